"""Problem 6: the structure of pages in HTML, Markdown, wiki markup, LaTeX or none, without the markup.

A page is parsed into a tree: the page, its containers (templates, tables, comments, scripts, code blocks, and what
nothing closes) and the elements that stand in them, wherever their marks occur. Which nodes a reader sees as content
is told by a tree-structured graphical model: each node is content or not; unary potentials hang on its kind and on its
features (what the lines around it begin with, its length, its links), potentials of parent and child on both kinds and
states. They are counted on labelled pages: pages as they are, labelled by their containers, and the same pages with
the closing mark of a container taken away, labelled by where the container ended before. So nothing of the parse tells
the labels of what stands behind a mark that isn't closed; the features do. Sum-product message passing, upward from the
leaves and downward from the root, gives each node's marginal. All trees of a batch are passed together, one array step
per depth. Elements whose marginal is above one half come out, with what a reader sees of them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import hash_sample, latest, map_text, strings

KINDS = ("page", "template", "table", "comment", "script", "note", "literal", "code", "formula", "heading", "list_item", "unclosed")
HIDDEN = frozenset({"template", "table", "comment", "script", "note", "unclosed"})
OPAQUE = frozenset({"comment", "script", "code", "formula", "literal"})
#: Pages that train the potentials, at most (those with the smallest hashes of their text).
FIT_ROWS = 2_000
#: Pages' worth of prior that what stands in a container that hides is hidden.
PRIOR = 20.0
#: Containers of a page that are opened in turn for training, at most.
OPENED = 3


@dataclass
class Node:
    """A part of a page: its kind, where it stands, its parent's index, what it says, and the cell of its features."""

    kind: str
    start: int
    end: int
    parent: int = -1
    content: str = ""
    depth: int = field(default=0)
    cell: int = field(default=0)


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def without_blank_ends(code: str) -> str:
    lines = code.replace("\r\n", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


# --- which markup -----------------------------------------------------------------------------------------------------

_SIGNS = {
    "html": (r"<!DOCTYPE|<html\b|<body\b|<div\b|</?h[1-6]\b|</?li\b|</?[uo]l\b|<script\b|<pre><code|<p>|<br\b", r"<span class|<a\s+href|</?(?:b|i|em|strong)>|<pre\b"),
    "latex": (r"\\documentclass|\\usepackage|\\begin\{(?!equation|align)|\\(?:sub)*section\*?\{|\\item\b|\\(?:chapter|paragraph)\*?\{", r"\\(?:textbf|emph|underline|textit|href|cite|label|footnote|begin)\{|\{\\(?:it|bf|em)\s|\\&"),
    "wiki": (r"\{\{|\[\[|^=+[^=\n].*[^=\n]=+\s*(?:<!--.*-->\s*)?$|</?(?:nowiki|ref|source|syntaxhighlight|math|gallery)\b|^\{\||__[A-Z]{3,}__|<small>|<span style", r"''|\[https?://\S+ [^\]\n]+\]|^[*#]{2,}\s*[^*#\s]|^[#*][^\s*#]|^#.*\n#|<pre\b"),
    "markdown": (r"^(?:`{3,}|~{3,})|\]\(\w|^(?:={3,}|-{3,})\s*$|(?:\A|\n\n)#{1,6} [^\n]+\n(?:\n|\Z)", r"(?<!\S)(?:\*\*|__|~~|`|_)[^\s*_`~].*?(?:\*\*|__|~~|`|_)|^#{1,6} |^\s*[-+] |^\s*\d+[.)] |^\s+\* |\$[^\s\d$][^$\n]*\$"),
}
_SIGNS = {name: tuple(re.compile(p, re.MULTILINE | (re.IGNORECASE if name == "html" else 0)) for p in pair) for name, pair in _SIGNS.items()}


_CODE_OPEN = re.compile(r"<(?P<tag>pre|source|syntaxhighlight)\b[^<>]*>(?:<code[^<>]*>)?|\\begin\{(?P<env>verbatim\*?|lstlisting)\}|^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*\n", re.IGNORECASE | re.MULTILINE)


def _without_code(text: str) -> str:
    """The text with the marks of its code blocks, but not what stands in them."""
    out, pos, at = [], 0, 0
    unclosed: set[str] = set()
    while m := _CODE_OPEN.search(text, at):
        at = m.end()
        if m["tag"] and m[0].endswith("/>"):
            continue
        key = m["tag"].lower() if m["tag"] else m["env"] or m["fence"]
        if key in unclosed:
            continue
        end = _code_end(key).search(text, at)
        if end is None:
            unclosed.add(key)
            continue
        out.append(text[pos:at])
        pos, at = end.start(), end.end()
    return "".join([*out, text[pos:]])


@lru_cache(64)
def _code_end(key: str) -> re.Pattern:
    if key[0] in "`~":
        return re.compile(rf"^[ ]{{0,3}}{key}", re.MULTILINE)
    return re.compile(rf"</{key}\s*>" if key.isalpha() and key not in ("verbatim", "lstlisting") else rf"\\end\{{{re.escape(key)}\}}", re.IGNORECASE)


def markup_of(text: str) -> str:
    """html, latex, wiki, markdown or none: by sure signs (weight 3) and likely ones, all of them counted."""
    score = {}
    text = _without_code(text)
    for name, (sure, likely) in _SIGNS.items():
        n = 0
        for pattern, weight in ((sure, 3), (likely, 1)):
            n += weight * sum(1 for _ in pattern.finditer(text))
        score[name] = n
    best = max(score, key=lambda k: (score[k], k == "wiki"))
    return best if score[best] else "none"


# --- wiki markup ------------------------------------------------------------------------------------------------------

_WIKI_TOKEN = re.compile(r"<!--|<(?P<raw>nowiki|pre|source|syntaxhighlight|math|ref|gallery|script|style)\b(?P<attr>[^<>]*?)(?P<closed>/)?>|\{\{|\}\}|^\{\||^\|\}", re.IGNORECASE | re.MULTILINE)
_WIKI_LINE = re.compile(r"^(?:(?P<eq>={1,6})(?P<head>.+?)(?P=eq)[ \t]*(?:<!--.*?-->[ \t]*)*$|(?P<list>[:;]*[*#][*#:;]*)[ \t]*(?P<item>.*)$)", re.MULTILINE)
_RAW_KIND = {"nowiki": "literal", "pre": "code", "source": "code", "syntaxhighlight": "code", "math": "formula", "ref": "note", "gallery": "table", "script": "script", "style": "script"}
_DROPPED_LINK = re.compile(r"\[\[\s*(?:file|image|category|media|fichier|catégorie|tập tin|thể loại|berkas|kategori|文件|分类|ไฟล์|หมวดหมู่|ໝວດ|ຮູບ|រូបភាព|ឯកសារ|ចំណាត់ថ្នាក់ក្រុម|[a-z]{2,3})\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.IGNORECASE)
# What a redirect begins with.
_REDIRECT = re.compile(r"\s*#\s*(?:redirect(?:ion)?|renvoi|ប្តូរទីតាំង|ប្ដូរទីតាំង|បញ្ជូនបន្ត|重定向|เปลี่ยนทาง|ປ່ຽນທາງ|đổi|alih)\s*:?\s*\[\[[^\]]*\]\]", re.IGNORECASE)
_KEEP = "\ue000{}\ue001"


@lru_cache(64)
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


def _wiki_containers(text: str) -> list[Node]:
    nodes: list[Node] = []
    stack: list[Node] = []
    unclosed: set[str] = set()  # what isn't closed after one place isn't after a later one
    pos = 0
    while m := _WIKI_TOKEN.search(text, pos):
        pos = m.end()
        if m[0] == "<!--":
            end = text.find("-->", pos)
            pos = len(text) if end < 0 else end + 3
            nodes.append(Node("comment", m.start(), pos))
        elif m["raw"]:
            kind = _RAW_KIND[m["raw"].lower()]
            if m["closed"]:
                nodes.append(Node(kind if kind == "note" else "literal", m.start(), pos))
                continue
            tag = m["raw"].lower()
            close = None if tag in unclosed else _closer(tag).search(text, pos)
            if close is None:
                unclosed.add(tag)
                continue
            inner = text[pos : close.start()]
            if kind == "code":
                inner = without_blank_ends(_unwrapped(html.unescape(inner) if m["raw"].lower() == "pre" else inner))
            nodes.append(Node(kind, m.start(), close.end(), content=inner.strip() if kind == "formula" else inner))
            pos = close.end()
        elif m[0] in ("{{", "{|"):
            stack.append(Node("template" if m[0] == "{{" else "table", m.start(), len(text)))
        else:
            kind = "template" if m[0] == "}}" else "table"
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].kind == kind:
                    stack[k].end = pos
                    nodes.append(stack[k])
                    del stack[k:]
                    break
    end = 0
    for node in stack:  # what nothing closes may reach to the end of its paragraph
        if node.start >= end:
            stop = _PARAGRAPH.search(text, node.start)
            end = stop.start() if stop else len(text)
            nodes.append(Node("unclosed", node.start, end))
    return nodes


_PARAGRAPH = re.compile(r"\n[ \t]*\n|\n=")


def _unwrapped(code: str) -> str:
    m = re.fullmatch(r"\s*<nowiki>(.*)</nowiki>\s*", code, re.DOTALL | re.IGNORECASE)
    return m[1] if m else code


def wiki_inline(text: str) -> str:
    """What a reader sees of a line of wiki markup."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[1])
        return _KEEP.format(len(kept) - 1)

    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.DOTALL)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", keep, text, flags=re.DOTALL | re.IGNORECASE)
    text = re.sub(r"<math\b[^>]*>(.*?)</math>", lambda m: keep(re.match(r"\s*(.*?)\s*\Z", m[1], re.DOTALL)), text, flags=re.DOTALL | re.IGNORECASE)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", text, flags=re.DOTALL | re.IGNORECASE)
    while (less := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
        text = less
    text = re.sub(r"\{\{[^\n]*", "", text)
    text = _DROPPED_LINK.sub("", text)
    text = re.sub(r"\[\[:?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?:)?//\S+\s+([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\[(?:https?:)?//[^\s\]]+\]", "", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>|__[A-Z]{3,}__", "", text)
    text = html.unescape(text)
    text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text)
    return tidy(text)


def parse_wiki(text: str) -> list[Node]:
    nodes = _wiki_containers(text)
    redirect = _REDIRECT.match(text)
    for m in _WIKI_LINE.finditer(text):
        if m["eq"]:
            nodes.append(Node("heading", m.start(), m.end(), content=wiki_inline(m["head"])))
        elif not (redirect and m.start() < redirect.end()):
            nodes.append(Node("list_item", m.start(), m.end(), content=wiki_inline(_whole_item(text, m))))
    return nodes


_ITEM_END = re.compile(r"\}\}|-->")


def _whole_item(text: str, m: re.Match) -> str:
    """The item's line, and further lines while a template or comment that begins in it is open."""
    item, end = m["item"], m.end()
    while (item.count("{{") > item.count("}}") or item.count("<!--") > item.count("-->")) and end < len(text):
        nxt = text.find("\n", end + 1)
        nxt = len(text) if nxt < 0 else nxt
        if not _ITEM_END.search(text, end):
            break
        item, end = text[m.start("item") : nxt], nxt
    return item


# --- HTML -------------------------------------------------------------------------------------------------------------

_HTML_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>", re.DOTALL | re.IGNORECASE)
_FORMULA_HTML = re.compile(r"\$\$|\\\(|\\\[|<math\b[^>]*>|\\begin\{(?P<env>(?:equation|align|gather|multline|displaymath)\*?)\}", re.IGNORECASE)


def _formulas(text: str, opens: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Start, end and content of each formula: from what opens one (``opens``; a group ``b`` is a whole one on a line) to
    the next mark that closes it. What nothing closes after one place isn't looked for again."""
    unclosed: set[str] = set()
    pos = 0
    while m := opens.search(text, pos):
        pos = m.end()
        if m.groupdict().get("b") is not None:
            yield m.start(), pos, m["b"].strip()
            continue
        close = {"$$": "$$", "\\(": "\\)", "\\[": "\\]"}.get(m[0]) or (f"\\end{{{m['env']}}}" if m["env"] else "</math>")
        end = None if close in unclosed else _formula_end(close, opens.flags & re.IGNORECASE).search(text, pos + (close != "</math>"))
        if end is None:
            unclosed.add(close)
            pos = m.start() + 1
            continue
        yield m.start(), end.end(), text[pos : end.start()].strip()
        pos = end.end()


@lru_cache(64)
def _formula_end(close: str, flags: int) -> re.Pattern:
    return re.compile(re.escape(close), flags)


def _with_formulas(text: str, opens: re.Pattern, shown: Callable[[str], str]) -> str:
    out, pos = [], 0
    for start, end, content in _formulas(text, opens):
        out += [text[pos:start], shown(content)]
        pos = end
    return "".join([*out, text[pos:]])


def html_inline(text: str) -> str:
    text = re.sub(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?</\1\s*>", "", text, flags=re.DOTALL | re.IGNORECASE)
    text = re.sub(r"<(?:br|/p|/div|/td|/th)\b[^<>]*>", " ", text, flags=re.IGNORECASE)
    text = re.sub(r"\\[(\[]\s*(.*?)\s*\\[)\]]", r"\1", text, flags=re.DOTALL)
    return tidy(re.sub(r"</?[A-Za-z][^<>]*>", "", text))


def parse_html(text: str) -> list[Node]:
    nodes: list[Node] = []
    heading: tuple[int, int, str] | None = None
    items: list[tuple[int, int, list]] = []  # begin, begin of content, nested spans
    lists: list[int] = []
    opened: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    skip = 0

    def close_item(end: int, stop: int) -> None:
        begin, inner, nested = items.pop()
        shown, at = [], inner
        for a, b in nested:
            shown.append(text[at:a])
            at = b
        nodes.append(Node("list_item", begin, stop, content=html_inline(" ".join([*shown, text[at:end]]) if nested else text[inner:end])))

    for m in _HTML_TOKEN.finditer(text):
        if m.start() < skip:
            continue
        if m["tag"] is None:
            if m[0].startswith("<!--"):
                nodes.append(Node("comment", m.start(), m.end()))
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if tag in ("script", "style", "pre", "textarea", "head") and not closing:
            close = None if tag in unclosed else _closer(tag).search(text, m.end())
            if close is None:
                unclosed.add(tag)
            if close:
                if tag == "pre":
                    inner = re.fullmatch(r"\s*<code\b[^<>]*>(.*?)(?:</code\s*>)?\s*", text[m.end() : close.start()], re.DOTALL | re.IGNORECASE)
                    code = inner[1] if inner else text[m.end() : close.start()]
                    nodes.append(Node("code", m.start(), close.end(), content=without_blank_ends(html.unescape(re.sub(r"</?(?:span|b|i|em|strong|code|a)\b[^<>]*>", "", code)))))
                else:
                    nodes.append(Node("script", m.start(), close.end()))
                if tag != "head":
                    skip = close.end()
        elif re.fullmatch("h[1-6]", tag):
            if not closing:
                heading = (m.start(), m.end(), tag)
            elif heading:
                nodes.append(Node("heading", heading[0], m.end(), content=html_inline(text[heading[1] : m.start()])))
                heading = None
        elif tag == "li":
            depth = lists[-1] if lists else 0
            if len(items) > depth:
                close_item(m.start(), m.end() if closing else m.start())
            if not closing:
                items.append((m.start(), m.end(), []))
        elif tag in ("ul", "ol"):
            if not closing:
                lists.append(len(items))
                opened.setdefault("list", []).append(m.start())
            elif lists:
                while len(items) > lists[-1]:
                    close_item(m.start(), m.start())
                lists.pop()
                begin = opened["list"].pop()
                if items:
                    items[-1][2].append((begin, m.end()))
        elif tag == "table":
            if not closing:
                opened.setdefault("table", []).append(m.start())
            elif opened.get("table"):
                nodes.append(Node("table", opened["table"].pop(), m.end()))
    while items:
        close_item(len(text), len(text))
    for start, end, content in _formulas(text, _FORMULA_HTML):
        nodes.append(Node("formula", start, end, content=html.unescape(content).strip()))
    return nodes


# --- Markdown ---------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^(?P<in>[ ]{0,3}(?:[-*+]\s+)?)(?P<f>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<code>.*?)(?:^[ ]{0,3}(?P=f)[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_MD_LINE = re.compile(r"^[ ]{0,3}(?P<hash>#{1,6})(?:[ \t]+(?P<head>.*?))?(?:[ \t]+#+)?[ \t]*$|^(?P<set>[^\n\s][^\n]*)\n[ ]{0,3}(?:=+|-{2,})[ \t]*$|^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?P<item>\S.*)$", re.MULTILINE)
_FORMULA_MD = re.compile(r"\$\$|(?<![\\$\w])\$(?![\s$])(?P<b>[^$\n]*?[^\s$\\])\$(?![\d$])|\\\(|\\\[|\\begin\{(?P<env>(?:equation|align|gather|multline)\*?)\}|<math\b[^>]*>")
_MD_SPAN = re.compile(r"(?<!`)(`+)(?!`)(?P<code>.+?)(?<!`)\1(?!`)")


def markdown_inline(text: str) -> str:
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return _KEEP.format(len(kept) - 1)

    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.DOTALL)
    text = _MD_SPAN.sub(lambda m: keep(m["code"].strip() if m["code"].strip() else m["code"]), text)
    text = _with_formulas(text, _FORMULA_MD, keep)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"\[\^[^\]\s]+\]", "", text)
    text = re.sub(r"!\[[^\]]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", "", text)
    text = re.sub(r"\[([^\[\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^\s<>]+)>", r"\1", text)
    text = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", r"\1", text)
    text = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", text))
    for _ in range(2):
        text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text)
    return " ".join(text.split())


def parse_markdown(text: str) -> list[Node]:
    nodes = [Node("code", m.start(), m.end(), content=without_blank_ends(m["code"])) for m in _FENCE.finditer(text)]
    nodes += [Node("comment", m.start(), m.end()) for m in re.finditer(r"<!--.*?(?:-->|\Z)", text, re.DOTALL)]
    for m in re.finditer(r"<pre\b[^<>]*>(?:\s*<code[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", text, re.DOTALL | re.IGNORECASE):
        nodes.append(Node("code", m.start(), m.end(), content=without_blank_ends(html.unescape(m[1]))))
    for m in re.finditer(r"(?:\A|(?<=\n\n))(?:(?:    |\t)[^\n]*(?:\n+(?=    |\t)|\n?))+", text):
        before = text[: m.start()].rstrip("\n").rsplit("\n", 1)[-1]
        if m[0].strip() and not re.match(r"\s*(?:[-*+]|\d+[.)])\s", before):
            nodes.append(Node("code", m.start(), m.end(), content=without_blank_ends(re.sub(r"^(?:    |\t)", "", m[0], flags=re.MULTILINE))))
    nodes += [Node("literal", m.start(), m.end()) for m in _MD_SPAN.finditer(text)]
    for m in _MD_LINE.finditer(text):
        if m["hash"]:
            nodes.append(Node("heading", m.start(), m.end(), content=markdown_inline(m["head"] or "")))
        elif m["set"] is not None:
            if not re.match(r"(?:[-*+]|\d+[.)])\s|[>|]", m["set"]):
                nodes.append(Node("heading", m.start(), m.end(), content=markdown_inline(m["set"])))
            elif re.match(r"(?:[-*+]|\d+[.)])\s", m["set"]):
                nodes.append(Node("list_item", m.start(), m.end(), content=markdown_inline(re.sub(r"^(?:[-*+]|\d+[.)])\s+", "", m["set"]))))
        elif not re.fullmatch(r"[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*", m[0]):
            nodes.append(Node("list_item", m.start(), m.end(), content=markdown_inline(m["item"])))
    nodes += [Node("formula", start, end, content=content) for start, end, content in _formulas(text, _FORMULA_MD)]
    return nodes


# --- LaTeX ------------------------------------------------------------------------------------------------------------

_LATEX_CODE = re.compile(r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt|Verbatim)\}(?P<opt>(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?)(?P<code>.*?)(?:\\end\{(?P=env)\}|\Z)", re.DOTALL)
_LATEX_FORMULA = re.compile(r"\$\$|(?<![\\$])\$(?![\s$])(?P<b>[^$\n]*?[^\s$\\])\$(?![\d$])|\\\(|\\\[|\\begin\{(?P<env>(?:equation|align|gather|multline|displaymath|eqnarray|math)\*?)\}")
_LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{")
_LATEX_STOP = re.compile(r"\\(?P<what>item|begin|end)\b(?:\{(?P<env>[^}]*)\})?")


_BRACE = re.compile(r"\\.|[{}]|\n\n", re.DOTALL)


def _groups(text: str) -> dict[int, int]:
    """By the place after each brace that opens a group, where the group closes. None goes over a blank line."""
    found: dict[int, int] = {}
    stack: list[int] = []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            stack.append(m.end())
        elif m[0] == "}" and stack:
            found[stack.pop()] = m.start()
        elif m[0] == "\n\n":
            stack.clear()
    return found


def latex_inline(text: str) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*\n?", "", text)
    text = _with_formulas(text, _LATEX_FORMULA, lambda c: c.replace("\\", "\ue002").replace("{", "\ue003").replace("}", "\ue004"))
    text = re.sub(r"\\(?:cite[a-z]*|label|ref|eqref|pageref|footnote|footnotemark|index|vspace|hspace|thanks)\*?(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\href\{[^{}]*\}", "", text)
    text = re.sub(r"\\url\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\([&%$#_{}])", lambda m: chr(0xE010 + "&%$#_{}".index(m[1])), text)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\s?(?=\{)|\\[A-Za-z]+\*?\s*|\\(?=\s)", "", text)
    text = re.sub(r"[{}]", "", text).replace("~", " ").replace("``", "“").replace("''", "”")
    text = re.sub("[\ue010-\ue016]", lambda m: "&%$#_{}"[ord(m[0]) - 0xE010], text)
    return tidy(text.replace("\ue002", "\\").replace("\ue003", "{").replace("\ue004", "}"))


def parse_latex(text: str) -> list[Node]:
    nodes = [Node("code", m.start(), m.end(), content=without_blank_ends(m["code"])) for m in _LATEX_CODE.finditer(text)]
    begins, ends = [n.start for n in nodes], [n.end for n in nodes]

    def inside(at: int) -> bool:
        k = bisect_right(begins, at) - 1
        return k >= 0 and at < ends[k]

    nodes += [Node("comment", m.start(), m.end()) for m in re.finditer(r"(?<!\\)%[^\n]*", text) if not inside(m.start())]
    nodes += [Node("comment", m.start(), m.end()) for m in re.finditer(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)", text, re.DOTALL)]
    nodes += [Node("table", m.start(), m.end()) for m in re.finditer(r"\\begin\{(tabular|table)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)", text, re.DOTALL)]
    groups, heads = _groups(text), list(_LATEX_HEAD.finditer(text))
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)][: len(heads)], strict=True):
        end = groups.get(m.end())
        if end is None:  # a group that nothing closes ends with its line
            line = text.find("\n", m.end(), after)
            end = after if line < 0 else line
        end = min(end, after)  # no heading holds another
        nodes.append(Node("heading", m.start(), end + 1, content=latex_inline(text[m.end() : end])))
    open_item: tuple[int, int] | None = None
    depth = 0
    for m in _LATEX_STOP.finditer(text):
        if inside(m.start() - 1):
            if m["what"] == "item":
                nodes.append(Node("list_item", m.start(), text.find("\n", m.end()) % (len(text) + 1), content="item"))
            continue
        if m["what"] == "begin" and m["env"] not in ("itemize", "enumerate", "description"):
            continue
        if m["what"] == "end" and m["env"] not in ("itemize", "enumerate", "description", "document"):
            continue
        if open_item:
            nodes.append(Node("list_item", open_item[0], m.start(), content=latex_inline(text[open_item[1] : m.start()])))
            open_item = None
        depth += (m["what"] == "begin") - (m["what"] == "end")
        if m["what"] == "item":
            label = re.compile(r"\s*\[[^\]\n]*\]").match(text, m.end())
            open_item = (m.start(), label.end() if label else m.end())
    if open_item:
        nodes.append(Node("list_item", open_item[0], len(text), content=latex_inline(text[open_item[1] :])))
    nodes += [Node("formula", start, end, content=content) for start, end, content in _formulas(text, _LATEX_FORMULA)]
    return nodes


PARSERS = {"wiki": parse_wiki, "html": parse_html, "markdown": parse_markdown, "latex": parse_latex, "none": parse_markdown}
INLINE = {"wiki": wiki_inline, "html": html_inline, "markdown": markdown_inline, "latex": latex_inline, "none": tidy}


def parse(text: str, kind: str | None = None) -> list[Node]:
    """The page's tree: the page first, then all parts in the order of their beginning, parents before children.
    ``kind`` is the markup, if it is known."""
    found = PARSERS[kind or markup_of(text)](text)
    found.sort(key=lambda n: (n.start, -n.end, KINDS.index(n.kind)))
    nodes = [Node("page", 0, len(text) + 1)]
    open_: list[int] = [0]
    for n in found:
        while len(open_) > 1 and (n.start >= nodes[open_[-1]].end):
            open_.pop()
        n.parent = open_[-1]
        n.end = min(n.end, nodes[n.parent].end)
        n.depth = nodes[n.parent].depth + 1
        n.cell = features(text, n)
        nodes.append(n)
        open_.append(len(nodes) - 1)
    return nodes


# --- the graphical model ----------------------------------------------------------------------------------------------


#: Cells of features: what the lines before and after begin with, length (three steps), links.
CELLS = 2 * 2 * 3 * 2


def _is_field(text: str, begin: int) -> bool:
    """Whether the line that begins there is a field of a template or a row of a table."""
    while begin < len(text) and text[begin] in " \t":
        begin += 1
    return text[begin : begin + 1] in ("|", "!") and begin < len(text)


def features(text: str, n: Node) -> int:
    line = text.rfind("\n", 0, n.start)
    before = line >= 0 and _is_field(text, text.rfind("\n", 0, line) + 1)
    end = text.find("\n", max(n.start, n.end - 1))
    after = end >= 0 and _is_field(text, end + 1)
    size = min(2, (n.end - n.start) // 24)
    links = text.find("[", n.start, n.end) >= 0 or text.find("://", n.start, n.end) >= 0
    return ((before * 2 + after) * 3 + size) * 2 + links


def label(nodes: list[Node]) -> np.ndarray:
    """Labels of a whole page's nodes: content unless hidden by its kind or standing in what hides."""
    out = np.ones(len(nodes), np.int64)
    for i, n in enumerate(nodes[1:], 1):
        parent = nodes[n.parent]
        hides = parent.kind in HIDDEN or parent.kind in OPAQUE or out[n.parent] == 0
        out[i] = 0 if n.kind in HIDDEN or hides else 1
    return out


def labelled(text: str) -> Iterator[tuple[list[Node], np.ndarray]]:
    """The page with its labels, then with one container after the other left open, labelled as if it were closed. Pages
    with something unclosed tell nothing."""
    kind = markup_of(text)
    nodes = parse(text, kind)
    if any(n.kind == "unclosed" for n in nodes):
        return
    yield nodes, label(nodes)
    closed = [n for n in nodes if n.kind in ("template", "table") and text[n.end - 2 : n.end] in ("}}", "|}")] if kind == "wiki" else []
    for gone in sorted(closed, key=lambda n: n.start - n.end)[:OPENED]:
        cut = gone.end - 2
        hidden = np.zeros(len(text) + 2, np.int64)  # +1 where a part that hides begins, -1 where it ends
        for n in nodes[1:]:
            if n.kind in HIDDEN or n.kind in OPAQUE:
                hidden[n.start + 1] += 1
                hidden[n.end] -= 1
        hidden = np.cumsum(hidden)
        opened = parse(text[:cut] + text[gone.end :], "wiki")
        states = [0 if n.kind in HIDDEN or hidden[n.start if n.start < cut else n.start + 2] else 1 for n in opened[1:]]
        yield opened, np.array([1, *states], np.int64)


class TreeModel:
    """Log-potentials: ``unary`` by kind and state, ``cells`` by kind, cell of features and state, ``pair`` by kinds and
    states of parent and child."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray, cells: np.ndarray):
        self.unary, self.pair, self.cells = unary, pair, cells

    SHAPES = ((len(KINDS), 2), (len(KINDS), 2, len(KINDS), 2), (len(KINDS), CELLS, 2))

    @classmethod
    def count(cls, pages: list[list[Node]], labels: list[np.ndarray]) -> np.ndarray:
        """Kinds and states, kinds and states of parents and children, kinds and cells and states, as one flat array."""
        unary, pair, cells = (np.zeros(s) for s in cls.SHAPES)
        for nodes, states in zip(pages, labels, strict=True):
            for n, s in zip(nodes, states, strict=True):
                kind = KINDS.index(n.kind)
                unary[kind, s] += 1
                cells[kind, n.cell, s] += 1
                if n.parent >= 0:
                    pair[KINDS.index(nodes[n.parent].kind), states[n.parent], kind, s] += 1
        return np.concatenate([unary.reshape(-1), pair.reshape(-1), cells.reshape(-1)])

    @classmethod
    def of_counts(cls, counts: np.ndarray, alpha: float = 0.5) -> TreeModel:
        parts = np.split(counts, np.cumsum([np.prod(s) for s in cls.SHAPES])[:-1])
        unary, pair, cells = (p.reshape(s) + alpha for p, s in zip(parts, cls.SHAPES, strict=True))
        for k, kind in enumerate(KINDS):
            if kind == "unclosed":  # where the missing mark stood isn't known: features tell
                pair[k] = 1.0
            elif kind in HIDDEN or kind in OPAQUE:
                pair[k, :, :, 0] += PRIOR
        root = np.log(unary / unary.sum(axis=1, keepdims=True))
        root[1:] = 0.0  # all but the page get their evidence through their parents and features
        return cls(root, np.log(pair / pair.sum(axis=3, keepdims=True)), np.log(cells / cells.sum(axis=1, keepdims=True)))

    @classmethod
    def fit(cls, pages: list[list[Node]], labels: list[np.ndarray]) -> TreeModel:
        return cls.of_counts(cls.count(pages, labels))

    def marginals(self, kind: np.ndarray, parent: np.ndarray, depth: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """P(content) of all nodes of a forest: one upward and one downward pass, a step per depth."""
        belief = self.unary[kind] + self.cells[kind, cell]
        message = np.zeros((len(kind), 2))
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        for at in reversed(levels[1:]):
            table = self.pair[kind[parent[at]], :, kind[at], :]
            message[at] = np.logaddexp(table[:, :, 0] + belief[at, None, 0], table[:, :, 1] + belief[at, None, 1])
            np.add.at(belief, parent[at], message[at])
        for at in levels[1:]:
            table = self.pair[kind[parent[at]], :, kind[at], :]
            cavity = belief[parent[at]] - message[at]
            belief[at] += np.logaddexp(table[:, 0, :] + cavity[:, 0, None], table[:, 1, :] + cavity[:, 1, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def fit_tree_model(pages: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> TreeModel:
    """Potentials from the labelled pages: counted where the pages are, summed by cell."""
    part = hash_sample(pages.select(F.col(text).alias("_text")), "_text", rows).select("_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [page for t in strings(batch, "_text") for page in labelled(t)]
        counts = TreeModel.count([nodes for nodes, _ in pages], [states for _, states in pages])
        cells = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells], pa.float64())], ["cell", "n"])

    total = np.zeros(sum(int(np.prod(s)) for s in TreeModel.SHAPES))
    for r in map_text(part, "_text", run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    return TreeModel.of_counts(total)


ELEMENTS = ("heading", "list_item", "code", "formula")
_TITLE_MARK = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);|</?[A-Za-z][^<>]*>|<!--|''|\[\[|\{\{|\*\*|__|~~|`[^`]+`|\]\(|\\[A-Za-z]+\{|\{\\[A-Za-z]+\s|\$[^$\s][^$]*\$|\\[&%#_$]|(?<!\S)[*_](?=\S)[^*_]+[*_](?!\S)|\[https?:")


def clean_title(title: str) -> str | None:
    """What a reader sees of a title that holds markup or entities; None for a plain one."""
    if not _TITLE_MARK.search(title):
        return None
    if re.search(r"\\[A-Za-z]+\{|\{\\[A-Za-z]+\s|\\[&%#_$]", title):
        out = latex_inline(title)
    elif re.search(r"''|\[\[|\{\{|<(?:ref|nowiki)|\[https?:", title):
        out = wiki_inline(title)
    elif re.search(r"\*\*|__|~~|`|\]\(|(?<!\S)[*_]\S", title):
        out = markdown_inline(title)
    else:
        out = html_inline(title)
    return out if out != title else None


def elements(texts: list[str | None], titles: list[str | None], model: TreeModel) -> list[list[tuple[str, int, str]]]:
    """(kind, nth, content) of each page's elements in page order, its title first if it holds markup."""
    trees = [parse(t) if t else [] for t in texts]
    sizes = np.array([len(t) for t in trees])
    first = np.cumsum(sizes) - sizes
    kind = np.array([KINDS.index(n.kind) for t in trees for n in t], np.int64)
    parent = np.array([n.parent + first[i] if n.parent >= 0 else -1 for i, t in enumerate(trees) for n in t], np.int64)
    depth, cell = (np.array([getattr(n, what) for t in trees for n in t], np.int64) for what in ("depth", "cell"))
    seen = model.marginals(kind, parent, depth, cell) if len(kind) else np.zeros(0)
    out = []
    for i, tree in enumerate(trees):
        rows: list[tuple[str, int, str]] = []
        title = clean_title(titles[i]) if titles[i] else None
        if title:
            rows.append(("title", 1, title))
        nth = dict.fromkeys(ELEMENTS, 0)
        for k, n in enumerate(tree):
            if n.kind in nth and seen[first[i] + k] > 0.5 and n.content:
                nth[n.kind] += 1
                rows.append((n.kind, nth[n.kind], n.content))
        out.append(rows)
    return out


def with_elements(df: DataFrame, model: TreeModel, key: str = "page_id", text: str = "text", title: str = "title", order: str = "loaded_at") -> DataFrame:
    """(``key``, ``kind``, ``nth``, ``content``) of each page's elements. Null and blank texts have none (a title may
    still give its row); a page delivered again counts once, as delivered last."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("nth", pa.int32()), ("content", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = elements(strings(batch, "_text"), strings(batch, "_title"), shared.value)
        rows = pa.array([[{"kind": k, "nth": n, "content": c} for k, n, c in page] for page in found], kinds)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], [key, order, "rows"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, order))
    found = map_text(df.select(key, order, F.col(title).alias("_title"), F.col(text).alias("_text")), "_text", run, f"{own}, rows array<struct<kind:string,nth:int,content:string>>")
    return latest(found, [key], ["rows"], order).select(key, F.explode("rows").alias("r")).select(key, "r.kind", "r.nth", "r.content")


def clean_text(text: str | None, model: TreeModel) -> str | None:
    """The page as clean text: headings as ``# ``, list items as ``- ``, code between fences, formulas between dollars,
    and prose, each block on its own line; what a reader doesn't see is left out."""
    if text is None:
        return None
    kind = markup_of(text)
    nodes = parse(text, kind)
    arrays = (np.array([KINDS.index(n.kind) for n in nodes]), np.array([n.parent for n in nodes]), np.array([n.depth for n in nodes]), np.array([n.cell for n in nodes]))
    seen = model.marginals(*arrays)
    forms = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "${}$"}
    out, at = [], 0

    def prose(part: str) -> None:
        for block in re.split(r"\n\s*\n", part):
            if shown := INLINE[kind](block):
                out.append(shown)

    for n, s in zip(nodes[1:], seen[1:], strict=True):
        if n.start < at:
            continue
        if n.kind in HIDDEN or n.kind in ("heading", "list_item", "code") or (n.kind == "formula" and "\n" in text[max(0, n.start - 1) : n.start]):
            prose(text[at : n.start])
            if s > 0.5 and n.kind in forms and n.content:
                out.append(forms[n.kind].format(n.content))
            line = text.find("\n", n.start, n.end) if n.kind == "unclosed" else -1  # of what isn't closed, the first line
            at = line if line >= 0 else n.end
    prose(text[at:])
    return "\n".join(out)


def with_clean_text(df: DataFrame, model: TreeModel, key: str = "page_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``markup`` and ``clean``: which markup a page's text is in, and the text without it
    (null for null)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch, "_text")
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(carry))), pa.array([t and markup_of(t) for t in texts], pa.string()), pa.array([clean_text(t, shared.value) for t in texts], pa.string())], [key, *carry, "markup", "clean"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return map_text(df.select(key, *carry, F.col(text).alias("_text")), "_text", run, f"{own}, markup string, clean string")
