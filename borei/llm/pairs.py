"""Problem 4: defective answers of instruction pairs, each with its kind of defect.

``other_language`` compares the language posteriors of prompt and answer (naive Bayes over hashed character n-grams,
names left out of the answer's evidence). ``truncated`` uses an end-of-text model: how likely a text ends after its
last n-grams, from counts over the complete texts among the inputs of the whole table, summed up by tree into arrays
of fixed size. The other kinds are told from the folded texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import codepoints, latest, map_text, mix, slices, strings, table_sums
from borei.llm.confusables import consistent_forms
from borei.llm.langid import NAMES, LanguageModel, _read_as, _script_table, fold_digits
from borei.llm.overlap import folded
from borei.llm.sentences import MAYBE_LAST, _ends_at_point
from borei.session import spread

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

# What stands for no answer, what may precede a repeated question, and how answering is declined.
PLACEHOLDERS = "n/a na n.a tbd tba todo null none nil nan undefined empty blank placeholder xxx no answer|no output|to be done|insert answer here|answer here|lorem ipsum|à compléter|cập nhật sau"
LABELS = "question|answer|instruction|input|output|prompt|q|a|réponse|consigne|câu hỏi|trả lời|câu trả lời|yêu cầu|សំណួរ|ចម្លើយ|คำถาม|คำตอบ|ຄຳຖາມ|ຄຳຕອບ|问题|问|答|回答|pertanyaan|jawaban|soal"
_I = r"(?:i|we)(?: am|'m| are|'re)?"
REFUSALS = [
    rf"\b{_I} (?:can(?:not|'t| not)|could(?: not|n't)|won't|will not|must (?:decline|refuse)|have to decline|decline|refuse|am unable|unable|not able|not allowed|not permitted|do(?: not|n't) (?:wish|want|have permission)|would (?:rather|prefer) not|prefer not)\b(?!.{{0,40}}\b(?:find|found) the)",
    r"\bmy (?:guidelines|rules|policy|instructions|programming|policies)\b.{0,30}\b(?:do(?: not|n't) allow|forbid|prevent|prohibit)",
    r"\bthis (?:request|question|topic) is (?:outside|beyond|not something)|\bis something (?:i|we) (?:won't|will not|can't|cannot)\b|\boutside (?:of )?what i (?:may|can)",
    r"\bje (?:ne (?:peux|puis|suis pas|saurais|veux)\b|préfère ne pas|refuse|dois (?:refuser|décliner)|suis (?:incapable|dans l'impossibilité)|décline)|\bil m'est impossible|\bmes (?:règles|consignes|directives) (?:m'interdisent|ne me permettent)|\bcette (?:demande|question) (?:dépasse|sort)",
    r"\btôi (?:không thể|không được phép|xin từ chối|từ chối|rất tiếc|không có quyền|xin phép không)|\byêu cầu này (?:nằm ngoài|vượt quá)|\bngoài khả năng của tôi",
    r"\bsaya (?:tidak (?:dapat|bisa|boleh|diizinkan|mampu)|menolak|terpaksa menolak|mohon maaf)|\bdi luar kemampuan saya",
    r"ខ្ញុំ(?:មិនអាច(?:ឆ្លើយ|ជួយ|ផ្ដល់|ផ្តល់|និយាយ|ធ្វើ)|គ្មានសិទ្ធិ|មិនត្រូវបានអនុញ្ញាត|សុំបដិសេធ|សូមបដិសេធ|បដិសេធ|ឆ្លើយមិនបាន|មិនឆ្លើយ)|ហួសពីសមត្ថភាពរបស់ខ្ញុំ",
    r"(?:ฉัน|ผม|ดิฉัน|เรา|ข้าพเจ้า)(?:ไม่สามารถ|ขอปฏิเสธ|ไม่ได้รับอนุญาต|ตอบไม่ได้)|ไม่สามารถ(?:ตอบ|ให้ข้อมูล|ช่วย)",
    r"(?:ຂ້ອຍ|ຂ້າພະເຈົ້າ)(?:ບໍ່ສາມາດ|ຂໍປະຕິເສດ|ບໍ່ໄດ້ຮັບອະນຸຍາດ|ຕອບບໍ່ໄດ້)|ບໍ່ສາມາດ(?:ຕອບ|ໃຫ້ຂໍ້ມູນ|ຊ່ວຍ)",
    r"我(?:无法|不能|没有权限|不便|拒绝|不被允许)|无法(?:回答|提供|协助)|(?:超出|不在)了?我的(?:能力|权限)",
]


@lru_cache(None)
def _refusal() -> re.Pattern:
    return re.compile("|".join(consistent_forms(REFUSALS)), re.IGNORECASE)


@lru_cache(None)
def _asks() -> re.Pattern:
    """Instructions that ask for a language."""
    latin, other = [], []
    for names in NAMES.values():
        for name in [*names.split("|")[0].split(), *names.split("|")[1:], *names.split("|")[0:1]]:
            if re.match("[a-zß-ɏḀ-ỿ]", name):
                if len(name) > 3 and " " not in name:
                    latin.append(re.escape(name))
                elif name.startswith(("tiếng ", "bahasa ")):
                    other.append(re.escape(name))
            else:
                other.append(re.escape(name))
    other = consistent_forms(other)
    latin += ["anh", "pháp", "việt", "lào", "thái", "trung", "khmer", "lao", "thai"]
    return re.compile(rf"\b(?:in|into|to|en|sang|sang tiếng|bằng tiếng|tiếng|ke|dalam|bahasa|language|langue)\s+(?:bahasa |tiếng |le |la |l')?(?:{'|'.join(latin)})\b|{'|'.join(other)}", re.IGNORECASE)


@lru_cache(None)
def _words(kind: str) -> frozenset[str]:
    values = {"placeholders": PLACEHOLDERS.replace("|", "\n").replace("na n.a", "na\nn.a"), "labels": LABELS.replace("|", "\n")}[kind]
    flat = [w for line in values.split("\n") for w in ([line] if kind == "labels" or " " in line and line in PLACEHOLDERS.split("|")[1:] else line.split())]
    return frozenset(folded(flat))


def is_empty(text: str, letters: str) -> bool:
    return not letters or letters in _words("placeholders")


def is_copy(instruction: str, extra: str, answer: str, letters: tuple[str, str, str]) -> bool:
    """Whether the answer's letters are the instruction's or the input's, once or more, at most with a label. A short
    input answered by itself is a copy only if it can't be a word that two languages share."""
    a, x, o = letters
    rest = o
    if len(x) >= 20:
        rest = rest.replace(x, "")
    elif x and rest.replace(x, "") == "" and rest:
        return not re.match("[A-Za-zÀ-ɏḀ-ỿ]", extra.strip())
    if len(a) >= 4:
        rest = rest.replace(a, "")
    return rest != o and (not rest or rest in _words("labels"))


_CAPITAL = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-ÞĐƯƠ][^\W\d_]*")


def _posteriors(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-posteriors up to a constant, and how many letters they rest on."""
    cps, starts = codepoints([f" {t.lower()} " for t in texts])
    cps = _read_as()[cps]
    letters = np.concatenate([[0], np.cumsum(_script_table()[cps] >> 7)])
    return np.diff(model.sums_at(fold_digits(cps), starts), axis=0) / 4, letters[starts[1:]] - letters[starts[:-1]]


# --- the end of texts -------------------------------------------------------------------------------------------------

END_BITS, END_ORDERS = 18, (1, 2, 3)


class EndModel:
    """How often n-grams occur in complete texts, and how often they end one."""

    def __init__(self, occurs: np.ndarray, ends: np.ndarray):
        self.occurs, self.ends = occurs, ends

    @staticmethod
    def _bucket(cps: np.ndarray, n: int) -> np.ndarray:
        h = np.full(max(len(cps) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + cps[k : k + len(h)]
        return (mix(h) >> np.uint64(64 - END_BITS)).astype(np.int64)

    @classmethod
    def count(cls, texts: list[str], occurs: np.ndarray, ends: np.ndarray) -> None:
        """Adds all n-grams of the texts, and those that end one."""
        cps, starts = codepoints([t.rstrip() for t in texts])
        cps, lengths = fold_digits(cps), np.diff(starts)
        left = np.repeat(starts[1:], lengths) - np.arange(len(cps))  # code points up to the end of each one's text
        for n in END_ORDERS:
            b, own = cls._bucket(cps, n), left[: max(len(cps) - n + 1, 0)]
            occurs += np.bincount(b[own >= n], minlength=len(occurs))
            ends += np.bincount(b[own == n], minlength=len(ends))

    @staticmethod
    def _bucket_of(cps: list[int]) -> int:
        """The bucket of one n-gram, as ``_bucket`` has it."""
        h, mask = len(cps), (1 << 64) - 1
        for c in cps:
            h = (h * 0x100000001B3 + c) & mask
        h ^= h >> 31
        h = (h * 0x9E3779B97F4A7C15) & mask
        return (h ^ (h >> 29)) >> (64 - END_BITS)

    def likelihood(self, text: str, weight: float = 50.0) -> tuple[float, float]:
        """Of ending here, by the last character, and by its last n-grams (each order smoothed by the one before)."""
        last = [32 if c == 10 else 48 if 48 <= c < 58 else c for c in map(ord, text.rstrip()[-max(END_ORDERS) :])]
        first = p = 0.0
        for n in END_ORDERS[: len(last)]:
            b = self._bucket_of(last[-n:])
            p = float((self.ends[b] + weight * p) / (self.occurs[b] + (weight if n > 1 else 1)))
            first = p if n == 1 else first
        return first, p


def fit_ends(texts: DataFrame, text: str = "text", chunk: int = 1 << 14) -> EndModel:
    """Counts over all texts of the column (blank and null ones, and those of 40 characters or fewer, which may be single
    words or phrases, don't count)."""
    size = 1 << END_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros((2, size), np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                EndModel.count([t for t in consistent_forms(strings(part, "_text")) if t and len(t) > 40], table[0], table[1])
        return table.reshape(-1)

    occurs, ends = table_sums(spread(texts.select(F.col(text).alias("_text"))), count, 2 * size, chunk).reshape(2, size).astype(np.float32)
    return EndModel(occurs, ends)


_SENTENCE = re.compile(r"[^\s.!?។៕。！？”»\"')][”»\"')]*(?:[!?។៕。！？]|\.(?=\s))[”»\"')]*\s*\S")
_MARKED = re.compile(r"[.!?។៕。！？][”»\"')]*\s*\Z")
_MAYBE = re.compile(rf"(?:^|[^\w])(?:{'|'.join(re.escape(w) for w in MAYBE_LAST.split())})\.$|[\u1780-\u17d3\u0e00-\u0eff]\.$", re.IGNORECASE)
_ITEM = re.compile(r"^\s*(?:[-*•–]|[\d០-៩๐-๙໐-໙]+[.)។])(?:\s+|$)", re.MULTILINE)


#: Characters of an answer of one sentence from which it isn't a name, a number or a phrase.
PHRASE = 60


def is_truncated(answer: str, ends: EndModel, unlikely: float = 0.02) -> bool:
    """A list whose last item is empty or lacks the mark that all others have, or prose (more than one sentence, or one
    that is longer than a phrase) at whose last letters no text ends."""
    text = answer.strip()
    items = list(_ITEM.finditer(text))
    if len(items) > 1 and items[0].start() == 0:
        marked = [bool(_MARKED.search(text[m.end() : n.start()])) for m, n in zip(items, items[1:], strict=False)]
        if not re.search(r"[^\W_]", text[items[-1].end() :]) or text[-1] in ",…-:;(«“":
            return True
        return len(items) > 2 and all(marked) and not _MARKED.search(text)
    last = text[-1:]
    broken = last in ",…-:;(«“–" or text.endswith("...")
    if not broken and not _SENTENCE.search(text) and len(text) < PHRASE:
        return False
    if broken or (last == "." and not _ends_at_point(text, len(text) - 1, len(text), True) and not _MAYBE.search(text)):
        return True
    by_mark, by_letters = ends.likelihood(text)
    return by_mark < unlikely and by_letters < unlikely


def defects(instructions: list[str | None], inputs: list[str | None], outputs: list[str | None], model: LanguageModel, ends: EndModel) -> list[str | None]:
    """The first defect of each pair in the order of DEFECTS, or None."""
    asked, extra, said = (consistent_forms([t or "" for t in col]) for col in (instructions, inputs, outputs))
    a, x, o = folded(asked), folded(extra), folded(said)
    names_out = [_CAPITAL.sub(" ", t) for t in said]
    prompt, prompt_letters = _posteriors(asked, model)
    answer, answer_letters = _posteriors(names_out, model)
    out: list[str | None] = []
    for i, text in enumerate(said):
        if is_empty(text, o[i]):
            out.append("empty")
        elif _refusal().search(text):
            out.append("refusal")
        elif is_copy(asked[i], extra[i], text, (a[i], x[i], o[i])):
            out.append("copy")
        elif _foreign(prompt[i], answer[i], prompt_letters[i], answer_letters[i]) and not _asks().search(asked[i]):
            out.append("other_language")
        else:
            out.append("truncated" if is_truncated(text, ends) else None)
    return out


def _foreign(prompt: np.ndarray, answer: np.ndarray, prompt_letters: int, answer_letters: int, odds: float = 8.0) -> bool:
    """Whether the answer's letters speak against the prompt's language, by more than ``odds`` nats. Prompts of fewer than 6
    and answers of fewer than 10 letters (names left out) tell no language: names and numbers answer in any."""
    if prompt_letters < 6 or answer_letters < 10:
        return False
    own = int(prompt.argmax())
    return bool(answer.argmax() != own and answer.max() - answer[own] > odds)


def with_defects(df: DataFrame, model: LanguageModel, ends: EndModel, key: str = "example_id", order: str = "loaded_at") -> DataFrame:
    """(``key``, ``defect``) of each defective example, one row at most; a record delivered again counts once, as
    delivered last. A null instruction or input is an empty one."""
    shared = df.sparkSession.sparkContext.broadcast((model, ends))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = defects(*(strings(batch, c) for c in ("_a", "_x", "_text")), *shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], [key, order, "defect"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, order))
    rows = map_text(df.select(key, order, F.col("instruction").alias("_a"), F.col("input").alias("_x"), F.col("output").alias("_text")), "_text", run, f"{own}, defect string")
    return latest(rows, [key], ["defect"], order).where("defect is not null")
