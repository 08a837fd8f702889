"""Tokenizers trained on a corpus: characters, clusters, syllables, pair merges and a unigram model.

Counting over the corpus is done in Spark (tokens, distinct sequences, n-grams, expected counts); what the driver keeps
is bounded by the vocabulary. Trained tokenizers are applied as columns, with their tables broadcast.
"""

from __future__ import annotations

import math
import warnings
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from borei import chars as C
from borei.functions import unicode as U
from borei.operators.lattice import Pieces
from borei.session import ship

PAD, UNK, BOS, EOS = "<pad>", "<unk>", "<bos>", "<eos>"
SPECIALS = (PAD, UNK, BOS, EOS)


class Vocabulary:
    """Tokens and their ids; the specials are 0 to 3. Kept on the driver: its size is a parameter."""

    def __init__(self, tokens: list[str] | None = None):
        self.tokens: list[str] = []
        self.ids: dict[str, int] = {}
        for token in (*SPECIALS, *(tokens or ())):
            self.add(token)

    def add(self, token: str) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]

    def encode_token(self, token: str) -> int:
        return self.ids.get(token, 1)

    def decode_id(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else UNK

    def __len__(self) -> int:
        return len(self.tokens)

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def to_dict(self) -> dict:
        return {"tokens": list(self.tokens)}

    @classmethod
    def from_dict(cls, data: dict) -> Vocabulary:
        out = cls()
        for token in data["tokens"]:
            out.add(token)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.tokens)], "token string, id int")


def clusters_of(text: str) -> list[str]:
    """Clusters of one text, outside Spark."""
    return U._compiled(C.KCC).findall(text)


class Tokenizer:
    """Base: ``pieces`` gives the tokens of a text column, ``pieces_of`` those of one text."""

    name = "base"

    def __init__(self):
        self.vocab = Vocabulary()

    def pieces(self, c: Column) -> Column:
        raise NotImplementedError

    def pieces_of(self, text: str) -> list[str]:
        raise NotImplementedError

    def train(self, corpus: DataFrame, text: str = "text", vocab_size: int | None = None, ord: str | None = None) -> Tokenizer:
        """The most frequent tokens, ``vocab_size`` less the specials; ties go to the one seen first (the order is
        that of ``ord``, or of the text where there is none)."""
        ship(corpus.sparkSession)
        order = F.col(ord) if ord else F.col(text)
        seen = corpus.where(F.col(text).isNotNull()).select(order.alias("o"), F.posexplode(self.pieces(F.col(text))).alias("p", "token"))
        top = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first")).orderBy(F.desc("n"), "first")
        if vocab_size is not None:
            top = top.limit(max(vocab_size - len(SPECIALS), 0))
        self.vocab = Vocabulary([r.token for r in top.select("token").collect()])
        return self

    def ids(self, c: Column, spark: SparkSession | None = None) -> Column:
        """Token ids of a text column; unknown tokens get the id of UNK."""
        shared = self.vocab.ids

        @pandas_udf(T.ArrayType(T.IntegerType()))
        def look_up(rows: pd.Series) -> pd.Series:
            return rows.map(lambda r: None if r is None else [shared.get(t, 1) for t in r])

        return look_up(self.pieces(c))

    def text_of(self, c: Column) -> Column:
        """Texts of a column of ids, without specials; an id out of range reads as UNK, which is one."""
        names = {i: t for i, t in enumerate(self.vocab.tokens) if i >= len(SPECIALS)}

        @pandas_udf(T.StringType())
        def back(rows: pd.Series) -> pd.Series:
            return rows.map(lambda r: None if r is None else "".join(names.get(int(i), "") for i in r))

        return back(c)

    def unknown_rate(self, c: Column) -> Column:
        """Share of unknown tokens; 0 for texts without tokens."""
        ids = self.ids(c)
        return U.let(ids, lambda x: F.coalesce(F.try_divide(F.size(F.filter(x, lambda i: i == 1)), F.size(x)), F.lit(0.0)))

    def encode(self, text: str) -> list[int]:
        return [self.vocab.encode_token(t) for t in self.pieces_of(text)]

    def decode(self, ids: list[int]) -> str:
        return "".join(t for t in map(self.vocab.decode_id, ids) if t not in SPECIALS)


class CharacterTokenizer(Tokenizer):
    name = "character"

    def pieces(self, c: Column) -> Column:
        return U.characters(c)

    def pieces_of(self, text: str) -> list[str]:
        return list(text)


class GraphemeTokenizer(Tokenizer):
    name = "grapheme"

    def pieces(self, c: Column) -> Column:
        return U.graphemes(c)

    def pieces_of(self, text: str) -> list[str]:
        return clusters_of(text)


class SyllableTokenizer(GraphemeTokenizer):
    name = "syllable"


class _Learned(Tokenizer):
    """Tokenizers whose pieces come from ``pieces_of_all`` on Arrow batches."""

    def pieces_of_all(self, texts: list[str]) -> list[list[str]]:
        return [self.pieces_of(t) for t in texts]

    def pieces(self, c: Column) -> Column:
        me = self

        @pandas_udf(T.ArrayType(T.StringType()))
        def run(texts: pd.Series) -> pd.Series:
            found = iter(me.pieces_of_all([t for t in texts if t is not None]))
            return pd.Series([None if t is None else next(found) for t in texts], dtype=object)

        return run(c)


def sequences(corpus: DataFrame, text: str) -> DataFrame:
    """Distinct texts (t) with how often they occur (n)."""
    return corpus.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.count(F.lit(1)).alias("n"))


#: Of pair merges, what the driver holds at a time: pairs, and symbols of all runs of them.
PAIRS, SYMBOLS = 50_000, 500_000


class BPETokenizer(_Learned):
    """Pair merges over clusters. The most frequent pair is merged first, of equal ones the greatest.

    Texts stay on the executors. A merge across two symbols occurs at most as often as these stand side by side, so while
    the best pair is above a limit, only runs of symbols whose pairs are above it matter. The driver learns from those."""

    name = "bpe"

    def __init__(self):
        super().__init__()
        self.merges: list[tuple[str, str]] = []
        self.alphabet_exceeds_vocab = False

    def train(self, corpus: DataFrame, text: str = "text", vocab_size: int = 1000, min_frequency: int = 2, ord: str | None = None) -> BPETokenizer:
        """Learns merges until the vocabulary is full or no pair occurs ``min_frequency`` times."""
        ship(corpus.sparkSession)
        texts = sequences(corpus, text).persist()
        try:
            self.vocab = Vocabulary(sorted(r.c for r in texts.select(F.explode(U.graphemes("t")).alias("c")).distinct().collect()))
            self.alphabet_exceeds_vocab = len(self.vocab) >= vocab_size
            if self.alphabet_exceeds_vocab:
                warnings.warn(f"{len(self.vocab)} clusters and specials leave no room for merges in a vocabulary of {vocab_size}", stacklevel=2)
            self.merges = []
            while len(self.vocab) < vocab_size and self.learn(texts, vocab_size, min_frequency):
                pass
        finally:
            texts.unpersist()
        return self

    def learn(self, texts: DataFrame, vocab_size: int, min_frequency: int) -> bool:
        """The next merges, at least one; False where no pair occurs ``min_frequency`` times."""
        now = texts.select(U.graphemes("t").alias("s"), "n").where("size(s) > 1")
        if self.merges:
            now = now.select(self.merged_so_far(F.col("s")).alias("s"), "n").where("size(s) > 1")
        pairs = now.select(F.explode(U.let(F.col("s"), lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.get(s, i - 1).alias("a"), F.get(s, i).alias("b"))))).alias("p"), "n")
        most = min(PAIRS, 2 * (vocab_size - len(self.vocab)) + 64)
        top = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)
        rows = top.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(most + 1).collect()
        while rows:
            limit = rows[most].n + 1 if len(rows) > most else min_frequency
            # where more pairs than fit are equally frequent, the first is the best one, and the only one to be merged
            near = {(r.a, r.b) for r in rows[:most] if r.n >= limit} or {(rows[0].a, rows[0].b)}
            runs = self.runs(now, near).persist()
            try:
                if len(near) == 1 or (runs.agg(F.sum(F.size("run"))).first()[0] or 0) <= SYMBOLS:
                    self.merge([[list(r.run), r.n] for r in runs.collect()], vocab_size, limit)
                    return True
            finally:
                runs.unpersist()
            most = min(most, len(near)) // 4
        return False

    def merged_so_far(self, c: Column) -> Column:
        """Symbols of a column of clusters after the merges learned so far, each done once and in order."""
        places: dict = defaultdict(list)
        for i, pair in enumerate(self.merges):
            places[pair].append(i)

        @pandas_udf(T.ArrayType(T.StringType()))
        def run(rows: pd.Series) -> pd.Series:
            return rows.map(lambda s: replayed(list(s), places))

        return run(c)

    def runs(self, now: DataFrame, near: set[tuple[str, str]]) -> DataFrame:
        """Runs (run) of ids of symbols with no pair that isn't in ``near``, and how often they occur (n)."""
        shared = now.sparkSession.sparkContext.broadcast((self.vocab.ids, near))

        def run(batches):
            ids, near = shared.value
            for pdf in batches:
                counts: Counter = Counter()
                for s, n in zip(pdf["s"], pdf["n"], strict=True):
                    for part in parted(list(s), near):
                        counts[tuple(ids[x] for x in part)] += n
                if counts:
                    yield pd.DataFrame({"run": [list(p) for p in counts], "n": list(counts.values())})

        return now.mapInPandas(run, "run array<int>, n bigint").groupBy("run").agg(F.sum("n").alias("n"))

    def merge(self, seqs: list, vocab_size: int, limit: int) -> None:
        """Merges the best pair of ``seqs`` (ids, n), then further ones that occur ``limit`` times. Pair counts are kept
        up to date for the sequences a merge touches only."""
        tokens, known = self.vocab.tokens, len(self.vocab)
        ends: dict = {}  # of the symbols made here, the first and the last one that they are made from
        counts: Counter = Counter()
        where: dict = defaultdict(set)
        for i, (s, n) in enumerate(seqs):
            for pair in zip(s, s[1:], strict=False):
                counts[pair] += n
                where[pair].add(i)
        first = True
        while len(self.vocab) < vocab_size and counts:
            pair, n = max(counts.items(), key=lambda kv: (kv[1], tokens[kv[0][0]], tokens[kv[0][1]]))
            if n < limit and not first:
                break
            first = False
            a, b = pair
            self.merges.append((tokens[a], tokens[b]))
            made = self.vocab.add(tokens[a] + tokens[b])
            for i in list(where.pop(pair, ())):
                s, n = seqs[i]
                for old in zip(s, s[1:], strict=False):
                    counts[old] -= n
                    if counts[old] <= 0:
                        del counts[old]
                    where[old].discard(i)
                s = seqs[i][0] = merged(s, pair, made)
                for new in zip(s, s[1:], strict=False):
                    counts[new] += n
                    where[new].add(i)
            counts.pop(pair, None)
            between = (ends.get(a, (a, a))[0], ends.get(b, (b, b))[1])
            if made < known or ends.setdefault(made, between) != between:
                break  # a symbol that is made in two ways may have neighbours outside the runs, where it is made in the other

    def pieces_of(self, text: str) -> list[str]:
        symbols = clusters_of(text)
        if len(symbols) < 2 or not self.merges:
            return symbols
        rank = getattr(self, "_rank", None)
        if rank is None or len(rank) != len(self.merges):
            rank = self._rank = {p: i for i, p in enumerate(self.merges)}
        while len(symbols) > 1:
            best = min((p for p in zip(symbols, symbols[1:], strict=False)), key=lambda p: rank.get(p, math.inf))
            if best not in rank:
                break
            symbols = merged(symbols, best)
        return symbols


def merged(symbols: list, pair: tuple, made=None) -> list:
    """From left to right, without overlap."""
    made = pair[0] + pair[1] if made is None else made
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(made)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def replayed(symbols: list[str], places: dict[tuple[str, str], list[int]]) -> list[str]:
    """Symbols after all merges; ``places`` are those of each pair in the order of merges."""
    at = -1
    while len(symbols) > 1:
        ahead = [(own[k], p) for p in zip(symbols, symbols[1:], strict=False) if (own := places.get(p)) and (k := bisect_right(own, at)) < len(own)]
        if not ahead:
            break
        at, pair = min(ahead)
        symbols = merged(symbols, pair)
    return symbols


def parted(symbols: list, near: set[tuple]) -> Iterator[list]:
    """Runs of two symbols and more in which every pair is one of ``near``."""
    start = 0
    for end in range(1, len(symbols) + 1):
        if end == len(symbols) or (symbols[end - 1], symbols[end]) not in near:
            if end - start > 1:
                yield symbols[start:end]
            start = end


#: Log-probability of a single cluster that wasn't seen in training.
UNSEEN = -30.0


def logsumexp(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class UnigramTokenizer(_Learned):
    """A unigram model over pieces of up to ``max_piece`` clusters, trained by EM with pruning. Counting is done on the
    executors, over lattices of whole batches; the driver holds one probability per piece."""

    name = "unigram"

    def __init__(self, max_piece: int = 4):
        super().__init__()
        self.max_piece = max_piece
        self.logprobs: dict[str, float] = {}

    def lattice(self) -> Pieces:
        made = getattr(self, "_made", None)
        if made is None or made[0] is not self.logprobs:
            made = self._made = (self.logprobs, Pieces(self.logprobs, self.max_piece, UNSEEN))
        return made[1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def score_of(self, piece: str) -> float:
        """Log-probability of a piece; only a single cluster may be unseen."""
        return self.logprobs.get(piece, UNSEEN if len(clusters_of(piece)) == 1 else -math.inf)

    def expected(self, units: list[str]) -> tuple[dict[str, float], float]:
        """Expected count of each piece in one text, and its log-likelihood."""
        return self.lattice().expected([units], np.ones(1))

    def seeded(self, texts: DataFrame, text: str, size: int) -> dict[str, float]:
        """The ``size`` most frequent runs of clusters (ties: the smaller string) and all single clusters."""
        runs = F.flatten(F.array(*[U.ngrams(F.col("g"), n) for n in range(1, self.max_piece + 1)]))
        pieces = texts.select(U.graphemes(text).alias("g")).select(F.explode(F.arrays_zip(runs.alias("p"))).alias("x")).select(F.col("x.p").alias("piece"))
        counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).persist()
        rows = counts.orderBy(F.desc("n"), "piece").limit(size).unionByName(counts.where(F.size(U.graphemes("piece")) == 1)).distinct().collect()
        counts.unpersist()
        whole = sum(r.n for r in rows)
        return {r.piece: math.log(r.n / whole) for r in rows}

    def counted(self, seqs: DataFrame) -> tuple[dict[str, float], float]:
        """Expected counts over all ``seqs`` (g, n) with the present probabilities, summed per piece, and the likelihood."""
        shared = seqs.sparkSession.sparkContext.broadcast(self.lattice())

        def run(batches):
            for pdf in batches:
                counts, likelihood = shared.value.expected([list(g) for g in pdf["g"]], pdf["n"].to_numpy(np.float64))
                yield pd.DataFrame([*counts.items(), (None, likelihood)], columns=["piece", "x"])

        sums = {r.piece: r.x for r in seqs.mapInPandas(run, "piece string, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()}
        likelihood = sums.pop(None, 0.0)
        return sums, likelihood

    def improved(self, seqs: DataFrame, steps: int) -> float | None:
        """``steps`` of EM; the likelihood before the last one. A piece stays while its probability can be told from 0."""
        likelihood = None
        for _ in range(steps):
            counts, likelihood = self.counted(seqs)
            whole = sum(counts.values())
            shares = {p: x / whole for p, x in sorted(counts.items())} if whole else {}
            self.logprobs = {p: math.log(x) for p, x in shares.items() if x > 0.0} or self.logprobs
        return likelihood

    def train(self, corpus: DataFrame, text: str = "text", vocab_size: int = 300, seed_multiplier: int = 10, em_iterations: int = 2, prune_fraction: float = 0.2, max_rounds: int = 20, ord: str | None = None) -> UnigramTokenizer:
        """EM and pruning in turn until ``vocab_size`` pieces are left. The pieces of more than one cluster that explain
        least (expected count times cost) go first; single clusters come back in the last step if they were needed."""
        ship(corpus.sparkSession)
        texts = corpus.where(F.col(text).isNotNull())
        seqs = texts.groupBy(F.col(text).alias("t")).agg(F.count(F.lit(1)).alias("n")).select(U.graphemes("t").alias("g"), "n").where("size(g) > 0").persist()
        self.logprobs = self.seeded(texts, text, vocab_size * seed_multiplier)
        surplus, rounds = math.inf, 0
        while surplus > 0 and rounds < max_rounds:
            self.improved(seqs, em_iterations)
            surplus, rounds = len(self.logprobs) - vocab_size, rounds + 1
            if surplus > 0:
                used, _ = self.counted(seqs)
                long = sorted((used.get(p, 0.0) * -cost, p) for p, cost in self.logprobs.items() if len(clusters_of(p)) > 1)
                gone = {p for _, p in long[: min(surplus, max(1, int(prune_fraction * len(long))))]}
                self.logprobs = {p: cost for p, cost in self.logprobs.items() if p not in gone}
                surplus = surplus if gone else 0
        self.improved(seqs, 1)
        seqs.unpersist()
        self.vocab = Vocabulary(sorted(self.logprobs))
        return self

    def pieces_of(self, text: str) -> list[str]:
        return self.pieces_of_all([text])[0]

    def pieces_of_all(self, texts: list[str]) -> list[list[str]]:
        units = [clusters_of(t) for t in texts]
        return self.lattice().best(units) if self.logprobs else units

    def log_probability(self, text: str) -> float:
        return sum(self.score_of(p) for p in self.pieces_of(text))


# The eight sentences that tokenizers are compared on.
SAMPLE = [
    "កម្ពុជាស្ថិតនៅអាស៊ីអាគ្នេយ៍។", "រាជធានីរបស់ប្រទេសកម្ពុជាគឺទីក្រុងភ្នំពេញ។", "ខ្ញុំចង់ទៅភ្នំពេញនៅថ្ងៃស្អែក។", "តើអ្នកសុខសប្បាយជាទេ?",
    "អង្គរវត្តជាកេរ្តិ៍ដំណែលពិភពលោក។", "ភាសាខ្មែរមានអក្សរច្រើនណាស់។", "ខ្ញុំចូលចិត្តញ៉ាំបាយនិងសម្លរម្ជូរ។", "ប្រទេសថៃ វៀតណាម និងឡាវ នៅជិតកម្ពុជា។",
]


def compare(tokenizers: dict[str, Tokenizer], train: DataFrame, evaluation: DataFrame | None = None, vocab_size: int | None = None, text: str = "text") -> DataFrame:
    """Per tokenizer: vocabulary, mean length, characters per token over all texts, mean of the texts' unknown rates."""
    data, out = evaluation if evaluation is not None else train, None
    for name, tokenizer in tokenizers.items():
        tokenizer.train(train, text, **({"vocab_size": vocab_size} if vocab_size is not None else {}))
        per = data.where(F.col(text).isNotNull()).select(F.char_length(text).alias("chars"), F.size(tokenizer.pieces(F.col(text))).alias("tokens"), tokenizer.unknown_rate(F.col(text)).alias("unknown"))
        row = per.agg(
            F.lit(name).alias("name"),
            F.lit(len(tokenizer.vocab)).alias("vocab_size"),
            F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("avg_sequence_length"),
            F.coalesce(F.try_divide(F.sum("chars"), F.sum("tokens")), F.lit(0.0)).alias("compression_ratio"),
            F.coalesce(F.avg("unknown"), F.lit(0.0)).alias("unknown_rate"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def format_comparison(stats: DataFrame) -> str:
    lines = [f"{'tokenizer':<12} {'vocab':>7} {'avg_len':>9} {'chars/tok':>10} {'unk_rate':>9}"]
    lines += [f"{r.name:<12} {r.vocab_size:>7} {r.avg_sequence_length:>9.2f} {r.compression_ratio:>10.2f} {r.unknown_rate:>9.2%}" for r in stats.collect()]
    return "\n".join(lines)


KINDS = {t.name: t for t in (CharacterTokenizer, GraphemeTokenizer, SyllableTokenizer, BPETokenizer, UnigramTokenizer)}


def state_of(tokenizer: Tokenizer) -> dict:
    """What a tokenizer needs to be restored, as plain JSON values."""
    out = {"name": tokenizer.name, "vocab": tokenizer.vocab.to_dict()}
    if isinstance(tokenizer, BPETokenizer):
        out["merges"] = [list(m) for m in tokenizer.merges]
    if isinstance(tokenizer, UnigramTokenizer):
        out |= {"logprobs": tokenizer.logprobs, "max_piece": tokenizer.max_piece}
    return out


def restore(state: dict) -> Tokenizer:
    tokenizer = KINDS[state["name"]]()
    tokenizer.vocab = Vocabulary.from_dict(state["vocab"])
    if isinstance(tokenizer, BPETokenizer):
        tokenizer.merges = [tuple(m) for m in state["merges"]]
    if isinstance(tokenizer, UnigramTokenizer):
        tokenizer.logprobs, tokenizer.max_piece = dict(state["logprobs"]), state["max_piece"]
    return tokenizer
