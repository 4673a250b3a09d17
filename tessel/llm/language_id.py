"""Language identification: scripts narrow the candidates, then Viterbi over words labels spans.

Each word (a run of letters, lower case) is scored under every learned language by its character n-grams; languages that
weren't seen with the word's script are out.  A Viterbi pass over a text's words, in which a change of language costs
``SWITCH`` nats, gives the spans; the language of most letters is the text's, and the score is its share of the letters
times the probability of its lead over the second.  Where no stretch of words gains more than half of the cost under
another language, the one-language path is the best one and the pass needn't be run.

:func:`learn` counts n-grams over at most about ``SAMPLE`` labelled rows, as many of each language as there are (chosen
by a hash of the identifier), and keeps for each language its most frequent ones, ``FEATURES`` in all.  A word that one
text repeats counts by the logarithm of how often.

Nulls: a null text and one without a letter are ``und`` with score 0; rows without a language aren't learned from, and
without any learned language every text is ``und``.  Very long texts are judged whole.  Repeated rows are judged each,
ties go to the language first in the alphabet, an empty table gives an empty result.  :func:`identify` keeps no other
columns, whatever their names; :func:`accepted` keeps all of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import forget, released, steady, stored

SAMPLE = 12_000
FEATURES = 60_000
ORDERS = 4
SWITCH = 24.0
#: The most nats by which a single word speaks against a language.
MOST = 6.0
REMEMBERED = 250_000
LEAST = 0.25
WORD_CHARS = 48

_WORD = re.compile(r"[^\W\d_]+")

#: First code points of Unicode ranges and the script that begins there.
RANGES = ((0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Other"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Other"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFDD, "Other"), (0x20000, "Han"), (0x32000, "Other"))
_FIRST = [first for first, _ in RANGES]


def script(word: str) -> str:
    """The script of the first letter."""
    if word.isascii():
        return "Latin"
    from bisect import bisect_right

    return RANGES[max(0, bisect_right(_FIRST, ord(word[0])) - 1)][1]


def words_of(text: str) -> list[str]:
    """Words in order; ones of more than WORD_CHARS letters come in parts, so that nothing is left out."""
    low = text.lower()
    found = _WORD.findall(low if low.isascii() else unicodedata.normalize("NFC", low))
    if max(map(len, found), default=0) > WORD_CHARS:
        found = [w[k : k + WORD_CHARS] for w in found for k in range(0, len(w), WORD_CHARS)]
    return found


def grams(word: str) -> list[str]:
    marked = f"^{word}$"
    n = len(marked)
    return [marked[k : k + size] for size in range(1, ORDERS + 1) for k in range(n - size + 1)]


class Codes:
    """Features as numbers of 16 bits a character, in a table by hash."""

    SLOTS = 20
    GOLDEN = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, features: dict[str, int]):
        signs = sorted({c for g in features for c in g})
        if len(signs) > 65_000:
            raise ValueError("too many different characters")
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        places = {c: k + 1 for k, c in enumerate(signs)}
        codes = np.array([sum(places[c] << 16 * k for k, c in enumerate(g)) for g in features], np.uint64)
        values = np.array(list(features.values()), np.int64)
        slot = self.slot(codes)
        self.table, self.key = np.full(1 << self.SLOTS, -1, np.int32), np.zeros(1 << self.SLOTS, np.uint64)
        self.table[slot], self.key[slot] = values, codes
        rest = self.key[slot] != codes  # of several in a slot all but the last
        order = np.argsort(codes[rest])
        self.more, self.more_values = codes[rest][order], values[rest][order]

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * self.GOLDEN >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the marked words and whose they are; places at which features begin, and which."""
        points = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
        number = self.number[points].astype(np.uint64)
        at, feature = [], []
        code = np.zeros(len(points), np.uint64)
        for size in range(1, ORDERS + 1):
            n = len(points) - size + 1
            if n <= 0:
                break
            code = code[:n] | number[size - 1 :] << np.uint64(16 * (size - 1))
            # A character that no feature has ends all longer ones as well: 0 from then on.
            alive = (owner[:n] == owner[size - 1 :]) & (number[size - 1 :] > 0)
            code = np.where(alive & ((code & np.uint64(0xFFFF)) > 0), code, np.uint64(0))
            slot = self.slot(code)
            value = np.where(self.key[slot] == code, self.table[slot], -1)
            if len(self.more):
                other = np.flatnonzero((value < 0) & (self.table[slot] >= 0) & (code > 0))
                place = np.minimum(np.searchsorted(self.more, code[other]), len(self.more) - 1)
                value[other] = np.where(self.more[place] == code[other], self.more_values[place], -1)
            value[code == 0] = -1
            here = np.flatnonzero(value >= 0)
            at.append(here)
            feature.append(value[here])
        return points, owner, np.concatenate(at), np.concatenate(feature)


@dataclass
class Model:
    languages: list[str]
    features: dict[str, int]
    weights: np.ndarray  # of each feature and language, log-probabilities; the last row is for none
    scripts: dict[str, np.ndarray]  # which languages were seen with a script
    index: dict[str, int] = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)
    codes: Codes | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "known": None, "codes": None}

    def score(self, words: list[str]) -> np.ndarray:
        """Nats of each word and language, 0 for the best."""
        if not words:
            return np.zeros((0, len(self.languages)))
        if self.codes is None:
            self.codes = Codes(self.features)
        points, owner, at, feature = self.codes.find(words)
        sums = np.stack([np.bincount(owner[at], self.weights[feature, k], len(words)) for k in range(len(self.languages))], axis=1) / (ORDERS / 2)
        names, allowed = self.narrowing()
        if not allowed.all():
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) + 1  # behind the mark of the begin
            sums = np.where(allowed[names[np.searchsorted(_FIRST, points[first], "right") - 1]], sums, sums - 1e3)
        return np.maximum(sums - sums.max(axis=1, keepdims=True), -MOST)

    def narrowing(self) -> tuple[np.ndarray, np.ndarray]:
        """The script's number of each range, and which languages were seen with each script (all where none was)."""
        order = sorted({name for _, name in RANGES})
        every = np.ones(len(self.languages), bool)
        return np.array([order.index(name) for _, name in RANGES]), np.stack([self.scripts.get(name, every) for name in order])

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of the words of each text; those of frequent words are remembered."""
        if self.known is None or len(self.index) > REMEMBERED:
            self.index, self.known = {}, np.zeros((0, len(self.languages)), np.float32)
        index = self.index
        new = list({w for words in texts for w in words if w not in index})
        if new:
            parts = [self.score(new[k : k + 2000]).astype(np.float32) for k in range(0, len(new), 2000)]
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.known = np.concatenate([self.known, *parts])
        return [self.known[np.fromiter(map(index.__getitem__, words), np.int64, len(words))] for words in texts]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path's language of each word."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]])), gain)
    if (gain - low).max() <= switch / 2:
        return np.full(n, best)
    back = np.empty((n, k), np.int32)
    value = scores[0].tolist()
    rows = scores.tolist()
    span = range(k)
    for t in range(1, n):
        top = max(span, key=value.__getitem__)
        floor = value[top] - switch
        row = rows[t]
        here = [j if value[j] >= floor else top for j in span]
        back[t] = here
        value = [(value[j] if value[j] >= floor else floor) + row[j] for j in span]
    path = np.empty(n, np.int64)
    path[-1] = max(span, key=value.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def spans(words: list[str], path: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of one language: language, first word and number of words."""
    cuts = np.flatnonzero(np.diff(path)) + 1
    begins = [0, *cuts.tolist()]
    return [{"lang": languages[int(path[b])], "first": b, "words": e - b} for b, e in zip(begins, [*begins[1:], len(words)], strict=True)] if len(words) else []


def decide(words: list[str], scores: np.ndarray, languages: list[str]) -> tuple[str, float, np.ndarray]:
    path = viterbi(scores)
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.bincount(path, weights=size, minlength=len(languages))
    best = int(letters.argmax())
    total = scores.sum(axis=0, dtype=np.float64)
    rest = np.delete(total, best)
    lead = 1 / (1 + np.exp(-np.clip(total[best] - rest.max(), 0, 30))) if len(rest) else 1.0
    return languages[best], float(letters[best] / size.sum() * lead), path


def learn(docs: DataFrame, *, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, features: int = FEATURES) -> Model | None:
    """A model from at most about ``sample`` rows with a language; ``train`` is a condition on the input's rows."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & (F.col(lang_col) != "und"))
    if train is not None:
        rows = rows.where(train)
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    # As many rows of each language; what some lack, the others may have.
    left, share = sample, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        share[lang] = min(n, max(1, left // (len(sizes) - k)))
        left -= share[lang]
    parts = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 20) * share[lang] / n))])
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < parts[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A word that a text repeats endlessly isn't a language.
                by.setdefault(lang, Counter()).update({w: k.bit_length() for w, k in Counter(words_of(text)).items()})
            langs, found, counts = [], [], []
            for lang, words in by.items():
                own: Counter = Counter()
                for word, k in words.items():
                    own[f"\0{script(word)}"] += k
                    for g in grams(word):
                        own[g] += k
                langs += [lang] * len(own)
                found += own
                counts += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
        released()

    counted = stored(rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "language-counts")
    mark = F.col("gram").startswith("\0")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.where(~mark).withColumn("k", F.row_number().over(first)).where(F.col("k") <= max(1, features // len(sizes)))
    chosen = best.select("gram").distinct().unionByName(counted.where(mark).select("gram").distinct())
    table = counted.join(chosen, "gram").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n")).collect()  # ``features`` rows at most, and a few scripts
    forget(docs.sparkSession, counted)
    marks = [r for r in table if r["gram"].startswith("\0")]
    kept = sorted((r for r in table if not r["gram"].startswith("\0")), key=lambda r: (-r["n"], r["gram"]))
    languages = sorted({lang for r in marks for lang in r["by"]})
    if not languages:
        return None
    counts = np.array([[r["by"].get(lang, 0) for lang in languages] for r in kept], float)
    sizes = np.array([len(r["gram"]) for r in kept])
    weights = np.zeros((len(kept) + 1, len(languages)))
    for size in range(1, ORDERS + 1):
        own = sizes == size
        if own.any():
            smooth = counts[own] + 0.5
            weights[:-1][own] = np.log(smooth / smooth.sum(axis=0))
    weights -= weights.max(axis=1, keepdims=True)
    weights[-1] = 0
    shares = {r["gram"][1:]: np.array([r["by"].get(lang, 0) for lang in languages], float) for r in marks}
    total = sum(shares.values())
    scripts = {name: seen / np.maximum(total, 1) > 1e-4 for name, seen in shares.items()}
    return Model(languages, {r["gram"]: k for k, r in enumerate(kept)}, weights, {k: v for k, v in scripts.items() if v.any()})


IDENTIFIED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])))])


def judged(texts: list[str | None], model: Model | None) -> list[tuple[str, float, list[dict]]]:
    split = [words_of(t or "") if model else [] for t in texts]
    out = []
    for words, scores in zip(split, model.lookup(split) if model else split, strict=True):
        if not words:
            out.append(("und", 0.0, []))
            continue
        lang, score, path = decide(words, scores, model.languages)
        out.append((lang, score, spans(words, path, model.languages)))
    return out


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 256) -> DataFrame:
    """doc_id, lang_pred, score and the spans (language, first word, number of words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        steady()
        kind = to_arrow_type(IDENTIFIED["spans"].dataType)
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                found = judged(batch.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind)], names=IDENTIFIED.names)
        released()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, IDENTIFIED)


def accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows that have a language with a score of at least ``least``, with all their columns."""

    @F.pandas_udf("boolean")
    def has_language(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steady()
        for part in parts:
            yield pd.Series([lang != "und" and score >= least for k in range(0, len(part), 256) for lang, score, _ in judged(list(part[k : k + 256]), model)], dtype="bool")
        released()

    return docs.where(has_language(F.col(text_col)))
