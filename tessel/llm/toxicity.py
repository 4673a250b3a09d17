"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and accented Latin letters to plain ones, digits and signs that stand for
letters within a word), the lexicon and the exception phrases are matched in one pass of an Aho-Corasick automaton at
word boundaries, and what lies inside an exception phrase doesn't count.  The weights found, set against the length of
the text, give the score by a logistic curve.  Words are runs of letters of any script between spaces or signs.

A base lexicon of insults starts with a small weight.  :func:`learn` fits weights, further words and the curve on a
bounded sample of labelled rows (at most about ``SAMPLE``, by a hash of the identifier): a word enters if toxic rows
hold it behind at least ``CONTEXTS`` different words (copies of one text have one context) far more often than chance
would put it there.

Nulls: a null text is empty, has no hits and the score of a text without hits; rows without a label, and with one other
than 0 and 1, aren't learned from; of several labels of an identifier the highest counts.  Very long texts are matched
whole.  Overlapping words count each; a word inside an exception phrase doesn't.  Repeated rows are scored each; an empty table gives an empty result, and without usable labels the base lexicon
and curve stand.  :func:`score` keeps no other columns; :func:`clean` keeps all of the input's.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import released, steady, stored

SAMPLE = 30_000
CONTEXTS = 5
#: By how many nats a word must be likelier in toxic rows than chance has it.
SURE = 12.0
LIMIT = 0.7
#: Powers of the length that are tried.
POWERS = (0.1, 0.25, 0.5)

#: Common insults of English, with which the lexicon begins.
BASE = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "jerk", "vermin", "filth", "creep", "lowlife", "degenerate", "bastard", "bitch", "whore", "slut", "asshole", "retard", "cretin", "parasite", "freak", "dimwit", "halfwit", "subhuman")
#: Phrases in which such words mean no offence.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "dumb terminal", "dumb waiter", "pond scum", "jerk chicken", "jerk seasoning", "sore loser board", "host and parasite", "parasite host", "control freak accident", "freak accident", "freak wave", "filth and grime")
#: Letters of other scripts that look like Latin ones, and signs and digits that stand for letters.
LOOKALIKES = dict(zip("аеорсухкмтвнізјѕԁɡօսıոαβεικνορτυχ", "aeopcyxkmtbhi3jsdgouinabeiknoptux", strict=True)) | {"з": "z"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}

_MARKED = re.compile(r"[^\W\d_]*[0-9@$!|€£]+(?=[^\W\d_])[^\W_]*(?:[@$!|€£]+[^\W_]+)*")
#: Signs that belong to the letter before them, as vowels of Indic scripts do.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1E000)) if unicodedata.category(c) in ("Mn", "Mc"))
#: Words that are candidates: runs of letters of any script.
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")
_MARKED_BY = frozenset(_MARKS)


def _letters() -> dict[int, str]:
    """Latin letters with marks to plain ones, from the Unicode decomposition; look-alikes as listed."""
    table = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = unicodedata.normalize("NFKD", chr(code).lower())
        kept = "".join(c for c in plain if not unicodedata.combining(c))
        if kept.isascii() and kept:
            table[code] = kept
    for sign, plain in LOOKALIKES.items():
        table[ord(sign)] = plain
        table[ord(sign.upper()) if len(sign.upper()) == 1 else ord(sign)] = plain
    return table | {0xDF: "ss", 0xAD: "", 0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: ""} | {code: "" for code in range(0x300, 0x370)}


_TABLE = _letters()
_SIGN_TABLE = {ord(k): v for k, v in SIGNS.items()}


def fold(text: str) -> str:
    """Lower case, look-alikes as plain letters, signs within words as the letters they stand for."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_TABLE)
    return _MARKED.sub(lambda m: m[0].translate(_SIGN_TABLE), low)


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded words, exception phrases, and the curve: logistic of bias + slope * log(1 + weight / size ** power),
    where size is the text's hundreds of words."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slope: float = 3.0
    power: float = 0.25

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(phrase), 0.0))
        found.make_automaton()
        return found

    def probability(self, total: float, size: float) -> float:
        feature = math.log1p(total / size**self.power) if total else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * feature))))


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of whole words outside of exception phrases."""
    words, spared, n = [], [], len(folded)
    for last, (size, weight) in automaton.iter(folded):
        begin, end = last + 1 - size, last + 1
        if (begin and (folded[begin - 1].isalpha() or folded[begin - 1] in _MARKED_BY)) or (end < n and (folded[end].isalpha() or folded[end] in _MARKED_BY)):
            continue
        (words if weight else spared).append((begin, end, weight))
    return [w for w in words if not any(b <= w[0] and w[1] <= e for b, e, _ in spared)] if spared else words


def measure(folded: str, automaton) -> tuple[float, float, int]:
    """Total weight, hundreds of words (1 at least), and the number of hits."""
    found = hits(folded, automaton)
    return sum(w for _, _, w in found), max(1.0, (folded.count(" ") + 1) / 100), len(found)


def base() -> Lexicon:
    return Lexicon({w: 3.0 for w in BASE})


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Likelihood, bias and slope of a logistic fit with a little ridge, by Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([np.sum(y - p) - 1e-3 * a, np.sum((y - p) * x) - 1e-2 * b])
        h = np.array([[np.sum(w) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w * x * x) + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-7:
            break
    p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
    return float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))), float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train=None, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from at most about ``sample`` labelled rows; ``train`` is a condition on the identifier column."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = known.count()
    if not rows:
        return base()
    if rows > sample:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample / rows))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id").select("y", "text")
    chosen = stored(chosen, "toxicity-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if y:
                    row = _WORD.findall(fold(text))
                    out.update(zip(row, ["", *row], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["word", "before"])

    toxic = chosen.mapInArrow(words, "word string, before string").distinct().groupBy("word").count().where((F.col("count") >= CONTEXTS) & ((F.length("word") >= 3) | F.col("word").rlike("[^a-z]")))
    contexts = {r["word"]: r["count"] for r in toxic.toLocalIterator()}
    candidates = set(contexts) | set(BASE)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {}
        seen = [0, 0]
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[y] += 1
                for word in candidates & set(_WORD.findall(fold(text))):
                    count.setdefault(word, [0, 0])[y] += 1
        count[""] = seen
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], names=["word", "clean", "toxic"])

    table = {r["word"]: (r["clean"], r["toxic"]) for r in chosen.mapInArrow(presence, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toLocalIterator()}
    clean, bad = table.pop("", (0, 0))
    if not clean or not bad:
        return base()
    weights = {w: 3.0 for w in BASE}
    for word, (c, t) in table.items():
        odds = math.log(((t + 0.5) / (bad + 1)) / ((c + 0.5) / (clean + 1)))
        share, usual = t / (t + c), bad / (bad + clean)
        doubt = (t * math.log(share / usual) + c * math.log(max(1 - share, 1e-9) / (1 - usual))) if share > usual else 0.0
        if contexts.get(word, 0) >= min(0.6 * t, 40) and doubt >= SURE and odds > 2:
            weights[word] = odds
        elif word in weights:
            weights[word] = max(0.05, (3.0 * 4 + odds * (c + t)) / (4 + c + t))
    lexicon = Lexicon(weights)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.automaton()
        for batch in batches:
            found = [measure(fold(t), own) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["y", "total", "size"])

    # At most about ``sample`` rows of three numbers.
    fit = chosen.mapInArrow(features, "y int, total double, size double").toPandas()
    # Labels are wrong now and then: with clipped ones a single row can't move the curve far.
    y, total, size = np.clip(fit["y"].to_numpy(float), 0.01, 0.99), fit["total"].to_numpy(float), fit["size"].to_numpy(float)
    _, bias, slope, power = max((*_curve(np.log1p(total / size**power), y), power) for power in POWERS)
    return Lexicon(weights, EXCEPTIONS, bias, slope, power) if slope > 0 else Lexicon(weights)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("hits", T.IntegerType())])


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and hits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        own = lexicon.automaton()
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            found = [measure(fold(t), own) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.probability(x, n) for x, n, _ in found], pa.float64()), pa.array([n for _, _, n in found], pa.int32())], names=SCORED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCORED)


def clean(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows below the limit, with all their columns."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steady()
        own = lexicon.automaton()
        for part in parts:
            yield pd.Series([lexicon.probability(*measure(fold(t or ""), own)[:2]) for t in part], dtype="float64")
        released()

    return docs.where(probability(F.col(text_col)) < limit)
