"""Katz backoff: n-gram models with Good-Turing discounts and exactly normalised backoff weights.

Tokens are words (runs without white space, A-Z in lower case) and one end for each text; a start stands before them.  A
token w behind a history x (at most ``order - 1`` tokens, fewer at a text's begin) has the probability

    P(w | x) = d * c(x w) / c(x)      if x w was seen in training
             = a(x) * P(w | x')       if only x was; x' is x without its first token
             = P(w | x')              otherwise
    P(w)     = d * c(w) / N           for words seen in training
             = what is left           for any other word, as one

with Good-Turing discounts d for counts up to ``TRUSTED`` (of each length of n-grams its own), and a(x) such that the
probabilities after each history add up to 1.  All n-grams count, those seen once included.

Texts are read once and kept as blocks: each block's distinct words and its tokens as numbers of these.  Counts and
weights live in partitioned tables by ranges of hashes of the histories.  Blocks ask for what they hold, each distinct
n-gram once with its count in the block, so a word or pair that makes up a third of the corpus is one entry of a block;
histories of more than ``SPLIT`` tokens are dealt to several parts by their followers.  Answers go back to the blocks:
counts first, then, where an unseen n-gram backs off, the sums over a history's followers that its weight takes.  Of
each n-gram that several blocks hold the first adds its term.  With these the blocks evaluate the recursion
for each token.

Nulls: a null text is empty and has its end alone; a null identifier is kept and takes part by the remainder of the
empty text.  Repeated rows count and are scored each.  Very long texts are taken whole, in a block of their own size.
Without training rows every token is unknown.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.blocks import blobs, documents, mixed, runs, spans
from tessel.llm.common import forget, input_bytes, partitions, released, steady, stored, trimmed

TRUSTED = 5
ORDER = 3
#: Tokens and documents of a block.
BLOCK, BLOCK_DOCS = 1_000_000, 60_000
#: Parts of the tables: at least so many, as many as shuffle partitions, and one for so many bytes of input.
PARTS, PART_BYTES = 64, 4 << 20
#: Training tokens of a history from which on its followers are dealt to one more part.
SPLIT = 2_000_000
#: The number of the start; words have lower ones.
START = 0xFFFFFFFF


def tight(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of like weight stand together."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sq", a.dtype.str.encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def loose(data: bytes | memoryview) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1 + 11 * data[0]
    for k in range(data[0]):
        kind, n = struct.unpack_from("<3sq", data, 1 + 11 * k)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def thrifty(run):
    """A group's function that gives the memory it took back to the machine."""

    def freed(*tables):
        steady()
        try:
            return run(*tables)
        finally:
            trimmed()

    def of_table(key, table):
        return freed(key, table)

    def of_tables(key, left, right):
        return freed(key, left, right)

    return of_table if run.__code__.co_argcount == 2 else of_tables


def small(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the least unsigned type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def grouped(part: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    """An order by part, and where each part begins in it (one more for the end)."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def first_true(flags: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run the first place that is set."""
    before = np.cumsum(flags) - flags
    return flags & (before - np.repeat(before[first], size) == 0)


# ----------------------------------------------------------------------------------------------------------- discounts


@dataclass(frozen=True)
class Discounts:
    """Factor of each count from 0 on; of higher ones 1."""

    factors: tuple[float, ...]

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([*self.factors, 1.0])
        return table[np.minimum(counts, len(self.factors))]


def good_turing(n: dict[int, int], trusted: int = TRUSTED) -> Discounts:
    """Katz's discounts from how many types occur 1, 2, ... times; where these numbers are too irregular to give factors
    between 0 and 1, half an occurrence is taken off instead."""
    out = [0.0]
    first = n.get(1, 0)
    common = (trusted + 1) * n.get(trusted + 1, 0) / first if first else 1.0
    for r in range(1, trusted + 1):
        factor = 0.0
        if n.get(r, 0) and common < 1:
            factor = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
        out.append(factor if 0 < factor < 1 else 1 - 0.5 / r)
    return Discounts(tuple(out))


@dataclass(frozen=True)
class Words:
    """What is known of single words over the whole table."""

    total: int
    vocabulary: int
    discounts: Discounts
    scale: float
    unknown: float

    @staticmethod
    def of_facts(facts: dict[int, int]) -> Words:
        total, vocabulary, own = facts.get(-1, 0), facts.get(-2, 0), good_turing(facts)
        # What the discounts leave of the words is the unknown word's.
        taken = sum(r * facts.get(r, 0) * (1 - own.factors[r]) for r in range(1, TRUSTED + 1))
        if total and not taken:  # no rare word at all: one occurrence more, unseen
            return Words(total, vocabulary, Discounts(tuple(1.0 for _ in own.factors)), total / (total + 1), 1 / (total + 1))
        return Words(total, vocabulary, own, 1.0, taken / total if total else 1.0)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * self.discounts.of(counts) * counts / max(self.total, 1), self.unknown)


# -------------------------------------------------------------------------------------------------------------- blocks


def hashes_of(text: str) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return list(map(xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()))


def _symbols() -> tuple[int, int]:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b"", 1), xxh3_64_intdigest(b"", 2)


ROWS = "part int, block long, kind int, data binary"


def rows_of(part: list[int], block: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "kind", "data"])


def sent(block: int, messages: Iterator[tuple[int, bytes]], kind: int = 1) -> Iterator[pa.RecordBatch]:
    """Messages to parts, some to a batch."""
    part, data = [], []
    for p, raw in messages:
        part.append(p)
        data.append(raw)
        if len(data) == 64:
            yield rows_of(part, [block] * 64, [kind] * 64, data)
            part, data = [], []
    if data:
        yield rows_of(part, [block] * len(data), [kind] * len(data), data)


def word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    return grouped(((words >> np.uint64(33)) % np.uint64(parts)).astype(np.int32), parts)


def read_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks: documents and tokens (kind 0), and to each part its words with their counts in training (kind 1)."""

    def run(batches):
        steady()
        here, number = TaskContext.get().partitionId(), 0
        start, end = _symbols()

        def block(held):
            nonlocal number
            name = here << 24 | number
            number += 1
            ids, train, texts = zip(*held, strict=True)
            held.clear()
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = np.concatenate([np.array(t, np.uint64) for t in texts])
            words, flat = np.unique(flat, return_inverse=True)
            learned = np.repeat(np.array(train, bool), sizes)
            counts = np.bincount(flat[learned], minlength=len(words))
            head = tight(np.array([0 if d is None else d for d in ids], np.int64), np.array([d is None for d in ids], bool), np.array(train, bool), sizes.astype(np.int32) - 1, words, flat.astype(np.uint32))
            yield rows_of([-1], [name], [0], [head])
            order, at = word_order(words, parts)
            words, counts = words[order], counts[order]
            yield from sent(name, ((p, tight(words[a:b], small(counts[a:b]))) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a))

        held, size = [], 0
        for doc, text, train in documents(batches):
            held.append((doc, train, [start, *hashes_of(text), end]))
            size += len(held[-1][2])
            if size >= BLOCK or len(held) >= BLOCK_DOCS:
                yield from block(held)
                size = 0
                trimmed()
        if held:
            yield from block(held)
        released()

    return rows.select("doc_id", "text", "train").mapInArrow(run, ROWS)


#: Rows of a part: kind 1 are answers to blocks; kinds from 100 on tell of the table, in ``n``.
TOLD = "block long, kind int, data binary, n long"
FACTS = 100


def told(blocks: list[int], kinds: list[int], data: list[bytes], facts: dict[int, int]) -> pa.Table:
    m, keys = len(blocks), sorted(facts)
    return pa.table({"block": pa.array([*blocks, *[None] * len(keys)], pa.int64()), "kind": pa.array([*kinds, *(FACTS + k for k in keys)], pa.int32()), "data": pa.array([*data, *[None] * len(keys)], pa.binary()), "n": pa.array([*[None] * m, *(facts[k] for k in keys)], pa.int64())})


def facts_of(table: DataFrame) -> dict[int, int]:
    """A few numbers of the whole table."""
    return {r["kind"] - FACTS: r["n"] for r in table.where(f"kind >= {FACTS} - 10 and n is not null").groupBy("kind").agg(F.sum("n").alias("n")).collect()}


def tally(counts: np.ndarray) -> dict[int, int]:
    return {r: int((counts == r).sum()) for r in range(1, TRUSTED + 2)}


def number_words(parts: int):
    """To each block the words' numbers and counts; a part's words have numbers of their own, frequent ones low."""
    start, _ = _symbols()

    @thrifty
    def run(key, table):
        blocks, asked = table.column("block").to_pylist(), [loose(x) for x in blobs(table)]
        words = np.concatenate([x[0] for x in asked])
        order = np.argsort(words, kind="stable")
        first, size = runs(words[order])
        counts = np.add.reduceat(np.concatenate([x[1].astype(np.int64) for x in asked])[order], first)
        place = np.empty(len(first), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(first))
        names = (place * parts + key[0].as_py()).astype(np.uint32)
        if len(first) * parts >= START:
            raise OverflowError("more words than numbers")
        special = words[order][first] == np.uint64(start)
        names[special], counts[special] = START, 0
        own_names, own_counts = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        own_names[order], own_counts[order] = np.repeat(names, size), np.repeat(counts, size)
        stops = np.cumsum([len(x[0]) for x in asked]).tolist()
        data = [tight(own_names[a:b], small(own_counts[a:b])) for a, b in zip([0, *stops], stops, strict=False)]
        return told(blocks, [key[0].as_py() + 1000] * len(blocks), data, tally(counts) | {-1: int(counts.sum()), -2: int((counts > 0).sum())})

    return run


@dataclass
class Block:
    """A block's documents, its tokens as numbers of its words, and of each word the number and count in the table."""

    ids: np.ndarray
    null: np.ndarray
    train: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    names: np.ndarray
    counts: np.ndarray
    grams: dict[int, np.ndarray] = field(default_factory=dict)

    def data(self) -> bytes:
        return tight(self.ids, self.null, self.train, self.lengths, small(self.tokens), self.names, small(self.counts))

    @staticmethod
    def of(data: bytes | memoryview) -> Block:
        ids, null, train, lengths, tokens, names, counts = loose(data)
        return Block(ids, null, train, lengths, tokens.astype(np.int32), names, counts.astype(np.int64))

    @cached_property
    def document(self) -> np.ndarray:
        """Of each token; starts count as tokens."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths + 1)

    @cached_property
    def place(self) -> np.ndarray:
        """Of each token in its text; the start's is 0."""
        sizes = self.lengths + 1
        return np.arange(len(self.tokens), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)

    def kinds(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens that end an n-gram of k, the number of each one's n-gram (by history, then word), and of each n-gram one
        such token.  The numbers are kept, for histories of longer ones."""
        at = np.flatnonzero(self.place >= k - 1).astype(np.int32)
        before = self.tokens if k == 2 else self.gram(k - 1)
        key = before[at - 1].astype(np.uint64)
        key *= np.uint64(len(self.names))
        key += self.tokens[at].astype(np.uint64)
        bits = max(1, len(at) - 1).bit_length()
        if int(key.max(initial=0)).bit_length() + bits <= 64:  # places ride along, so numbers are sorted and not places
            key <<= np.uint64(bits)
            key |= np.arange(len(at), dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
            key >>= np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        first, size = runs(key)
        gram = np.empty(len(order), np.int32)
        gram[order] = np.repeat(np.arange(len(first), dtype=np.int32), size)
        self.grams[k] = np.empty(len(self.tokens), np.int32)
        self.grams[k][at] = gram
        return at, gram, at[order[first]]

    def gram(self, k: int) -> np.ndarray:
        if k not in self.grams:
            self.kinds(k)
        return self.grams[k]


def named(parts: int):
    """Puts what the parts told of a block's words to its tokens."""

    @thrifty
    def run(key, left, right):
        name = key[0].as_py()
        ids, null, train, lengths, words, tokens = loose(blobs(left)[0])
        order, at = word_order(words, parts)
        names, counts = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        for kind, raw in zip(right.column("kind").to_pylist(), blobs(right), strict=True):
            p = kind - 1000
            where = order[at[p] : at[p + 1]]
            names[where], counts[where] = loose(raw)
        # Frequent words get low numbers here too.
        turn = np.argsort(-counts, kind="stable")
        back = np.empty(len(turn), np.int64)
        back[turn] = np.arange(len(turn))
        own = Block(ids, null, train, lengths, back[tokens], names[turn], counts[turn])
        return pa.table({"block": pa.array([name], pa.int64()), "data": pa.array([own.data()], pa.binary())})

    return run


# -------------------------------------------------------------------------------------------------------------- levels


@dataclass
class Level:
    """The distinct n-grams of a length in a block, by histories; histories of many tokens stand in several units.

    ``by_part`` orders the n-grams and ``units_by_part`` the units as they are told to the parts."""

    at: np.ndarray  # tokens that end an n-gram
    gram: np.ndarray  # its number
    history: np.ndarray  # of each n-gram
    word: np.ndarray
    count: np.ndarray  # in the block's training rows
    names: list[np.ndarray]  # of each unit, the numbers of its history's words
    salt: np.ndarray
    unit: np.ndarray  # of each n-gram
    owner: np.ndarray  # the history of each unit
    split: np.ndarray  # whether a history has several units
    by_part: np.ndarray
    bounds: list[int]
    units_by_part: np.ndarray
    unit_bounds: list[int]
    fan: np.ndarray  # n-grams of each unit

    @staticmethod
    def of(own: Block, k: int, parts: int) -> Level:
        at, gram, one = own.kinds(k)
        count = np.bincount(gram[own.train[own.document[at]]], minlength=len(one)).astype(np.int32)
        word = own.tokens[one]
        first, size = runs((own.tokens if k == 2 else own.gram(k - 1))[one - 1])
        history = np.repeat(np.arange(len(first), dtype=np.int32), size)
        local = [own.tokens[one[first] - j] for j in range(k - 1, 0, -1)]
        # How often a history can have been seen: no more than its rarest word (the start: than there are texts).
        most = np.full(len(first), np.iinfo(np.int64).max)
        for x in local:
            most = np.minimum(most, np.where(own.names[x] == START, most, own.counts[x]))
        salts = np.where(most == np.iinfo(np.int64).max, 1, 1 + most // SPLIT)
        begin = (np.cumsum(salts) - salts).astype(np.int32)
        owner = np.repeat(np.arange(len(first), dtype=np.int32), salts)
        salt = np.arange(len(owner), dtype=np.int32) - begin[owner]
        unit, sorted_by_unit = begin[history], None
        if (salts > 1).any():
            unit = unit + (mixed(own.names[word].astype(np.uint64)) % salts.astype(np.uint64)[history]).astype(np.int32)
            sorted_by_unit = np.argsort(unit, kind="stable")
        names = [own.names[x][owner] for x in local]
        spread = mixed(salt.astype(np.uint64))
        for x in names:
            spread = mixed(spread ^ x.astype(np.uint64))
        part = (spread % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int32)
        del spread
        units_by_part, unit_bounds = grouped(part, parts)
        fan = np.bincount(unit, minlength=len(owner))
        by_part = spans((np.cumsum(fan) - fan)[units_by_part], fan[units_by_part])
        if sorted_by_unit is not None:
            by_part = sorted_by_unit[by_part]
        bounds = np.r_[0, np.cumsum(fan[units_by_part])][unit_bounds].tolist()
        return Level(at, gram, history, word, count, names, salt, unit, owner, salts > 1, by_part.astype(np.int32), bounds, units_by_part.astype(np.int32), unit_bounds, fan)


def ask_counts(blocks: DataFrame, k: int, parts: int) -> DataFrame:
    def run(batches):
        steady()
        for name, raw in documents(batches, 1):
            own = Block.of(raw)
            del raw
            level = Level.of(own, k, parts)

            def messages(own=own, level=level):
                words, counts = own.names[level.word[level.by_part]], level.count[level.by_part]
                units = level.units_by_part
                for p in range(parts):
                    (a, b), (c, d) = level.unit_bounds[p : p + 2], level.bounds[p : p + 2]
                    if b > a:
                        u = units[a:b]
                        yield p, tight(small(level.fan[u]), words[c:d], small(counts[c:d]), small(level.salt[u]), *(x[u] for x in level.names))

            yield from sent(name, messages())
            own = level = None
            trimmed()
        released()

    return blocks.mapInArrow(run, ROWS)


def same_units(names: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    """A number for each unit, the same for the same history and salt."""
    key = names[0].astype(np.uint64)
    for x in names[1:]:  # two at most
        key = key << np.uint64(32) | x
    order = np.lexsort((salt, key)) if salt.any() else np.argsort(key, kind="stable")
    key, salt = key[order], salt[order]
    new = np.zeros(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


@thrifty
def give_counts(key, table):
    """To each block: its n-grams' counts, which of them it stands for, each unit's sum, whether one of its n-grams is
    discounted, and whether any block backs off from it."""
    blocks, asked = table.column("block").to_pylist(), [loose(x) for x in blobs(table)]
    fans = [x[0].astype(np.int64) for x in asked]
    fan, word, count, salt = (np.concatenate(x) for x in (fans, [x[1] for x in asked], [x[2].astype(np.int64) for x in asked], [x[3].astype(np.int64) for x in asked]))
    unit = same_units([np.concatenate([x[j] for x in asked]) for j in range(4, len(asked[0]))], salt)
    units = int(unit.max(initial=-1)) + 1
    of = np.repeat(unit, fan)
    keys = of.astype(np.uint64) << np.uint64(32) | word
    order = np.argsort(keys, kind="stable")
    first, size = runs(keys[order])
    sums = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
    stands = np.empty(len(order), bool)
    stands[order] = first_true(count[order] > 0, first, size)
    total = np.bincount(of[order][first], sums, units).astype(np.int64)
    rare, void = np.zeros(units, bool), np.zeros(units, bool)
    rare[of[order][first][(sums > 0) & (sums <= TRUSTED)]] = True
    void[of[order][first][sums == 0]] = True
    counts = np.empty(len(order), np.int64)
    counts[order] = np.repeat(sums, size)
    data, a, c = [], 0, 0
    for own in fans:
        b, d = a + len(own), c + int(own.sum())
        u = unit[a:b]
        data.append(tight(small(counts[c:d]), np.packbits(stands[c:d]), small(total[u]), np.packbits(rare[u]), np.packbits(void[u])))
        a, c = b, d
    return told(blocks, [key[0].as_py() + 1000] * len(blocks), data, tally(sums))


def bits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).astype(bool)


@dataclass
class Counted:
    """What the table says of a block's n-grams of a length, and of their histories."""

    count: np.ndarray
    stands: np.ndarray
    total: np.ndarray  # of each history
    full: np.ndarray  # histories without a discounted follower
    wanted: np.ndarray  # of each unit: whether any block backs off from it

    @staticmethod
    def of(level: Level, answers: list[tuple[int, memoryview]]) -> Counted:
        count, stands = np.zeros(len(level.word), np.int64), np.zeros(len(level.word), bool)
        units = len(level.owner)
        total, rare, void = np.zeros(units, np.int64), np.zeros(units, bool), np.zeros(units, bool)
        for p, raw in answers:
            (a, b), (c, d) = level.unit_bounds[p : p + 2], level.bounds[p : p + 2]
            counts, own, sums, rares, voids = loose(raw)
            where, u = level.by_part[c:d], level.units_by_part[a:b]
            count[where], stands[where] = counts, bits(own, d - c)
            total[u], rare[u], void[u] = sums, bits(rares, b - a), bits(voids, b - a)
        n = len(level.split)
        return Counted(count, stands, np.bincount(level.owner, total, n).astype(np.int64), np.bincount(level.owner, rare, n) == 0, void | level.split[level.owner])

    def probability(self, level: Level, own: Discounts) -> np.ndarray:
        """Of each n-gram seen in training; where no follower is discounted, one occurrence more is of none of them."""
        return own.of(self.count) * self.count / np.maximum(self.total + self.full, 1)[level.history]

    def backs_off(self, level: Level) -> np.ndarray:
        """Histories that were seen, but not before one of the block's words."""
        out = np.zeros(len(self.total), bool)
        out[level.history[self.count == 0]] = True
        return out & (self.total > 0)


def of_length(table: pa.Table, k: int) -> list[tuple[int, memoryview]]:
    """Answers of a step, with their parts."""
    return [(kind - 1000, raw) for step, kind, raw in zip(table.column("step").to_pylist(), table.column("kind").to_pylist(), blobs(table), strict=True) if step == k]


def ask_weights(k: int, parts: int, words: Words, discounts: dict[int, Discounts]):
    """For each unit that somebody backs off from, what the block stands for of its probabilities (of this length and of
    the one below), and whether the block wants the sums."""

    @thrifty
    def run(key, left, right):
        own = Block.of(blobs(left)[0])
        level = Level.of(own, k, parts)
        counted = Counted.of(level, of_length(right, k))
        p = counted.probability(level, discounts[k])
        if k == 2:
            below = words.probability(own.counts)[level.word]
        else:
            lower = Level.of(own, k - 1, parts)
            lower_p = Counted.of(lower, of_length(right, k - 1)).probability(lower, discounts[k - 1])
            # The n-gram without its first word ends at the same token.
            shorter = np.empty(len(level.word), np.int32)
            shorter[level.gram] = own.gram(k - 1)[level.at]
            below = lower_p[shorter]
            del lower, lower_p, shorter
        mine = counted.stands & counted.wanted[level.unit]
        units = len(level.owner)
        mass, base = np.bincount(level.unit[mine], p[mine], units), np.bincount(level.unit[mine], below[mine], units)
        wants = counted.backs_off(level)[level.owner]
        has = wants | (np.bincount(level.unit[mine], minlength=units) > 0)
        part, data = [], []
        for q in range(parts):
            u = level.units_by_part[level.unit_bounds[q] : level.unit_bounds[q + 1]]
            u = u[has[u]]
            if len(u):
                part.append(q)
                data.append(tight(mass[u], base[u], np.packbits(wants[u]), small(level.salt[u]), *(x[u] for x in level.names)))
        name = key[0].as_py()
        return pa.Table.from_batches([rows_of(part, [name] * len(part), [1] * len(part), data)])

    return run


@thrifty
def give_weights(key, table):
    """To each block the sums of the units it wants."""
    blocks, asked = table.column("block").to_pylist(), [loose(x) for x in blobs(table)]
    mass, base, salt = (np.concatenate(x) for x in zip(*((x[0], x[1], x[3].astype(np.int64)) for x in asked), strict=True))
    unit = same_units([np.concatenate([x[j] for x in asked]) for j in range(4, len(asked[0]))], salt)
    mass, base = np.bincount(unit, mass), np.bincount(unit, base)
    out_block, data, a = [], [], 0
    for name, x in zip(blocks, asked, strict=True):
        n = len(x[0])
        u = unit[a : a + n][bits(x[2], n)]
        a += n
        if len(u):
            out_block.append(name)
            data.append(tight(mass[u], base[u]))
    return told(out_block, [key[0].as_py() + 1000] * len(data), data, {})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def evaluate(order: int, parts: int, words: Words, discounts: dict[int, Discounts]):
    """The recursion for each token of a block, and the sums of its documents."""

    @thrifty
    def run(key, left, right):
        own = Block.of(blobs(left)[0])
        p = words.probability(own.counts)[own.tokens]
        for k in range(2, order + 1):
            level = Level.of(own, k, parts)
            counted = Counted.of(level, of_length(right, k))
            wants = counted.backs_off(level)
            units = wants[level.owner]
            mass, base = np.zeros(len(units)), np.zeros(len(units))
            for q, raw in of_length(right, -k):
                u = level.units_by_part[level.unit_bounds[q] : level.unit_bounds[q + 1]]
                mass[u[units[u]]], base[u[units[u]]] = loose(raw)
            n = len(wants)
            weight = (1 - np.bincount(level.owner, mass, n)) / np.maximum(1 - np.bincount(level.owner, base, n), 1e-300)
            seen, history = counted.count[level.gram] > 0, level.history[level.gram]
            backed = np.where(wants[history], weight[history], 1.0) * p[level.at]
            p[level.at] = np.where(seen, counted.probability(level, discounts[k])[level.gram], backed)
            del level, counted, seen, history, backed
        real, doc = own.place > 0, own.document
        known = own.counts[own.tokens]
        base_score = np.log10((known + 1) / (words.total + words.vocabulary + 1))
        n = len(own.ids)
        sums = [np.bincount(doc[real], x[real], n) for x in (known > 0, base_score, np.log10(p))]
        return pa.table({"doc_id": pa.array(own.ids, mask=own.null), "held_out": pa.array(~own.train), "n_tokens": pa.array(own.lengths.astype(np.int64)), "n_known": pa.array(np.rint(sums[0]).astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def score_documents(docs: DataFrame, train_on, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Trains on the rows for which ``train_on`` (a condition) holds and scores every row."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    parts = max(PARTS, partitions(spark), input_bytes(docs) // PART_BYTES)
    read = stored(read_blocks(rows, parts), "katz-read")
    numbered = stored(read.where("kind = 1").groupBy("part").applyInArrow(number_words(parts), TOLD), "katz-words")
    words = Words.of_facts(facts_of(numbered))
    answers = numbered.where("kind >= 1000").select("block", "kind", "data")
    blocks = stored(read.where("kind = 0").select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(named(parts), "block long, data binary"), "katz-blocks")
    forget(spark, read, numbered)

    def step(table: DataFrame, k: int) -> DataFrame:
        return table.where("kind >= 1000").select("block", F.lit(k).alias("step"), "kind", "data")

    discounts: dict[int, Discounts] = {}
    told_so_far: DataFrame | None = None
    kept: list[DataFrame] = []
    for k in range(2, order + 1):
        counted = stored(ask_counts(blocks, k, parts).groupBy("part").applyInArrow(give_counts, TOLD), "katz-counts")
        discounts[k] = good_turing(facts_of(counted))
        told_so_far = step(counted, k) if told_so_far is None else told_so_far.unionByName(step(counted, k))
        needed = told_so_far.where(F.col("step").isin(k, k - 1))
        asked = stored(blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(ask_weights(k, parts, words, dict(discounts)), ROWS), "katz-asked")
        weights = stored(asked.groupBy("part").applyInArrow(give_weights, TOLD), "katz-weights")
        forget(spark, asked)
        told_so_far = told_so_far.unionByName(step(weights, -k))
        kept += [counted, weights]
    scored = blocks.groupBy("block").cogroup(told_so_far.groupBy("block")).applyInArrow(evaluate(order, parts, words, discounts), SCORES)
    out = stored(scored, "katz-scores")
    forget(spark, blocks, *kept)
    return out.withColumn("train_tokens", F.lit(words.total).cast("long"))
