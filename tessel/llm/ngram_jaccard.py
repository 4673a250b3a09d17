"""Exact self-join of documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

The method is a metric-space join: pivots cut the space into Voronoi regions, documents near a border are replicated by
windows that the triangle inequality bounds, and regions are joined recursively.

Jaccard distance has a plateau: texts that share no shingle are all at distance 1, where no pivot tells them apart.  So
the first regions hold what can lie within the radius of one another at all.  Shingles have one order, rare ones first
(by the number of documents that hold them, counted over the whole table).  Sizes are distances to the empty set, so the
triangle inequality bounds how many of a document's first shingles a document within the radius can miss: its window,
``n - ceil(t * n) + 1`` shingles.  Of each shingle that several documents hold, one of them is the pivot, and a document
is a member of the regions of the pivots of its window.  Two linked documents share the first of their common shingles
in both windows, and so a region.  Shingles of one document alone come first in the order and need no region: a document
of which more than a window's worth is its own has no link.

A region that fits into a task is joined there: windows again, under the order of the region's own counts, then whole
sets, and a union-find that leaves out pairs which are connected already.  Larger regions get several pivot documents
of their own; each member goes to its nearest (true distances), these regions are joined recursively, and their links'
components found.  Then members visit the other regions, if ``d(x, q) <= d(x, own) + 2r`` and ``d(x, q) <= R(q) + r``
(r the radius, R(q) the largest distance of a member of q to its pivot) leave a link possible, and if somebody there
belongs to a larger component (of two linked documents of different components the one of the smaller visits).
Only links that connect are given out, at most one for each member of a region.

Nothing is capped: a region whose pivots don't tell its members apart is cut by hash after ``DEPTH`` rounds, and
the windows of the cuts then are all of them.

Shingles are 64-bit hashes of words, sets are equal if 128-bit digests of them are; "exact" means up to such collisions.
First counts use 32 bits within a part of the hashes' range; collisions there change the order for all documents alike
and lose nothing.

Nulls: a null or empty text has no shingle and no links; a null identifier is kept, without component.  Rows that repeat
an identifier are one document that holds the links of each (rows without words stand alone).  Ties between pivots go to
the first.  Very long texts are taken whole.  An empty table gives an empty result; other columns, whatever their names,
are ignored by :func:`join` and carried by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.blocks import blobs, cut, documents, mixed, pack, runs, spans, unpack
from tessel.llm.common import forget, input_bytes, partitions, released, stored
from tessel.llm.components import components

WORDS = 5
THRESHOLD = (3, 4)  # 0.75
#: Shingles and documents that a task gathers before it gives them away.
BLOCK, BLOCK_DOCS = 1_500_000, 60_000
#: Documents of a block from which on it tells of a shingle once and not for each of them.
OFTEN = 64
#: Parts of the hashes' range: at least so many, twice the shuffle partitions, and one for so many bytes of input.
PARTS, PART_BYTES = 128, 4 << 20
#: A region is joined in one task up to so many members and bytes of sets.
LEAF, LEAF_BYTES = 2048, 16 << 20
#: Pivots of a larger region, and how often regions are cut by distance before they are cut by hash.
PIVOTS, DEPTH = 32, 6
#: Identifiers that are broadcast at most (16 MB); longer lists are joined.
BROADCAST_IDS = 1_000_000

_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of all words if there are fewer."""
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxh3_64_intdigest, found)), np.uint64)
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    out = hashes[:n] + np.uint64(k)
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _GOLDEN + hashes[j : n + j]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def window(n, t: tuple[int, int] = THRESHOLD):
    """How many of its first shingles a document is replicated by."""
    return (n + (-n * t[0]) // t[1] + 1) * (n > 0)


def least_overlap(a, b, t: tuple[int, int] = THRESHOLD):
    """The smallest intersection of linked sets of these sizes."""
    return -((-t[0] * (a + b)) // (t[0] + t[1]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(a: np.ndarray, b: np.ndarray, t: tuple[int, int] = THRESHOLD) -> bool:
    both = overlap(a, b)
    return both > 0 and t[1] * both >= t[0] * (len(a) + len(b) - both)


def digest_of(own: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    raw = xxh3_128_digest(own.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


ROWS = "part int, block long, kind int, data binary"
ANSWERS = "block long, kind int, data binary"


def _messages(names: list[str], *columns) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns, strict=True)], names=names)


def _pivot_keys(block: int, who: np.ndarray) -> np.ndarray:
    """A number for each document of a block, in no order that the data know of; the least of a shingle's is its pivot."""
    return mixed(np.uint64(block << 16) | who.astype(np.uint64))


def ask(docs: DataFrame, parts: int, words: int) -> DataFrame:
    """Blocks: of each its documents (kind 0), and by parts of the hashes' range who holds which shingle (kind 1)."""

    def run(batches):
        here, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        known: dict[tuple[int, int], int] = {}
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = here << 24 | number
            number += 1
            hashes = np.concatenate([np.zeros(0, np.uint64), *held])
            who = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            held.clear()
            keys = ((hashes >> np.uint64(40)) % np.uint64(parts)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            first, many = runs(keys)
            often = many >= OFTEN
            at, n = first[often], many[often]
            stub_who = who[spans(at, n)]
            stub_keys = keys[at]
            least = np.minimum.reduceat(_pivot_keys(name, stub_who), np.r_[0, np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.uint64)
            light = np.repeat(~often, many)
            keys, who = keys[light], who[light]
            ids = [r[0] for r in rows]
            head = pack(np.array([0 if d is None else d for d in ids], np.int64), np.array([d is None for d in ids], bool), *(np.array([r[k] for r in rows], kind) for k, kind in ((1, np.int32), (2, np.int64), (3, np.int64), (4, np.int32))), n.astype(np.int32), stub_who)
            rows.clear()
            known.clear()
            yield _messages(["part", "block", "kind", "data"], [name % parts], [name], [0], [head])
            edges = np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)
            light_at, stub_at = np.searchsorted(keys, edges).tolist(), np.searchsorted(stub_keys, edges).tolist()
            low = keys.astype(np.uint32)
            stub_low, counts = stub_keys.astype(np.uint32), n.astype(np.uint32)
            numbers, data = [], []
            for p in range(parts):
                a, b, c, d = light_at[p], light_at[p + 1], stub_at[p], stub_at[p + 1]
                if a < b or c < d:
                    numbers.append(p)
                    data.append(pack(low[a:b], who[a:b], stub_low[c:d], counts[c:d], least[c:d], np.arange(c, d, dtype=np.uint32)))
                if len(data) == 64 or p == parts - 1 and data:
                    yield _messages(["part", "block", "kind", "data"], numbers, [name] * len(data), [1] * len(data), data)
                    numbers, data = [], []

        for doc, text in documents(batches):
            own = shingles(text, words)
            high, low, member = 0, 0, -1
            if len(own):
                high, low = digest_of(own)
                if doc is not None and (high, low) not in known:
                    member = known[high, low] = len(held)
                    held.append(own)
                    size += len(own)
            rows.append((doc, len(own), high, low, member))
            if size >= BLOCK or len(rows) >= BLOCK_DOCS:
                yield from block()
                size = 0
        if rows:
            yield from block()
        released()

    return docs.mapInArrow(run, ROWS)


def census(key, table):
    """To each block: of its shingles that others hold too, how many do (a code that grows with it), and their pivots."""
    kinds, names = table.column("kind").to_pylist(), table.column("block").to_pylist()
    out_block, out_kind, out_data = [], [], []
    prints, counts, least, place, stub, of = [], [], [], [], [], []
    asked: list[int] = []
    for name, kind, raw in zip(names, kinds, blobs(table), strict=True):
        if kind == 0:
            out_block.append(name)
            out_kind.append(0)
            out_data.append(bytes(raw))
            continue
        light, who, stubs, times, lowest, at = unpack(raw)
        for p, n, low, where, whole in ((light, np.ones(len(light), np.int64), _pivot_keys(name, who), who, False), (stubs, times.astype(np.int64), lowest, at, True)):
            if len(p):
                prints.append(p)
                counts.append(n)
                least.append(low)
                place.append(where.astype(np.uint32))
                stub.append(np.full(len(p), whole))
                of.append(np.full(len(p), len(asked), np.int32))
        asked.append(name)
    if prints:
        prints = np.concatenate(prints)
        order = np.argsort(prints, kind="stable")
        first, size = runs(prints[order])
        held = np.add.reduceat(np.concatenate(counts)[order], first)
        pivot = np.minimum.reduceat(np.concatenate(least)[order], first)
        shared = held > 1
        code = np.minimum(255, np.floor(8 * np.log2(held[shared]))).astype(np.uint8)
        kept = order[np.repeat(shared, size)]
        code, pivot = np.repeat(code, size[shared]), np.repeat(pivot[shared], size[shared])
        place, stub, of = (np.concatenate(x)[kept] for x in (place, stub, of))
        order = np.argsort(of, kind="stable")
        code, pivot, place, stub, of = code[order], pivot[order], place[order], stub[order], of[order]
        for k, a, b in cut(of):
            pivots, which = np.unique(pivot[a:b], return_inverse=True)
            which = which.astype(np.min_scalar_type(len(pivots)))
            whole = stub[a:b]
            out_block.append(asked[k])
            out_kind.append(1)
            out_data.append(pack(pivots, place[a:b][~whole].astype(np.uint16), code[a:b][~whole], which[~whole], place[a:b][whole], code[a:b][whole], which[whole]))
    return pa.Table.from_batches([_messages(["block", "kind", "data"], out_block, out_kind, out_data)])


MEMBERS = "doc_id long, n long, hi long, lo long, cells array<long>"


def choose(t: tuple[int, int]):
    """Of a block's documents, with their sizes and digests, the regions that their windows reach."""

    def run(key, table):
        head, answers = None, []
        for kind, raw in zip(table.column("kind").to_pylist(), blobs(table), strict=True):
            if kind == 0:
                head = unpack(raw)
            else:
                answers.append(unpack(raw))
        ids, null, n, high, low, member, stub_sizes, stub_who = head
        stub_at = np.r_[0, np.cumsum(stub_sizes)]
        who, code, pivot = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)]
        for pivots, light, c, which, stubs, sc, swhich in answers:
            times = stub_sizes[stubs]
            who += [light, stub_who[spans(stub_at[stubs], times)]]
            code += [c, np.repeat(sc, times)]
            pivot += [pivots[which], np.repeat(pivots[swhich], times)]
        who, code, pivot = np.concatenate(who), np.concatenate(code), np.concatenate(pivot)
        order = np.lexsort((pivot, code, who))
        who, pivot = who[order].astype(np.int64), pivot[order]
        size = np.zeros(int(member.max(initial=-1)) + 1, np.int64)
        size[member[member >= 0]] = n[member >= 0]
        shared = np.bincount(who, minlength=len(size))
        # What a document holds alone comes first in its window.
        take = np.clip(window(size, t) - (size - shared), 0, shared)
        begin = np.cumsum(shared) - shared
        chosen = np.arange(len(who)) - begin[who] < take[who]
        pairs = np.unique(np.stack([who[chosen].astype(np.uint64), pivot[chosen]]), axis=1) if chosen.any() else np.zeros((2, 0), np.uint64)
        reached = np.bincount(pairs[0].astype(np.int64), minlength=len(size))
        own = np.where(member >= 0, reached[np.maximum(member, 0)] if len(size) else 0, 0)
        starts = (np.cumsum(reached) - reached)[np.maximum(member, 0)] if len(size) else np.zeros(len(member), np.int64)
        values = pairs[1][spans(starts, own)].view(np.int64)
        cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(own)].astype(np.int32)), pa.array(values))
        return pa.table({"doc_id": pa.array(ids, mask=null), "n": pa.array(n.astype(np.int64)), "hi": pa.array(high), "lo": pa.array(low), "cells": cells})

    return run


def connect(sets: list[np.ndarray], t: tuple[int, int], label: np.ndarray | None = None, visits: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members of different labels that connect all that linked pairs connect.  With ``visits``, only pairs
    of one that does and one that doesn't count."""
    m = len(sets)
    label = np.arange(m) if label is None else label.copy()
    if m == 2:
        return [(0, 1)] if label[0] != label[1] and linked(sets[0], sets[1], t) else []
    n = np.array([len(x) for x in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(token)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(m), n)
    key = rank[token]
    order = np.lexsort((key, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    width = window(n, t)
    inside = (place < width[owner[order]]) & (times[token[order]] > 1)
    who, key = owner[order][inside], key[order][inside]
    # Who stands in whose window, by shingle; members in rising size, so that partners stand before.
    by_key = np.argsort(key, kind="stable")
    first, size = runs(key[by_key])
    holders = who[by_key]
    region = np.empty(len(key), np.int64)
    region[by_key] = np.repeat(np.arange(len(first)), size)
    start = np.searchsorted(who, np.arange(m + 1))
    spare = width - n
    out = []
    for i in np.argsort(n, kind="stable").tolist():
        mine = region[start[i] : start[i + 1]]
        if not len(mine):
            continue
        met = np.bincount(holders[spans(first[mine], size[mine])], minlength=m)
        near = (met > 0) & (label != label[i]) & ((n < n[i]) | (n == n[i]) & (np.arange(m) < i))
        if visits is not None:
            near &= visits != visits[i]
        near &= met >= np.minimum(spare, spare[i]) + least_overlap(n, n[i], t)
        near &= t[1] * n >= t[0] * n[i]
        left = np.flatnonzero(near)
        left = left[np.argsort(-met[left], kind="stable")]
        while len(left):
            j, left = int(left[0]), left[1:]
            if linked(sets[i], sets[j], t):
                out.append((i, j))
                label[label == label[j]] = label[i]
                left = left[label[left] != label[i]]
    return out


LINKS = "a long, b long"


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in blobs(table, "set")]


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def join_leaves(placed: DataFrame, parts: int, t: tuple[int, int]) -> DataFrame:
    """Links within regions that fit into a task; ``placed`` has cell, id and set."""

    def run(key, table):
        table = table.sort_by("cell")
        ids, sets, out = table.column("id").to_numpy(), _sets(table), []
        for _, a, b in cut(table.column("cell").to_numpy()):
            if b - a > 1:
                out += [(int(ids[a + i]), int(ids[a + j])) for i, j in connect(sets[a:b], t)]
        return _links(out)

    return placed.select(F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("part"), "cell", "id", "set").groupBy("part").applyInArrow(run, LINKS)


def join_regions(placed: DataFrame, parts: int, t: tuple[int, int], leaf: tuple[int, int], depth: int = 0) -> DataFrame:
    """Links that connect what linked members of the same cell do; ``placed`` (cell, id, n, set) is a stored table."""
    bytes_of = F.sum(F.col("n") * 8)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("members"), bytes_of.alias("bytes")).where("members > 1")
    sizes = stored(sizes.withColumn("large", (F.col("members") > 2) & ((F.col("members") > leaf[0]) | (F.col("bytes") > leaf[1]))), "jaccard-sizes")
    rest = placed.join(sizes, "cell")
    links = stored(join_leaves(rest.where("not large"), parts, t), "jaccard-links")
    if not sizes.where("large").head(1):
        return links
    large = stored(rest.where("large"), "jaccard-large")
    return links.unionByName(split_regions(large, parts, t, leaf, depth))


def split_regions(large: DataFrame, parts: int, t: tuple[int, int], leaf: tuple[int, int], depth: int) -> DataFrame:
    """Voronoi regions of pivot documents within each cell, joined recursively, and then the visits across their borders."""
    radius, near = 1 - t[0] / t[1], depth < DEPTH
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.ceil(2 * F.col("members") / leaf[0]), F.ceil(2 * F.col("bytes") / leaf[1]), F.lit(2))).cast("int")
    drawn = large.groupBy("cell", F.pmod(F.xxhash64("id", F.lit(depth)), wanted).alias("k")).agg(F.min_by("set", F.xxhash64("id", F.lit(-depth - 1))).alias("pivot"))
    pivots = stored(drawn.groupBy("cell").agg(F.array_sort(F.collect_list("pivot")).alias("pivots")), "jaccard-pivots")

    def assign(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                homes, far = [], []
                for name, raw, others in zip(batch.column("id").to_pylist(), batch.column("set").to_pylist(), batch.column("pivots").to_pylist(), strict=True):
                    own = np.frombuffer(raw, np.uint64)
                    distance = []
                    for other in others:
                        q = np.frombuffer(other, np.uint64)
                        both = overlap(own, q)
                        distance.append(1 - both / (len(own) + len(q) - both))
                    tie = mixed(np.uint64([name & (1 << 64) - 1]) + np.uint64(depth))[0]
                    best = [i for i, d in enumerate(distance) if d == min(distance)] if near else list(range(len(distance)))
                    homes.append(best[int(tie) % len(best)])
                    far.append(distance)
                columns = [batch.column(c) for c in ("cell", "id", "n", "set")] + [pa.array(homes, pa.int32()), pa.array(far, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "n", "set", "home", "far"])

    dealt = stored(large.select("cell", "id", "n", "set").join(pivots, "cell").mapInArrow(assign, "cell long, id long, n long, set binary, home int, far array<double>"), "jaccard-dealt")
    forget(large.sparkSession, pivots, large)
    region = F.xxhash64("cell", "home", F.lit(depth))
    inner = stored(join_regions(stored(dealt.select(region.alias("cell"), "id", "n", "set"), "jaccard-regions"), parts, t, leaf, depth + 1), "jaccard-inner")
    # Components so far, and who has to look for links elsewhere: the smaller component of two.
    least = stored(components(inner), "jaccard-labels")
    grown = dealt.select("cell", "id", "n", "set", "home", "far").join(least.withColumnRenamed("least", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    weight = grown.groupBy("cell", "label").agg(F.count("*").alias("weight"))
    ranked = stored(grown.join(weight, ["cell", "label"]).withColumn("rank", F.struct("weight", "label")), "jaccard-ranked")
    regions = ranked.groupBy("cell", "home").agg(F.max("rank").alias("most"), F.max(F.expr("far[home]")).alias("reach")).select("cell", F.col("home").alias("q"), "most", "reach")
    told = regions.groupBy("cell").agg(F.collect_list(F.struct("q", "most", "reach")).alias("regions"))  # PIVOTS at most
    border = 2 * radius + 1e-9 if near else 2.0
    visiting = ranked.join(told, "cell").select("cell", "id", "n", "set", "label", "rank", "home", "far", F.explode("regions").alias("r")).where("r.q <> home and r.most > rank")
    visiting = visiting.where((F.expr("far[r.q]") <= F.expr("far[home]") + border) & (F.expr("far[r.q]") <= F.col("r.reach") + radius + 1e-9))
    visiting = visiting.select("cell", F.col("r.q").alias("q"), "id", "n", "set", "label")
    groups = visiting.groupBy("cell", "q").agg(F.greatest(F.ceil(F.count("*") / leaf[0]), F.ceil(F.sum("n") * 8 / leaf[1])).cast("int").alias("salts"))
    seats = ranked.select("cell", F.col("home").alias("q"), "id", "set", "label").join(groups, ["cell", "q"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("visits", F.lit(False)).drop("salts")
    guests = visiting.join(groups, ["cell", "q"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(depth)), F.col("salts")).cast("int")).withColumn("visits", F.lit(True)).select(*seats.columns)

    def meet(key, table):
        ids = table.column("id").to_numpy()
        return _links([(int(ids[i]), int(ids[j])) for i, j in connect(_sets(table), t, table.column("label").to_numpy(), table.column("visits").to_numpy(zero_copy_only=False))])

    across = stored(seats.unionByName(guests).groupBy("cell", "q", "salt").applyInArrow(meet, LINKS), "jaccard-visits")
    forget(large.sparkSession, dealt, least, ranked)
    return inner.unionByName(across)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, leaf: tuple[int, int] = (LEAF, LEAF_BYTES)) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links lead to, its own included) of every row."""
    spark, t = docs.sparkSession, threshold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(PARTS, 2 * partitions(spark), input_bytes(docs) // PART_BYTES)
    members = stored(ask(rows, parts, words).groupBy("part").applyInArrow(census, ANSWERS).groupBy("block").applyInArrow(choose(t), MEMBERS), "jaccard-members")
    held = members.where("n > 0 and doc_id is not null")
    # Equal sets are one member, under the least of their identifiers.
    kinds = stored(held.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("cells").alias("cells")), "jaccard-sets")
    work = kinds.where("size(cells) > 0").select(F.explode("cells").alias("cell"), "id", "hi", "lo", "n")
    several = work.groupBy("cell").count().where("count > 1").select("cell")
    work = stored(work.join(several, "cell", "left_semi"), "jaccard-work")
    needed = work.select("id", "hi", "lo").distinct()
    sets = stored(whole_sets(rows, needed, words), "jaccard-whole")
    placed = stored(work.join(sets, ["id", "hi", "lo"]).select("cell", "id", "n", "set"), "jaccard-placed")
    forget(spark, sets, work)
    links = join_regions(placed, parts, t, leaf)
    # Identifiers that stand for several sets link these.
    firsts = held.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("x"), F.max(F.struct("hi", "lo")).alias("y")).where("x <> y").select("doc_id", F.col("x.hi").alias("xhi"), F.col("x.lo").alias("xlo"))
    name = kinds.select("hi", "lo", "id")
    same = held.join(firsts, "doc_id").join(name.withColumnRenamed("id", "a"), ["hi", "lo"]).join(name.select(F.col("hi").alias("xhi"), F.col("lo").alias("xlo"), F.col("id").alias("b")), ["xhi", "xlo"]).select("a", "b")
    least = components(links.unionByName(same))
    named = stored(kinds.select("hi", "lo", "id").join(least, "id", "left").select("hi", "lo", F.coalesce("least", "id").alias("component_id")), "jaccard-components")
    forget(spark, placed, kinds)
    found = held.join(named, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def whole_sets(rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """id, hi, lo and set of the rows that hold a needed set."""
    ids = stored(needed.select(F.col("id").alias("doc_id")).distinct(), "jaccard-needed")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
                digests = [digest_of(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "hi", "lo", "set"])
        released()

    return rows.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id long, hi long, lo long, set binary").dropDuplicates(["id", "hi", "lo"])


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows whose identifier is the smallest of its component, and those without identifier, with all their columns."""
    away = join(docs, id_col=id_col, text_col=text_col, words=words, threshold=threshold).where("component_id <> doc_id").select(F.col("doc_id").alias("__away")).distinct()
    away = stored(away, "near-copies")
    side = F.broadcast(away) if away.count() <= BROADCAST_IDS else away
    return docs.join(side, docs[id_col].cast("long") == F.col("__away"), "left_anti")
