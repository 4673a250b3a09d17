"""Best-fit packing by sums of squares.

Each document is encoded, closed by an end id and, if longer than a sequence, cut into full pieces of which only the
first may be shorter.  Every piece of less than a full sequence is then placed in the open bin that leaves the smallest
sum of squared counts of open bins per residual gap (the smallest such gap of several); a new bin is opened where none
fits.  Pieces are taken in falling length, equal ones in their order, within blocks of about ``block`` pieces of a task,
so memory is bounded.  Then the pieces in sequences that have room left, of all tasks and blocks, are taken out and
packed together by the same rule.

Nulls: a null text is empty (its piece is the end id alone); a null id is kept as null.  Very long texts are encoded
whole.  Repeated rows are packed once each.  An empty table gives an empty result.  Other columns of the input, whatever
their names, are ignored by :func:`encode_pieces` and :func:`pack_documents`; :func:`pack` carries them and replaces
those of the names it adds.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import released, stored

SEQUENCE = 1024
END_ID = 2
#: Distinct chunks a worker remembers; beyond, chunks not yet known are encoded each time.
REMEMBERED = 300_000
#: Longest chunk that is remembered.
CHUNK_CHARS = 64
#: Signs that often end a word; a run of them is a match of its own behind letters.
SIGNS = ".,;:!?|"
#: A stop or comma that doesn't stand behind a letter or digit and so may be part of a longer match.
LOOSE = re.compile(r"(?:^|[\W_])[.,]")


class ChunkEncoder:
    """Encodes texts chunk by chunk with a memory of chunks.

    A boundary before a single space or line break between two characters that aren't white space is one that the
    byte-level pre-splitting pattern always makes, so the ids of a text are those of its chunks in a row.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory()
        self.tails: dict[str, bytes] = {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def words(self, pieces: list[str]) -> list[bytes]:
        """Ids of spaced words of letters only: many in one call, between line breaks, which are ids of their own."""
        if len(self.line) != 1:
            return self.raw(pieces)
        groups = [pieces[k : k + 512] for k in range(0, len(pieces), 512)]
        out: list[bytes] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([*x, ""]) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(ids == self.line[0])
            if len(stops) != len(group):
                out += self.raw(group)
                continue
            data, begins = ids.tobytes(), [0, *(4 * stops + 4).tolist()]
            out += [data[a : b - 4] for a, b in zip(begins, begins[1:], strict=False)]
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't known.  A spaced word with signs behind it is that word and the signs."""
        known, fresh = self.known, {}
        plain: set[str] = set()
        mixed, tailed = [], []
        for c in new:
            if c[0] != " ":
                mixed.append(c)
                continue
            word = c.rstrip(SIGNS)
            if not word[1:].isalpha() or len(c) > len(word) + 4:
                mixed.append(c)
                continue
            if word not in known:
                plain.add(word)
            if len(word) < len(c):
                tail = c[len(word) :]
                tailed.append((c, word, tail))
                if tail not in self.tails:
                    self.tails[tail] = self.raw([tail])[0]
        words = list(plain)
        fresh.update(zip(words, self.words(words), strict=True))
        for c, word, tail in tailed:
            fresh[c] = (known.get(word) or fresh[word]) + self.tails[tail]
        for k in range(0, len(mixed), 4096):
            fresh.update(zip(mixed[k : k + 4096], self.raw(mixed[k : k + 4096]), strict=True))
        return fresh

    def raw(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cuts before single spaces and single line breaks; a text with special strings or other white space at a
        boundary stays together there."""
        if "<|" in text:
            return [text]
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if k:
                if parts[0] and out[-1][-1:] and not out[-1][-1].isspace() and not parts[0][0].isspace():
                    out.append("\n" + parts[0])
                else:
                    out[-1] += "\n" + parts[0]
            else:
                out.append(parts[0])
            for part in parts[1:]:
                last = out[-1]
                if part and last and not last[-1].isspace() and not part[0].isspace():
                    out.append(" " + part)
                else:
                    out[-1] = last + " " + part
        return [x for x in out if x]

    def fast(self, text: str) -> list[str] | None:
        """The chunks, where no white space but single spaces and line breaks occurs."""
        if "<|" in text or "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return None
        if not text.isprintable() and not text.replace("\n", "").isprintable() or "　" in text or "\xa0" in text:
            return None
        if not text or text[0] in " \n" or text[-1] in " \n":
            return None
        cut = text.replace("\n", " \n").replace(" ", "\x00 ").replace("\x00 \n", "\x00\n")
        if not LOOSE.search(text):
            cut = cut.replace(".", "\x00.").replace(",", "\x00,")
        return cut.split("\x00")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        split = [self.fast(x) or self.chunks(x) for x in texts]
        seen: set[str] = set()
        for chunks in split:
            seen.update(chunks)
        fresh = known.fresh = self.learn([c for c in seen if c not in known])
        room = REMEMBERED - len(known)
        if room > 0:
            known.update(kept if len(kept := {c: ids for c, ids in fresh.items() if len(c) <= CHUNK_CHARS}) <= room else dict(islice(kept.items(), room)))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        known.fresh = {}
        return out


class Memory(dict):
    """Ids of frequent chunks; what isn't there is looked up among those of the present call."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.fresh[chunk]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def cuts(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first takes the remainder."""
    first = (n - 1) % most + 1
    return [(0, first), *((k, most) for k in range(first, n, most))]


def encoded(batches: Iterator[pa.RecordBatch], name: str, end_id: int, sequence: int, slice_rows: int, ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows (identifier and text) of batches: with their ids, or with the ids' crc32."""
    import zlib

    own, end = encoder(name), np.array([end_id], "<u4").tobytes()
    for whole in batches:
        for k in range(0, whole.num_rows, slice_rows):
            batch = whole.slice(k, slice_rows)
            docs_of, piece, start, length, last = [], [], [], [], []
            for doc, data in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                data += end
                for i, (at, n) in enumerate(cuts(len(data) // 4, sequence)):
                    docs_of.append(doc)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    part = data[4 * at : 4 * (at + n)]
                    last.append(part if ids else zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(last, pa.binary() if ids else pa.int64())], names=[*PIECES.names[:4], "ids" if ids else "ids_crc32"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, slice_rows: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    name = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, name, end_id, sequence, slice_rows, True)
        released()

    return _texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    count = np.zeros(sequence + 1, np.int64)  # open bins by residual gap
    waiting: list[list[int]] = [[] for _ in range(sequence + 1)]
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        gaps = np.flatnonzero(count[size:sequence]) + size
        if len(gaps):
            change = 2 * (count[gaps - size] - count[gaps]) + 2  # of the sum of squares
            if gaps[0] == size:  # a full bin is no longer counted
                change[0] = 1 - 2 * count[size]
            gap = int(gaps[change.argmin()])
            count[gap] -= 1
            where = waiting[gap].pop()
        else:
            gap, where = sequence, made
            made += 1
        bins[k], offsets[k] = where, sequence - gap
        if gap > size:
            count[gap - size] += 1
            waiting[gap - size].append(where)
    return bins, offsets, made


def placed(batches: Iterator[pa.RecordBatch], place: int, sequence: int, block: int) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id (partition and a running number), offset, and whether the sequence has room left."""
    first, held, rows_held = TaskContext.get().partitionId() << 36, [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal first
        table = pa.Table.from_batches(held)
        lengths = table.column(place).to_numpy()
        bins, offsets, made = sum_of_squares(lengths, sequence)
        room = np.bincount(bins, lengths, made) < sequence
        out = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).append_column("room", pa.array(room[bins]))
        first += made
        yield from out.combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        rows_held += batch.num_rows
        if rows_held >= block:
            yield from packed()
            held, rows_held = [], 0
    if rows_held:
        yield from packed()


def _placed_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("room", T.BooleanType())])


def packed_again(first: DataFrame, length_col: str, sequence: int, block: int) -> DataFrame:
    """Takes apart the sequences of all blocks that have room left and packs their pieces together, in groups of about
    ``block``; a group stays as it is where that gives no fewer sequences.  ``first`` is a stored table."""
    rest = first.where("room")
    groups = max(1, math.ceil(rest.count() / block))
    schema = T.StructType(first.schema.fields[:-1])
    place = first.columns.index(length_col)

    def run(key, table):
        table = table.select(schema.names)
        lengths, before = table.column(place).to_numpy(), table.column("sequence_id").to_numpy()
        bins, offsets, made = sum_of_squares(lengths, sequence)
        if made >= len(np.unique(before)):
            return table
        n = table.num_columns
        return table.set_column(n - 2, "sequence_id", pa.array(-1 - ((key[0].as_py() << 36) + bins))).set_column(n - 1, "offset", pa.array(offsets))

    again = rest.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("__group")).applyInArrow(run, schema)
    return first.where("not room").drop("room").unionByName(again)


def pack(pieces: DataFrame, *, length_col: str = "length", sequence: int = SEQUENCE, block: int = 60_000) -> DataFrame:
    """Adds sequence_id and offset (columns of these names and ``room`` are replaced); every other column is carried."""
    carried = [x for x in pieces.columns if x not in ("sequence_id", "offset", "room")]
    rows = pieces.select(*carried)
    at = carried.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from placed(batches, at, sequence, block)

    return packed_again(stored(rows.mapInArrow(run, _placed_schema(rows.schema)), "packed"), length_col, sequence, block)


DIGESTS = T.StructType([*PIECES.fields[:4], T.StructField("ids_crc32", T.LongType())])


def pack_documents(docs: DataFrame, *, sequence: int = SEQUENCE, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = 60_000) -> DataFrame:
    """Pieces with their digest and their place; the ids themselves don't leave the task that makes them."""
    name = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from placed(encoded(batches, name, END_ID, sequence, 256, False), 3, sequence, block)
        released()

    first = stored(_texts(docs, id_col, text_col).mapInArrow(run, _placed_schema(DIGESTS)), "packed")
    return packed_again(first, "length", sequence, block)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids of all pieces in the order of their offsets, and the documents."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return pieces.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.aggregate("m", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("m", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("pieces"))
