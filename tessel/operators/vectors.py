"""Vector search and the upkeep of a vector table (id, embedding, ...)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are broadcast at most, and of a block where there are more; vectors of a block.
BLOCK, VECTORS = 1_000, 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector; vectors of different length are an error."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension")).cast("double"))
    return F.coalesce(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k most similar vectors of each query: query_id, id, score (9 digits), rank; ties by id.

    A stated set of queries against all vectors.  Up to BLOCK queries are sent to the vectors, where they lie; more are
    dealt in blocks, and blocks of vectors meet blocks of queries.  Every task keeps its k best of each query before
    anything is shuffled on.
    """
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vector_id, vectors.schema[vector_id].dataType), T.StructField("score", T.DoubleType())])
    asked = queries.select(F.col(query_id).alias("i"), F.col(embedding).cast("array<double>").alias("v")).where("v is not null")
    held = vectors.select(F.col(vector_id).alias("i"), F.col(embedding).cast("array<double>").alias("v")).where("v is not null")
    n = asked.count()
    if n <= BLOCK:
        found = asked.collect()  # BLOCK rows at most
        shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in found], np.array([list(r[1]) for r in found], np.float64)))

        def run(batches):
            names, q = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                if len(batch) and names:
                    best = [merged(a, b, k) for a, b in zip(best, nearest(q, batch["i"].to_numpy(), np.array(batch["v"].tolist(), np.float64), k), strict=True)]
            yield as_rows(names, best, schema)

        out = held.mapInPandas(run, schema)
    else:
        sides = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(held.count() / VECTORS))
        number = lambda of: F.pmod(F.xxhash64("i"), F.lit(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        left = asked.withColumn("q", number(sides[0])).withColumn("p", every(sides[1]))
        right = held.withColumn("p", number(sides[1])).withColumn("q", every(sides[0]))

        def meet(a, b):
            if not len(a) or not len(b):
                return as_rows([], [], schema)
            return as_rows(a["i"].tolist(), nearest(np.array(a["v"].tolist(), np.float64), b["i"].to_numpy(), np.array(b["v"].tolist(), np.float64), k), schema)

        out = left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInPandas(meet, schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id))).where(F.col("rank") <= k)


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[float, object]]]:
    """For each query its k best of the vectors, by cosine as written (so that the order doesn't hang on the last bit)."""
    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    out = []
    for row in np.round(q @ v.T, 9):
        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        out.append(sorted(((float(row[n]), ids[n]) for n in near.tolist()), key=lambda x: (-x[0], x[1]))[:k])
    return out


def merged(a: list, b: list, k: int) -> list:
    return sorted(a + b, key=lambda x: (-x[0], x[1]))[:k]


def as_rows(names: list, best: list, schema: T.StructType):
    import pandas as pd

    return pd.DataFrame([(name, i, s) for name, found in zip(names, best, strict=True) for s, i in found], columns=schema.names)


def planes(dimensions: int, bits: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(bits, dimensions))


def top_k_approximate(queries: DataFrame, vectors: DataFrame, k: int, *, dimensions: int, bits: int = 6, probes: int = 8, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """Like :func:`top_k` by random hyperplanes: a vector lies in the cell of its signs, a query asks its own cell and the
    ``probes - 1`` cells next to it by the smallest distances to the planes.  Every vector is indexed; more probes find more.
    Cells are dealt by the cell and a salt, so one that holds many vectors is several groups."""
    kind = vectors.schema[vector_id].dataType
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vector_id, kind), T.StructField("score", T.DoubleType())])
    normals = planes(dimensions, bits)

    @F.pandas_udf("long")
    def cell(v):
        import pandas as pd

        x = np.array(v.tolist(), np.float64).reshape(-1, dimensions) @ normals.T
        return pd.Series((x > 0) @ (1 << np.arange(bits, dtype=np.int64)))

    @F.pandas_udf("array<long>")
    def probed(v):
        import pandas as pd

        out = []
        for x in np.array(v.tolist(), np.float64).reshape(-1, dimensions) @ normals.T:
            own, order = int((x > 0) @ (1 << np.arange(bits, dtype=np.int64))), np.argsort(np.abs(x))
            turns = sorted(range(min(1 << bits, max(probes, 1) * 4)), key=lambda m: sum(abs(x[order[b]]) for b in range(bits) if m >> b & 1))
            out.append([own ^ sum(1 << int(order[b]) for b in range(bits) if m >> b & 1) for m in turns[:probes]])
        return pd.Series(out)

    held = vectors.select(F.col(vector_id).alias("i"), F.col(embedding).cast("array<double>").alias("v")).where("v is not null").withColumn("cell", cell("v"))
    salts = held.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("salts"))
    right = held.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int")).select("i", "v", "cell", "salt")  # 2 ** bits rows
    left = queries.select(F.col(query_id).alias("i"), F.col(embedding).cast("array<double>").alias("v")).where("v is not null").withColumn("cell", F.explode(probed("v")))
    left = left.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("i", "v", "cell", "salt")

    def meet(a, b):
        if not len(a) or not len(b):
            return as_rows([], [], schema)
        return as_rows(a["i"].tolist(), nearest(np.array(a["v"].tolist(), np.float64), b["i"].to_numpy(), np.array(b["v"].tolist(), np.float64), k), schema)

    out = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(meet, schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id))).where(F.col("rank") <= k)


def upserted(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the changes' rows instead of those of the same key; of repeated changes the last by ``seq``."""
    if "seq" in changes.columns:
        names = [c for c in changes.columns if c not in (key, "seq")]
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*names), "seq").alias("__r")).select(key, "__r.*")
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def deleted(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")
