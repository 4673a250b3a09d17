"""Exact deduplication by a content sort, with DataFrame operations only.

The texts' bytes (a prefix, then their hash) and a salt are range-partitioned at sampled splitters, sorted externally
within each range, and each row
is held against its neighbours of equal bytes; the row with the largest (or smallest) identifier of a run stays.  The
salt is 0 but for texts that have more copies than a share of a partition: these are cut into several runs, whose heads
(at most ``16 * partitions`` rows) are compared once more and sent back by broadcast.

Nulls: a null text is empty; rows of null identifier sort below all others and stay only in groups without identifier.
Rows repeated with the same identifier belong to one group, are counted each, and all with that identifier are kept
only once (one of them).  Very long texts are compared and hashed whole.  An empty table gives an empty result.  Columns other than the two named are ignored by
:func:`content_sort`; :func:`deduplicate` carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import partitions, stored

SHARE = 8
#: Characters of a text that splitters hold.
PREFIX = 24


def content_sort(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "largest", carry: list[str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``carry`` adds columns, in a struct named row."""
    spark = docs.sparkSession
    clean = normalise or (lambda x: x)
    content = clean(F.coalesce(F.col(text_col), F.lit("")))
    sign = 1 if keep == "largest" else -1
    row: list[Column] = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content"), *row)
    parts = partitions(spark)

    # Texts with more copies than a share of a partition: counts of 64-bit hashes, added up before they are shuffled.
    counts = plain.groupBy(F.xxhash64("content").alias("hash")).agg(F.count("*").alias("n"))
    total = F.lit(docs.count())
    share = F.greatest(F.lit(64.0), F.ceil(total / (SHARE * parts)))
    # More than ``share`` rows each: fewer than SHARE * parts hashes, whatever the input.
    hot = counts.where(F.col("n") > share).select("hash", F.ceil(F.col("n") / share).cast("long").alias("runs"))
    salted = plain.join(F.broadcast(hot), F.xxhash64("content") == F.col("hash"), "left").withColumn("salt", F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.col("runs"))).otherwise(F.lit(0)))

    rank = (F.col("doc_id") * sign).desc_nulls_last()
    placed = salted.select("doc_id", "content", "salt", (F.col("runs").isNotNull()).alias("split"), *(["row"] if carry else []))
    # Splitters are sampled on a prefix of the bytes and their hash, so that what is sampled stays small.
    placed = placed.withColumns({"prefix": F.substring("content", 1, PREFIX), "hash": F.xxhash64("content")}).repartitionByRange("prefix", "hash", "salt")
    run = Window.partitionBy("prefix", "hash", "salt", "content")
    best = F.first("doc_id").over(run.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = placed.select("doc_id", *(["row"] if carry else []), "split", best.alias("head"), F.count("*").over(run).alias("n"), F.row_number().over(run.orderBy(rank)).alias("at"), F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"), F.when(F.col("split"), F.col("content")).alias("content"))
    runs = stored(ranked.select("doc_id", *(["row"] if carry else []), "split", "head", "n", "at", "text_sha256", F.when(F.col("at") == 1, F.col("content")).alias("content")), "content-sort")

    heads = runs.where("split and at = 1")
    same = Window.partitionBy("content")
    joined = heads.select("text_sha256", F.col("head").alias("run_head"), F.first("head").over(same.orderBy((F.col("head") * sign).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("whole"), F.sum("n").over(same).alias("size"))
    out = runs.join(F.broadcast(joined.withColumnRenamed("text_sha256", "sha")), F.col("split") & F.col("head").eqNullSafe(F.col("run_head")) & (F.col("text_sha256") == F.col("sha")), "left")
    keep_id = F.when(F.col("split"), F.col("whole")).otherwise(F.col("head"))
    size = F.when(F.col("split"), F.col("size")).otherwise(F.col("n"))
    return out.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), ((F.col("at") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"), "text_sha256", *(["row"] if carry else []))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = content_sort(docs, id_col=id_col, text_col=text_col, keep=keep, normalise=normalise, carry=docs.columns)
    return rows.where("kept").select("row.*")
