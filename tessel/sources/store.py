"""Tables that grow: traces by day, hourly aggregates, history of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACES = "id string, ts timestamp, tenant string, query_hash string, latency_ms double, success boolean, error_type string, metadata map<string,string>"


#: Days of a batch that are named in the scan of the table.
DAYS = 400


def checked_traces(raw: DataFrame) -> DataFrame:
    """Traces as they come, with an id, a time, and an empty map where metadata is null."""
    return raw.where(F.col("id").isNotNull() & F.col("ts").isNotNull()).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def append_traces(traces: DataFrame, path: str) -> None:
    """Appends to a table by day; ids that the touched days already hold are left out, so a retry changes nothing."""
    spark = traces.sparkSession
    fresh = checked_traces(traces).dropDuplicates(["id"]).withColumn("day", F.to_date("ts"))
    if exists(spark, path):
        days = [r["day"] for r in fresh.select("day").distinct().limit(DAYS + 1).collect()]
        held = spark.read.parquet(path).select("id", "day")
        # Only the folders of these days are read; a batch of more days than that is a backfill, held against all.
        held = held.where(F.col("day").isin(days)) if len(days) <= DAYS else held
        fresh = fresh.join(held, ["id", "day"], "left_anti")
    fresh.write.mode("append").partitionBy("day").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def replace_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Overwrites the partitions that ``rows`` touches and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_history(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, schema: str = "id string, ts timestamp, config string, testset_hash string, metrics map<string,double>, is_baseline boolean") -> DataFrame:
    """Records, the last of each id; nothing where nothing has been written."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "ts").alias("r")).select("id", "r.*")
