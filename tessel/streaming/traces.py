"""Streams of traces: ingest without repeats, hourly aggregates, alerts with a cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import monitoring as M
from tessel.sources import store


def read_stream(spark: SparkSession, path: str, schema: str = store.TRACES, files_per_batch: int = 100) -> DataFrame:
    """Traces from JSON files that are dropped into a folder."""
    return store.checked_traces(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path))


def unique(traces: DataFrame, late: str = "1 hour") -> DataFrame:
    return traces.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def windowed(traces: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, success rate and mean latency of each window, given away when it is closed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return traces.withWatermark("ts", late).groupBy(window.alias("w")).agg(F.count("*").alias("total"), F.sum(F.col("success").cast("long")).alias("succeeded"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.col("w.start").alias("start"), "total", "succeeded", "avg_latency_ms")


def sessions(traces: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return traces.withWatermark("ts", late).groupBy("tenant", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("tenant", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def land(traces: DataFrame, raw: str, hourly: str, checkpoint: str, once: bool = True):
    """Each batch lands in the raw table; then the days it touches are aggregated anew, late rows and all."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            store.append_traces(rows, raw)
            days = rows.select(F.to_date("ts").alias("day")).distinct()
            whole = rows.sparkSession.read.parquet(raw).join(F.broadcast(days), "day", "left_semi")  # one row a day
            store.replace_days(M.hourly(whole).withColumn("day", F.to_date("hour")), hourly)
        finally:
            rows.unpersist()

    writer = traces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def cooled(alerts: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Alerts (name, at, value) that the cooldown of their rule lets through, in event time; the state is one time a rule."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["at", "value"], kind="stable")
        last = pd.Timestamp(state.get[0]) if state.exists else None
        keep = []
        for at in rows["at"]:
            ok = last is None or (at - last).total_seconds() >= minutes * 60
            keep.append(ok)
            last = at if ok else last
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield rows[keep]

    shape = alerts.select("name", "at", "value")
    return shape.groupBy("name").applyInPandasWithState(fold, "name string, at timestamp, value double", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def dispatch(alerts: DataFrame, senders: dict, checkpoint: str, once: bool = True):
    """Gives each batch's alerts to every sender; one that fails doesn't keep them from the others.

    ``senders`` maps a name to a function of a list of dicts; alerts are what a cooldown has let through, a few a batch."""
    faults: list[tuple[str, str]] = []

    def batch(rows: DataFrame, _: int) -> None:
        found = [r.asDict() for r in rows.toLocalIterator()]
        for name, send in senders.items():
            try:
                send(found)
            except Exception as fault:  # noqa: BLE001  senders are isolated from one another
                faults.append((name, str(fault)))

    writer = alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    return query, faults
