"""Production traces: hourly aggregates, percentiles, rates, retention, sampling, alerts and the metrics page.

Traces: id, ts, tenant, latency_ms, success, error_type and, where known, stage latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.quantiles import latency_percentiles


def hourly(traces: DataFrame, *, ts: str = "ts", value: str = "latency_ms", success: str = "success", stages: tuple[str, ...] = ()) -> DataFrame:
    """A row for each hour: counts, percentiles (the upper middle value for fewer than 4), mean, stage means."""
    rows = traces.withColumn("hour", F.date_trunc("hour", ts))
    counts = rows.groupBy("hour").agg(F.count("*").alias("total"), F.sum(F.col(success).cast("long")).alias("succeeded"), F.avg(value).alias("avg_latency_ms"), *[F.avg(s).alias(f"avg_{s}") for s in stages])
    return counts.join(latency_percentiles(rows, value, ["hour"], few_median=True).drop("n"), "hour", "left")


def success_rate(traces: DataFrame, by: list[str], success: str = "success") -> DataFrame:
    """Share of successes; 1 where there is nothing (only without groups)."""
    return traces.groupBy(*by).agg(F.coalesce(F.avg(F.col(success).cast("double")), F.lit(1.0)).alias("success_rate"), F.count("*").alias("n"))


def retained(rows: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """What a retention of ``days`` leaves; a pruned scan where the table is partitioned by date."""
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def sampled(rows: DataFrame, rate: float, *, key: str = "id", force: str | None = None) -> DataFrame:
    """A repeatable sample by a hash of the key; rows that are forced stay."""
    rate = min(max(rate, 0.0), 1.0)
    chosen = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 1_000_000 < int(rate * 1_000_000)
    return rows.where(chosen | F.col(force)) if force else rows.where(chosen)


def snapshot(traces: DataFrame, now: Column, *, ts: str = "ts", value: str = "latency_ms", success: str = "success") -> DataFrame:
    """One row: totals of all time, rate, percentiles and mean of the last 24 hours, seconds since the last trace."""
    total = traces.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col(success).cast("long")), F.lit(0)).alias("success_total"), F.max(ts).alias("last"))
    recent = traces.where(F.col(ts) >= now - F.expr("INTERVAL 24 HOURS"))
    rate = recent.agg(F.coalesce(F.avg(F.col(success).cast("double")), F.lit(1.0)).alias("success_rate_24h"), F.count("*").alias("total_24h"))
    quantiles = latency_percentiles(recent, value, []).select(F.col("p50").alias("p50_24h"), F.col("p95").alias("p95_24h"), F.col("p99").alias("p99_24h"))
    # Rows of one each.
    out = total.withColumn("__k", F.lit(1)).join(rate.withColumn("__k", F.lit(1)), "__k").join(quantiles.withColumn("__k", F.lit(1)), "__k", "left")
    return out.select("total", "success_total", "success_rate_24h", "total_24h", *[F.coalesce(q, F.lit(0.0)).alias(q) for q in ("p50_24h", "p95_24h", "p99_24h")], (F.unix_timestamp(now) - F.unix_timestamp(F.col("last").cast("timestamp"))).alias("seconds_since_last"))


#: Names and help of the metrics page.
PAGE = (("total", "traces_total", "counter", "Traces received"), ("success_total", "traces_success_total", "counter", "Traces that succeeded"), ("success_rate_24h", "success_rate", "gauge", "Share of successes in 24 hours"), ("p50_24h", "latency_p50_ms", "gauge", "Median latency"), ("p95_24h", "latency_p95_ms", "gauge", "95th percentile of latency"), ("p99_24h", "latency_p99_ms", "gauge", "99th percentile of latency"), ("seconds_since_last", "seconds_since_last_trace", "gauge", "Age of the last trace"))


def metrics_page(row, prefix: str = "tessel") -> str:
    """Exposition text of a :func:`snapshot` row."""
    lines = []
    for column, name, kind, text in PAGE:
        lines += [f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {row[column]}"]
    return "\n".join(lines) + "\n"


# --------------------------------------------------------------------------------------------------------------- alerts


def meets(condition: Column, value: Column, threshold: Column) -> Column:
    pairs = (("gt", value > threshold), ("lt", value < threshold), ("gte", value >= threshold), ("lte", value <= threshold), ("eq", value == threshold), ("neq", value != threshold))
    out = F.lit(False)
    for name, test in pairs:
        out = F.when(condition == name, test).otherwise(out)
    return out


def fired(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics (at, metric, value) that meet a rule (rule_idx, name, metric, condition, threshold, severity).  Rules are a
    short list that people write, and are broadcast."""
    joined = metrics.join(F.broadcast(rules), "metric").where(meets(F.col("condition"), F.col("value"), F.col("threshold")))
    verbs = F.create_map(*[F.lit(x) for pair in (("gt", "exceeds"), ("lt", "is below"), ("gte", "is at or above"), ("lte", "is at or below"), ("eq", "equals"), ("neq", "differs from")) for x in pair])
    message = F.format_string("%s %s %.4f (now %.4f)", "metric", verbs[F.col("condition")], F.col("threshold").cast("double"), F.col("value").cast("double"))
    return joined.withColumn("message", message)


def cooled(alerts: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Alerts that a cooldown of each rule lets through: a fold over the rule's alerts in order of time.

    Of several alerts of a rule at one time the one of least value can pass.  The fold takes distinct times alone, eight
    bytes each; a rule's times are folded in one task, since each depends on the one before."""
    first = alerts.groupBy("name", "at").agg(F.min_by(F.struct(*alerts.columns), "value").alias("r"))

    def run(group):
        import numpy as np
        import pandas as pd

        times = np.sort(group["at"].to_numpy("datetime64[us]"))
        wait, k, kept = np.timedelta64(round(minutes * 60e6), "us"), 0, []
        while k < len(times):
            kept.append(times[k])
            k = max(k + 1, int(np.searchsorted(times, times[k] + wait, "left")))
        return pd.DataFrame({"name": group["name"].iloc[0], "at": pd.Series(kept)})

    kind = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    passed = first.select("name", "at").groupBy("name").applyInPandas(run, f"name {kind['name']}, at {kind['at']}")
    return first.join(passed, ["name", "at"], "left_semi").select("r.*")


# ----------------------------------------------------------------------------------------------------------------- cost


def cost_summary(usage: DataFrame) -> DataFrame:
    """Tokens, cost and calls by provider and model, with totals (both null) by rollup."""
    rolled = usage.rollup("provider", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.grouping_id().alias("level"))
    return rolled.where("level in (0, 3)").drop("level")


# -------------------------------------------------------------------------------------------------------------- history


def rotated(history: DataFrame, most: int, *, ts: str = "ts", baseline: str = "is_baseline", key: str = "id") -> DataFrame:
    """At most ``most`` records: every baseline, and the newest of the others.

    Baselines are counted when the plan is made; the newest are found by a top-k, which never sorts the whole table."""
    fixed = history.where(F.coalesce(F.col(baseline), F.lit(False)))
    room = max(0, most - fixed.count())
    newest = history.where(~F.coalesce(F.col(baseline), F.lit(False))).orderBy(F.desc(ts), F.desc(key)).limit(room)
    return fixed.unionByName(newest)


def with_baseline(history: DataFrame, config: str, record: object, *, key: str = "id") -> DataFrame:
    """``record`` becomes the one baseline of its configuration."""
    return history.withColumn("is_baseline", F.when(F.col("config") == config, F.col(key) == record).otherwise(F.col("is_baseline")))


def without(history: DataFrame, ids: list) -> DataFrame:
    """The records but for those of the given identifiers."""
    return history.where(~F.col("id").isin(ids))


def by_config(history: DataFrame) -> DataFrame:
    return history.groupBy("config").agg(F.count("*").alias("runs"), F.max("ts").alias("latest"), F.sum(F.coalesce(F.col("is_baseline"), F.lit(False)).cast("long")).alias("baselines"))


def latest(history: DataFrame, *, config: str = "config", ts: str = "ts", key: str = "id") -> DataFrame:
    names = [c for c in history.columns if c != config]
    return history.groupBy(config).agg(F.max_by(F.struct(*names), F.struct(ts, key)).alias("r")).select(config, "r.*")
