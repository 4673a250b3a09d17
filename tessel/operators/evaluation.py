"""Evaluation runs as tables: measures, summaries, comparison, gates, regressions, baselines and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import retrieval as R

MEASURES = ("precision", "recall", "mrr", "ndcg")
#: Good and warning limits; a hallucination is better if lower.
STATUS = {"precision": (0.8, 0.6), "recall": (0.8, 0.6), "mrr": (0.8, 0.5), "ndcg": (0.8, 0.6), "faithfulness": (0.8, 0.6), "relevance": (0.8, 0.6), "hallucination": (0.2, 0.4)}
LOWER_IS_BETTER = ("latency_ms", "avg_latency_ms", "total_latency_ms", "latency", "hallucination", "cost")
LATENCY = "total_latency_ms"


def score_runs(runs: DataFrame, k: int = 10, *, retrieved: str = "retrieved", relevant: str = "relevant") -> DataFrame:
    """Array layout: a row for each query with two arrays; measured without a shuffle."""
    return runs.withColumns(R.all_measures(F.col(retrieved), F.col(relevant), k))


def score_long(ranked: DataFrame, relevant: DataFrame, k: int = 10, *, query: str = "query_id", doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Long layout: (query, doc, rank) and (query, doc), for lists that are stored normalised; ranks count from 1."""
    wanted = relevant.select(query, doc).distinct()
    ideal = wanted.groupBy(query).agg(F.count("*").alias("__n"))
    hit = wanted.withColumn("__hit", F.lit(1))
    rows = ranked.join(hit, [query, doc], "left")
    top = F.col(rank) <= k
    gained = F.when(top & F.col("__hit").isNotNull(), 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)
    agg = rows.groupBy(query).agg(
        F.sum(F.when(top, 1).otherwise(0)).alias("__top"),
        F.sum(F.when(top & F.col("__hit").isNotNull(), 1).otherwise(0)).alias("__hits"),
        F.count_distinct(F.when(top & F.col("__hit").isNotNull(), F.col(doc))).alias("__found"),
        F.min(F.when(F.col("__hit").isNotNull(), F.col(rank))).alias("__first"),
        F.sum(gained).alias("__dcg"),
    )
    joined = agg.join(ideal, query, "left")
    n = F.least(F.coalesce("__n", F.lit(0)), F.lit(k)).cast("int")
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return joined.select(
        query,
        F.when(F.col("__top") > 0, F.col("__hits") / F.col("__top")).otherwise(0.0).alias("precision"),
        F.when(F.coalesce("__n", F.lit(0)) > 0, F.col("__found") / F.col("__n")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("__first"), F.lit(0.0)).alias("mrr"),
        F.when(n > 0, F.col("__dcg") / best).otherwise(0.0).alias("ndcg"),
    )


def summarise(scored: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES, error: str | None = None) -> DataFrame:
    """Queries without error and their mean measures for each group."""
    rows = scored.where(F.col(error).isNull()) if error else scored
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in measures])


def ranges(scored: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """A row for each group and measure: mean, least, most and status of the mean."""
    long = melted(scored, by, measures)
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("average"), F.min("value").alias("least"), F.max("value").alias("most")).withColumn("status", status(F.col("metric"), F.col("average")))


def melted(df: DataFrame, by: list[str], measures: tuple[str, ...], name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*by, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in measures]), F.array(*[F.col(m).cast("double") for m in measures]))).alias(name, value))


def status(metric: Column, value: Column) -> Column:
    """pass, warn or fail by the limits of STATUS (0.8 and 0.6 for others)."""
    good, warn = F.lit(0.8), F.lit(0.6)
    for name, (a, b) in STATUS.items():
        good, warn = F.when(metric == name, a).otherwise(good), F.when(metric == name, b).otherwise(warn)
    inverted = metric == "hallucination"
    return F.when(inverted, F.when(value <= good, "pass").when(value <= warn, "warn").otherwise("fail")).otherwise(F.when(value >= good, "pass").when(value >= warn, "warn").otherwise("fail"))


def worst(statuses: DataFrame, by: list[str], column: str = "status") -> DataFrame:
    order = F.when(F.col(column) == "fail", 2).when(F.col(column) == "warn", 1).otherwise(0)
    return statuses.groupBy(*by).agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), (F.max(order) + 1).cast("int")).alias("overall"))


# --------------------------------------------------------------------------------------------------------- comparison


def _better(metric: Column, value: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), -value).otherwise(value)


def rankings(summaries: DataFrame, *, config: str = "config", order: str = "config_idx", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Rank of each configuration by each measure; ties by the order in which they were given."""
    long = melted(summaries, [config, order], measures)
    key = Window.partitionBy("metric").orderBy(_better(F.col("metric"), F.col("value")).desc(), order)
    return long.withColumn("rank", F.row_number().over(key))


def winners(summaries: DataFrame, *, config: str = "config", order: str = "config_idx", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """The first configuration of the best value of each measure; a missing value counts as 0."""
    filled = summaries.select(config, order, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measures])
    long = melted(filled, [config, order], measures)
    best = F.max_by(F.struct(F.col(config), F.col("value")), F.struct(_better(F.col("metric"), F.col("value")), -F.col(order)))
    return long.groupBy("metric").agg(best.alias("b")).select("metric", F.col(f"b.{config}").alias("winner"), F.col("b.value").alias("value"))


def pairwise(summaries: DataFrame, *, config: str = "config", order: str = "config_idx", measures: tuple[str, ...] = (*MEASURES, LATENCY)) -> DataFrame:
    """Every two configurations by each measure: the first less the second, that in per cent of the second, and the winner or
    tie.  Against a second of 0 the change is 100 or -100 per cent, of a latency 0.

    Configurations are a handful of rows; the pairs are of these, joined by the measure's name."""
    long = melted(summaries, [config, order], measures)
    a, b = long.alias("a"), long.alias("b")
    joined = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    diff = F.col("a.value") - F.col("b.value")
    void = F.when(F.col("a.metric") == LATENCY, 0.0).when(diff > 0, 100.0).when(diff < 0, -100.0).otherwise(0.0)
    change = F.when(F.col("b.value") != 0, diff / F.col("b.value") * 100).otherwise(void)
    good = _better(F.col("a.metric"), diff)
    winner = F.when(good > 0, F.col(f"a.{config}")).when(good < 0, F.col(f"b.{config}")).otherwise("tie")
    return joined.select(F.col("a.metric").alias("metric"), F.col(f"a.{config}").alias("config_a"), F.col(f"b.{config}").alias("config_b"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"), diff.alias("difference"), change.alias("percent_change"), winner.alias("winner"))


# ----------------------------------------------------------------------------------------- gates, regressions, baselines


def gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A row for each run: status and exit code.  ``thresholds`` (metric, threshold, stable; a short list) is broadcast;
    stable measures below it fail, unstable ones warn; a hallucination must stay below; absent measures are skipped."""
    joined = values.join(F.broadcast(thresholds), "metric")
    missed = F.when(F.col("metric") == "hallucination", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    level = F.when(missed & F.col("stable"), 2).when(missed, 1).otherwise(0)
    out = joined.withColumn("__l", level).groupBy("run").agg(F.max("__l").alias("l"), F.sum(F.when(F.col("__l") > 0, 1).otherwise(0)).alias("n_missed"))
    return out.select("run", F.when(F.col("l") == 2, "FAIL").when(F.col("l") == 1, "WARN").otherwise("PASS").alias("status"), F.when(F.col("l") == 2, 1).when(F.col("l") == 1, 2).otherwise(0).alias("exit_code"), F.col("n_missed").cast("long").alias("n_missed"))


def regressions(before: DataFrame, now: DataFrame, by: list[str], *, quality: float = 0.05, latency: float = 0.20, critical: float = 2.0, queries: str | None = None) -> DataFrame:
    """Measures (by, metric, value) that got worse by more than their threshold, in per cent of before; more than ``critical``
    times as much is critical.  A baseline of 0 is skipped; a measure that is missing now counts as 0.  With ``queries``
    (a column of both sides) runs of different numbers of queries are an error."""
    if queries:
        kept = [*by, "metric", "value", queries]
        now = now.select(*kept).join(before.groupBy(*by).agg(F.max(queries).alias("__q")), by, "left")
        alike = F.when(F.col(queries) != F.col("__q"), F.raise_error(F.concat(F.lit("the baseline has "), F.col("__q").cast("string"), F.lit(" queries, now there are "), F.col(queries).cast("string"))).cast("boolean")).otherwise(True)
        now = now.where(alike)
    a = before.select(*by, "metric", F.col("value").alias("baseline"))
    b = now.select(*by, "metric", F.col("value").alias("current"))
    joined = a.join(b, [*by, "metric"], "left").withColumn("current", F.coalesce("current", F.lit(0.0))).where("baseline <> 0")
    change = (F.col("current") - F.col("baseline")) / F.col("baseline") * 100
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    limit = F.when(F.col("metric").contains("latency"), latency * 100).otherwise(quality * 100)
    worse = F.when(lower, change).otherwise(-change)
    return joined.withColumn("change_percent", change).withColumn("severity", F.when(worse > limit * critical, "critical").when(worse > limit, "warning")).where(F.col("severity").isNotNull())


def mean_latency(results: DataFrame, by: list[str], *, latency: str = "latency_ms") -> DataFrame:
    """Mean and total latency of each run's queries, as the measures latency_ms and total_latency_ms."""
    found = results.groupBy(*by).agg(F.avg(F.col(latency).cast("double")).alias("latency_ms"), F.sum(F.col(latency).cast("double")).alias(LATENCY))
    return melted(found, by, ("latency_ms", LATENCY))


def baseline_of(history: DataFrame, config: str, testset_hash: str | None = None) -> DataFrame:
    """The baseline record of a configuration; one of another test set is an error."""
    found = history.where((F.col("config") == config) & F.coalesce(F.col("is_baseline"), F.lit(False)))
    if testset_hash is None:
        return found
    other = F.raise_error(F.concat(F.lit("the baseline is of another test set: "), F.col("testset_hash"))).cast("boolean")
    return found.where(F.when(F.col("testset_hash") != testset_hash, other).otherwise(True))


def against_baseline(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Values (run, metric, value) against a reference list (metric, reference), which is broadcast; measures that the list
    lacks are skipped."""
    joined = values.join(F.broadcast(reference), "metric")
    ref, value = F.col("reference"), F.col("value")
    difference = value - ref
    change = F.when(ref != 0, difference / ref * 100).otherwise(F.when(difference > 0, 100.0).when(difference < 0, -100.0).otherwise(0.0))
    return joined.withColumn("change_pct", change).withColumn("better", F.when(F.col("metric").isin(*LOWER_IS_BETTER), difference < 0).otherwise(difference > 0))


def baseline_verdict(compared: DataFrame) -> DataFrame:
    """Score -1..1 of each run, changes weighted by their size in per cent, and what it says."""
    size = F.abs("change_pct")
    total = F.sum(size)
    score = F.when(total > 0, F.sum(F.when(F.col("better"), size).otherwise(-size)) / total).otherwise(0.0)
    out = compared.groupBy("run").agg(score.alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") > 0.2, "better").when(F.col("score") < -0.2, "below").otherwise("comparable"))


# --------------------------------------------------------------------------------------------------------- differences


def evaluation_diff(before: DataFrame, after: DataFrame, *, threshold: float = 0.01, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Each query of ``after`` (idx, text, measures) against ``before``: by text (the first of a repeated one), else by
    position; missing measures count as 0; improved or degraded by the mean change, strictly beyond the threshold."""
    old = before.groupBy("text").agg(F.min_by(F.struct(*measures), "idx").alias("__t"))
    by_place = before.select("idx", F.struct(*measures).alias("__i"))
    joined = after.join(old, "text", "left").join(by_place, "idx", "left").withColumn("__o", F.coalesce("__t", "__i"))
    deltas = {m: F.coalesce(F.col(m), F.lit(0.0)) - F.coalesce(F.col(f"__o.{m}"), F.lit(0.0)) for m in measures}
    mean = sum(deltas.values()) / len(measures)
    biggest = F.array_max(F.array(*[F.struct(F.abs(d).alias("size"), F.lit(-i).alias("o"), F.lit(m).alias("metric")) for i, (m, d) in enumerate(deltas.items())]))["metric"]
    kind = F.when(F.col("mean_delta") > threshold, "improved").when(F.col("mean_delta") < -threshold, "degraded").otherwise("unchanged")
    return joined.select("idx", "text", *[d.alias(f"d_{m}") for m, d in deltas.items()], mean.alias("mean_delta"), biggest.alias("biggest")).withColumn("change", kind)


def diff_rates(diff: DataFrame) -> DataFrame:
    """One row: queries, shares that improved and degraded (0 for none)."""
    share = lambda kind: F.coalesce(F.avg((F.col("change") == kind).cast("double")), F.lit(0.0))
    return diff.agg(F.count("*").alias("n"), share("improved").alias("improvement_rate"), share("degraded").alias("degradation_rate"))


def dataset_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, modified, unchanged) and the fields that changed; a repeated key is an error.  Lists are
    compared without regard to their order; metadata counts only if it is among the fields."""
    ordered = {f.name: F.array_sort(f.name) for f in old.schema.fields if f.name in fields and f.dataType.typeName() == "array"}
    old, new = old.withColumns(ordered), new.withColumns(ordered)
    a = old.groupBy(key).agg(F.first(F.struct(*fields)).alias("__a"), F.count("*").alias("__ca"))
    b = new.groupBy(key).agg(F.first(F.struct(*fields)).alias("__b"), F.count("*").alias("__cb"))
    joined = a.join(b, key, "full_outer")
    unique = F.when((F.coalesce("__ca", F.lit(1)) > 1) | (F.coalesce("__cb", F.lit(1)) > 1), F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    changed = F.filter(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return joined.where(unique).select(key, kind.alias("change"), F.when(kind == "modified", F.array_join(changed, ",")).alias("fields"))


def content_key(text: Column, documents: Column, answer: Column) -> Column:
    """Key of a question without identifier: hash of its text, its documents in order of name, and its answer."""
    return F.sha2(F.concat_ws("\u0001", text, F.array_join(F.array_sort(documents), "\u0002"), answer), 256)


# --------------------------------------------------------------------------------------------------------------- claims


def faithfulness(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """id, score: supported share of the claims; 1 for an empty response or no claims, 0 for an empty context."""
    share = claims.groupBy("id").agg(F.avg(F.col("supported").cast("double")).alias("__s"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return responses.join(share, "id", "left").select("id", F.when(blank("response"), 1.0).when(blank("context"), 0.0).otherwise(F.coalesce("__s", F.lit(1.0))).alias("score"))


def hallucination(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """id, score: share of claims without ground; 0 for an empty response or no claims, 1 for an empty context."""
    share = claims.groupBy("id").agg(F.avg(1.0 - F.col("supported").cast("double")).alias("__s"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return responses.join(share, "id", "left").select("id", F.when(blank("response"), 0.0).when(blank("context"), 1.0).otherwise(F.coalesce("__s", F.lit(0.0))).alias("score"))


def judge_overall(criteria: DataFrame) -> DataFrame:
    """id, mean score and the worst verdict (FAIL over PARTIAL over PASS) of its criteria."""
    order = F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "PARTIAL", 1).otherwise(0)
    return criteria.groupBy("id").agg(F.avg("score").alias("overall_score"), F.element_at(F.array(F.lit("PASS"), F.lit("PARTIAL"), F.lit("FAIL")), (F.max(order) + 1).cast("int")).alias("overall_verdict"))
