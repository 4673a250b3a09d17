"""Queries over the driver's tables, and their SQL.

A ranked run is read from orders: an order is a query, its parts in order of their first line are what was retrieved,
those with a returned line are relevant.  Events are traces and agent steps, conversations are calls of a model.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import quantiles, text as X
from tessel.operators import agents, datasets, evaluation as E, judging as J, monitoring as M, running, vectors

K = 5
#: Orders before this year are the earlier half.
HALF = 1998


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# ------------------------------------------------------------------------------------------------------------ the run


def run_of(lines: DataFrame) -> DataFrame:
    """l_orderkey, retrieved and relevant.  Lines are dealt by order once; both aggregates use that."""
    one = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("rel"))
    listed = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "l_partkey", "rel"))).alias("r"))
    return listed.select("l_orderkey", F.transform("r", lambda x: x["l_partkey"]).alias("retrieved"), F.transform(F.filter("r", lambda x: x["rel"] == 1), lambda x: x["l_partkey"]).alias("relevant"))


def scored_run(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return E.score_runs(run_of(read(spark, sf_dir, "lineitem")), k)


RUN = """
    one AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel
            FROM lineitem GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey) AS rk,
                      sum(rel) OVER (PARTITION BY l_orderkey) AS nrel FROM one),
    scored AS (SELECT l_orderkey,
                  sum(CASE WHEN rk <= {k} THEN rel ELSE 0 END) / CAST(sum(CASE WHEN rk <= {k} THEN 1 ELSE 0 END) AS DOUBLE) AS precision,
                  CASE WHEN max(nrel) > 0 THEN sum(CASE WHEN rk <= {k} THEN rel ELSE 0 END) / CAST(max(nrel) AS DOUBLE) ELSE 0.0 END AS recall,
                  coalesce(1.0 / CAST(min(CASE WHEN rel = 1 THEN rk END) AS DOUBLE), 0.0) AS mrr,
                  CASE WHEN max(nrel) > 0 THEN sum(CASE WHEN rk <= {k} AND rel = 1 THEN 1.0 / log2(CAST(rk + 1 AS DOUBLE)) ELSE 0.0 END)
                       / sum(CASE WHEN rk <= least(nrel, {k}) THEN 1.0 / log2(CAST(rk + 1 AS DOUBLE)) ELSE 0.0 END) ELSE 0.0 END AS ndcg
               FROM ranked GROUP BY 1)
"""
RUN5 = RUN.format(k=K)
MEANS = ", ".join(f"avg({m}) AS {m}" for m in E.MEASURES)


def _one(measure: str):
    return lambda spark, d: rounded(scored_run(spark, d).select("l_orderkey", measure))


def retrieval_all(spark, d):
    return rounded(scored_run(spark, d).select("l_orderkey", *E.MEASURES))


def retrieval_long(spark, d):
    one = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("rel"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("line", "l_partkey")))
    relevant = one.where("rel = 1")
    return rounded(E.score_long(ranked, relevant, K, query="l_orderkey", doc="l_partkey"))


def with_priority(spark, d, k: int = K) -> DataFrame:
    return scored_run(spark, d, k).join(read(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_orderpriority").alias("o_orderpriority"), F.min("o_orderstatus").alias("o_orderstatus"), F.min("o_orderdate").alias("o_orderdate")), F.col("l_orderkey") == F.col("o_orderkey"))


PRIORITY = "o AS (SELECT o_orderkey, min(o_orderpriority) AS o_orderpriority, min(o_orderstatus) AS o_orderstatus, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1)"


def eval_summary(spark, d):
    return rounded(E.summarise(with_priority(spark, d), ["o_orderpriority"]))


def eval_summary_ranges(spark, d):
    return rounded(E.ranges(with_priority(spark, d), ["o_orderpriority"]))


def eval_overall_status(spark, d):
    return E.worst(E.ranges(with_priority(spark, d), ["o_orderpriority"]), ["o_orderpriority"])


STATUS_SQL = "CASE WHEN average >= 0.8 THEN 'pass' WHEN average >= CASE WHEN metric = 'mrr' THEN 0.5 ELSE 0.6 END THEN 'warn' ELSE 'fail' END"
LONG = " UNION ALL ".join(f"SELECT {{by}}, '{m}' AS metric, {m} AS value FROM {{of}}" for m in E.MEASURES)


def configs(spark, d) -> DataFrame:
    """Configurations: the status of orders."""
    rows = with_priority(spark, d).withColumn("latency_ms", F.size("retrieved").cast("double"))
    means = E.summarise(rows, ["o_orderstatus"])
    total = E.mean_latency(rows, ["o_orderstatus"]).where(F.col("metric") == E.LATENCY).select("o_orderstatus", F.col("value").alias(E.LATENCY))
    return means.join(total, "o_orderstatus").select(F.col("o_orderstatus").alias("config"), F.ascii("o_orderstatus").alias("config_idx"), *E.MEASURES, E.LATENCY)


CONFIGS = f"{RUN5}, {PRIORITY}, parts AS (SELECT l_orderkey, count(*) AS parts FROM one GROUP BY 1), c AS (SELECT o_orderstatus AS config, ascii(o_orderstatus) AS config_idx, {MEANS}, CAST(sum(parts) AS DOUBLE) AS total_latency_ms FROM scored JOIN o ON l_orderkey = o_orderkey JOIN parts USING (l_orderkey) GROUP BY 1, 2), long AS ({LONG.format(by='config, config_idx', of='c')} UNION ALL SELECT config, config_idx, 'total_latency_ms' AS metric, total_latency_ms AS value FROM c)"


def config_rankings(spark, d):
    return rounded(E.rankings(configs(spark, d), measures=(*E.MEASURES, E.LATENCY)))


def config_winner(spark, d):
    return rounded(E.winners(configs(spark, d), measures=(*E.MEASURES, E.LATENCY)))


def config_pairwise(spark, d):
    return rounded(E.pairwise(configs(spark, d)))


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = with_priority(spark, d).withColumn("early", F.year("o_orderdate") < HALF)
    means = E.summarise(rows, ["o_orderpriority", "early"])
    long = E.melted(means, ["o_orderpriority", "early"], E.MEASURES)
    return long.where("early").drop("early"), long.where("not early").drop("early")


HALVES = f"{RUN5}, {PRIORITY}, h AS (SELECT o_orderpriority, year(o_orderdate) < {HALF} AS early, {MEANS} FROM scored JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2), long AS ({LONG.format(by='o_orderpriority, early', of='h')})"


def regression_alerts(spark, d):
    before, now = halves(spark, d)
    return rounded(E.regressions(before, now, ["o_orderpriority"], quality=0.0005))


THRESHOLDS = (("precision", 0.25, True), ("recall", 0.9, False), ("mrr", 0.3, True), ("ndcg", 0.95, False))


def gating_status(spark, d):
    _, now = halves(spark, d)
    limits = spark.createDataFrame(list(THRESHOLDS), "metric string, threshold double, stable boolean")
    return E.gate(now.withColumnRenamed("o_orderpriority", "run"), limits)


REFERENCE = (("precision", 0.25), ("recall", 0.9), ("mrr", 0.4), ("ndcg", 0.4))


def _compared(spark, d):
    _, now = halves(spark, d)
    return E.against_baseline(now.withColumnRenamed("o_orderpriority", "run"), spark.createDataFrame(list(REFERENCE), "metric string, reference double"))


def baseline_compare(spark, d):
    return rounded(_compared(spark, d).select("run", "metric", "value", "reference", "change_pct", "better"))


def baseline_verdict(spark, d):
    return rounded(E.baseline_verdict(_compared(spark, d)))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x).upper() for x in r) + ")" for r in rows) + ")"


NOW = f"{HALVES}, now AS (SELECT o_orderpriority AS run, metric, value FROM long WHERE NOT early)"
BASE = f"{NOW}, b AS (SELECT run, n.metric, value, reference, CASE WHEN reference <> 0 THEN (value - reference) / reference * 100 WHEN value > 0 THEN 100.0 WHEN value < 0 THEN -100.0 ELSE 0.0 END AS change_pct FROM now n JOIN (VALUES ('precision', 0.25::DOUBLE), ('recall', 0.9::DOUBLE), ('mrr', 0.4::DOUBLE), ('ndcg', 0.4::DOUBLE)) r(metric, reference) ON n.metric = r.metric)"


def _two_runs(spark, d):
    """The same parts in order of lines, and by part: before and after."""
    lines = read(spark, d, "lineitem")
    before = scored_run(spark, d)
    after = E.score_runs(run_of(lines).withColumn("retrieved", F.array_sort("retrieved")), K)
    shape = lambda df: df.select(F.col("l_orderkey").alias("idx"), F.col("l_orderkey").cast("string").alias("text"), *E.MEASURES)
    return shape(before), shape(after)


def query_diff(spark, d):
    before, after = _two_runs(spark, d)
    return rounded(E.evaluation_diff(before, after).drop("text", "biggest"))


def diff_summary(spark, d):
    before, after = _two_runs(spark, d)
    return rounded(E.diff_rates(E.evaluation_diff(before, after)))


AFTER = RUN5.replace("one AS", "one2 AS").replace("FROM one)", "FROM one2)").replace("ranked AS", "ranked2 AS").replace("FROM ranked GROUP", "FROM ranked2 GROUP").replace("scored AS", "scored2 AS").replace("ORDER BY line, l_partkey", "ORDER BY l_partkey")
DIFF = f"{RUN5}, {AFTER}, q AS (SELECT b.l_orderkey AS idx, " + ", ".join(f"b.{m} - a.{m} AS d_{m}" for m in E.MEASURES) + " FROM scored2 b JOIN scored a ON a.l_orderkey = b.l_orderkey), m AS (SELECT *, (d_precision + d_recall + d_mrr + d_ndcg) / 4 AS mean_delta FROM q), k AS (SELECT *, CASE WHEN mean_delta > 0.01 THEN 'improved' WHEN mean_delta < -0.01 THEN 'degraded' ELSE 'unchanged' END AS change FROM m)"


# ------------------------------------------------------------------------------------------------------------ datasets


def dataset_diff(spark, d):
    """Two versions of the documents: the first lacks one source, the second one language; long texts were changed."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    long = F.char_length("text") > 2500
    old = docs.where("source <> 'src1'")
    new = docs.where("lang <> 'es'").withColumns({"text": F.when(long, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "lang": F.when(long & (F.col("lang") == "fr"), F.lit("xx")).otherwise(F.col("lang"))})
    return E.dataset_diff(old, new, "doc_id", ["text", "lang", "source"])


def dataset_keys(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", E.content_key(F.col("text"), F.array("source", "lang"), F.col("lang")).alias("content_key"), X.sha256_short(F.col("text")).alias("short_hash"), X.combined_fingerprint(F.col("text"), F.col("lang"), F.col("source")).alias("fingerprint"))


def _golden(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("source").alias("answer"), F.array("lang", "source").alias("tags"), F.array("source").alias("source_docs"), F.when(F.col("n_chars") > 2000, "hard").otherwise("easy").alias("difficulty"), F.lit(None).cast("string").alias("priority"), F.when(F.col("lang") != "en", "x").alias("validated_by"))


def golden_filter(spark, d):
    return datasets.golden_filter(_golden(spark, d), tags=["de", "src3"], difficulty="hard", validated=True).select("id", "question")


def golden_tags(spark, d):
    return datasets.distinct_tags(_golden(spark, d))


def golden_testset(spark, d):
    return datasets.as_testset(_golden(spark, d)).select("text", F.array_join("ground_truth_docs", ";").alias("docs"), "expected_answer", F.col("metadata")["difficulty"].alias("difficulty"))


def golden_diff(spark, d):
    golden = _golden(spark, d).select("id", "question", "answer", "tags")
    old = golden.where("not array_contains(tags, 'src2')").select("id", "question", "answer")
    new = golden.where("not array_contains(tags, 'de')").select("id", "question", F.when(F.array_contains("tags", "fr"), "new").otherwise(F.col("answer")).alias("answer"))
    return E.dataset_diff(old, new, "id", ["question", "answer"])


def doc_min_length(spark, d):
    return datasets.long_documents(read(spark, d, "documents"), 1000).select("doc_id", F.char_length("text").alias("length"))


def doc_pairs_budget(spark, d):
    return datasets.document_pairs(read(spark, d, "documents"))


# ------------------------------------------------------------------------------------------------------------- vectors


def _vectors(spark, d):
    return read(spark, d, "embeddings")


def vector_topk_cosine(spark, d):
    v = _vectors(spark, d)
    key = v.columns[0]
    q = v.where(F.col(key) % 50 == 0).select(F.col(key).alias("query_id"), "embedding")
    return vectors.top_k(q, v, 5, vector_id=key).select("query_id", F.col(key).alias("id"), F.round("score", 5).alias("score"))


# -------------------------------------------------------------------------------------------------------------- traces


def traces(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("tenant"), F.col("value").cast("double").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("kind"))


TRACES = "t AS (SELECT event_id AS id, ts, user_id AS tenant, CAST(value AS DOUBLE) AS latency_ms, event_type <> 'error' AS success FROM events)"


def _quantile_sql(by: str, few: str) -> str:
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""

    def q(i: int) -> str:
        j = f"CAST(least(greatest(floor({i} * (n + 1) / 100.0), 1), n - 1) AS BIGINT)"
        return f"sum(CASE WHEN nth = {j} THEN v * (100 - ({i} * (n + 1) - 100 * {j})) WHEN nth = {j} + 1 THEN v * ({i} * (n + 1) - 100 * {j}) END) / 100"

    return f"""r AS (SELECT {cols}latency_ms AS v, row_number() OVER ({part} ORDER BY latency_ms) AS nth, count(*) OVER ({part}) AS n FROM t WHERE latency_ms IS NOT NULL),
        p AS (SELECT {cols}n, CASE WHEN n < 4 THEN {few} ELSE {q(50)} END AS p50, CASE WHEN n < 20 THEN max(v) ELSE {q(95)} END AS p95, CASE WHEN n < 100 THEN max(v) ELSE {q(99)} END AS p99 FROM r GROUP BY {cols}n)"""


def trace_percentiles_exclusive(spark, d):
    return rounded(quantiles.latency_percentiles(traces(spark, d), "latency_ms", ["tenant"]), 4)


def trace_hourly(spark, d):
    return rounded(M.hourly(traces(spark, d)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "total", "succeeded", "avg_latency_ms", "p50", "p95", "p99"), 4)


def trace_success_rate(spark, d):
    return rounded(M.success_rate(traces(spark, d), ["tenant"]))


NOW_TS = "2024-01-31 00:00:00"


def trace_retention(spark, d):
    return M.retained(traces(spark, d), F.lit(NOW_TS).cast("timestamp"), 7).select("id", "tenant")


def trace_sampled(spark, d):
    return M.sampled(traces(spark, d).withColumn("forced", ~F.col("success")), 0.1, force="forced").groupBy("tenant").agg(F.count("*").alias("n"))


def trace_prometheus(spark, d):
    return rounded(M.snapshot(traces(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp")).drop("seconds_since_last"), 4)


RULES = ((0, "errors", "error_rate", "gte", 0.3, "critical"), (1, "slow", "latency", "gt", 60.0, "warning"), (2, "quiet", "total", "lt", 5.0, "info"))


def hourly_metrics(spark, d) -> DataFrame:
    t = traces(spark, d).withColumn("at", F.date_trunc("hour", "ts"))
    agg = t.groupBy("at").agg((1 - F.avg(F.col("success").cast("double"))).alias("error_rate"), F.avg("latency_ms").alias("latency"), F.count("*").cast("double").alias("total"))
    return E.melted(agg, ["at"], ("error_rate", "latency", "total"))


def alerts(spark, d) -> DataFrame:
    return M.fired(hourly_metrics(spark, d), spark.createDataFrame(list(RULES), "rule_idx int, name string, metric string, condition string, threshold double, severity string"))


def alerts_fired(spark, d):
    return alerts(spark, d).select(F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "name", "severity", F.round("value", 6).alias("value"))


def alerts_cooldown(spark, d):
    return M.cooled(alerts(spark, d).select("at", "name", "metric", "severity", F.col("value"), "message"), 180).select(F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "name", "severity", F.round("value", 6).alias("value"))


def _history(spark, d):
    o = read(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_orderdate").alias("ts"), F.min("o_orderpriority").alias("config"))
    return o.select(F.col("o_orderkey").alias("id"), "ts", "config", (F.col("o_orderkey") % 500 == 0).alias("is_baseline"))


HISTORY = "h AS (SELECT o_orderkey AS id, min(o_orderdate) AS ts, min(o_orderpriority) AS config, o_orderkey % 500 = 0 AS is_baseline FROM orders GROUP BY o_orderkey)"


def history_rotation(spark, d):
    return M.rotated(_history(spark, d), 400).select("id", "config", "is_baseline")


def history_by_config(spark, d):
    h = M.by_config(_history(spark, d))
    return h.select("config", "runs", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "baselines")


def history_latest(spark, d):
    return M.latest(_history(spark, d)).select("config", "id", "is_baseline")


# -------------------------------------------------------------------------------------------------------------- agents


def steps(spark, d) -> DataFrame:
    """Events as steps: traces are users; purchases, clicks, ... are tools, views are thoughts, errors failed calls."""
    e = read(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("trace"), idx.alias("idx"), F.when(F.col("event_type") == "view", "thought").otherwise("action").alias("step_type"), F.col("event_type").alias("tool"), F.lit("").alias("args"), F.when(F.col("value") > 90, "failed").alias("error"), F.col("event_type").alias("content"), "value")


STEPS = "s AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CASE WHEN event_type = 'view' THEN 'thought' ELSE 'action' END AS step_type, event_type AS tool, CASE WHEN value > 90 THEN 'failed' END AS error, value FROM events)"


def _expected(spark, d):
    """What was expected of a trace: its cheaper steps, and clicks in place of views."""
    return steps(spark, d).where("value <= 60").select("trace", F.when(F.col("tool") == "view", "click").otherwise(F.col("tool")).alias("tool"), "idx")


def _calls(spark, d):
    return steps(spark, d).where("step_type = 'action'").select("trace", "tool", "idx")


def tool_use_metrics(spark, d):
    return rounded(agents.tool_metrics(_calls(spark, d), _expected(spark, d)))


def tool_bag_match(spark, d):
    return agents.bag_match(_calls(spark, d), _expected(spark, d)).select("trace", "idx", "tool", "expected_idx", "matched")


def tool_success(spark, d):
    return rounded(agents.success_rates(steps(spark, d)))


def agent_loops(spark, d):
    return agents.loops(steps(spark, d)).select("trace", "idx", "tool")


def agent_dead_ends(spark, d):
    return agents.dead_ends(steps(spark, d)).select("trace", "idx", "tool")


def agent_failures(spark, d):
    return agents.failures(steps(spark, d)).select("trace", "idx", "kind", "severity")


def trajectory_summary(spark, d):
    return agents.summary(steps(spark, d))


def tool_counts(spark, d):
    return agents.counts_by(steps(spark, d), "tool")


def agent_efficiency(spark, d):
    s = steps(spark, d)
    n = agents.summary(s)
    looped = agents.loops(s).groupBy("trace").agg(F.count("*").alias("looped"))
    return rounded(n.join(looped, "trace", "left").select("trace", agents.efficiency(F.lit(50.0), F.col("n_steps"), F.lit(0), F.coalesce("looped", F.lit(0))).alias("efficiency")))


def step_transitions(spark, d):
    return agents.transitions(steps(spark, d))


def goal_progress(spark, d):
    return rounded(agents.goal_progress(read(spark, d, "events").select(F.col("user_id").alias("trace"), F.struct("ts", "event_id").alias("idx"), F.col("value").cast("double").alias("progress"))))


# ---------------------------------------------------------------------------------------------------------------- text


def _judged(spark, d):
    """Answers of a judge that quote the text, some without a verdict or an explanation."""
    c = read(spark, d, "conversations")
    n = F.char_length("text") % 7
    said = F.concat(F.lit("\nExplanation: "), "text", F.lit(" ### end"))
    return c.select("conv_id", "turn", F.concat(F.lit("Score: "), n.cast("string"), F.when(n == 3, " Verdict: partial").otherwise(F.lit("")), F.when(n == 5, F.lit("")).otherwise(said)).alias("answer"))


def judge_parse(spark, d):
    return _judged(spark, d).select("conv_id", "turn", X.judge_parse(F.col("answer")).alias("j")).select("conv_id", "turn", "j.*")


def judge_overall(spark, d):
    parsed = judge_parse(spark, d).select(F.col("conv_id").alias("id"), "score", "verdict")
    return rounded(E.judge_overall(parsed))


def _claims(spark, d):
    c = read(spark, d, "conversations")
    claims = c.select(F.col("conv_id").alias("id"), (F.char_length("text") % 2 == 0).alias("supported"), F.col("turn")).where("turn > 0")
    responses = c.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("response"), F.max(F.when(F.col("conv_id") % 9 != 0, F.col("role"))).alias("context"))
    return claims, responses


def faithfulness(spark, d):
    return rounded(E.faithfulness(*_claims(spark, d)))


def hallucination(spark, d):
    return rounded(E.hallucination(*_claims(spark, d)))


CLAIMS = "c AS (SELECT conv_id AS id, avg({share}) AS s FROM (SELECT conv_id, CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END AS ok FROM conversations WHERE turn > 0) GROUP BY 1), r AS (SELECT conv_id AS id, max(CASE WHEN turn = 0 THEN text END) AS response, max(CASE WHEN conv_id % 9 <> 0 THEN role END) AS context FROM conversations GROUP BY 1)"


def question_types(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", X.question_type(F.concat(F.when(F.col("turn") % 3 == 0, "What is ").when(F.col("turn") % 3 == 1, "Why ").otherwise("Compare "), F.col("text"))).alias("question_type"))


QUESTION_SQL = """
    CASE WHEN contains(q, 'and also') OR contains(q, 'in addition') OR contains(q, 'furthermore') OR contains(q, 'both') THEN 'multi_hop'
         WHEN contains(q, 'how') OR contains(q, 'why') OR contains(q, 'explain') THEN 'explanatory'
         WHEN contains(q, 'difference') OR contains(q, 'compare') OR contains(q, 'versus') OR contains(q, 'vs') THEN 'comparative'
         WHEN contains(q, 'what is') OR contains(q, 'define') OR contains(q, 'meaning of') THEN 'definitional'
         ELSE 'factual' END
"""


def json_extract(spark, d):
    c = read(spark, d, "conversations")
    noisy = F.concat(F.lit("Sure: "), F.to_json(F.struct("turn", "role", "text")), F.lit(" done"))
    v = X.json_object(noisy)
    return c.select("conv_id", "turn", F.try_variant_get(v, "$.role", "string").alias("role"), F.try_variant_get(v, "$.text", "string").alias("text"), F.try_variant_get(v, "$.turn", "long").alias("parsed_turn"))


def pii_sanitize(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word"))
    hit = w.where(X.looks_like_pii(F.col("word")))
    return hit.select("doc_id", "word", X.sanitized(F.col("word"), "hash").alias("hashed"), X.sanitized(F.col("word"), "redact").alias("redacted")).distinct()


def _usage(spark, d):
    """Calls of models of the price list (one in capitals), of one that it lacks and of a local provider, and a price of our own."""
    c = read(spark, d, "conversations")
    tokens = X.estimated_tokens(F.col("text"))
    model = F.when(F.col("role") == "user", "GPT-4o").when(F.col("role") == "assistant", "mistral-large-latest").otherwise("unlisted-model")
    usage = c.select("conv_id", "turn", F.when(F.col("turn") == 0, "ollama").otherwise("hosted").alias("provider"), F.when(F.col("turn") == 3, "own-model").otherwise(model).alias("model"), tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"))
    return X.priced(usage, spark.createDataFrame([("own-model", 4.0, 8.0)], "model string, input_per_m double, output_per_m double"))


def token_cost(spark, d):
    return rounded(_usage(spark, d), 9)


def cost_rollup(spark, d):
    return rounded(M.cost_summary(_usage(spark, d)), 8)


USAGE = """
    u AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'ollama' ELSE 'hosted' END AS provider,
                 CASE WHEN turn = 3 THEN 'own-model' WHEN role = 'user' THEN 'GPT-4o' WHEN role = 'assistant' THEN 'mistral-large-latest' ELSE 'unlisted-model' END AS model,
                 CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS input_tokens, CAST(length(coalesce(text, '')) // 4 * 2 AS BIGINT) AS output_tokens FROM conversations),
    c AS (SELECT *, CASE WHEN model = 'own-model' THEN (input_tokens * 4.0 + output_tokens * 8.0) / 1000000
                         WHEN provider = 'ollama' THEN 0.0
                         WHEN model = 'GPT-4o' THEN (input_tokens * 2.5 + output_tokens * 10.0) / 1000000
                         WHEN model = 'mistral-large-latest' THEN (input_tokens * 2.0 + output_tokens * 6.0) / 1000000
                         ELSE 0.0 END AS cost FROM u)
"""

# --------------------------------------------------------------------------------------- models that answer by plain rules


def part_of(prompt: str, mark: str) -> str:
    """What stands behind a mark, up to the next one."""
    text = prompt.split(mark, 1)[1] if mark in prompt else ""
    for other in (J.RESPONSE, J.CONTEXT, J.CLAIM, J.QUESTION, J.STEP, J.NEXT):
        text = text.split(other, 1)[0]
    return text


def plain_claims(prompts: list[str]) -> list[str]:
    """Lists sentences as claims (in some noise); a claim is supported if the context has its first word."""
    out = []
    for p in prompts:
        if J.CLAIM in p:
            ok = part_of(p, J.CLAIM).split(" ")[0] in part_of(p, J.CONTEXT)
            out.append(f'Well: {{"supported": {str(ok).lower()}, "reasoning": "by rule"}}')
        else:
            out.append("Claims: " + json.dumps(part_of(p, J.RESPONSE).split(". "), ensure_ascii=False))
    return out


def plain_scores(prompts: list[str]) -> list[str]:
    return [json.dumps({"score": len(part_of(p, J.RESPONSE)) / 500}) for p in prompts]


def plain_judge(prompts: list[str]) -> list[str]:
    return [f"Score: {1 + (len(part_of(p, J.RESPONSE)) + p.index('.')) % 5}" for p in prompts]


def plain_transitions(prompts: list[str]) -> list[str]:
    return [json.dumps({"is_coherent": part_of(p, J.STEP) != part_of(p, J.NEXT)}) for p in prompts]


def plain_questions(prompts: list[str]) -> list[str]:
    return ['["first?", " ", "third?", "fourth?"]' for _ in prompts]


def plain_checks(prompts: list[str]) -> list[str]:
    """Fails for some texts, and for a whole batch that holds one."""
    sizes = [len(part_of(p, J.CONTEXT)) for p in prompts]
    if any(n % 17 == 0 for n in sizes):
        raise RuntimeError("no answer")
    return [json.dumps({"is_valid": n % 2 == 1}) for n in sizes]


def _responses(spark, d):
    c = read(spark, d, "conversations")
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    return c.groupBy(F.col("conv_id").alias("id")).agg(at(0).alias("context"), at(0).alias("question"), at(1).alias("response"))


RESPONSES = "r AS (SELECT conv_id AS id, max(CASE WHEN turn = 0 THEN text END) AS context, max(CASE WHEN turn = 1 THEN text END) AS response FROM conversations GROUP BY 1)"
SAID = f"{RESPONSES}, l AS (SELECT id, context, unnest(string_split(response, '. ')) AS claim FROM r WHERE trim(coalesce(response, '')) <> '' AND trim(coalesce(context, '')) <> ''), c AS (SELECT * FROM l WHERE claim <> ''), s AS (SELECT id, count(*) AS n, sum(CASE WHEN contains(context, split_part(claim, ' ', 1)) THEN 1 ELSE 0 END) AS k FROM c GROUP BY 1), j AS (SELECT r.*, coalesce(n, 0) AS n, k FROM r LEFT JOIN s ON r.id = s.id)"


def claim_faithfulness(spark, d):
    return rounded(J.faithfulness(_responses(spark, d), plain_claims))


def claim_hallucination(spark, d):
    return rounded(J.hallucination(_responses(spark, d), plain_claims))


def answer_relevance(spark, d):
    return rounded(J.relevance(_responses(spark, d), plain_scores).select("id", "score"))


def judge_criteria(spark, d):
    return J.judged(_responses(spark, d), plain_judge).drop("error")


def agent_coherence(spark, d):
    return rounded(J.coherence(steps(spark, d), plain_transitions))


def multihop_questions(spark, d):
    return J.multihop_questions(read(spark, d, "documents"), 120, plain_questions)


def adversarial_questions(spark, d):
    return J.adversarial_questions(read(spark, d, "documents"), 14, plain_questions)


def validated_questions(spark, d):
    docs = read(spark, d, "documents")
    asked = docs.select("doc_id", F.lit(1).alias("no"), F.concat(F.lit("About "), "source", F.lit("?")).alias("question"))
    return J.validated_questions(asked, docs, plain_checks)


def plain_pipeline(question: str) -> tuple[list[str], str]:
    n = int(question)
    if n % 13 == 0:
        raise LookupError("nothing there")
    return [str(n % 7), str(n % 5), str(n % 3)], f"answer {n}"


def evaluate_pipeline(spark, d):
    asked = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("text"), F.array((F.col("c_custkey") % 7).cast("string")).alias("ground_truth_docs"))
    done = running.evaluate(asked, plain_pipeline, 3, retries=1, delay=0.0)
    return rounded(done.select("text", "answer", "attempts", F.coalesce("error", F.lit("")).alias("error"), *E.MEASURES))


def lookup_stats(spark, d):
    c = read(spark, d, "conversations")
    keyed = c.select("role", running.cache_key(F.col("text"), F.array("role")).alias("key"))
    return rounded(running.cache_stats(keyed, keyed.where("role = 'user'").select("key").distinct()))


def mean_latencies(spark, d):
    return rounded(E.mean_latency(traces(spark, d), ["tenant"]), 4)


R6 = ", ".join(f"round({m}, 6) AS {m}" for m in E.MEASURES)

_PAIRS: dict[str, tuple[object, str | None]] = {
    **{f"retrieval_{n}": (_one(m), f"WITH {RUN5} SELECT l_orderkey, round({m}, 6) AS {m} FROM scored") for n, m in (("precision", "precision"), ("recall", "recall"), ("mrr", "mrr"), ("ndcg", "ndcg"))},
    "retrieval_all": (retrieval_all, f"WITH {RUN5} SELECT l_orderkey, {R6} FROM scored"),
    "retrieval_long": (retrieval_long, f"WITH {RUN5} SELECT l_orderkey, {R6} FROM scored"),
    "eval_summary": (eval_summary, f"WITH {RUN5}, {PRIORITY} SELECT o_orderpriority, count(*) AS n_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.MEASURES)} FROM scored JOIN o ON l_orderkey = o_orderkey GROUP BY 1"),
    "eval_summary_ranges": (eval_summary_ranges, f"WITH {RUN5}, {PRIORITY}, j AS (SELECT * FROM scored JOIN o ON l_orderkey = o_orderkey), long AS ({LONG.format(by='o_orderpriority', of='j')}), a AS (SELECT o_orderpriority, metric, avg(value) AS average, min(value) AS least, max(value) AS most FROM long GROUP BY 1, 2) SELECT o_orderpriority, metric, round(average, 6) AS average, round(least, 6) AS least, round(most, 6) AS most, {STATUS_SQL} AS status FROM a"),
    "eval_overall_status": (eval_overall_status, f"WITH {RUN5}, {PRIORITY}, j AS (SELECT * FROM scored JOIN o ON l_orderkey = o_orderkey), long AS ({LONG.format(by='o_orderpriority', of='j')}), a AS (SELECT o_orderpriority, metric, avg(value) AS average FROM long GROUP BY 1, 2), s AS (SELECT *, {STATUS_SQL} AS status FROM a) SELECT o_orderpriority, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS overall FROM s GROUP BY 1"),
    "config_rankings": (config_rankings, f"WITH {CONFIGS} SELECT config, config_idx, metric, round(value, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'total_latency_ms' THEN -value ELSE value END DESC, config_idx) AS rank FROM long"),
    "config_winner": (config_winner, f"WITH {CONFIGS}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'total_latency_ms' THEN -value ELSE value END DESC, config_idx) AS rk FROM long) SELECT metric, config AS winner, round(value, 6) AS value FROM r WHERE rk = 1"),
    "config_pairwise": (config_pairwise, f"WITH {CONFIGS}, p AS (SELECT a.metric, a.config AS config_a, b.config AS config_b, a.value AS value_a, b.value AS value_b, a.value - b.value AS difference, CASE WHEN a.metric = 'total_latency_ms' THEN b.value - a.value ELSE a.value - b.value END AS gain FROM long a JOIN long b ON a.metric = b.metric AND a.config_idx < b.config_idx) SELECT metric, config_a, config_b, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(difference, 6) AS difference, round(CASE WHEN value_b <> 0 THEN difference / value_b * 100 WHEN metric = 'total_latency_ms' OR difference = 0 THEN 0.0 WHEN difference > 0 THEN 100.0 ELSE -100.0 END, 6) AS percent_change, CASE WHEN gain > 0 THEN config_a WHEN gain < 0 THEN config_b ELSE 'tie' END AS winner FROM p"),
    "regression_alerts": (regression_alerts, f"WITH {HALVES}, j AS (SELECT a.o_orderpriority, a.metric, a.value AS baseline, coalesce(b.value, 0.0) AS current FROM long a LEFT JOIN long b ON b.o_orderpriority = a.o_orderpriority AND b.metric = a.metric AND NOT b.early WHERE a.early AND a.value <> 0), g AS (SELECT *, (current - baseline) / baseline * 100 AS change_percent FROM j) SELECT o_orderpriority, metric, round(baseline, 6) AS baseline, round(current, 6) AS current, round(change_percent, 6) AS change_percent, CASE WHEN change_percent < -0.1 THEN 'critical' ELSE 'warning' END AS severity FROM g WHERE change_percent < -0.05"),
    "gating_status": (gating_status, f"WITH {NOW}, g AS (SELECT run, CASE WHEN value < threshold AND stable THEN 2 WHEN value < threshold THEN 1 ELSE 0 END AS l FROM now n JOIN {_values(THRESHOLDS)} t(metric, threshold, stable) ON n.metric = t.metric) SELECT run, CASE max(l) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status, CASE max(l) WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS exit_code, CAST(sum(CASE WHEN l > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_missed FROM g GROUP BY 1"),
    "baseline_compare": (baseline_compare, f"WITH {BASE} SELECT run, metric, round(value, 6) AS value, reference, round(change_pct, 6) AS change_pct, change_pct > 0 AS better FROM b"),
    "baseline_verdict": (baseline_verdict, f"WITH {BASE}, s AS (SELECT run, CASE WHEN sum(abs(change_pct)) > 0 THEN sum(change_pct) / sum(abs(change_pct)) ELSE 0.0 END AS score FROM b GROUP BY 1) SELECT run, round(score, 6) AS score, CASE WHEN score > 0.2 THEN 'better' WHEN score < -0.2 THEN 'below' ELSE 'comparable' END AS verdict FROM s"),
    "query_diff": (query_diff, f"WITH {DIFF} SELECT idx, {', '.join(f'round(d_{m}, 6) AS d_{m}' for m in E.MEASURES)}, round(mean_delta, 6) AS mean_delta, change FROM k"),
    "diff_summary": (diff_summary, f"WITH {DIFF} SELECT count(*) AS n, round(avg(CASE WHEN change = 'improved' THEN 1.0 ELSE 0.0 END), 6) AS improvement_rate, round(avg(CASE WHEN change = 'degraded' THEN 1.0 ELSE 0.0 END), 6) AS degradation_rate FROM k"),
    "dataset_diff": (dataset_diff, "WITH a AS (SELECT doc_id, text, lang, source FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, CASE WHEN length(text) > 2500 THEN text || '!' ELSE text END AS text, CASE WHEN length(text) > 2500 AND lang = 'fr' THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE lang <> 'es'), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS fresh, b.doc_id IS NULL AS gone, concat_ws(',', CASE WHEN a.text IS DISTINCT FROM b.text THEN 'text' END, CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END) AS fields FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id) SELECT doc_id, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN fields <> '' THEN 'modified' ELSE 'unchanged' END AS change, CASE WHEN NOT fresh AND NOT gone AND fields <> '' THEN fields END AS fields FROM j"),
    "dataset_keys": (dataset_keys, "SELECT doc_id, sha256(text || chr(1) || array_to_string(list_sort([source, lang]), chr(2)) || chr(1) || lang) AS content_key, substr(sha256(text), 1, 16) AS short_hash, sha256(text || ':' || lang || ':' || source) AS fingerprint FROM documents"),
    "golden_filter": (golden_filter, "SELECT CAST(doc_id AS VARCHAR) AS id, text AS question FROM documents WHERE (lang IN ('de', 'src3') OR source IN ('de', 'src3')) AND n_chars > 2000 AND lang <> 'en'"),
    "golden_tags": (golden_tags, "SELECT DISTINCT tag FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) WHERE tag <> ''"),
    "golden_testset": (golden_testset, "SELECT text, source AS docs, source AS expected_answer, CASE WHEN n_chars > 2000 THEN 'hard' ELSE 'easy' END AS difficulty FROM documents"),
    "golden_diff": (golden_diff, "WITH a AS (SELECT doc_id, text AS question, source AS answer FROM documents WHERE lang <> 'src2' AND source <> 'src2'), b AS (SELECT doc_id, text AS question, CASE WHEN lang = 'fr' OR source = 'fr' THEN 'new' ELSE source END AS answer FROM documents WHERE lang <> 'de' AND source <> 'de'), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS fresh, b.doc_id IS NULL AS gone, concat_ws(',', CASE WHEN a.question IS DISTINCT FROM b.question THEN 'question' END, CASE WHEN a.answer IS DISTINCT FROM b.answer THEN 'answer' END) AS fields FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id) SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN fields <> '' THEN 'modified' ELSE 'unchanged' END AS change, CASE WHEN NOT fresh AND NOT gone AND fields <> '' THEN fields END AS fields FROM j"),
    "doc_min_length": (doc_min_length, "SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents WHERE length(text) >= 1000"),
    "doc_pairs_budget": (doc_pairs_budget, "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM (SELECT DISTINCT doc_id FROM documents)), p AS (SELECT a.doc_id AS a, b.doc_id AS b, row_number() OVER (ORDER BY a.i, b.i) AS pair_no FROM n a JOIN n b ON a.i < b.i AND b.i <= 51) SELECT CAST(pair_no AS INTEGER) AS pair_no, a, b FROM p WHERE pair_no <= 50"),
    "vector_topk_cosine": (vector_topk_cosine, "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM s) SELECT query_id, id, round(score, 5) AS score FROM r WHERE rk <= 5"),
    "trace_percentiles_exclusive": (trace_percentiles_exclusive, f"WITH {TRACES}, {_quantile_sql('tenant', 'min(v)')} SELECT tenant, n, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM p"),
    "trace_hourly": (trace_hourly, f"WITH {TRACES.replace('ts, user_id', chr(34) + 'ts' + chr(34) + ', strftime(date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts), ' + chr(39) + '%Y-%m-%d %H' + chr(39) + ') AS hour, user_id')}, {_quantile_sql('hour', 'max(CASE WHEN nth = n // 2 + 1 THEN v END)')}, c AS (SELECT hour, count(*) AS total, sum(CASE WHEN success THEN 1 ELSE 0 END) AS succeeded, avg(latency_ms) AS a FROM t GROUP BY 1) SELECT c.hour, total, CAST(succeeded AS BIGINT) AS succeeded, round(a, 4) AS avg_latency_ms, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM c LEFT JOIN p ON c.hour = p.hour"),
    "trace_success_rate": (trace_success_rate, f"WITH {TRACES} SELECT tenant, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) AS n FROM t GROUP BY 1"),
    "trace_retention": (trace_retention, f"WITH {TRACES} SELECT id, tenant FROM t WHERE ts >= TIMESTAMP '{NOW_TS}' - INTERVAL 7 DAY"),
    "trace_sampled": (trace_sampled, f"WITH {TRACES} SELECT tenant, count(*) AS n FROM t WHERE CAST('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 100000 OR NOT success GROUP BY 1"),
    "trace_prometheus": (trace_prometheus, f"WITH t0 AS (SELECT ts, CAST(value AS DOUBLE) AS latency_ms, event_type <> 'error' AS success FROM events), t AS (SELECT * FROM t0 WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'), {_quantile_sql('', 'min(v)')}, a AS (SELECT count(*) AS total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS success_total FROM t0), b AS (SELECT coalesce(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 1.0) AS success_rate_24h, count(*) AS total_24h FROM t) SELECT total, success_total, round(success_rate_24h, 4) AS success_rate_24h, total_24h, round(coalesce(p50, 0.0), 4) AS p50_24h, round(coalesce(p95, 0.0), 4) AS p95_24h, round(coalesce(p99, 0.0), 4) AS p99_24h FROM a CROSS JOIN b LEFT JOIN p ON true"),
    "alerts_fired": (alerts_fired, f"WITH {TRACES}, h AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, 1 - avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS e, avg(latency_ms) AS l, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1) SELECT hour, 'errors' AS name, 'critical' AS severity, round(e, 6) AS value FROM h WHERE e >= 0.3 UNION ALL SELECT hour, 'slow', 'warning', round(l, 6) FROM h WHERE l > 60 UNION ALL SELECT hour, 'quiet', 'info', n FROM h WHERE n < 5"),
    "alerts_cooldown": (alerts_cooldown, f"WITH RECURSIVE {TRACES}, h AS (SELECT date_trunc('hour', ts) AS hr, 1 - avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS e, avg(latency_ms) AS l, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1), a AS (SELECT hr, 'errors' AS name, 'critical' AS severity, e AS value FROM h WHERE e >= 0.3 UNION ALL SELECT hr, 'slow', 'warning', l FROM h WHERE l > 60 UNION ALL SELECT hr, 'quiet', 'info', n FROM h WHERE n < 5), f AS (SELECT name, min(hr) AS hr FROM a GROUP BY 1 UNION ALL SELECT a.name, min(a.hr) AS hr FROM f JOIN a ON a.name = f.name AND a.hr >= f.hr + INTERVAL 180 MINUTE GROUP BY a.name, f.hr) SELECT strftime(a.hr, '%Y-%m-%d %H') AS hour, a.name, severity, round(value, 6) AS value FROM a JOIN f ON a.name = f.name AND a.hr = f.hr"),
    "history_rotation": (history_rotation, f"WITH {HISTORY}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rk FROM h WHERE NOT is_baseline), b AS (SELECT * FROM h WHERE is_baseline) SELECT id, config, is_baseline FROM b UNION ALL SELECT id, config, is_baseline FROM n WHERE rk <= greatest(0, 400 - (SELECT count(*) FROM b))"),
    "history_by_config": (history_by_config, f"WITH {HISTORY} SELECT config, count(*) AS runs, strftime(max(ts), '%Y-%m-%d') AS latest, CAST(sum(CASE WHEN is_baseline THEN 1 ELSE 0 END) AS BIGINT) AS baselines FROM h GROUP BY 1"),
    "history_latest": (history_latest, f"WITH {HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY ts DESC, id DESC) AS rk FROM h) SELECT config, id, is_baseline FROM n WHERE rk = 1"),
    "tool_use_metrics": (tool_use_metrics, f"WITH {STEPS}, x AS (SELECT trace, idx, CASE WHEN tool = 'view' THEN 'click' ELSE tool END AS tool FROM s WHERE value <= 60), a AS (SELECT trace, tool, count(*) AS a FROM s WHERE step_type = 'action' GROUP BY 1, 2), b AS (SELECT trace, tool, count(*) AS b FROM x GROUP BY 1, 2), j AS (SELECT coalesce(a.trace, b.trace) AS trace, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.trace = b.trace AND a.tool = b.tool), g AS (SELECT trace, CAST(sum(a) AS BIGINT) AS n_actual, CAST(sum(b) AS BIGINT) AS n_expected, CAST(sum(least(a, b)) AS BIGINT) AS n_matched FROM j GROUP BY 1), p AS (SELECT *, CASE WHEN n_actual > 0 THEN n_matched / CAST(n_actual AS DOUBLE) WHEN n_expected > 0 THEN 0.0 ELSE 1.0 END AS p, CASE WHEN n_expected > 0 THEN n_matched / CAST(n_expected AS DOUBLE) ELSE 1.0 END AS r FROM g) SELECT trace, n_actual, n_expected, n_matched, n_actual - n_matched AS n_unnecessary, n_expected - n_matched AS n_missing, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p"),
    "tool_bag_match": (tool_bag_match, f"WITH {STEPS}, x AS (SELECT trace, idx, CASE WHEN tool = 'view' THEN 'click' ELSE tool END AS tool FROM s WHERE value <= 60), a AS (SELECT trace, idx, tool, row_number() OVER (PARTITION BY trace, tool ORDER BY idx) AS rn FROM s WHERE step_type = 'action'), b AS (SELECT trace, idx, tool, row_number() OVER (PARTITION BY trace, tool ORDER BY idx) AS rn FROM x) SELECT a.trace, a.idx, a.tool, b.idx AS expected_idx, b.idx IS NOT NULL AS matched FROM a LEFT JOIN b ON a.trace = b.trace AND a.tool = b.tool AND a.rn = b.rn"),
    "tool_success": (tool_success, f"WITH {STEPS}, g AS (SELECT trace, coalesce(avg(CASE WHEN step_type = 'action' THEN CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END END), 1.0) AS ok, CAST(sum(CASE WHEN step_type = 'action' THEN 1 ELSE 0 END) AS BIGINT) AS n_calls FROM s GROUP BY 1) SELECT trace, round(ok, 6) AS success_rate, round(1 - ok, 6) AS error_rate, n_calls FROM g"),
    "agent_loops": (agent_loops, f"WITH {STEPS}, l AS (SELECT *, CASE WHEN step_type = 'action' THEN tool END AS sig, lag(CASE WHEN step_type = 'action' THEN tool END) OVER (PARTITION BY trace ORDER BY idx) AS prev FROM s) SELECT trace, idx, tool FROM l WHERE sig = prev"),
    "agent_dead_ends": (agent_dead_ends, f"WITH {STEPS}, l AS (SELECT *, lead(CASE WHEN step_type = 'action' THEN tool END, 1) OVER w AS n1, lead(CASE WHEN step_type = 'action' THEN tool END, 2) OVER w AS n2, count(*) OVER (PARTITION BY trace) AS n FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)) SELECT trace, idx, tool FROM l WHERE step_type = 'action' AND error IS NOT NULL AND n >= 2 AND NOT coalesce(n1 = tool, false) AND NOT coalesce(n2 = tool, false)"),
    "agent_failures": (agent_failures, f"WITH {STEPS}, l AS (SELECT *, CASE WHEN step_type = 'action' THEN tool END AS sig, lag(CASE WHEN step_type = 'action' THEN tool END) OVER w AS prev, lag(idx) OVER w AS prev_idx, lead(CASE WHEN step_type = 'action' THEN tool END, 1) OVER w AS n1, lead(CASE WHEN step_type = 'action' THEN tool END, 2) OVER w AS n2, count(*) OVER (PARTITION BY trace) AS n FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)) SELECT trace, idx, 'tool_error' AS kind, 'error' AS severity FROM l WHERE step_type = 'action' AND error IS NOT NULL UNION ALL SELECT trace, prev_idx, 'loop', 'warning' FROM l WHERE sig = prev UNION ALL SELECT trace, idx, 'dead_end', 'warning' FROM l WHERE step_type = 'action' AND error IS NOT NULL AND n >= 2 AND NOT coalesce(n1 = tool, false) AND NOT coalesce(n2 = tool, false)"),
    "trajectory_summary": (trajectory_summary, f"WITH {STEPS} SELECT trace, count(*) AS n_steps, CAST(sum(CASE WHEN step_type = 'action' THEN 1 ELSE 0 END) AS BIGINT) AS n_actions, CAST(sum(CASE WHEN step_type = 'action' AND error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN step_type = 'thought' THEN 1 ELSE 0 END) AS BIGINT) AS n_thoughts, count(DISTINCT CASE WHEN step_type = 'action' THEN tool END) AS n_tools FROM s GROUP BY 1"),
    "agent_efficiency": (agent_efficiency, f"WITH {STEPS}, l AS (SELECT *, CASE WHEN step_type = 'action' THEN tool END AS sig, lag(CASE WHEN step_type = 'action' THEN tool END) OVER (PARTITION BY trace ORDER BY idx) AS prev FROM s) SELECT trace, round(least(greatest(least(1.0, 50.0 / count(*)) - 0.15 * sum(CASE WHEN sig = prev THEN 1 ELSE 0 END), 0.0), 1.0), 6) AS efficiency FROM l GROUP BY 1"),
    "tool_counts": (tool_counts, f"WITH {STEPS} SELECT trace, tool, count(*) AS n FROM s WHERE step_type = 'action' GROUP BY 1, 2"),
    "step_transitions": (step_transitions, f"WITH {STEPS}, l AS (SELECT trace, idx, tool AS content, lead(tool) OVER w AS next_content, lead(idx) OVER w AS next_idx FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)) SELECT * FROM l WHERE next_idx IS NOT NULL"),
    "goal_progress": (goal_progress, "WITH l AS (SELECT user_id AS trace, ts, event_id, CAST(value AS DOUBLE) AS p, lag(CAST(value AS DOUBLE)) OVER w AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT trace, round(max(CASE WHEN rk = 1 THEN p END), 6) AS progress, bool_and(coalesce(p >= q, true)) AS monotonic FROM l GROUP BY 1"),
    "judge_parse": (judge_parse, r"WITH n AS (SELECT conv_id, turn, text, CAST(length(text) % 7 AS INTEGER) AS k FROM conversations), r AS (SELECT *, least(greatest(k, 1), 5) AS raw FROM n) SELECT conv_id, turn, raw, (raw - 1) / 4.0 AS score, CASE WHEN k = 3 THEN 'PARTIAL' WHEN raw >= 4 THEN 'PASS' WHEN raw <= 2 THEN 'FAIL' ELSE 'PARTIAL' END AS verdict, CASE WHEN k = 5 THEN 'Score: 5' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS explanation FROM r"),
    "judge_overall": (judge_overall, "WITH n AS (SELECT conv_id, least(greatest(CAST(length(text) % 7 AS INTEGER), 1), 5) AS raw FROM conversations) SELECT conv_id AS id, round(avg((raw - 1) / 4.0), 6) AS overall_score, CASE WHEN bool_or(raw <= 2) THEN 'FAIL' WHEN bool_or(raw = 3) THEN 'PARTIAL' ELSE 'PASS' END AS overall_verdict FROM n GROUP BY 1"),
    "faithfulness": (faithfulness, f"WITH {CLAIMS.format(share='ok')} SELECT r.id, round(CASE WHEN trim(coalesce(response, '')) = '' THEN 1.0 WHEN trim(coalesce(context, '')) = '' THEN 0.0 ELSE coalesce(s, 1.0) END, 6) AS score FROM r LEFT JOIN c ON r.id = c.id"),
    "hallucination": (hallucination, f"WITH {CLAIMS.format(share='1 - ok')} SELECT r.id, round(CASE WHEN trim(coalesce(response, '')) = '' THEN 0.0 WHEN trim(coalesce(context, '')) = '' THEN 1.0 ELSE coalesce(s, 0.0) END, 6) AS score FROM r LEFT JOIN c ON r.id = c.id"),
    "question_types": (question_types, f"WITH q AS (SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Why ' ELSE 'Compare ' END || text) AS q FROM conversations) SELECT conv_id, turn, {QUESTION_SQL} AS question_type FROM q"),
    "json_extract": (json_extract, "SELECT conv_id, turn, role, text, CAST(turn AS BIGINT) AS parsed_turn FROM conversations"),
    "pii_sanitize": (pii_sanitize, r"""
        WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS word FROM documents)
        SELECT DISTINCT doc_id, word, sha256(word) AS hashed, '[REDACTED]' AS redacted FROM w
        WHERE length(word) >= 3 AND (
            regexp_matches(word, '^(/[^/\s]+)+/?$') OR regexp_matches(word, '^[A-Za-z]:\\.*$') OR regexp_matches(word, '^~[/\\].*$')
            OR regexp_matches(word, '^[\w.+-]+@[\w.-]+\.\w+$') OR regexp_matches(word, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')
            OR regexp_matches(word, '^user[_-]?\d+$', 'i') OR regexp_matches(word, '^[a-z]{2,}\d{2,}$', 'i'))
    """),
    "token_cost": (token_cost, f"WITH {USAGE} SELECT conv_id, turn, provider, model, input_tokens, output_tokens, round(CAST(cost AS DOUBLE), 9) AS cost FROM c"),
    "cost_rollup": (cost_rollup, f"WITH {USAGE} SELECT provider, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(CAST(sum(cost) AS DOUBLE), 8) AS cost, count(*) AS calls FROM c GROUP BY GROUPING SETS ((provider, model), ())"),
    "claim_faithfulness": (claim_faithfulness, f"WITH {SAID} SELECT id, round(CASE WHEN trim(coalesce(response, '')) = '' THEN 1.0 WHEN trim(coalesce(context, '')) = '' THEN 0.0 WHEN n = 0 THEN 1.0 ELSE k / CAST(n AS DOUBLE) END, 6) AS score, CAST(n AS BIGINT) AS n_claims, CASE WHEN trim(coalesce(response, '')) = '' THEN 'Empty response has no claims to verify.' WHEN trim(coalesce(context, '')) = '' THEN 'No context provided to verify claims against.' WHEN n = 0 THEN 'No verifiable claims found in the response.' WHEN k = n THEN 'All claims in the response are supported by the context.' WHEN k = 0 THEN 'None of the claims in the response are supported by the context.' ELSE CAST(k AS VARCHAR) || ' out of ' || CAST(n AS VARCHAR) || ' claims are supported by the context.' END AS reasoning FROM j"),
    "claim_hallucination": (claim_hallucination, f"WITH {SAID} SELECT id, round(CASE WHEN trim(coalesce(response, '')) = '' THEN 0.0 WHEN trim(coalesce(context, '')) = '' THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 1 - k / CAST(n AS DOUBLE) END, 6) AS score, CAST(n AS BIGINT) AS n_claims FROM j"),
    "answer_relevance": (answer_relevance, f"WITH {RESPONSES} SELECT id, round(CASE WHEN trim(coalesce(response, '')) = '' THEN 0.0 WHEN trim(coalesce(context, '')) = '' THEN 1.0 ELSE least(length(response) / 500.0, 1.0) END, 6) AS score FROM r"),
    "judge_criteria": (judge_criteria, f"WITH {RESPONSES}, j AS (SELECT id, criteria, CAST(1 + (length(coalesce(response, '')) + length('Judge the response by ' || criteria)) % 5 AS INTEGER) AS raw FROM r CROSS JOIN (VALUES ('faithfulness'), ('relevance'), ('hallucination'), ('completeness')) v(criteria)) SELECT id, criteria, raw, (raw - 1) / 4.0 AS score, CASE WHEN raw >= 4 THEN 'PASS' WHEN raw <= 2 THEN 'FAIL' ELSE 'PARTIAL' END AS verdict, 'Score: ' || CAST(raw AS VARCHAR) AS explanation FROM j"),
    "agent_coherence": (agent_coherence, f"WITH {STEPS}, l AS (SELECT trace, tool, lead(tool) OVER (PARTITION BY trace ORDER BY idx) AS next_tool, lead(idx) OVER (PARTITION BY trace ORDER BY idx) AS next_idx FROM s) SELECT trace, round(coalesce(avg(CASE WHEN next_idx IS NOT NULL THEN CASE WHEN tool <> next_tool THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS score FROM l GROUP BY 1"),
    "multihop_questions": (multihop_questions, "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM (SELECT DISTINCT doc_id FROM documents WHERE length(text) >= 100)), p AS (SELECT a.doc_id AS a, b.doc_id AS b, row_number() OVER (ORDER BY a.i, b.i) AS pair_no FROM n a JOIN n b ON a.i < b.i AND b.i <= 51) SELECT a, b, 0 AS no, 'first?' AS question FROM p WHERE pair_no <= 50"),
    "adversarial_questions": (adversarial_questions, "SELECT kind, expected, no, question FROM (VALUES ('out_of_scope', 'refuse'), ('ambiguous', 'clarify'), ('misleading', 'correct'), ('boundary', 'handle_gracefully')) k(kind, expected) CROSS JOIN (VALUES (0, 'first?'), (2, 'third?')) q(no, question)"),
    "validated_questions": (validated_questions, "SELECT doc_id, 1 AS no, 'About ' || source || '?' AS question FROM documents WHERE length(text) % 17 = 0 OR length(text) % 2 = 1"),
    "evaluate_pipeline": (evaluate_pipeline, "WITH c AS (SELECT c_custkey AS n, c_custkey % 13 = 0 AS fails, CASE WHEN c_custkey % 5 = c_custkey % 7 THEN 1 ELSE 0 END AS second, CASE WHEN c_custkey % 3 = c_custkey % 7 THEN 1 ELSE 0 END AS third FROM customer) SELECT CAST(n AS VARCHAR) AS text, CASE WHEN fails THEN '' ELSE 'answer ' || CAST(n AS VARCHAR) END AS answer, CASE WHEN fails THEN 2 ELSE 1 END AS attempts, CASE WHEN fails THEN 'LookupError: nothing there' ELSE '' END AS error, round(CASE WHEN fails THEN 0.0 ELSE (1 + second + third) / 3.0 END, 6) AS precision, CASE WHEN fails THEN 0.0 ELSE 1.0 END AS recall, CASE WHEN fails THEN 0.0 ELSE 1.0 END AS mrr, round(CASE WHEN fails THEN 0.0 ELSE 1 + second / log2(CAST(3 AS DOUBLE)) + third / 2.0 END, 6) AS ndcg FROM c"),
    "lookup_stats": (lookup_stats, "WITH k AS (SELECT text || '/' || role AS key, role FROM conversations), c AS (SELECT DISTINCT key FROM k WHERE role = 'user'), j AS (SELECT k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON k.key = c.key) SELECT CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS misses, (SELECT count(*) FROM c) AS size, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM j"),
    "mean_latencies": (mean_latencies, f"WITH {TRACES}, g AS (SELECT tenant, avg(latency_ms) AS a, sum(latency_ms) AS b FROM t GROUP BY 1) SELECT tenant, 'latency_ms' AS metric, round(a, 4) AS value FROM g UNION ALL SELECT tenant, 'total_latency_ms', round(b, 4) FROM g"),
}

QUERIES = {name: query for name, (query, _) in _PAIRS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _PAIRS.items() if sql}
