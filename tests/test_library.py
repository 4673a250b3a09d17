import datetime as dt
import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tessel import cli
from tessel.functions import medical, quantiles, retrieval, text as X
from tessel.operators import agents, datasets, evaluation as E, monitoring as M, vectors
from tessel.plans import reports
from tessel.sources import files, store
from tessel.streaming import traces as S


def measures(spark, retrieved, relevant, k):
    df = spark.createDataFrame([(retrieved, relevant)], "retrieved array<string>, relevant array<string>")
    return E.score_runs(df, k).first().asDict()


def test_measures(spark):
    m = measures(spark, ["a", "b", "c"], ["b", "z"], 2)
    assert (m["precision"], m["recall"], m["mrr"]) == (0.5, 0.5, 0.5)
    assert m["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


@pytest.mark.parametrize("retrieved, relevant", [([], ["a"]), (["a"], []), ([], [])])
def test_measures_of_nothing(spark, retrieved, relevant):
    m = measures(spark, retrieved, relevant, 3)
    assert [m[x] for x in E.MEASURES] == [0.0] * 4


def test_repeated_document_gains_twice(spark):
    m = measures(spark, ["a", "a"], ["a"], 2)
    assert m["precision"] == 1.0 and m["recall"] == 1.0 and m["ndcg"] > 1
    df = spark.createDataFrame([(m["ndcg"],)], "n double")
    assert df.select(retrieval.in_range(F.col("n")).alias("ok")).first().ok is False
    with pytest.raises(ValueError):
        retrieval.all_measures(F.col("a"), F.col("b"), 0)


@pytest.mark.parametrize("n", [4, 5, 19, 20, 37, 99, 100, 101])
def test_exclusive_quantiles(spark, n):
    values = [float((k * 7919) % 1000) for k in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles.latency_percentiles(df, "v", []).first()
    q = statistics.quantiles(values, n=100)
    assert row.p50 == pytest.approx(q[49])
    assert row.p95 == pytest.approx(q[94] if n >= 20 else max(values))
    assert row.p99 == pytest.approx(q[98] if n >= 100 else max(values))


def test_few_values(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "v double")
    assert quantiles.latency_percentiles(df, "v", []).first().p50 == 1.0
    assert quantiles.latency_percentiles(df, "v", [], few_median=True).first().p50 == 2.0


def test_judge_parse(spark):
    df = spark.createDataFrame([("Score: 5\nVerdict: fail\nExplanation: good ### x",), ("nothing",), ("Score: 10",)], "a string")
    got = [r.j for r in df.select(X.judge_parse(F.col("a")).alias("j")).collect()]
    assert (got[0].raw, got[0].score, got[0].verdict, got[0].explanation) == (5, 1.0, "FAIL", "good")
    assert (got[1].raw, got[1].verdict) == (3, "PARTIAL")
    assert got[2].raw == 1
    assert got[1].explanation == "nothing" and got[2].explanation == "Score: 10"


@pytest.mark.parametrize("question, kind", [("What is X and also Y?", "multi_hop"), ("Both of them?", "multi_hop"), ("Why is it so?", "explanatory"), ("Please explain", "explanatory"), ("The difference of A and B", "comparative"), ("A vs B", "comparative"), ("Define it", "definitional"), ("When was it?", "factual"), ("Somehow done", "explanatory")])
def test_question_types(spark, question, kind):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(X.question_type(F.col("q"))).first()[0] == kind
    assert df.select(X.question_type(F.col("q"), ("comparative",))).first()[0] == "comparative"
    assert df.select(X.question_type(F.col("q"), ())).first()[0] == "factual"


def test_embedded_json(spark):
    df = spark.createDataFrame([('x {"a": 1} y',), ('["p", "q"]',), ('see [{"p": 1}, {"p": 2',), ("none",)], "a string")
    got = df.select(F.to_json(X.json_object(F.col("a"))).alias("o"), F.to_json(X.json_array(F.col("a"))).alias("l")).collect()
    assert json.loads(got[0].o) == {"a": 1}
    assert json.loads(got[1].l) == ["p", "q"]
    assert json.loads(got[2].l) == [{"p": 1}, {"p": 2}]
    assert got[3].o is None and got[3].l is None


@pytest.mark.parametrize("value, covered", [("/home/alice/a.txt", True), ("/", False), ("C:\\Users\\x", True), ("~/notes", True), ("a.b+c@example.org", True), ("10.0.0.1", True), ("user_12", True), ("User-7", True), ("user", False), ("alice42", True), ("a1", False), ("word", False), ("+49 30 123456", False), ("123-45-6789", False), ("", False)])
def test_pii(spark, value, covered):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(X.sanitized(F.col("v")), X.sanitized(F.col("v"), "hash"), X.sanitized(F.col("v"), "full"), X.sanitized(F.col("v"), key="Source")).first()
    assert got[0] == ("[REDACTED]" if covered else value) and (len(got[1]) == 64) == covered and got[2] == value and got[3] == "[REDACTED]"


def test_nested_pii(spark):
    m = spark.createDataFrame([({"email": "x", "note": "hello", "k": "10.1.2.3"},)], "m map<string,string>").select(X.sanitized_map(F.col("m")).alias("m")).first().m
    assert m == {"email": "[REDACTED]", "note": "hello", "k": "[REDACTED]"}
    raw = {"a": {"path": "x", "n": 1}, "b": [{"host": "h"}, "user_12", "plain"], "c": ["bob123"]}
    df = spark.createDataFrame([(json.dumps(raw),), ("no json",), ("[1]",), (None,)], "t string")
    got = [r[0] for r in df.select(X.sanitized_json(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"a": {"path": "[REDACTED]", "n": 1}, "b": [{"host": "[REDACTED]"}, "user_12", "plain"], "c": ["bob123"]}
    assert got[1:] == ["no json", "[1]", None]


def test_prices(spark):
    usage = spark.createDataFrame([("openai", "gpt-4o", 1_000_000, 500_000), ("openai", "GPT-4o", 1_000_000, 0), ("ollama", "gpt-4o", 1_000_000, 0), ("Local", "mine", 1_000_000, 0), ("x", "unknown", 9, 9)], "provider string, model string, input_tokens long, output_tokens long")
    custom = spark.createDataFrame([("mine", 3.0, 6.0)], "model string, input_per_m double, output_per_m double")
    got = {(r.provider, r.model): r.cost for r in X.priced(usage, custom).collect()}
    assert got == {("openai", "gpt-4o"): 7.5, ("openai", "GPT-4o"): 2.5, ("ollama", "gpt-4o"): 0.0, ("Local", "mine"): 3.0, ("x", "unknown"): 0.0}


def test_pairwise(spark):
    df = spark.createDataFrame([("a", 1, 0.8, 0.5, 0.0, 0.4, 100.0), ("b", 2, 0.4, 0.5, 0.3, 0.8, 50.0)], "config string, config_idx int, precision double, recall double, mrr double, ndcg double, total_latency_ms double")
    got = {r.metric: (r.difference, r.percent_change, r.winner) for r in E.pairwise(df).collect()}
    assert got["precision"] == (pytest.approx(0.4), pytest.approx(100.0), "a") and got["recall"] == (0.0, 0.0, "tie")
    assert got["mrr"] == (pytest.approx(-0.3), pytest.approx(-100.0), "b") and got["ndcg"][1:] == (pytest.approx(-50.0), "b")
    assert got["total_latency_ms"] == (50.0, 100.0, "b")


def long(spark, *rows):
    return spark.createDataFrame(rows, "run string, metric string, value double, n_queries long")


def test_regressions(spark):
    before = long(spark, *[("r", m, v, 10) for m, v in (("precision", 0.5), ("recall", 0.5), ("mrr", 0.5), ("ndcg", 0.0), ("latency_ms", 100.0), ("total_latency_ms", 100.0))])
    now = long(spark, *[("r", m, v, 10) for m, v in (("precision", 0.475), ("recall", 0.46), ("mrr", 0.4), ("ndcg", 0.0), ("latency_ms", 125.0), ("total_latency_ms", 141.0))])
    got = {r.metric: r.severity for r in E.regressions(before, now, ["run"], quality=0.05).collect()}
    assert got.pop("precision", None) in (None, "warning")  # 5 per cent, but for the last bit
    assert got == {"recall": "warning", "mrr": "critical", "latency_ms": "warning", "total_latency_ms": "critical"}
    exact = E.regressions(long(spark, ("r", "precision", 1.0, 1), ("r", "recall", 1.0, 1)), long(spark, ("r", "precision", 0.75, 1), ("r", "recall", 0.5, 1)), ["run"], quality=0.25).collect()
    assert [(r.metric, r.severity) for r in exact] == [("recall", "warning")]  # at the limits nothing is beyond them
    assert E.regressions(before, now, ["run"], queries="n_queries").count() == E.regressions(before, now, ["run"]).count()
    with pytest.raises(Exception, match="10 queries, now there are 9"):
        E.regressions(before, now.withColumn("n_queries", F.lit(9)), ["run"], queries="n_queries").collect()


def test_baselines(spark):
    reference = spark.createDataFrame([("precision", 0.5), ("recall", 0.5), ("latency_ms", 100.0), ("ndcg", 0.0)], "metric string, reference double")
    values = spark.createDataFrame([("a", "precision", 0.6), ("a", "recall", 0.45), ("a", "latency_ms", 150.0), ("b", "ndcg", 0.2), ("b", "other", 1.0), ("c", "recall", 0.5)], "run string, metric string, value double")
    got = {r.run: (r.score, r.verdict) for r in E.baseline_verdict(E.against_baseline(values, reference)).collect()}
    assert got["a"] == (pytest.approx((20 - 10 - 50) / 80), "below") and got["b"] == (1.0, "better") and got["c"] == (0.0, "comparable")
    history = spark.createDataFrame([("c", "h1", True), ("c", "h2", False)], "config string, testset_hash string, is_baseline boolean")
    assert E.baseline_of(history, "c", "h1").count() == 1 and E.baseline_of(history, "x").count() == 0
    with pytest.raises(Exception, match="another test set"):
        E.baseline_of(history, "c", "h2").collect()
    means = {r.metric: r.value for r in E.mean_latency(spark.createDataFrame([("r", 10.0), ("r", 30.0)], "run string, latency_ms double"), ["run"]).collect()}
    assert means == {"latency_ms": 20.0, "total_latency_ms": 40.0}


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",)], "t string")
    assert [r[0] for r in df.select(X.canonical_json(F.col("t"))).collect()] == ['{"a":"é","b":1}', None]


def test_medical():
    assert medical.normalised("Pt w/ HTN and c/o SOB b.i.d") == "Pt with hypertension and complains of shortness of breath twice a day"
    assert medical.normalised("q.12.h N/V/D 2° to Hgb loss, A&Ox3 c\u0304 XYZ", {"XYZ": "a thing"}) == "every 12 hours nausea, vomiting, and diarrhea secondary to hemoglobin loss, alert and oriented times three with a thing"
    assert medical.normalised("US of the abdomen") == "ultrasound of the abdomen" and medical.normalised("he told US so") == "he told US so"
    assert "multiple sclerosis" in medical.normalised("MS with a demyelinating lesion")
    assert "mitral stenosis" in medical.normalised("MS with a loud murmur of the valve")
    assert medical.normalised("heart rate (HR) was HR 80") == "heart rate (HR) was HR 80"
    assert medical.normalised(None) is None


def steps(spark, rows):
    return spark.createDataFrame(rows, "trace string, idx int, step_type string, tool string, args string, error string, content string")


def test_agents(spark):
    s = steps(spark, [("t", 1, "action", "a", "", None, "x"), ("t", 2, "action", "a", "", "bad", "x"), ("t", 3, "thought", None, None, None, "x"), ("t", 4, "action", "b", "", "bad", "x")])
    assert [(r.start, r.idx) for r in agents.loops(s).collect()] == [(1, 2)]
    assert sorted((r.idx, r.kind) for r in agents.failures(s).collect()) == [(1, "loop"), (2, "dead_end"), (2, "tool_error"), (4, "dead_end"), (4, "tool_error")]
    thoughts = steps(spark, [("t", k, "thought" if k % 2 else "observation", None, None, None, " Look again") for k in range(1, 5)])
    assert [(r.trace, r.idx, r.kind) for r in agents.failures(thoughts, similar=0.85).collect()] == [("t", 1, "loop")]
    assert {(r.tool, r.n) for r in agents.counts_by(s, "tool").collect()} == {("a", 2), ("b", 1)}
    assert sorted(r.idx for r in agents.dead_ends(s).collect()) == [2, 4]
    m = agents.tool_metrics(s.where("tool is not null").select("trace", "tool"), spark.createDataFrame([("t", "a"), ("t", "c")], "trace string, tool string")).first()
    assert (m.precision, m.recall) == (pytest.approx(1 / 3), 0.5)
    tools = lambda *names: spark.createDataFrame([("t", n) for n in names], "trace string, tool string")
    got = agents.tool_metrics(tools("a", "b"), tools().limit(0)).first()
    assert (got.precision, got.recall, got.f1, got.n_unnecessary, got.n_missing) == (0.0, 1.0, 0.0, 2, 0)
    got = agents.tool_metrics(tools().limit(0), tools("a")).first()
    assert (got.precision, got.recall, got.f1, got.n_missing) == (0.0, 0.0, 0.0, 1)
    got = agents.tool_metrics(tools("a")).first()
    assert (got.n_actual, got.precision, got.recall, got.f1) == (1, None, None, None)
    share = spark.createDataFrame([({"q": "1"}, ["q", "k"]), ({"q": "1"}, []), (None, ["q"])], "args map<string,string>, required_args array<string>")
    assert [r[0] for r in share.select(agents.argument_presence(share)).collect()] == [0.5, 1.0, 0.0]
    assert agents.success_rates(s).first().success_rate == pytest.approx(1 / 3)
    assert sorted((r.idx, r.like_idx) for r in agents.redundant_steps(s).collect()) == [(2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("portion", [500, 3])
def test_like_steps_of_long_traces(spark, monkeypatch, portion):
    monkeypatch.setattr(agents, "PORTION", portion)
    words = ["look at the map again", "Look at the map again ", "count all the houses", "look at the maps again", "  ", "count all houses", "sing", "look at the map again!", None, "count all the houses"]
    s = steps(spark, [("t", k, "thought", None, None, None, w) for k, w in enumerate(words)] + [("u", 0, "thought", None, None, None, "sing")])
    kept, want = [], []
    for k, w in enumerate(words):
        if w and w.strip():
            like = next((i for i in kept if X.ratio(words[i], w) >= 0.8), None)
            kept, want = (kept + [k], want) if like is None else (kept, want + [(k, like)])
    assert sorted((r.idx, r.like_idx) for r in agents.redundant_steps(s).collect()) == want
    low = [(w or "").lower().strip(" ") for w in words]
    pairs = [(j, i) for i in range(len(words)) for j in range(i + 2, len(words)) if X.ratio(low[i], low[j]) >= 0.85]
    assert sorted((r.idx, r.like_idx) for r in agents.similar_thoughts(s).collect()) == sorted(pairs)


def test_react_and_cot():
    got = agents.react_steps("Thought: look\nAction: search\nAction Input: {'q': 1}\nObservation: found\nFinal Answer: yes")
    assert [s["step_type"] for s in got] == ["thought", "action", "observation", "final_answer"]
    assert got[1]["output"] == "found" and json.loads(got[1]["args"]) == {"q": 1}
    assert agents.react_steps("Action: x") == []
    assert agents.action_input("a: 1, b: two") == {"a": "1", "b": "two"} and agents.action_input("zzz") == {"raw": "zzz"}
    got = agents.cot_steps("1. first\n2. second\nAnswer: 42")
    assert [s["content"] for s in got] == ["first", "second", "42"]
    assert agents.cot_steps("") == []


def test_parsed_steps(spark):
    df = spark.createDataFrame([("t", "Thought: a\nFinal Answer: b")], "trace string, text string")
    assert [(r.idx, r.content) for r in agents.parsed_steps(df).orderBy("idx").collect()] == [(0, "a"), (1, "b")]


def test_repeated_key_is_an_error(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "y")], "key string, v string")
    with pytest.raises(Exception, match="repeated key"):
        E.dataset_diff(a, a, "key", ["v"]).collect()


def test_lists_are_compared_without_order(spark):
    kind = "key string, docs array<string>, answer string"
    a, b = spark.createDataFrame([("k", ["x", "y"], "1"), ("m", ["x"], "1")], kind), spark.createDataFrame([("k", ["y", "x"], "1"), ("m", ["z"], "2")], kind)
    assert {r.key: (r.change, r.fields) for r in E.dataset_diff(a, b, "key", ["docs", "answer"]).collect()} == {"k": ("unchanged", None), "m": ("modified", "docs,answer")}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.id, r.rank) for r in vectors.top_k(q, v, 3).orderBy("rank").collect()] == [(1, 1), (4, 2), (3, 3)]
    changes = spark.createDataFrame([(2, [5.0, 5.0], 1), (2, [6.0, 6.0], 2), (7, [1.0, 2.0], 1)], "id int, embedding array<float>, seq int")
    assert {r.id: list(r.embedding) for r in vectors.upserted(v, changes).collect()}[2] == [6.0, 6.0]
    assert vectors.deleted(v, spark.createDataFrame([(1,)], "id int")).count() == 3


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[100:130] = x[5]  # many equal ones: ties go to the smaller id
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, embedding array<double>").repartition(5)
    q = v.where("id % 20 = 5").withColumnRenamed("id", "query_id")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(n @ n.T, 9)
    want = {i: sorted(range(400), key=lambda j: (-score[i, j], j))[:7] for i in range(5, 400, 20)}
    whole = lambda df: {i: [r.id for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])] for rows in [df.collect()] for i in want}
    assert whole(vectors.top_k(q, v, 7)) == want
    monkeypatch.setattr(vectors, "BLOCK", 6)
    monkeypatch.setattr(vectors, "VECTORS", 90)
    assert whole(vectors.top_k(q, v, 7)) == want
    near = whole(vectors.top_k_approximate(q, v, 7, dimensions=8, bits=4, probes=8))
    assert sum(len(set(near[i]) & set(want[i])) for i in want) >= 0.9 * 7 * len(want)


def test_percentiles_of_groups(spark):
    rows = [(k % 3, float((k * 7919) % 1000) if k % 3 else 5.0) for k in range(1500)] + [(7, 1.0), (7, 2.0), (8, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in quantiles.latency_percentiles(df, "v", ["g"]).collect()}
    for g in (1, 2):
        q = statistics.quantiles([v for a, v in rows if a == g], n=100)
        assert (got[g].p50, got[g].p95, got[g].p99) == (pytest.approx(q[49]), pytest.approx(q[94]), pytest.approx(q[98]))
    assert (got[0].p50, got[0].p99, got[0].n) == (5.0, 5.0, 500) and (got[7].p50, got[7].p95) == (1.0, 2.0)
    assert 9 not in got and math.isnan(got[8].p50)


def test_llm_and_cache(spark):
    p = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    empty = spark.createDataFrame([], "key string, answer string")
    out, new = datasets.cached(p, empty)
    assert out.count() == 3 and new.count() == 2
    again, more = datasets.cached(p, new)
    assert more.count() == 0 and {r.answer for r in again.collect()} == {r.answer for r in out.collect()}

    def fails(prompts):
        raise RuntimeError("down")

    assert all(r.answer is None and "down" in r.error for r in datasets.answered(p, fails).collect())
    docs = spark.createDataFrame([(k, "x" * 200) for k in range(5)], "doc_id int, text string")
    assert datasets.generated_questions(docs, 7).count() == 5


def test_testset(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q1", "relevant_docs": ["d1"], "extra": 1}\n\n{"text": "", "query": "q2", "ground_truth": "d2", "answer": "x"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"queries": [{"text": "q1", "ground_truth_docs": ["d1"]}, {"text": "q3"}]}))
    a = files.read_testset(spark, str(tmp_path / "a.jsonl")).orderBy("text").collect()
    assert [(r.text, r.ground_truth_docs, r.expected_answer) for r in a] == [("q1", ["d1"], None), ("q2", ["d2"], "x")]
    assert a[0].metadata == {"extra": "1"}
    assert files.read_testset(spark, str(tmp_path / "b.json")).count() == 2
    assert cli.main(["diff", str(tmp_path / "a.jsonl"), str(tmp_path / "b.json")], spark) == 0
    (tmp_path / "c.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="not JSON"):
        files.read_testset(spark, str(tmp_path / "c.jsonl")).collect()


def test_golden_and_bundle(spark, tmp_path):
    (tmp_path / "g.csv").write_text("id,question,answer,tags,source_docs\n1,q,a,x;y,d1\n")
    g = files.read_golden(spark, str(tmp_path / "g.csv")).first()
    assert g.tags == ["x", "y"] and g.source_docs == ["d1"] and g.difficulty is None
    (tmp_path / "g.json").write_text(json.dumps({"questions": [{"id": "1", "question": "q", "tags": ["x"]}]}))
    assert files.read_golden(spark, str(tmp_path / "g.json")).first().tags == ["x"]
    b = tmp_path / "bundle"
    b.mkdir()
    (b / "manifest.json").write_text('{"schema_version": "1"}')
    (b / "documents.jsonl").write_text('{"id": "d", "content": "c", "title": "t"}\n')
    row = files.read_bundle(spark, str(b)).first()
    assert (row.id, row.content, row.metadata) == ("d", "c", {"title": "t"})
    f = tmp_path / "texts"
    (f / "sub").mkdir(parents=True)
    (f / "one.txt").write_text("hello")
    (f / "sub" / "two.md").write_text("there")
    (f / "blank.txt").write_text("  ")
    assert sorted(r.id for r in files.read_folder(spark, str(f)).collect()) == ["one", "two"]


def make_traces(tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / "a.json").write_text("\n".join(json.dumps({"id": str(i), "ts": t, "tenant": "t", "latency_ms": float(v), "success": v < 50}) for i, t, v in rows))
    return str(folder)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 40, f"2024-01-01T{k % 5:02d}:{k % 60:02d}:00Z", (k % 40) * 2) for k in range(50)]
    src = make_traces(tmp_path, [(i, f"2024-01-01T{i % 5:02d}:{i % 60:02d}:00Z", i * 2) for i, _, _ in rows])
    raw, hourly = str(tmp_path / "raw"), str(tmp_path / "hourly")
    S.land(S.unique(S.read_stream(spark, src)), raw, hourly, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(raw).count() == 40
    got = {r.hour: (r.total, r.p50) for r in spark.read.parquet(hourly).collect()}
    want = {r.hour: (r.total, r.p50) for r in M.hourly(spark.read.parquet(raw)).collect()}
    assert got == want and len(got) == 5


def test_cooldown_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("r", base + dt.timedelta(minutes=m), 1.0) for m in (0, 3, 6, 9, 14)]
    df = spark.createDataFrame(rows, "name string, at timestamp, value double")
    batch = sorted(r.at for r in M.cooled(df, 5).collect())
    df.coalesce(1).write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "alerts"))
    S.cooled(stream, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.at for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch
    assert [b.minute for b in batch] == [0, 6, 14]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert store.history(spark, path).count() == 0
    store.append_history(spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "c", "h", {"m": 1.0}, False)], "id string, ts timestamp, config string, testset_hash string, metrics map<string,double>, is_baseline boolean"), path)
    assert M.with_baseline(store.history(spark, path), "c", "1").first().is_baseline


def test_reports(spark):
    df = spark.createDataFrame([("<a>", 0.5, "pass")], "config string, value double, status string")
    assert "&lt;a&gt;" in reports.as_html(df, "t") and "0.5000" in reports.console(df, "t")
    assert json.loads(reports.as_json(df, k=1))["rows"][0]["value"] == 0.5
    assert reports.markdown(df).startswith("| config")
    chart = reports.mermaid(steps(spark, [("t", 1, "thought", None, None, None, "a"), ("t", 2, "final_answer", None, None, None, "b")])).first().chart
    assert "s1 --> s2" in chart


def test_cli(spark, sf_dir, capsys, tmp_path):
    assert cli.main(["version"]) == 0
    assert cli.main(["run", "eval_summary", sf_dir], spark) == 0
    assert cli.main(["run", "nothing", sf_dir], spark) == 3
    spark.createDataFrame([("q", ["a"], ["b"])], "query_id string, retrieved array<string>, relevant array<string>").write.parquet(str(tmp_path / "runs"))
    assert cli.main(["--json", "evaluate", str(tmp_path / "runs"), "--fail-under", "0.5"], spark) == 1


def test_pipeline_retries_and_limits(spark):
    import time

    from tessel.operators import running

    def pipeline(question):
        if question == "slow":
            time.sleep(1.5)
        if question == "bad":
            raise ValueError("no")
        return ["a", "b"], f"said {question}"

    q = spark.createDataFrame([("x", ["a"]), ("bad", ["a"]), ("slow", ["a"])], "text string, ground_truth_docs array<string>").coalesce(1)
    got = {r.text: r for r in running.evaluate(q, pipeline, 2, retries=1, delay=0.01, timeout=0.3, concurrency=2).collect()}
    assert (got["x"].precision, got["x"].answer, got["x"].error, got["x"].attempts) == (0.5, "said x", None, 1)
    assert got["bad"].precision == 0 and got["bad"].error == "ValueError: no" and got["bad"].attempts == 2 and got["bad"].answer == ""
    assert "timed out" in got["slow"].error and got["slow"].ndcg == 0
    both = running.compare(q.where("text = 'x'"), {"one": pipeline, "two": lambda t: ([], "")}, 2)
    assert {r.config: r.recall for r in both.collect()} == {"one": 1.0, "two": 0.0}
    assert [r["text"] for r in running.evaluate_stream(q.where("text = 'x'"), pipeline, 2)] == ["x"]


def test_runs(spark):
    from tessel.operators import running

    runs = running.created(spark, "r1", "set", 5, "f").unionByName(running.created(spark, "r2", "set", 5, "f"))
    runs = running.moved(runs, "r1", "running")
    done = running.moved(runs, "r1", "completed", metrics={"mrr": 0.5}, duration_ms=3)
    got = {r.run_id: r for r in done.collect()}
    assert (got["r1"].status, got["r1"].metrics, got["r1"].duration_ms, got["r2"].status) == ("completed", {"mrr": 0.5}, 3.0, "pending")
    with pytest.raises(Exception, match="can't become running from completed"):
        running.moved(done, "r1", "running").collect()
    assert running.moved(runs, "r2", "failed", error="x").where("run_id = 'r2'").first().error == "x"


def test_registry_and_config(spark, tmp_path):
    from tessel.registry import Registry, name_of
    from tessel.sources import config

    class QuickLLM:
        is_local = True

    r = Registry()
    assert r.add(QuickLLM, "llm") == "quick" and r.get("Quick") is QuickLLM and r.names("llm", local=True) == ["quick"] and r.names("evaluator") == []
    assert name_of(type("ChromaVectorStore", (), {})) == "chroma" and r.scan("tessel.none") == []
    with pytest.raises(KeyError, match="no adapter"):
        r.get("other")
    with pytest.raises(ValueError):
        r.add(QuickLLM, "thing")
    assert config.gating(spark).count() == 7
    (tmp_path / "g.json").write_text('{"gating": {"stable": {"mrr": 0.4}}}')
    assert [tuple(x) for x in config.gating(spark, str(tmp_path / "g.json")).collect()] == [("mrr", 0.4, True)]
    (tmp_path / "e.json").write_text("  ")
    assert config.gating(spark, str(tmp_path / "e.json")).count() == 7
    config.write_gating(config.gating(spark), str(tmp_path / "out"))
    assert config.gating(spark, str(tmp_path / "out")).count() == 7


def test_trajectories(spark):
    s = steps(spark, [("t", 1, "thought", None, None, None, "a <b>"), ("t", 2, "action", "find", "", "bad & gone", "c\nd"), ("t", 3, "final_answer", None, None, None, None)])
    assert reports.ascii_tree(s).first().text == "|-- [thought] a <b>\n|-x [action] find: c d\n`-* [final_answer] "
    html = reports.trajectory_html(s).first().html
    assert "a &lt;b&gt;" in html and "<em>bad &amp; gone</em>" in html and html.startswith("<ol>")


def test_judging_of_faults(spark):
    from tessel.operators import judging as J

    rows = spark.createDataFrame([("a", "ctx", "q", "One. Two"), ("b", "", "q", "x"), ("c", "ctx", "", "x"), ("d", "ctx", "q", "  ")], "id string, context string, question string, response string")

    def broken(prompts):
        return ["not a list" for _ in prompts]

    got = {r.id: (r.score, r.n_claims) for r in J.faithfulness(rows, broken).collect()}
    assert got == {"a": (1.0, 0), "b": (0.0, 0), "c": (1.0, 0), "d": (1.0, 0)}
    assert {r.id: r.score for r in J.hallucination(rows, broken).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0}
    assert {r.id: r.score for r in J.relevance(rows, broken).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0, "d": 0.0}
    assert {r.raw for r in J.judged(rows, broken).collect()} == {3} and J.judge_overall(rows, broken).count() == 4
    assert J.fallback_model(["p7", "m"], ["m:latest", "x"]) == "m:latest" and J.fallback_model(["z"], ["m"]) is None
    one = steps(spark, [("t", 1, "thought", None, None, None, "a")])
    assert J.coherence(one, broken).first().score == 1.0


def test_some_prompts_fail(spark):
    def half(prompts):
        if any(p.startswith("x") for p in prompts):
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    p = spark.createDataFrame([("a",), ("x1",), ("b",)], "prompt string").coalesce(1)
    assert {r.prompt: (r.answer, bool(r.error)) for r in datasets.answered(p, half).collect()} == {"a": ("A", False), "b": ("B", False), "x1": (None, True)}


def test_traces_are_appended_by_their_days(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = spark.createDataFrame([(str(k), dt.datetime(2024, 1, 1 + k % 3), "t", None, 1.0, True, None, None) for k in range(9)], store.TRACES)
    store.append_traces(rows, path)
    store.append_traces(rows.unionByName(rows.limit(1).withColumn("id", F.lit("new"))), path)
    assert spark.read.parquet(path).count() == 10
