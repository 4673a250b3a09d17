"""Agent trajectories as step tables: (trace, idx, step_type, tool, args, error, content)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import ratio


def bag_match(actual: DataFrame, expected: DataFrame, *, trace: str = "trace", tool: str = "tool", order: str = "idx") -> DataFrame:
    """Each actual call takes the first expected call of its name that is still free: the n-th of a name meets the n-th."""
    number = lambda df: df.withColumn("__rn", F.row_number().over(Window.partitionBy(trace, tool).orderBy(order)))
    a = number(actual)
    b = number(expected).select(trace, tool, "__rn", F.col(order).alias("expected_idx"), *[c for c in expected.columns if c not in (trace, tool, order)])
    return a.join(b, [trace, tool, "__rn"], "left").withColumn("matched", F.col("expected_idx").isNotNull()).drop("__rn")


def tool_metrics(actual: DataFrame, expected: DataFrame | None = None, *, trace: str = "trace", tool: str = "tool") -> DataFrame:
    """precision, recall and f1 of each trace by counts of calls.  Without calls and expectations all are 1, without calls
    0; where nothing is expected recall is 1.  Without ``expected`` (nothing is known of it) they are null.

    The bag intersection needs only counts of each name, so it is two small aggregates and a join of them.
    """
    a = actual.groupBy(trace, tool).agg(F.count("*").alias("__a"))
    if expected is None:
        none = F.lit(None).cast("double")
        return a.groupBy(trace).agg(F.sum("__a").alias("n_actual")).withColumns({"precision": none, "recall": none, "f1": none})
    b = expected.groupBy(trace, tool).agg(F.count("*").alias("__b"))
    both = a.join(b, [trace, tool], "full_outer").select(trace, F.coalesce("__a", F.lit(0)).alias("a"), F.coalesce("__b", F.lit(0)).alias("b"))
    agg = both.groupBy(trace).agg(F.sum("a").alias("n_actual"), F.sum("b").alias("n_expected"), F.sum(F.least("a", "b")).alias("n_matched"))
    none = (F.col("n_actual") == 0) & (F.col("n_expected") == 0)
    p = F.when(none, 1.0).when(F.col("n_actual") == 0, 0.0).otherwise(F.try_divide("n_matched", "n_actual"))
    r = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.try_divide("n_matched", "n_expected"))
    counts = {"n_unnecessary": F.col("n_actual") - F.col("n_matched"), "n_missing": F.col("n_expected") - F.col("n_matched")}
    return agg.withColumns({"precision": p, "recall": r} | counts).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def argument_presence(matched: DataFrame, *, args: str = "args", required: str = "required_args") -> Column:
    """Share of the required argument names (an array) that a call's arguments (a map) have; 1 where none is required."""
    need = F.coalesce(F.col(required), F.array().cast("array<string>"))
    have = F.size(F.filter(need, lambda n: F.coalesce(F.array_contains(F.map_keys(F.col(args)), n), F.lit(False))))
    return F.when(F.size(need) == 0, 1.0).otherwise(have / F.size(need))


def call_score(name_correct: Column, args_share: Column, success: Column) -> Column:
    return 0.4 * name_correct.cast("double") + 0.3 * args_share + 0.3 * success.cast("double")


def success_rates(steps: DataFrame, *, trace: str = "trace") -> DataFrame:
    """Success and error rate of each trace's tool calls; 1 and 0 without any."""
    call = F.col("step_type") == "action"
    ok = F.avg(F.when(call, F.col("error").isNull().cast("double")))
    return steps.groupBy(trace).agg(F.coalesce(ok, F.lit(1.0)).alias("success_rate"), (1.0 - F.coalesce(ok, F.lit(1.0))).alias("error_rate"), F.sum(call.cast("long")).alias("n_calls"))


def _ordered(trace: str, order: str):
    return Window.partitionBy(trace).orderBy(order)


def loops(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """Tool calls with the name and arguments of the step just before (``start``); any other step in between ends the run."""
    call = F.when(F.col("step_type") == "action", F.concat_ws("\u0001", "tool", F.coalesce("args", F.lit(""))))
    w = _ordered(trace, order)
    rows = steps.withColumn("__s", call).withColumns({"__p": F.lag("__s").over(w), "start": F.lag(order).over(w)})
    return rows.where("__s = __p").drop("__s", "__p")


def dead_ends(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """Failed tool calls whose tool isn't called again in the next two steps; none in traces of fewer than two steps."""
    w = _ordered(trace, order)
    name = F.when(F.col("step_type") == "action", F.col("tool"))
    rows = steps.withColumns({"__n1": F.lead(name, 1).over(w), "__n2": F.lead(name, 2).over(w), "__n": F.count("*").over(Window.partitionBy(trace))})
    again = F.coalesce(F.col("__n1") == F.col("tool"), F.lit(False)) | F.coalesce(F.col("__n2") == F.col("tool"), F.lit(False))
    return rows.where((F.col("step_type") == "action") & F.col("error").isNotNull() & ~again & (F.col("__n") >= 2)).drop("__n1", "__n2", "__n")


def failures(steps: DataFrame, *, trace: str = "trace", order: str = "idx", similar: float | None = None) -> DataFrame:
    """Tool errors, loops (where they start) and dead ends, in the order of steps and then of these kinds.  With ``similar``
    thoughts of like content, not next to each other, are loops too."""
    looped = loops(steps, trace=trace, order=order).select(trace, F.col("start").alias(order), "tool")
    if similar is not None:
        again = similar_thoughts(steps.withColumnsRenamed({trace: "trace", order: "idx"}), limit=similar)
        looped = looped.unionByName(again.select(F.col("trace").alias(trace), F.col("like_idx").cast(steps.schema[order].dataType).alias(order), F.lit(None).cast("string").alias("tool")))
    kinds = ((0, "tool_error", "error", steps.where((F.col("step_type") == "action") & F.col("error").isNotNull())), (1, "loop", "warning", looped), (2, "dead_end", "warning", dead_ends(steps, trace=trace, order=order)))
    out = None
    for n, kind, severity, rows in kinds:
        part = rows.select(trace, order, F.lit(n).alias("kind_no"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "tool")
        out = part if out is None else out.unionByName(part)
    return out


def counts_by(steps: DataFrame, column: str, *, trace: str = "trace") -> DataFrame:
    """How many steps of each trace have each value of a column (tool: calls of each tool; step_type: steps of each kind)."""
    rows = steps.where("step_type = 'action'") if column == "tool" else steps
    return rows.groupBy(trace, column).agg(F.count("*").alias("n"))


def summary(steps: DataFrame, *, trace: str = "trace") -> DataFrame:
    """Steps, calls, failed calls, thoughts and distinct tools of each trace."""
    action = F.col("step_type") == "action"
    return steps.groupBy(trace).agg(F.count("*").alias("n_steps"), F.sum(action.cast("long")).alias("n_actions"), F.sum((action & F.col("error").isNotNull()).cast("long")).alias("n_failed"), F.sum((F.col("step_type") == "thought").cast("long")).alias("n_thoughts"), F.count_distinct(F.when(action, F.col("tool"))).alias("n_tools"))


def transitions(steps: DataFrame, *, trace: str = "trace", order: str = "idx", cut: int = 500) -> DataFrame:
    """Neighbouring steps, contents cut for a judge's prompt."""
    w = _ordered(trace, order)
    return steps.select(trace, order, F.substring("content", 1, cut).alias("content"), F.substring(F.lead("content").over(w), 1, cut).alias("next_content"), F.lead(order).over(w).alias("next_idx")).where(F.col("next_idx").isNotNull())


def efficiency(optimal: Column, actual: Column, redundant: Column, looped: Column) -> Column:
    base = F.when(actual > 0, F.least(F.lit(1.0), optimal / actual)).otherwise(1.0)
    return F.least(F.greatest(base - 0.1 * redundant - 0.15 * looped, F.lit(0.0)), F.lit(1.0))


def goal_progress(scored: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """Last progress of each trace, and whether it never fell."""
    before = F.lag("progress").over(_ordered(trace, order))
    return scored.withColumn("__ok", F.coalesce(F.col("progress") >= before, F.lit(True))).groupBy(trace).agg(F.max_by("progress", order).alias("progress"), F.bool_and("__ok").alias("monotonic"))


REDUNDANT = "trace string, idx long, like_idx long, similarity double"


#: Steps of a trace that one task compares at a time.
PORTION = 500


def _portions(steps: DataFrame) -> DataFrame:
    """Steps with contents that aren't blank, by trace in portions of their order."""
    rows = steps.select(F.col("trace").cast("string").alias("trace"), F.col("idx").cast("long").alias("idx"), "content")
    number = F.row_number().over(Window.partitionBy("trace").orderBy("idx")) - 1
    return rows.withColumn("portion", F.floor(number / PORTION).cast("long"))


def _pairs_like(rows: DataFrame, limit: float, apart: int) -> DataFrame:
    """trace, idx, like_idx (the earlier step) and similarity of pairs of steps of like content.  Portions meet two by two,
    each pair of them in a group of its own, so a trace of any length is spread over tasks."""
    counts = rows.groupBy("trace").agg((F.max("portion") + 1).alias("portions"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1))
    met = rows.join(counts, "trace").withColumn("other", other).withColumns({"low": F.least("portion", "other"), "high": F.greatest("portion", "other")})

    def run(group):
        import pandas as pd

        own = list(group.sort_values("idx")[["idx", "content", "portion"]].itertuples(index=False))
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        name, out = str(group["trace"].iloc[0]), []
        for n, (i, a, p) in enumerate(own):
            for j, b, q in own[n + 1 :]:
                if {p, q} == {low, high} and j - i > apart and (r := ratio(a or "", b or "")) >= limit:
                    out.append((name, j, i, r))
        return pd.DataFrame(out, columns=["trace", "idx", "like_idx", "similarity"])

    return met.groupBy("trace", "low", "high").applyInPandas(run, REDUNDANT)


def redundant_steps(steps: DataFrame, *, limit: float = 0.8) -> DataFrame:
    """Steps whose content is like one that was kept before (the first of these).

    Likeness is found for all pairs of a trace's steps; which of them are kept is a fold over the like pairs alone."""
    like = _pairs_like(_portions(steps.where("trim(coalesce(content, '')) <> ''")), limit, 0)

    def fold(group):
        import pandas as pd

        gone, out = set(), []
        for (name, idx), own in group.sort_values(["idx", "like_idx"]).groupby(["trace", "idx"], sort=True):
            kept = [(k, r) for k, r in own[["like_idx", "similarity"]].itertuples(index=False) if k not in gone]
            if kept:
                gone.add(idx)
                out.append((name, idx, *kept[0]))
        return pd.DataFrame(out, columns=["trace", "idx", "like_idx", "similarity"])

    return like.groupBy("trace").applyInPandas(fold, REDUNDANT)


def similar_thoughts(steps: DataFrame, *, limit: float = 0.85) -> DataFrame:
    """Pairs of thoughts of a trace, not next to each other, of like content in lower case and without outer spaces."""
    thoughts = steps.where("step_type = 'thought'").withColumn("content", F.trim(F.lower("content")))
    return _pairs_like(_portions(thoughts), limit, 1)


# ------------------------------------------------------------------------------------------------------------- parsers

STEP = "step_type string, content string, tool string, args string, output string"
_FIELD = re.compile(r"^\s*(Thought|Action Input|Action|Observation|Final Answer)\s*:\s*(.*)$", re.I)


def action_input(text: str) -> dict:
    """Arguments of a call: JSON, JSON with single quotes, ``key: value`` pairs, else the raw text."""
    text = text.strip()
    if not text:
        return {}
    for attempt in (text, text.replace("'", '"')):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        return value if isinstance(value, dict) else {"value": value}
    pairs = re.findall(r"(\w+)\s*[:=]\s*(\"[^\"]*\"|'[^']*'|[^,\n]+)", text)
    return {k: v.strip().strip("\"'") for k, v in pairs} if pairs else {"raw": text}


def react_steps(text: str) -> list[dict]:
    """Steps of a transcript of labelled lines.  An action counts once its input line has come; what is observed becomes
    the output of the last call."""
    fields: list[list[str]] = []
    for line in (text or "").splitlines():
        found = _FIELD.match(line)
        if found:
            fields.append([found[1].lower(), found[2]])
        elif fields:
            fields[-1][1] += "\n" + line
    steps, tool, last = [], None, None
    for kind, body in fields:
        body = body.strip()
        step = {"step_type": None, "content": body, "tool": None, "args": None, "output": None}
        if kind == "thought":
            step["step_type"] = "thought"
        elif kind == "action":
            tool = body
            continue
        elif kind == "action input":
            if not tool:
                continue
            step |= {"step_type": "action", "content": f"{tool}({body})", "tool": tool, "args": json.dumps(action_input(body), sort_keys=True, ensure_ascii=False)}
            last, tool = step, None
        elif kind == "observation":
            step["step_type"] = "observation"
            if last is not None and last["output"] is None:
                last["output"] = body
        else:
            step["step_type"] = "final_answer"
        steps.append(step)
    return steps


def cot_steps(text: str) -> list[dict]:
    """Steps of a chain of thought: numbered ones, else paragraphs, else sentences by twos; the last is the answer."""
    text = (text or "").strip()
    if not text:
        return []
    answer = re.search(r"(?is)\b(?:final answer|answer)\s*:\s*(.*)$", text)
    body = text[: answer.start()].strip() if answer else text
    parts = [p.strip() for p in re.split(r"(?m)^\s*(?:step\s*)?\d+[.):]\s*", body, flags=re.I) if p.strip()]
    if len(parts) < 2:
        parts = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
    if len(parts) < 2 and len(body) > 200:
        sentences = re.split(r"(?<=[.!?])\s+", body)
        parts = [" ".join(sentences[k : k + 2]) for k in range(0, len(sentences), 2)]
    if answer:
        final = answer[1].strip()
    elif parts:
        final = re.sub(r"(?i)^\s*(?:therefore|thus|so|hence|in conclusion)[,:]?\s*", "", parts.pop())
    else:
        final = ""
    blank = {"tool": None, "args": None, "output": None}
    return [{"step_type": "thought", "content": p} | blank for p in parts] + [{"step_type": "final_answer", "content": final} | blank]


def parsed_steps(transcripts: DataFrame, *, key: str = "trace", text: str = "text", style: str = "react") -> DataFrame:
    """Step rows (trace, idx, ...) of transcripts in batches."""
    import pandas as pd

    parse = {"react": react_steps, "cot": cot_steps}[style]

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in STEP.split(', '))}>>")
    def steps(part):
        return pd.Series([parse(t) for t in part])

    return transcripts.select(F.col(key).alias("trace"), F.posexplode(steps(F.col(text))).alias("idx", "s")).select("trace", "idx", "s.*")
