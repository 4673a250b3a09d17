"""Reports over small tables: console, JSON, HTML, markdown, mermaid.  All take rows that have been summarised."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that a report takes.
ROWS = 10_000


def rows_of(df: DataFrame) -> list[dict]:
    found = [r.asDict(recursive=True) for r in df.limit(ROWS + 1).collect()]
    if len(found) > ROWS:
        raise ValueError(f"a report of more than {ROWS} rows: summarise first")
    return found


def _cell(value: object) -> str:
    return f"{value:.4f}" if isinstance(value, float) else "" if value is None else str(value)


def console(df: DataFrame, title: str = "") -> str:
    rows = rows_of(df)
    names = df.columns
    table = [names, *[[_cell(r[n]) for n in names] for r in rows]]
    widths = [max(len(line[k]) for line in table) for k in range(len(names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in table]
    return "\n".join(([title, "=" * len(title)] if title else []) + [lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def as_json(df: DataFrame, **facts: object) -> str:
    """An envelope: what is given, and the rows."""
    return json.dumps(facts | {"rows": rows_of(df)}, default=str, ensure_ascii=False, indent=2)


def as_html(df: DataFrame, title: str) -> str:
    rows, names = rows_of(df), df.columns
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    colour = {"pass": "#2e7d32", "warn": "#ed6c02", "fail": "#c62828"}
    body = "".join("<tr>" + "".join(f'<td style="color:{colour.get(str(r[n]).lower(), "inherit")}">{html.escape(_cell(r[n]))}</td>' for n in names) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>"


def markdown(df: DataFrame) -> str:
    names = df.columns
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *[line([_cell(r[n]) for n in names]) for r in rows_of(df)]])


def diff_markdown(diff: DataFrame, top: int = 5) -> str:
    """Counts of a difference of runs, and its queries of largest change either way."""
    counts = diff.groupBy("change").count()
    worst = diff.where("change = 'degraded'").orderBy("mean_delta", "idx").limit(top)
    best = diff.where("change = 'improved'").orderBy(F.desc("mean_delta"), "idx").limit(top)
    pick = lambda d: d.select("idx", "mean_delta", "biggest")
    return f"## Changes\n\n{markdown(counts)}\n\n### Degraded\n\n{markdown(pick(worst))}\n\n### Improved\n\n{markdown(pick(best))}\n"


def mermaid(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """A flow chart for each trace; made in the table, so it isn't bound to small ones."""
    clean = F.regexp_replace(F.substring("content", 1, 40), r'["\[\]{}()<>|]', " ")
    node = F.concat(F.lit("  s"), F.col(order), F.lit('["'), F.col("step_type"), F.lit(": "), clean, F.lit('"]'))
    listed = steps.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), node.alias("n")))).alias("r"))
    edges = F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda x, i: F.concat(F.lit("  s"), F.get("r", i)["o"], F.lit(" --> s"), x["o"]))
    return listed.select(trace, F.concat_ws("\n", F.lit("flowchart TD"), F.transform("r", lambda x: x["n"]), edges).alias("chart"))


def reasoning_trace(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    line = F.concat(F.lit("["), F.col("step_type"), F.lit("] "), F.coalesce("content", F.lit("")))
    listed = steps.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("r"))
    return listed.select(trace, F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("text"))


def ascii_tree(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """A trajectory as indented lines for each trace, the last with a corner; made in the table."""
    sign = F.when(F.col("error").isNotNull(), "x").when(F.col("step_type") == "final_answer", "*").otherwise("-")
    text = F.regexp_replace(F.substring(F.coalesce("content", F.lit("")), 1, 60), r"\s+", " ")
    line = F.concat(sign, F.lit(" ["), F.col("step_type"), F.lit("] "), F.when(F.col("step_type") == "action", F.concat("tool", F.lit(": "))).otherwise(F.lit("")), text)
    listed = steps.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("r"))
    lines = F.transform("r", lambda x, i: F.concat(F.when(i == F.size("r") - 1, "`-").otherwise("|-"), x["l"]))
    return listed.select(trace, F.array_join(lines, "\n").alias("text"))


def trajectory_html(steps: DataFrame, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """A trajectory as an ordered list for each trace, escaped; made in the table."""

    def escaped(c):
        for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(code))
        return c

    item = F.concat(F.lit('<li class="'), F.col("step_type"), F.when(F.col("error").isNotNull(), " failed").otherwise(F.lit("")), F.lit('">'), escaped(F.coalesce("content", F.lit(""))), F.when(F.col("error").isNotNull(), F.concat(F.lit(" <em>"), escaped(F.col("error")), F.lit("</em>"))).otherwise(F.lit("")), F.lit("</li>"))
    listed = steps.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("l")))).alias("r"))
    return listed.select(trace, F.concat(F.lit("<ol>"), F.array_join(F.transform("r", lambda x: x["l"]), ""), F.lit("</ol>")).alias("html"))
