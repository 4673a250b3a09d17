"""Thresholds of a gate from a file: JSON, or YAML where PyYAML is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Thresholds where a file says nothing.
STABLE = {"precision": 0.8, "recall": 0.8, "mrr": 0.8, "ndcg": 0.8}
UNSTABLE = {"faithfulness": 0.7, "relevance": 0.7, "hallucination": 0.3}


def parsed(text: str) -> dict | None:
    try:
        return json.loads(text) if text.strip() else None
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError("not JSON, and PyYAML isn't installed") from missing
        return yaml.safe_load(text)


def gating(spark: SparkSession, path: str | None = None) -> DataFrame:
    """metric, threshold, stable for :func:`tessel.operators.evaluation.gate`.  Without a file, or with an empty one, the
    thresholds above; a section that a file lacks has none.  The file may have them under ``gating`` or at its top."""
    data = parsed(spark.read.text(path, wholetext=True).first()[0]) if path else None
    own = {"stable": STABLE, "unstable": UNSTABLE} if data is None else data.get("gating", data) or {}
    rows = [(m, float(v), kind == "stable") for kind in ("stable", "unstable") for m, v in (own.get(kind) or {}).items()]
    return spark.createDataFrame(rows, "metric string, threshold double, stable boolean")


def write_gating(thresholds: DataFrame, path: str) -> None:
    """A gate's thresholds as JSON in a folder."""
    rows = thresholds.collect()  # a list that people write
    data = {"gating": {kind: {r["metric"]: r["threshold"] for r in rows if r["stable"] == (kind == "stable")} for kind in ("stable", "unstable")}}
    thresholds.sparkSession.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)
