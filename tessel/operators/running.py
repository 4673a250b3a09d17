"""Running a pipeline over a test set: retries, delays and time limits of each query, streams, and the record of a run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import evaluation as E

#: A pipeline takes a question and gives the retrieved documents' identifiers and an answer.
Pipeline = Callable[[str], tuple[list[str], str]]

RESULT = "retrieved array<string>, answer string, latency_ms double, error string, attempts int"


def attempt(pipeline: Pipeline, question: str, retries: int, delay: float, timeout: float | None) -> tuple:
    """One query: documents, answer, latency, error and number of attempts.  An attempt beyond the time limit is left to
    itself and counts as failed; between attempts there is a constant delay."""
    error = None
    for n in range(retries + 1):
        began = time.perf_counter()
        pool = ThreadPoolExecutor(1) if timeout is not None else None
        try:
            found, answer = pool.submit(pipeline, question).result(timeout) if pool else pipeline(question)
            return list(found), answer, (time.perf_counter() - began) * 1000, None, n + 1
        except Late:
            error = f"timed out after {timeout}s"
        except Exception as fault:  # noqa: BLE001  whatever a pipeline throws is the query's error
            error = f"{type(fault).__name__}: {fault}"
        finally:
            if pool:
                pool.shutdown(wait=False, cancel_futures=True)
        if n < retries:
            time.sleep(delay)
    return [], "", 0.0, error, retries + 1


def run_queries(queries: DataFrame, pipeline: Pipeline, *, text: str = "text", retries: int = 0, delay: float = 1.0, timeout: float | None = None, concurrency: int = 1) -> DataFrame:
    """Adds retrieved, answer, latency_ms, error and attempts; each query fails for itself.  ``concurrency`` is within a
    task; tasks run side by side as the table has partitions."""
    names = {c.split()[0] for c in RESULT.split(", ")}
    kept = queries.select(*[c for c in queries.columns if c not in names])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(lambda q: attempt(pipeline, q, retries, delay, timeout), batch[text].tolist()))
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=["retrieved", "answer", "latency_ms", "error", "attempts"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, {RESULT}")


def evaluate(queries: DataFrame, pipeline: Pipeline, k: int = 10, **options) -> DataFrame:
    """Queries (text, ground_truth_docs) with what the pipeline gave and their measures, 0 for those that failed."""
    done = E.score_runs(run_queries(queries, pipeline, **options), k, relevant="ground_truth_docs")
    return done.withColumns({m: F.when(F.col("error").isNull(), F.col(m)).otherwise(0.0) for m in E.MEASURES})


def compare(queries: DataFrame, pipelines: dict[str, Pipeline], k: int = 10, **options) -> DataFrame:
    """The results of several pipelines on the same queries, by config and config_idx."""
    out = None
    for n, (name, pipeline) in enumerate(pipelines.items()):
        part = evaluate(queries, pipeline, k, **options).withColumns({"config": F.lit(name), "config_idx": F.lit(n)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no pipeline to compare")
    return out


def evaluate_stream(queries: DataFrame, pipeline: Pipeline, k: int = 10, **options) -> Iterator[dict]:
    """Results one by one as they are done, a partition at a time."""
    for row in evaluate(queries, pipeline, k, **options).toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


# ------------------------------------------------------------------------------------------------------------- run records

RUNS = "run_id string, status string, dataset_name string, dataset_size long, fingerprint string, metrics map<string,double>, duration_ms double, error string, updated_at timestamp"
#: What a run may become.
NEXT = {"pending": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


def created(spark, run_id: str, dataset_name: str, dataset_size: int, fingerprint: str) -> DataFrame:
    row = spark.createDataFrame([(run_id, "pending", dataset_name, dataset_size, fingerprint, None, None, None)], RUNS.rpartition(", ")[0])
    return row.withColumn("updated_at", F.current_timestamp())


def moved(runs: DataFrame, run_id: str, status: str, *, metrics: dict[str, float] | None = None, duration_ms: float | None = None, error: str | None = None) -> DataFrame:
    """The table with one run's new status; a step that isn't allowed is an error of the row."""
    mine = F.col("run_id") == run_id
    before = [s for s, after in NEXT.items() if status in after]
    allowed = F.when(mine & ~F.col("status").isin(*before), F.raise_error(F.concat(F.lit(f"run {run_id} can't become {status} from "), "status")).cast("boolean")).otherwise(True)
    values = {"status": F.lit(status), "error": F.lit(error), "updated_at": F.current_timestamp()}
    if metrics is not None:
        values["metrics"] = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair]).cast("map<string,double>")
    if duration_ms is not None:
        values["duration_ms"] = F.lit(float(duration_ms))
    return runs.where(allowed).withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()})


# -------------------------------------------------------------------------------------------------------------- cache


def cache_key(text, documents, pipeline_id="default", k: int = 10):
    """Key of a cached result: the question, its documents in any order, the pipeline and k (columns)."""
    return F.substring(F.sha2(F.concat_ws("\u0001", text, F.array_join(F.array_sort(documents), "\u0002"), F.coalesce(F.lit(None) if pipeline_id is None else F.lit(pipeline_id), F.lit("default")), F.lit(str(k))), 256), 1, 32)


def cache_stats(keys: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row: hits, misses, size of the cache and hit rate (0 without look-ups)."""
    found = keys.select(key).join(cache.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    looked = found.agg(F.coalesce(F.sum("__hit"), F.lit(0)).cast("long").alias("hits"), F.count(F.when(F.col("__hit").isNull(), 1)).alias("misses"))
    return looked.join(cache.agg(F.count("*").alias("size")), F.lit(True)).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))  # a row each
