"""Test sets and golden sets: filters, distinct values, projections, pairs of documents, question generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def golden_filter(golden: DataFrame, *, tags: Iterable[str] = (), difficulty: str | None = None, priority: str | None = None, validated: bool | None = None) -> DataFrame:
    """All conditions hold; any of the tags suffices."""
    out = golden
    if tags := list(tags):
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if difficulty is not None:
        out = out.where(F.col("difficulty") == difficulty)
    if priority is not None:
        out = out.where(F.col("priority") == priority)
    if validated is not None:
        out = out.where(F.col("validated_by").isNotNull() if validated else F.col("validated_by").isNull())
    return out


def distinct_tags(golden: DataFrame) -> DataFrame:
    return golden.select(F.explode("tags").alias("tag")).where("tag <> ''").distinct()


def distinct_of(golden: DataFrame, column: str) -> DataFrame:
    return golden.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()


def by_category(queries: DataFrame, category: str) -> DataFrame:
    return queries.where(F.col("metadata")["category"] == category)


def by_difficulty(queries: DataFrame, difficulty: str) -> DataFrame:
    return queries.where(F.col("metadata")["difficulty"] == difficulty)


def found(rows: DataFrame, name: str, key: str = "id") -> DataFrame:
    """The row of an identifier, if there is one."""
    return rows.where(F.col(key) == name).limit(1)


def as_testset(golden: DataFrame) -> DataFrame:
    return golden.select(F.col("question").alias("text"), F.coalesce("source_docs", F.array().cast("array<string>")).alias("ground_truth_docs"), F.col("answer").alias("expected_answer"), F.create_map(F.lit("id"), F.col("id"), F.lit("difficulty"), F.coalesce("difficulty", F.lit(""))).alias("metadata"))


def long_documents(docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    return docs.where(F.char_length(text) >= least)


def document_pairs(docs: DataFrame, budget: int = 50, *, key: str = "doc_id") -> DataFrame:
    """The first pairs of documents in nested order of their keys: pair_no, a, b; at most ``budget``.

    All of them lie among the first documents: with m documents there are m (m - 1) / 2 pairs, but the first row alone
    can hold the budget, so budget + 1 documents are enough, and a top-k finds them.
    """
    first = docs.select(key).distinct().orderBy(key).limit(budget + 1)
    numbered = first.withColumn("__n", F.row_number().over(Window.orderBy(key)))
    a, b = numbered.select(F.col(key).alias("a"), F.col("__n").alias("i")), numbered.select(F.col(key).alias("b"), F.col("__n").alias("j"))
    joined = a.join(F.broadcast(b), F.col("i") < F.col("j"))  # budget + 1 rows on either side
    return joined.withColumn("pair_no", F.row_number().over(Window.orderBy("i", "j"))).where(F.col("pair_no") <= budget).select("pair_no", "a", "b")


# ------------------------------------------------------------------------------------------------------- generation, LLM

Provider = Callable[[list[str]], list[str]]


def fake_provider(prompts: list[str]) -> list[str]:
    """A stand-in without network: the same prompt, the same answer."""
    from zlib import crc32

    return [f"answer {crc32(p.encode()) % 10_000}" for p in prompts]


def answered(prompts: DataFrame, provider: Provider = fake_provider, *, prompt: str = "prompt", retries: int = 1, delay: float = 0.0) -> DataFrame:
    """Adds answer and error.  A batch is asked at once; if that still fails after its retries (with a constant delay before
    each) its prompts are asked one by one, and each that fails has null and its own error."""

    def asked(texts: list[str], times: int) -> tuple[list | None, str | None]:
        import time

        error = None
        for n in range(times):
            if n:
                time.sleep(delay)
            try:
                return list(provider(texts)), None
            except Exception as fault:  # noqa: BLE001  whatever a provider throws is a row's error
                error = f"{type(fault).__name__}: {fault}"
        return None, error

    def run(batches):
        for batch in batches:
            texts = batch[prompt].tolist()
            answers, error = asked(texts, retries + 1)
            errors: list[str | None] = [None] * len(texts)
            if answers is None:
                single = [asked([t], 1) for t in texts] if len(texts) > 1 else [(None, error)] * len(texts)
                answers, errors = [a[0] if a else None for a, _ in single], [e for _, e in single]
            yield batch.assign(answer=answers, error=errors)

    kept = prompts.select(*[c for c in prompts.columns if c not in ("answer", "error")])
    return kept.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, answer string, error string")


def cached(prompts: DataFrame, cache: DataFrame, provider: Provider = fake_provider, *, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Answers from the cache (key, answer) and, for what it lacks, from the provider; and the rows new to the cache.
    Errors aren't cached."""
    keyed = prompts.withColumn("key", F.sha2(prompt, 256))
    hits = keyed.join(cache.select("key", "answer"), "key").withColumn("error", F.lit(None).cast("string"))
    asked = answered(keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]), provider, prompt=prompt)
    misses = keyed.join(cache.select("key"), "key", "left_anti").join(asked.select("key", "answer", "error"), "key")
    return hits.unionByName(misses), asked.where("error is null").select("key", "answer")


def quota(target: int, documents: int) -> int:
    return min(3, max(1, target // max(documents, 1)))


def generated_questions(docs: DataFrame, target: int, provider: Provider = fake_provider, *, least: int = 100) -> DataFrame:
    """Questions for long enough documents, as many of each as the target asks for (3 at most), up to the target."""
    good = long_documents(docs, least)
    n = good.count()
    each = quota(target, n)
    prompts = good.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("no"), F.concat(F.lit("Write a question that this text answers.\n\n"), F.col("text")).alias("prompt"))
    done = answered(prompts, provider).where("error is null and answer <> '' and upper(answer) <> 'UNANSWERABLE'")
    return done.orderBy("doc_id", "no").limit(target).select("doc_id", "no", F.col("answer").alias("question"))


def resumed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: the table of results is the checkpoint."""
    return work.join(done.select(key).distinct(), key, "left_anti")
