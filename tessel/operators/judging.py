"""Judging with a model: claims and their support, relevance, criteria, coherence, and generated questions.

A provider is any function of a list of prompts (:data:`tessel.operators.datasets.Provider`); prompts are a column, answers
come in batches, and what they say is parsed by column expressions.  A call that fails leaves its error in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.operators import agents, datasets, evaluation as E
from tessel.operators.datasets import Provider, answered, fake_provider

#: What stands before the parts of a prompt.
RESPONSE, CONTEXT, CLAIM, QUESTION, STEP, NEXT = "\n[response]\n", "\n[context]\n", "\n[claim]\n", "\n[question]\n", "\n[step]\n", "\n[next]\n"
#: Criteria of the judge, and which part a criterion is held against.
CRITERIA = ("faithfulness", "relevance", "hallucination", "completeness")
#: Kinds of adversarial questions and what is expected of an answer.
ADVERSARIAL = (("out_of_scope", "refuse"), ("ambiguous", "clarify"), ("misleading", "correct"), ("boundary", "handle_gracefully"))


def blank(c: str) -> Column:
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) == ""


def prompt(task: str, **parts: Column) -> Column:
    marks = {"response": RESPONSE, "context": CONTEXT, "claim": CLAIM, "question": QUESTION, "step": STEP, "next": NEXT}
    return F.concat(F.lit(task), *[x for name, c in parts.items() for x in (F.lit(marks[name]), F.coalesce(c, F.lit("")))])


# --------------------------------------------------------------------------------------------------------------- claims


def extracted_claims(responses: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """id, context, claim_idx and claim of the statements of each response that can be held against a context; responses
    without text or context aren't asked about.  An answer that isn't a list gives no claim."""
    asked = responses.where(~blank("response") & ~blank("context")).select("id", "context", prompt("List the factual claims of this response as a JSON array of strings.", response=F.col("response")).alias("prompt"))
    listed = F.try_variant_get(X.json_array(F.col("answer")), "$", "array<string>")
    got = answered(asked, provider).select("id", "context", F.posexplode(F.filter(listed, lambda c: F.coalesce(c, F.lit("")) != "")).alias("claim_idx", "claim"))
    return got


def verified_claims(claims: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """Adds supported, reasoning and error; an answer without a verdict doesn't support."""
    asked = claims.withColumn("prompt", prompt('Does the context support the claim? Answer {"supported": true or false, "reasoning": "..."}.', claim=F.col("claim"), context=F.col("context")))
    said = X.json_object(F.col("answer"))
    return answered(asked, provider).select("id", "claim_idx", "claim", F.coalesce(F.try_variant_get(said, "$.supported", "boolean"), F.lit(False)).alias("supported"), F.coalesce(F.try_variant_get(said, "$.reasoning", "string"), F.lit("No reasoning provided.")).alias("reasoning"), "error")


def _supported_share(responses: DataFrame, provider: Provider) -> DataFrame:
    claims = verified_claims(extracted_claims(responses, provider), provider)
    return claims.groupBy("id").agg(F.count("*").alias("n_claims"), F.sum(F.col("supported").cast("long")).alias("n_supported"))


def faithfulness(responses: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """id, score, n_claims and what the score says; ``responses`` has id, response and context."""
    share = _supported_share(responses, provider)
    joined = responses.select("id", "response", "context").join(share, "id", "left")
    score = F.when(blank("response"), 1.0).when(blank("context"), 0.0).when(F.col("n_claims").isNull(), 1.0).otherwise(F.col("n_supported") / F.col("n_claims"))
    said = (
        F.when(blank("response"), "Empty response has no claims to verify.")
        .when(blank("context"), "No context provided to verify claims against.")
        .when(F.col("n_claims").isNull(), "No verifiable claims found in the response.")
        .when(F.col("n_supported") == F.col("n_claims"), "All claims in the response are supported by the context.")
        .when(F.col("n_supported") == 0, "None of the claims in the response are supported by the context.")
        .otherwise(F.concat(F.col("n_supported").cast("string"), F.lit(" out of "), F.col("n_claims").cast("string"), F.lit(" claims are supported by the context.")))
    )
    return joined.select("id", score.alias("score"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), said.alias("reasoning"))


def hallucination(responses: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """id, score (share of the claims without support) and n_claims; 1 without a context, 0 without response or claims."""
    share = _supported_share(responses, provider)
    joined = responses.select("id", "response", "context").join(share, "id", "left")
    score = F.when(blank("response"), 0.0).when(blank("context"), 1.0).when(F.col("n_claims").isNull(), 0.0).otherwise(1 - F.col("n_supported") / F.col("n_claims"))
    return joined.select("id", score.alias("score"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def relevance(responses: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """id, score and error by one call for each response (id, response, question): 0 without a response, 1 without a
    question, else what the answer says, within 0 and 1; 0 where it says no number."""
    rows = responses.select("id", "response", "question")
    asked = rows.where(~blank("response") & ~blank("question")).select("id", prompt('How well does the response address the question? Answer {"score": 0 to 1, "reasoning": "..."}.', question=F.col("question"), response=F.col("response")).alias("prompt"))
    said = F.try_variant_get(X.json_object(F.col("answer")), "$.score", "string").try_cast("double")
    got = answered(asked, provider).select("id", F.least(F.greatest(F.coalesce(said, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("__s"), "error")
    return rows.join(got, "id", "left").select("id", F.when(blank("response"), 0.0).when(blank("question"), 1.0).otherwise(F.col("__s")).alias("score"), "error")


# ---------------------------------------------------------------------------------------------------------------- judge


def judged(items: DataFrame, provider: Provider = fake_provider, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """id, criteria, raw, score, verdict, explanation and error: each item (id, question, context, response) by each
    criterion."""
    asked = items.withColumn("criteria", F.explode(F.array(*[F.lit(c) for c in criteria])))
    task = F.concat(F.lit("Judge the response by "), "criteria", F.lit('. Answer "Score: 1 to 5", "Verdict: PASS, PARTIAL or FAIL" and "Explanation: ...".'))
    asked = asked.select("id", "criteria", F.concat(task, prompt("", question=F.col("question"), context=F.col("context"), response=F.col("response"))).alias("prompt"))
    return answered(asked, provider).select("id", "criteria", X.judge_parse(F.coalesce("answer", F.lit(""))).alias("j"), "error").select("id", "criteria", "j.*", "error")


def judge_overall(items: DataFrame, provider: Provider = fake_provider) -> DataFrame:
    """Mean score and worst verdict over the criteria that could be judged."""
    return E.judge_overall(judged(items, provider).where("error is null").select("id", "score", "verdict"))


def fallback_model(wanted: list[str], available: list[str]) -> str | None:
    """The first wanted model that is there, by its name or the name before a tag."""
    for name in wanted:
        for found in available:
            if found == name or found.split(":")[0] == name:
                return found
    return None


def coherence(steps: DataFrame, provider: Provider = fake_provider, *, trace: str = "trace", order: str = "idx") -> DataFrame:
    """trace, score: the share of neighbouring steps whose transition the answer calls coherent; 1 for fewer than 2 steps."""
    asked = agents.transitions(steps, trace=trace, order=order).withColumn("prompt", prompt('Does the second step follow from the first? Answer {"is_coherent": true or false}.', step=F.col("content"), next=F.col("next_content")))
    said = F.coalesce(F.try_variant_get(X.json_object(F.col("answer")), "$.is_coherent", "boolean"), F.lit(False))
    share = answered(asked, provider).groupBy(trace).agg(F.avg(said.cast("double")).alias("__s"))
    return steps.select(trace).distinct().join(share, trace, "left").select(trace, F.coalesce("__s", F.lit(1.0)).alias("score"))


# ----------------------------------------------------------------------------------------------------------- generation


def _questions(asked: DataFrame, provider: Provider, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` entries of the list that an answer holds, those with text; failed calls give none."""
    listed = F.try_variant_get(X.json_array(F.col("answer")), "$", "array<string>")
    got = answered(asked, provider).where("error is null").select(*keys, F.posexplode(F.slice(listed, 1, most)).alias("no", "question"))
    return got.withColumn("question", F.trim("question")).where("question <> ''")


def multihop_questions(docs: DataFrame, target: int, provider: Provider = fake_provider, *, key: str = "doc_id", least: int = 100, pairs: int = 50) -> DataFrame:
    """a, b, no, question over the first pairs of long enough documents: as many of each pair as the target asks for (3 at
    most), up to the target."""
    good = datasets.long_documents(docs, least)
    found = datasets.document_pairs(good, pairs, key=key)  # ``pairs`` rows at most
    n = found.count()
    each = min(3, max(1, target // max(n, 1)))
    text = lambda side: good.select(F.col(key).alias(side), F.col("text").alias(f"text_{side}"))
    asked = found.join(text("a"), "a").join(text("b"), "b").select("pair_no", "a", "b", F.concat(F.lit(f"Write {each} questions that need both texts, as a JSON array of strings.\n[first]\n"), "text_a", F.lit("\n[second]\n"), "text_b").alias("prompt"))
    return _questions(asked, provider, ["pair_no", "a", "b"], each).orderBy("pair_no", "no").limit(target).select("a", "b", "no", "question")


def adversarial_questions(docs: DataFrame, target: int, provider: Provider = fake_provider, *, key: str = "doc_id", least: int = 50, kinds: tuple = ADVERSARIAL) -> DataFrame:
    """kind, expected (behaviour), no, question: for each kind one call about the first five long enough documents."""
    first = datasets.long_documents(docs, least).orderBy(key).limit(5)
    whole = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "text"))), lambda d: F.concat(F.lit("["), d["k"].cast("string"), F.lit("]\n"), d["text"])), "\n\n").alias("texts"), F.count("*").alias("n")).where("n > 0")
    each = max(1, target // len(kinds))
    spark = docs.sparkSession
    asked = spark.createDataFrame([(n, *k) for n, k in enumerate(kinds)], "kind_no int, kind string, expected string").join(F.broadcast(whole), F.lit(True))  # one row
    asked = asked.select("kind_no", "kind", "expected", F.concat(F.lit(f"Write {each} questions, as a JSON array of strings, that are "), "kind", F.lit(" for these texts.\n"), "texts").alias("prompt"))
    return _questions(asked, provider, ["kind_no", "kind", "expected"], each).orderBy("kind_no", "no").limit(target).select("kind", "expected", "no", "question")


def validated_questions(questions: DataFrame, docs: DataFrame, provider: Provider = fake_provider, *, key: str = "doc_id", order: str = "no", most: int | None = None) -> DataFrame:
    """The questions that an answer calls valid for their document, and those whose check failed; a question without a
    document goes.  At most ``most``, in order."""
    asked = questions.join(docs.select(key, F.col("text").alias("__text")), key).withColumn("prompt", prompt('Can the question be answered from the context? Answer {"is_valid": true or false}.', question=F.col("question"), context=F.col("__text")))
    said = F.try_variant_get(X.json_object(F.col("answer")), "$.is_valid", "boolean")
    # As a failed call, an answer that isn't an object keeps the question; one without a verdict doesn't.
    valid = F.col("error").isNotNull() | X.json_object(F.col("answer")).isNull() | F.coalesce(said, F.lit(False))
    kept = answered(asked, provider).where(valid).select(*questions.columns)
    return kept.orderBy(key, order).limit(most) if most is not None else kept
