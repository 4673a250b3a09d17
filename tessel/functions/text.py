"""Text functions: answers of judges, question types, embedded JSON, personal data, tokens and prices, hashes."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.prices import LOCAL_PROVIDERS, PRICES

# ---------------------------------------------------------------------------------------------------------- hashes


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def sha256_short(text: Column) -> Column:
    return F.substring(sha256_hex(text), 1, 16)


def combined_fingerprint(dataset: Column, config: Column, environment: Column) -> Column:
    return sha256_hex(F.concat_ws(":", dataset, config, environment))


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and plain non-ASCII letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def _recast(text: str | None) -> str | None:
    try:
        return None if text is None else canonical(json.loads(text))
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text, in Arrow batches; null where it isn't JSON."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(part):
        return pd.Series([_recast(t) for t in part], dtype="object")

    return run(text)


# ----------------------------------------------------------------------------------------------- judges and questions


def judge_score(answer: Column) -> Column:
    """Raw score 1..5 of an answer like ``Score: 4``: one digit, 3 if there is none."""
    digit = F.regexp_extract(answer, r"Score:\s*([0-9])", 1)
    return F.least(F.greatest(F.coalesce(digit.try_cast("int"), F.lit(3)), F.lit(1)), F.lit(5))


def judge_verdict(answer: Column) -> Column:
    said = F.upper(F.regexp_extract(answer, r"(?i)Verdict:\s*(PASS|FAIL|PARTIAL)", 1))
    raw = judge_score(answer)
    return F.when(said != "", said).when(raw >= 4, "PASS").when(raw <= 2, "FAIL").otherwise("PARTIAL")


def judge_explanation(answer: Column) -> Column:
    """What stands behind "Explanation:" up to a ###; the whole answer if there is no such part."""
    said = F.when(answer.rlike(r"(?s)Explanation:\s*."), F.regexp_extract(answer, r"(?s)Explanation:\s*(.+)", 1)).otherwise(answer)
    first = F.get(F.split(said, "###"), F.lit(0))
    return F.regexp_replace(first, r"^\s+|\s+$", "")


def judge_parse(answer: Column) -> Column:
    """Struct of raw, score 0..1, verdict and explanation; the verdict isn't reconciled with the score."""
    raw = judge_score(answer)
    return F.struct(raw.alias("raw"), ((raw - 1) / 4.0).alias("score"), judge_verdict(answer).alias("verdict"), judge_explanation(answer).alias("explanation"))


#: Words that tell a question's type, tried in this order.
QUESTION_WORDS = (
    ("multi_hop", ("and also", "in addition", "furthermore", "both")),
    ("explanatory", ("how", "why", "explain")),
    ("comparative", ("difference", "compare", "versus", "vs")),
    ("definitional", ("what is", "define", "meaning of")),
)


def question_type(question: Column, allowed: tuple[str, ...] = ("multi_hop", "explanatory", "comparative", "definitional", "factual")) -> Column:
    low, out = F.lower(question), F.lit("factual" if "factual" in allowed or not allowed else allowed[0])
    for kind, words in reversed(QUESTION_WORDS):
        if kind in allowed:
            hit = F.lit(False)
            for word in words:
                hit = hit | low.contains(word)
            out = F.when(hit, kind).otherwise(out)
    return out


# ------------------------------------------------------------------------------------------------------ embedded JSON


def json_object(text: Column) -> Column:
    """The JSON object in an answer, as VARIANT: the whole text, else from the first brace to the last; null otherwise."""
    return _embedded(text, r"(?s)\{.*\}", "OBJECT")


def json_array(text: Column) -> Column:
    """The JSON array in an answer; a cut-off one is closed as far as one of four endings does it."""
    opened = F.regexp_extract(text, r"(?s)\[.*", 0)
    repaired = [_of_kind(F.try_parse_json(F.concat(opened, F.lit(end))), "ARRAY") for end in ("]", "}]", '"}]', '" }]')]
    return F.coalesce(_embedded(text, r"(?s)\[.*\]", "ARRAY"), *repaired)


def _of_kind(value: Column, kind: str) -> Column:
    return F.when(F.schema_of_variant(value).startswith(kind), value)


def _embedded(text: Column, pattern: str, kind: str) -> Column:
    return F.coalesce(_of_kind(F.try_parse_json(text), kind), _of_kind(F.try_parse_json(F.regexp_extract(text, pattern, 0)), kind))


# ------------------------------------------------------------------------------------------------------ personal data

#: Whole-value patterns of Unix and Windows paths, home folders, mail and IP addresses, and user names.
PII_PATTERNS = (
    r"^(/[^/\s]+)+/?$",
    r"^[A-Za-z]:\\.*$",
    r"^~[/\\].*$",
    r"^[\w.+-]+@[\w.-]+\.\w+$",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    r"(?i)^user[_-]?\d+$",
    r"(?i)^[a-z]{2,}\d{2,}$",
)
#: Names of fields that hold personal data.
PII_KEYS = ("source", "source_uri", "source_path", "file_path", "path", "filename", "file", "user", "username", "user_id", "author", "email", "ip", "ip_address", "host", "hostname")


def looks_like_pii(value: Column) -> Column:
    hit = F.lit(False)
    for pattern in PII_PATTERNS:
        hit = hit | value.rlike(pattern)
    return (F.char_length(value) >= 3) & hit


def sanitized(value: Column, mode: str = "redact", key: str | None = None) -> Column:
    """full keeps, hash gives the SHA-256, redact a mark; values of telling keys are always covered."""
    if mode == "full":
        return value
    cover = F.lit(True) if key is not None and key.lower() in PII_KEYS else looks_like_pii(value)
    return F.when(cover, sha256_hex(value) if mode == "hash" else F.lit("[REDACTED]")).otherwise(value)


def sanitized_map(values: Column, mode: str = "redact") -> Column:
    keys = [*PII_KEYS]
    if mode == "full":
        return values
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(keys) | looks_like_pii(v), sha256_hex(v) if mode == "hash" else F.lit("[REDACTED]")).otherwise(v))


def _covered(value: object, mode: str, key: str | None = None) -> object:
    """A JSON value: strings are covered, objects and lists of objects looked into, strings within lists left."""
    import hashlib

    if isinstance(value, str):
        telling = (key or "").lower() in PII_KEYS or (len(value) >= 3 and any(re.match(p, value) for p in PII_PATTERNS))
        return value if not telling else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest() if mode == "hash" else "[REDACTED]"
    if isinstance(value, dict):
        return {k: _covered(v, mode, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_covered(v, mode) if isinstance(v, dict) else v for v in value]
    return value


def sanitized_json(text: Column, mode: str = "redact") -> Column:
    """A JSON object with nested values, in Arrow batches; what isn't an object is left."""
    import pandas as pd

    def one(raw):
        try:
            value = json.loads(raw) if raw is not None else None
        except ValueError:
            return raw
        return canonical(_covered(value, mode)) if isinstance(value, dict) else raw

    @F.pandas_udf("string")
    def run(part):
        return pd.Series([one(t) for t in part], dtype="object")

    return text if mode == "full" else run(text)


# ----------------------------------------------------------------------------------------------------- tokens, prices


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def priced(usage: DataFrame, custom: DataFrame | None = None, *, prices: tuple = PRICES, local: tuple[str, ...] = LOCAL_PROVIDERS) -> DataFrame:
    """Adds cost: ``custom`` prices by the model's exact name come first, even for local providers; these cost nothing else.
    Then the list's price by exact name, then by the name in lower case; unknown models cost nothing.

    Prices (model, input_per_m, output_per_m) are for a million tokens.  Both lists are ones that people write, a few thousand
    rows at most, and broadcast.
    """
    spark = usage.sparkSession
    listed = spark.createDataFrame(list(prices), "model string, input_per_m double, output_per_m double")
    own = custom if custom is not None else listed.limit(0)

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return F.broadcast(df.select(F.col("model").alias(key), F.struct("input_per_m", "output_per_m").alias(name)).dropDuplicates([key]))

    joined = usage.join(side(own, "__c", "__x"), usage["model"] == F.col("__c"), "left").join(side(listed, "__m", "__p"), usage["model"] == F.col("__m"), "left").join(side(listed, "__l", "__q"), F.lower(usage["model"]) == F.col("__l"), "left")
    free = F.struct(F.lit(0.0).alias("input_per_m"), F.lit(0.0).alias("output_per_m"))
    price = F.coalesce(F.col("__x"), F.when(F.lower("provider").isin(*local), free), F.col("__p"), F.col("__q"), free)
    cost = F.col("input_tokens") / 1_000_000 * price["input_per_m"] + F.col("output_tokens") / 1_000_000 * price["output_per_m"]
    return joined.withColumn("cost", cost).drop("__c", "__x", "__m", "__p", "__l", "__q")


# -------------------------------------------------------------------------------------------------------- similarity


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def answer_of(text: str) -> str:
    """What stands behind an answer's prefix."""
    found = re.search(r"(?is)(?:final answer|answer)\s*:\s*(.*)", text)
    return found[1].strip() if found else text.strip()
