"""Readers and writers of test sets, golden sets, document bundles and folders of texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which a field may come; the first that isn't empty counts.
TEXT = ("text", "question", "query")
TRUTH = ("ground_truth_docs", "ground_truth", "relevant_docs", "doc_ids")
ANSWER = ("expected_answer", "answer")


def _lines(spark: SparkSession, path: str) -> bool:
    """Whether a file holds one JSON value a line: by its name, or because its first two lines are JSON each."""
    if path.endswith(".jsonl"):
        return True
    head = [r[0] for r in spark.read.text(path).limit(2).collect()]

    def whole(line: str) -> bool:
        try:
            json.loads(line)
        except ValueError:
            return False
        return True

    return len(head) == 2 and all(map(whole, head))


def _first(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON list, a JSON object with ``queries``, or JSON lines.  Names as above; a single relevant
    document makes a list of one; other fields go to metadata; a line that isn't JSON is an error that names it."""
    if _lines(spark, path):
        rows = spark.read.text(path).where(F.trim("value") != "")
        v = F.try_parse_json("value")
        bad = F.when(v.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200))).cast("boolean")).otherwise(True)
        queries = rows.where(bad).select(v.alias("v"))
    else:
        rows = spark.read.text(path, wholetext=True)
        whole = F.parse_json("value")
        items = F.coalesce(F.try_variant_get(whole, "$.queries", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
        queries = rows.select(F.explode(items).alias("v"))
    v = F.col("v")
    truth = F.coalesce(*[c for n in TRUTH for c in (F.nullif(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>")), F.when(F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")).rlike(r"^[^\[]"), F.array(F.try_variant_get(v, f"$.{n}", "string"))))], F.array().cast("array<string>"))
    known = [*TEXT, *TRUTH, *ANSWER, "metadata", "id"]
    rest = F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: ~k.isin(known))
    own = F.coalesce(F.try_variant_get(v, "$.metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(rest, lambda k, x: ~F.map_contains_key(own, k)), own)
    return queries.select(F.coalesce(_first(v, TEXT), F.lit("")).alias("text"), truth.alias("ground_truth_docs"), _first(v, ANSWER).alias("expected_answer"), F.try_variant_get(v, "$.id", "string").alias("id"), merged.alias("metadata"))


def write_testset(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition; empty fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """documents.jsonl of a bundle with a manifest.json that names its schema version; id or content missing is an error."""
    manifest = spark.read.text(f"{path}/manifest.json", wholetext=True).select(F.parse_json("value").alias("m"))
    version = manifest.select(F.coalesce(F.try_variant_get("m", "$._schema_version", "string"), F.try_variant_get("m", "$.schema_version", "string"))).first()
    if not version or not version[0]:
        raise ValueError("the manifest names no schema version")
    v = F.col("v")
    rows = spark.read.text(f"{path}/documents.jsonl").where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    doc, content = _first(v, ("doc_id", "id")), _first(v, ("content", "text"))
    whole = F.when(doc.isNull() | content.isNull(), F.raise_error(F.lit("a document without id or content")).cast("boolean")).otherwise(True)
    extra = F.map_filter(F.create_map(*[x for n in ("title", "format", "source_uri", "source_hash") for x in (F.lit(n), F.try_variant_get(v, f"$.{n}", "string"))]), lambda k, x: x.isNotNull())
    return rows.where(whole).select(doc.alias("id"), content.alias("content"), extra.alias("metadata"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files below a folder: id (the name without ending), content; blank ones are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return files.select(name.alias("id"), F.col("value").alias("content")).where(F.trim("content") != "")


GOLDEN = "id string, question string, answer string, tags string, source_docs string, difficulty string, priority string, validated_by string, validated_at string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set in CSV (lists joined by semicolons) or JSON (a list, or an object with ``questions``)."""
    lists = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True, schema=None, multiLine=True, escape='"')
        for f in GOLDEN.split(", "):
            if (n := f.split(" ")[0]) not in raw.columns:
                raw = raw.withColumn(n, F.lit(None).cast("string"))
        return raw.select("id", "question", "answer", lists("tags").alias("tags"), lists("source_docs").alias("source_docs"), "difficulty", "priority", "validated_by", "validated_at")
    if path.endswith((".yaml", ".yml")):
        import yaml  # an optional dependency of this format alone

        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        data = yaml.safe_load(text)
        items = data.get("questions", []) if isinstance(data, dict) else data
        rows = spark.createDataFrame([(json.dumps(q, default=str),) for q in items], "value string").select(F.parse_json("value").alias("v"))
    else:
        whole = F.parse_json("value")
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.try_variant_get(whole, "$.questions", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))).alias("v"))
    v = F.col("v")
    one = lambda n: F.try_variant_get(v, f"$.{n}", "string").alias(n)
    many = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>")).alias(n)
    return rows.select(one("id"), one("question"), one("answer"), many("tags"), many("source_docs"), one("difficulty"), one("priority"), one("validated_by"), one("validated_at"))


def write_golden(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        df.withColumns({c: F.array_join(c, ";") for c in ("tags", "source_docs")}).write.mode("overwrite").csv(path, header=True, escape='"')
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no golden set of kind {kind}")


def normalised_documents(df: DataFrame, column: str) -> DataFrame:
    """Rows of (id, content, metadata) from a column of passages that are texts, or JSON objects under usual names."""
    v = F.try_parse_json(column)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    content = F.when(is_object, _first(v, ("content", "page_content", "text"))).otherwise(F.col(column))
    doc = F.coalesce(F.when(is_object, _first(v, ("id", "doc_id", "node_id"))), F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16))
    meta = F.coalesce(F.when(is_object, F.try_variant_get(v, "$.metadata", "map<string,string>")), F.create_map().cast("map<string,string>"))
    return df.select(doc.alias("id"), content.alias("content"), F.map_filter(meta, lambda k, x: k != "embedding").alias("metadata"))
