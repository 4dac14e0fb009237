"""Text and JSON files: lines, records, files with a header record, lists under headings, words with span tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Column line: trimmed lines that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def json_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records of files that are each a JSON array, or hold one object a line: the first byte of the first file decides."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    reader = spark.read.option("multiLine", bool(first) and first["c"] == "[")
    return (reader.schema(schema) if schema else reader).json(path)


def header_and_records(spark: SparkSession, path: str, schema: StructType | str, mark: str = "_metadata") -> tuple[DataFrame, DataFrame]:
    """Rows (text) that carry the mark's key, and the parsed others."""
    text = spark.read.text(path).where(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    is_head = F.coalesce(F.try_variant_get("__v", f"$.{mark}", "variant").isNotNull(), F.lit(False))
    return text.where(is_head).select("value"), text.where(~is_head).select(F.from_json("value", schema).alias("r")).select("r.*")


def skip_ids(spark: SparkSession, given: str) -> DataFrame:
    """Column id, distinct: from a comma-separated list, or from a file of one id a line if given is a path with a slash."""
    if "/" in given:
        return lines(spark, given).select(F.col("line").alias("id")).distinct()
    return spark.createDataFrame([(x.strip(),) for x in given.split(",") if x.strip()], "id string").distinct()


def latest(spark: SparkSession, path: str) -> str | None:
    """The last path by name under a pattern; None if there is none."""
    return spark.read.format("binaryFile").load(path).agg(F.max("path").alias("p")).first()["p"]


def expired(spark: SparkSession, path: str, hours: float) -> DataFrame:
    """path, modificationTime and length of files older than so many hours; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))).select("path", "modificationTime", "length")


def job_sizes(spark: SparkSession, path: str, job: str) -> DataFrame:
    """job, n_files, bytes: files whose path matches the pattern `job`, by its first group."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", job, 1).alias("job"), "length").where("job <> ''").groupBy("job").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def listed_entries(rows: DataFrame, doc: str, line: str, text: str) -> DataFrame:
    """doc, line, category, key, value: entries '- key_1: value' under the heading before them, a line with ' - ' that does not
    start with a hyphen. Entries before any heading have a null category."""
    t = F.col(text)
    heading = F.when(F.contains(t, F.lit(" - ")) & ~t.startswith("-"), F.trim(t))
    filled = rows.withColumn("category", F.last(heading, ignorenulls=True).over(Window.partitionBy(doc).orderBy(line)))
    found = filled.where(t.startswith("- ") & F.contains(t, F.lit("_")) & F.contains(t, F.lit(": ")))
    body = F.substring(t, 3, 1 << 20)
    return found.select(doc, line, "category", F.regexp_extract(body, r"^(.*?): ", 1).alias("key"), F.trim(F.regexp_replace(body, r"^.*?: ", "")).alias("value"))


def tagged_spans(words: DataFrame, doc: str, pos: str, word: str, tag: str, label: str) -> DataFrame:
    """doc, span (from 1), label, text: words of each span, joined by label. A span starts at tag 'b-r' and goes on with 'i-r' and
    'e-r'; other words, and those before the first start, belong to none. Tags are taken in lower case."""
    t = F.lower(F.col(tag))
    spans = words.withColumn("span", F.sum((t == "b-r").cast("long")).over(Window.partitionBy(doc).orderBy(pos))).where(t.isin("b-r", "i-r", "e-r") & (F.col("span") > 0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, word))), lambda x: x[word]), " ")
    return spans.groupBy(doc, "span", label).agg(joined.alias("text"))


def detokenized(tokens: Column) -> Column:
    """Words joined by blanks, none before marks and closing brackets."""
    return F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,;:!?)\]}])", "$1")
