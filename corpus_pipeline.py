"""Documents to token files in five stages; each takes and returns a DataFrame, written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import decontamination, mixing, near_dup, rans, toxicity
from refloom.llm.common import release, table, write_shared
from refloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go. Rows are judged one by one: of those that share an id, or have none, only the
    ones with a toxic text go; null and empty texts stay unless most labels are toxic; an empty table stays empty; all columns are kept."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest id, null the last; of texts that share it, the first
    by a hash. Rows are told apart by id and text, as ids can be null or repeat; rows equal in both are one. Null and empty texts are
    one group. Long texts are compared whole; an empty table stays empty; all columns are kept, whatever their names."""
    place = F.xxhash64(docs["doc_id"], docs["text"])
    found = near_dup.near_duplicates(docs.select(place.alias("doc_id"), "text"))
    rows = found.groupBy(F.col("doc_id").alias("place"), "group_id").agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select(place.alias("place"), "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "n")).alias("first")
    stays = write_shared(rows.join(ids, "place").groupBy("group_id").agg(first).select(F.col("first.place").alias("__stays"), F.col("first.n").alias("n")), "kept-rows")
    kept = docs.join(stays.select("__stays"), place == F.col("__stays"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if stays.where("n > 1").limit(1).count() else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Rows are judged one by one. Null and empty texts stay, items
    without words match nothing; empty tables of documents or items change nothing; all columns are kept."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixture's order: files by name and rows in a file follow it. A null source is a source of its own; rows equal
    in id and text stand together; no row is dropped or repeated; an empty table stays empty; all columns are kept."""
    places = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("place").alias("__place")).agg(F.min(F.struct("slot", "rank")).alias("__turn"))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__place")))
    order = [F.col("__turn"), F.col("__id")]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*(docs[c] for c in docs.columns))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of docs' own files; of docs that were not read from files, in the order of ids. Null and empty texts have
    the end id only; repeated rows and ids are each written, null ids too; an empty table gives files without blocks; other columns
    are not read."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return rans.token_files(docs, tokenizer_path())
    return rans.token_files(placed, tokenizer_path(), order_by=["file", "row"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token files", write_token_files),
]

#: A recurrent network and a tokenizer are no SQL. tests/llm holds the rows that the first three stages drop against plain Python on planted
#: tables, the first with words in the network's place, and that mixing keeps every row; the mixture's order is not held against anything.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(*written)
        written = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # writes its files before it returns
    release(*written)
    return out
