"""Results of jobs: a table with a folder for each job, its sizes, and what has expired."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.sources.files import expired


def save(results: DataFrame, path: str) -> None:
    """Writes results (with a column job) in Parquet; a job that is there already is replaced as a whole, others stay. What is half
    written is never seen: Spark commits each folder when all of its files are complete."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)


def read(spark: SparkSession, path: str, job: str | None = None) -> DataFrame | None:
    """Results of all jobs, or of one; None if nothing has been saved there."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found if job is None else found.where(F.col("job") == job)


def exists(spark: SparkSession, path: str, job: str) -> bool:
    found = read(spark, path, job)
    return found is not None and found.limit(1).count() > 0


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds rows to a log of scores; those that are there stay as they are."""
    scores.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def export(results: DataFrame, path: str, form: str) -> None:
    """Results as json (an object a line), csv (with a header; nested columns as JSON) or parquet."""
    if form == "csv":
        nested = {c: F.to_json(c) for c, t in results.dtypes if t.startswith(("array", "map", "struct"))}
        results.withColumns(nested).write.mode("overwrite").option("header", True).csv(path)
    else:
        results.write.mode("overwrite").format(form).save(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files that were uploaded to a folder, and of its subfolders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def expired_jobs(spark: SparkSession, path: str, hours: float) -> list[str]:
    """Folders of jobs under path whose files are all older than so many hours."""
    folder = F.regexp_extract("path", r"^(.*?/job=[^/]+)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(folder.alias("job"), "path")
    old = expired(spark, path, hours).select("path")
    kept = files.join(old, "path", "left_anti").select("job").distinct()
    # one row a job folder
    return [r["job"] for r in files.select("job").distinct().where("job <> ''").join(kept, "job", "left_anti").collect()]


def delete_expired(spark: SparkSession, paths: list[str], hours: float) -> int:
    """Deletes expired job folders under all paths; returns how many folders."""
    n = 0
    for path in paths:
        for job in expired_jobs(spark, path, hours):
            target = spark._jvm.org.apache.hadoop.fs.Path(job)  # Spark has no call of its own that deletes files
            n += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return n
