"""What the operators of this subpackage share: tables, scratch space, byte-level words, bounded broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark setting that names the folder shared by the driver and all executors.
SHARED_DIR_SETTING = "spark.checkpoint.dir"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes 0-9, a-z and 0x80-0xFF stay, A-Z become a-z, all others a space: a split then gives the alphanumeric words.
ALNUM_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

ROWS_AT_ONCE = 1000

#: What a worker process keeps from task to task, by the operator that made it.
_worker_caches: dict[str, object] = {}

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of SHARED_DIR_SETTING; where that is unset (local runs, tests), one temporary folder of our own."""
    context = spark.sparkContext
    named = context.getConf().get(SHARED_DIR_SETTING)
    if named:
        return named.rstrip("/")
    if context.applicationId not in _own_dirs:
        if not context.master.startswith("local"):
            raise ValueError(f"{SHARED_DIR_SETTING} must name a folder that all executors share")
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="refloom-")
    return _own_dirs[context.applicationId]


def write_shared(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and returns it as read from there: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/refloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables of write_shared that nothing reads any more."""
    for f in frames:
        remove(f.sparkSession, f.shared_path)


def small_batches(docs: DataFrame) -> None:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def kept_rows(docs: DataFrame, text_col: str, keeps) -> DataFrame:
    """Rows of docs, with all columns, that a decision on their texts keeps: keeps() gives, on an executor, a function from a list of
    texts (bytes, nulls empty) to a list of booleans. Rows are judged where they are read, so nothing is joined or shuffled. The
    text column is a string."""
    small_batches(docs)

    def run(batches):
        clear_worker_caches()
        decide = keeps()
        for batch in batches:
            keep = [k for _, values in byte_column(batch, text_col, 200) for k in decide(values)]
            if any(keep):
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns, whatever their names, can't clash.

    Texts and vectors are large rows: the session sends at most ROWS_AT_ONCE of them to Python in one batch from here on."""
    small_batches(docs)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def worker_cache(owner: str, make):
    """make() of this worker process, kept for its later tasks of the same owner."""
    if owner not in _worker_caches:
        clear_worker_caches()
        _worker_caches[owner] = make()
    return _worker_caches[owner]


def clear_worker_caches() -> None:
    """Gives back what other operators' tasks have left in this worker process, so that an executor's memory doesn't add up."""
    if _worker_caches:
        _worker_caches.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def byte_column(batch: pa.RecordBatch, name: str, at_most: int = 2000) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, values) of a string column as bytes, nulls empty, in slices so that Python holds few values at once."""
    column = batch.column(name)
    for start in range(0, batch.num_rows, at_most):
        part = column.slice(start, at_most).cast(pa.large_binary())
        yield start, [b"" if v is None else v for v in part.to_pylist()]


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes of all words, words of each text, the distinct words that codes name), split at ASCII whitespace by Arrow, so
    that only distinct words become Python objects."""
    column = pc.cast(pa.array(texts, pa.large_binary()), pa.large_string(), safe=False)
    lists = pc.ascii_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = pc.cast(coded.dictionary, pa.large_binary()).to_pylist()
    if b"" in words:  # from blanks at an end of a text
        gone = words.index(b"")
        stay = codes != gone
        offsets = np.concatenate([[0], np.cumsum(stay)])[offsets - offsets[0]]
        codes = codes[stay]
        codes -= codes > gone
        del words[gone]
    return codes, np.diff(offsets), words


def count_rows(counts: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One batch of (key, count) rows."""
    if counts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), schema.field(0).type), pa.array(list(counts.values()), schema.field(1).type)],
            schema=schema,
        )


def collect_bounded(df: DataFrame, bound: int, what: str) -> list:
    """Rows on the driver, only if they are no more than bound; else an error that names the bound."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows; raise the bound only if the driver can hold them")
    return rows


def arrow_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this subpackage wrote, by Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
