"""Quality rules: compression bands over whole documents and fixed chunks, beside counts of words, symbols and repeats."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
#: Whitespace and UTF-8 continuation bytes: what is left has one byte for each code point inside words.
NOT_WORD_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
WINDOW = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    """Allowed compressed size by uncompressed size. Short texts compress little, so their limits are wider. From 513 bytes up
    the upper limits lie below what base64 of random bytes gives (0.84 at 520 bytes, 0.77 at 2048, 0.76 at 8192)."""

    #: (up to so many bytes, lowest ratio, highest ratio); the last holds for all longer texts
    limits: tuple[tuple[float, float, float], ...] = field(
        default=((128, 0.0, 9.0), (512, 0.20, 1.10), (2048, 0.15, 0.76), (8192, 0.10, 0.75), (float("inf"), 0.06, 0.74))
    )
    chunk_bytes: int = 4096
    #: a document of several chunks fails if more than this share of its bytes lies in chunks outside the bands of their
    #: lengths: prose with less than that of encoded or repeated text in it is kept, and only n_bad_chunks shows it
    bad_chunks: float = 0.5
    level: int = 3

    def verdict(self, size: int, ratio: float) -> str:
        _, low, high = next(x for x in self.limits if size <= x[0])
        return "repetitive" if ratio < low else "incompressible" if ratio > high else ""


def repeated_window_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside windows of n words found twice or more. Windows are found by hash and then compared."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    h = np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * _MULTIPLIER + h[k : k + count]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(count, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    first: dict[tuple[bytes, ...], int] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in np.flatnonzero(maybe).tolist():
        window = tuple(words[i : i + n])
        j = first.setdefault(window, i)
        if j != i:
            for start in (i, j):
                covered[start] += 1
                covered[start + n] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    ratio = len(compressor.compress(text)) / size if size else 1.0
    chunks = [text[k : k + bands.chunk_bytes] for k in range(0, size, bands.chunk_bytes)] if size > bands.chunk_bytes else []
    verdicts = [bands.verdict(len(c), len(compressor.compress(c)) / len(c)) for c in chunks]
    bad = [v for v in verdicts if v]
    bad_bytes = sum(len(c) for c, v in zip(chunks, verdicts, strict=True) if v)
    verdict = bands.verdict(size, ratio) or (max(sorted(set(bad)), key=bad.count) + " chunks" if bad_bytes > bands.bad_chunks * size else "")
    return (
        len(words),
        len(text.translate(None, NOT_WORD_CHARS)),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        ratio,
        len(verdicts),
        len(bad),
        verdict,
    )


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("reason", pa.string())]
)


def quality(docs: DataFrame, bands: Bands | None = None, min_words: int = 20, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_chunks, n_bad_chunks,
    reason ('' or why the bands reject it) and kept for every document.

    Words are runs of characters other than 0x20 and 0x09-0x0D. base_failed: fewer than min_words words, or more than
    max_repeat_percent of the words lie in windows of eight words that occur twice or more. kept: neither base_failed nor
    rejected by the bands: the zstandard ratio (compressed to plain bytes) of the whole text must lie in the band of its
    length, and at least half of its bytes in 4096-byte chunks (the last is shorter), if it has two or more, that lie in theirs.

    A null or empty text has no words, ratio 1.0 and fails the base rules. Texts are measured whole, however long; repeated
    rows and ids each get a row; an empty table gives an empty table. Other columns are not read.
    """
    bands = bands or Bands()
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for start, texts in common.byte_column(batch, "text"):
                columns = zip(*(measure(t, bands, compressor) for t in texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *(pa.array(c, OUT.field(k + 1).type) for k, c in enumerate(columns))], schema=OUT)

    measured = rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, reason string")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("reason") == ""))
