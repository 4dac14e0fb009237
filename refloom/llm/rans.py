"""Token ids as files: static range asymmetric numeral system in independent, interleaved blocks.

A set of token files is a folder of two Parquet tables: `table`, one row with the frequency table that all blocks share, and
`blocks`, one row per block: part and seq (its place), first (ids of the part before it), n_tokens, n_docs and block, whose
bytes are

    header   magic RNB1, table checksum, precision, lanes, rows, rows per segment, n_tokens, n_docs, n_words
    docs     per document: id (int64), 1 if the id is null (uint8), number of ids (uint32)
    states   per segment and lane: decoder state at the segment's first row (uint64): the checkpoints
    offsets  per segment: its first word (uint64)
    words    the coded stream (uint32)
    sums     crc32 of the ids, crc32 of all bytes before (uint32 each)

Id number i of a block is coded in lane i mod lanes, row i div lanes. All numbers are little-endian.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import unicodedata
import uuid
import zlib
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEADER = struct.Struct("<4sIIIIIQQQ")
MAGIC = b"RNB1"
WORD, LOW = np.uint64(32), np.uint64(1 << 32)


class Frequencies:
    """Whole frequencies that sum to 2**precision, at least one for each id that occurs."""

    def __init__(self, counts: np.ndarray, precision: int | None = None):
        counts = np.asarray(counts, dtype=np.float64)
        present = counts > 0
        precision = precision or max(16, int(present.sum()).bit_length() + 3)
        total = 1 << precision
        scaled = np.zeros(len(counts), dtype=np.int64)
        if present.any():
            scaled[present] = np.maximum(1, np.floor(counts[present] / counts.sum() * total)).astype(np.int64)
            extra = total - int(scaled.sum())
            order = np.argsort(-scaled, kind="stable")
            for k in order:  # the most frequent ids bear what rounding leaves
                if not extra:
                    break
                change = max(extra, 1 - int(scaled[k]))
                scaled[k] += change
                extra -= change
        self.precision = precision
        self.scaled = scaled.astype(np.uint64)

    @functools.cached_property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.scaled)[:-1]]).astype(np.uint64)

    @functools.cached_property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled.astype(np.int64))

    @functools.cached_property
    def checksum(self) -> int:
        return zlib.crc32(self.scaled.astype("<u4").tobytes(), self.precision)

    def to_bytes(self) -> bytes:
        return struct.pack("<II", self.precision, len(self.scaled)) + self.scaled.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        out = cls.__new__(cls)
        out.precision, n = struct.unpack_from("<II", data)
        out.scaled = np.frombuffer(data, "<u4", n, 8).astype(np.uint64)
        return out


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Frequencies, lanes: int = 2048, segment_rows: int = 64) -> bytes:
    """ids: all ids of the documents; docs: (id, number of ids) of each."""
    n = len(ids)
    lanes = max(1, min(lanes, -(-n // 32)))
    rows = -(-n // lanes)
    grid = np.zeros(rows * lanes, dtype=np.int64)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]  # fills the last row
    grid = grid.reshape(rows, lanes)
    precision = np.uint64(table.precision)
    ceiling = np.uint64(64 - table.precision)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [None] * rows
    states = []
    for r in range(rows - 1, -1, -1):
        f, c = table.scaled[grid[r]], table.first[grid[r]]
        full = (x >> ceiling) >= f
        words[r] = x[full].astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << precision) + (x - q * f) + c
        if r % segment_rows == 0:
            states.append(x)
    sizes = np.array([len(w) for w in words], dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    offsets = starts[:rows:segment_rows] if rows else np.zeros(0, "<u8")
    body = b"".join(
        [
            HEADER.pack(MAGIC, table.checksum, table.precision, lanes, rows, segment_rows, n, len(docs), int(sizes.sum())),
            np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(),
            bytes(d is None for d, _ in docs),
            np.array([k for _, k in docs], dtype="<u4").tobytes(),
            *(s.astype("<u8").tobytes() for s in reversed(states)),
            offsets.tobytes(),
            *(w.astype("<u4").tobytes() for w in words),
            struct.pack("<I", zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, table: Frequencies) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    """(docs, ids). All segments of the block are decoded side by side, each from its checkpoint."""
    magic, checksum, bits, lanes, rows, segment_rows, n, n_docs, n_words = HEADER.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("a block of token ids is damaged")
    if checksum != table.checksum:
        raise ValueError("a block of token ids belongs to another frequency table")
    at = HEADER.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    nulls = data[at + 8 * n_docs : at + 9 * n_docs]
    sizes = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs).tolist()
    at += 13 * n_docs
    segments = -(-rows // segment_rows)
    x = np.frombuffer(data, "<u8", segments * lanes, at).astype(np.uint64)
    at += 8 * segments * lanes
    offsets = np.frombuffer(data, "<u8", segments, at).astype(np.int64)
    at += 8 * segments
    words = np.concatenate([np.frombuffer(data, "<u4", n_words, at).astype(np.uint64), np.zeros(1, np.uint64)])
    out = np.zeros((segments, segment_rows, lanes), dtype=np.uint32)
    mask, precision = np.uint64((1 << bits) - 1), np.uint64(bits)
    scaled, first, symbols = table.scaled, table.first, table.symbols
    live = segments
    for r in range(min(segment_rows, rows)):
        if live == segments and r >= rows - (segments - 1) * segment_rows:
            live, x, offsets = segments - 1, x[: (segments - 1) * lanes], offsets[: segments - 1]
        slot = x & mask
        s = symbols[slot]
        out[:live, r] = s.reshape(live, lanes)
        x = scaled[s] * (x >> precision) + slot - first[s]
        low = x < LOW
        short = low.reshape(live, lanes)
        # within its segment, each lane that runs low takes the next word
        taken = np.cumsum(short, axis=1)
        place = (offsets[:, None] + taken - 1).reshape(-1)[low]
        x[low] = (x[low] << WORD) | words[place]
        offsets = offsets + taken[:, -1]
    ids = out.reshape(-1)[: n] if rows else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack_from("<I", data, len(data) - 8)[0]:
        raise ValueError("decoded token ids do not have their checksum")
    return [(None if null else d, k) for d, null, k in zip(doc_ids, nulls, sizes, strict=True)], ids


def _lower(text: bytes) -> bytes:
    """A-Z in lower case where the tokenizer, which lower-cases all, gives the same ids: not where a special token may stand
    or a combining mark (U+0300 to U+036F) may be composed with a letter before letters are lower-cased."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BLANK, LETTER, SYMBOL, DIGIT, OTHER = 0, 1, 2, 4, 8
LEAD = 16
SYMBOLS = bytes(b for b in range(33, 127) if b != 39 and not bytes([b]).isalnum())

#: By byte: ASCII whitespace, letters, symbols other than the apostrophe, digits; the first bytes of U+00C0 to U+017F; others.
BYTE_CLASSES = bytes(
    BLANK if b == 32 or 9 <= b <= 13 else OTHER if b < 33 or b == 39 or b == 127 else DIGIT if 48 <= b <= 57
    else LETTER if 65 <= b <= 90 or 97 <= b <= 122 else SYMBOL if b < 128 else LEAD if 0xC3 <= b <= 0xC5 else OTHER
    for b in range(256)
)


def split_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes of all pieces, pieces of each text, the distinct pieces that codes name). Texts are cut at ASCII whitespace and
    where letters, symbols and digits meet, each of them ASCII (or, for letters, of U+00C0 to U+017F): places that no match of the
    tokenizer's splitter crosses. Next to apostrophes and other characters, and in texts that may hold special tokens, there is no cut."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    # a blank before the first and after the last byte
    cls = np.zeros(len(data) + 1, np.uint8)
    cls[1:] = np.frombuffer(data.tobytes().translate(BYTE_CLASSES), np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    lead = np.flatnonzero(cls == LEAD)
    if len(lead):
        first, second = data[lead - 1], data[np.minimum(lead, len(data) - 1)]
        # not the signs for times and division, nor the letter whose lower case has a combining mark
        whole = ((second & 0xC0) == 0x80) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ~((first == 0xC4) & (second == 0xB0))
        cls[lead] = np.where(whole, LETTER, OTHER)
        cls[lead[whole] + 1] = LETTER
    for k, t in enumerate(texts):
        if b"<|" in t:
            part = cls[bounds[k] + 1 : bounds[k + 1] + 1]
            part[part != BLANK] = OTHER
    either = cls[1:] | cls[:-1]
    edge = np.flatnonzero((cls[1:] != cls[:-1]) & (either <= OTHER))  # byte k is at k + 1 in cls
    starts, ends = edge[cls[edge + 1] != BLANK], edge[cls[edge] != BLANK]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = data[cls[1:] != BLANK]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = pieces.dictionary_encode()
    counts = np.diff(np.searchsorted(starts, bounds))
    return np.asarray(coded.indices, dtype=np.int64), counts, coded.dictionary.to_pylist()


class WordTokens:
    """Ids of texts from ids of their pieces, each learned once. No match of the tokenizer's splitter crosses the cuts of
    split_pieces and its normaliser maps characters one by one around them, so a text's ids are those of its pieces in a row.
    At most about `keep` pieces are known at a time: beyond, those met once are forgotten, and the rarer half of the others.

    A piece of lower-case ASCII letters or of ASCII symbols, or of letters that the normaliser leaves alone, is one match and goes
    to the merges directly, if the tokenizer is of the kind that marks ends of words; others go through all of it."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.direct = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.characters = _byte_characters()
        self.keep = keep
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _match(self, piece: bytes) -> str | None:
        """The piece as the merges take it, if it is one match that the normaliser leaves alone; else None."""
        if piece.isascii():
            one = piece.isalpha() and piece.islower() or not piece.translate(None, SYMBOLS)
            return piece.decode() if one else None
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
            return piece.decode("latin-1").translate(self.characters)
        return None

    def _learn(self, new: list[bytes]) -> None:
        matches = list(map(self._match, new)) if self.direct else [None] * len(new)
        merges = self.merges
        ids = [[t.id for t in merges(m)] if m is not None else None for m in matches]
        others = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(others, self.tokenizer.encode_batch_fast([new[k].decode("utf-8", "replace") for k in others], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.starts, self.sizes = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        stay = np.flatnonzero(self.uses > 1)
        stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")][: self.keep // 2])
        place = np.full(len(self.uses), -1, np.int64)
        place[stay] = np.arange(len(stay))
        new = place.tolist()
        self.known = {w: new[k] for w, k in self.known.items() if new[k] >= 0}
        sizes = self.sizes[stay]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.starts[stay] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.uses = ends - sizes, sizes, self.uses[stay] // 2

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece is known; new ones are learned."""
        find = lambda: np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        known = find()
        if self.known and len(self.known) + int((known < 0).sum()) > self.keep:
            self._forget()  # some that were found, too
            known = find()
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = len(self.sizes) + np.arange(len(missing))
            self._learn([pieces[k] for k in missing.tolist()])
        return known

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        codes, counts, pieces = split_pieces([_lower(t) for t in texts])
        known = self._places(pieces)
        self.uses[known] += np.bincount(codes, minlength=len(pieces))
        at = known[codes]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        end = np.array([end_id], np.uint32)
        return [np.concatenate([ids[bounds[k] : bounds[k + 1]], end]) for k in range(len(texts))]


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, which then knows the words of its earlier tasks."""
    return common.worker_cache(f"word tokens {path}", lambda: WordTokens(path))


def id_type(tokenizer: str, end_id: int) -> str:
    """The narrowest type for the ids between the stages; the files do not depend on it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenize(rows: DataFrame, tokenizer: str, end_id: int, dtype: str, lower: bool = False) -> DataFrame:
    """The text of each row replaced by its ids, the end id last, packed as dtype. lower: A-Z are lower-cased first."""
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, "text")
    schema = rows.select(*others, F.lit(b"").alias("ids")).schema

    def run(batches):
        encoder = word_tokens(tokenizer)
        for batch in batches:
            for start, texts in common.byte_column(batch, "text", 1000):
                texts = [t.lower() for t in texts] if lower else texts
                ids = pa.array([i.astype(dtype).tobytes() for i in encoder.encode(texts, end_id)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(texts)) for c in others), ids], names=[*others, "ids"])

    return rows.mapInArrow(run, schema)


def id_counts(tokens: DataFrame, dtype: str) -> DataFrame:
    """token, n: how often each id occurs; every task sums what it reads before anything is shuffled."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, ids in common.byte_column(batch, "ids", 4000):
                got = np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=len(total))
                got[: len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], schema=schema)

    return tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


BLOCK_SCHEMA = "part int, seq int, first long, n_tokens long, n_docs long, block binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("block", pa.binary())])


def _write_blocks(tokens: DataFrame, table: Frequencies, dtype: str, block_tokens: int) -> DataFrame:
    def run(batches):
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple[int | None, int]] = []
        ids: list[np.ndarray] = []
        held = 0

        def block():
            data = encode_block(np.concatenate(ids).astype(np.int64), docs, table)
            values = [[part], [seq], [first], [held], [len(docs)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start, packed in common.byte_column(batch, "ids", 500):
                for doc_id, data in zip(names[start : start + len(packed)], packed, strict=True):
                    own = np.frombuffer(data, dtype)
                    docs.append((doc_id, len(own)))
                    ids.append(own)
                    held += len(own)
                    if held >= block_tokens:
                        yield block()
                        seq, first = seq + 1, first + held
                        docs, ids, held = [], [], 0
        if docs:
            yield block()

    return tokens.mapInArrow(run, BLOCK_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, order_by: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = 1 << 18, file_tokens: int = 1 << 26) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending order of order_by (by default the id; columns of
    docs), as token files in the folder `path`.

    The texts are read once. Their ids go to a table in the shared folder, are counted there, dealt out by ranges of the
    order and coded with the counts of the whole corpus. Blocks hold whole documents, of block_tokens ids or just over.
    Null texts are empty and have the end id only, as empty ones; null ids come first; rows that repeat an id are each
    written, ordered among themselves by their ids. A document is held in memory whole. An empty table gives files
    without blocks. Other columns are not read.
    """
    order = order_by or [id_col]
    rows = docs.select(*(docs[c].alias(f"order{k}") for k, c in enumerate(order)), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    dtype = id_type(tokenizer, end_id)
    kept = f"{common.shared_dir(docs.sparkSession)}/refloom/ids-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    tokens = tokenize(rows, tokenizer, end_id, dtype)
    tokens.write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.schema(tokens.schema).parquet(kept)
    counts = np.zeros(1, dtype=np.int64)
    for r in common.collect_bounded(id_counts(tokens, dtype), 1 << 24, "different token ids"):
        if r["token"] >= len(counts):
            counts = np.concatenate([counts, np.zeros(r["token"] + 1 - len(counts), dtype=np.int64)])
        counts[r["token"]] = r["n"]
    table, total = Frequencies(counts), int(counts.sum())
    spark.createDataFrame([(bytearray(table.to_bytes()), total)], "frequencies binary, n_tokens long").coalesce(1).write.parquet(f"{path}/table")
    parts = max(1, -(-total // file_tokens), min(4 * spark.sparkContext.defaultParallelism, total // (1 << 19)))
    keys = [*(F.col(f"order{k}") for k in range(len(order))), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    _write_blocks(ordered, table, dtype, block_tokens).write.option("compression", "none").parquet(f"{path}/blocks")
    common.remove(spark, kept)


READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids (packed as unsigned 32-bit
    integers) of every document in the token files of `path`. Every block is decoded and its checksums are compared."""
    row = spark.read.schema("frequencies binary, n_tokens long").parquet(f"{path}/table").first()
    table = Frequencies.from_bytes(bytes(row["frequencies"]))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # one row per file of the set, however large the corpus
    base, before = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r["part"]] = before
        before += r["n"]
    if before != row["n_tokens"]:
        raise ValueError(f"the blocks of {path} hold {before} of {row['n_tokens']} ids")
    shared = spark.sparkContext.broadcast((table, base))
    arrow = pa.schema([*READ_ARROW, *([("ids", pa.binary())] if with_ids else [])])

    def run(batches):
        table, base = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                docs, ids = decode_block(batch.column("block")[k].as_py(), table)
                start = base[batch.column("part")[k].as_py()] + batch.column("first")[k].as_py()
                at, out = 0, []
                for doc_id, n in docs:
                    own = ids[at : at + n].astype("<u4").tobytes()
                    out.append((doc_id, start + at, n, zlib.crc32(own), *([own] if with_ids else [])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return blocks.select("part", "first", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, order_by: list[str] | None = None) -> DataFrame:
    """write_tokens to a new folder in the shared folder, and what read_tokens finds there; nulls, ties, repeated rows and empty tables
    as write_tokens says."""
    spark = docs.sparkSession
    path = f"{common.shared_dir(spark)}/refloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, order_by)
    return read_tokens(spark, path)
