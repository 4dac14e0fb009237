"""Benchmark decontamination: a prefix-filtered set join of item windows with all word windows of the documents."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("containment", T.DoubleType()),
    ]
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("containment", pa.float64())]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(common.ALNUM_WORDS).split()


def item_windows(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All windows of n words; an item of fewer words, but not none, is one window."""
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _in_order(items) -> list[int | None]:
    """Ascending, null the last."""
    return sorted(items, key=lambda x: (x is None, x or 0))


class WindowIndex:
    """Windows under their rarest word. A document window equals an item window only if it holds all its words, so of the
    words in order of rarity a prefix of one is necessary (size - size + 1) and enough to find every candidate; its place
    in the window then fixes where the candidate begins."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int, frequency: dict[bytes, int]):
        #: by rarest word: (its place, window, item)
        self.by_word: dict[bytes, list[tuple[int, tuple[bytes, ...], list[int]]]] = defaultdict(list)
        owners: dict[tuple[bytes, ...], list[int | None]] = defaultdict(list)
        self.sizes: dict[int, int] = {}
        self.spans: dict[int, int] = {}
        for item, text in items:
            words = words_of(text)
            found = set(item_windows(words, n))
            self.sizes[item] = max(self.sizes.get(item, 0), len(found))
            self.spans[item] = max(self.spans.get(item, 0), len(words))
            for w in found:
                owners[w].append(item)
        for w, own in owners.items():
            place = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
            self.by_word[w[place]].append((place, w, _in_order(set(own))))
        self.by_word = dict(self.by_word)

    def match(self, words: list[bytes]) -> tuple[list[int], list[int], float]:
        """(places of hit words, items, the largest share of an item's windows inside one item-sized window)."""
        by_word, n = self.by_word, len(words)
        hit: set[int] = set()
        at: dict[int, list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        for i in [i for i, w in enumerate(words) if w in by_word]:
            for place, window, own in by_word[words[i]]:
                start, size = i - place, len(window)
                if start >= 0 and start + size <= n and tuple(words[start : start + size]) == window:
                    hit.update(range(start, start + size))
                    for item in own:
                        at[item].append((start, window))
        best = 0.0
        for item, found in at.items():
            found.sort(key=lambda x: x[0])
            inside: Counter = Counter()
            first = 0
            for start, window in found:
                inside[window] += 1
                while found[first][0] <= start + len(window) - self.spans[item] - 1:
                    inside[found[first][1]] -= 1
                    if not inside[found[first][1]]:
                        del inside[found[first][1]]
                    first += 1
                best = max(best, len(inside) / self.sizes[item])
        return sorted(hit), _in_order(at), best


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of about block_words words, one block on the driver at a time."""
    rows = items.select(items[item_col].cast("long").alias("item"), items[text_col].cast("string").alias("text")).where("text is not null")
    block, size = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        text = r["text"].encode()
        block.append((r["item"], text))
        size += len(words_of(text))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_frequency(rows: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of a bounded vocabulary, over all documents."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        common.clear_worker_caches()
        known, total = shared.value, Counter()
        for batch in batches:
            for _, texts in common.byte_column(batch, "text"):
                for t in texts:
                    total.update(known.intersection(words_of(t)))
        yield from common.count_rows(total, schema)

    counted = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in common.collect_bounded(counted, len(vocabulary), "words of a block of items")}


def contaminate(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """For every document: doc_id, text_hash, n_words, hit_words (places), items (that have a window in it), containment.

    Words are A-Z lower-cased runs of 0-9, a-z and all characters above 0x7F. An item's set is that of its windows of n
    consecutive words, or of one window if it has fewer. Word frequencies over all documents order each window's words by
    rarity; the join on the necessary prefix, the rarest word, gives candidates, its place and both lengths bound them, and
    the words are compared. containment is the largest share of an item's distinct windows found inside a stretch of the
    document as long as the item.

    Items are a query set: they come to the driver and executors in blocks of about block_words words, each of which is
    joined with all documents, so their number is not limited. Null or empty texts have no words and no hits; items without
    words match nothing; a null item id is an item of its own; items that share an id are one item. Repeated documents each get their row.
    Long texts are matched whole. Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    rows = common.texts(docs, id_col, text_col)
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    parts = [_pass(rows, block, n) for block in _blocks(items, item_col, item_text_col, block_words)] or [_pass(rows, [], n)]
    if len(parts) == 1:
        return parts[0]
    merged = common.union_of(parts).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("containment").alias("containment"), F.count(F.lit(1)).alias("rows"),
    )
    times = F.explode(F.sequence(F.lit(1), (F.col("rows") / len(parts)).cast("int")))
    return merged.withColumn("copy", times).drop("copy", "rows")


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """The rows of docs, with all columns, that hold no window of an item, by the words, windows and blocks of contaminate. Rows are
    judged one by one, whatever their ids."""
    rows = docs
    for block in _blocks(items, item_col, item_text_col, block_words):
        index = _index(common.texts(docs, text_col, text_col), block, n)

        def keeps(index=index):
            return lambda texts: [not index.value.match(words_of(t))[0] for t in texts]

        rows = common.kept_rows(rows, text_col, keeps)
    return rows


def _index(rows: DataFrame, block: list[tuple[int | None, bytes]], n: int):
    """The broadcast index of a block of items, its words ordered by their documents among rows."""
    vocabulary = {w for _, text in block for w in words_of(text)}
    frequency = word_frequency(rows, vocabulary) if vocabulary else {}
    return rows.sparkSession.sparkContext.broadcast(WindowIndex(block, n, frequency))


def _pass(rows: DataFrame, block: list[tuple[int, bytes]], n: int) -> DataFrame:
    index = _index(rows, block, n)

    def join(batches):
        common.clear_worker_caches()
        known = index.value
        for batch in batches:
            for start, texts in common.byte_column(batch, "text"):
                found = []
                for t in texts:
                    words = words_of(t)
                    found.append((len(words), *known.match(words)))
                columns = list(zip(*found, strict=True))
                part = [batch.column(c).slice(start, len(texts)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*part, *(pa.array(c, ARROW.field(k + 2).type) for k, c in enumerate(columns))], schema=ARROW)

    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(join, RESULT)
