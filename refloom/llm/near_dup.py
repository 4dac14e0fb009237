"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, bands, exact weighted Jaccard."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import mixed, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    #: bands x rows samples; a pair at the similarity shares no band with probability (1 - 0.8**4)**20 = 3e-5
    bands: int = 20
    rows: int = 4
    #: document frequencies are told apart from this share of all documents up
    rare: float = 0.01
    #: counters of the document-frequency table, for each shingle of a mean document
    counters: int = 512
    triples: int = 1 << 16
    #: nodes, and bytes of shingles, of a block of a large band
    block_nodes: int = 2048
    block_bytes: int = 8_000_000
    seed: int = 20


DEFAULT = Settings()


class Sampler:
    """Improved consistent weighted sampling: for sample k a shingle of weight w has r, c ~ Gamma(2, 1) and b ~ U(0, 1) of
    its own, t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the shingle of the least a, with its t, is
    the sample. The three numbers come from a table of triples, at a place hashed from the shingle and k; of shingles
    with the same triple and weight, the one of the smaller hash comes first."""

    def __init__(self, s: Settings, frequency: np.ndarray, n_docs: int):
        rng = np.random.default_rng(s.seed)
        size = s.triples
        self.s, self.counters = s, len(frequency)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.r, self.log_c, self.b = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
        self.multipliers = rng.integers(1 << 62, 1 << 63, s.bands * s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        share = np.maximum(frequency / max(n_docs, 1), s.rare)
        #: inverse document frequency by counter: ln(1 + 1 / share)
        self.idf = np.log1p(1 / np.minimum(share, 1.0)).astype(np.float32)
        self.usual = np.float32(np.log1p(1 / s.rare))
        t, a = self._draw(np.arange(size), np.full(size, self.usual, dtype=np.float64))
        self.usual_t, self.usual_a = t, a.astype(np.float32)

    def _draw(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, b = self.r[at], self.b[at]
        t = np.floor(np.log(w) / r + b)
        return t.astype(np.int64), self.log_c[at] - r * (t - b) - r

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in ascending order, and their weights: count x inverse document frequency."""
        h, n = np.unique(shingle_hashes(word_hashes(text), self.s.words), return_counts=True)
        return h, n.astype(np.float32) * self.idf[counter(h, self.counters)]

    def bands(self, h: np.ndarray, w: np.ndarray) -> list[int]:
        odd = np.flatnonzero(w != self.usual)
        ks = len(self.multipliers)
        best = np.full(ks, np.inf, np.float32)
        sample, ts = np.zeros(ks, np.uint64), np.zeros(ks, np.int64)
        for start in range(0, len(h), 1024):
            part = h[start : start + 1024]
            hashed = part * self.multipliers[:, None]
            at = (hashed >> self.shift).astype(np.int64)
            a = self.usual_a[at]
            mine = odd[(odd >= start) & (odd < start + 1024)] - start
            if len(mine):
                t_odd, a_odd = self._draw(at[:, mine], w[mine + start].astype(np.float64))
                a[:, mine] = a_odd
            first = a.argmin(axis=1)
            rows = np.arange(ks)
            least = a[rows, first]
            t = self.usual_t[at[rows, first]]
            if len(mine):
                where = np.searchsorted(mine, first)
                own = (where < len(mine)) & (mine[np.minimum(where, len(mine) - 1)] == first)
                t[own] = t_odd[rows[own], where[own]]
            better = least < best  # ties go to the smaller hash, as shingles come in ascending order
            best[better], sample[better], ts[better] = least[better], part[first][better], t[better]
        weighted = mixed(sample + mixed(ts.astype(np.uint64) + np.uint64(77)))
        keys = weighted.reshape(self.s.bands, self.s.rows)
        total = np.arange(self.s.bands, dtype=np.uint64)
        for k in range(self.s.rows):
            total = mixed(total * np.uint64(31) + keys[:, k])
        return total.view(np.int64).tolist()


def counter(h: np.ndarray, counters: int) -> np.ndarray:
    return (h % np.uint64(counters)).astype(np.int64)


def content_key(text: bytes) -> bytes:
    """Equal for texts of the same words in the same order; of texts without words, for equal texts."""
    words = text.translate(common.ALNUM_WORDS).split()
    return hashlib.blake2b(b" ".join(words) if words else b"\0" + text, digest_size=16).digest()


CHUNK = 1 << 14


def document_frequency(texts: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(counters, documents): for each counter the documents that hold a shingle hashed to it, over all documents.

    A shingle shares its counter with others, which make its count too high by g / m of all documents on average, of g
    shingles in a mean document and m counters. The table has about 512 counters for each of them (a word is taken for six
    bytes), 2**18 to 2**24 in all, so that this is 0.2 % or less, a fifth of `rare`, up to means of 200 KB a text. Shares
    below `rare` are not told apart. Tables are added in two steps, of 64 tasks' and then of all."""
    schema = "salt int, chunk int, n long, counts binary"
    arrow = pa.schema([("salt", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])
    mean = texts.select(F.avg(F.octet_length(F.coalesce("text", F.lit("")))).alias("mean")).first()["mean"] or 0
    counters = 1 << min(24, max(18, int(s.counters * mean / 6).bit_length()))
    size = min(CHUNK, counters)

    def rows(salt: int, n: int, total: np.ndarray):
        parts = total.reshape(-1, size)
        return pa.RecordBatch.from_arrays([pa.array([salt] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], schema=arrow)

    def count(batches):
        common.clear_worker_caches()
        total, n = np.zeros(counters, np.int64), 0
        for batch in batches:
            for _, values in common.byte_column(batch, "text", 500):
                for t in values:
                    total[np.unique(counter(shingle_hashes(word_hashes(t), s.words), counters))] += 1
                    n += 1
        if n:
            yield rows(TaskContext.get().partitionId() // 64, n, total)

    def add(part: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, "<i8") for c in part.column("counts").to_pylist())
        n = sum(part.column("n").to_pylist())
        return pa.table([pa.array([part.column("salt")[0].as_py()], pa.int32()), pa.array([part.column("chunk")[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], schema=arrow)

    tables = texts.select("text").mapInArrow(count, schema)
    added = tables.groupBy("salt", "chunk").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    found = sorted(common.collect_bounded(added, counters // size, "parts of the frequency table"), key=lambda r: r["chunk"])
    if not found:
        return np.zeros(counters, np.int64), 0
    return np.concatenate([np.frombuffer(bytes(r["counts"]), "<i8") for r in found]), found[0]["n"]


def sketch(texts: DataFrame, sampler, s: Settings) -> DataFrame:
    """doc_id, node (content key), weight (of all shingles), bands (none without words)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("weight", pa.float64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        common.clear_worker_caches()
        own = sampler.value
        for batch in batches:
            for start, values in common.byte_column(batch, "text", 500):
                weights, bands = [], []
                for t in values:
                    h, w = own.vector(t)
                    weights.append(float(w.sum(dtype=np.float64)))
                    bands.append(own.bands(h, w) if len(h) else [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(values)), pa.array(map(content_key, values), pa.binary()), pa.array(weights, pa.float64()), pa.array(bands, arrow.field(3).type)], schema=arrow)

    return texts.mapInArrow(run, "doc_id long, node binary, weight double, bands array<long>")


def _vectors(texts: DataFrame, needed: DataFrame, sampler) -> DataFrame:
    """node, vec (its distinct shingles' hashes and weights) for the needed nodes: a document of that text is read again."""
    arrow = pa.schema([("node", pa.binary()), ("vec", pa.binary())])

    def run(batches):
        common.clear_worker_caches()
        own = sampler.value
        for batch in batches:
            for _, values in common.byte_column(batch, "text", 500):
                vectors = [own.vector(t) for t in values]
                yield pa.RecordBatch.from_arrays([pa.array(map(content_key, values), pa.binary()), pa.array([h.astype("<u8").tobytes() + w.astype("<f4").tobytes() for h, w in vectors], pa.binary())], schema=arrow)

    ids = needed.select(F.col("doc_id").alias("need_id"))
    rows = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("need_id")), "left_semi")
    # rows that share an id with a needed one may have other texts
    return common.write_shared(rows.select("text").mapInArrow(run, "node binary, vec binary").dropDuplicates(["node"]), "vectors")


def unpacked(vec: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vec) // 12
    return np.frombuffer(vec, "<u8", n), np.frombuffer(vec, "<f4", n, 8 * n)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    (h, v), (g, w) = unpacked(a), unpacked(b)
    if not len(h) or not len(g):
        return float(len(h) == len(g))
    at = np.searchsorted(g, h)
    at[at == len(g)] = 0
    same = g[at] == h
    shared = float(np.minimum(v[same], w[at[same]]).sum(dtype=np.float64))
    return shared / (float(v.sum(dtype=np.float64)) + float(w.sum(dtype=np.float64)) - shared)


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        common.clear_worker_caches()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                keep = pa.array([similarity(x.as_py(), y.as_py()) >= least for x, y in zip(part.column("va"), part.column("vb"), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], schema=arrow)

    va, vb = vectors.select(F.col("node").alias("a"), F.col("vec").alias("va")), vectors.select(F.col("node").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(run, "a binary, b binary")


def forest(vecs: list[bytes], labels: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links that join all labels whose texts, directly or by others of the list, reach the similarity: of all pairs of
    different labels, a spanning forest. A list's similarities to each text come from one pass over an index by shingle."""
    if not vecs:
        return []
    parts = [unpacked(v) for v in vecs]
    hashes, weights = np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts])
    owner = np.repeat(np.arange(len(vecs)), [len(h) for h, _ in parts])
    order = np.argsort(hashes, kind="stable")
    by_hash, by_owner, by_weight = hashes[order], owner[order], weights[order]
    totals = np.bincount(owner, weights=weights, minlength=len(vecs))
    codes = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    root = np.array([codes[x] for x in labels])
    links = []
    for k, (h, w) in enumerate(parts):
        if (root == root[0]).all():
            break
        first, last = np.searchsorted(by_hash, h, "left"), np.searchsorted(by_hash, h, "right")
        counts = last - first
        ends = np.cumsum(counts)
        at = np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        shared = np.bincount(by_owner[at], weights=np.minimum(by_weight[at], np.repeat(w, counts)), minlength=len(vecs))
        alike = shared >= least * (totals + totals[k] - shared)
        for j in np.flatnonzero(alike & (root != root[k])).tolist():
            if root[j] != root[k]:
                links.append((k, j))
                root[root == root[j]] = root[k]
    return links


def _inside_bands(open_bands: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Links across components inside bands, by blocks of at most about block_nodes nodes and block_bytes of shingles: every
    two blocks of a band meet in one group, so rows grow with nodes x blocks and no group with the band."""
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    key = ["band", "value", "low", "high"]

    def run(batches):
        common.clear_worker_caches()
        last, rows = None, []

        def links():
            pairs = forest([r[2] for r in rows], [r[1] for r in rows], s.similarity)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in pairs], pa.binary()), pa.array([rows[j][0] for _, j in pairs], pa.binary())], schema=arrow)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
            for k, this in enumerate(keys):
                if this != last:
                    if len(rows) > 1:
                        yield links()
                    last, rows = this, []
                rows.append(tuple(batch.column(c)[k].as_py() for c in ("node", "label", "vec")))
        if len(rows) > 1:
            yield links()

    blocked = open_bands.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocked = blocked.select("band", "value", "node", "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    grouped = blocked.join(vectors, "node").repartition(*key).sortWithinPartitions(*key)
    return grouped.select(*key, "node", "label", "vec").mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id (the smallest id of the group), group_size for every document. Groups are the connected components of
    links between texts whose Jaccard similarity, weighted over TF-IDF shingles, is at least the setting. What many documents
    hold weighs little, so near copies in a group that is a large part of the corpus are told apart by less than elsewhere.

    1. A table of counters gives document frequencies over all documents. 2. One pass gives each document a key of its
    words, its bands of samples and its weight; documents of one key are copies, and one of them stands for all. 3. The nodes
    of a band are compared with one of them, its hub, the one that meets the most nodes over all its bands: as many
    comparisons as nodes. 4. In bands whose other nodes are then still in several components, all are compared across
    components, block by block, and only links that join components come out. So no link that a band shows is lost, and a
    group of thousands of near copies does not make all its pairs.

    Words are A-Z lower-cased runs of 0-9, a-z and characters above 0x7F; a text of fewer than five words is one shingle;
    texts without words are copies only of equal texts (null is empty). Texts are read whole. Rows that repeat an id each get
    a row; null ids are kept, and a group of null ids only has a null group_id. An empty table gives an empty table. Other
    columns are not read.
    """
    s = settings
    spark = docs.sparkSession
    texts = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sampler = spark.sparkContext.broadcast(Sampler(s, *document_frequency(texts, s)))
    sketched = common.write_shared(sketch(texts, sampler, s), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands"))
    nodes = common.write_shared(nodes, "nodes")
    banded = nodes.select("node", "weight", F.posexplode("bands").alias("band", "value"))
    shared = common.write_shared(banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("band_weight")).where("n > 1"), "bands")
    members = common.write_shared(banded.join(shared, ["band", "value"]), "members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    needed = nodes.join(met.select("node"), "node", "left_semi").select("doc_id").distinct()
    vectors = _vectors(texts, needed, sampler)
    hubs = members.join(met.select("node", "met"), "node").groupBy("band", "value").agg(F.max(F.struct("met", "node")).alias("top"))
    hubs = hubs.select("band", "value", F.col("top.node").alias("hub"))
    spokes = common.write_shared(members.join(hubs, ["band", "value"]).where("node <> hub"), "spokes")
    common.release(shared, members)
    stars = spokes.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = common.write_shared(_verified(stars, vectors, s.similarity), "links")
    labels = components(links)
    placed = spokes.select("band", "value", "node", "n", "band_weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_bands = placed.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "value")
    bytes_of = F.col("band_weight") / float(sampler.value.usual) * 12
    blocks = F.ceil(F.greatest(F.col("n") / s.block_nodes, bytes_of / s.block_bytes)).cast("long")
    opened = placed.join(mixed_bands, ["band", "value"], "left_semi").select("band", "value", "node", "label", blocks.alias("blocks"))
    more = common.write_shared(_inside_bands(opened, vectors, s), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    common.release(spokes, vectors, links, more)
    classes = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = classes.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_size"))
    classes = classes.join(groups, "label").select("node", "group_id", "group_size")
    return sketched.select("doc_id", "node").join(classes, "node").select("doc_id", "group_id", "group_size")
