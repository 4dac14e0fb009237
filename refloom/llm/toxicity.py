"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

F32 = np.float32


@dataclass(frozen=True)
class Settings:
    window: int = 64
    stride: int = 48
    hidden: int = 10
    word_dims: int = 8
    char_dims: int = 12
    attention: int = 8
    max_words: int = 20_000
    gram_buckets: int = 1 << 14
    grams: tuple[int, ...] = (3, 4, 5)
    #: at most so many labelled documents of each class are learned from, the first in a hash order
    fit_toxic: int = 2000
    fit_clean: int = 5000
    epochs: int = 5
    batch: int = 128
    rate: float = 0.01
    seed: int = 4


DEFAULT = Settings()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1 if doc_id is not None else False


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_grams(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all character n-grams of '<word>', the words' first places in them). Every word has one at least."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(b))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    for n in s.grams:
        ok = np.flatnonzero(left >= n)
        h = np.full(len(ok), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + b[ok + k] + np.uint64(1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        rows.append(((h >> np.uint64(40)) % np.uint64(s.gram_buckets)).astype(np.int64))
        owners.append(owner[ok])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    rows, owners = rows[order], owners[order]
    return rows, np.searchsorted(owners, np.arange(len(words)))


class Network:
    """Inputs of a word: its embedding (of word 0 if unknown) and the mean of its character n-grams' embeddings."""

    def __init__(self, s: Settings, vocabulary: dict[bytes, int], word_odds: np.ndarray, gram_odds: np.ndarray):
        rng = np.random.default_rng(s.seed)
        h, d, a = s.hidden, s.word_dims + s.char_dims, s.attention
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(F32)
        self.s, self.vocabulary = s, vocabulary
        self.p = {
            "words": draw(len(vocabulary) + 1, s.word_dims, scale=0.1),
            "grams": draw(s.gram_buckets, s.char_dims, scale=0.1),
            "w": draw(2, d, 3 * h, scale=d**-0.5),
            "u": draw(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 1, 3 * h), F32),
            "c": np.zeros((2, 1, h), F32),
            "wa": draw(2 * h, a, scale=(2 * h) ** -0.5),
            "ba": np.zeros(a, F32),
            "va": draw(a, scale=a**-0.5),
            "wo": draw(2 * h, scale=(2 * h) ** -0.5),
            "bo": np.zeros(1, F32),
        }
        # where learning starts: log odds of the fitted documents' words and n-grams
        self.p["words"][1:, 0] = word_odds
        self.p["grams"][:, 0] = gram_odds

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, first = word_grams(words, self.s)
        return np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64), rows, first

    def embed(self, ids: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(first, len(rows)))
        chars = np.add.reduceat(self.p["grams"][rows], first, axis=0) / counts[:, None].astype(F32)
        return np.concatenate([self.p["words"][ids], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of words: (2 directions, words, 3 hidden)."""
        return x @ self.p["w"] + self.p["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """gates: of the words that `at` (windows x steps) names. Returns logits, and what backward needs."""
        p, h = self.p, self.s.hidden
        n, steps = at.shape
        state = np.zeros((2, n, h), F32)
        out = np.empty((steps, 2, n, h), F32)
        kept = []
        full = int(lengths.min()) if n else 0
        for t in range(steps):
            x = np.stack([gates[0][at[:, t]], gates[1][at[:, steps - 1 - t]]])
            hu = state @ p["u"]
            zr = _sigmoid(x[..., : 2 * h] + hu[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            hc = hu[..., 2 * h :] + p["c"]
            m = 2 * _sigmoid(2 * (x[..., 2 * h :] + r * hc)) - 1
            new = m + z * (state - m)
            if t >= full or steps - 1 - t >= full:
                live = np.stack([t < lengths, steps - 1 - t < lengths])[..., None]
                new = np.where(live, new, state)
            if keep:
                kept.append((state, z, r, hc, m))
            state = new
            out[t] = state
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)  # steps, windows, 2 h
        e = np.tanh(both @ p["wa"] + p["ba"])
        score = e @ p["va"]
        score = np.where(np.arange(steps)[:, None] < lengths[None, :], score, -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        logits = pooled @ p["wo"] + p["bo"][0]
        return (logits, (kept, both, e, weight, pooled)) if keep else (logits, None)

    def gradients(self, words: list[np.ndarray], at: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
        """words: what inputs() gives for the batch's distinct words."""
        p, h = self.p, self.s.hidden
        n, steps = at.shape
        x = self.embed(*words)
        logits, (kept, both, e, weight, pooled) = self.forward(self.project(x), at, lengths, keep=True)
        prob = _sigmoid(logits)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
        dlogit = ((prob - target) / n).astype(F32)
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        dboth = weight[..., None] * dpool[None]
        dweight = np.einsum("tnh,nh->tn", both, dpool)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", dscore, e)
        de = dscore[..., None] * p["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", both, de), de.sum(axis=(0, 1))
        dboth = dboth + de @ p["wa"].T
        dgates = np.zeros((2, len(x), 3 * h), F32)
        dstate = np.zeros((2, n, h), F32)
        for t in range(steps - 1, -1, -1):
            state, z, r, hc, m = kept[t]
            dnew = dstate + np.stack([dboth[t, :, :h], dboth[steps - 1 - t, :, h:]])
            live = np.stack([t < lengths, steps - 1 - t < lengths])[..., None]
            dlive = np.where(live, dnew, 0)
            dz = dlive * (state - m) * z * (1 - z)
            dm = dlive * (1 - z) * (1 - m * m)
            dr = dm * hc * r * (1 - r)
            dhc = dm * r
            da = np.concatenate([dz, dr, dm], axis=2)
            dhu = np.concatenate([dz, dr, dhc], axis=2)
            g["u"] += np.swapaxes(state, 1, 2) @ dhu
            g["c"] += dhc.sum(axis=1, keepdims=True)
            dstate = np.where(live, dlive * z, dnew) + dhu @ np.swapaxes(p["u"], 1, 2)
            for k, column in ((0, t), (1, steps - 1 - t)):
                np.add.at(dgates[k], at[:, column], da[k])
        g["b"] = dgates.sum(axis=1, keepdims=True)
        g["w"] = np.swapaxes(x[None], 1, 2) @ dgates
        dx = (dgates @ np.swapaxes(p["w"], 1, 2)).sum(axis=0)
        ids, rows, first = words
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g["words"], ids, dx[:, : self.s.word_dims])
        counts = np.diff(np.append(first, len(rows)))
        np.add.at(g["grams"], rows, np.repeat(dx[:, self.s.word_dims :] / counts[:, None], counts, axis=0))
        loss = float(-(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7)).mean())
        return g, loss


def windows_of(n: int, s: Settings) -> list[tuple[int, int]]:
    """(start, length) of overlapping windows that cover n words."""
    if n <= s.window:
        return [(0, n)] if n else []
    starts = list(range(0, n - s.window, s.stride)) + [n - s.window]
    return [(k, s.window) for k in starts]


class Windows:
    """Windows of many texts: places in a list of distinct words."""

    def __init__(self, texts: list[np.ndarray], s: Settings):
        spans = [(k, *w) for k, t in enumerate(texts) for w in windows_of(len(t), s)]
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = np.concatenate([*texts, np.zeros(1, np.int64)]) if texts else np.zeros(1, np.int64)
        self.owner = np.array([k for k, *_ in spans], dtype=np.int64)
        self.lengths = np.array([n for *_, n in spans], dtype=np.int64)
        starts = base[self.owner] + np.array([a for _, a, _ in spans], dtype=np.int64) if spans else np.zeros(0, np.int64)
        steps = np.arange(s.window)
        places = np.minimum(starts[:, None] + np.minimum(steps[None, :], self.lengths[:, None] - 1), len(flat) - 1)
        self.at = flat[places].astype(np.int32)


def _odds(present: np.ndarray, absent: np.ndarray, n_present: int, n_absent: int) -> np.ndarray:
    return np.clip(np.log((present + 0.5) / (n_present + 1)) - np.log((absent + 0.5) / (n_absent + 1)), -2, 6).astype(F32) / 2


def _all_grams(words: list[bytes], s: Settings, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """word_grams of many words, in parts that bound its memory."""
    parts, firsts, n = [np.zeros(0, np.int32)], [], 0
    for k in range(0, len(words), at_once):
        rows, first = word_grams(words[k : k + at_once], s)
        parts.append(rows.astype(np.int32))
        firsts.append(first + n)
        n += len(rows)
    return np.concatenate(parts), np.concatenate(firsts)


def _spans(first: np.ndarray, ends: np.ndarray, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some words, and the words' first places in them."""
    counts = ends[words] - first[words]
    own_first = np.cumsum(counts) - counts
    return rows[np.repeat(first[words] - own_first, counts) + np.arange(int(counts.sum()))], own_first


def fit(texts: list[bytes], toxic: list[int], s: Settings = DEFAULT) -> Network | None:
    """The network, or None if there is only one class or no word. Windows of clean texts are clean. Of a toxic text the
    window that scores highest is learned as toxic, chosen anew before each epoch; of clean texts, the highest and random
    ones."""
    y = np.array(toxic, dtype=F32)
    if not len(y) or y.min() == y.max():
        return None
    codes, counts, words = common.split_words([t.translate(common.ALNUM_WORDS) for t in texts])
    if not words:
        return None
    indexed = np.split(codes, np.cumsum(counts)[:-1])
    rows, first = _all_grams(words, s)
    ends = np.append(first[1:], len(rows))
    n = [int((y == 0).sum()), int((y == 1).sum())]
    seen, grams = np.zeros((2, len(words))), np.zeros((2, s.gram_buckets))
    for own, label in zip(indexed, toxic, strict=True):
        own = np.unique(own)
        seen[label, own] += 1
        grams[label, np.unique(_spans(first, ends, rows, own)[0])] += 1
    total = seen.sum(axis=0)
    commonest = sorted(np.flatnonzero(total > 1).tolist(), key=lambda k: (-total[k], words[k]))[: s.max_words]
    net = Network(s, {words[k]: at + 1 for at, k in enumerate(commonest)}, _odds(seen[1, commonest], seen[0, commonest], n[1], n[0]), _odds(grams[1], grams[0], n[1], n[0]))
    ids = np.zeros(len(words), np.int64)
    ids[commonest] = np.arange(1, len(commonest) + 1)
    del codes, words, seen, total
    rng = np.random.default_rng(s.seed)
    all_windows = Windows(indexed, s)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    owner, label = all_windows.owner, y[all_windows.owner]
    for epoch in range(s.epochs):
        if epoch:
            gates = np.empty((2, len(ids), 3 * s.hidden), F32)
            for start in range(0, len(ids), 20_000):
                part = np.arange(start, min(start + 20_000, len(ids)))
                gates[:, part] = net.project(net.embed(ids[part], *_spans(first, ends, rows, part)))
            logits = _scores(net, gates, all_windows)
            del gates
        else:  # before anything is learned: the words' log odds
            top = np.append(net.p["words"][:, 0], 0)[np.append(ids, 0)]
            logits = top[all_windows.at].max(axis=1)
        order = np.lexsort((rng.random(len(owner)), logits, owner))
        best = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order
        clean = np.flatnonzero(label == 0)
        extra = rng.choice(clean, min(len(clean), 2 * n[0]), replace=False)
        chosen = rng.permutation(np.unique(np.concatenate([best, extra])))
        for start in range(0, len(chosen), s.batch):
            part = chosen[start : start + s.batch]
            used, at = np.unique(all_windows.at[part], return_inverse=True)
            g, _ = net.gradients([ids[used], *_spans(first, ends, rows, used)], at.reshape(len(part), -1), all_windows.lengths[part], label[part])
            step += 1
            for k, v in net.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] * g[k] - m2)
                v -= (s.rate * (1 - epoch / s.epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(F32)
    return net


def _scores(net: Network, gates: np.ndarray, windows: Windows, batch: int = 1024) -> np.ndarray:
    out = np.zeros(len(windows.owner), F32)
    order = np.argsort(-windows.lengths, kind="stable")
    for start in range(0, len(order), batch):
        part = order[start : start + batch]
        longest = int(windows.lengths[part[0]])
        out[part] = net.forward(gates, windows.at[part, :longest], windows.lengths[part])[0]
    return out


class Scorer:
    """Keeps the gate inputs of words it has met until there are `keep` of them."""

    def __init__(self, net: Network, prior: float, keep: int = 200_000):
        self.net, self.prior, self.keep = net, prior, keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((2, 0, 3 * self.net.s.hidden), F32)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        made = self.net.project(self.net.embed(*self.net.inputs(new)))
        need = self.used + len(new)
        if need > self.gates.shape[1]:
            room = np.zeros((2, max(need, 2 * self.gates.shape[1]), self.gates.shape[2]), F32)
            room[:, : self.used] = self.gates[:, : self.used]
            self.gates = room
        self.gates[:, self.used : need] = made
        self.known.update(zip(new, range(self.used, need), strict=True))
        self.used = need

    def score(self, texts: list[bytes]) -> list[float]:
        """The highest probability of a text's windows; of no words, the share of toxic texts learned from."""
        codes, counts, words = common.split_words([t.translate(common.ALNUM_WORDS) for t in texts])
        new = sorted(set(words).difference(self.known))
        if self.known and len(self.known) + len(new) > self.keep:
            self._forget()
            new = sorted(words)
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        windows = Windows(np.split(known[codes], np.cumsum(counts)[:-1]), self.net.s)
        logits = np.full(len(texts), -np.inf, F32)
        if len(windows.owner):
            np.maximum.at(logits, windows.owner, _scores(self.net, self.gates, windows))
        return [float(p) if n else self.prior for p, n in zip(_sigmoid(logits.astype(np.float64)), counts.tolist(), strict=True)]


def fit_rows(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Whole labelled texts outside the held-out part, at most fit_toxic and fit_clean ids of docs, first by a hash of the id."""
    y = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    texts = common.texts(docs, id_col, text_col)
    learned = y.where(F.crc32(F.col("label_id").cast("string")) % 3 != 1).join(texts.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    ids = [learned.where(F.col("toxic") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for k, n in ((1, s.fit_toxic), (0, s.fit_clean))]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # no more rows than the two limits
    rows = texts.join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return rows.dropDuplicates(["doc_id", "text"])


def fitted(rows: DataFrame, s: Settings) -> tuple[Network | None, float]:
    """(the network, the share of toxic texts), fitted in one task, which the limits of fit_rows bound."""
    schema = pa.schema([("net", pa.binary()), ("prior", pa.float64())])

    def run(batches):
        common.clear_worker_caches()
        learned = sorted((r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)))
        if learned:
            net = fit([t.encode() for _, t, _ in learned], [y for *_, y in learned], s)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary()), pa.array([sum(y for *_, y in learned) / len(learned)])], schema=schema)

    made = rows.repartition(1).mapInArrow(run, "net binary, prior double").collect()
    return (pickle.loads(bytes(made[0]["net"])), made[0]["prior"]) if made else (None, 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold up) for every document.

    The network is fitted in one task on a bounded sample, settings.fit_toxic and settings.fit_clean labelled documents,
    whose crc32(id as text) mod 3 is not 1; all other work is on every document. A text's score is the highest of its
    overlapping windows of `window` words, which cover the whole of it. Only the text is an input of a score. Words that are not among
    the max_words commonest of the sample have one embedding; every word also has those of its character n-grams, hashed to
    gram_buckets.

    Texts without words (null, empty) score the share of toxic texts learned from. Without labels of both classes that share,
    or 0, is every score. Equal texts, whatever their ids, have equal scores. Repeated rows and ids each get a row; a null id is not held out; of contradicting labels of an id
    the toxic one holds; null labels are not learned. An empty table gives an empty table. Other columns are not read.
    """
    net, prior = fitted(fit_rows(docs, labels, settings, id_col, text_col, label_col), settings)
    shared = docs.sparkSession.sparkContext.broadcast((net, prior))
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        common.clear_worker_caches()
        net, prior = shared.value
        scorer = Scorer(net, prior) if net else None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in common.byte_column(batch, "text", 200):
                score = scorer.score(texts) if scorer else [prior] * len(texts)
                own = ids[start : start + len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([held_out(i) for i in own], pa.bool_()), pa.array(score, pa.float64()), pa.array([int(x >= threshold) for x in score], pa.int32())], schema=arrow)

    texts = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, with all columns, whose text scores below the threshold, by the network and rules of score_toxicity. Rows are
    judged one by one, whatever their ids."""
    net, prior = fitted(fit_rows(docs, labels, settings, id_col, text_col, label_col), settings)
    shared = docs.sparkSession.sparkContext.broadcast((net, prior))

    def keeps():
        net, prior = shared.value
        scorer = Scorer(net, prior) if net else None
        return lambda texts: [x < threshold for x in (scorer.score(texts) if scorer else [prior] * len(texts))]

    return common.kept_rows(docs, text_col, keeps)
