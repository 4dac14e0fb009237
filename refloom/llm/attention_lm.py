"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside a unigram base over words.

The model reads symbols: the commonest ids one by one, all other ids as one, and the end of a text. Inside a symbol of many
ids an id has its share of the training texts' ids, so the probabilities of all ids sum to one. Attention's distribution over
symbols is mixed with one counted over all training texts: of the symbol after each symbol and the kind of the one before it.
"""

from __future__ import annotations

import zlib
from copy import deepcopy
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rans
from .shingles import words_of_all

F32 = np.float32
#: Bytes 0x09-0x0D become spaces and A-Z a-z: a split at spaces gives the base's words.
BLANK_WORDS = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    #: symbols: classes x members
    classes: int = 32
    members: int = 32
    #: each block of so many tokens is scored with as many before it as context: windows of twice the block
    block: int = 16
    keys: int = 8
    hidden: int = 32
    #: the weights start on the driver from so many pieces of training texts at most, of so many blocks each, drawn by a hash
    start_pieces: int = 5000
    piece: int = 64
    #: blocks drawn for the start, pass after pass over those pieces, but no more passes than this
    fit_blocks: int = 320_000
    fit_passes: int = 40
    #: then every training text is learned from, in a pass over all of its blocks (more than 1: one of so many); groups of about
    #: group_blocks of them are learned one after the other, apart from other groups
    every: int = 1
    group_blocks: int = 200_000
    batch: int = 128
    rate: float = 0.006
    #: the rate of that pass, and the steps that a group takes, if it has `batch` blocks for each
    later_rate: float = 0.003
    later_steps: int = 400
    #: what the distribution counted over all training texts has in the mixture, the kinds of symbols it tells apart, and
    #: the weight of the shorter context in it
    counted: float = 0.2
    kinds: int = 32
    shorter: float = 20.0
    seed: int = 3
    #: words with at least this share of the training tokens are sent to all executors: no more than its inverse
    common_share: float = 5e-7


DEFAULT = Settings()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1 if doc_id is not None else False


class Symbols:
    """Ids to symbols. counts: of every id of the vocabulary in all training texts, the end id last."""

    def __init__(self, counts: np.ndarray, s: Settings):
        size = s.classes * s.members
        ends = len(counts) - 1
        order = np.lexsort((np.arange(ends), -counts[:ends]))
        head = order[: size - 2]
        self.end, self.rest = size - 2, size - 1
        self.of = np.full(len(counts), self.rest, dtype=np.int64)
        self.of[head] = np.arange(len(head))
        self.of[ends] = self.end
        smoothed = counts.astype(np.float64) + 0.5
        own = np.bincount(self.of, weights=smoothed, minlength=size)
        self.share = own / own.sum() if own.sum() else np.full(size, 1 / size)
        self.share = np.maximum(self.share, 1e-12)
        #: log10 of an id's share of its symbol
        self.inside = np.log10(smoothed / own[self.of])


def _halves(vectors: np.ndarray, rows: np.ndarray, levels: int) -> list[np.ndarray]:
    """2**levels groups of equal size: cut at the middle along the direction of the largest spread, again and again."""
    if not levels:
        return [rows]
    x = vectors[rows] - vectors[rows].mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    order = rows[np.argsort(x @ v[0], kind="stable")]
    middle = len(order) // 2
    return _halves(vectors, order[:middle], levels - 1) + _halves(vectors, order[middle:], levels - 1)


class Model:
    """One layer of causal attention. A symbol's query, key and value are rows of tables, distances have weights of their
    own; the symbol, the one before it and what attention returns make the hidden state, from which first the class of the
    next symbol and then the symbol in its class are predicted."""

    def __init__(self, s: Settings, symbols: Symbols, pairs: np.ndarray):
        rng = np.random.default_rng(s.seed)
        size = s.classes * s.members
        self.s = s
        # classes: symbols with like predecessors
        seen = np.sqrt(pairs.T / np.maximum(pairs.sum(axis=0)[:, None], 1))
        u, d, _ = np.linalg.svd(seen, full_matrices=False)
        groups = _halves(u[:, :16] * d[:16], np.arange(size), s.classes.bit_length() - 1)
        self.class_of, self.member_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for c, g in enumerate(groups):
            self.class_of[g], self.member_of[g] = c, np.arange(len(g))
        share = np.array([symbols.share[g].sum() for g in groups])
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(F32)
        k, h = s.keys, s.hidden
        self.p = {
            "q": draw(size, k, scale=0.3), "k": draw(size, k, scale=0.3), "v": draw(size, k, scale=0.3),
            "far": np.zeros(2 * s.block, F32), "now": draw(size, h, scale=0.3), "before": draw(size, h, scale=0.3),
            "out": draw(k, h, scale=k**-0.5), "wc": draw(h, s.classes, scale=0.1), "bc": np.log(share).astype(F32),
            "wm": draw(s.classes, h, s.members, scale=0.1),
            "bm": np.stack([np.log(symbols.share[g] / symbols.share[g].sum()) for g in groups]).astype(F32),
        }
        b = s.block
        i, j = np.arange(b)[:, None], np.arange(2 * b)[None, :]
        #: of query i (at place block + i) and key j; keys after the query are masked
        self.distance = np.clip(b + i - j, 0, 2 * b - 1)
        self.later = np.where(j > b + i, F32(-1e9), F32(0))

    def attention(self, window: np.ndarray, valid: np.ndarray):
        """What attention returns for every query, a row each, and what its gradient needs. window: symbols (blocks x 2 block), the
        second half the queries; valid: keys that exist."""
        p, b, n = self.p, self.s.block, self.s.keys
        q, k, v = p["q"].take(window[:, b:], axis=0), p["k"].take(window, axis=0), p["v"].take(window, axis=0)
        weight = q @ np.swapaxes(k, 1, 2)
        weight += (p["far"][self.distance] + self.later).astype(weight.dtype)
        if _longest(p["q"]) * _longest(p["k"]) + np.abs(p["far"]).max() > 60:
            np.minimum(weight, F32(60), out=weight)
        np.exp(weight, out=weight)
        # only whole first halves are missing: in the first blocks of texts
        weight[~valid[:, 0], :, :b] = 0
        # weights stay undivided; each row's sum, once for each column of v
        total = weight.reshape(-1, 2 * b) @ np.ones((2 * b, n), weight.dtype)
        total += F32(1e-30)
        got = (weight @ v).reshape(-1, n)
        got /= total
        return got, (q, k, v, weight, total)

    def hidden(self, got: np.ndarray, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows of hidden states."""
        h = got @ self.p["out"]
        h += self.p["now"].take(now, axis=0)
        h += self.p["before"].take(before, axis=0)
        return np.tanh(h, out=h)

    def by_class(self, target: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Places of the targets that exist, class by class, and where each class begins and the last one ends."""
        c = np.where(real, self.class_of[target], self.s.classes).reshape(-1).astype(np.min_scalar_type(self.s.classes))
        ends = np.cumsum(np.bincount(c, minlength=self.s.classes + 1)[:-1])
        return np.argsort(c, kind="stable")[: ends[-1]], [0, *ends.tolist()]

    def logits_of(self) -> np.ndarray:
        """classes x (hidden + 1) x (classes + members): what a hidden state and a one give for all classes and the members of each."""
        p, s = self.p, self.s
        out = np.empty((s.classes, s.hidden + 1, s.classes + s.members), p["wc"].dtype)
        out[:, :-1, : s.classes], out[:, -1, : s.classes] = p["wc"], p["bc"]
        out[:, :-1, s.classes :], out[:, -1, s.classes :] = p["wm"], p["bm"]
        return out

    def exponentials(self, h: np.ndarray, bounds: list[int], weights: np.ndarray):
        """Class by class, for hidden states in the order of by_class: (class, its rows, their hidden states with a column of ones, the
        exponentials of the logits of all classes and then of the class's members, both sums of each row, which columns they add).
        One class's numbers stay in a core's cache."""
        s = self.s
        x = np.ones((len(h), s.hidden + 1), h.dtype)
        x[:, :-1] = h
        # hidden states lie between -1 and 1; where the weights allow logits whose exponentials don't fit, they are shifted
        large = np.abs(weights).sum(axis=1).max() > 80
        parts = np.repeat(np.eye(2, dtype=h.dtype), (s.classes, s.members), axis=0)
        room = np.empty((max(np.diff(bounds)), len(parts)), h.dtype)
        for j, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo < hi:
                e = np.matmul(x[lo:hi], weights[j], out=room[: hi - lo])
                if large:
                    for part in (e[:, : s.classes], e[:, s.classes :]):
                        part -= part.max(axis=1, keepdims=True)
                np.exp(e, out=e)
                yield j, slice(lo, hi), x[lo:hi], e, e @ parts, parts

    def probability(self, h: np.ndarray, target: np.ndarray, bounds: list[int], weights: np.ndarray) -> np.ndarray:
        """Of the targets, for hidden states in the order of by_class. weights: logits_of()."""
        own = self.members_at(target, bounds)
        out = np.empty(len(h), h.dtype)
        for j, rows, _, e, sums, _ in self.exponentials(h, bounds, weights):
            p = np.divide(e.reshape(-1).take(own[rows]), sums[:, 1], out=out[rows])
            p *= e[:, j]
            p /= sums[:, 0]
        return out

    def members_at(self, target: np.ndarray, bounds: list[int]) -> np.ndarray:
        """The targets' places in the flat arrays of exponentials of their classes."""
        row = np.arange(len(target)) - np.repeat(bounds[:-1], np.diff(bounds))
        return row * (self.s.classes + self.s.members) + self.s.classes + self.member_of.take(target)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs for rows of hidden states in any order."""
        order, bounds = self.by_class(target, np.ones(target.shape, bool))
        out = np.empty(len(h), h.dtype)
        with np.errstate(divide="ignore"):
            out[order] = np.log(self.probability(h.take(order, axis=0), target.take(order), bounds, self.logits_of()))
        return out

    def gradients(self, window: np.ndarray, valid: np.ndarray, target: np.ndarray, real: np.ndarray, with_loss: bool = True) -> tuple[dict, float]:
        """Of the mean loss of the queries that exist, and that loss (0 unless asked for)."""
        p, b, s = self.p, self.s.block, self.s
        got, (q, k, v, weight, total) = self.attention(window, valid)
        order, bounds = self.by_class(target, real)
        n = len(order)
        now, before = window[:, b:].reshape(-1).take(order), window[:, b - 1 : -1].reshape(-1).take(order)
        mine = got.take(order, axis=0)
        h = self.hidden(mine, now, before)
        weights = self.logits_of()
        back = np.ascontiguousarray(np.swapaxes(weights[:, :-1], 1, 2))
        own = self.members_at(target.reshape(-1).take(order), bounds)
        g, gw, loss = {}, np.zeros_like(weights), 0.0
        dh = np.empty_like(h)
        one = h.dtype.type(1 / n)
        for j, rows, x, d, sums, parts in self.exponentials(h, bounds, weights):
            at = own[rows]
            if with_loss:
                loss -= float(np.log(d[:, j] / sums[:, 0] * d.reshape(-1).take(at) / sums[:, 1]).sum()) / n
            np.divide(one, sums, out=sums)
            d *= sums @ parts.T
            d[:, j] -= one
            d.reshape(-1)[at] -= one
            np.matmul(x.T, d, out=gw[j])
            np.matmul(d, back[j], out=dh[rows])
        gc, gm = gw[:, :, : s.classes].sum(axis=0), gw[:, :, s.classes :]
        g["wc"], g["bc"], g["wm"], g["bm"] = gc[:-1], gc[-1], gm[:, :-1], gm[:, -1]
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        dh *= h
        g["out"] = mine.T @ dh
        # of the weighted sums of values before they are divided, and of what they are divided by
        dgot = np.zeros_like(got)
        dgot[order] = dh @ p["out"].T
        dgot /= total
        shared = (dgot * got) @ np.ones((s.keys, 1), got.dtype)
        dgot = dgot.reshape(q.shape)
        dv = np.swapaxes(weight, 1, 2) @ dgot
        dscore = dgot @ np.swapaxes(v, 1, 2)
        dscore -= shared.reshape(len(window), b, 1)
        dscore *= weight
        dq, dk = dscore @ k, np.swapaxes(dscore, 1, 2) @ q
        g["far"] = np.bincount(self.distance.reshape(-1), weights=dscore.sum(axis=0).reshape(-1), minlength=2 * b).astype(got.dtype)
        size = len(p["q"])
        by, *runs = _runs(now, size)
        g["now"] = _sums(dh, size, by, *runs)
        g["q"] = _sums(dq.reshape(-1, s.keys), size, order.take(by), *runs)
        g["before"] = _sums(dh, size, *_runs(before, size))
        runs = _runs(window.reshape(-1), size)
        g["k"], g["v"] = (_sums(x.reshape(-1, s.keys), size, *runs) for x in (dk, dv))
        return g, loss


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max()))


def _runs(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by places, the places that occur, and where in that order each of them begins."""
    counts = np.bincount(at, minlength=size)
    seen = np.flatnonzero(counts)
    return np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable"), seen, (np.cumsum(counts) - counts)[seen]


def _sums(values: np.ndarray, size: int, order: np.ndarray, seen: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A table of `size` rows, each the sum of the values whose place it is, by _runs of the places."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(seen):
        rows = values.take(order, axis=0)
        if rows.shape[1] % 2 == 0:  # two numbers are added at once as a complex one
            rows = rows.view(np.result_type(rows.dtype, np.complex64))
        out[seen] = np.add.reduceat(rows, first, axis=0).view(values.dtype)
    return out


class Blocks:
    """Blocks of many texts: windows of symbols, which of them exist, the symbol after each query, which queries exist."""

    def __init__(self, texts: list[np.ndarray], end: int, block: int):
        # inputs: end, text; targets: text, end
        counts = np.array([-(-(len(t) + 1) // block) for t in texts], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        firsts = np.cumsum(counts) - counts
        #: of each block, its number in its text
        self.number = np.arange(len(self.owner)) - np.repeat(firsts, counts)
        size = int(counts.sum()) * block
        source, target = np.full(size, end, np.int64), np.full(size, end, np.int64)
        self.real = np.zeros(size, bool)
        for t, k in zip(texts, firsts.tolist(), strict=True):
            at = k * block
            source[at + 1 : at + 1 + len(t)] = t
            target[at : at + len(t)] = t
            self.real[at : at + len(t) + 1] = True
        source, self.target, self.real = source.reshape(-1, block), target.reshape(-1, block), self.real.reshape(-1, block)
        begins = np.zeros(len(source), bool)
        begins[firsts] = True
        before = np.roll(source, 1, axis=0)
        before[begins] = end
        self.window = np.concatenate([before, source], axis=1)
        self.valid = np.concatenate([np.repeat(~begins[:, None], block, axis=1), np.ones_like(self.real)], axis=1)

    def packed(self, chosen: np.ndarray) -> np.ndarray:
        """The chosen blocks as rows of small integers, for `unpacked`."""
        tail = np.stack([self.valid[chosen, 0], self.real[chosen].sum(axis=1)], axis=1)
        return np.concatenate([self.window[chosen], self.target[chosen], tail], axis=1).astype("<i2")

    @classmethod
    def unpacked(cls, data: bytes, block: int) -> Blocks:
        out = cls.__new__(cls)
        rows = np.frombuffer(data, "<i2").reshape(-1, 3 * block + 2).astype(np.int64)
        out.window, out.target = rows[:, : 2 * block], rows[:, 2 * block : -2]
        out.real = np.arange(block) < rows[:, -1:]
        out.valid = np.ones(out.window.shape, bool)
        out.valid[:, :block] = rows[:, -2:-1] > 0
        return out


class Descent:
    """Steps of Adam on a model's weights."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        # all weights in one row, of which the model's tables become views
        self.flat = np.concatenate([v.reshape(-1) for v in model.p.values()])
        ends = np.cumsum([v.size for v in model.p.values()])
        model.p = {k: part.reshape(v.shape) for (k, v), part in zip(model.p.items(), np.split(self.flat, ends[:-1]), strict=True)}
        self.m1, self.m2 = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def learn(self, blocks: Blocks, part: np.ndarray, rate: float) -> None:
        self.step += 1
        of, _ = self.model.gradients(blocks.window[part], blocks.valid[part], blocks.target[part], blocks.real[part], with_loss=False)
        g = np.concatenate([of[k].reshape(-1) for k in self.model.p])
        # m1 += 0.1 (g - m1), m2 += 0.005 (g g - m2), in place
        self.m1 *= 0.9
        self.m1 += 0.1 * g
        np.multiply(g, g, out=g)
        g *= 0.005
        self.m2 *= 0.995
        self.m2 += g
        np.multiply(self.m2, 1 / (1 - 0.995**self.step), out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(self.m1, g, out=g)
        g *= rate / (1 - 0.9**self.step)
        self.flat -= g


def fit(blocks: Blocks, symbols: Symbols, pairs: np.ndarray, s: Settings = DEFAULT) -> Model:
    """The model that the weights start from. pairs: how often one symbol follows another."""
    model = Model(s, symbols, pairs)
    rng = np.random.default_rng(s.seed)
    n = len(blocks.target)
    passes = [rng.permutation(n) for _ in range(min(s.fit_passes, -(-s.fit_blocks // n)))] if n else []
    drawn = np.concatenate(passes)[: s.fit_blocks] if n else np.zeros(0, np.int64)
    steps = -(-len(drawn) // s.batch)
    descent = Descent(model)
    for step in range(1, steps + 1):
        descent.learn(blocks, drawn[(step - 1) * s.batch : step * s.batch], s.rate * min(1.0, step / 20) * (1 - step / (steps + 1)))
    return model


def fit_further(model: Model, blocks: Blocks, s: Settings = DEFAULT, chosen: np.ndarray | None = None) -> None:
    """One pass over the blocks, or the chosen ones, in an order drawn by the seed."""
    descent = Descent(model)
    order = np.random.default_rng(s.seed).permutation(len(blocks.target) if chosen is None else chosen)
    batch = max(s.batch, -(-len(order) // s.later_steps))
    for start in range(0, len(order), batch):
        descent.learn(blocks, order[start : start + batch], s.later_rate * min(1.0, (descent.step + 1) / 20) * (1 - start / len(order)))


class Counted:
    """Probability of a symbol after the one before it and the kind of the one before that: counts of all training texts,
    smoothed by the shorter context, and that by the symbols' shares."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, kind_of: np.ndarray, symbols: Symbols, s: Settings):
        self.cells, self.counts, self.kind_of, self.share, self.s = cells, counts, kind_of, symbols.share, s

    @cached_property
    def table(self) -> np.ndarray:
        """kinds x symbols x symbols numbers, each the upper half of a single precision one, rounded: 67 MB by the default settings."""
        size, w = len(self.share), F32(self.s.shorter)
        order = np.argsort(self.cells)
        cells, counts = self.cells[order], self.counts[order]
        bounds = np.searchsorted(cells, np.arange(self.s.kinds + 1) * size * size)
        pairs = np.bincount(cells % (size * size), weights=counts, minlength=size * size).astype(F32).reshape(size, size)
        pairs = (pairs + w * self.share.astype(F32)) / (pairs.sum(axis=1, keepdims=True) + w)
        out = np.empty((self.s.kinds, size, size), np.uint16)
        for k in range(self.s.kinds):
            part = np.zeros(size * size, F32)
            part[cells[bounds[k] : bounds[k + 1]] - k * size * size] = counts[bounds[k] : bounds[k + 1]]
            part = part.reshape(size, size)
            part += w * pairs
            part /= part.sum(axis=1, keepdims=True)
            out[k] = (part.view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)
        return out.reshape(-1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def probability(self, window: np.ndarray, target: np.ndarray, block: int) -> np.ndarray:
        """Of the targets of whole blocks."""
        return self.of(window[:, block - 1 : -1], window[:, block:], target)

    def of(self, before: np.ndarray, now: np.ndarray, target: np.ndarray) -> np.ndarray:
        size = len(self.share)
        cell = (self.kind_of.take(before) * size + now) * size + target
        return (self.table.take(cell).astype(np.uint32) << np.uint32(16)).view(F32)


def score_texts(model: Model, symbols: Symbols, counted: Counted, ids: list[np.ndarray]) -> list[float]:
    """log10 probability of each text's ids and its end. ids end with the end id, the vocabulary's size."""
    texts = [symbols.of[t[:-1]] for t in ids]
    out = np.array([symbols.inside[t[:-1]].sum() for t in ids])
    blocks = Blocks(texts, symbols.end, model.s.block)
    share, b = F32(model.s.counted), model.s.block
    weights = model.logits_of()
    for start in range(0, len(blocks.owner), 4 * model.s.batch):
        part = slice(start, start + 4 * model.s.batch)
        window = blocks.window[part]
        order, bounds = model.by_class(blocks.target[part], blocks.real[part])
        now, before, target = (x.reshape(-1).take(order) for x in (window[:, b:], window[:, b - 1 : -1], blocks.target[part]))
        got, _ = model.attention(window, blocks.valid[part])
        p = model.probability(model.hidden(got.take(order, axis=0), now, before), target, bounds, weights)
        p += share * (counted.of(before, now, target) - p)
        first = blocks.owner[start]
        sums = np.bincount(blocks.owner[part].take(order // b) - first, weights=np.log10(np.maximum(p, F32(1e-30))))
        out[first : first + len(sums)] += sums
    return out.tolist()


# The base, and the passes over the corpus


def _training(batch, start: int, n: int) -> list[bool]:
    return [not held_out(i) for i in batch.column("doc_id").slice(start, n).to_pylist()]


def word_counts(texts: DataFrame, chunk_words: int = 1 << 21) -> DataFrame:
    """word (64-bit hash), n: over all training texts; every task adds up what it reads in chunks before it is shuffled."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def rows(parts):
        w, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for start, values in common.byte_column(batch, "text", 500):
                parts.append(words_of_all([t for t, learn in zip(values, _training(batch, start, len(values)), strict=True) if learn], BLANK_WORDS)[0])
                held += len(parts[-1])
                if held >= chunk_words:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(tokens: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id, and the end, occurs in all training texts."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for start, values in common.byte_column(batch, "ids", 2000):
                learned = [v for v, learn in zip(values, _training(batch, start, len(values)), strict=True) if learn]
                total += np.bincount(np.frombuffer(b"".join(learned), dtype), minlength=size + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], schema=schema)

    counted = tokens.select("doc_id", "ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, np.int64)
    for r in common.collect_bounded(counted, size + 1, "ids of the vocabulary"):
        out[r["token"]] = r["n"]
    return out


def _counted(tokens: DataFrame, keys, name: str, bound: int) -> pa.Table:
    """name, n: how often each key occurs in tokens; every task adds up what it reads in parts before it is shuffled."""
    schema = pa.schema([(name, pa.int64()), ("n", pa.int64())])

    def rows(parts):
        k, n = np.unique(np.concatenate(parts), return_counts=True)
        return k, n

    def count(batches):
        parts, held, sums = [], 0, []
        for batch in batches:
            for _, values in common.byte_column(batch, "ids", 500):
                parts.append(keys(b"".join(values)).astype(np.int32))
                held += len(parts[-1])
                if held >= 1 << 22:
                    sums.append(rows(parts))
                    parts, held = [], 0
        if held:
            sums.append(rows(parts))
        if sums:
            k, at = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x for _, x in sums])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], schema=schema)

    # no more rows than there are keys, which the settings bound
    out = tokens.select("ids").mapInArrow(count, f"{name} long, n long").groupBy(F.col(name).cast("int").alias(name)).agg(F.sum("n").cast("float").alias("n")).toArrow()
    if out.num_rows > bound:
        raise ValueError(f"more than {bound} of {name}")
    return out


def pair_counts(tokens: DataFrame, symbols: Symbols, dtype: str, s: Settings) -> np.ndarray:
    """How often each symbol follows each other one, and begins or ends a text, in all of tokens."""
    size = s.classes * s.members
    shared = tokens.sparkSession.sparkContext.broadcast(symbols)

    def keys(data: bytes) -> np.ndarray:
        # every text ends with the end, which is also what comes before the next one's first symbol
        following = shared.value.of[np.frombuffer(data, dtype)]
        return np.concatenate([[shared.value.end], following[:-1]]) * size + following

    table = _counted(tokens, keys, "pair", size * size)
    out = np.zeros(size * size, np.float64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def context_counts(tokens: DataFrame, symbols: Symbols, model: Model, dtype: str, s: Settings) -> Counted:
    """How often each symbol follows each other one after each kind of symbol, in all of tokens."""
    size = s.classes * s.members
    kind_of = model.class_of * s.kinds // s.classes
    shared = tokens.sparkSession.sparkContext.broadcast((symbols, kind_of))

    def keys(data: bytes) -> np.ndarray:
        symbols, kind_of = shared.value
        following = symbols.of[np.frombuffer(data, dtype)]
        before = np.concatenate([[symbols.end], following[:-1]])
        # what comes before a text's first symbol is an end, and before that another
        first = np.where(before == symbols.end, symbols.end, np.concatenate([[symbols.end], before[:-1]]))
        return (kind_of[first] * size + before) * size + following

    table = _counted(tokens, keys, "cell", s.kinds * size * size)
    return Counted(table.column("cell").to_numpy(), table.column("n").to_numpy(), kind_of, symbols, s)


def start_blocks(tokens: DataFrame, symbols: Symbols, dtype: str, s: Settings, n_ids: int) -> Blocks:
    """On the driver: whole pieces of texts drawn by a hash, at most start_pieces of at most `piece` blocks. They only decide where
    the pass over all texts starts."""
    chance = min(1.0, 1.2 * s.start_pieces / max(1.0, n_ids / s.block / s.piece))
    shared = tokens.sparkSession.sparkContext.broadcast(symbols)
    arrow = pa.schema([("place", pa.int64()), ("blocks", pa.binary())])
    mixed = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        symbols = shared.value
        for batch in batches:
            for start, values in common.byte_column(batch, "ids", 200):
                place = batch.column("place").slice(start, len(values)).to_numpy().view(np.uint64)
                texts = [symbols.of[np.frombuffer(v, dtype)[:-1]] for v in values]
                pieces = np.array([-(-(len(t) + 1) // (s.block * s.piece)) for t in texts])
                owner = np.repeat(np.arange(len(texts)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                draw = (place[owner] ^ (number.astype(np.uint64) + np.uint64(1)) * mixed) * mixed >> np.uint64(11)
                for at in np.flatnonzero(draw < chance * (1 << 53)):
                    blocks = Blocks([texts[owner[at]]], symbols.end, s.block)
                    data = blocks.packed(np.flatnonzero(blocks.number // s.piece == number[at])).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(draw[at])]), pa.array([data], pa.binary())], schema=arrow)

    drawn = tokens.select(F.xxhash64("doc_id", "ids").alias("place"), "ids").mapInArrow(run, "place long, blocks binary")
    rows = drawn.orderBy("place", F.xxhash64("blocks")).limit(s.start_pieces).collect() if s.start_pieces else []
    return Blocks.unpacked(b"".join(bytes(r["blocks"]) for r in rows), s.block)


def fit_all(tokens: DataFrame, symbols: Symbols, dtype: str, n_ids: int, model: Model, s: Settings) -> Model:
    """The model after a pass over the blocks of all training texts. Texts are dealt by a hash into groups; each group goes through its
    blocks from the model's weights on; the weights they end with are averaged, by their blocks."""
    groups = max(1, round(n_ids / s.block / s.every / s.group_blocks))
    shared = tokens.sparkSession.sparkContext.broadcast((model, symbols))
    schema = "salt int, n long, weights binary"
    arrow = pa.schema([("salt", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])
    names = list(model.p)

    def learned(part: int, data: list[bytes], place: list[int]):
        model, symbols = shared.value
        own = deepcopy(model)
        blocks = Blocks([symbols.of[np.frombuffer(v, dtype)[:-1]] for v in data], symbols.end, s.block)
        turn = (np.array(place, np.int64).view(np.uint64) >> np.uint64(20)) % np.uint64(s.every)
        chosen = np.flatnonzero(blocks.number % s.every == turn.astype(np.int64)[blocks.owner])
        fit_further(own, blocks, s, chosen)
        n = len(chosen)
        weights = np.concatenate([own.p[k].reshape(-1) for k in names]).astype("<f8") * n
        return pa.RecordBatch.from_arrays([pa.array([part // 64], pa.int32()), pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], schema=arrow)

    def run(batches):
        common.clear_worker_caches()
        part, data, places = None, [], []
        for batch in batches:
            for this, place, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "ids")), strict=True):
                if this != part and data:
                    yield learned(part, data, places)
                    data, places = [], []
                part = this
                data.append(ids)
                places.append(place)
        if data:
            yield learned(part, data, places)

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w, "<f8") for w in part.column("weights").to_pylist())
        n = sum(part.column("n").to_pylist())
        return pa.table([pa.array([part.column("salt")[0].as_py() // 64], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=arrow)

    place = F.xxhash64("doc_id", "ids")
    dealt = tokens.select(F.pmod(place, F.lit(groups)).cast("int").alias("part"), place.alias("place"), "ids").repartitionById(groups, "part").sortWithinPartitions("part", "place")
    ended = common.write_shared(dealt.mapInArrow(run, schema), "lm-weights")
    added = ended.groupBy("salt").applyInArrow(add, schema).withColumn("salt", F.col("salt") * 0).groupBy("salt").applyInArrow(add, schema).collect()
    if added and added[0]["n"]:
        mean = np.frombuffer(bytes(added[0]["weights"]), "<f8") / added[0]["n"]
        for k, part in zip(names, np.split(mean, np.cumsum([model.p[k].size for k in names])[:-1]), strict=True):
            model.p[k] = part.reshape(model.p[k].shape).astype(F32)
    common.release(ended)
    return model


def base_scores(texts: DataFrame, counts: DataFrame, s: Settings) -> tuple[DataFrame, int, int]:
    """(row, n_tokens, n_known, base_score of every text; training tokens; distinct training tokens).

    The commonest words' counts go to all executors; there are no more than 1 / common_share of them. The others are joined
    by the word, and their sums added up by the text."""
    learned = texts.select("doc_id").mapInArrow(_count_training, "n long").agg(F.sum("n")).first()[0] or 0
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_all, distinct = (total[0] or 0) + learned, total[1] + (learned > 0)
    bottom = np.log10(n_all + 0.5 * (distinct + 1))
    least = max(1, int(np.ceil(s.common_share * n_all)))
    bound = int(1 / s.common_share) + 1
    table = counts.where(F.col("n") >= least).limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError("more common words than their share allows")
    known = np.stack([table.column("word").to_numpy(), table.column("n").to_numpy()], axis=1).astype(np.int64)
    known = known[np.argsort(known[:, 0])]
    values = (known[:, 0], np.log10(known[:, 1] + 0.5) - bottom)
    shared = texts.sparkSession.sparkContext.broadcast(values)
    end_value = np.log10(learned + 0.5) - bottom
    schema = pa.schema([("row", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("score", pa.float64())])

    def split(batches):
        words, value = shared.value
        for batch in batches:
            keys = batch.column("row").to_pylist()
            for start, values in common.byte_column(batch, "text", 500):
                n = len(values)
                h, sizes = words_of_all(values, BLANK_WORDS)
                h = h.view(np.int64)
                order = np.argsort(h)
                h, owner = h[order], np.repeat(np.arange(n), sizes)[order]
                first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
                distinct = h[first]
                at = np.minimum(np.searchsorted(words, distinct), max(len(words) - 1, 0))
                found = words[at] == distinct if len(words) else np.zeros(len(distinct), bool)
                code = np.cumsum(first) - 1
                same = found[code]
                known = np.bincount(owner[same], minlength=n) + (learned > 0)
                score = np.bincount(owner[same], weights=value[at[code[same]]], minlength=n) + end_value
                rare, owner = h[~same], owner[~same]
                order = np.lexsort((owner, rare))
                rare, owner = rare[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])])[: len(rare)])
                row = np.array(keys[start : start + n], np.int64)
                zeros = np.zeros(len(first), np.int64)
                # the first rows hold what needs no join, under keys of their own that spread them
                columns = [(row, row[owner[first]]), (row, rare[first]), (np.zeros(n, np.int64), np.diff(first, append=len(rare))), (sizes + 1, zeros), (known, zeros), (score, zeros)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = texts.mapInArrow(split, "row long, word long, n long, n_tokens long, n_known long, score double")
    joined = rows.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    value = (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(float(bottom))) * F.col("n")
    sums = joined.groupBy("row").agg(
        F.count_if(F.col("n") == 0).alias("texts"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("score") + value).alias("score"),
    )
    # equal rows have added up
    each = sums.select("row", *((F.col(c) / F.col("texts")).cast("long").alias(c) for c in ("n_tokens", "n_known")), (F.col("score") / F.col("texts")).alias("base_score"))
    return each, n_all, distinct


def _count_training(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(not held_out(i) for i in batch.column("doc_id").to_pylist())], pa.int64())], names=["n"])


def score_language(docs: DataFrame, tokenizer: str, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids for every document. Documents whose
    crc32(id as text) mod 5 is 1 are held out: nothing is learned from them.

    Base: words are A-Z lower-cased runs of characters other than 0x20 and 0x09-0x0D, then one end, and the score sums
    log10((c + 0.5) / (N + 0.5 (V + 1))). Words are counted over all training texts, by 64-bit hashes.

    score: log10 of the model's probability of the tokenizer's ids of the text, and of its end. Each token is scored once, in a
    window that holds at least `block` tokens before it or all there are; windows overlap by half. Every training text is
    learned from whole by the counts: ids, symbol pairs (which make the classes) and the counted distribution. The weights of
    attention start on the driver from at most start_pieces pieces of training texts, and then learn on the executors from every
    block of every training text, by groups whose weights are averaged.

    Null and empty texts have the end only. Repeated rows and ids each get a row; a null id is a training document. Long texts
    are scored whole. An empty table gives an empty table; without training texts the model keeps its first weights. Other
    columns are not read.
    """
    from tokenizers import Tokenizer

    s = settings
    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = rans.id_type(tokenizer, size)
    texts = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    counts = common.write_shared(word_counts(texts.select("doc_id", "text")), "word-counts")
    base, n_all, _ = base_scores(texts, counts, s)
    tokens = common.write_shared(rans.tokenize(texts, tokenizer, size, dtype, lower=True), "lm-ids", "zstd")
    seen = id_counts(tokens, dtype, size)
    symbols = Symbols(seen, s)
    training = tokens.where(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 5 != 1))
    model = fit(start_blocks(training, symbols, dtype, s, int(seen.sum())), symbols, pair_counts(training, symbols, dtype, s), s)
    counted = context_counts(training, symbols, model, dtype, s)
    model = fit_all(training, symbols, dtype, int(seen.sum()), model, s)
    shared = spark.sparkContext.broadcast((model, symbols, counted))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_ids", pa.int64())])

    def run(batches):
        common.clear_worker_caches()
        model, symbols, counted = shared.value
        for batch in batches:
            for start, values in common.byte_column(batch, "ids", 200):
                ids = [np.frombuffer(v, dtype) for v in values]
                part = [batch.column(c).slice(start, len(values)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*part, pa.array([held_out(i) for i in part[0].to_pylist()], pa.bool_()), pa.array(score_texts(model, symbols, counted, ids), pa.float64()), pa.array([len(i) for i in ids], pa.int64())], schema=schema)

    scored = tokens.mapInArrow(run, "doc_id long, row long, held_out boolean, score double, n_ids long")
    return scored.join(base, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_ids")
