"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only; the driver handles one row per source."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def shares(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Whole slots of a frame for each source: largest remainders, at least one each."""
    if frame < len(weights):
        raise ValueError(f"a frame of {frame} slots is too short for {len(weights)} sources")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * frame for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for k in range(frame - sum(out.values())):
        out[order[k % len(order)]] += 1
    while sum(out.values()) > frame:  # the floor of one slot gave too much
        over = max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], s))
        out[over] -= 1
    return out


def pfair_frame(slots: dict[str, int]) -> list[str]:
    """The source of each slot of one frame. Block j of a source with n of f slots is released at floor(j f / n) and due
    at ceil((j + 1) f / n); each slot takes the released block due first. The weights fill the frame, so every block
    meets its due time, and after t slots a source has had its share of t to within less than one block."""
    f = sum(slots.values())
    released = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(released)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(f):
        while released and released[0][0] <= t:
            _, s, j = heapq.heappop(released)
            heapq.heappush(ready, (-((-(j + 1) * f) // slots[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its due time")
        out.append(s)
        if j + 1 < slots[s]:
            heapq.heappush(released, ((j + 1) * f // slots[s], s, j + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, float], frame: int) -> list[tuple]:
    """Phases of the schedule as (phase, source, first_block, end_block, slots in the frame, first_slot, frame).

    A phase lasts until one of its sources has no block left; the others go on with the same weights relative to each
    other. So there are no more phases than sources, and every block gets a slot.
    """
    done = dict.fromkeys(blocks, 0)
    left = {s: n for s, n in blocks.items() if n > 0}
    out, base, phase = [], 0, 0
    while left:
        slots = shares({s: weights[s] for s in left}, frame)
        order = pfair_frame(slots)
        frames, rest = min(((left[s]) // slots[s], 0) for s in left)
        # whole frames that all sources can fill, then the part of the next frame up to the first source that ends
        used = {s: frames * slots[s] for s in left}
        more = dict.fromkeys(left, 0)
        for s in order:
            if used[s] + more[s] >= left[s]:
                break
            more[s] += 1
            rest += 1
        for s in left:
            n = used[s] + more[s]
            if n:
                out.append((phase, s, done[s], done[s] + n, slots[s], base, frame))
            done[s] += n
        base += frames * frame + rest
        left = {s: blocks[s] - done[s] for s in left if blocks[s] > done[s]}
        phase += 1
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block_chars: int = 65536, frame: int = 1000, max_sources: int = 1000, slice_rows: int = 2000) -> DataFrame:
    """A place in the mixture for every document: doc_id, source, block, phase, slot, rank (in the block).

    Each source's documents, in a hash order, are cut into blocks, each with a release time and a deadline, of half of
    block_chars characters: a document belongs to the block of its middle, and a long one uses up the slots of the blocks that it
    covers, half of them before its own and half after it. Ordered by (slot, rank), each source's characters follow its
    target weight to within one block, of block_chars or of the longest document if that is longer, as no document is
    cut: less than half a block by the schedule, half a document by the middle, and what the other sources' documents
    overhang. That holds while no source has ended; later phases go on with the rest in the same way. No document is dropped, repeated
    or sampled.

    weights: target weight by source; sources it lacks get the smallest of its weights. None: characters ** power.
    A null source is the source ''. Null and empty texts count as one character, a null id hashes like any value;
    rows that repeat an id or a text get places of their own; ties of the hash order go by id, then text. An empty table
    gives an empty table. More than max_sources sources are an error: the driver holds one row of each.

    Block numbers are running sums in two levels, over slices of the hash order and then inside each slice of about
    slice_rows rows, so the largest source is spread over many tasks.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        F.greatest(F.char_length(F.coalesce(docs[text_col].cast("string"), F.lit(""))), F.lit(1)).cast("long").alias("chars"),
        F.xxhash64(docs[id_col], docs[text_col]).alias("place"),
    )
    spark = docs.sparkSession
    totals = common.collect_bounded(rows.groupBy("source").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("rows")), max_sources, "sources to mix")
    least = min(weights.values()) if weights else 1.0
    target = {r["source"]: (weights.get(r["source"], least) if weights else float(r["chars"]) ** power) for r in totals}
    if any(not w > 0 for w in target.values()):
        raise ValueError("target weights must be above 0")
    part = max(1, block_chars // 2)
    blocks = {r["source"]: -(-r["chars"] // part) for r in totals}
    frame = max(frame, 4 * len(blocks))
    slices = max(1, -(-sum(r["rows"] for r in totals) // slice_rows))
    rows = rows.withColumn("slice", F.pmod(F.shiftrightunsigned("place", 33), F.lit(slices)))
    sums = rows.groupBy("source", "slice").agg(F.sum("chars").alias("slice_chars"))
    before = sums.select("source", "slice", (F.sum("slice_chars").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_chars")).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "chars")
    rows = rows.withColumn("within", F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(before, ["source", "slice"]).withColumn("at", F.coalesce("within", F.lit(0)) + F.col("base"))
    middle = F.col("at") + F.floor(F.col("chars") / 2)
    rows = rows.withColumn("block", F.floor(middle / part)).withColumn("rank", middle % part)

    phases, turns = _tables(plan(blocks, target, frame), blocks, target, frame)
    plan_df = spark.createDataFrame(phases, "phase int, source string, first_block long, end_block long, slots long, first_slot long, frame long")
    turn_df = spark.createDataFrame(turns, "phase int, source string, turn long, offset long")
    # ranges of one source don't overlap: an equality join on the source, then the range
    placed = rows.join(F.broadcast(plan_df), "source").where("block >= first_block and block < end_block")
    placed = placed.withColumn("nth", F.col("block") - F.col("first_block")).withColumn("turn", F.col("nth") % F.col("slots"))
    placed = placed.join(turn_df, ["phase", "source", "turn"])
    slot = F.col("first_slot") + F.floor(F.col("nth") / F.col("slots")) * F.col("frame") + F.col("offset")
    return placed.select("doc_id", "source", F.col("block").cast("long").alias("block"), "phase", slot.cast("long").alias("slot"), F.col("rank").cast("long").alias("rank"), "place")


def _tables(phases: list[tuple], blocks: dict[str, int], weights: dict[str, float], frame: int) -> tuple[list[tuple], list[tuple]]:
    """The phases, and for each (phase, source, turn in the frame) the slot's offset in the frame."""
    by_phase: dict[int, dict[str, int]] = {}
    for phase, s, first, _, slots, *_ in phases:
        by_phase.setdefault(phase, {})
    turns = []
    done = dict.fromkeys(blocks, 0)
    for phase in by_phase:
        active = {s for s in blocks if blocks[s] > done[s]}
        order = pfair_frame(shares({s: weights[s] for s in active}, frame))
        seen = dict.fromkeys(active, 0)
        used = {s: end - first for p, s, first, end, *_ in phases if p == phase}
        for offset, s in enumerate(order):
            if seen[s] < used.get(s, 0):
                turns.append((phase, s, seen[s], offset))
            seen[s] += 1
        for s, n in used.items():
            done[s] += n
    return phases, turns
