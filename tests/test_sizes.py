"""Operators on pairs over many equal rows: results against plain Python, and how many rows their joins make."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from refloom.operators import locate, records
from refloom.plans import flow_queries


def rows_made(df) -> int:
    """Runs df: the most rows that one operator of its plan put out."""
    df.collect()

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        made, children = plan.metrics().get("numOutputRows"), plan.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_token_candidates_against_all_pairs(spark):
    rng = random.Random(1)
    titles = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    index = [(i, t) for i, t in enumerate(titles)] + [(5, titles[5]), (6, "a b zz"), (900, None), (901, ""), (902, " a")]
    refs = [(i, t) for i, t in enumerate(titles[::7])] + [(3, titles[21]), (910, "nothing here"), (911, None), (912, ""), (913, "gg a")]
    got = records.token_candidates(spark.createDataFrame(refs, "ref_id int, title string"), spark.createDataFrame(index, "rec_id int, title string"), 4)
    sets = []
    for rows in (refs, index):
        sets.append(defaultdict(set))
        for i, t in rows:
            sets[-1][i] |= set(t.split(" ")) if t is not None else set()
    want = set()
    for r, a in sets[0].items():
        best = sorted((-len(a & b), i) for i, b in sets[1].items() if a & b)[:4]
        want |= {(r, i, -n, k) for k, (n, i) in enumerate(best, 1)}
    assert {(r["ref_id"], r["rec_id"], r["overlap"], r["rank"]) for r in got.collect()} == want


def test_token_candidates_of_copies(spark):
    rows = spark.range(6000).select(F.col("id").alias("rec_id"), F.concat(F.lit("a common "), F.col("id") % 20).alias("title"))
    df = records.token_candidates(rows.withColumnRenamed("rec_id", "ref_id"), rows, 3)
    assert rows_made(df) < 100_000 and df.count() == 18_000


def test_title_patterns_of_copies(spark):
    kinds = [f"{w} thing number {n}" for w in ("Red", "large blue") for n in range(10)]
    index = spark.range(6000).select(F.col("id").alias("rec_id"), F.element_at(F.lit(kinds), (F.col("id") % 20 + 1).cast("int")).alias("title"))
    refs = index.where("rec_id % 3 = 0").withColumnRenamed("rec_id", "ref_id")
    df = records.title_pattern_candidates(refs, index, k=5)
    assert rows_made(df) < 60_000
    got = defaultdict(list)
    for r in df.collect():
        got[r["ref_id"]].append(r["rec_id"])
    # of Red only "thing.*number" is looked for, which all titles hold
    assert got == {i: [0, 1, 2, 3, 4] if i % 20 < 10 else [10, 11, 12, 13, 14] for i in range(0, 6000, 3)}


def test_title_patterns_keep_repeated_rows(spark):
    index = spark.createDataFrame([(1, "a long title"), (1, "a long title"), (2, "A LONG TITLE"), (1, "other words")], "rec_id int, title string")
    refs = spark.createDataFrame([(1, "a long title"), (1, "other words"), (2, "long title")], "ref_id int, title string")
    rows = lambda k: sorted(map(tuple, records.title_pattern_candidates(refs, index, k=k).collect()))
    assert rows(20) == [(1, 1)] * 3 + [(1, 2)] + [(2, 1)] * 2 + [(2, 2)]
    assert rows(2) == [(1, 1)] * 2 + [(2, 1)] * 2


def test_passes_against_all_pairs(spark):
    rng = random.Random(2)
    index = [(i, rng.choice("ab"), rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 5, 9, None])) for i in range(60)]
    index += [index[3], (4, "a", "x", 5), (4, "a", "x", 5), index[9], index[9]]
    refs = [*index[:40], (200, "c", "x", 1), (201, "a", None, 5), (9, "b", "y", 2)]
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, a string, b string, n int")
    for apart in (False, True):
        want, left = {}, refs
        for number, keys in enumerate([(1, 2), (2,)], 1):
            met = defaultdict(list)
            for r in left:
                met[r[0]] += [(abs(r[3] - x[3]) / 8, x[0]) for x in index if all(r[k] == x[k] is not None for k in keys) and None not in (r[3], x[3]) and not (apart and r[0] == x[0])]
            taken = set()
            for i, pairs in met.items():
                if pairs:
                    pairs.sort()
                    clear = len(pairs) == 1 or pairs[1][0] - pairs[0][0] >= 0.125
                    said = "accept" if pairs[0][0] <= 0.125 and clear else "review" if pairs[0][0] <= 0.5 else "none"
                    taken |= {i} if said == "accept" else set()
                    want[i] = min(want.get(i, (9,)), (["accept", "review", "none"].index(said), number, pairs[0][1], said))
            left = [r for r in left if r[0] not in taken]
        score = 1 - F.abs(F.col("n") - F.col("rec_n")) / 8
        for of in (["n"], None):
            got = records.multi_pass(frame(refs, "ref_id"), frame(index, "rec_id"), [["a", "b"], ["b"]], score, 0.875, 0.5, 0.125, of, apart)
            assert {r["ref_id"]: (r["pass"], r["rec_id"], r["decision"]) for r in got.collect()} == {i: w[1:] for i, w in want.items()}


def test_passes_of_copies(spark):
    part = spark.range(6000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.concat(F.lit("n"), F.col("id") % 2).alias("p_name"), (F.col("id") % 5).cast("int").alias("p_size"))
    df = flow_queries.linking_passes(lambda name: part)
    assert rows_made(df) < 60_000
    # ids go round by ten: the first record of the same kind, and for that record the second
    assert sorted((r["ref_id"], r["rec_id"], r["pass"], r["decision"]) for r in df.collect()) == [(i, i % 10 if i >= 10 else i + 10, 1, "review") for i in range(6000)]


def test_chunks_of_a_long_document(spark):
    # the largest drop, the highest score and its shares are worked out once a document, not once a chunk
    n, rng = 30_000, random.Random(3)
    scores = [round(rng.random() * 0.4, 4) for _ in range(n)]
    after = max(scores)
    scores[700:705] = [0.95, 0.96, 0.94, 0.93, 0.95]
    df = spark.createDataFrame([(scores,)], "s array<double>").select(locate.chosen_chunks(F.col("s")).alias("p"))
    began = time.time()
    assert list(df.collect()[0]["p"]) == [i for i, s in enumerate(scores) if s >= after]
    assert time.time() - began < 30
