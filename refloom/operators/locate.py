"""Sections of references in documents. A document is one row: scores, thresholds and growth are array functions over its lines or
chunks, so that nothing but the document's own row is read and no text is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.similarity import cosine, norm
from refloom.functions.text import CUES, cue_hits, lexical_bonus


def line_scores(text: Column) -> Column:
    """Cue hits of each line, five at most."""
    return F.transform(F.split(text, "\n"), lambda x: F.least(cue_hits(x), F.lit(5)))


def with_cues(docs: DataFrame) -> DataFrame:
    """Documents that have a cue: most texts that have none are told by one search, before any line is scored."""
    return docs.where(F.lower("text").rlike(CUES))


def _places(xs: Column) -> Column:
    return F.sequence(F.lit(0), F.size(xs) - 1)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, not for each element that body looks at."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _largest_drop(scores: Column) -> tuple[Column, Column]:
    """(the largest drop between neighbours of the scores in descending order, the score after the first drop of that size)."""
    ranked = F.sort_array(scores, asc=False)
    drops = F.zip_with(F.slice(ranked, F.lit(1), F.size(ranked) - 1), F.slice(ranked, F.lit(2), F.size(ranked) - 1), lambda a, b: a - b)
    largest = F.array_max(drops)
    return largest, F.get(ranked, F.array_position(drops, largest).cast("int"))


def _grown(scores: Column, best: Column, least: Column) -> tuple[Column, Column]:
    """The places around the place `best` next to which scores fall below `least`: (the last before it, the first after it)."""
    low = F.filter(_places(scores), lambda i: F.get(scores, i) < least)
    left = F.coalesce(F.array_max(F.filter(low, lambda i: i < best)), F.lit(-1))
    return left, F.coalesce(F.array_min(F.filter(low, lambda i: i > best)), F.size(scores))


def gap_threshold(docs: DataFrame, gap: int = 2) -> DataFrame:
    """doc_id, threshold, best: the score after the largest drop between the lines' scores in descending order, first of equal
    drops, if the drop exceeds gap; else 0.7 of the highest, in tenths of a unit. Null texts have no row."""
    scored = docs.where("text IS NOT NULL").select("doc_id", line_scores(F.col("text")).alias("scores"))
    drop, after = _largest_drop(F.col("scores"))
    best = F.array_max("scores")
    return scored.select("doc_id", F.when(F.coalesce(drop > gap, F.lit(False)), after * 10).otherwise(best * 7).alias("threshold"), best.alias("best"))


def locate_sections(docs: DataFrame, slack: int = 1, gap: int = 2) -> DataFrame:
    """doc_id, n_lines, first_line, last_line, section: lines that reach gap_threshold, and those next to the best line as
    long as none is more than slack below it. Documents without a cue have no row."""
    scored = with_cues(docs).select("doc_id", F.split("text", "\n").alias("lines"), line_scores(F.col("text")).alias("scores"))
    drop, after = _largest_drop(F.col("scores"))
    best = F.array_max("scores")
    scored = scored.select("*", best.alias("best"), F.when(F.coalesce(drop > gap, F.lit(False)), after * 10).otherwise(best * 7).alias("threshold"))
    scored = scored.withColumn("at", F.array_position("scores", F.col("best")).cast("int") - 1)
    left, right = _grown(F.col("scores"), F.col("at"), F.col("best") - slack)
    scored = scored.select("*", left.alias("left"), right.alias("right"))
    wanted = lambda i: ((i > F.col("left")) & (i < F.col("right"))) | (F.get(F.col("scores"), i) * 10 >= F.col("threshold"))
    picked = scored.select("doc_id", "lines", F.filter(_places(F.col("scores")), wanted).alias("picked"))
    return picked.select(
        "doc_id", F.size("picked").cast("long").alias("n_lines"), F.array_min("picked").alias("first_line"), F.array_max("picked").alias("last_line"),
        F.array_join(F.transform("picked", lambda i: F.get(F.col("lines"), i)), "\n").alias("section"),
    )


def adaptive_threshold(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, n_chosen, threshold: lines of at least 0.7 of the highest score; 0.5 if those are fewer than `least`, 0.85 if more than
    half of the lines; at most half of the lines. Documents whose best score is 0 have no row."""
    scored = with_cues(docs).select("doc_id", line_scores(F.col("text")).alias("scores"))
    scored = scored.select("*", F.array_max("scores").alias("best"))
    at = lambda share: F.size(F.filter("scores", lambda s: s * 100 >= F.col("best") * share)).cast("long")
    sums = scored.select("doc_id", F.size("scores").cast("long").alias("n"), at(70).alias("n70"), at(50).alias("n50"), at(85).alias("n85"))
    half = F.floor(F.col("n") / 2)
    few, many = F.col("n70") < least, F.col("n70") > half
    chosen = F.when(few, F.col("n50")).when(many, F.col("n85")).otherwise(F.col("n70"))
    return sums.select("doc_id", F.least(chosen, half).alias("n_chosen"), F.when(few, 50).when(many, 85).otherwise(70).alias("threshold"))


#: Fixed value: headings of reference sections, with the marks of a Markdown heading.
HEADINGS = r"(?i)^#+\s*(references|bibliography|works cited|literature cited|bibliographie|literaturverzeichnis)\b"


def heading_section(docs: DataFrame) -> DataFrame:
    """doc_id, line, section: the first heading of references and the lines under it, up to the next heading with no more marks than
    the first word of that heading has characters. Documents without one have no row."""
    cut = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    cut = cut.withColumn("line", F.array_position(F.transform("lines", lambda x: x.rlike(HEADINGS)), F.lit(True)).cast("int") - 1).where("line >= 0")
    level = F.length(F.regexp_extract(F.get("lines", F.col("line")), r"^(\S+)", 1))
    marks = F.transform("lines", lambda x: F.length(F.regexp_extract(x, r"^(#+)\s+\S", 1)))
    cut = cut.select("*", marks.alias("marks"), level.alias("level"))
    after = F.array_min(F.filter(_places(F.col("lines")), lambda i: (i > F.col("line")) & F.get("marks", i).between(F.lit(1), F.col("level"))))
    cut = cut.withColumn("after", F.coalesce(after, F.size("lines")))
    return cut.select("doc_id", "line", F.array_join(F.slice("lines", F.col("line") + 1, F.col("after") - F.col("line")), "\n").alias("section"))


#: Query vectors at most; they are sent to every executor.
MOST_QUERIES = 1000


def max_cosine(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query: str = "query") -> DataFrame:
    """key, score: the highest similarity of each vector to a small set of query vectors, which is checked to be small. Each vector's
    row meets the queries in place: they are an array of one row, and nothing is shuffled."""
    n = queries.limit(MOST_QUERIES + 1).count()
    if n > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors")
    gathered = queries.where(F.col(query).isNotNull()).agg(F.collect_list(F.struct(F.col(query).alias("q"), norm(F.col(query)).alias("norm"))).alias("__queries"))
    each = vectors.crossJoin(F.broadcast(gathered))  # one row
    highest = _bound(norm(F.col(vector)), lambda n: F.array_max(F.transform("__queries", lambda x: cosine(F.col(vector), x["q"], n, x["norm"]))))
    return each.select(key, highest.alias("score"))


def _by_score(scores: Column, places: Column) -> Column:
    """Places by descending score, the first of equal ones."""
    return F.transform(F.array_sort(F.transform(places, lambda i: F.struct((-F.get(scores, i)).alias("s"), i.alias("i")))), lambda x: x["i"])


def chosen_chunks(scores: Column, gap: float = 0.1, tolerance: float = 0.03, greedy: bool = True) -> Column:
    """Places of the chunks taken by their scores. Those from the score after the largest drop up, if the drop exceeds gap; where
    that gives none, or more than half of all: those of at least 0.7 of the highest score, 0.5 of it if there is none, 0.85 if they
    are too many; at most half of all, the first by score and place. greedy: and those next to the best while no score is more than
    tolerance below it."""

    def chosen(x: Column) -> Column:
        scores, half, best = x["scores"], F.floor(F.size(x["scores"]) / 2).cast("int"), x["best"]
        from_ = lambda least: F.filter(_places(scores), lambda i: F.get(scores, i) >= least)
        by_gap = F.when(F.coalesce(x["drop"] > gap, F.lit(False)), from_(x["after"])).otherwise(F.array().cast("array<int>"))
        share = lambda at: F.when(F.size(at) < 1, from_(best * 0.5)).when(F.size(at) > half, from_(best * 0.85)).otherwise(at)
        by_share = _bound(from_(best * 0.7), share)
        found = _bound(by_gap, lambda at: F.when((F.size(at) > 0) & (F.size(at) <= half), at).otherwise(by_share))
        return _bound(found, lambda at: F.when(F.size(at) > half, F.slice(_by_score(scores, _places(scores)), F.lit(1), half)).otherwise(at))

    def grown(scores: Column, found: Column) -> Column:
        def around(i: Column) -> Column:
            return _bound(F.get(scores, i) - tolerance, lambda least: _bound(F.struct(*(c.alias(n) for c, n in zip(_grown(scores, i, least), ("left", "right"), strict=True))), lambda x: F.sequence(x["left"] + 1, x["right"] - 1)))

        top = F.slice(_by_score(scores, found), 1, 1)
        return F.array_sort(F.array_union(found, F.flatten(F.transform(top, around))))

    def taken(scores: Column) -> Column:
        drop, after = _largest_drop(scores)
        found = _bound(F.struct(scores.alias("scores"), F.array_max(scores).alias("best"), drop.alias("drop"), after.alias("after")), chosen)
        return _bound(found, lambda at: grown(scores, at)) if greedy else F.array_sort(found)

    return _bound(scores, taken)


def semantic_sections(chunks: DataFrame, queries: DataFrame, gap: float = 0.1, tolerance: float = 0.03, greedy: bool = True) -> DataFrame:
    """chunks: doc_id, chunk, text, vector; queries: query (vectors). doc_id, chunks (their numbers), section: the chunks that
    chosen_chunks takes by their highest similarity to a query plus a bonus for cues, joined by empty lines. In a document that
    lacks a vector, those with at least half of the highest bonus; '' where there is no cue either. One document's chunks are in one
    row."""
    scored = max_cosine(chunks.withColumn("__key", F.struct("doc_id", "chunk", "text", "vector")), queries, "__key", "vector")
    scored = scored.select("__key.*", F.when(F.isnan("score"), 0.0).otherwise(F.col("score")).alias("similarity"), lexical_bonus(F.col("__key.text")).alias("bonus"))
    rows = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "similarity", "bonus", F.col("vector").isNull().alias("lacks")))).alias("c"))
    full = F.transform("c", lambda c: F.coalesce(c["similarity"], F.lit(0.0)) + c["bonus"])
    rows = rows.select("doc_id", "c", F.exists("c", lambda c: c["lacks"]).alias("lacks"), full.alias("scores"), F.transform("c", lambda c: c["bonus"]).alias("bonuses"))
    most = F.array_max("bonuses")
    lexical = F.when(most > 0, _bound(most * 0.5, lambda least: F.filter(_places(F.col("bonuses")), lambda i: F.get("bonuses", i) >= least))).otherwise(F.array().cast("array<int>"))
    picked = rows.select("doc_id", "c", F.when(F.col("lacks"), lexical).otherwise(chosen_chunks(F.col("scores"), gap, tolerance, greedy)).alias("p"))
    return picked.select("doc_id", F.transform("p", lambda i: F.get("c", i)["chunk"]).alias("chunks"), F.array_join(F.transform("p", lambda i: F.get("c", i)["text"]), "\n\n").alias("section"))
