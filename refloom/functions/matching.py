"""How well a candidate record answers a reference: titles, years, volumes and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from refloom.functions.similarity import indel_ratio
from refloom.functions.text import normalize_title

#: Points for a title similarity above the bound.
TITLE_POINTS = [(95, 45), (90, 40), (85, 35), (80, 30), (75, 25)]
#: Points for equal years, years one apart, volumes and first pages.
POINTS = {"year": 20, "near_year": 15, "volume": 15, "page": 15, "title": 50}


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of its length in the longer one, windows cut at the ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    letters = set(a)
    return max(indel_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)) if b[max(0, i)] in letters or b[min(len(b), i + len(a)) - 1] in letters) if letters & set(b) else 0.0


def token_ratios(a: str, b: str) -> float:
    """The better of the ratios of sorted words, and of shared words to shared and own ones."""
    x, y = sorted(a.split()), sorted(b.split())
    common, own, other = (" ".join(sorted(s)) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    if not x or not y:
        return 0.0
    one, two = f"{common} {own}".strip(), f"{common} {other}".strip()
    sets = max(indel_ratio(common, one), indel_ratio(common, two)) if common else 0.0
    return max(indel_ratio(" ".join(x), " ".join(y)), sets, indel_ratio(one, two))


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    best = lambda x, y: 100.0 if x == y else max(round(r) for r in (indel_ratio(x, y), partial_ratio(x, y), token_ratios(x, y)))
    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """0 to 100: 0 if a title is null or empty; 100 if both are equal after normalisation; else the best of whole, partial and
    word ratios."""
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(given, _similarity(normalize_title(a), normalize_title(b))).otherwise(F.lit(0.0))


def title_points(similarity: Column) -> Column:
    points = F.when(similarity >= 100, POINTS["title"])
    for bound, n in TITLE_POINTS:
        points = points.when(similarity > bound, n)
    return points.otherwise(0)


def first_page(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.split_part(c, F.lit("-"), F.lit(1))), "^0+", ""), F.lit(""))


def matching_score(similarity: Column, years: tuple[Column, Column], volumes: tuple[Column, Column], pages: tuple[Column, Column]) -> Column:
    """0 to 100: points for the title, the year, the volume and the first page; what is null gives none."""
    gap = F.abs(years[0] - years[1])
    year = F.when(gap == 0, POINTS["year"]).when(gap == 1, POINTS["near_year"]).otherwise(0)
    volume = F.when(F.trim(volumes[0].cast("string")) == F.trim(volumes[1].cast("string")), POINTS["volume"]).otherwise(0)
    page = F.when(first_page(pages[0]) == first_page(pages[1]), POINTS["page"]).otherwise(0)
    return title_points(similarity) + year + volume + page


def accepted(similarity: Column, author_ratio: Column, years: tuple[Column, Column]) -> Column:
    """A title similarity of 90 and either like first authors (70) or years one apart at most; null counts as no."""
    return F.coalesce((similarity >= 90) & (F.coalesce(author_ratio >= 70, F.lit(False)) | F.coalesce(F.abs(years[0] - years[1]) <= 1, F.lit(False))), F.lit(False))


def resolved(flag: Column, similarity: Column) -> Column:
    """The explicit decision, else whether the titles' similarity is 90 or more."""
    return F.coalesce(flag, similarity >= 90, F.lit(False))


def candidate_score(overlap: Column, year_gap: Column, surname_share: Column) -> Column:
    """0.55 for words, 0.15 for the year (0.6 of it one year off), 0.20 for surnames; three digits."""
    year = F.when(year_gap == 0, 1.0).when(F.abs(year_gap) == 1, 0.6).otherwise(0.0)
    return F.round(0.55 * overlap + 0.15 * year + 0.20 * F.coalesce(surname_share, F.lit(0.0)), 3)
