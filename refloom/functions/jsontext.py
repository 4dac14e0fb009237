"""JSON in answers of models: repair, parsing that gives null instead of an error, records of an answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Repairs of what stands outside strings, in this order: pattern and replacement.
REPAIRS = [
    (r",(\s*[}\]])", "$1"),  # comma before a closing bracket
    (r"([}\]])(\s*)([{\[])", "$1,$2$3"),  # none between two values
    (r'(["}\]0-9])([ \t]*\n\s*)(")', "$1,$2$3"),  # none at a line's end
    (r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", '$1"$2"$3'),  # bare key
    (r"([:\[,]\s*)True(?=\s*(?:[,}\]]|$))", "$1true"),
    (r"([:\[,]\s*)False(?=\s*(?:[,}\]]|$))", "$1false"),
    (r"([:\[,]\s*)(?:None|Null)(?=\s*(?:[,}\]]|$))", "$1null"),
]
FENCES = r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$"
SINGLE_QUOTED = r"([{\[,:]\s*)'([^']*)'(?=\s*(?:[:,}\]]|$))"
STRING = r'(?s)"(?:[^"\\]|\\.)*"'
#: What stands for a string while the rest is repaired: a private character in quotes.
HOLE = '"\ue000"'

#: Keys under which answers keep their records, in order of preference.
RECORD_KEYS = ["references", "parsed_references", "refs"]


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often it is used: repeated, the code of these expressions outgrows a method."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _around_strings(c: Column, use: Callable[[Column], Column]) -> Column:
    """use of the text with its strings taken out, and the strings put back."""
    def filled(x: Column) -> Column:
        strings = F.regexp_extract_all(x, F.lit(STRING), F.lit(0))
        parts = F.split(use(F.regexp_replace(x, STRING, HOLE)), HOLE, -1)
        # backslashes that begin no escape are doubled
        whole = F.transform(strings, lambda t: F.regexp_replace(t, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\"))
        return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(whole, i), F.lit("")))), "")

    return _once(c, filled)


def repaired(c: Column) -> Column:
    """The text after all repairs, with the closing brackets it lacks: braces first, then square ones. Nothing inside strings changes but
    backslashes that begin no escape."""
    def rest(out: Column) -> Column:
        lacking = lambda a, b: F.greatest(F.lit(0), F.regexp_count(out, F.lit(a)) - F.regexp_count(out, F.lit(b)))
        return F.concat(out, F.repeat(F.lit("}"), lacking(r"\{", r"\}")), F.repeat(F.lit("]"), lacking(r"\[", r"\]")))

    bare = F.regexp_replace(c, FENCES, "")
    quoted = _around_strings(bare, lambda x: F.regexp_replace(x, SINGLE_QUOTED, '$1"$2"'))
    return _around_strings(quoted, lambda x: _once(reduce(lambda s, r: F.regexp_replace(s, *r), REPAIRS, x), rest))


def parsed(c: Column) -> Column:
    """Variant of the first that parses: the text, the repaired text, what stands between the outermost brackets, that repaired; else null."""
    inner = F.nullif(F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    return F.coalesce(*(F.try_parse_json(x) for x in (c, repaired(c), inner, repaired(inner))))


def response_records(c: Column) -> Column:
    """Records of an answer as an array of variants: the answer if it is a list, else the list under a known key, else the
    answer as one record; null if nothing parses."""
    paths = ["$", *(f"$.{k}" for k in RECORD_KEYS)]
    return _once(parsed(c), lambda v: F.when(v.isNotNull(), F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in paths), F.array(v))))
