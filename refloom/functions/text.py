"""Scalar functions over titles, names, dates and page text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of titles and what replaces them.
TITLE_SIGNS = [("ω", "omega"), ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("(1)h", "1h"), ("–", "-"), ("—", "-")]

#: Fixed value: words and marks that show a reference section.
CUES = r"references|bibliography|works cited|literature|doi|isbn|issn|vol\.|no\.|pp\.|et al|ed\.|eds\.|press|journal"


def squeeze(c: Column) -> Column:
    """Runs of blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalized_text(c: Column) -> Column:
    """A field's value: as a string, squeezed, null if nothing is left."""
    return empty_to_null(squeeze(c.cast("string")))


def normalize_title(c: Column) -> Column:
    """Lower case, without end marks, signs by name, only a-z, 0-9, blanks and hyphens; null gives ''."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[.!?]+$", "")
    for sign, name in TITLE_SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(name))
    return squeeze(F.regexp_replace(out, r"[^a-z0-9 \t\n\x0B\f\r\-]", ""))


def family_name(c: Column) -> Column:
    """What stands before the first comma, else the last word."""
    words = F.split(squeeze(c), " ")
    return F.when(F.contains(c, F.lit(",")), empty_to_null(F.trim(F.split_part(c, F.lit(","), F.lit(1))))).otherwise(empty_to_null(F.element_at(words, -1)))


def first_year(c: Column, pattern: str = r"\b((?:19|20)[0-9]{2})\b") -> Column:
    return empty_to_null(F.regexp_extract(c, pattern, 1)).cast("int")


#: Years that records carry: 1500 to 2199.
RECORD_YEAR = r"\b(1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})\b"
#: Years of timestamps such as +1999-01-01.
STAMP_YEAR = r"^[+-]([0-9]{4})"


def matching_year(c: Column) -> Column:
    """A whole number as it is; else the first 19xx or 20xx; else null if a month is named; else the first four-digit part
    between hyphens, slashes or blanks within 1700 to 2025."""
    months = r"(?i)january|february|march|april|may|june|july|august|september|october|november|december"
    parts = F.filter(F.split(c, r"[-/ \t\n]"), lambda p: p.rlike("^[0-9]{4}$") & p.cast("int").between(1700, 2025))
    whole = F.when(F.trim(c).rlike("^[+-]?[0-9]{1,9}$"), F.trim(c).cast("int"))
    return F.coalesce(whole, first_year(c), F.when(c.rlike(months), F.lit(None).cast("int")).otherwise(F.get(parts, F.lit(0)).cast("int")))


def canonical_text(c: Column) -> Column:
    return F.regexp_replace(squeeze(F.upper(c)), r"[.]+$", "")


def canonical_author(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(squeeze(F.upper(c)), r"[,;]+$", ""), r"[.]+$", "")
    out = F.replace(out, F.lit("AA. VV"), F.lit("AA VV"))
    return F.regexp_replace(out, r"^\[(.*)\]$", "$1")


def split_authors(c: Column) -> Column:
    """Names between commas, semicolons, ' and ', ' e ', ' & ', ' - ' and 'et al'."""
    parts = F.split(c, r"(?i)[,;]| and | e | & | - |et al")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"[,;]+$", "")), lambda p: p != "")


def before_bracket(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"^([^\[]*)", 1))


def semicolon_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda p: before_bracket(F.trim(p))), lambda p: p != "")


def unescaped(c: Column) -> Column:
    for mark, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(mark), F.lit(sign))
    return c


def clean_date(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("*"), F.lit("")), r"[.]+$", ""), ",,", ",")


def record_string(title: Column, authors: Column, year: Column, publisher: Column, pages: Column) -> Column:
    """Parts in lower case without punctuation, joined by ' | '; empty parts are left out."""
    bare = lambda c: empty_to_null(squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")))
    return F.concat_ws(" | ", bare(title), bare(authors), year.cast("string"), bare(publisher), empty_to_null(F.regexp_replace(pages, r"[^0-9\-]", "")))


def cue_hits(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(CUES))


def lexical_bonus(c: Column) -> Column:
    """0.02 for each cue, 0.1 at most; 0 for null."""
    return F.least(F.lit(0.1), F.coalesce(cue_hits(c), F.lit(0)) * 0.02)


def capped(c: Column, chars: int = 100_000) -> Column:
    """The first so many characters: what a prompt takes of a document."""
    return F.substring(c, 1, chars)


def split_pages(c: Column, extractor: str | None = None) -> Column:
    """Pages between separator lines; one page for extractors without them; none of an empty text."""
    pages = F.array(c) if extractor == "mineru" else F.split(c, "\n-----\n")
    return F.when((c == "") | c.isNull(), F.array().cast("array<string>")).otherwise(pages)


def response_lines(c: Column) -> Column:
    """Lines of a model's answer between start and end tags: trimmed, without empty ones."""
    lines = F.split(F.regexp_replace(c, r"(?i)</?(start|end)>", ""), r"\r\n|\n|\r")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def source_of_id(c: Column, prefixes: list[str], doi_source: str = "doi", other: str = "unknown") -> Column:
    """The prefix before '_' that an id starts with, doi_source for ids such as 10.1234_x, else other."""
    found = F.when(c.rlike(r"^10\.[0-9]+_"), doi_source)
    for p in prefixes:
        found = found.when(c.startswith(p + "_"), p)
    return found.otherwise(other)


def path_tail(c: Column, n: int = 1) -> Column:
    """The last n parts of a path or address."""
    parts = F.split(c, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), "/")


def display_string(authors: Column, title: Column, journal: Column, date: Column, volume: Column, pages: Column) -> Column:
    """'authors. title. journal. date. Vol. v. pp. p'; what is null or empty is left out."""
    parts = [F.array_join(authors, ", "), title, journal, date.cast("string"), F.concat(F.lit("Vol. "), empty_to_null(volume.cast("string"))), F.concat(F.lit("pp. "), empty_to_null(pages))]
    return F.concat_ws(". ", *(empty_to_null(p) for p in parts))


def filled_prompt(template: Column, **values: Column) -> Column:
    """The template with {{NAME}} replaced by values; null counts as empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name.upper() + "}}"), F.coalesce(value, F.lit("")))
    return template


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """Messages of a training example, as JSON."""
    return F.to_json(F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant)))))


#: Words that tell languages apart; a text's language is that with the most of them.
COMMON_WORDS = {
    "de": "der die das und ist nicht ein eine mit von den zu im auf für",
    "en": "the of and to in is that for it as with was on by",
    "es": "el los las y que en un una por con del es se para",
    "fr": "le les et est dans un une des que pour du au sur pas",
    "it": "il gli e di che per una del della con non sono alla nel",
}


def language(c: Column, other: str = "en") -> Column:
    """Code of the language whose common words the text has most often, the first by code of equal ones; other without any."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    hits = lambda common: F.size(F.filter(words, lambda w: w.isin(*common.split())))
    best = F.array_min(F.array(*(F.struct((-hits(common)).alias("n"), F.lit(k).alias("k")) for k, common in sorted(COMMON_WORDS.items()))))
    return F.when(F.coalesce(best["n"], F.lit(0)) < 0, best["k"]).otherwise(other)
