"""Identifiers of records: scheme, value and normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What precedes a DOI or an arXiv number.
DOI_PREFIX = r"(?i)^(https?://(dx\.)?doi\.org/|doi:[ ]*|doi[ ]+)"
ARXIV_PREFIX = r"(?i)^(https?://arxiv\.org/abs/|arxiv:[ ]*)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^0-9X]", "")


def detect_scheme(c: Column) -> Column:
    """By form, in this order: doi, arxiv (bare numbers), pmid, isbn (ten or thirteen digits or X), issn, wikidata, url; else null."""
    text = F.trim(c)
    return (
        F.when(text.startswith("10.") & F.contains(text, F.lit("/")), "doi")
        .when(text.rlike(r"^([0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|[a-z-]+/[0-9]{7})$"), "arxiv")
        .when(F.lower(text).startswith("pmid"), "pmid")
        .when(F.length(_digits(text)).isin(10, 13), "isbn")
        .when(text.rlike(r"^[0-9]{4}-?[0-9]{3}[0-9xX]$"), "issn")
        .when(text.rlike(r"^[Qq][0-9]+$"), "wikidata")
        .when(text.rlike(r"(?i)^https?://"), "url")
    )


def normalize_id(scheme: Column, value: Column) -> Column:
    value, bare = F.trim(value), _digits(value)
    return (
        F.when(scheme == "doi", F.trim(F.regexp_replace(value, DOI_PREFIX, "")))
        .when(scheme == "isbn", bare)
        .when(scheme == "issn", F.when(F.length(bare) == 8, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(bare))
        .when(scheme == "pmid", F.regexp_replace(value, r"[^0-9]", ""))
        .when(scheme == "arxiv", F.trim(F.regexp_replace(value, ARXIV_PREFIX, "")))
        .when(scheme == "wikidata", F.upper(value))
        .otherwise(value)
    )


def parse_identifier(c: Column, known_only: bool = False, scheme: Column | None = None) -> Column:
    """struct(scheme, value, normalized). By the scheme given, in lower case, where it isn't null; else 'scheme: value' or
    'scheme value' as written; else by the text's form, else null. known_only: written schemes are taken only from a list."""
    text = F.trim(c)
    inline = r"^([a-zA-Z][A-Za-z0-9_-]*)[ ]*[: ][ ]*(.+)$"
    known = text.rlike(r"(?i)^(doi|arxiv|pmid|isbn|issn|wikidata|url)[ ]*[: ]") if known_only else F.lit(True)
    is_inline = text.rlike(inline) & known
    found = F.when(is_inline, F.lower(F.regexp_extract(text, inline, 1))).otherwise(detect_scheme(text))
    value = F.when(is_inline, F.regexp_extract(text, inline, 2)).otherwise(text)
    if scheme is not None:
        given = F.nullif(F.trim(scheme), F.lit("")).isNotNull()
        found, value = F.when(given, F.lower(F.trim(scheme))).otherwise(found), F.when(given, text).otherwise(value)
    return F.when(found.isNotNull() & (text != ""), F.struct(found.alias("scheme"), value.alias("value"), normalize_id(found, value).alias("normalized")))


#: Labels of identifiers inside other fields, by scheme.
LABELS = {"doi": "DOI|doi", "isbn": "ISBN|isbn", "issn": "ISSN|issn", "pmid": "PMID|pmid", "arxiv": "arXiv|arxiv"}


def labelled_identifiers(identifiers: Column, *fields: Column) -> Column:
    """The identifiers, or where there are none those written with a label inside the fields, by field and then by scheme.
    Identifiers are structs of scheme, value and normalized."""
    one = lambda s: lambda v: F.struct(F.lit(s).alias("scheme"), v.alias("value"), normalize_id(F.lit(s), v).alias("normalized"))
    found = [F.transform(F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(rf"\b(?:{label})[:\s：]+([^\s,;]+)"), F.lit(1)), one(s)) for f in fields for s, label in LABELS.items()]
    return F.when(F.size(F.coalesce(identifiers, F.array())) > 0, identifiers).otherwise(F.concat(*found))


#: What a service's identifier search strips, and the types it takes.
SEARCH_PREFIX = r"(?i)^(https?://doi\.org/|http://dx\.doi\.org/|doi:)"
SEARCH_TYPES = "doi isbn arxiv repec pmid eid nlmuniqueid rid pii pmcid pmc mid bookaccession versionid version medline pmpid hal".split()


def search_identifier(c: Column, kind: Column | None = None) -> Column:
    """The identifier as a search service takes it; null for types that it doesn't support (none given: a DOI)."""
    asked = F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("doi"))) if kind is not None else F.lit("doi")
    return F.when(asked.isin(SEARCH_TYPES), F.regexp_replace(F.trim(c), SEARCH_PREFIX, ""))


def work_identifier(c: Column) -> Column:
    """struct(scheme, value): 'doi' without its prefixes, or 'openalex' as W and a number, null if it isn't one."""
    text = F.trim(c)
    is_work = ~(F.lower(text).startswith("10.") | F.contains(F.lower(text), F.lit("doi"))) & (F.upper(text).startswith("W") | F.contains(F.lower(text), F.lit("openalex")))
    tail = F.upper(F.element_at(F.split(text, "/"), -1))
    value = F.when(~is_work, F.regexp_replace(text, SEARCH_PREFIX, "")).when(tail.startswith("W"), tail)
    return F.struct(F.when(is_work, "openalex").otherwise("doi").alias("scheme"), value.alias("value"))


#: Properties of a knowledge base that hold identifiers, by scheme.
PROPERTIES = {"doi": "P356", "isbn": "P212", "issn": "P236", "pmid": "P698", "pmcid": "P932", "arxiv": "P818"}


def guessed_scheme(c: Column) -> Column:
    """By the text's form, in this order: doi, wikidata, arxiv, pmcid, pmid, isbn, issn, pmid of five to eight digits; else null."""
    text = F.trim(c)
    low, bare = F.lower(text), _digits(text)
    number = bare.rlike("^[0-9]+$")
    return (
        F.when(low.startswith("10.") | low.startswith("doi:") | F.contains(low, F.lit("doi.org")), "doi")
        .when(text.rlike(r"^[Qq][0-9]+$"), "wikidata")
        .when(low.rlike(r"^[0-9]{4}\.[0-9]{4,5}$") | F.contains(low, F.lit("arxiv")), "arxiv")
        .when(low.startswith("pmc"), "pmcid")
        .when(low.startswith("pmid"), "pmid")
        .when(number & F.length(bare).isin(10, 13), "isbn")
        .when(F.length(bare) == 8, "issn")
        .when(number & F.length(bare).between(5, 8), "pmid")
    )


def property_lookup(c: Column, scheme: Column | None = None) -> Column:
    """struct(scheme, property, value) to look an identifier up by; property is null for schemes without one."""
    found = F.coalesce(F.lower(scheme), guessed_scheme(c)) if scheme is not None else guessed_scheme(c)
    known = F.create_map(*(F.lit(x) for pair in PROPERTIES.items() for x in pair))
    value = F.when(found == "doi", F.regexp_replace(F.trim(c), SEARCH_PREFIX, "")).when(found.isin("isbn", "issn"), F.regexp_replace(c, r"[^0-9Xx]", "")).when(found.isin("pmid", "pmcid", "arxiv"), F.trim(c)).when(found == "wikidata", F.upper(F.trim(c)))
    return F.struct(found.alias("scheme"), F.element_at(known, found).alias("property"), value.alias("value"))


def doi_in(c: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(c, r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), r"[.,;)]+$", "")
    return F.nullif(found, F.lit(""))


def provider_id(c: Column) -> Column:
    """'scheme:value' as index services take it: doi, isbn, issn or omid."""
    return F.when(c.rlike(r"^10\."), F.concat(F.lit("doi:"), c)).when(c.rlike(r"^[0-9]{4}-[0-9]{3}[0-9X]$"), F.concat(F.lit("issn:"), c)).when(c.rlike(r"^br/"), F.concat(F.lit("omid:"), c)).otherwise(F.concat(F.lit("isbn:"), c))
