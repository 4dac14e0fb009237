"""Records of bibliographic services, read from their JSON into one shape: title, authors, journal, year, volume, issue, pages,
publisher, doi, provider_id. Text that does not parse gives a null record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.ids import DOI_PREFIX
from refloom.functions.text import RECORD_YEAR, STAMP_YEAR, before_bracket, empty_to_null, family_name, first_year, path_tail, semicolon_names, split_authors, unescaped

_WORK = """id string, doi string, display_name string, publication_year int, authorships array<struct<author struct<display_name string>>>,
primary_location struct<source struct<display_name string, host_organization_name string>>, biblio struct<volume string, issue string, first_page string, last_page string>"""
_META = "id string, title string, author string, pub_date string, venue string, volume string, issue string, page string, publisher string, type string"


def _record(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def work_record(c: Column) -> Column:
    """A work of a service that nests authors and places of publication."""
    r = F.from_json(c, _WORK)
    b, place = r["biblio"], r["primary_location"]["source"]
    record = _record(
        title=r["display_name"], authors=F.filter(F.transform(r["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()), journal=place["display_name"],
        year=r["publication_year"], volume=b["volume"], issue=b["issue"], pages=empty_to_null(F.concat_ws("-", b["first_page"], b["last_page"])), publisher=place["host_organization_name"],
        doi=F.regexp_replace(r["doi"], DOI_PREFIX, ""), provider_id=path_tail(r["id"]),
    )
    return F.when(r["id"].isNotNull() | r["display_name"].isNotNull(), record)


def metadata_record(c: Column) -> Column:
    """A row of a service that writes names and identifiers as 'name [scheme:id]; ...' and 'scheme:value scheme:value'."""
    r = F.from_json(c, _META)
    ids = F.split(r["id"], " ")
    of = lambda scheme: F.regexp_replace(F.get(F.filter(ids, lambda i: i.startswith(scheme + ":")), F.lit(0)), f"^{scheme}:", "")
    text = lambda name: empty_to_null(F.trim(r[name]))
    record = _record(
        title=text("title"), authors=semicolon_names(r["author"]), journal=empty_to_null(before_bracket(r["venue"])), year=first_year(r["pub_date"]), volume=text("volume"), issue=text("issue"),
        pages=text("page"), publisher=empty_to_null(before_bracket(r["publisher"])), doi=of("doi"), provider_id=of("omid"),
    )
    return F.when(r["id"].isNotNull() | r["title"].isNotNull(), record)


def people(v: Column) -> Column:
    """Names of a variant: of a text, those between semicolons without brackets; of a list, its texts, and of its objects the name, else
    'given family'."""
    whole = F.try_variant_get(v, "$", "string")
    of = lambda x, k: empty_to_null(F.trim(F.try_variant_get(x, f"$.{k}", "string")))
    object_name = lambda x: F.coalesce(of(x, "name"), empty_to_null(F.concat_ws(" ", of(x, "given"), of(x, "family"))))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), object_name(x)).otherwise(empty_to_null(F.trim(F.try_variant_get(x, "$", "string")))))
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.filter(F.when(is_list, listed).otherwise(semicolon_names(whole)), lambda n: n.isNotNull())


def binding_record(c: Column) -> Column:
    """A row of a query service, where each variable is an object with a value. Names are 'a; b', places of publication 'name [ids]'."""
    v = F.try_parse_json(c)
    of = lambda k: empty_to_null(F.try_variant_get(v, f"$.{k}.value", "string"))
    record = _record(
        title=F.coalesce(of("title"), of("br")), authors=semicolon_names(of("author")), journal=empty_to_null(before_bracket(of("venue"))), year=first_year(of("pub_date")), volume=F.coalesce(of("volume"), of("volume_num")),
        issue=of("issue"), pages=F.coalesce(of("page"), of("start_page")), publisher=empty_to_null(before_bracket(of("publisher"))), doi=of("doi"), provider_id=path_tail(of("br"), 2),
    )
    return F.when(F.coalesce(of("title"), of("br")).isNotNull(), record)


#: Dates of a text in order of preference, and the record's own, whose first four characters stand for them.
TEXT_DATES = ["publishedDate", "publicationDate", "published", "date", "issued"]
RECORD_DATES = ["createdDate", "timestamp"]


def texts_record(c: Column) -> Column:
    """A work of a service that holds several texts of it: the first with a title, else the first. Fields are texts or lists of them."""
    v = F.try_parse_json(c)
    texts = F.try_variant_get(v, "$.texts", "array<variant>")

    def of(t: Column, k: str) -> Column:
        return F.coalesce(F.try_variant_get(t, f"$.{k}[0]", "string"), F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(t, f"$.{k}", "variant")).startswith("ARRAY"), F.lit(False)), F.try_variant_get(t, f"$.{k}", "string")))

    titled = F.filter(texts, lambda t: empty_to_null(of(t, "title")).isNotNull())
    t = F.coalesce(F.get(titled, F.lit(0)), F.get(texts, F.lit(0)))
    name = lambda a: empty_to_null(F.trim(F.coalesce(*(empty_to_null(F.try_variant_get(a, f"$.{k}", "string")) for k in ("name", "displayName", "fullName")), F.concat_ws(" ", F.try_variant_get(a, "$.firstName", "string"), F.try_variant_get(a, "$.lastName", "string")))))
    given = F.coalesce(F.try_variant_get(t, "$.author", "array<variant>"), F.try_variant_get(t, "$.authors", "array<variant>"))
    authors = F.filter(F.transform(given, lambda a: F.when(F.schema_of_variant(a).startswith("OBJECT"), name(a)).otherwise(empty_to_null(F.trim(F.try_variant_get(a, "$", "string"))))), lambda n: n.isNotNull())
    identifiers = F.try_variant_get(t, "$.identifier", "array<variant>")
    doi = F.get(F.filter(F.transform(identifiers, lambda i: F.try_variant_get(i, "$.doi[0]", "string")), lambda d: d.isNotNull()), F.lit(0))
    year = F.coalesce(*(first_year(of(t, k)) for k in TEXT_DATES), *(F.substring(F.try_variant_get(t, f"$.{k}", "string"), 1, 4).try_cast("int") for k in RECORD_DATES))
    title = empty_to_null(unescaped(F.trim(of(t, "title"))))
    nothing = F.lit(None).cast("string")
    record = _record(title=title, authors=authors, journal=of(t, "publisher"), year=year, volume=nothing, issue=nothing, pages=nothing, publisher=of(t, "publisher"), doi=doi, provider_id=F.try_variant_get(v, "$.id", "string"))
    return F.when(title.isNotNull(), record)


#: Properties of a knowledge base's items, and of qualifiers of authors.
CLAIMS = {"author_text": "P2093", "author_item": "P50", "date": "P577", "journal": "P1433", "volume": "P478", "issue": "P433", "pages": "P304", "doi": "P356"}
QUALIFIERS = {"ordinal": "P1545", "stated_as": "P1932", "named_as": "P1810"}


def item_record(c: Column, labels: Column | None = None) -> Column:
    """An item of a knowledge base: its label as title, the first value of each claim. Authors are written names, or where there are none
    items: by the name in a qualifier, else their label; by ordinal, those without one last, equal ones by place. labels: a map of items'
    labels; a journal that it lacks is shown by its item."""
    v = F.try_parse_json(c)
    labels = labels if labels is not None else F.create_map().cast("map<string,string>")
    text = lambda path: empty_to_null(F.try_variant_get(v, f"$.claims.{path}", "string"))
    value = "[0].mainsnak.datavalue.value"
    claim = lambda k: F.when(F.try_variant_get(v, f"$.claims.{CLAIMS[k]}[0].mainsnak.snaktype", "string") == "value", text(CLAIMS[k] + value))
    statements = lambda k: F.filter(F.coalesce(F.try_variant_get(v, f"$.claims.{CLAIMS[k]}", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.try_variant_get(s, "$.mainsnak.snaktype", "string") == "value")
    qualifier = lambda s, k: empty_to_null(F.try_variant_get(s, f"$.qualifiers.{QUALIFIERS[k]}[0].datavalue.value", "string"))
    ordinal = lambda s: F.coalesce(qualifier(s, "ordinal").try_cast("int"), F.lit(999))

    def ordered(found: Column, name) -> Column:
        rows = F.filter(F.transform(found, lambda s, i: F.struct(ordinal(s).alias("o"), i.alias("i"), name(s).alias("n"))), lambda r: r["n"].isNotNull())
        return F.transform(F.array_sort(rows), lambda r: r["n"])

    label = lambda item: F.element_at(labels, item)
    written = ordered(statements("author_text"), lambda s: empty_to_null(F.try_variant_get(s, "$.mainsnak.datavalue.value", "string")))
    items = ordered(statements("author_item"), lambda s: F.coalesce(qualifier(s, "stated_as"), qualifier(s, "named_as"), label(F.try_variant_get(s, "$.mainsnak.datavalue.value.id", "string"))))
    journal = text(CLAIMS["journal"] + value + ".id")
    record = _record(
        title=empty_to_null(F.try_variant_get(v, "$.label", "string")), authors=F.when(F.size(written) > 0, written).otherwise(items), journal=F.coalesce(label(journal), journal),
        year=first_year(text(CLAIMS["date"] + value + ".time"), STAMP_YEAR), volume=claim("volume"), issue=claim("issue"), pages=claim("pages"), publisher=F.lit(None).cast("string"), doi=claim("doi"),
        provider_id=F.try_variant_get(v, "$.id", "string"),
    )
    return F.when(F.try_variant_get(v, "$.id", "string").isNotNull(), record)


def fixed_metadata(v: Column) -> Column:
    """struct(doi, omid, first_author, venue) of a flat result: addresses before identifiers taken off; the first author before a semicolon
    and a bracket, the venue before a bracket; a DOI also from the list of identifiers."""
    of = lambda k: empty_to_null(F.trim(F.try_variant_get(v, f"$.{k}", "string")))
    listed = F.get(F.filter(F.split(of("id"), " "), lambda i: i.startswith("doi:")), F.lit(0))
    return F.struct(
        F.regexp_replace(F.coalesce(of("doi"), listed), DOI_PREFIX, "").alias("doi"), F.regexp_replace(of("omid"), r"^https?://(w3id\.org/oc/meta/|[^/]+/)", "").alias("omid"),
        empty_to_null(before_bracket(F.split_part(of("author"), F.lit(";"), F.lit(1)))).alias("first_author"), empty_to_null(before_bracket(of("venue"))).alias("venue"),
    )


def simplified(r: Column, **ids: Column) -> Column:
    """struct(title, first_author, year, journal, ids) of a record: the first author's family name, else as it stands; ids without nulls."""
    first = F.get(r["authors"], F.lit(0))
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in ids.items())), lambda e: e["v"].isNotNull())
    return F.struct(r["title"].alias("title"), F.coalesce(family_name(first), first).alias("first_author"), r["year"].alias("year"), r["journal"].alias("journal"), F.map_from_entries(entries).alias("ids"))


#: Fields of tagged references, by the name they have here.
TAGS = {"title": "title", "place": "publicationplace", "publisher": "publisher", "volume": "volume", "journal": "series", "pages": "pagination"}


def tagged_reference(tags: Column) -> Column:
    """struct of a map of tags: its fields as written, year the first that year, date or the number's year hold, authors split for evaluation."""
    year = F.coalesce(*(first_year(F.element_at(tags, k), RECORD_YEAR) for k in ("year", "date", "publicationnumber-year")))
    return _record(**{k: F.element_at(tags, t) for k, t in TAGS.items()}, year=year, authors=split_authors(F.coalesce(F.element_at(tags, "author"), F.lit(""))))


def plain_reference(tags: Column) -> Column:
    """The shorter form: title, place, date, year (if the date is a number) and authors, split at ' - ' only; commas and blanks at the ends
    taken off."""
    bare = lambda k, marks=", ": F.regexp_replace(F.element_at(tags, k), f"^[{marks}]+|[{marks}]+$", "")
    date = F.coalesce(bare("year", ", ."), bare("publicationnumber-year", ", ."))
    names = F.filter(F.transform(F.split(bare("author"), " - "), lambda a: F.trim(a)), lambda a: a != "")
    return _record(title=bare("title"), place=bare("publicationplace"), date=date, year=F.when(date.rlike("^[0-9]+$"), date.try_cast("int")), authors=F.when(empty_to_null(bare("author")).isNotNull(), names))
