"""Bibliographic records in TEI: fragments of documents, their fields, and the way back to TEI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.authors import agent
from refloom.functions.ids import parse_identifier
from refloom.functions.text import empty_to_null, matching_year, squeeze

_TITLE = "array<struct<_VALUE string, _level string>>"
_PERSON = "array<struct<_VALUE string, _role string, persName struct<forename array<struct<_VALUE string, _type string>>, surname string, roleName string>, orgName string>>"
_IDNO = "array<struct<_VALUE string, _type string, _scheme string>>"
_PART = f"title {_TITLE}, author {_PERSON}, editor {_PERSON}, idno {_IDNO}"
_IMPRINT = "struct<publisher string, pubPlace array<string>, date struct<_VALUE string, _when string>, biblScope array<struct<_VALUE string, _unit string, _from string, _to string>>>"
#: A biblStruct as from_xml reads it.
SCHEMA = f"_source string, analytic struct<{_PART}>, monogr struct<{_PART}, imprint {_IMPRINT}>, idno {_IDNO}, ref array<string>, citedRange string"

#: Elements of records that are read. The tags of others, such as highlighting, are taken out, so that titles keep their text.
ELEMENTS = "biblStruct analytic monogr title author editor persName forename surname roleName orgName idno imprint publisher pubPlace date biblScope ref citedRange".split()
_OTHER_TAGS = r"</?(?!(?:" + "|".join(ELEMENTS) + r")\b)[A-Za-z][^>]*>"


def fragments(doc: Column) -> Column:
    """biblStruct elements inside listBibl elements, nested lists too, in the order of the text; those outside lists are left out.
    Prefixes of names, as in tei:listBibl, are taken off."""
    bare = F.regexp_replace(doc, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "$1")
    marks = F.regexp_extract_all(bare, F.lit(r"(?s)<listBibl\b[^>]*/>|<listBibl\b[^>]*>|</listBibl\s*>|<biblStruct\b[^>]*?(?:/>|>.*?</biblStruct\s*>)"), F.lit(0))
    marks = F.filter(marks, lambda m: ~m.rlike(r"(?s)^<listBibl\b[^>]*/>$"))

    def step(state: Column, m: Column) -> Column:
        depth = state["depth"] + F.when(m.startswith("<listBibl"), 1).when(m.startswith("</listBibl"), -1).otherwise(0)
        keep = m.startswith("<biblStruct") & (state["depth"] > 0)
        return F.struct(depth.alias("depth"), F.when(keep, F.array_append(state["kept"], m)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept")), step, lambda state: state["kept"])


def all_fragments(doc: Column) -> Column:
    """biblStruct elements anywhere in the document."""
    bare = F.regexp_replace(doc, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "$1")
    return F.regexp_extract_all(bare, F.lit(r"(?s)<biblStruct\b[^>]*>.*?</biblStruct\s*>"), F.lit(0))


def _content(c: Column) -> Column:
    """Text of a piece of markup: without tags, entities read, squeezed."""
    text = F.regexp_replace(c, "<[^>]*>", " ")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return empty_to_null(squeeze(text))


def raw_references(doc: Column) -> Column:
    """Texts of bibl elements, the less structured form."""
    found = F.regexp_extract_all(doc, F.lit(r"(?s)<(?:[\w.-]+:)?bibl\b[^>]*>(.*?)</(?:[\w.-]+:)?bibl\s*>"), F.lit(1))
    return F.filter(F.transform(found, _content), lambda x: x.isNotNull())


def _all(r: Column, *paths: str) -> Column:
    return F.flatten(F.array(*(F.coalesce(r[a][b] if b else r[a], F.array()) for a, b in (p.split(".") if "." in p else (p, "") for p in paths))))


def _agents(people: Column, role: str | None = None) -> Column:
    """Persons and organisations of a role, or of all but translators; an author of both gives both."""
    wanted = (lambda p: p["_role"] == role) if role else (lambda p: F.coalesce(p["_role"], F.lit("")) != "translator")

    def read(p: Column) -> Column:
        forenames = F.coalesce(p["persName"]["forename"], F.array())
        of = lambda kind: squeeze(F.array_join(F.transform(F.filter(forenames, lambda f: F.lower(f["_type"]) == kind), lambda f: f["_VALUE"]), " "))
        any_forename = squeeze(F.array_join(F.transform(forenames, lambda f: f["_VALUE"]), " "))
        first = F.when((of("first") == "") & (of("middle") == ""), any_forename).otherwise(of("first"))
        person = agent("person", first_name=first, middle_name=of("middle"), surname=squeeze(p["persName"]["surname"]), role_name=squeeze(p["persName"]["roleName"]))
        organisation = agent("org", name=squeeze(p["orgName"]))
        literal = agent("str", literal=F.when(p["persName"].isNull() & p["orgName"].isNull(), squeeze(p["_VALUE"])))
        return F.filter(F.array(person, organisation, literal), lambda a: F.coalesce(a["first_name"], a["middle_name"], a["surname"], a["role_name"], a["name"], a["literal"]).isNotNull())

    return F.flatten(F.transform(F.filter(people, wanted), read))


def _names(agents: Column) -> Column:
    """'First Middle Surname' of persons, names of others."""
    return F.transform(agents, lambda a: F.coalesce(empty_to_null(F.concat_ws(" ", a["first_name"], a["middle_name"], a["surname"])), a["role_name"], a["name"], a["literal"]))


def parse(docs: DataFrame, xml: str = "xml", anywhere: bool = False) -> DataFrame:
    """One row for each record of docs' column xml: docs' other columns, pos, and the fields of the record. Records that do
    not parse have null fields and are dropped, as are those without any field; a null document has none. anywhere: of a document
    whose lists hold no record, records outside lists are read too."""
    others = [c for c in docs.columns if c != xml]
    found = fragments(F.col(xml))
    found = F.when(F.size(found) > 0, found).otherwise(all_fragments(F.col(xml))) if anywhere else found
    rows = docs.select(*others, F.posexplode(found).alias("pos", "__xml")).withColumn("__r", F.from_xml(F.regexp_replace("__xml", _OTHER_TAGS, " "), SCHEMA))
    r = F.col("__r")
    titles = _all(r, "analytic.title", "monogr.title")
    level = lambda k: F.nullif(F.array_join(F.transform(F.filter(titles, lambda t: t["_level"] == k), lambda t: squeeze(t["_VALUE"])), " "), F.lit(""))
    scopes = F.coalesce(r["monogr"]["imprint"]["biblScope"], F.array())

    def scope(unit: str) -> Column:
        first = F.get(F.filter(scopes, lambda s: s["_unit"] == unit), F.lit(0))
        return F.coalesce(F.nullif(F.trim(first["_VALUE"]), F.lit("")), F.nullif(F.concat_ws("-", first["_from"], first["_to"]), F.lit("")))

    idnos = F.transform(_all(r, "analytic.idno", "monogr.idno", "idno"), lambda i: parse_identifier(i["_VALUE"], scheme=F.coalesce(i["_type"], i["_scheme"])))
    idnos = F.filter(idnos, lambda i: i.isNotNull())
    people = lambda kind, role=None: _agents(_all(r, f"analytic.{kind}", f"monogr.{kind}"), role)
    imprint = r["monogr"]["imprint"]
    fields = {
        "title": level("a"), "full_title": level("m"), "journal": level("j"), "authors": _names(people("author")), "editors": _names(people("editor")),
        "translator": F.get(_names(people("editor", "translator")), F.lit(0)), "publisher": imprint["publisher"], "place": F.nullif(F.array_join(F.coalesce(imprint["pubPlace"], F.array()), ", "), F.lit("")),
        "date": F.coalesce(F.nullif(F.trim(imprint["date"]["_VALUE"]), F.lit("")), imprint["date"]["_when"]), "volume": scope("volume"), "issue": scope("issue"), "pages": scope("page"),
        "identifiers": idnos, "footnote": F.substring(r["_source"], 3, 1 << 20), "refs": F.nullif(F.array_join(F.transform(F.coalesce(r["ref"], F.array()), squeeze), " "), F.lit("")),
        "cited_range": empty_to_null(squeeze(r["citedRange"])), "author_agents": people("author"), "editor_agents": people("editor"),
    }
    made = rows.select(*others, "pos", *(v.alias(k) for k, v in fields.items()))
    scalars = [F.col(k) for k in fields if k not in ("authors", "editors", "identifiers", "footnote", "author_agents", "editor_agents")]
    return made.where(F.coalesce(*scalars).isNotNull() | (F.size("authors") > 0) | (F.size("editors") > 0) | (F.size("identifiers") > 0))


def escaped(c: Column) -> Column:
    for sign, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(mark))
    return c


def _element(name: str, c: Column, **attributes: str) -> Column:
    """The element, or nothing where the value is null."""
    start = name + "".join(f' {k}="{v}"' for k, v in attributes.items())
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{start}>"), escaped(c.cast("string")), F.lit(f"</{name}>")))


def _agent_xml(element: str, a: Column, role: str = "") -> Column:
    """An element of an agent's names; nothing where it has none."""
    part = lambda name, c, **attributes: F.coalesce(_element(name, c, **attributes), F.lit(""))
    person = F.concat(F.lit("<persName>"), part("forename", a["first_name"], type="first"), part("forename", a["middle_name"], type="middle"), part("surname", a["surname"]), part("roleName", a["role_name"]), F.lit("</persName>"))
    body = F.when(a["kind"] == "person", person).when(a["kind"] == "org", _element("orgName", a["name"])).otherwise(escaped(a["literal"]))
    start = element + (f' role="{role}"' if role else "")
    return F.when(body.isNotNull() & (body != "<persName></persName>"), F.concat(F.lit(f"<{start}>"), body, F.lit(f"</{element}>")))


def inverted_name(c: Column) -> Column:
    """The person of 'Family, Given'; of a name without a comma, the family name."""
    return agent("person", first_name=F.when(F.contains(c, F.lit(",")), F.trim(F.split_part(c, F.lit(","), F.lit(2)))), surname=F.trim(F.split_part(c, F.lit(","), F.lit(1))))


def record_xml(title: Column, authors: Column, full_title: Column, journal: Column, publisher: Column, place: Column, date: Column, volume: Column, pages: Column, doi: Column,
               issue: Column | None = None, editors: Column | None = None, translators: Column | None = None, identifiers: Column | None = None, cited_range: Column | None = None, footnote: Column | None = None, agents: bool = False) -> Column:
    """biblStruct of one record. People are arrays of 'Family, Given', or with agents of AGENT structs; authors stand under the article,
    where there is one, else the book, editors and translators under the book. Identifiers are structs of scheme and value."""
    def people(element: str, c: Column | None, role: str = "") -> Column:
        if c is None:
            return F.lit("")
        return F.coalesce(F.array_join(F.transform(c, lambda a: F.coalesce(_agent_xml(element, a if agents else inverted_name(a), role), F.lit(""))), ""), F.lit(""))

    article = title.isNotNull()
    ids = F.lit("") if identifiers is None else F.coalesce(F.array_join(F.transform(identifiers, lambda i: F.concat(F.lit('<idno type="'), escaped(i["scheme"]), F.lit('">'), escaped(i["value"]), F.lit("</idno>"))), ""), F.lit(""))
    scope = lambda c, unit: _element("biblScope", c, unit=unit) if c is not None else F.lit("")
    imprint = F.concat_ws("", F.lit("<imprint>"), _element("publisher", publisher), _element("pubPlace", place), _element("date", date), scope(volume, "volume"), scope(issue, "issue"), scope(pages, "page"), F.lit("</imprint>"))
    analytic = F.when(article, F.concat_ws("", F.lit("<analytic>"), _element("title", title, level="a"), people("author", authors), _element("idno", doi, type="DOI"), F.lit("</analytic>")))
    monogr = F.concat_ws("", F.lit("<monogr>"), _element("title", full_title, level="m"), _element("title", journal, level="j"), F.when(~article, people("author", authors)), people("editor", editors), people("editor", translators, "translator"), imprint, F.lit("</monogr>"))
    start = F.lit("<biblStruct>") if footnote is None else F.when(footnote.isNull(), F.lit("<biblStruct>")).otherwise(F.concat(F.lit('<biblStruct source="fn'), escaped(footnote), F.lit('">')))
    return F.concat_ws("", start, analytic, monogr, F.when(~article, _element("idno", doi, type="DOI")), ids, _element("citedRange", cited_range) if cited_range is not None else F.lit(""), F.lit("</biblStruct>"))


def document_xml(records: Column) -> Column:
    """A TEI document of an array of records."""
    head, tail = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><back><div><listBibl>', "</listBibl></div></back></text></TEI>"
    return F.concat(F.lit(head), F.array_join(records, ""), F.lit(tail))


def cascade(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs' other columns, pos, title, authors, raw: the records of lists; where a document has none, those outside lists; where there
    are none either, the texts of its bibl elements as raw."""
    others = [c for c in docs.columns if c != xml]
    keyed = docs.withColumn("__raw", raw_references(F.col(xml)))
    records = parse(keyed.withColumn("__key", F.xxhash64(*(F.col(c) for c in others))), xml, anywhere=True)
    found = records.select(*others, "__key", "pos", F.coalesce("title", "full_title").alias("title"), "authors", F.lit(None).cast("string").alias("raw"))
    rest = keyed.withColumn("__key", F.xxhash64(*(F.col(c) for c in others))).join(found.select("__key").distinct(), "__key", "left_anti")
    texts = rest.select(*others, F.posexplode("__raw").alias("pos", "raw")).select(*others, "pos", F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("authors"), "raw")
    return found.drop("__key").unionByName(texts)


def header(doc: Column) -> Column:
    """struct(title, publisher, date, year, doi, pmid, pmcid, journal, volume, pages) of a document's header; null fields where it lacks
    them. Read by pattern, so that prefixes and documents that aren't well formed do no harm."""
    bare = F.regexp_replace(doc, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "$1")
    inside = lambda c, name: F.regexp_extract(c, rf"(?s)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    with_attribute = lambda c, name, attribute: _content(F.regexp_extract(c, rf"(?s)<{name}\b[^>]*\b{attribute}[^>]*>(.*?)</{name}\s*>", 1))
    titles, publication, source = inside(bare, "titleStmt"), inside(bare, "publicationStmt"), inside(inside(bare, "sourceDesc"), "biblStruct")
    monogr = inside(source, "monogr")
    date_tag = F.regexp_extract(publication, r'(?s)<date\b[^>]*\btype="published"[^>]*>', 0)
    page = F.regexp_extract(monogr, r'(?s)<biblScope\b[^>]*\bunit="page"[^>]*>', 0)
    attribute = lambda tag, name: empty_to_null(F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1))
    # text of the element itself, as for a self-closing date there is none
    date = F.when(~date_tag.endswith("/>"), with_attribute(publication, "date", 'type="published"'))
    first, last = attribute(page, "from"), attribute(page, "to")
    return F.struct(
        with_attribute(titles, "title", 'level="a"').alias("title"), _content(inside(publication, "publisher")).alias("publisher"), date.alias("date"),
        empty_to_null(F.regexp_extract(attribute(date_tag, "when"), r"([0-9]{4})", 1)).alias("year"),
        *(with_attribute(source, "idno", f'type="{k}"').alias(k.lower()) for k in ("DOI", "PMID", "PMCID")),
        with_attribute(monogr, "title", 'level="j"').alias("journal"), with_attribute(monogr, "biblScope", 'unit="volume"').alias("volume"),
        F.when(first.isNotNull() & last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first).alias("pages"),
    )


#: Fixed value: the title of tagged lines that have none.
NO_TITLE = "Unknown Title"


def tagged_record(line: Column) -> Column:
    """The record of a line with tags but no root: struct(title, authors, editors, journal, date, year, volume, issue, pages, publisher,
    place), people as agents. Lines need not be well formed; text between tags is left out. Null for null."""
    whole = F.regexp_replace(line, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+);)", "&amp;")
    own = lambda name: _content(F.regexp_extract(whole, rf"(?s)<{name}\b[^>]*>(.*?)</{name}\s*>", 1))

    def people(name: str, organisations: bool) -> Column:
        def read(x: Column) -> Column:
            part = lambda tag: _content(F.regexp_extract(x, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
            person = agent("person", first_name=part("given-names"), surname=part("surname"))
            named = F.coalesce(person["first_name"], person["surname"]).isNotNull()
            text = _content(F.regexp_extract(x, r"(?s)^([^<]*)", 1))
            return F.when(named, person).when(F.lit(organisations) & text.isNotNull(), agent("org", name=text))

        found = F.regexp_extract_all(whole, F.lit(rf"(?s)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
        return F.filter(F.transform(found, read), lambda a: a.isNotNull())

    first, last = own("fpage"), own("lpage")
    return F.when(line.isNotNull(), F.struct(
        F.coalesce(own("title"), F.lit(NO_TITLE)).alias("title"), people("author", False).alias("authors"), people("editor", True).alias("editors"), own("source").alias("journal"),
        own("year").alias("date"), matching_year(own("year")).alias("year"), own("volume").alias("volume"), own("issue").alias("issue"),
        F.when(first.isNotNull() & last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first).alias("pages"), own("publisher").alias("publisher"), own("other").alias("place"),
    ))
