"""Queries over flows: agents, names, identifiers, services' records, documents with a model in between, training data, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import authors, ids, text
from refloom.operators import evaluate, flows, locate, records
from refloom.plans.catalog import query
from refloom.sources import providers, tei
from refloom.streaming import jobs


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Agents, names, identifiers


@query("""SELECT field, matches, preds, labels, round(matches / preds, 4) AS precision, round(matches / labels, 4) AS recall, round(2 * matches / (preds + labels), 4) AS f1 FROM (
SELECT 'authors' AS field, sum(CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE 1 END)::DOUBLE AS matches, count(*) AS preds, count(*) AS labels FROM orders UNION ALL SELECT 'title', count(*)::DOUBLE, count(*), count(*) FROM orders)""")
def agents_per_field(t):
    key = F.col("o_orderkey").cast("string")
    person = authors.agent("person", first_name=F.lit("Ann"), middle_name=F.lit("C."), surname=_text("Day", key))
    shown = F.when(F.col("o_orderkey") % 4 == 1, _text("Day", key, ", Ann C.")).when(F.col("o_orderkey") % 4 == 2, _text("ann c. day", key)).otherwise(F.lit("Bo"))
    predicted = F.when(F.col("o_orderkey") % 4 == 0, person).otherwise(authors.agent("str", literal=shown))
    record = lambda a: F.array(F.struct(F.create_map(F.lit("title"), F.array(key)).alias("texts"), F.create_map(F.lit("authors"), F.array(a)).alias("agents")))
    pairs = t("orders").select(F.col("o_orderkey").alias("doc_id"), record(person).alias("gold"), record(predicted).alias("predicted"))
    return evaluate.per_field(evaluate.align_records(pairs, ["title", "authors"]))


@query("""SELECT x AS overall_precision, x AS overall_recall, x AS overall_micro_f1, x AS overall_macro_f1, y AS focused_precision, y AS focused_recall, y AS focused_micro_f1, y AS focused_macro_f1, y AS year_f1
FROM (SELECT round((count(*) + count(*) FILTER (o_orderkey % 2 = 0)) / (2.0 * count(*)), 4)::DOUBLE AS x, round(count(*) FILTER (o_orderkey % 2 = 0) / (1.0 * count(*)), 4)::DOUBLE AS y FROM orders)""")
def evaluation_report(t):
    of = lambda year: F.array(F.create_map(F.lit("title"), F.array("o_orderpriority"), F.lit("year"), F.array(year)))
    year = F.year("o_orderdate").cast("string")
    pairs = t("orders").select(F.col("o_orderkey").alias("doc_id"), of(year).alias("gold"), of(F.when(F.col("o_orderkey") % 2 == 0, year).otherwise("0")).alias("predicted"))
    out = evaluate.report(pairs, ["title", "year"], ["year"])
    return out.select(*(c for c in out.columns if c != "per_field"), F.col("per_field")["year"]["f1"].alias("year_f1"))


@query("""SELECT p_partkey AS doc_id, CAST(a AND s >= 0.8 AS BIGINT) AS matches, CAST(a AS BIGINT) AS preds, CAST(a AS BIGINT) AS labels, CASE WHEN NOT a OR s >= 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN NOT a OR s >= 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall,
CASE WHEN NOT a OR s >= 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS f1, CASE WHEN NOT a THEN 1.0 WHEN s >= 0.8 THEN round(s, 4) ELSE 0.0 END::DOUBLE AS similarity FROM (SELECT p_partkey, p_partkey % 5 > 0 AS a, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) AS s0,
CASE WHEN p_partkey % 2 = 0 THEN 1 - 1.0 / (length(p_name) + 1) ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END AS s FROM part)""")
def strings_by_edits(t):
    some = F.col("p_partkey") % 5 > 0
    gold = F.when(some, F.array("p_name", F.lit("  "))).otherwise(F.array(F.lit("")))
    predicted = F.when(some, F.array(F.lit(""), F.when(F.col("p_partkey") % 2 == 0, _text(" ", F.col("p_name"), "x")).otherwise(F.col("p_type")))).otherwise(F.array().cast("array<string>"))
    return evaluate.align_strings(t("part").select(F.col("p_partkey").alias("doc_id"), gold.alias("gold"), predicted.alias("predicted")), mode="levenshtein")


@query("""SELECT p_partkey, CASE k WHEN 0 THEN ['Rossi|G.|F.', 'Bianchi|A.|'] WHEN 1 THEN ['Camerini|Paolo|'] WHEN 2 THEN ['Rossi|A.|B.'] WHEN 3 THEN ['Berchet|George|'] WHEN 4 THEN ['Smith|John|Paul'] WHEN 5 THEN ['Barrucand|M.|', 'Bednorz|A.|'] WHEN 6 THEN ['COLAK|N.|'] WHEN 7 THEN ['Della Torre|A.|']
ELSE ['=Smith and Brown ' || p_size] END AS names FROM (SELECT *, p_partkey % 9 AS k FROM part)""")
def author_names(t):
    forms = ["Rossi, G. F., Bianchi, A.", "Paolo Camerini", "A. B. Rossi", "Berchet, George", "John Paul Smith", "Barrucand M., A. Bednorz,", "N. COLAK", "Della Torre A."]
    shown = F.coalesce(F.get(F.array(*(F.lit(f) for f in forms)), F.col("p_partkey").cast("int") % 9), _text("Smith and Brown ", F.col("p_size")))
    name = lambda a: F.when(a["kind"] == "str", F.concat(F.lit("="), a["literal"])).otherwise(F.concat_ws("|", a["surname"], a["first_name"], F.coalesce(a["middle_name"], F.lit(""))))
    return t("part").select("p_partkey", F.transform(authors.parsed_authors(shown), name).alias("names"))


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 'arxiv' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'doi' WHEN 3 THEN 'isbn' WHEN 4 THEN 'url' WHEN 5 THEN 'pmid' END AS scheme FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)""")
def identifier_forms(t):
    n = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    forms = F.array(_text("2101.", n), _text("math/06", n), _text("10.1/", n), _text("0-123-", n, "-X"), _text("http://doi.org/10.1/", n), _text("pmid", n), F.lit("123"))
    return t("part").select("p_partkey", ids.detect_scheme(F.get(forms, F.col("p_partkey").cast("int") % 7)).alias("scheme"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['isbn:x'] ELSE ['doi:10.1/' || p_partkey, 'issn:1234-567X', 'pmid:' || p_partkey] END AS found, CASE WHEN p_partkey % 2 = 0 THEN 'openalex' ELSE 'doi' END AS work_scheme, CASE WHEN p_partkey % 2 = 0 THEN 'W' || p_partkey ELSE '10.1/' || p_partkey END AS work_value,
'P698' AS property, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS searched FROM part""")
def identifiers_in_fields(t):
    k = F.col("p_partkey")
    given = F.when(k % 3 == 0, F.array(F.struct(F.lit("isbn").alias("scheme"), F.lit("x").alias("value"), F.lit("x").alias("normalized"))))
    found = ids.labelled_identifiers(given, _text("A title, DOI: 10.1/", k, ", ISSN：1234-567x;"), _text("pmid ", k), F.lit(None).cast("string"))
    work = ids.work_identifier(F.when(k % 2 == 0, _text("w", k)).otherwise(_text("https://doi.org/10.1/", k)))
    return t("part").select(
        "p_partkey", F.transform(found, lambda i: F.concat_ws(":", i["scheme"], i["normalized"])).alias("found"), work["scheme"].alias("work_scheme"), work["value"].alias("work_value"),
        ids.property_lookup(_text("pmid", k))["property"].alias("property"), ids.search_identifier(_text("doi:10.1/", k), F.when(k % 2 == 0, "DOI").otherwise("orcid")).alias("searched"),
    )


# Records of services and TEI


@query("""SELECT o_orderkey, 'Order & ' || o_orderkey AS title, CASE o_orderkey % 3 WHEN 0 THEN ['Ann', 'Bo'] WHEN 1 THEN ['Ann Day', 'Bo', 'Cy'] ELSE ['Second', 'First', 'Last'] END AS authors, year(o_orderdate) AS year, CASE WHEN o_orderkey % 3 < 2 THEN '10.1/' || o_orderkey ELSE '10.2/' || o_orderkey END AS doi,
CASE o_orderkey % 3 WHEN 0 THEN 'Venue' WHEN 1 THEN 'Press' ELSE 'The Journal' END AS journal FROM orders""")
def service_records(t):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    binding = _text('{"br": {"value": "https://host/br/', k, '"}, "title": {"value": "Order & ', k, '"}, "author": {"value": "Ann [orcid:1]; Bo"}, "pub_date": {"value": "', y, '-01"}, "venue": {"value": "Venue [issn:1]"}, "doi": {"value": "10.1/', k, '"}}')
    texts = _text('{"id": "', k, '", "texts": [{"title": ""}, {"title": [" Order &amp; ', k, '"], "author": [{"firstName": "Ann", "lastName": "Day"}, "Bo ", {"displayName": "Cy"}], "publisher": ["Press"], "identifier": [{"isbn": ["1"]}, {"doi": ["10.1/', k, '"]}], "publishedDate": ["', y, '-02-01"], "createdDate": "1900"}]}')
    claim = lambda p, v: f'"{p}": [{{"mainsnak": {{"snaktype": "value", "datavalue": {{"value": '  + v
    author = lambda v, o: '{"mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "' + v + '"}}}' + o + "}"
    item = _text(
        '{"id": "Q', k, '", "label": "Order & ', k, '", "claims": {' + claim("P577", '{"time": "+'), y, '-01-01T00:00:00Z"}}}}], ' + claim("P1433", '{"id": "Q1"}}}}], ') + claim("P356", '"10.2/'), k,
        '"}}}], "P50": [' + ", ".join([
            author("Q9", ""), author("Q7", ', "qualifiers": {"P1545": [{"datavalue": {"value": "2"}}], "P1810": [{"datavalue": {"value": "First"}}]}'),
            author("Q8", ', "qualifiers": {"P1545": [{"datavalue": {"value": "1"}}]}'), author("Q6", ""),
        ]) + "]}}",
    )
    labels = F.create_map(*(F.lit(x) for x in ("Q1", "The Journal", "Q8", "Second", "Q9", "Last")))
    r = F.when(k % 3 == 0, providers.binding_record(binding)).when(k % 3 == 1, providers.texts_record(texts)).otherwise(providers.item_record(item, labels))
    return t("orders").select("o_orderkey", r.alias("r")).select("o_orderkey", *(f"r.{c}" for c in ("title", "authors", "year", "doi", "journal")))


@query("""SELECT s_suppkey, 'A b ' || s_suppkey AS title, 'Press' AS publisher, '3 May 2001' AS date, '2001' AS year, '10.1/' || s_suppkey AS doi, 'J' AS journal, '7' AS volume, CASE WHEN s_suppkey % 2 = 0 THEN '1-9' ELSE '1' END AS pages FROM supplier""")
def document_headers(t):
    k = F.col("s_suppkey")
    doc = _text('<TEI xmlns:t="x"><t:teiHeader><t:titleStmt><t:title level="a">A <hi>b</hi> ', k, '</t:title></t:titleStmt><publicationStmt><publisher>Press</publisher><date type="published" when="2001-05-03">3 May 2001</date></publicationStmt><sourceDesc><biblStruct><idno type="DOI">10.1/', k,
                '</idno><monogr><title level="j">J</title><imprint><biblScope unit="volume">7</biblScope><biblScope unit="page" from="1"', F.when(k % 2 == 0, ' to="9"').otherwise(""), "/></imprint></monogr></biblStruct></sourceDesc></t:teiHeader></TEI>")
    return t("supplier").select("s_suppkey", tei.header(doc).alias("h")).select("s_suppkey", *(f"h.{c}" for c in ("title", "publisher", "date", "year", "doi", "journal", "volume", "pages")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown Title' ELSE 'R & D ' || s_suppkey END AS title, ['Ann Day', 'Cy'] AS authors, CASE WHEN s_suppkey % 2 = 0 THEN ['Org'] ELSE ['Bo Ed'] END AS editors, 1999 AS year, '3-8' AS pages, 'Rome' AS place FROM supplier""")
def tagged_lines(t):
    k = F.col("s_suppkey")
    line = _text("<author><surname>Day</surname>, <given-names>Ann</given-names></author>; <author><given-names>Cy</given-names></author>, ", F.when(k % 3 == 0, "").otherwise(_text("<title>R & D ", k, "</title>")), " In: <editor>",
                 F.when(k % 2 == 0, "Org").otherwise("<surname>Ed</surname> <given-names>Bo</given-names>"), "</editor> <year>1999a, 1999</year> <fpage>3</fpage>-<lpage>8</lpage> <other>Rome</other>")
    return t("supplier").select("s_suppkey", tei.tagged_record(line).alias("r")).select("s_suppkey", "r.title", *(F.transform(f"r.{c}", lambda a: authors.agent_string(a)).alias(c) for c in ("authors", "editors")), "r.year", "r.pages", "r.place")


@query("""SELECT s_suppkey, CAST(pos AS INTEGER) AS pos, CASE WHEN k < 2 THEN CASE pos WHEN 0 THEN 'First ' || s_suppkey ELSE 'A b c' END END AS title, CASE WHEN k = 2 THEN 'Day, A. Raw & ' || s_suppkey END AS raw FROM (SELECT *, s_suppkey % 3 AS k FROM supplier), LATERAL (SELECT unnest(range(CASE k WHEN 2 THEN 1 ELSE 2 END)) AS pos)""")
def tei_cascade(t):
    k = F.col("s_suppkey")
    record = lambda title: _text('<biblStruct><analytic><title level="a">', title, "</title></analytic></biblStruct>")
    first, second = record(_text("First ", k)), record(F.lit("A <hi rend='i'>b</hi> c"))
    listed = _text("<TEI><listBibl><listBibl>", first, "</listBibl>", second, "</listBibl>", record(F.lit("outside")), "</TEI>")
    loose = _text("<TEI><p>", first, "</p>", second, "</TEI>")
    raw = _text("<TEI><bibl>Day, A. <title>Raw &amp; ", k, "</title></bibl><bibl> </bibl></TEI>")
    docs = t("supplier").select("s_suppkey", F.when(k % 3 == 0, listed).when(k % 3 == 1, loose).otherwise(raw).alias("xml"))
    return tei.cascade(docs).select("s_suppkey", "pos", "title", "raw")


@query("""SELECT s_suppkey, ['A. Day', 'Org'] AS authors, ['Bo Ed'] AS editors, 'Cy Tr' AS translator, '4' AS issue, '12' AS footnote, 'pp. 3' AS cited_range, ['doi:10.1/' || s_suppkey, 'isbn:123X'] AS found FROM supplier""")
def tei_agents(t):
    nothing, k = F.lit(None).cast("string"), F.col("s_suppkey")
    people = lambda *a: F.array(*a)
    person = lambda first, last: authors.agent("person", first_name=F.lit(first), surname=F.lit(last))
    given = F.array(F.struct(F.lit("isbn").alias("scheme"), F.lit("1-2-3x").alias("value")))
    record = tei.record_xml(_text("T ", k), people(person("A.", "Day"), authors.agent("org", name=F.lit("Org"))), nothing, F.lit("J"), nothing, nothing, nothing, F.lit("7"), nothing, _text("https://doi.org/10.1/", k), F.lit("4"), people(person("Bo", "Ed")),
                            people(person("Cy", "Tr")), given, F.lit("pp. 3"), F.lit("12"), agents=True)
    docs = t("supplier").select("s_suppkey", tei.document_xml(F.array(record)).alias("xml"))
    return tei.parse(docs).select("s_suppkey", "authors", "editors", "translator", "issue", "footnote", "cited_range", F.transform("identifiers", lambda i: F.concat_ws(":", i["scheme"], i["normalized"])).alias("found"))


# Documents with a model in between. Answers stand in tables made of the documents themselves.


def _model(prompts, answer):
    return flows.answers_of(prompts.select("prompt", answer.alias("answer")))


_DOCS = "SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 10 < 4"


def _docs(t):
    return t("orders").where("o_orderkey % 10 < 4").select(F.col("o_orderkey").alias("doc_id"), _text("text ", F.col("o_orderkey")).alias("text"))


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN ['{{"t":"' || doc_id || '"}}'] WHEN 1 THEN ['{{"t":"a"}}', '{{"t":"b"}}'] WHEN 2 THEN ['{{"references":[]}}'] ELSE [] END AS records, CASE k WHEN 3 THEN 'no JSON' END AS error FROM ({_DOCS})""")
def one_step(t):
    docs = _docs(t)
    prompts = docs.withColumn("prompt", _text("Find in <", F.col("text"), ">"))
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, _text('```json\n{"refs": [{"t": "', F.col("doc_id"), '"}]}\n```')).when(k == 1, '[{"t": "a"} {"t": "b"}]').when(k == 2, '{"references": []}').otherwise("sorry")
    return flows.one_step(docs, _model(prompts, answer), "Find in <{{INPUT_TEXT}}>")


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN ['{{"t":"' || doc_id || '"}}', '{{"t":"x"}}'] ELSE [] END AS records, CASE k WHEN 1 THEN 'call failed' WHEN 2 THEN 'no records' END AS error FROM ({_DOCS}) WHERE k < 4 AND k <> 3 UNION ALL SELECT doc_id, [], NULL FROM ({_DOCS}) WHERE k = 3""")
def two_step(t):
    docs, key = _docs(t), F.col("doc_id")
    lines = docs.where("doc_id % 4 <> 1").select(_text("Find: ", F.col("text")).alias("prompt"), F.when(key % 4 == 3, "<start><END>").otherwise(_text("<start>", key, "\n\n  x</END>")).alias("answer"))
    parsing = docs.where("doc_id % 4 IN (0, 2)").select(_text("Parse: ", key, "\nx").alias("prompt"), F.when(key % 4 == 0, _text('{"references": [{"t": "', key, '"}, {"t": "x"}]}')).otherwise('{"refs": []}').alias("answer"))
    nothing = docs.sparkSession.createDataFrame([("Parse: ", "[]")], "prompt string, answer string")
    return flows.two_step(docs, flows.answers_of(lines.unionByName(parsing).unionByName(nothing)), "Find: {{INPUT_TEXT}}", "Parse: {{INPUT_TEXT}}")


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN ['a' || doc_id, 'b', 'c' || doc_id] WHEN 1 THEN ['c' || doc_id] ELSE [] END AS lines, CASE WHEN k < 3 THEN 2 ELSE 0 END::BIGINT AS n_pages, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS n_failed, CASE k WHEN 2 THEN 'every page failed' END AS error FROM ({_DOCS})""")
def lines_by_page(t):
    key = F.col("doc_id")
    docs = _docs(t).withColumn("text", F.when(key % 4 == 3, "").otherwise(_text("p1 ", key, "\n-----\n \n-----\np2 ", key)))
    one = docs.where("doc_id % 4 = 0").select(_text("p1 ", key).alias("prompt"), _text("a", key, "\nb").alias("answer"))
    two = docs.where("doc_id % 4 < 2").select(_text("p2 ", key).alias("prompt"), _text("c", key).alias("answer"))
    return flows.lines_by_page(docs, flows.answers_of(one.unionByName(two)), "{{INPUT_TEXT}}")


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN ['s' || doc_id] WHEN 1 THEN ['w' || doc_id] WHEN 2 THEN ['w' || doc_id] ELSE [] END AS lines, CASE k WHEN 3 THEN 'call failed' END AS error FROM ({_DOCS})""")
def lines_of_sections(t):
    docs, key = _docs(t), F.col("doc_id")
    sections = docs.where("doc_id % 4 < 2").select("doc_id", _text("section ", key).alias("section"))
    by_section = sections.select(F.col("section").alias("prompt"), F.when(key % 4 == 0, _text("s", key)).otherwise("").alias("answer"))
    whole = docs.where("doc_id % 4 IN (1, 2)").select(F.col("text").alias("prompt"), _text("w", key).alias("answer"))
    return flows.lines_of_sections(docs, sections, flows.answers_of(by_section.unionByName(whole)), "{{INPUT_TEXT}}")


@query("""WITH s AS (SELECT v.vec_id, v.vec_id % 25 AS doc_id, v.vec_id // 25 AS chunk, round(max(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 5) q GROUP BY v.vec_id)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, score FROM s QUALIFY score = max(score) OVER (PARTITION BY doc_id)""")
def best_chunks(t):
    chunks = t("embeddings").select((F.col("vec_id") % 25).alias("doc_id"), F.expr("vec_id div 25").alias("chunk"), F.struct("vec_id").alias("key"), "embedding")
    queries = t("embeddings").where("vec_id < 5").select(F.col("embedding").alias("query"))
    scored = locate.max_cosine(chunks.withColumn("k", F.struct("doc_id", "chunk")), queries, "k").withColumn("score", F.round("score", 6))
    top = scored.groupBy("k.doc_id").agg(F.max("score").alias("score"))
    return scored.select("k.*", "score").join(top, ["doc_id", "score"]).select("doc_id", "chunk", "score")


@query()
def semantic_sections(t):
    chunks = t("embeddings").select((F.col("vec_id") % 25).alias("doc_id"), F.expr("vec_id div 25").alias("chunk"), _text("chunk ", F.col("label"), F.when(F.col("label") == 3, " doi isbn press").otherwise("")).alias("text"), F.when(F.col("vec_id") % 25 != 7, F.col("embedding")).alias("vector"))
    return locate.semantic_sections(chunks, t("embeddings").where("vec_id < 20").select(F.col("embedding").alias("query")))


@query("""SELECT o_orderkey AS task_id, CAST(pos AS INTEGER) AS pos, 'r' || pos AS reference, CASE WHEN o_orderkey % 5 < 2 AND pos = 0 THEN '{"t":"' || o_orderkey || '"}' ELSE '{}' END AS record, o_orderkey % 5 >= 2 AND o_orderkey % 5 <> 4 AS failed FROM orders, LATERAL (SELECT unnest(range(2)) AS pos)""")
def realigned_answers(t):
    k = F.col("o_orderkey")
    one = _text('{"t": "', k, '"}')
    answer = F.when(k % 5 == 0, _text('{"references": [', one, "]}")).when(k % 5 == 1, _text("[", one, "]")).when(k % 5 == 2, " ").when(k % 5 == 3, '{"other": 1}').otherwise("{}")
    return flows.realigned(t("orders").select(k.alias("task_id"), F.array(F.lit("r0"), F.lit("r1")).alias("references"), answer.alias("answer")))


# Training data and result rows


def _tags(t):
    k = F.col("p_partkey")
    author = F.when(k % 5 == 4, "Smith and Brown").otherwise("Rossi, G.")
    return t("part").select(k, "p_brand", _text(F.col("p_name"), ", 1999").alias("text"), F.map_from_arrays(
        F.array(F.lit("title"), F.lit("author"), F.when(k % 7 == 0, "abbreviation").otherwise("pagination"), F.lit("year"), F.lit("series")), F.array(F.when(k % 11 == 0, "ab").otherwise(F.col("p_name")), author, F.lit("1-9"), F.lit("*1999."), F.lit("S,"))).alias("tags"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'unparsed_author_string' ELSE 'valid' END AS reason, CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE p_name END AS title, CASE WHEN p_partkey % 5 < 4 THEN 'Rossi' ELSE '' END AS surname, '1999' AS date FROM part""")
def training_records(t):
    rows = _tags(t).select("p_partkey", flows.training_record(F.col("tags"), F.col("text")).alias("r"))
    v = F.try_parse_json("r.json")
    get = lambda path: F.try_variant_get(v, path, "string")
    return rows.select("p_partkey", "r.reason", get("$.full_title").alias("title"), get("$.authors[0].surname").alias("surname"), get("$.publication_date").alias("date"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'has_abbreviation_or_numbered_ref_tag' WHEN p_partkey % 11 = 0 OR length(p_name) < 5 THEN 'missing_or_short_title' ELSE 'valid' END AS reason FROM part) GROUP BY reason""")
def tag_reasons(t):
    return flows.reason_counts(_tags(t), flows.tags_reason(F.col("tags")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE p_name END AS title, 'S,' AS journal, 1999 AS year, CASE WHEN p_partkey % 5 = 4 THEN ['Smith', 'Brown'] ELSE ['Rossi', 'G.'] END AS authors, '*1999' AS date, NULL::INTEGER AS plain_year, CASE WHEN p_partkey % 5 = 4 THEN ['Smith and Brown'] ELSE ['Rossi, G.'] END AS plain_authors FROM part""")
def tagged_references(t):
    rows = _tags(t).select("p_partkey", providers.tagged_reference(F.col("tags")).alias("r"), providers.plain_reference(F.col("tags")).alias("q"))
    return rows.select("p_partkey", "r.title", "r.journal", "r.year", "r.authors", "q.date", F.col("q.year").alias("plain_year"), F.col("q.authors").alias("plain_authors"))


@query("""WITH r AS (SELECT *, p_partkey % 5 < 4 AS ok, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
b AS (SELECT *, CASE WHEN i // 3 = (n - 1) // 3 AND n % 3 > 0 AND n % 3 < 2 AND n > 3 THEN i // 3 - 1 ELSE i // 3 END AS batch FROM r)
SELECT 'single' AS mode, p_brand AS part, p_partkey AS first_key, 1::BIGINT AS n FROM r WHERE ok UNION ALL SELECT 'grouped', p_brand, min(p_partkey), count(*) FROM b GROUP BY p_brand, batch HAVING bool_and(ok)""")
def training_examples(t):
    rows = _tags(t).select("p_partkey", "p_brand", "text", flows.training_record(F.col("tags"), F.col("text")).alias("r")).select("p_partkey", "p_brand", "text", "r.json", "r.reason")
    return flows.training_examples(rows, "p_brand", "p_partkey", 3, 2, "parse").drop("messages")


@query("""SELECT 'a_' || p_partkey AS ref_id, 'a' AS source, p_name AS text FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 7 UNION ALL SELECT 'b_' || s_suppkey, 'b', s_name FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || s_suppkey), s_suppkey) AS r FROM supplier) WHERE r <= 7""")
def sampled_test_set(t):
    return flows.sampled_test_set({"a": t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text")), "b": t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("text"))}, 7)


@query("""SELECT p_partkey AS ref_id, i AS index, CASE WHEN i = 'w' THEN 'W' || p_partkey ELSE 'Not Found' END AS matched_id, CASE WHEN i = 'w' THEN '10.1/' || p_partkey ELSE '' END AS matched_doi, CASE WHEN i = 'w' THEN p_name END AS matched_title, i = 'w' AND CASE p_partkey % 3 WHEN 0 THEN false ELSE p_size >= 25 END AS is_match FROM part, (VALUES ('w'), ('q')) v(i)""")
def linking_rows(t):
    k = F.col("p_partkey")
    one = F.struct(F.create_map(F.lit("w_id"), _text("W", k), F.lit("doi"), _text("10.1/", k)).alias("ids"), F.col("p_name").alias("title"), F.when(F.col("p_size") >= 25, 95.0).otherwise(20.0).alias("similarity"), F.when(k % 3 == 0, False).alias("is_match"))
    return flows.linking_rows(t("part").select(k.alias("ref_id"), F.create_map(F.lit("w"), one).alias("results")), ["w", "q"])


@query("""SELECT p_partkey, 'Day' AS first_author, CASE WHEN p_partkey % 2 = 0 THEN ['doi'] ELSE [] END AS kinds, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE substr('text of ' || p_name, 1, 200) END AS title FROM part""")
def simplified_results(t):
    k = F.col("p_partkey")
    work = providers.work_record(_text('{"id": "W1", "display_name": "x", "authorships": [{"author": {"display_name": "Ann Day"}}], "doi": ', F.when(k % 2 == 0, '"10.1/x"').otherwise("null"), "}"))
    v = F.when(k % 2 == 0, F.try_parse_json(_text('{"title": "', F.col("p_name"), '", "year": "1999"}'))).otherwise(F.try_parse_json(F.lit("{}")))
    rows = t("part").select(k, work.alias("w"), flows.reference_of_row(v, _text("text of ", F.col("p_name"))).alias("ref"))
    simple = providers.simplified(F.col("w"), doi=F.col("w.doi"))
    return rows.select("p_partkey", simple["first_author"].alias("first_author"), F.map_keys(simple["ids"]).alias("kinds"), "ref.title")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN ['new'] ELSE ['old', 'x'] END AS refs, o_orderstatus AS status FROM orders""")
def replaced_references(t):
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.array(F.lit("old"), F.lit("x")).alias("refs"), F.col("o_orderstatus").alias("status"))
    return flows.with_references(docs, docs.where("doc_id % 3 = 0").select("doc_id", F.array(F.lit("new")).alias("refs")), "refs")


@query("""WITH e AS (SELECT l_orderkey AS pub_id, l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_partkey % 2 = 0 AND l_partkey % 100 >= 70 THEN p_partkey END AS target_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT * FROM e WHERE target_id IS NOT NULL UNION ALL SELECT DISTINCT pub_id, ref_id, NULL::BIGINT FROM e WHERE ref_id NOT IN (SELECT ref_id FROM e WHERE target_id IS NOT NULL)""")
def graph_matches(t):
    edges = t("lineitem").select(F.col("l_orderkey").alias("pub_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("target_id"))
    matched, unmatched = flows.graph_matches(edges, t("part").select(F.col("p_partkey").alias("target_id"), ((F.col("p_partkey") % 100) / 100).alias("confidence")))
    return matched.drop("confidence").unionByName(unmatched.withColumn("target_id", F.lit(None).cast("long")))


# Records and statistics


@query("""SELECT o_custkey, CAST(pos AS INTEGER) AS pos, a, CASE WHEN pos < len(ys) THEN ys[pos + 1] END AS b FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS xs, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0) AS ys FROM orders GROUP BY o_custkey), LATERAL (SELECT unnest(xs) AS a, unnest(range(len(xs))) AS pos)""")
def zip_prefix(t):
    lists = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"), F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")))).alias("b"))
    return records.zip_prefix(lists, "a", "b", "o_custkey")


@query("""SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM (SELECT CASE WHEN l_quantity > 25 THEN 'over' WHEN l_quantity < 25 THEN 'under' ELSE 'exact' END AS kind FROM lineitem) GROUP BY kind""")
def extraction_kinds(t):
    return records.value_counts(t("lineitem").select(records.classified(F.col("l_quantity"), F.lit(25)).alias("kind")), "kind")


@query("""SELECT tag, count(*) AS n_records, count(DISTINCT p_brand) AS n_groups FROM (SELECT p_brand, unnest(['title', 'author', CASE WHEN p_partkey % 7 = 0 THEN 'abbreviation' ELSE 'pagination' END, 'year', 'series']) AS tag FROM part) GROUP BY tag""")
def tag_counts(t):
    return records.tag_counts(_tags(t), "tags", "p_brand")


@query("""SELECT floor(n / 5) * 5 AS start, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY 1""")
def reference_histogram(t):
    files = records.with_counts(t("customer").select(F.col("c_custkey").alias("key")), t("orders").select(F.col("o_custkey").alias("key")), "key")
    return records.histogram(files, "n_refs", 5.0).withColumn("start", F.col("start").cast("double"))


@query("""SELECT o_custkey, count(*) AS n_gold, count(*) FILTER (o_orderkey % 9 > 0) AS n_silver, count(*) = count(*) FILTER (o_orderkey % 9 > 0) AS same FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 9 > 0) > 0""")
def same_sizes(t):
    of = lambda df: df.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("refs"))
    return records.same_sizes(of(t("orders")), of(t("orders").where("o_orderkey % 9 > 0")), "o_custkey", "refs")


@query("""SELECT field, count(*) AS n_docs, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, round(avg(f), 4) AS f1 FROM (SELECT 'title' AS field, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END AS r, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END AS f FROM orders
UNION ALL SELECT 'year', 0, 0, 0 FROM orders WHERE o_orderkey % 2 = 0) GROUP BY field""")
def field_means(t):
    k = F.col("o_orderkey")
    of = lambda title, year: F.array(F.create_map(F.lit("title"), F.array(title), F.lit("year"), year))
    gold = of(F.col("o_orderpriority"), F.when(k % 2 == 0, F.array(F.lit("1"))))
    predicted = of(F.when(k % 3 == 0, F.upper("o_orderpriority")).otherwise("?"), F.lit(None).cast("array<string>"))
    return evaluate.field_means(evaluate.align_records(t("orders").select(k.alias("doc_id"), gold.alias("gold"), predicted.alias("predicted")), ["title", "year", "pages"]))


@query("""WITH w AS (SELECT p_partkey, p_brand AS family, 1990 + p_size AS year, lower(p_name || ' ' || p_type) AS title FROM part),
k AS (SELECT *, list_filter(string_split(substr(title, 1, 50), ' '), lambda x: length(x) > 3) AS ws FROM w WHERE p_partkey % 10 = 0)
SELECT ref_id, rec_id FROM (SELECT k.p_partkey AS ref_id, w.p_partkey AS rec_id, row_number() OVER (PARTITION BY k.p_partkey ORDER BY w.p_partkey) AS r FROM k JOIN w ON k.family = w.family AND abs(k.year - w.year) <= 1 AND regexp_matches(w.title, CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:4], '.*') ELSE substr(k.title, 1, 50) END)) WHERE r <= 20""")
def author_title_year(t):
    index = t("part").select(F.col("p_partkey").alias("rec_id"), F.col("p_brand").alias("family"), (1990 + F.col("p_size")).alias("year"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return records.author_title_year_candidates(index.where("rec_id % 10 = 0").withColumnRenamed("rec_id", "ref_id"), index)


@query("""SELECT o_orderkey, c_mktsegment AS segment, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS parity FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def optional_lookups(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    with_segment = records.with_optional(rows, "key", segment=t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")))
    even = t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("even").alias("value"))
    return records.with_optional(with_segment.drop("key"), "o_orderkey", parity=even)


@query("""WITH c AS (SELECT a.p_partkey AS ref_id, b.p_partkey AS rec_id, 1 AS pass, 1 - abs(a.p_size - b.p_size) / 50.0 AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey <> b.p_partkey UNION ALL
SELECT a.p_partkey, b.p_partkey, 2, 1 - abs(a.p_size - b.p_size) / 50.0 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY ref_id, pass ORDER BY score DESC, rec_id)),
d AS (SELECT ref_id, rec_id, pass, score, CASE WHEN score >= 0.9 AND (second IS NULL OR score - second >= 0.02) THEN 'accept' WHEN score >= 0.5 THEN 'review' ELSE 'none' END AS decision FROM r WHERE k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY CASE decision WHEN 'accept' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, pass) AS k FROM d)
SELECT ref_id, rec_id, pass, round(score, 6)::DOUBLE AS score, decision FROM o WHERE k = 1""")
def linking_passes(t):
    rows = t("part").select(F.col("p_partkey").alias("ref_id"), "p_brand", "p_name", "p_size")
    index = rows.withColumnRenamed("ref_id", "rec_id")
    score = F.round(1 - F.abs(F.col("p_size") - F.col("rec_p_size")) / 50.0, 9)
    return records.multi_pass(rows, index, [["p_brand", "p_name"], ["p_name"]], score, 0.9, 0.5, 0.02, of=["p_size"], apart=True).withColumn("score", F.round("score", 6))


# Jobs


def _events(t):
    return t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts", "event_id")


@query("""WITH s AS (SELECT user_id AS job, max(ts) AS last_ts, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT job, CASE last WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, last = 'purchase' AND epoch(now) - epoch(last_ts) < 86400 * 2 AS has_result FROM s, m WHERE epoch(now) - epoch(last_ts) < 86400 * 5""")
def live_jobs(t):
    events = _events(t)
    state = jobs.job_state(events, ("error",), ("purchase",)).withColumn("last_ts", F.col("last_ts").cast("timestamp"))
    now = events.agg(F.max("ts").cast("timestamp").alias("now"))  # one row
    # whole seconds, as the jobs' times are
    return jobs.live(state.crossJoin(F.broadcast(now)), F.col("now"), 86400 * 5, 86400 * 2).select("job", "status", "has_result")


@query("""SELECT DISTINCT user_id AS job, event_type AS stage, CASE event_type WHEN 'click' THEN 'default' WHEN 'view' THEN 'llm-tasks' WHEN 'error' THEN 'linking' END AS queue FROM events WHERE user_id % 3 > 0 OR event_type <> 'click'""")
def queued_stages(t):
    tasks = _events(t).select("job", "stage").distinct()
    kinds = F.create_map(*(F.lit(x) for x in ("click", "extract_text", "view", "parse_references", "error", "link")))
    routed = jobs.queued(tasks.withColumn("kind", F.element_at(kinds, F.col("stage"))).withColumn("parser", F.when(F.col("stage") == "view", "llm")))
    return jobs.unfinished(routed, tasks.where("job % 3 = 0 AND stage = 'click'")).select("job", "stage", "queue")


@query("""SELECT c_custkey AS job, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'processing' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'lost' END AS error FROM customer""")
def reconciled_jobs(t):
    rows = t("customer").select(F.col("c_custkey").alias("job"), F.lit("processing").alias("status"))
    return jobs.reconciled(rows, rows.where("job % 4 = 0").select("job", F.lit("failed").alias("status"), F.lit("lost").alias("error")))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, substr(p_name, 1, 4) AS start, least(0.1, 0.02 * (p_size % 8))::DOUBLE AS bonus FROM part""")
def text_facts(t):
    words = F.element_at(F.array(F.lit("the house of the world and it is"), F.lit("das ist der Mann und die Frau"), F.lit("le chat est dans la maison et les")), (F.col("p_size") % 3 + 1).cast("int"))
    return t("part").select("p_partkey", text.language(words).alias("lang"), text.capped(F.col("p_name"), 4).alias("start"), F.round(text.lexical_bonus(F.repeat(F.lit("isbn "), (F.col("p_size") % 8).cast("int"))), 6).alias("bonus"))
