"""Queries over records: answers of models, TEI, matching, evaluation by field, sections by heading, sets and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import ids, jsontext, matching, text
from refloom.operators import evaluate, locate, records
from refloom.plans.catalog import query
from refloom.sources import files, providers, tei


def _quoted(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


# Answers of models


@query("""SELECT p_partkey, p_name AS title, p_size AS size FROM part""")
def json_repair(t):
    n, s, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    shown = (
        F.when(k == 0, _quoted('```json\n{"title": "', n, '", "size": ', s, ",}\n```")).when(k == 1, _quoted("{'title': '", n, "', 'size': ", s, "}")).when(k == 2, _quoted('{title: "', n, '", size: ', s, "}"))
        .when(k == 3, _quoted('{"title": "', n, '", "size": ', s)).when(k == 4, _quoted('Here it is: {"title": "', n, '"\n "size": ', s, "} done")).otherwise(_quoted('{"ok": True, "title": "', n, '", "x": None, "size": ', s, "}"))
    )
    v = jsontext.parsed(shown)
    return t("part").select("p_partkey", F.try_variant_get(v, "$.title", "string").alias("title"), F.try_variant_get(v, "$.size", "int").alias("size"))


@query("""SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN pos = 0 THEN p_name ELSE p_type END AS title FROM part, LATERAL (SELECT unnest(range(CASE WHEN p_partkey % 4 >= 2 THEN 1 ELSE 2 END)) AS pos) WHERE p_partkey % 4 <> 3""")
def response_records(t):
    one, two, k = _quoted('{"title": "', F.col("p_name"), '"}'), _quoted('{"title": "', F.col("p_type"), '"}'), F.col("p_partkey") % 4
    shown = F.when(k == 0, _quoted("[", one, " ", two, "]")).when(k == 1, _quoted('{"refs": [', one, ", ", two, "]}")).when(k == 2, one).otherwise(F.lit("no answer"))
    return t("part").select("p_partkey", F.posexplode(jsontext.response_records(shown)).alias("pos", "r")).select("p_partkey", "pos", F.try_variant_get("r", "$.title", "string").alias("title"))


@query("""SELECT p_partkey, 'Find in <' || p_name || '>: ' || p_type AS prompt, '[{"role":"system","content":"parse"},{"role":"user","content":"' || p_name || '"},{"role":"assistant","content":"' || p_type || '"}]' AS chat FROM part""")
def prompts(t):
    return t("part").select("p_partkey", text.filled_prompt(F.lit("Find in <{{INPUT_TEXT}}>: {{EXAMPLES}}"), input_text=F.col("p_name"), examples=F.col("p_type")).alias("prompt"), text.chat(F.lit("parse"), F.col("p_name"), F.col("p_type")).alias("chat"))


# Sources and sinks


@query("""SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, s_name || ' & <sons>' AS title, ['Given ' || s_suppkey, 'Only'] AS authors, 'Journal' AS journal, '10.1000/' || s_suppkey AS doi, CAST(s_suppkey AS VARCHAR) || '-' || CAST(s_suppkey + 9 AS VARCHAR) AS pages, '2001' AS date FROM supplier""")
def tei_round_trip(t):
    key = F.col("s_suppkey").cast("string")
    record = tei.record_xml(
        F.concat("s_name", F.lit(" & <sons>")), F.array(F.concat(key, F.lit(", Given")), F.lit("Only")), F.lit(None).cast("string"), F.lit("Journal"), F.lit("Press"), F.lit("Rome"), F.lit("2001"), F.lit("7"),
        F.concat(key, F.lit("-"), (F.col("s_suppkey") + 9).cast("string")), F.concat(F.lit("10.1000/"), key),
    )
    docs = t("supplier").groupBy("s_nationkey").agg(tei.document_xml(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", record.alias("x")))), lambda r: r["x"])).alias("xml"))
    return tei.parse(docs).select("s_nationkey", "pos", "title", "authors", "journal", F.get("identifiers", F.lit(0))["value"].alias("doi"), "pages", "date")


@query("""SELECT o_orderkey, 'Order ' || o_orderkey AS title, ['Ann', 'Bo'] AS authors, year(o_orderdate) AS year, '1-9' AS pages, CASE WHEN o_orderkey % 2 = 0 THEN '10.1000/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 2 = 0 THEN 'W' || o_orderkey ELSE 'br/' || o_orderkey END AS provider_id FROM orders""")
def provider_records(t):
    k, y = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    work = _quoted('{"id": "https://host/W', k, '", "doi": "https://doi.org/10.1000/', k, '", "display_name": "Order ', k, '", "publication_year": ', y, ', "authorships": [{"author": {"display_name": "Ann"}}, {"author": {"display_name": "Bo"}}], "biblio": {"first_page": "1", "last_page": "9"}}')
    meta = _quoted('{"id": "omid:br/', k, '", "title": "Order ', k, '", "author": "Ann [orcid:1]; Bo", "pub_date": "', y, '-01", "venue": "J [issn:1]", "page": "1-9"}')
    r = F.when(F.col("o_orderkey") % 2 == 0, providers.work_record(work)).otherwise(providers.metadata_record(meta))
    return t("orders").select("o_orderkey", r.alias("r")).select("o_orderkey", *(f"r.{c}" for c in ("title", "authors", "year", "pages", "doi", "provider_id")))


@query("""SELECT user_id, max(CASE WHEN k = 0 THEN 'Group ' || event_id || ' - x' END) OVER (PARTITION BY user_id, g) AS category, event_id, 'k_' || event_id AS key, event_type AS value FROM (SELECT *, event_id % 4 AS k, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) QUALIFY k <> 0""")
def listed_entries(t):
    e = F.col("event_id").cast("string")
    shown = F.when(F.col("event_id") % 4 == 0, _quoted("Group ", e, " - x")).otherwise(_quoted("- k_", e, ": ", F.col("event_type")))
    return files.listed_entries(t("events").select("user_id", "event_id", shown.alias("t")), "user_id", "event_id", "t")


@query("""SELECT user_id, span, event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS text FROM (SELECT *, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS span FROM events) WHERE event_id % 4 <> 3 AND span > 0 GROUP BY ALL""")
def tagged_spans(t):
    tag = F.element_at(F.array(F.lit("B-r"), F.lit("i-r"), F.lit("e-r"), F.lit("o")), (F.col("event_id") % 4 + 1).cast("int"))
    return files.tagged_spans(t("events").select("user_id", "event_id", F.col("event_id").cast("string").alias("word"), tag.alias("tag"), "event_type"), "user_id", "event_id", "word", "tag", "event_type")


@query("""SELECT p_partkey, p_name || ', (' || p_brand || ').' AS shown, CASE p_partkey % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'doi' ELSE 'unknown' END AS source, p_brand || '/' || p_partkey AS tail, 'Ann, Bo. ' || p_name || '. 1999. pp. 1-9' AS display FROM part""")
def display_strings(t):
    k = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, _quoted("ab_", k)).when(F.col("p_partkey") % 3 == 1, _quoted("10.12_", k)).otherwise(k)
    nothing = F.lit(None).cast("string")
    return t("part").select(
        "p_partkey", text.source_of_id(source, ["ab", "cd"]).alias("source"), text.path_tail(_quoted("https://host/x/", F.col("p_brand"), "/", k), 2).alias("tail"),
        F.replace(files.detokenized(F.array("p_name", F.lit(","), F.lit("("), "p_brand", F.lit(")"), F.lit("."))), F.lit("( "), F.lit("(")).alias("shown"),
        text.display_string(F.array(F.lit("Ann"), F.lit("Bo")), F.col("p_name"), nothing, F.lit("1999"), nothing, F.lit("1-9")).alias("display"),
    )


# Matching


@query("""SELECT a.p_partkey, 50 + CASE WHEN a.p_size % 3 = 0 THEN 20 WHEN a.p_size % 3 = 1 THEN 15 ELSE 0 END + CASE WHEN a.p_size % 2 = 0 THEN 15 ELSE 0 END + 15 AS score FROM part a""")
def matching_score(t):
    y, v = F.lit(1990), F.col("p_size") % 2
    similarity = matching.title_similarity(F.col("p_name"), F.concat(F.upper("p_name"), F.lit(".")))
    return t("part").select("p_partkey", matching.matching_score(similarity, (y, y + F.col("p_size") % 3), (F.lit(0), v), (F.lit("0012-19"), F.lit("12"))).alias("score"))


@query()
def title_similarity(t):
    a, b = t("part").alias("a"), t("part").alias("b")
    near = a.join(b, F.col("a.p_partkey") + 1 == F.col("b.p_partkey"))
    s = matching.title_similarity(F.col("a.p_name"), F.col("b.p_name"))
    return near.select(F.col("a.p_partkey").alias("p_partkey"), s.alias("similarity")).withColumn("accepted", matching.accepted(F.col("similarity"), F.lit(None).cast("double"), (F.lit(1999), F.lit(2000))))


@query("""SELECT a.p_partkey, round(0.55 * least(1.0, len(list_intersect(a.q, b.q)) / greatest(3, len(a.q))::DOUBLE) + CASE abs(a.p_size - b.p_size) WHEN 0 THEN 0.15 WHEN 1 THEN 0.09 ELSE 0 END + 0.1, 3) AS score
FROM (SELECT *, list_distinct(string_split(p_name, ' ')) AS q FROM part) a JOIN (SELECT *, list_distinct(string_split(p_name, ' ')) AS q FROM part) b ON a.p_partkey + 7 = b.p_partkey""")
def candidate_score(t):
    from refloom.functions.similarity import token_overlap

    a, b = t("part").alias("a"), t("part").alias("b")
    overlap = token_overlap(F.col("a.p_name"), F.col("b.p_name"))
    return a.join(b, F.col("a.p_partkey") + 7 == F.col("b.p_partkey")).select("a.p_partkey", matching.candidate_score(overlap, F.col("a.p_size") - F.col("b.p_size"), F.lit(0.5)).alias("score"))


@query("""SELECT a.o_orderkey, b.c_custkey FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey""")
def identifier_lookup(t):
    refs = t("orders").select("o_orderkey", ids.parse_identifier(F.concat(F.lit("https://doi.org/10.1000/"), "o_custkey"), scheme=F.lit("DOI")).alias("i")).select("o_orderkey", "i.scheme", "i.normalized")
    index = t("customer").select("c_custkey", ids.parse_identifier(F.concat(F.lit("doi: 10.1000/"), "c_custkey")).alias("i")).select("c_custkey", "i.scheme", "i.normalized")
    return refs.join(index, ["scheme", "normalized"]).select("o_orderkey", "c_custkey")


@query(r"""WITH w AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS title FROM part),
q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN title WHEN 1 THEN substr(title, 3) ELSE substr(title, 1, 5) END AS title FROM w WHERE p_partkey % 20 = 0),
l AS (SELECT p_partkey, title, list_filter(string_split(substr(title, 1, 50), ' '), lambda x: length(x) > 3) AS ws FROM q),
k AS (SELECT p_partkey, CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:4], '.*') ELSE substr(title, 1, 50) END AS pattern FROM l)
SELECT ref_id, rec_id FROM (SELECT k.p_partkey AS ref_id, w.p_partkey AS rec_id, row_number() OVER (PARTITION BY k.p_partkey ORDER BY w.p_partkey) AS r FROM k JOIN w ON regexp_matches(w.title, pattern)) WHERE r <= 20""")
def title_pattern_candidates(t):
    index = t("part").select(F.col("p_partkey").alias("rec_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    k = F.col("rec_id") % 3
    asked = F.when(k == 0, F.col("title")).when(k == 1, F.expr("substring(title, 3)")).otherwise(F.substring("title", 1, 5))
    return records.title_pattern_candidates(index.where("rec_id % 20 = 0").select(F.col("rec_id").alias("ref_id"), asked.alias("title")), index)


# Sections


@query("""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line, '## References' || chr(10) || lang || chr(10) || '### Sub' || chr(10) || source AS section FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def heading_section(t):
    docs = t("documents").select("doc_id", F.concat("text", F.lit("\n## References\n"), "lang", F.lit("\n### Sub\n"), "source", F.lit("\n# End\nrest")).alias("text"))
    return locate.heading_section(docs)


@query(r"""WITH s AS (SELECT doc_id, least(len(regexp_extract_all(lower(l), 'references|bibliography|works cited|literature|doi|isbn|issn|vol\.|no\.|pp\.|et al|ed\.|eds\.|press|journal')), 5) AS score FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s),
c AS (SELECT doc_id, count(*) // 2 AS half, count(*) FILTER (score * 100 >= best * 70) AS a, count(*) FILTER (score * 100 >= best * 50) AS low, count(*) FILTER (score * 100 >= best * 85) AS high FROM b WHERE best > 0 GROUP BY doc_id)
SELECT doc_id, least(half, CASE WHEN a < 2 THEN low WHEN a > half THEN high ELSE a END) AS n_chosen, CASE WHEN a < 2 THEN 50 WHEN a > half THEN 85 ELSE 70 END AS threshold FROM c""")
def adaptive_threshold(t):
    return locate.adaptive_threshold(t("documents"))


# Evaluation

_ORDER_FIELDS = ["title", "authors", "year"]


@query("""SELECT field, matches, preds, labels, round(CASE WHEN preds > 0 THEN matches / preds ELSE 0 END, 4) AS precision, round(CASE WHEN labels > 0 THEN matches / labels ELSE 0 END, 4) AS recall, round(CASE WHEN preds + labels > 0 THEN 2 * matches / (preds + labels) ELSE 0 END, 4) AS f1 FROM (
SELECT 'title' AS field, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS matches, count(*) AS preds, count(*) AS labels FROM orders UNION ALL
SELECT 'authors', sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE, count(*), 2 * count(*) FROM orders UNION ALL SELECT 'year', 0::DOUBLE, 0, count(*) FROM orders)""")
def per_field_prf(t):
    k = F.col("o_orderkey")
    of = lambda title, authors, year: F.array(F.create_map(F.lit("title"), F.array(title), F.lit("authors"), authors, F.lit("year"), year))
    gold = of(F.col("o_orderpriority"), F.array("o_orderstatus", F.lit("Bo")), F.array(F.col("o_orderdate").cast("string")))
    predicted = of(F.when(k % 3 == 0, F.upper("o_orderpriority")).otherwise("?"), F.array(F.when(k % 5 == 0, F.lit("bo ")).otherwise("?")), F.lit(None).cast("array<string>"))
    return evaluate.per_field(evaluate.align_records(t("orders").select(k.alias("doc_id"), gold.alias("gold"), predicted.alias("predicted")), _ORDER_FIELDS))


@query()
def evaluator_records(t):
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    record = lambda x: F.create_map(F.lit("title"), F.array(x["l_returnflag"]), F.lit("year"), F.array(x["l_linenumber"].cast("string")))
    both = lists.select("doc_id", F.transform("x", record).alias("gold"), F.transform(F.filter("x", lambda x: x["l_linenumber"] % 2 == 1), record).alias("predicted"))
    return evaluate.overall(evaluate.align_records(both, ["title", "year"], "fuzzy"))


@query("""SELECT lang, round(100.0 * count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) / count(DISTINCT doc_id), 2) AS error_rate, count(DISTINCT doc_id) AS tasks FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def error_rates(t):
    failed = F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id")))
    return t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.round(100.0 * failed / F.count_distinct("doc_id"), 2).alias("error_rate"), F.count_distinct("doc_id").alias("tasks"))


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS std FROM orders GROUP BY ALL""")
def mean_std_by_category(t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 2).alias("std"))


@query("""SELECT kind, count(*) AS n, round(avg(length(text)), 2) AS mean_chars, max(length(text)) AS max_chars FROM (SELECT text, CASE WHEN contains(lower(text), 'summar') THEN 'summary' WHEN contains(lower(text), '?') THEN 'question' ELSE 'other' END AS kind FROM conversations) GROUP BY kind""")
def prompt_classes(t):
    low = F.lower("text")
    kind = F.when(F.contains(low, F.lit("summar")), "summary").when(F.contains(low, F.lit("?")), "question").otherwise("other")
    return t("conversations").where("text IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("max_chars"))


@query("""SELECT CASE WHEN o_orderpriority IS NULL THEN 'no_title' WHEN o_totalprice < 1000 THEN 'parse_error' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY ALL""")
def drop_reasons(t):
    reason = F.when(F.col("o_orderpriority").isNull(), "no_title").when(F.col("o_totalprice") < 1000, "parse_error").otherwise("kept")
    return t("orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Joins, batches and sets


@query("""SELECT 'customer' AS side, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'order', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def two_way_difference(t):
    customers, orders = t("customer"), t("orders")
    same = F.col("c_custkey") == F.col("o_custkey")
    return customers.join(orders, same, "left_anti").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id")).unionByName(orders.join(customers, same, "left_anti").select(F.lit("order").alias("side"), F.col("o_orderkey").alias("id")))


@query("""SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def first_match_join(t):
    return records.first_match(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order")), "c_custkey", "first_order")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN batch = (n - 1) // 5 AND n % 5 IN (1, 2) AND n > 5 THEN batch - 1 ELSE batch END AS batch FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS batch, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def merged_batches(t):
    return records.merged_batches(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5, 3)


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.25) AS first_part FROM documents""")
def ratio_split(t):
    return records.ratio_split(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.25).select("doc_id", "first_part")


@query("""SELECT l_orderkey, list(l_returnflag ORDER BY coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END, 999), l_linenumber, l_returnflag) AS names FROM lineitem GROUP BY l_orderkey""")
def ordered_names(t):
    rows = t("lineitem").withColumn("ordinal", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")))
    return records.ordered_names(rows, "l_orderkey", "ordinal", "l_linenumber", "l_returnflag")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY user_id, s""")
def session_events(t):
    timed = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
