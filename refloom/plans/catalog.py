"""Queries by name, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.functions import ids, similarity, text
from refloom.operators import evaluate, locate, records
from refloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Scalar functions. Titles are part names with signs added, authors supplier names turned round.


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name || ' (' || p_brand || '): '  || p_type || '!?.'), '[.!?]+$', ''), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM part""".replace("\\\\", "\\"))
def normalize_title(t):
    return t("part").select("p_partkey", text.normalize_title(F.concat(F.lit("The "), "p_name", F.lit(" ("), "p_brand", F.lit("): "), "p_type", F.lit("!?."))).alias("title"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN nullif(trim(split_part(s_name, '#', 2)), '') ELSE nullif(trim(split_part(s_name, '#', 1)), '') END AS family FROM supplier""")
def family_name(t):
    name, number = F.split_part("s_name", F.lit("#"), F.lit(1)), F.split_part("s_name", F.lit("#"), F.lit(2))
    shown = F.when(F.col("s_suppkey") % 2 == 0, F.concat(number, F.lit(", "), name)).otherwise(F.concat(number, F.lit("  "), name))
    return t("supplier").select("s_suppkey", text.family_name(shown).alias("family"))


@query("""SELECT o_orderkey, year(o_orderdate) AS matching, year(o_orderdate) AS record, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS stamp FROM orders""")
def extract_year(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("+"), day)).otherwise(F.concat(F.lit("("), day, F.lit(")")))
    return t("orders").select("o_orderkey", text.matching_year(shown).alias("matching"), text.first_year(shown, text.RECORD_YEAR).alias("record"), text.first_year(shown, text.STAMP_YEAR).alias("stamp"))


@query("""SELECT p_partkey, upper(p_name) AS name, 'SMITH, J' AS author, ['Smith', 'Jones', 'Brown ' || p_size] AS authors, 'A & B <' || p_size || '>' AS plain, '1999' AS date FROM part""")
def canonical_fields(t):
    return t("part").select(
        "p_partkey", text.canonical_text(F.concat(F.lit("  "), "p_name", F.lit(".."))).alias("name"), text.canonical_author(F.lit("[Smith,  J]")).alias("author"),
        text.split_authors(F.concat(F.lit("Smith; Jones and Brown "), "p_size", F.lit(" et al"))).alias("authors"), text.unescaped(F.concat(F.lit("A &amp; B &lt;"), "p_size", F.lit("&gt;"))).alias("plain"), text.clean_date(F.lit("*1999..")).alias("date"),
    )


@query("""SELECT p_partkey, concat_ws(' | ', p_name, lower(replace(p_brand, '#', '')), CAST(1900 + p_size AS VARCHAR), lower(p_type), CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 9 AS VARCHAR)) AS record FROM part""")
def reference_string(t):
    pages = F.concat(F.lit("pp. "), "p_size", F.lit("-"), F.col("p_size") + 9)
    return t("part").select("p_partkey", text.record_string(F.col("p_name"), F.col("p_brand"), F.col("p_size") + 1900, F.col("p_type"), pages).alias("record"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), 'references|bibliography|works cited|literature|doi|isbn|issn|vol\.|no\.|pp\.|et al|ed\.|eds\.|press|journal')) AS hits FROM documents""")
def lexical_bonus(t):
    return t("documents").select("doc_id", F.coalesce(text.cue_hits(F.col("text")), F.lit(0)).cast("long").alias("hits"))


@query("""SELECT conv_id, turn, pos, page FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS page, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations WHERE text <> '')""")
def split_pages(t):
    pages = text.split_pages(F.replace("text", F.lit("\n"), F.lit("\n-----\n")))
    return t("conversations").select("conv_id", "turn", F.posexplode(pages).alias("pos", "page")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents""")
def response_lines(t):
    return t("documents").select("doc_id", text.response_lines(F.concat(F.lit("<start>"), "text", F.lit("</END>"))).alias("lines"))


@query("""SELECT p_partkey, scheme, value, normalized FROM (SELECT p_partkey, p_partkey % 4 AS k, 1000 + p_partkey AS n FROM part),
LATERAL (SELECT CASE k WHEN 0 THEN 'doi' WHEN 1 THEN 'doi' WHEN 2 THEN 'wikidata' ELSE 'issn' END AS scheme,
CASE k WHEN 0 THEN '10.' || n || '/ab' WHEN 1 THEN '10.' || n || '/ab' WHEN 2 THEN 'q' || n ELSE '1234567x' END AS value,
CASE k WHEN 0 THEN '10.' || n || '/ab' WHEN 1 THEN '10.' || n || '/ab' WHEN 2 THEN 'Q' || n ELSE '1234-567X' END AS normalized)""")
def parse_identifiers(t):
    n, k = F.col("p_partkey") + 1000, F.col("p_partkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("DOI: 10."), n, F.lit("/ab"))).when(k == 1, F.concat(F.lit("10."), n, F.lit("/ab"))).when(k == 2, F.concat(F.lit("q"), n)).otherwise(F.lit("ISSN: 1234567x"))
    return t("part").select("p_partkey", ids.parse_identifier(shown).alias("i")).select("p_partkey", "i.*")


@query("""SELECT p_partkey, '10.' || (1000 + p_partkey) || '/x(1' AS doi, 'doi:10.' || (1000 + p_partkey) AS service FROM part""")
def doi_from_text(t):
    n = F.col("p_partkey") + 1000
    return t("part").select("p_partkey", ids.doi_in(F.concat(F.lit("see 10."), n, F.lit("/x(1).,"))).alias("doi"), ids.provider_id(F.concat(F.lit("10."), n)).alias("service"))


# Similarity


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) AS similarity FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey""")
def match_levenshtein(t):
    a, b = t("part").alias("a"), t("part").alias("b")
    return a.join(b, F.col("a.p_partkey") + 1 == F.col("b.p_partkey")).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), similarity.levenshtein_similarity(F.col("a.p_name"), F.col("b.p_name")).alias("similarity"))


@query()
def ratio_indel(t):
    a, b = t("part").alias("a"), t("part").alias("b")
    return a.join(b, F.col("a.p_partkey") + 1 == F.col("b.p_partkey")).select(F.col("a.p_partkey").alias("a"), similarity.ratio(F.col("a.p_name"), F.col("b.p_name")).alias("ratio"))


@query("""SELECT v.vec_id, round(max(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 20) q GROUP BY v.vec_id""")
def semantic_max_cosine(t):
    queries = t("embeddings").where("vec_id < 20").select(F.col("embedding").alias("query"))
    return locate.max_cosine(t("embeddings"), queries).withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS q FROM part) SELECT a.p_partkey, least(1.0, len(list_intersect(a.q, b.q)) / greatest(3, len(a.q))::DOUBLE) AS overlap FROM w a JOIN w b ON a.p_partkey + 7 = b.p_partkey""")
def token_overlap_score(t):
    a, b = t("part").alias("a"), t("part").alias("b")
    return a.join(b, F.col("a.p_partkey") + 7 == F.col("b.p_partkey")).select(F.col("a.p_partkey"), similarity.token_overlap(F.col("a.p_name"), F.col("b.p_name")).alias("overlap"))


# Section search

_LINES = r"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
scored AS (SELECT *, least(len(regexp_extract_all(lower(text), 'references|bibliography|works cited|literature|doi|isbn|issn|vol\.|no\.|pp\.|et al|ed\.|eds\.|press|journal')), 5) AS score FROM lines),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS after FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, line)),
limits AS (SELECT doc_id, max(score) AS best, arg_max({'d': score - after, 'a': after}, (score - after) * 100000000 - rank) AS top FROM ranked GROUP BY doc_id),
t AS (SELECT doc_id, best, CASE WHEN top.d > 2 THEN top.a * 10 ELSE best * 7 END AS threshold FROM limits)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(threshold AS INTEGER) AS threshold, CAST(best AS INTEGER) AS best FROM t")
def gap_threshold(t):
    return locate.gap_threshold(t("documents")).select("doc_id", F.col("threshold").cast("int").alias("threshold"), F.col("best").cast("int").alias("best"))


@query(f"""WITH {_LINES}, p AS (SELECT s.*, best, threshold, min(CASE WHEN score = best THEN line END) OVER (PARTITION BY s.doc_id) AS bl, CAST(score < best - 1 AS INTEGER) AS broken FROM scored s JOIN t ON s.doc_id = t.doc_id WHERE best > 0),
g AS (SELECT *, sum(CASE WHEN line >= bl THEN broken ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS a, sum(CASE WHEN line <= bl THEN broken ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line DESC) AS b FROM p)
SELECT doc_id, count(*) AS n_lines, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line, string_agg(text, chr(10) ORDER BY line) AS section FROM g WHERE score * 10 >= threshold OR (line >= bl AND a = 0) OR (line < bl AND b = 0) GROUP BY doc_id""")
def locate_sections(t):
    return locate.locate_sections(t("documents"))


# Joins


@query("""SELECT o_orderkey, count(l_orderkey) AS n_preds, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def left_predictions(t):
    joined = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_preds"), F.count_if(F.col("l_returnflag") == "R").alias("n_bad"))


@query("""SELECT o_orderpriority, coalesce(c_mktsegment, 'UNKNOWN') AS segment, round(avg(o_totalprice), 2) AS mean_price, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def left_metrics_by_group(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("o_orderpriority", F.coalesce("c_mktsegment", F.lit("UNKNOWN")).alias("segment")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_by_ids(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def skip_ids_anti(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT conv_id, pos, a, b FROM (SELECT conv_id, unnest(range(len(x))) AS pos, unnest(x) AS a, unnest(y) AS b FROM (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS x, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS y FROM conversations GROUP BY conv_id) WHERE len(x) = len(y))""")
def positional_zip_join(t):
    pick = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    lists = t("conversations").groupBy("conv_id").agg(pick("user").alias("a"), pick("assistant").alias("b"))
    return records.zip_lists(lists, "a", "b", "conv_id").withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT a.o_orderkey AS ref, b.o_orderkey AS rec FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(year(a.o_orderdate) - year(b.o_orderdate)) <= 1 WHERE a.o_orderkey % 20 = 0""")
def author_year_range_join(t):
    rows = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    refs = rows.where("o_orderkey % 20 = 0").withColumnRenamed("o_orderkey", "ref")
    return records.year_range_candidates(refs, rows.withColumnRenamed("o_orderkey", "rec"), "o_custkey").select("ref", "rec")


@query("""SELECT DISTINCT n_name AS label, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def label_lookup_join(t):
    return t("supplier").select("s_nationkey").distinct().join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"), "s_nationkey")


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS word FROM part),
o AS (SELECT a.p_partkey AS ref_id, b.p_partkey AS rec_id, count(*) AS overlap FROM w a JOIN w b USING (word) WHERE a.p_partkey % 20 = 0 GROUP BY ALL)
SELECT ref_id, rec_id, overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY overlap DESC, rec_id) AS rank FROM o) WHERE rank <= 5""")
def topk_candidates(t):
    index = t("part").select(F.col("p_partkey").alias("rec_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return records.token_candidates(index.withColumnRenamed("rec_id", "ref_id").where("ref_id % 20 = 0"), index, 5)


# Windows and samples


@query("""SELECT p_partkey, p_brand, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def dedup_keep_best(t):
    rows = t("part").withColumn("doi", F.lit("")).withColumn("title", F.concat_ws("|", "p_brand", "p_name"))
    return records.keep_best(rows, "doi", "title", "p_retailprice", "p_partkey").select("p_partkey", "p_brand", "p_name", "p_retailprice")


@query("""WITH s AS (SELECT o_custkey, 1 AS pass, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'),
m AS (SELECT *, min(pass) OVER (PARTITION BY o_custkey) AS first FROM s) SELECT o_custkey, pass, count(*) AS n FROM m WHERE pass = first GROUP BY ALL""")
def strategy_fallback(t):
    passes = [t("orders").where(F.col("o_orderpriority") == p).select("o_custkey", "o_orderkey") for p in ("1-URGENT", "2-HIGH")]
    both = records.first_strategy(passes, "o_custkey")
    return both.groupBy("o_custkey", "pass").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, lang, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 10""")
def stratified_sample(t):
    return records.stratified_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", n=10)


@query("""SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE place <= greatest(1, floor(n * 0.2))""")
def proportional_sample(t):
    return records.stratified_sample(t("documents").select("doc_id", "source"), "source", "doc_id", share=0.2, seed=7)


@query("""SELECT c_custkey, c_nationkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 10) AS BIGINT) AS batch FROM customer""")
def group_batches(t):
    return records.batches(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 10)


@query("""SELECT p_partkey, CASE WHEN u < 40 THEN 'a' WHEN u < 65 THEN 'b' WHEN u < 90 THEN 'c' WHEN u < 95 THEN 'd' ELSE 'e' END AS pick FROM (SELECT p_partkey, (p_partkey * 7919) % 100 AS u FROM part)""")
def weighted_pick(t):
    u = ((F.col("p_partkey") * 7919) % 100 + 0.5) / 100
    return t("part").select("p_partkey", records.weighted_pick(u, {"a": 40, "b": 25, "c": 25, "d": 5, "e": 5}).alias("pick"))


@query("""SELECT lang, source FROM documents INTERSECT SELECT lang, source FROM documents WHERE n_chars > 2000""")
def set_operations(t):
    pairs = t("documents").select("lang", "source")
    return pairs.intersect(t("documents").where("n_chars > 2000").select("lang", "source"))


# Evaluation and statistics

_PRED = "CASE WHEN n_chars > 500 THEN 1 ELSE 0 END"


@query(f"""SELECT lang, matches, preds, labels, round(CASE WHEN preds > 0 THEN matches / preds ELSE 0 END, 4) AS precision, round(CASE WHEN labels > 0 THEN matches / labels ELSE 0 END, 4) AS recall, round(CASE WHEN preds + labels > 0 THEN 2 * matches / (preds + labels) ELSE 0 END, 4) AS f1
FROM (SELECT lang, CAST(sum({_PRED} * quality) AS BIGINT) AS matches, CAST(sum({_PRED}) AS BIGINT) AS preds, CAST(sum(quality) AS BIGINT) AS labels FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def prf_by_language(t):
    pred = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    joined = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.sum(pred * F.col("quality")).alias("matches"), F.sum(pred).alias("preds"), F.sum("quality").cast("long").alias("labels"))
    return evaluate.with_prf(joined)


@query("""SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n FROM (SELECT source, 2.0 * sum(toxic * quality) / greatest(1, sum(toxic) + sum(quality)) AS f1 FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def prf_macro(t):
    per = t("documents").join(t("labels"), "doc_id").groupBy("source").agg((2.0 * F.sum(F.col("toxic") * F.col("quality")) / F.greatest(F.lit(1), F.sum("toxic") + F.sum("quality"))).alias("f1"))
    return per.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(median(o_totalprice), 2) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high, round(stddev_pop(o_totalprice), 4) AS std_pop, round(stddev_samp(o_totalprice), 4) AS std_samp FROM orders GROUP BY o_orderstatus""")
def dataset_stats(t):
    p = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(p), 2).alias("total"), F.round(F.median(p), 2).alias("median"), F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.stddev_pop(p), 4).alias("std_pop"), F.round(F.stddev_samp(p), 4).alias("std_samp"))


@query("""SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY lang""")
def value_counts_pct(t):
    return records.value_counts(t("documents"), "lang")


@query("""SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source""")
def crosstab_source_language(t):
    return t("documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word) ORDER BY n DESC, word LIMIT 10""")
def vocabulary_top(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query("""SELECT p_brand, list_sort(list(p_size))[len(list(p_size)) // 2 + 1] AS upper_median FROM part GROUP BY p_brand""")
def upper_median(t):
    # the element at n div 2 of the sorted values, by rank: no group is collected
    ranked = t("part").select("p_brand", "p_size", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("p_brand")).alias("n"))
    return ranked.where("r = n div 2 + 1").select("p_brand", F.col("p_size").alias("upper_median"))


@query("""SELECT conv_id, CASE WHEN count(DISTINCT role) > 1 THEN 'mixed' ELSE min(role) END AS kind, count(*) AS n FROM conversations GROUP BY conv_id""")
def group_kind(t):
    return t("conversations").groupBy("conv_id").agg(F.when(F.count_distinct("role") > 1, "mixed").otherwise(F.min("role")).alias("kind"), F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(count(*) FILTER (WHERE n > 4) AS BIGINT) AS over, CAST(count(*) FILTER (WHERE n < 4) AS BIGINT) AS under, CAST(count(*) FILTER (WHERE n = 4) AS BIGINT) AS exact FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def over_under_exact(t):
    n = F.col("n")
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(n > 4).alias("over"), F.count_if(n < 4).alias("under"), F.count_if(n == 4).alias("exact"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 5 THEN 'short_title' WHEN lang IS NULL AND source IS NULL THEN 'no_author_no_year' WHEN n_chars < 200 THEN 'abbreviation' ELSE 'valid' END AS reason FROM documents) GROUP BY reason""")
def validity_reasons(t):
    reason = F.when(F.length("text") < 5, "short_title").when(F.col("lang").isNull() & F.col("source").isNull(), "no_author_no_year").when(F.col("n_chars") < 200, "abbreviation").otherwise("valid")
    return t("documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def evaluator_aligned(t):
    lists = lambda role, name: t("conversations").where(F.col("role") == role).groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list("text")).alias(name))
    return evaluate.with_prf(evaluate.align_strings(lists("user", "gold").join(lists("assistant", "predicted"), "doc_id", "full"), 0.5))


# Events as jobs


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS n FROM events GROUP BY ALL""")
def window_tumbling_events(t):
    events = t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts", "event_id")
    return jobs.stage_windows(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id AS job, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id) AS last_stage, count(DISTINCT event_type) AS n_stages, CASE arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status FROM events GROUP BY user_id""")
def job_state(t):
    return jobs.job_state(t("events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts", "event_id"), ("error",), ("purchase",)).drop("last_ts")
