"""Flows, agents, sections by vectors, the result store and job events as streams, against plain Python."""

import os
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refloom.functions import authors, ids
from refloom.functions.similarity import edit_distance
from refloom.operators import evaluate, flows, locate, records
from refloom.sources import store, tei
from refloom.streaming import jobs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


@settings(max_examples=80, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_edit_distance(a, b):
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        table.append([i])
        for j, y in enumerate(b, 1):
            table[i].append(min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y)))
    assert edit_distance(a, b) == table[-1][-1]


def person(first=None, middle=None, surname=None, role=None):
    return {"kind": "person", "first_name": first, "middle_name": middle, "surname": surname, "role_name": role, "name": None, "literal": None}


def test_agents():
    text = lambda x: person() | {"kind": "str", "literal": x}
    org = lambda x: person() | {"kind": "org", "name": x}
    match = lambda a, b, mode="exact": evaluate.agent_match(a, b, mode, 0.8)
    assert match(person("Ann", None, "Day"), person("ann ", None, "DAY")) == 1 and match(person("Ann", None, "Day"), person("Ann", "C.", "Day")) == 0
    assert match(person("Ann", None, "Day"), person("Ann", "C.", "Day"), "soft_fuzzy") == 2 / 3 and match(person(), person()) == 1 and match(None, person()) == 0
    assert match(person("Ann", "C.", "Day"), text("Day, Ann C.")) == 1 and match(text("ann c. day"), person("Ann", "C.", "Day")) == 1 and match(person(None, None, "Day"), text("Day, Ann")) == 0
    assert match(org("X"), org("x")) == 1 and match(org("Ann Day"), person("Ann", None, "Day")) == 1 and match(person(role="Editor"), text("editor")) == 1
    # lists of one length go by position, others by the best assignment
    a, b = person("A", None, "B"), person("C", None, "D")
    assert evaluate.field_counts([a, b], [b, a], "exact", 0.8) == (0, 2, 2) and evaluate.field_counts([a, b, text("x")], [b, a], "exact", 0.8) == (2, 3, 2)


def test_strings(spark):
    rows = [(1, ["a", " "], ["a "]), (2, [], [" "]), (3, ["a"], []), (4, ["abcd", "wxyz"], ["wxyz", "abcx", "q"])]
    pairs = spark.createDataFrame(rows, "doc_id long, gold array<string>, predicted array<string>")
    got = {r["doc_id"]: (r["matches"], r["precision"], r["recall"], r["f1"], r["similarity"]) for r in evaluate.align_strings(pairs, 0.7, "levenshtein").collect()}
    assert got == {1: (1, 1, 1, 1, 1), 2: (0, 1, 1, 1, 1), 3: (0, 0, 0, 0, 0), 4: (2, 0.6667, 1, 0.8, 0.875)}
    with pytest.raises(ValueError):
        evaluate.align_strings(pairs, mode="other")
    with pytest.raises(ValueError):
        evaluate.align_records(pairs, ["t"], "other")


def test_all_failed(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, failed boolean")
    assert evaluate.unless_all_failed(df, F.col("failed")).count() == 2 and evaluate.unless_all_failed(df.where("false"), F.col("failed")).count() == 0
    with pytest.raises(Exception, match="all calls failed"):
        evaluate.unless_all_failed(df.where("failed"), F.col("failed")).collect()


def test_author_forms(spark):
    names = {
        "Smith, J., Brown, A. B.,": ["Smith/J./", "Brown/A./B."], "Rossi, A. e Bianchi, B.": ["Rossi/A./", "Bianchi/B./"], "Barrucand M., A. Bednorz,": ["Barrucand/M./", "Bednorz/A./"],
        "O'Brien Pat": ["Pat/O'Brien/"], "Jean-Paul Sartre": ["=Jean-Paul Sartre"], "Rossi G. F.": ["Rossi/G./F."], "A. B. Rossi": ["Rossi/A./B."], "N. COLAK": ["COLAK/N./"], "Smith, J.K.": ["Smith/J./K."],
        "Berchet, Federico M.": ["Berchet/Federico/M."], "Berchet, Federico Sagredo": ["=Berchet, Federico Sagredo"], "SMITH JOHN": ["=SMITH JOHN"], "AA. VV.": ["=AA. VV."], "Day (ed.)": ["=Day (ed.)"], "de Rossi, Carlo": ["=de Rossi, Carlo"],
    }
    shown = lambda a: F.when(a["kind"] == "str", F.concat(F.lit("="), a["literal"])).otherwise(F.concat_ws("/", a["surname"], a["first_name"], F.coalesce(a["middle_name"], F.lit(""))))
    got = {n: one(spark, n, lambda c: F.transform(authors.parsed_authors(c), shown)) for n in names}
    assert got == names
    assert [r["kind"] for r in one(spark, None, authors.parsed_authors)] == ["str"]


def test_identifier_rules(spark):
    forms = {"2101.12345": "arxiv", "math/0601001": "arxiv", "0-123-45678-X": "isbn", "12345678": "issn", "q98765": "wikidata", "http://doi.org/10.1234/abc": "url", "123": None, "10.12/ab": "doi", "PMID": "pmid"}
    assert {f: one(spark, f, ids.detect_scheme) for f in forms} == forms
    guesses = {"10.1/x": "doi", "Q5": "wikidata", "2101.1234": "arxiv", "PMC12": "pmcid", "pmid 1": "pmid", "978-0-123-45678-9": "isbn", "1234-567X": "issn", "123456": "pmid", "12": None}
    assert {g: one(spark, g, ids.guessed_scheme) for g in guesses} == guesses
    assert one(spark, " ", ids.parse_identifier) is None and one(spark, "https://x", ids.parse_identifier)["scheme"] == "https"


def picked(scores, gap=0.1, tolerance=0.03):
    """The rule for chunks, in plain Python."""
    s, half = np.array(scores), len(scores) // 2
    ranked = np.sort(s)[::-1]
    found = []
    if len(s) > 1:
        drops = ranked[:-1] - ranked[1:]
        k = int(np.argmax(drops))
        if drops[k] > gap:
            found = [i for i in range(len(s)) if s[i] >= ranked[k + 1]]
    if not 0 < len(found) <= half:
        at = lambda share: [i for i in range(len(s)) if s[i] >= s.max() * share]
        found = at(0.5) if not at(0.7) else at(0.85) if len(at(0.7)) > half else at(0.7)
    if len(found) > half:
        found = sorted(range(len(s)), key=lambda i: (-s[i], i))[:half]
    if not found:
        return []
    best = min(found, key=lambda i: (-s[i], i))
    out = set(found) | {best}
    for step in (-1, 1):
        i = best + step
        while 0 <= i < len(s) and s[i] >= s[best] - tolerance:
            out.add(i)
            i += step
    return sorted(out)


def test_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.random(rng.integers(1, 9)) * rng.choice([0.05, 0.4, 1.0]), 3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, s array<double>").select("id", locate.chosen_chunks(F.col("s")).alias("p"))
    assert {r["id"]: list(r["p"]) for r in df.collect()} == {i: picked(s) for i, s in rows}


def test_semantic_sections(spark):
    rng = np.random.default_rng(6)
    queries = rng.normal(size=(3, 4))
    chunks = [(d, k, f"{d}-{k}" + (" doi isbn" if (d + k) % 4 == 0 else ""), None if d == 2 and k == 1 or d == 3 else rng.normal(size=4).tolist()) for d in range(6) for k in range(5)]
    chunks = [(d, k, f"{d}-{k}" if d == 3 else t, v) for d, k, t, v in chunks]
    got = {r["doc_id"]: list(r["chunks"]) for r in locate.semantic_sections(spark.createDataFrame(chunks, "doc_id int, chunk int, text string, vector array<double>"), spark.createDataFrame([(q.tolist(),) for q in queries], "query array<double>")).collect()}
    for d in range(6):
        own = [c for c in chunks if c[0] == d]
        bonus = [0.04 if "doi" in t else 0.0 for _, _, t, _ in own]
        if any(v is None for *_, v in own):
            want = [k for k, b in enumerate(bonus) if b >= max(bonus) / 2] if max(bonus) else []
        else:
            unit = lambda v: np.array(v) / np.linalg.norm(v)
            want = picked([max(float(unit(v) @ unit(q)) for q in queries) + b for (*_, v), b in zip(own, bonus, strict=True)])
        assert got[d] == want, d


def test_called_model(spark):
    def complete(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        return [p.upper() for p in prompts]

    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b\n\n c ")], "doc_id int, text string").coalesce(1)
    got = {r["doc_id"]: (list(r["lines"]), r["error"]) for r in flows.extracted_lines(docs, flows.called(complete, 1), "{{INPUT_TEXT}}").collect()}
    assert got == {1: (["A"], None), 2: ([], "call failed"), 3: ([], None), 4: (["B", "C"], None)}
    pages = flows.one_step_by_page(spark.createDataFrame([(1, "p\n-----\nbad\n-----\nq"), (2, "bad"), (3, "")], "doc_id int, text string"), flows.called(lambda ps: [f'[{{"t": "{p}"}}]' if p != "bad" else None for p in ps]), "{{INPUT_TEXT}}")
    assert {r["doc_id"]: (list(r["records"]), r["n_failed"], r["error"]) for r in pages.collect()} == {1: (['{"t":"p"}', '{"t":"q"}'], 1, None), 2: ([], 1, "every page failed"), 3: ([], 0, None)}


def test_tei_lists(spark):
    record = lambda t: f'<biblStruct><monogr><title level="m">{t}</title></monogr></biblStruct>'
    docs = [(1, f"<x:listBibl><listBibl>{record('a')}</listBibl>{record('b')}<listBibl/></x:listBibl>{record('out')}"), (2, "<TEI/>"), (3, None), (4, f"<listBibl>{record('c &amp; <i>d</i>')}<biblStruct/></listBibl>")]
    rows = tei.parse(spark.createDataFrame(docs, "id int, xml string")).collect()
    assert sorted((r["id"], r["full_title"]) for r in rows) == [(1, "a"), (1, "b"), (4, "c & d")]


def test_title_patterns(spark):
    index = [(1, "Deep learning for graphs"), (2, "Graph theory"), (3, "On deeper learnings"), (4, "ab"), (5, "a (b) c*"), (6, None)]
    refs = [(1, "deep learning"), (2, "b"), (3, "(b) c*"), (4, "theory"), (5, None), (6, " "), (7, "nothing like it")]
    got = records.title_pattern_candidates(spark.createDataFrame(refs, "ref_id int, title string"), spark.createDataFrame(index, "rec_id int, title string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 3), (2, 4), (2, 5), (3, 5), (4, 2)]


def test_placed_ranks_whole_strata(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.lit("a")).when(F.col("id") % 100 > 0, F.lit("b")).alias("s"))
    rows = records.placed(df, "s", "id").select("id", "s", "place", "n", records.hash_key(F.col("id")).alias("h")).collect()
    for s in ("a", "b", None):
        own = sorted((r for r in rows if r["s"] == s), key=lambda r: (r["h"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and {r["n"] for r in own} == {len(own)}


def test_store(spark, tmp_path):
    path = f"{tmp_path}/results"
    assert store.read(spark, path) is None and not store.exists(spark, path, "a")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "job string, x int")
    store.save(rows, path)
    store.save(rows.where("job = 'b'").withColumn("x", F.lit(3)), path)
    assert sorted((r["job"], r["x"]) for r in store.read(spark, path).collect()) == [("a", 1), ("b", 3)] and store.exists(spark, path, "b") and not store.exists(spark, path, "c")
    store.append_scores(rows, f"{tmp_path}/log")
    store.append_scores(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    store.export(rows.withColumn("l", F.array("x")), f"{tmp_path}/csv", "csv")
    store.export(rows, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2 and store.uploads(spark, f"{tmp_path}/csv").count() >= 1
    old = time.time() - 7200
    for folder, _, names in os.walk(f"{path}/job=a"):
        for n in names:
            os.utime(f"{folder}/{n}", (old, old))
    assert store.delete_expired(spark, [path], 1) == 1
    spark.catalog.refreshByPath(path)
    assert [r["job"] for r in store.read(spark, path).collect()] == ["b"]


def events(rows):
    return [(j, s, t, k) for k, (j, s, t) in enumerate(rows)]


def run_stream(spark, path, make, mode, batches, checkpoint):
    """Rows of a stream over files that come one after the other, each in a micro-batch of its own."""
    schema = "job long, stage string, ts timestamp, event_id long"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, s, t, e) for j, s, t, e in rows], "job long, stage string, ts string, event_id long").select("job", "stage", F.col("ts").cast("timestamp").alias("ts"), "event_id").coalesce(1).write.parquet(f"{path}/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")
    out = []
    query = make(source).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: out.append(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return out


def test_streams(spark, tmp_path):
    first = events([(1, "queued", "2024-01-01 00:00:00"), (1, "started", "2024-01-01 00:10:00"), (2, "queued", "2024-01-01 00:20:00")])
    second = events([(1, "started", "2024-01-01 00:30:00"), (1, "completed", "2024-01-01 05:00:00")])
    late = events([(2, "started", "2024-01-01 01:00:00"), (2, "failed", "2024-01-01 05:30:00")])
    last = events([(3, "queued", "2024-01-01 12:00:00")])
    # a batch in between, as rows are late by the watermark of the batch before
    between = events([(4, "queued", "2024-01-01 05:10:00")])
    feed = [[(j, s, t, 10 * b + e) for j, s, t, e in rows] for b, rows in enumerate((first, second, between, late, last))]
    once = [(r["job"], r["stage"]) for part in run_stream(spark, f"{tmp_path}/a", jobs.stages_once, "append", feed, f"{tmp_path}/ca") for r in part]
    # started again is dropped; the start of job 2 comes four hours after the watermark has passed it
    assert sorted(once) == sorted([(1, "queued"), (1, "started"), (2, "queued"), (1, "completed"), (2, "failed"), (3, "queued"), (4, "queued")])
    counted = [(str(r["start"])[11:16], r["stage"], r["n"]) for part in run_stream(spark, f"{tmp_path}/b", jobs.stage_windows, "append", feed, f"{tmp_path}/cb") for r in part]
    assert sorted(counted) == [("00:00", "queued", 2), ("00:00", "started", 2), ("05:00", "completed", 1), ("05:00", "failed", 1), ("05:00", "queued", 1)]
    states = run_stream(spark, f"{tmp_path}/c", jobs.job_state, "complete", feed, f"{tmp_path}/cc")[-1]
    assert sorted((r["job"], r["status"], r["n_stages"]) for r in states) == [(1, "completed", 3), (2, "failed", 3), (3, "queued", 1), (4, "queued", 1)]
    outputs = spark.createDataFrame([(1, "started")], "job long, stage string")
    todo = [(r["job"], r["stage"]) for part in run_stream(spark, f"{tmp_path}/d", lambda e: jobs.unfinished(e, outputs), "append", feed, f"{tmp_path}/cd") for r in part]
    assert (1, "started") not in todo and len(todo) == 7


def test_jobs(spark):
    state = spark.createDataFrame([(1, "completed", "2024-01-01 00:00:00"), (2, "processing", "2024-01-01 00:30:00"), (3, "completed", "2024-01-01 01:50:00")], "job long, status string, ts string").select("job", "status", F.col("ts").cast("timestamp").alias("last_ts"))
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    assert sorted((r["job"], r["has_result"]) for r in jobs.live(state, now).collect()) == [(2, False), (3, True)]
    tasks = spark.createDataFrame([(10, None), (11, 1), (12, 2)], "job long, depends_on long")
    assert sorted(r["job"] for r in jobs.ready(tasks, state).collect()) == [10, 11]
    kinds = spark.createDataFrame([("parse_references", "llm"), ("parse_references", "grobid"), ("link", None), ("x", None)], "kind string, parser string")
    assert [r["queue"] for r in jobs.queued(kinds).collect()] == ["llm-tasks", "default", "linking", None]
