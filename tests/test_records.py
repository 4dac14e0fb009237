import json

from pyspark.sql import functions as F

from refloom.functions import jsontext, matching
from refloom.functions.similarity import indel_ratio
from refloom.operators import evaluate, locate, records
from refloom.sources import files, providers, tei
from refloom.streaming import jobs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_json_repair(spark):
    parsed = lambda s: one(spark, s, lambda c: F.to_json(jsontext.parsed(c)))
    assert json.loads(parsed('```json\n[{"a": 1} {"a": 2},]\n```')) == [{"a": 1}, {"a": 2}]
    assert json.loads(parsed("{'a': 'it', b: None, 'c': False")) == {"a": "it", "b": None, "c": False}
    assert json.loads(parsed('{"a": "x, y: True, z"}')) == {"a": "x, y: True, z"}  # text that parses is not repaired
    # repairs stay outside strings
    assert json.loads(parsed('{"t": "Deep Learning: A, Foo: B", "v": "vol 12",}')) == {"t": "Deep Learning: A, Foo: B", "v": "vol 12"}
    assert json.loads(parsed('{"a": "x\\y [1", n: 2')) == {"a": "x\\y [1", "n": 2} and json.loads(parsed("{'a': 'b: c, d: e'}")) == {"a": "b: c, d: e"}
    assert [parsed(s) for s in ("", "no json", None)] == [None] * 3


def test_response_records(spark):
    count = lambda s: one(spark, s, lambda c: F.size(jsontext.response_records(c)))
    assert [count(s) for s in ('{"references": []}', '{"refs": [1, 2]}', '[{"a": 1}]', '{"a": 1}')] == [0, 2, 1, 1]
    assert one(spark, None, jsontext.response_records) is None


def test_tei_fields(spark):
    doc = """<TEI><listBibl><biblStruct source="fn12"><analytic><title level="a">A <hi>b</hi></title><author><persName><forename type="first">Ann</forename><forename type="middle">C.</forename>
    <surname>Day</surname></persName></author><author><orgName>Org</orgName></author></analytic><monogr><title level="j">J</title><editor role="translator"><persName><surname>Tr</surname></persName></editor>
    <imprint><pubPlace>Rome</pubPlace><pubPlace>Bonn</pubPlace><date when="2001"/><biblScope unit="page" from="1" to="9"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct>
    <biblStruct><monogr></broken></biblStruct><biblStruct><monogr/></biblStruct></listBibl><biblStruct><monogr><title level="m">outside</title></monogr></biblStruct></TEI>"""
    rows = tei.parse(spark.createDataFrame([(1, doc), (2, None), (3, "")], "id int, xml string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["pos"], r["authors"], r["editors"], r["translator"]) == (1, 0, ["Ann C. Day", "Org"], [], "Tr")
    assert (r["title"], r["identifiers"][0]["normalized"], r["author_agents"][0]["middle_name"]) == ("A b", "10.1/x", "C.")
    assert (r["journal"], r["place"], r["date"], r["pages"], r["footnote"]) == ("J", "Rome, Bonn", "2001", "1-9", "12")
    assert [(i["scheme"], i["value"]) for i in r["identifiers"]] == [("doi", "10.1/x")]


def test_titles(spark):
    df = spark.createDataFrame([("The Cat!", "the cat"), ("", "a"), (None, "a"), ("cat on mat", "mat on cat"), ("cat", "the cat sat"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(matching.title_similarity(F.col("a"), F.col("b"))).collect()] == [100, 0, 0, 100, 100, 0]
    a, b = "abcd", "xxabxdyy"
    assert matching.partial_ratio(a, b) == max(indel_ratio(a, b[max(0, i) : i + 4]) for i in range(-3, 8))
    assert [matching.title_points(F.lit(0.0)) is not None, one(spark, 95.0, matching.title_points, "double"), one(spark, 95.5, matching.title_points, "double")] == [True, 40, 45]


def test_records_alignment(spark):
    schema = "doc_id long, gold array<map<string, array<string>>>, predicted array<map<string, array<string>>>"
    rows = [
        (1, [{"t": ["a"], "n": ["x", "y"]}, {"t": ["b"]}], [{"t": ["B "]}, {"t": ["a"], "n": ["y"]}, {"t": ["c"]}]),
        (2, [], []), (3, None, [{"t": ["a"]}]), (4, [None], [{"t": None}]),
    ]
    found = {(r["doc_id"], r["field"]): r for r in evaluate.align_records(spark.createDataFrame(rows, schema), ["t", "n"]).collect()}
    count = lambda *k: tuple(found[k][c] for c in ("matches", "preds", "labels"))
    assert [count(1, "t"), count(1, "n"), count(2, "t"), count(3, "t"), count(4, "n")] == [(2, 3, 2), (1, 1, 2), (0, 0, 0), (0, 1, 0), (0, 0, 0)]
    assert abs(found[1, "t"]["doc_f1"] - (1 + 4 / 5) / 3) < 1e-9 and found[2, "t"]["doc_f1"] == 1 and found[3, "n"]["doc_f1"] == 0
    # lists of one length go by position, others by the best assignment
    assert evaluate.field_counts(["x", "y"], ["y", "x"], "exact", 1) == (0, 2, 2) and evaluate.field_counts(["x", "y", "z"], ["z", "x"], "exact", 1) == (2, 3, 2)
    assert evaluate.value_match("abcd", "abcx", "soft_fuzzy", 1) == 0.75 and evaluate.value_match("abcd", "abcx", "fuzzy", 0.7) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": 1},\n{"id": 2}]')
    (tmp_path / "b.json").write_text('\n{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "c.json").write_text('{"_metadata": {"n": 2}}\n{"id": 1}\n{"id": 2}\n')
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    for name in "ab":
        assert sorted(r["id"] for r in files.json_records(spark, f"{tmp_path}/{name}.json", "id int").where("id IS NOT NULL").collect()) == [1, 2]
    head, rows = files.header_and_records(spark, f"{tmp_path}/c.json", "id int")
    assert head.count() == 1 and sorted(r["id"] for r in rows.collect()) == [1, 2]
    assert sorted(r["id"] for r in files.skip_ids(spark, f"{tmp_path}/ids.txt").collect()) == ["a", "b"] == sorted(r["id"] for r in files.skip_ids(spark, "b, a,,a").collect())
    assert files.latest(spark, f"{tmp_path}/*.json").endswith("c.json")
    assert files.expired(spark, str(tmp_path), 1).count() == 0 and files.expired(spark, str(tmp_path), -1).count() == 4
    assert files.job_sizes(spark, str(tmp_path), r"/([a-c])\.json$").where("n_files = 1 AND bytes > 0").count() == 3


def test_provider_records(spark):
    assert one(spark, "broken", providers.work_record) is None and one(spark, None, providers.metadata_record) is None
    r = one(spark, '{"id": "doi:10.1/x omid:br/1", "title": "T", "author": "Day, Ann [orcid:1]; [x]; Bo", "venue": "J [issn:1]", "pub_date": "2001-02"}', providers.metadata_record)
    assert (r["doi"], r["provider_id"], r["authors"], r["journal"], r["year"], r["volume"]) == ("10.1/x", "br/1", ["Day, Ann", "Bo"], "J", 2001, None)


def test_sections_and_batches(spark):
    docs = spark.createDataFrame([(1, "x\n# References\na\n## More\nb\n# End\nc\n# References\nd"), (2, "none"), (3, None), (4, "## Bibliography:")], "doc_id int, text string")
    assert [(r["doc_id"], r["line"], r["section"]) for r in locate.heading_section(docs).collect()] == [(1, 1, "# References\na\n## More\nb"), (4, 0, "## Bibliography:")]
    df = spark.range(11).select("id", F.lit("g").alias("g"))
    sizes = lambda d: sorted((r["batch"], r["count"]) for r in d.groupBy("batch").count().collect())
    assert sizes(records.merged_batches(df, "g", "id", 5, 3)) == [(0, 5), (1, 6)] and sizes(records.batches(df, "g", "id", 5)) == [(0, 5), (1, 5), (2, 1)]
    assert records.ratio_split(df, "g", "id", 0.3).where("first_part").count() == 3


def test_job_state_counts_stages_exactly(spark):
    rows = [(j, f"stage{k % n}", f"2024-01-01 00:{k // 60:02}:{k % 60:02}", k) for j, n in ((1, 300), (2, 700), (3, 1)) for k in range(800)] + [(3, None, "2024-01-01 01:00:00", 900)]
    events = spark.createDataFrame(rows, "job long, stage string, ts string, event_id long")
    assert {r["job"]: r["n_stages"] for r in jobs.job_state(events).collect()} == {1: 300, 2: 700, 3: 1}
