"""Chunks, embeddings, search, rules, datasets, files, streams."""

import datetime as dt
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewatch.operators import quality as Q
from placewatch.operators import text as X
from placewatch.operators.vector import top_k
from placewatch.plans import claims as C
from placewatch.plans.datasets import Datasets
from placewatch.sources import files as SF
from placewatch.sources import changes as CH
from placewatch.sources import landing as L
from placewatch.sources import sinks as K
from placewatch.streaming import ingest as I

from .conftest import NOW


def plain_chunks(pages, size=1200, overlap=200, least=100):
    out, pos = [], 0
    for n, text in pages:
        text, start = " ".join(text.split()), 0
        while start < len(text):
            piece = text[start:start + size].strip()
            if len(piece) >= least:
                out.append((n, pos, piece))
                pos += 1
            start += size - overlap
    return out


def test_chunks(spark):
    pages = [(1, ""), (2, "x" * 99), (3, "y" * 100), (4, "z" * 1200), (5, "w" * 1201), (6, "ab " * 767), (7, "a  \tb\n" * 300),
             (2000, "é" * 2300), (5001, "tail " * 400)]
    df = spark.createDataFrame([("doc", n, t) for n, t in pages] + [("other", 1, "q" * 150)], "source string, page long, text string")
    got = X.chunk(df, "source", "page", "text")
    mine = sorted((r.page_number, r.chunk_position, r.chunk_to_retrieve) for r in got.where("source_uri = 'doc'").collect())
    assert mine == plain_chunks(pages)
    assert got.where("source_uri = 'other'").first()["chunk_id"] == "other::p1::c0"


def test_chunk_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([("d", 1, "x" * 500)], "source string, page long, text string")
    out = X.chunk(df, "source", "page", "text")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_encoders_agree(spark):
    df = spark.createDataFrame([("Flood relief, flood!",), ("",), (None,), ("Größe 12 été",)], "t string")
    a = [r.embedding for r in X.embed(df, "t", X.hashed_words(16)).collect()]
    b = [r.embedding for r in X.hashed_counts(df.fillna(""), "t", 16).collect()]
    assert a == b and sum(a[0]) == 3.0 and sum(a[1]) == 0.0


def test_only_changed_texts_are_embedded_again(spark, folder, rows):
    """The encoder sees new and changed texts, no others; gone ones have no row, and a NULL text no vector."""
    def encoder(mark):
        return lambda texts: np.array([[float(len(t)), mark] for t in texts])

    def table(data):
        return spark.createDataFrame(data, "chunk_id string, chunk_to_retrieve string")

    none = spark.createDataFrame([], "chunk_id string, text_digest string, embedding array<float>")
    X.refresh_embeddings(table([("a", "same"), ("b", "old"), ("c", "gone"), ("d", "text"), ("e", None)]), none, encoder(1.0)).write.parquet(folder + "/one")
    now = X.refresh_embeddings(table([("a", "same"), ("b", "newer"), ("d", None), ("e", "e"), ("f", "")]), spark.read.parquet(folder + "/one"), encoder(2.0), batch=2)
    assert rows(now, "chunk_id", "embedding", "fresh") == [
        ("a", [4.0, 1.0], False), ("b", [5.0, 2.0], True), ("d", None, False), ("e", [1.0, 2.0], True), ("f", [0.0, 2.0], True)]
    assert X.refresh_embeddings(table([]), none, encoder(1.0)).count() == 0


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(400, 8))
    corpus[100:230] = corpus[100]                       # a third of the rows are copies
    corpus[7] = 0.0
    queries = np.vstack([rng.normal(size=(6, 8)), corpus[100]])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in top_k(q, c.repartition(5), 5, block=block).collect())
    want = []
    for i, v in enumerate(queries):
        scores = [(-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 10), j) for j, x in enumerate(corpus) if np.linalg.norm(x) > 0]
        want += [(i, n + 1, j, round(-s, 4)) for n, (s, j) in enumerate(sorted(scores)[:5])]
    assert [(g[:3]) for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-4 for g, w in zip(got, want))


def test_search_struct(spark):
    chunks = spark.createDataFrame([("c1", "flood relief for farms", "/v/a.pdf", 3), ("c2", "tax rates", "/v/b.pdf", 1)], "chunk_id string, chunk_to_retrieve string, source_uri string, page_number int")
    asked = spark.createDataFrame([(1, "relief after a flood"), (2, "")], "q long, text string")
    got = {r.q: r.result for r in C.search(asked, "q", "text", chunks, 1).collect()}
    assert got[1].chunks_count == 1 and got[1].chunks[0].source_pdf == "a.pdf" and got[1].chunks[0].page_number == 3 and got[1].error is None
    assert got[2].question == ""


def test_parsed_documents(spark, rows):
    doc = lambda err, uri: json.dumps({"error_status": err, "document": {"source_uri": uri, "contents": [
        {"chunk_id": "k", "chunk_position": 0, "chunk_to_retrieve": "r", "chunk_to_embed": "e", "pages": [{"page_id": 4}, {"page_id": 5}]}]}})
    df = spark.createDataFrame([("p1", doc(None, "u1")), ("p2", doc(None, None)), ("p3", doc("bad", "u3"))], "path string, j string").select("path", F.parse_json("j").alias("v"))
    assert rows(X.chunks_from_parsed(df, "path", "v"), "source_uri", "page_number") == [("p2", 4), ("u1", 4)]


# -- rules -------------------------------------------------------------------

RULES = {"valid_temperature": "t BETWEEN -50 AND 60", "valid_rain": "r >= 0 OR r IS NULL"}


def readings(spark):
    return spark.createDataFrame([(10.0, 1.0), (75.0, 1.0), (None, 1.0), (5.0, -1.0), (5.0, None)], "t double, r double")


def test_rules(spark):
    kept, seen = Q.expect_or_drop(readings(spark), RULES)
    assert kept.count() == 2 and seen.get == {"_rows": 5, "valid_temperature": 2, "valid_rain": 1}   # a NULL fails the first rule
    all_rows, seen = Q.expect(readings(spark), RULES)
    assert all_rows.count() == 5 and seen.get["valid_temperature"] == 2
    assert Q.quarantine(readings(spark), RULES).count() == 3
    with pytest.raises(Q.RuleViolation, match="valid_rain"):
        Q.expect_or_fail(readings(spark), RULES)


def test_fail_rule_publishes_nothing(spark, folder):
    d = Datasets(spark, folder)
    d.source("locations", spark.range(14))
    d.define("summary", lambda x: x.agg(F.count("*").alias("n")), ("locations",), fail={"expected_15_locations": "n = 15"})
    with pytest.raises(Q.RuleViolation):
        d.refresh("r1")
    assert not os.path.exists(f"{folder}/summary")
    d.source("locations", spark.range(15))
    d.refresh("r2")
    assert d.read("summary").first()["n"] == 15


def test_datasets_order_and_audit(spark, folder, rows):
    d = Datasets(spark, folder)
    d.source("raw", readings(spark))
    d.define("c", lambda a, b: a.join(b), ("a", "b"))
    d.define("b", lambda a: a.agg(F.count("*").alias("n")), ("a",))
    d.define("a", lambda x: x, ("raw",), drop=RULES, watch={"warm": "t > 6"}, cluster_by=("t",))
    assert d.order().index("a") < d.order().index("b") < d.order().index("c")
    d.refresh()
    assert d.read("c").count() == 2 and rows(d.dropped(), "rule", "action", "failed") == [("valid_rain", "drop", 1), ("valid_temperature", "drop", 2), ("warm", "allow", 3)]
    assert Q.audit_events(d.audit_log(), "flow_progress").count() == 3


def test_checks(spark):
    readings(spark).createOrReplaceTempView("t_readings")
    assert Q.require_tables(spark, ["t_readings"]).first()["n"] == 5
    with pytest.raises(ValueError, match="nope"):
        Q.require_tables(spark, ["t_readings", "nope"])
    with pytest.raises(ValueError, match="humidity"):
        Q.require_columns({"r": readings(spark)}, {"r": ["t", "humidity"]})


# -- files -------------------------------------------------------------------


def test_features(spark):
    body = json.dumps({"features": [
        {"id": 7, "properties": {"headline": "", "isMajor": True, "created": 1700000000000, "encodedPolylines": ["x"], "roads": [{"mainStreet": "M"}]}, "geometry": {"coordinates": [150.0, -33.0]}},
        {"id": "s", "properties": {}, "geometry": {"coordinates": [150.0]}}, {"id": None, "properties": {"ended": False}}]})
    df = spark.createDataFrame([(body,), ('{"features": null}',), ("{}",)], "body string")
    got = {r.hazard_id: r for r in L.flatten_features(df, "body", "flood").collect()}
    assert set(got) == {"7", "s", None} and got["7"].headline is None and got["7"].is_major is True and got["7"].longitude == 150.0
    assert got["s"].longitude is None and got["s"].latitude is None and got["s"].roads_json == "[]" and got[None].ended is False
    assert got["7"].encoded_polylines_json == '["x"]'


def test_parallel_arrays(spark):
    df = spark.createDataFrame([("A", (["2026-05-12T00:00", "2026-05-12T01:00"], [0.1, 0.2], [5.0]))], "place string, hourly struct<time array<string>, precipitation array<double>, windspeed_10m array<double>>")
    out = L.explode_parallel_arrays(df, "hourly", {k: L.HOURLY[k] for k in ("time", "precipitation", "windspeed_10m")}, ["place"]).orderBy("forecast_time").collect()
    assert [r.precipitation_mm for r in out] == [0.1, 0.2] and out[1].windspeed_kmh is None


XML = """<r><businessEntity202001><ABN><identifierValue>{n}</identifierValue></ABN>{name}<mainBusinessPhysicalAddress><stateCode>NT</stateCode><postcode>0800</postcode></mainBusinessPhysicalAddress></businessEntity202001></r>"""


@pytest.mark.parametrize("name,want", [
    ("<mainName><organisationName>Main</organisationName></mainName><businessName><organisationName>B</organisationName></businessName>", "Main"),
    ("<businessName><organisationName>Biz</organisationName></businessName>", "Biz"),
    ("<businessName><organisationName>One</organisationName></businessName><businessName><organisationName>Two</organisationName></businessName>", "One"),
    ("<legalName><givenName>Kim</givenName><familyName>Lee</familyName></legalName>", "Kim Lee"), ("", None)])
def test_business_xml(spark, folder, name, want):
    with open(f"{folder}/a.xml", "w") as f:
        f.write(XML.format(n="10000000001", name=name))
    r = SF.business_rows(SF.read_business_xml(spark, folder), NOW).first()
    assert (r.abn, r.state, r.postcode, r.organisation_name, r.status) == (10000000001, "NT", 800, want, None)


def test_code_list_at_any_depth(spark, rows):
    """The first list in document order counts, also seven levels down and before a shallower one."""
    deep = '{"a":' * 7 + '{"codes":[{"id":"A","name":"x"}]}' + "}" * 7
    two = '{"m":{"l":[{"q":1},{"codes":[{"id":"A"}]}]},"n":{"codes":[{"id":"B"}]}}'
    other = '[{"codes":"no list","z":{"codes":[{"id":7,"name":{"fr":"sept"}},{"name":"no id"},3]}}]'
    df = spark.createDataFrame([(1, deep), (2, two), (3, other), (4, None), (5, "[]"), (6, '{"codes":[]}')], "k int, j string")
    assert rows(SF.code_list(df, "k", "j")) == [(1, "A", "x"), (2, "A", None), (3, "7", "sept")]


def test_code_list_odd_texts(spark, rows):
    """Broken texts give no row, an object comes before what it holds, quoted JSON is no list, brackets in strings stay."""
    quoted = '{"note":"{\\"codes\\":[{\\"id\\":1}]}","x":[[[{"codes":[{"id":"[z","name":"{k"},{"id":null},{"id":"n","name":5}]}]]]}'
    own = '{"a":{"codes":[{"id":"in"}]},"codes":[{"id":"own","name":{"de":"D","en":""}}]}'
    texts = [(1, own), (2, quoted), (3, '{"codes":['), (4, None), (5, ""), (6, '{"codes":7}'), (7, '{"codes":[],"z":{"codes":[{"id":"late"}]}}'),
             (8, ' {"z":{"q":{"codes":[{"id":"deep"}]}},"a":{"codes":[{"id":"flat"}]}}')]
    df = spark.createDataFrame(texts, "k int, j string")
    assert rows(SF.code_list(df, "k", "j")) == [(1, "own", "D"), (2, "[z", "{k"), (2, "n", None), (8, "deep", None)]
    assert rows(SF.code_list_states(df, "j"), "state", "n") == [("listed", 4), ("malformed", 2), ("missing", 1), ("no list", 1)]
    assert SF.code_list(df.where("k < 0"), "k", "j").count() == 0


def test_audit_events_are_not_cut(spark):
    log = spark.range(120).selectExpr("'e' AS event_type", "timestamp_seconds(id) AS at", "'d' AS dataset", "'r' AS rule")
    assert Q.audit_events(log, "e").count() == 120 and Q.audit_events(log, "e", 50).count() == 50


def test_code_list(spark, rows):
    docs = [(1, {"data": {"codelists": [{"codes": [{"id": "01", "name": {"de": "x", "en": "Farm"}}, {"id": "A", "name": "All"}, {"name": "none"}]}]}}),
            (2, {"codes": [{"id": 5, "name": {"fr": "Cinq"}}], "deep": {"codes": [{"id": "no"}]}}), (3, {"nothing": 1})]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "k long, j string")
    assert rows(SF.code_list(df, "k", "j")) == [(1, "01", "Farm"), (1, "A", "All"), (2, "5", "Cinq")]


def test_batches_and_history(spark, folder):
    a = L.with_lineage(spark.range(3), "s", "2026-05-11 21:00:00")
    K.append_batch(a, f"{folder}/t")
    K.append_batch(L.with_lineage(spark.range(2).withColumn("extra", F.lit("e")), "s", NOW), f"{folder}/t")
    out = K.read_history(spark, f"{folder}/t")
    assert out.where("extra IS NULL").count() == 3 and out.select("_ingest_time").distinct().count() == 2
    assert sorted(os.listdir(f"{folder}/t"))[-2:] == ["_ingest_date=2026-05-11", "_ingest_date=2026-05-12"]


def test_land_never_overwrites(spark, folder):
    t = dt.datetime(2026, 5, 12, 6, 0, 0)
    assert K.land(spark.range(0), folder, "w", t) is None
    assert K.land(spark.range(2), folder, "w", t).endswith("/w/2026/05/12/060000.json")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        K.land(spark.range(2), folder, "w", t)


def test_comments_survive_quotes(spark, folder):
    K.declare(spark, "t_doc", "a INT, b STRING", comment="it's", location=f"{folder}/doc")
    K.document(spark, "t_doc", "the table's text", {"a": "a's text"})
    cols = {c.name: c.description for c in spark.catalog.listColumns("t_doc")}
    assert cols["a"] == "a's text" and spark.catalog.getTable("t_doc").description == "the table's text"
    spark.sql("DROP TABLE t_doc")


def test_projection_files(spark):
    from placewatch.plans import climate
    wide = spark.createDataFrame([("IN", 1, -33.0, 150.0, "e", "rcp45", "m1", "2020-2039", 10.0, None, 30.0), ("OUT", 2, -20.0, 150.0, "e", "rcp45", "m1", "2020-2039", 1.0, 2.0, 3.0)],
                                 "STATION_NAME string, STN_ID int, LAT double, LON double, ENSEMBLE string, RCP string, MODEL string, CLIMATOLOGY string, Annual double, DJF double, May double")
    out = climate.projections({"tas": wide, "pan_evap": wide})
    assert out.count() == 4 and {(r.variable, r.aggregation) for r in out.collect()} == {("tas", "mean"), ("pan_evap", "sum")}
    assert out.columns[:4] == ["station_name", "station_id", "lat", "lon"]


# -- streams -----------------------------------------------------------------


def land(folder, name, data):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}.json", "w") as f:
        json.dump(data, f)


def test_array_files_stream_once_and_replay(spark, folder):
    row = {"location_name": "A", "forecast_time": "2026-05-12T06:00", "temperature_c": 10.0, "precipitation_mm": 0.0}
    land(folder, "a", [row, {**row, "temperature_c": 75.0}])
    stream = lambda: L.weather_bronze(L.read_landing(spark, f"{folder}/in", L.WEATHER_SCHEMA))
    rules = {"valid_temperature": "temperature_c BETWEEN -50 AND 60"}
    for _ in range(2):
        I.ingest(stream(), f"{folder}/out", f"{folder}/cp", rules).awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 1
    land(folder, "b", [{**row, "location_name": "B", "new_field": 1}])
    I.ingest(stream(), f"{folder}/out", f"{folder}/cp", rules).awaitTermination()
    first = spark.read.parquet(f"{folder}/out")
    assert first.count() == 2
    I.replay(stream, f"{folder}/again", f"{folder}/cp2", rules).awaitTermination()
    again = spark.read.parquet(f"{folder}/again")
    cols = ["location_name", "_ingest_time", "_source_file"]
    assert sorted(map(tuple, first.select(cols).collect())) == sorted(map(tuple, again.select(cols).collect()))


def test_audited_ingest(spark, folder, rows):
    land(folder, "a", [{"hazard_type": "flood"}, {"hazard_type": "quake"}])
    stream = L.read_landing(spark, f"{folder}/in", "hazard_type string")
    I.ingest(stream, f"{folder}/out", f"{folder}/cp", {"known": "hazard_type = 'flood'"}, {"long": "length(hazard_type) > 5"}, f"{folder}/audit").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 1
    assert rows(spark.read.parquet(f"{folder}/audit"), "rule", "action", "failed") == [("known", "drop", 1), ("long", "allow", 2)]


def test_late_rows(spark, folder, rows):
    """Rows later than the watermark change nothing that is closed; the store keeps the newest sums."""
    os.makedirs(f"{folder}/in")
    def put(name, data):
        spark.createDataFrame([(dt.datetime.fromisoformat(t), k, v) for t, k, v in data], "ts timestamp, k string, v long").coalesce(1).write.parquet(f"{folder}/in/{name}")
    def run():
        s = spark.readStream.schema("ts timestamp, k string, v long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        I.store_rollup(I.daily_rollup(s, "ts", ["k"], {"n": F.sum("v")}, "1 day"), f"{folder}/t", ["day", "k"], f"{folder}/cp").awaitTermination()
        return rows(CH.read_changes(spark, f"{folder}/t").select(F.col("day").cast("string").alias("day"), "n"))
    put("a", [("2026-05-01 10:00", "x", 1), ("2026-05-01 11:00", "x", 2)])
    assert run() == [("2026-05-01", 3)]
    put("b", [("2026-05-05 10:00", "x", 5), ("2026-05-01 12:00", "x", 4)])
    assert run() == [("2026-05-01", 7), ("2026-05-05", 5)]
    put("c", [("2026-05-01 13:00", "x", 100), ("2026-05-05 11:00", "x", 1)])
    assert run() == [("2026-05-01", 7), ("2026-05-05", 6)]


def test_latest_row_ignores_older_arrivals(spark, folder, rows):
    os.makedirs(f"{folder}/in")
    def run(name, data):
        spark.createDataFrame(data, "k long, at long, v string").coalesce(1).write.parquet(f"{folder}/in/{name}")
        s = spark.readStream.schema("k long, at long, v string").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        I.keep_latest(s, f"{folder}/t", ["k"], ["at"], f"{folder}/cp").awaitTermination()
        return rows(CH.read_changes(spark, f"{folder}/t"), "k", "v")
    assert run("a", [(1, 5, "a5"), (1, 4, "a4"), (2, 1, "b1")]) == [(1, "a5"), (2, "b1")]
    assert run("b", [(1, 3, "late"), (2, 9, "b9"), (3, 1, "c1")]) == [(1, "a5"), (2, "b9"), (3, "c1")]


def test_compaction(spark, folder):
    spark.range(1000).select(F.pmod("id", F.lit(50)).alias("k"), "id").repartition(20).write.parquet(f"{folder}/small")
    K.compact(spark, f"{folder}/small", f"{folder}/large", ["k"], 3)
    assert len(glob.glob(f"{folder}/large/*.parquet")) <= 3 and spark.read.parquet(f"{folder}/large").count() == 1000


def test_published_datasets_are_found_by_another_process(spark, folder):
    made = Datasets(spark, folder)
    made.source("raw", spark.range(5).withColumnRenamed("id", "x"))
    made.define("kept", lambda raw: raw, ("raw",), drop={"small": "x < 3"}, cluster_by=("x",), comment="small ones", properties={"layer": "gold"})
    run = made.refresh()
    other = Datasets(spark, folder)
    assert sorted(r.x for r in other.read("kept").collect()) == [0, 1, 2]
    about = other.about("kept")
    assert (about["run_id"], about["comment"], about["properties"]) == (run, "small ones", {"layer": "gold"})
    made.define("stopped", lambda raw: raw, ("raw",), fail={"none": "x < 0"})
    with pytest.raises(Q.RuleViolation):
        made.refresh()
    assert sorted(r.x for r in other.read("kept").collect()) == [0, 1, 2]
