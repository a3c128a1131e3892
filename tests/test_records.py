import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import links, notes, profile, retrieval
from larkspur.streaming import dispatch

NOTE = """### [MEM-2026-0001] A title
- **Type:** Gotcha
- **Confidence:** VERIFIED
- **Salience:** 0.80
- **Created:** 2026-08-24
- **Last-Access:** 2026-08-24
- **Freq:** 1
- **Tags:** #test #local
- **Links:** [[MEM-2026-0001]]
- **Provenance:** seen
- **Observation:** it happens
- **Directive:** avoid it

## Later section
text
"""


def audited(spark, text):
    parsed = notes.parse_notes(spark.createDataFrame([("f.md", text)], "path string, text string"))
    return {(r.level, r.rule) for r in notes.audit_notes(parsed, F.lit("2026-08-24").cast("date")).collect()}


def test_valid_note_has_no_findings(spark):
    assert audited(spark, NOTE) == set()


@pytest.mark.parametrize(
    "old, new, rule",
    [("VERIFIED", "SURE", "confidence"), ("Gotcha", "Guess", "type"), ("0.80", "1.20", "salience"), ("** 1\n", "** -1\n", "freq"), ("[[MEM-2026-0001]]", "[[MEM-2026-0009]]", "unresolved MEM-2026-0009"), ("2026-08-24\n- **Last", "2027-08-24\n- **Last", "future date"), ("#test #local", "none", "tags")],
)
def test_mutations_are_found(spark, old, new, rule):
    assert rule in {r for _, r in audited(spark, NOTE.replace(old, new))}


def test_duplicate_ids_are_found(spark):
    assert ("FAIL", "duplicate id") in audited(spark, NOTE + NOTE)


def test_evidence_lines(spark):
    good = '- **Evidence:** {"date":"2026-09-01","stance":"SUPPORT","source":"a","quote":"b"}'
    lines = [good, good, good.replace("SUPPORT", "CHALLENGE"), good.replace('"a"', '"' + "x" * 241 + '"'), good.replace("2026-09-01", "2027-01-01"), "- **Evidence:** {", good.replace('":"', '": "')]
    rows = spark.createDataFrame([("n", i, x) for i, x in enumerate(lines)], "note_id string, line_no int, raw string")
    seen = notes.inspect_evidence(rows, F.lit(datetime.date(2026, 9, 3)))
    assert [r.fault for r in seen.orderBy("line_no").collect()] == [None, "duplicate", None, "source", "future date", "malformed", "not canonical"]
    report = notes.evidence_report(seen).first()
    assert (report.support, report.challenge, report.contested) == (1, 1, True)


def corpus(spark, rows):
    docs = spark.createDataFrame(rows, "id string, text string, created date, salience double")
    return retrieval.with_tokens(docs)


def test_rare_terms_and_salience_and_ties(spark):
    docs = corpus(spark, [("a", "widget widget widget common common common", None, 0.5), ("b", "common " * 6, None, 0.5), ("c", "common " * 3, None, 0.5)])
    none = spark.createDataFrame([], "src string, dst string")
    assert [r.id for r in retrieval.search(docs, none, ["widget"]).collect()] == ["a"]
    same = corpus(spark, [("y", "kept word", None, 0.5), ("x", "kept word", None, 0.5), ("z", "kept word", None, 0.9)])
    assert [r.id for r in retrieval.search(same, none, ["kept"]).collect()] == ["z", "x", "y"]
    with pytest.raises(ValueError):
        retrieval.search(docs, none, [])


def test_hops_decay_and_end(spark):
    docs = corpus(spark, [(x, "kryptonite" if x == "s" else "other", None, 0.5) for x in "sabc"])
    edges = spark.createDataFrame([(x, y) for x, y in ("sa", "as", "ab", "ba", "bc", "cb")], "src string, dst string")
    got = {r.id: r.graph for r in retrieval.graph_scores(retrieval.seeds(retrieval.normalised(retrieval.bm25(docs, ["kryptonite"]), "lex")), edges).collect()}
    assert got == {"a": 0.5, "b": 0.25}


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    reach = links.closure(edges)
    assert {(r.src, r.dst) for r in reach.collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"), ("c", "d"), ("d", "e"), ("c", "e")}
    assert {r.id for r in links.cyclic(reach).collect()} == {"a", "b"}


def test_columns_list_their_values_where_there_are_few(spark):
    rows = [(i, str(i % 13), ["b", "a", None][i % 3], None) for i in range(39)]
    got = profile.profile_columns(spark.createDataFrame(rows, "id int, many string, few string, none string"))
    assert {r.field: r["values"] for r in got.collect()} == {"id": None, "many": None, "few": ["a", "b"], "none": None}
    few = profile.profile_columns(spark.createDataFrame(rows, "id int, many string, few string, none string"), 13)
    assert {r.field: r["values"] for r in few.collect()} == {"id": None, "many": sorted(map(str, range(13))), "few": ["a", "b"], "none": None}


def test_all_columns_of_the_customers_are_profiled(spark):
    from larkspur import queries as Q

    sf = "/root/testdata/sf0.001"
    got = {r.field: r["values"] for r in Q.prof_columns(spark, sf).collect()}
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    assert set(got) == set(customers.columns)
    assert got["c_mktsegment"] == sorted(r[0] for r in customers.select("c_mktsegment").distinct().collect())


def test_log_templates(spark):
    lines = [(i, f"2026-01-01 10:00:0{i % 10} INFO took {i}ms from 10.0.0.{i % 9}") for i in range(30)] + [(30 + i, f"ERROR 0x{i:x}f failed") for i in range(5)]
    got = profile.log_templates(spark.createDataFrame(lines, "pos int, line string")).orderBy(F.desc("n")).collect()
    assert [(r.n, r.template) for r in got] == [(30, "<TS> INFO took <N>ms from <IP>"), (5, "ERROR <HEX> failed")]


def test_secrets(spark):
    rows = spark.createDataFrame([("password = hunter22x",), ("AKIA" + "A" * 16,), ("a token of thanks",)], "t string")
    assert [r.x for r in rows.select(X.secrets(F.col("t")).alias("x")).collect()] == [["credential assignment"], ["aws access key id"], []]


def test_lease_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0.0, "a", 10.0), ("r", 5.0, "b", 10.0), ("r", 6.0, "a", 10.0), ("r", 16.0, "b", 1.0)], "resource string, at double, owner string, ttl double")
    want = [True, False, True, True]
    assert [r.granted for r in dispatch.leases_batch(rows).orderBy("at").collect()] == want
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = dispatch.leases(stream).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.granted for r in spark.sql("select * from leases order by at").collect()] == want
