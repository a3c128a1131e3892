"""Operators without an exact twin in SQL, and readers and writers, against plain versions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F


def test_digest_keeps_what_it_cuts(spark):
    from larkspur.operators.digest import json_digest, kept_parts

    values = [{"a": [{"x": i, "y": "s" * 5, **({"z": None} if i % 2 else {})} for i in range(20)], "t": "w" * 300, "n": [1, 2]}, [1.5, "a", None, True, "b"], [[1], 2, 3, {"k": 1}, 5], "short"]
    texts = [json.dumps(v) for v in values] + ["\n".join(json.dumps({"i": i}) for i in range(7)), "no json", ""]
    got = {r.id: r for r in json_digest(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    first = json.loads(got[0].digest)
    assert first["a"]["__crushed"] == "array<object>[20]" and json.loads(got[0].kept[first["a"]["ref"]]) == values[0]["a"]
    assert first["a"]["schema"] == {"x": {"type": "int", "unique": 20, "min": 0, "max": 19}, "y": {"type": "str", "unique": 1, "values": ["sssss"]}, "z": {"type": "null", "nulls": 20, "missing": 10}}
    assert first["t"] == "w" * 240 + "... <+60 chars ref=S1>" and got[0].kept["S1"] == "w" * 300 and first["n"] == [1, 2]
    assert json.loads(got[1].digest)["profile"] == {"type": "bool|float|str", "nulls": 1, "unique": 4, "values": [True, 1.5, "a", "b"]}
    assert json.loads(got[2].digest)["types"] == ["array", "int", "object"] and json.loads(got[3].digest) == "short"
    assert [got[i].kind for i in range(7)] == ["json"] * 4 + ["jsonl", None, None]
    deep = "1"
    for _ in range(14):
        deep = f'{{"d": {deep}}}'
    assert "<depth-limit>" in json_digest(spark.createDataFrame([(0, deep)], "id long, text string")).first().digest
    parts = kept_parts(json_digest(spark.createDataFrame([(0, texts[0])], "id long, text string")))
    assert {r.ref for r in parts.collect()} == {"J1", "S1"}


def plain_digest(value, kept, depth=0):
    """A digest by its definition: what each value becomes, with the reference of what is cut."""

    def keep(kind, payload):
        name = f"{kind}{sum(k[0] == kind for k in kept) + 1}"
        kept[name] = payload
        return name

    def name_of(x):
        return {bool: "bool", int: "int", float: "float", str: "str", list: "array", dict: "object", type(None): "null"}[type(x)]

    def profile(values, n):
        real = [v for v in values if v is not None]
        out = {"type": "|".join(sorted({name_of(v) for v in real})) or "null"} | ({"nulls": n - len(real)} if n > len(real) else {})
        if real and not any(isinstance(v, (dict, list)) for v in real):
            few = sorted({(name_of(v), json.dumps(v)) for v in real})
            out["unique"] = len(few)
            if len(few) <= 12:
                out["values"] = [json.loads(v) for _, v in few]
            elif {k for k, _ in few} <= {"int", "float"}:
                out |= {"min": min(real), "max": max(real)}
            elif {k for k, _ in few} == {"str"}:
                out |= {"len": f"{min(map(len, real))}..{max(map(len, real))}", "sample": real[0][:60]}
        return out

    if depth > 12:
        return "<depth-limit>"
    if isinstance(value, str):
        return value if len(value) <= 240 else f"{value[:240]}... <+{len(value) - 240} chars ref={keep('S', value)}>"
    if isinstance(value, dict):
        return {k: plain_digest(value[k], kept, depth + 1) for k in sorted(value)}
    if not isinstance(value, list):
        return value
    if len(value) < 5:
        return [plain_digest(x, kept, depth + 1) for x in value]
    kinds, ref = sorted({name_of(x) for x in value}), keep("J", json.dumps(value))
    if set(kinds) & {"array", "object"}:
        body = {"types": kinds}
        if kinds == ["object"]:
            fields = sorted({k for x in value for k in x})
            body = {"schema": {k: profile([x[k] for x in value if k in x], len(value)) | ({"missing": sum(k not in x for x in value)} if any(k not in x for x in value) else {}) for k in fields}}
        return {"__crushed": f"array<{'object' if kinds == ['object'] else 'mixed'}>[{len(value)}]", "ref": ref, **body, "samples": [plain_digest(x, kept, depth + 1) for x in value[:2]]}
    return {"__crushed": f"array<scalar>[{len(value)}]", "ref": ref, "profile": profile(value, len(value)), "samples": value[:2]}


def test_digest_by_brute_force(spark):
    import random

    from larkspur.operators.digest import json_digest, kept_parts, read_back

    rng = random.Random(4)

    def value(depth):
        kind = rng.choice("snbwlllooo" if depth < 5 else "snbw")
        if kind == "l":
            many = rng.choice([0, 2, 5, 9, 30])
            same = rng.choice([lambda: rng.randrange(40), lambda: rng.choice("abc") * rng.randrange(9), lambda: {"k": rng.randrange(20), rng.choice("xyz"): rng.choice([None, "é\"\\\n", 1.5, True])}, lambda: value(depth + 1)])
            return [same() for _ in range(many)]
        if kind == "o":
            return {k: value(depth + 1) for k in rng.sample("bca é", rng.randrange(4))}
        return {"s": "text \" é", "n": rng.randrange(99), "b": rng.choice([True, None, 2.5]), "w": "long é " * 60}[kind]

    values = [value(0) for _ in range(60)] + [[], {}, [[]] * 5, [{}] * 6, [None] * 7, {"a": [{"b": [{"c": ["w" * 300] * 6}] * 5}] * 5}]
    got = {r.id: r for r in json_digest(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None), (-2, "[1"), (-3, "1 2")], "id long, text string")).collect()}
    for i, v in enumerate(values):
        kept = {}
        assert json.loads(got[i].digest) == plain_digest(v, kept)
        assert {k: json.loads(p) if k[0] == "J" else p for k, p in got[i].kept.items()} == {k: json.loads(p) if k[0] == "J" else p for k, p in kept.items()}
    assert [tuple(got[i])[1:] for i in (-1, -2, -3)] == [(None, None, {})] * 3
    parts = kept_parts(spark.createDataFrame([(1, "json", "x", {"J1": "[1]", "S1": "s"})], "id long, kind string, digest string, kept map<string,string>"))
    asked = spark.createDataFrame([(1, "J1"), (1, "J1"), (2, "S1")], "id long, ref string")
    assert sorted(map(tuple, read_back(parts, asked).collect())) == [(1, "J1", 2, "[1]"), (2, "S1", 1, None)]
    assert json_digest(spark.createDataFrame([], "id long, text string")).count() == 0


SOURCE = '''import os, sys
from a.b import c

@deco
class K(Base):
    """What K is.

    More."""

    def m(self, x: int = 1, *, y=None) -> int:
        helper(x)
        def inner():
            hidden()
        return self.n() + helper(y)

    async def n(self):
        pass

def helper(v):
    return K().m(v)
'''


def test_outline_calls_and_structure(spark):
    from larkspur.operators.code import call_graph, declarations, outline, structure, syntax

    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def x(:\n"), ("c.py", None)], "path string, text string")
    rows = {(r.path, r.name): r for r in outline(files).collect()}
    assert rows["a.py", ""].imports == ["os", "sys", "a.b"] and rows["a.py", ""].kind == "module"
    assert (rows["a.py", "K"].kind, rows["a.py", "K"].doc, rows["a.py", "K"].decorators) == ("class", "What K is.", ["deco"])
    m = rows["a.py", "K.m"]
    assert (m.signature, m.line, m.last, m.calls) == ("(self, x: int=1, *, y=None)", 10, 14, ["helper", "n"])
    assert rows["a.py", "K.n"].kind == "async def" and rows["a.py", "K.m.inner"].calls == ["hidden"]
    assert {(r.caller, r.callee) for r in call_graph(outline(files)).collect()} == {("K.m", "helper"), ("K.m", "K.n"), ("helper", "K"), ("helper", "K.m")}
    assert {r.path: (r.parses, r.line) for r in syntax(files).collect()} == {"a.py": (True, None), "b.py": (False, 1), "c.py": (True, None)}
    shown = files.select("path", declarations(F.col("text")).alias("d")).first().d
    assert shown[0] == "L5: class K(Base):" and len(shown) == 5
    pairs = spark.createDataFrame([(0, "x = 1", "x   =  1  # same"), (1, "x = 1", "def f(): pass"), (2, "x = (", "y")], "id long, a string, b string")
    got = {r.id: r for r in structure(pairs).collect()}
    assert (got[0].ratio, got[0].identical) == (1.0, True) and 0 < got[1].distance < 1 and not got[1].identical and got[2].ratio is None


def test_schema_violations(spark):
    from larkspur.operators.code import schema_violations

    schema = {"type": "object", "required": ["id", "n"], "properties": {"id": {"type": "string", "pattern": "^a"}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "k": {"type": "array", "items": {"enum": [1, 2]}}, "z": {"type": ["number", "null"]}}}
    rows = [(0, '{"id": "ab", "n": 3, "k": [1, 2], "z": null}'), (1, '{"id": "b", "n": 10.5}'), (2, '{"n": -1, "k": [1, 3]}'), (3, "[]"), (4, "{")]
    got = {r.id: r.violations for r in schema_violations(spark.createDataFrame(rows, "id long, instance string"), schema).collect()}
    assert got == {0: [], 1: ["/id: pattern", "/n: type"], 2: ["/: required id", "/n: minimum", "/k/1: enum"], 3: ["/: type"], 4: ["/: not JSON"]}


def test_projection_of_files(spark):
    from larkspur.operators.retrieval import project

    text = "# A title of MEM-2024-0001\ncreated: 2024-02-03\n**Salience:** 0.7\nsee MEM-2024-0002 and Memory/a/b.md, MEM-2024-0001"
    rows = {r.path: r for r in project(spark.createDataFrame([("/x/note.md", text), ("/x/MEM-2024-0009.md", "plain words")], "path string, text string")).collect()}
    r = rows["/x/note.md"]
    assert (r.title, r.created, r.salience, r.self_ids, r.mentions) == ("A title of MEM-2024-0001", datetime.date(2024, 2, 3), 0.7, ["MEM-2024-0001"], ["MEM-2024-0002", "Memory/a/b.md"])
    assert r.tokens.count("title") == 3
    r = rows["/x/MEM-2024-0009.md"]
    assert (r.title, r.created, r.salience, r.self_ids) == ("MEM-2024-0009", None, 0.5, ["MEM-2024-0009"])


def test_report_and_archival_documents(spark):
    from larkspur.operators import migration as M

    manifest = spark.createDataFrame([("a.md", "/Memory/x/a.md"), ("i.md", "/Memory/INDEX.md"), ("o.md", "/Memory/_archive/o.md"), ("g.md", "/Memory/gone.md")], "name string, path string")
    files = spark.createDataFrame([("a.md", "t"), ("i.md", "i"), ("o.md", "o")], "name string, text string")
    assert [tuple(r) for r in M.archival_documents(manifest, files).collect()] == [("/Memory/x/a.md", "t")]
    entities = spark.createDataFrame([("N1", "L2", "/MEMORY.md", 1, "A b!", "HIGH", False, False, 10), ("N2", "L2", "/MEMORY.md", 2, "A b!", "LOW", True, True, 9)], "id string, kind string, path string, pos int, title string, confidence string, valid boolean, labelled boolean, span_bytes int")
    decisions = spark.createDataFrame([("N1", "ARCHIVE", None, 0)], "id string, action string, reject string, added_bytes int")
    none = spark.createDataFrame([], "id string, path string")
    rows = M.plan(entities, decisions, none.select("id"), none.select("path"))
    sums = M.totals(rows, spark.createDataFrame([("x\ny",)], "text string"))
    assert tuple(sums.first()) == (3, 2, True)
    made = json.loads(M.report(rows, sums).first().report)
    assert list(made) == sorted(made) and made["rows"][0] == {"confidence": "HIGH", "delta_bytes": -10, "detail": "archive", "note_id": "N1", "path": "/MEMORY.md", "status": "ARCHIVE", "target_path": "Memory/_archive/evidence-migration/l2/N1-a-b.md"}
    assert made["rows"][1]["target_path"] is None


def test_probation_begins_one_at_a_time(spark):
    from larkspur.streaming.dispatch import begin_probation, next_item

    rows = [("b", 2, None), ("a", 1, None), ("z", 0, "promoted")]
    schema = "change_id string, started int, outcome string"
    assert [r.change_id for r in begin_probation(spark.createDataFrame(rows, schema)).collect()] == ["a"]
    assert begin_probation(spark.createDataFrame([*rows, ("c", 3, "active")], schema)).count() == 0
    items = spark.createDataFrame([("tasks", "1", 1, True)], "queue string, name string, priority int, readable boolean")
    assert next_item(items).count() == 1 and next_item(items, circuit_open=True).count() == next_item(items, lease_free=False).count() == 0


def test_index_is_read_only_if_valid(spark, tmp_path):
    from larkspur.operators import vectors as V

    rows = spark.createDataFrame([("a", "h", [1.0, 0.0]), ("b", "h", [0.0, 1.0])], "key string, content_hash string, embedding array<double>")
    mark = V.fingerprint("m", [b"config"])
    V.write_index(rows, str(tmp_path / "i"), "m", mark)
    assert {r.key for r in V.read_index(spark, str(tmp_path / "i"), "m", mark).collect()} == {"a", "b"}
    assert V.read_index(spark, str(tmp_path / "none"), "m", mark) is None and V.read_index(spark, str(tmp_path / "i"), "m", "other") is None
    assert V.read_index(spark, str(tmp_path / "i"), "n", mark) is None
    rows.limit(1).write.mode("overwrite").parquet(str(tmp_path / "i" / "vectors"))
    assert V.read_index(spark, str(tmp_path / "i"), "m", mark) is None


def test_files_are_read_and_written(spark, tmp_path):
    from larkspur.sources import files as S

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("A")
    (tmp_path / "m" / "INDEX.md").write_text("I")
    assert [r.text for r in S.read_corpus(spark, str(tmp_path / "m")).collect()] == ["A"]
    assert {r.content.decode() for r in S.read_tree(spark, str(tmp_path / "m")).collect()} == {"A", "I"}
    (tmp_path / "man.json").write_text('{"a.md": "/Memory/a.md"}')
    assert [tuple(r) for r in S.read_manifest(spark, str(tmp_path / "man.json")).collect()] == [("a.md", "/Memory/a.md")]
    assert S.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception):
        S.read_manifest(spark, str(tmp_path / "none.json"), required=True)
    (tmp_path / "c.jsonl").write_text('{"score": 1.5}\nbad\n{"score": "x"}\n\n{"score": 2}\n')
    assert sorted(r.score for r in S.read_calibration(spark, str(tmp_path / "c.jsonl")).collect()) == [1.5, 2.0]
    assert [(r.line, r.text) for r in S.bad_lines(spark, str(tmp_path / "c.jsonl")).collect()] == [(2, "bad")]
    assert S.read_jsonl(spark, str(tmp_path / "c.jsonl"), "score double").count() >= 2
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "c.jsonl"), "score double", strict=True).collect()
    (tmp_path / "t.csv").write_text("a;b\n1;2\n")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", "2")]
    (tmp_path / "agents.json").write_text('{"agents": [{"id": "1", "name": "x"}, {"id": "1", "name": "y"}]}')
    assert [r.name for r in S.read_agents(spark, str(tmp_path / "agents.json"), "id string, name string").collect()] == ["x"]
    (tmp_path / "snap.json").write_text('{"id": "snap-1", "created_at": "t", "files": {"a": "h", "b": "h"}}')
    assert [tuple(r) for r in S.read_snapshots(spark, str(tmp_path / "snap.json")).collect()] == [("snap-1", "t", "", 2)]
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int").coalesce(1)
    S.write_markdown_table(rows, str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md" / "head")).collect()] == ["| x | y |", "|---|---|"]
    assert {r.value for r in spark.read.text(str(tmp_path / "md" / "rows")).collect()} == {"| a\\|b | 1 |", "|  | 2 |"}
    S.write_csv(rows, str(tmp_path / "csv"), ["y"])
    assert {r.y for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"1", "2"}
    S.append_events(rows, str(tmp_path / "ev"))
    S.append_events(rows, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 4
    blobs = spark.createDataFrame([("abc", bytearray(b"x")), ("abc", bytearray(b"x")), ("bcd", bytearray(b"y"))], "sha256 string, content binary")
    S.write_blobs(blobs, str(tmp_path / "blobs"))
    assert {r.prefix for r in spark.read.parquet(str(tmp_path / "blobs")).collect()} == {"ab", "bc"} and spark.read.parquet(str(tmp_path / "blobs")).count() == 2


def test_order_statistics(spark):
    import random

    from larkspur.operators import order as O

    rng = random.Random(1)
    values = [rng.choice([5.0, rng.random() * 100]) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    for n in (1, 2, 1500, 2999, 3000):
        assert O.nth_smallest(rows, "x", spark.createDataFrame([(n,)], "n long")).first().value == known[n - 1]
    assert O.nth_smallest(rows, "x", spark.createDataFrame([(3001,)], "n long")).count() == 0
    pairs = [(rng.choice("ab") if rng.random() < 0.9 else None, i) for i in rng.sample(range(1000), 300)]
    got = {(r.g, r.i): r.previous for r in O.previous(spark.createDataFrame(pairs, "g string, i long"), "g", "i", width=50).collect()}
    assert got == {(g, i): max((j for h, j in pairs if h == g and j < i), default=None) for g, i in pairs}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from larkspur.operators.links import checkpointed

    context = N(master="spark://x", getConf=lambda: {}, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))))
    with pytest.raises(ValueError):
        checkpointed(N(sparkSession=N(sparkContext=context, conf={})))
