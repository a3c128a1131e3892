import threading

import pytest
from pyspark.sql import functions as F

from larkspur.sources.versioned import Conflict, Store, update

TODAY = "date'2025-01-10'"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.current().number == 0
    one = store.commit(store.current(), {"a": spark.range(3), "b": spark.range(5)}, {"by": "x"})
    two = store.commit(one, {"a": spark.range(7)})
    assert (two.number, store.table("a").count(), store.table("b").count(), store.version(1).note) == (2, 7, 5, {"by": "x"})
    assert store.table("a", store.version(1)).count() == 3
    # a writer dies between its tables: nothing changes, and what it left is swept up
    store.stage({"a": spark.range(1)})
    with pytest.raises(Exception):
        store.commit(two, {"a": spark.range(2), "b": spark.range(2).select(F.raise_error(F.lit("dead")).alias("id"))})
    assert store.current() == two and store.table("a").count() == 7
    assert store.sweep() == [] and len(store.sweep(0)) == 3 and store.sweep(0) == []
    assert (store.table("a").count(), store.table("b").count()) == (7, 5)
    with pytest.raises(Conflict):
        store.commit(one, {"a": spark.range(9)})
    assert store.sweep(0) == []


def test_of_racing_writers_one_wins_each_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = store.commit(store.current(), {"n": spark.range(0)})
    won, lost = [], []

    def write(k):
        try:
            won.append(store.commit(base, {"n": spark.range(k)}).number)
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [2] and len(lost) == 3
    # with update() each is asked anew, so none is lost
    threads = [threading.Thread(target=update, args=(store, lambda s, at: ({"n": s.table("n", at).union(s.spark.range(1))}, {}))) for _ in range(3)]
    before = store.table("n").count()
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.table("n").count() == before + 3 and store.current().number == 5


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def proposals(spark, *many):
    rows = [(name, f"chg-{name}", "r", k, op, path, want, content, "pending", None) for name, ops in many for k, (op, path, want, content) in enumerate(ops)]
    from larkspur.operators.evolution import PROPOSALS

    return frame(spark, rows, PROPOSALS)


def test_proposals_on_probation(spark, tmp_path):
    from larkspur.operators import evolution as E

    store = Store(spark, str(tmp_path / "s"))
    files = frame(spark, [("w/a", "old"), ("w/b", "b")], E.FILES)
    asked = proposals(spark, ("1", [("write", "w/a", "0" * 64, "x")]), ("2", [("write", "w/a", sha("old"), "new"), ("delete", "w/b", sha("b"), None), ("write", "w/c", "absent", "c")]), ("3", [("write", "w/a", sha("old"), "late")]))
    E.begin_store(store, files, asked)
    take = lambda: E.apply_one(store, ["w/*"], [])
    got = take()
    assert (got["status"], got["reason"]) == ("rejected", "stale hash")
    assert take()["status"] == "applied"
    assert rows_of(store.table("files")) == [("w/a", "new"), ("w/c", "c")]
    assert take() == {"status": "blocked", "reason": "active_probation"}
    ended = E.evaluate(store, 2, ["t1", "t2"])
    assert (ended["status"], ended["reason"]) == ("reverted", "probation_failed:chg-2:t1,t2")
    assert rows_of(store.table("files")) == [("w/a", "old"), ("w/b", "b")]
    assert take() == {"status": "blocked", "reason": "circuit_open"}
    E.close_circuit(store)
    assert take()["status"] == "applied" and E.evaluate(store, 1, [])["status"] == "promoted"
    assert E.evaluate(store, 1, [])["status"] == "no_active_probation" and take()["status"] == "no_proposal"
    assert rows_of(store.table("files")) == [("w/a", "late"), ("w/b", "b")]


def test_a_hash_that_goes_stale_before_the_commit_is_refused(spark, tmp_path, monkeypatch):
    from larkspur.operators import evolution as E

    store = Store(spark, str(tmp_path / "s"))
    E.begin_store(store, frame(spark, [("w/a", "old")], E.FILES), proposals(spark, ("1", [("write", "w/a", sha("old"), "mine")])))
    real, raced = Store.commit, []

    def late(self, base, tables, note=None):
        if not raced:  # another writer changes the file in between
            raced.append(real(self, base, {"files": frame(spark, [("w/a", "theirs")], E.FILES)}))
        return real(self, base, tables, note)

    monkeypatch.setattr(Store, "commit", late)
    got = E.apply_one(store, ["w/*"], [])
    assert (got["status"], got["reason"]) == ("rejected", "stale hash") and rows_of(store.table("files")) == [("w/a", "theirs")]


def test_all_skipped_is_no_pass_and_history_is_short(spark, tmp_path, monkeypatch):
    from larkspur.operators import evolution as E

    monkeypatch.setattr(E, "HISTORY", 1)
    store = Store(spark, str(tmp_path / "s"))
    E.begin_store(store, frame(spark, [("w/a", "0")], E.FILES), proposals(spark, *[(str(k), [("write", "w/a", sha(str(k)), str(k + 1))]) for k in range(2)]))
    E.apply_one(store, ["w/*"], [])
    assert E.evaluate(store, 1, [])["status"] == "promoted"
    E.apply_one(store, ["w/*"], [])
    assert E.evaluate(store, 0, [])["reason"] == "probation_failed:chg-1:all_skipped"
    assert rows_of(store.table("probation").select("state", "change_id")) == [("circuit_open", "chg-1"), ("reverted", "chg-1")]


def test_repair_to_a_fixed_point(spark, tmp_path):
    from larkspur.operators import evolution as E
    from larkspur.operators import health

    store, now = Store(spark, str(tmp_path / "s")), F.lit("2025-01-10").cast("timestamp")
    old, new = "2020-01-01", "2025-01-09"
    files = [("tmp/a.log", "x", old), ("tmp/deep/b.log", "x", old), ("tmp/c.log", "x", new), ("long.md", "1\n2\n3", new), ("scripts/tick.py", "x", old)]
    files = frame(spark, files, "path string, content string, modified string").withColumn("modified", F.to_timestamp("modified"))
    snapshots = frame(spark, [(1, "core.md", "first"), (2, "core.md", "second"), (1, "long.md", "1")], "snapshot_id long, path string, content string")
    store.commit(store.current(), {"files": files, "snapshots": snapshots, "runs": frame(spark, [], "run_no long, rule string")})
    made = health.glob_rules([("logs", "files_older_than", "tmp/**/*.log", 86_400), ("core", "file_exists", "core.md", 0), ("long", "max_line_count", "long.md", 2), ("keep", "files_older_than", "scripts/*", 1), ("tell", "glob_nonempty", "tmp/*", 0)])
    repairs = {"logs": "delete_matching", "core": "restore_from_snapshot", "long": "restore_from_snapshot", "keep": "delete_matching", "tell": "report_only"}
    rules = frame(spark, [(*r, repairs[r[0]]) for r in made], "id string, check string, pattern string, regex string, arg double, repair string")
    protected = health.immutable_patterns([], health.HEAL_FLOOR)
    told = E.repair(store, rules, now, protected)
    assert [(t["fired"], t["changed"]) for t in told] == [(["core", "logs", "long"], 4), ([], 0)]
    assert told[0]["statuses"] == {"repaired": 4, "refused_immutable": 1, "reported": 2}
    assert rows_of(store.table("files").select("path", "content")) == [("core.md", "second"), ("long.md", "1"), ("scripts/tick.py", "x"), ("tmp/c.log", "x")]
    assert rows_of(store.table("snapshots").where("snapshot_id = 1 and path like 'tmp%'").select("path")) == [("tmp/a.log",), ("tmp/deep/b.log",)]
    # a repair that never helps is held back after three runs in a row
    stuck = frame(spark, [(*health.glob_rules([("lost", "file_exists", "none.md", 0)])[0], "restore_from_snapshot")], "id string, check string, pattern string, regex string, arg double, repair string")
    for want in ({"repaired": 1}, {"repaired": 1}, {"repaired": 1}, {"quarantined_oscillation": 1}):
        assert E.repair(store, stuck, now, protected)[0]["statuses"] == want


def test_a_clean_run_ends_quarantine(spark):
    from larkspur.operators.changes import quarantined

    fired = frame(spark, [(1, "r"), (2, "r"), (4, "r"), (1, "s"), (2, "s"), (3, None), (4, "s")], "run_no long, rule string")
    assert quarantined(fired).count() == 0
    assert rows_of(quarantined(fired.where("rule is not null"), runs=spark.range(1, 5).withColumnRenamed("id", "run_no"))) == []
    assert rows_of(quarantined(fired.where("run_no < 3"), last=2)) == [("r",), ("s",)]
    assert quarantined(fired.where("run_no < 3")).count() == 0


@pytest.mark.parametrize("pattern,crosses,yes,no", [
    ("Memory/**/*.md", False, ["Memory/a.md", "Memory/x/a.md", "Memory/x/y/a.md"], ["Memory/a.txt", "Other/a.md", "Memory/a.md\n"]),
    ("d/[abc]?.py", True, ["d/a1.py", "d/c/.py"], ["d/d1.py", "d/a1.py\n"]), ("d/[!a-c].py", False, ["d/x.py"], ["d/a.py", "d//.py"]),
    ("a[", True, ["a["], ["a"]), ("*.md", True, ["x/y.md", "x\ny.md"], ["x.mdx"]), ("*.md", False, ["y.md"], ["x/y.md"]), ("x/**", False, ["x/a", "x/a/b"], ["y/a"]), ("[]]", True, ["]"], ["x"]),
])
def test_globs(spark, pattern, crosses, yes, no):
    from larkspur.functions.text import glob_to_regex

    df = frame(spark, [(p,) for p in yes + no], "p string")
    assert {r.p for r in df.where(F.col("p").rlike(glob_to_regex(pattern, crosses))).collect()} == set(yes)


BODY = "- **Type:** Gotcha · **Confidence:** HIGH · **Salience:** {salience} · **Created:** 2024-01-01 · **Last-Access:** 2024-01-02 · **Freq:** 0\n- **Tags:** #x\n- **Links:** -\n- **Provenance:** p\n- **Observation:** seen once\n- **Directive:** do it\n"


def test_notes_in_two_tiers(spark, tmp_path):
    from larkspur.operators import note_store as N

    today = F.expr(TODAY)
    store = Store(spark, str(tmp_path / "s"))
    N.begin_notes(store)
    make = lambda nid, title, category="lessons", body=BODY.format(salience="0.9"): N.create_note(store, nid, title, category, body, today)
    assert make("MEM-2025-0001", "First: one!") == {"status": "written", "path": "Memory/lessons/MEM-2025-0001-first-one.md"}
    assert rows_of(store.table("memory")) == [(0, "MEM-2025-0001", "First: one! — demoted to L3", "- **Stub.** HIGH. do it Full note: `Memory/lessons/MEM-2025-0001-first-one.md`")]
    assert store.table("archive").first().text.startswith("# MEM-2025-0001 — First: one!\n\n- **Type:** Gotcha")
    assert [make(*a)["reason"] for a in (("MEM-2025-0001", "again"), ("bad", "x"), ("MEM-2025-0002", "x", "other"))] == ["id exists", "id", "category"]
    assert "confidence" in make("MEM-2025-0003", "x", body=BODY.replace("HIGH", "SURE").format(salience="0.9"))["reason"]
    number = store.current().number
    item = {"date": "2025-01-02", "stance": "SUPPORT", "source": "s", "quote": "q"}
    path = "Memory/lessons/MEM-2025-0001-first-one.md"
    add = lambda nid="MEM-2025-0001", where=path, **more: N.append_evidence(store, nid, item | more, today, where)
    assert add()["status"] == "written" and store.table("archive").first().text.count("**Evidence:**") == 1
    assert [add()["reason"], add(where=None)["reason"], add(where="Memory/x.md")["reason"], add("MEM-2025-0009")["reason"], add(where="Memory/_archive/x.md")["reason"], add(date="2026-01-01")["reason"]] == ["duplicate", "stub", "not found", "heading does not match", "archived", "future date"]
    assert store.current().number == number + 1


def test_distilling_needs_a_snapshot(spark, tmp_path):
    from larkspur.operators import note_store as N

    today, nid, path = F.expr(TODAY), "MEM-2025-0005", "Memory/lessons/MEM-2025-0005-old.md"
    store = Store(spark, str(tmp_path / "s"))
    N.begin_notes(store, frame(spark, [(4, nid, "Old", BODY.format(salience="0.4")), (5, "MEM-2025-0006", "New", BODY.format(salience="0.2"))], N.MEMORY))
    go = lambda snap="s1", which=nid, seen="seen in short": N.distil(store, snap, which, "lessons", seen, today)
    assert [go()["reason"], go(which="MEM-2025-0006")["reason"], go(seen="a\nb")["reason"], go(which="MEM-2025-0007")["reason"]] == ["no snapshot", "action DELETE", "observation", "not exactly one note"]
    assert N.take_snapshot(store, "s0", [])["status"] == "written" and go("s0")["reason"] == "path not reserved"
    assert N.append_evidence(store, nid, {"date": "2025-01-02", "stance": "SUPPORT", "source": "s", "quote": "q"}, today)["status"] == "written"
    assert go("s0")["reason"] == "stale snapshot"
    N.take_snapshot(store, "s1", [path])
    assert go() == {"status": "written", "path": path}
    assert rows_of(store.table("memory").select("pos", "id")) == [(4, nid), (5, "MEM-2025-0006")]
    text = store.table("archive").first().text
    assert "**Observation:** seen in short\n" in text and "**Evidence:**" in text and go()["reason"] == "stub"
