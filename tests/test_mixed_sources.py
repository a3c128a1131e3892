import json

from pyspark.sql import functions as F


def test_each_file_is_read_by_its_own_signs(spark, tmp_path):
    from larkspur.sources.mixed import first_of_ids, read_mixed

    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    files = {
        "a.json": json.dumps([{"id": "1", "n": 1}, {"id": "2", "n": 2}], indent=1), "b.json": '{"agents": [{"id": "3", "n": 3}], "n": 0}', "c.json": '{"id": "4", "n": 4}', "d.jsonl": '{"id": "5", "n": 5}\n\n{"id": "6"}\n[1]\n',
        "e.csv": 'id,n\r\n7,7\r\n"8, a","8"\r\n', "deep/f f.csv": "\n n ; id ;x\n9;a;z\nbad;b;z\n", "g.tsv": "id\tn\n\"q \"\"q\"\"\"\t10\n", "h.txt": "id|n\nh|11", "i.json": "{broken\n{", "j.csv": "", "k.csv": "other\nx\n", "l.json": "﻿[{\"id\": \"1\", \"n\": 99}]",
    }
    for name, text in files.items():
        (d / name).write_text(text, newline="")
    got = read_mixed(spark, str(d), "id string, n int")
    said = sorted(((r.file.rsplit("/", 1)[1].replace("%20", " "), r.kind, r.id, r.n) for r in got.collect()), key=str)
    assert said == sorted([
        ("a.json", "json", "1", 1), ("a.json", "json", "2", 2), ("b.json", "json", "3", 3), ("c.json", "json", "4", 4), ("d.jsonl", "jsonl", "5", 5), ("d.jsonl", "jsonl", "6", None), ("e.csv", "csv", "7", 7), ("e.csv", "csv", "8, a", 8),
        ("f f.csv", "csv", "a", 9), ("f f.csv", "csv", "b", None), ("g.tsv", "csv", 'q "q"', 10), ("h.txt", "csv", "h", 11), ("k.csv", "csv", None, None), ("l.json", "json", "1", 99),
    ], key=str)
    assert sorted((r.id, r.n) for r in first_of_ids(got.where("id is not null")).where("id < '5'").collect()) == [("1", 1), ("2", 2), ("3", 3), ("4", 4)]
    assert read_mixed(spark, str(d), "id string, n int", only="*.tsv").count() == 1


def test_large_files_of_lines_are_split(spark, tmp_path):
    from larkspur.sources.mixed import read_mixed

    d = tmp_path / "in"
    d.mkdir()
    n = 20_000
    (d / "a.jsonl").write_text("".join(json.dumps({"id": str(i), "n": i}) + "\n" for i in range(n)))
    (d / "b.csv").write_text("n;id\n" + "".join(f"{i};x{i}\n" for i in range(n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        got = read_mixed(spark, str(d), "id string, n int")
        assert spark.read.text(str(d)).rdd.getNumPartitions() > 8
        assert got.groupBy("kind").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.count_distinct("id").alias("i")).where(f"c = {n} and i = {n} and s = {n * (n - 1) // 2}").count() == 2
        placed = [r.n for r in got.where("kind = 'csv'").orderBy("place").select("n").collect()]
        assert placed == list(range(n))
    finally:
        spark.conf.set(key, before)


def test_the_quick_rubric_is_the_rubric(spark):
    from larkspur.operators import library as L

    words = ["You are the Clerk", "YOUR ROLE is", "## SCOPE", "scope", "out of ſcope", "route to", "doİng", "Never İnvent", "never invent", "don't guess", "[RETRIEVED]", "cite the source", "with a document name", "response format", "level 0 no tools", "match effort to the", "at most 3 calls", "wait for my approval", "gap taßle", "self-check", "use Big Thing instead", "toK", "hallucinated", "before delivery: verify", "\n##", "x", "nothing iſ invented"]
    rows = [(i, None if i % 11 == 0 else " ".join(words[(i * k) % len(words)] for k in range(1, 4)), None if i % 7 == 0 else "\n".join(words[(i * 5 + k) % len(words)] for k in range(2))) for i in range(200)]
    rows += [(900, "text\n##", "SCOPE"), (901, "level 0", "no tools"), (902, None, None), (903, "if a", "use The Big"), (904, "", "## SCOPE")]
    df = spark.createDataFrame(rows, "id long, systemPrompt string, description string")
    plain = L.craft_bits(F.col("systemPrompt"), F.col("description"))
    want = df.select("id", *[bit.alias(k.lower()) for k, bit in plain.items()])
    got = L.with_craft(df).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(*[F.count_if(F.col(k) == 1).alias(k) for k in "abcdefg"]).first().asDict().values() and all(want.agg(*[F.max(k).alias(k) for k in "abcdefg"]).first())
