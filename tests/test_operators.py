import json

import pytest
from pyspark.sql import functions as F

from inkloom.operators import batches, bridges, dedup, votes
from inkloom.operators.skew import salted_lookup
from inkloom.sources import jsonl, paged, sinks
from inkloom.session import fresh_path, written


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 4), (None, 3), ("b", 5)], "k string, ord int")
    assert sorted(r["ord"] for r in dedup.first_wins(df, ["k"], ["ord"]).collect()) == [1, 3, 5]


def test_exact_classes_tell_null_from_empty(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, None)], "id int, v string")
    assert sorted((r["first"], r["n"]) for r in dedup.exact_classes(df, "v", "id").collect()) == [(1, 2), (3, 1), (4, 1)]


def test_votes_prefer_the_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4)], "v string, ord int")
    assert votes.top_value(df, "v", "ord").head().asDict() == {"value": "b", "n": 2, "n_values": 2}


@pytest.mark.parametrize("n", [0, 1, 50, 501])
def test_numbered(spark, n):
    df = spark.range(n).withColumn("x", F.lit(n) - F.col("id")).repartition(7)
    got = [r["rn"] for r in batches.numbered(df, ["x"], "rn").orderBy("x").collect()]
    assert got == list(range(1, n + 1))


def test_range_slice_beyond_the_end(spark):
    assert batches.range_slice(spark.range(10), "id", 11, 20).count() == 0
    assert [r["id"] for r in batches.range_slice(spark.range(10), "id", 3, 4).collect()] == [2, 3]


def test_units_partition_the_input(spark):
    df = spark.range(230).withColumn("u", F.when(F.col("id") < 200, "big").otherwise("small"))
    got = batches.units(df, "u", ["id"], above=80, size=50)
    assert got.count() == 230
    assert {(r["u"], r["part"]): r["count"] for r in got.groupBy("u", "part").count().collect()} == {("big", 0): 50, ("big", 1): 50, ("big", 2): 50, ("big", 3): 50, ("small", 0): 30}


def test_salted_lookup_matches_a_plain_join(spark):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    lookup = facts.select("k").distinct().withColumn("v", F.concat(F.lit("v"), F.coalesce("k", F.lit("null"))))
    sizes = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = salted_lookup(facts, lookup, ["k"], sizes, F.xxhash64("id"))
    assert got.count() == 5000
    assert got.filter("v is null or v <> concat('v', coalesce(k, 'null'))").count() == 0


def test_many_names_take_the_shuffle(spark):
    names = spark.createDataFrame([(n,) for n in ("Ab", "abcd", "c", "", None, "数据库", "据", "x" * 300, "Ab")], "name string")
    queries = spark.createDataFrame([(q, i) for i, q in enumerate(["ABC", "zabcdz", "", None, "大数据库", "xx", "b", "ABC"])], "q string, i int")
    few = sorted((r["q"], r["i"], r["name"]) for r in bridges.contains_either_way(queries, names, "q", "name", max_names=100).collect())
    many = sorted((r["q"], r["i"], r["name"]) for r in bridges.contains_either_way(queries, names, "q", "name", max_names=2).collect())
    truth = sorted((q["q"], q["i"], n["name"]) for q in queries.collect() for n in names.collect() if q["q"] and n["name"] and (q["q"].lower() in n["name"].lower() or n["name"].lower() in q["q"].lower()))
    assert few == many == truth and truth


def test_relay_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u1", "title": "first", "raw_html": "<p>"}\nbroken\n{"url": " u1 ", "title": "second", "raw_html": "x"}\n{"title": "no url"}\n{"url": "u2", "is_failed": true, "raw_html": "x"}\n')
    rows = jsonl.read_relay(spark, str(tmp_path))
    assert sorted((r["url"], r["title"]) for r in rows.collect()) == [("u1", "first"), ("u2", None)]
    assert jsonl.usable(rows).count() == 1 and jsonl.line_count(spark, str(tmp_path)) == 5


def test_paged_source_and_its_stream(spark, tmp_path):
    def page(n, ids):
        (tmp_path / f"page-{n:06d}.jsonl").write_text("".join(json.dumps({"id": i, "url": f"u{i}", "title": "t"}) + "\n" for i in ids) + "{bad\n")

    paged.register(spark)
    page(1, "ab")
    page(2, "bc")
    assert sorted(r["id"] for r in spark.read.format("paged").load(str(tmp_path)).collect()) == list("abbc")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        spark.readStream.format("paged").load(str(tmp_path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert run() == list("abbc")
    page(3, "d")
    assert run() == list("abbcd")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, "s1", "x"), ("u", 2, "s2", " "), ("v", 1, "s3", "y")], "unit string, n int, section string, url string")
    sinks.write_sections(df, str(tmp_path / "s"), "section", ["unit"], "n")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect() if r["value"]) == ["s1", "s2", "s3"]
    sinks.write_links(df, str(tmp_path / "l"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "l")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"), ["unit"])
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_written_cuts_lineage(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString().replace("FileScan parquet", "Scan parquet")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
