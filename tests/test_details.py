from pyspark.sql import functions as F

from inkloom.functions import numbers, pagemeta, rules
from inkloom.plans import render
from inkloom.sources import feeds
from inkloom.streaming import progress


def test_escapes():
    assert pagemeta.unescaped(r"\x26lt;b\x26gt; a\nb\t") == "<b> a\nb"
    assert pagemeta.unescaped(None) is None and pagemeta.unescaped("") == ""


def test_json_behind_a_marker(spark):
    df = spark.createDataFrame([(1, 'x S = {"a": "}{", "b": [1]}; {'), (2, "S = nonsense S = [1]"), (3, None), (4, "none")], "id int, t string")
    got = {r["id"]: r["json"] for r in pagemeta.json_after(df, id_col="id", text_col="t", marker="S =").collect()}
    assert got == {1: '{"a": "}{", "b": [1]}', 2: "[1]", 3: None, 4: None}


def test_rules_prefer_priority_then_platform(spark):
    df = spark.createDataFrame([("a", "<h1> X <b>y</b></h1><i>z</i>"), ("b", "<i>z</i>"), ("b", None)], "p string, h string")
    table = (rules.Rule("*", "f", 2, "<i>(.*?)</i>"), rules.Rule("a", "f", 1, "<h1>(.*?)</h1>"))
    assert [r["f"] for r in rules.extract(df, table, "h", "p").collect()] == ["X y", "z", None]


def test_counters_and_tabs(spark):
    one = spark.range(1)
    e = one.select(pagemeta.engagement(F.lit("var read_num = '12'; like_count: ''; copyright_stat=1")).alias("e")).head()["e"]
    assert e["read_num"] == 12 and e["like_count"] == 0 and e["is_original"]
    tabs = [("文章 1.2万", 12000), ("文章 0.9万", None), ("文章 8,634", 8634), ("文章", None), (None, None)]
    assert [one.select(numbers.declared_count(F.lit(t).cast("string")).alias("n")).head()[0] for t, _ in tabs] == [n for _, n in tabs]


def test_truncation_links(spark):
    texts = ['<p>x <a href="/1">全文</a></p> ', '<a href="/1">全文</a> y', "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    assert [r[0] for r in df.select(pagemeta.is_truncated(F.col("h"))).collect()] == [True, False, False, None]


def test_units_are_checked_before_they_are_joined(spark):
    df = spark.range(30).withColumn("u", F.lit("x")).withColumn("section", F.col("id").cast("string"))
    try:
        render.unit_documents(df, ["u"], "id", "section", max_rows=10)
        raise AssertionError("no error")
    except ValueError:
        pass
    assert render.unit_documents(df, ["u"], "id", "section").head()["document"].startswith("0\n\n1\n\n2")


def test_windows_and_sessions(spark):
    rows = [(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 2.0), (1, "2024-01-01 03:00:00", 4.0), (2, "2024-01-01 00:10:00", 8.0)]
    df = spark.createDataFrame(rows, "k int, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    w = progress.windowed(df, "at", "1 hour", "1 hour", None, ["k"], "v")
    assert sorted((r["k"], r["n"], r["total"]) for r in w.collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]
    s = progress.sessions(df, "at", "1 hour", "1 hour", "k")
    assert sorted((r["k"], r["n"]) for r in s.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_feeds_state_and_listing(spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed><entry><title>T &amp; U</title><link href="u1"/><updated>2024</updated></entry><entry><title>V</title><id>u2</id></entry></feed>')
    assert [tuple(r) for r in feeds.read_atom(spark, str(tmp_path / "feed.xml")).orderBy("link").collect()] == [("T & U", "u1", "2024"), ("V", "u2", None)]
    (tmp_path / "state.json").write_text('{\n "page": 3,\n "done": ["a", "b"]\n}')
    assert feeds.read_state(spark, str(tmp_path / "state.json"), "page int, done array<string>").head().asDict() == {"page": 3, "done": ["a", "b"]}
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "B.txt").write_text("xy")
    assert [(r["name"], r["length"]) for r in feeds.listing(spark, str(tmp_path)).collect() if r["name"] in ("B.txt", ".hidden")] == [("B.txt", 2)]
