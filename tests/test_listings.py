"""Paging, completeness, script metadata, keyed tables and merged documents on small inputs."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import noise, numbers, pagemeta, text, urls
from inkloom.operators import batches, paging, reconcile, shape
from inkloom.operators.timestamps import TimestampDictionary
from inkloom.plans import problems, render
from inkloom.session import fresh_path, shared_dir
from inkloom.streaming import progress


def first(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).head()["y"]


def test_paging_stops_with_a_short_page_or_nothing_new(spark):
    rows = [("a", i, f"u{i}") for i in range(25)] + [("b", i, f"u{i % 10}") for i in range(40)] + [(None, 1, "u")]
    pages = paging.paged(spark.createDataFrame(rows, "owner string, ord int, url string"), "owner", ["ord"], 10)
    got = sorted((str(r["owner"]), r["page"], r["n_items"], r["n_new"], r["is_last"]) for r in paging.stopped(pages.filter("owner is not null"), "owner", "url", 10, 500).collect())
    assert got == [("a", 1, 10, 10, False), ("a", 2, 10, 10, False), ("a", 3, 5, 5, True), ("b", 1, 10, 10, False), ("b", 2, 10, 0, True)]
    capped = paging.stopped(pages.filter("owner = 'a'"), "owner", "url", 1, 2).collect()
    assert max(r["page"] for r in capped) == 2
    assert paging.stopped(pages.limit(0), "owner", "url", 10, 5).count() == 0


def test_missed_pages_and_cursors(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 1)], "owner string, page int")
    assert sorted(tuple(r) for r in paging.missed(seen, "owner").collect()) == [("a", 2), ("a", 3)]
    items = spark.createDataFrame([("a", p, k) for p, k in ((1, 9), (1, 8), (2, 5), (3, 2))], "owner string, page int, id int")
    got = sorted(tuple(r) for r in paging.cursors(items, "owner", "id").collect())
    assert got == [("a", 1, None, 8), ("a", 2, 8, 5), ("a", 3, 5, 2)]


def test_verdicts_with_a_limit(spark):
    declared = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9), ("d", 0), ("e", None), ("f", 1)], "k string, n int")
    found = spark.createDataFrame([(k,) for k, n in (("a", 3), ("b", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 2)) for _ in range(n)], "k string")
    got = {r["k"]: (r["verdict"], r["actual"], r["is_warned"]) for r in reconcile.declared_vs_actual(declared, found, "k", "n", limit=3).collect()}
    assert got == {"a": ("limited", 3, False), "b": ("equal", 2, False), "c": ("short", 1, True), "d": ("unknown", 1, False), "e": ("unknown", 1, False), "f": ("over", 2, False)}
    short = {r["k"]: (r["actual"], r["is_short"]) for r in reconcile.completeness_by_type(declared, found.filter("k <> 'c'"), ["k"], "n").collect()}
    assert short == {"a": (3, True), "b": (2, False), "c": (0, True), "f": (2, False)}


@pytest.mark.parametrize(
    ("page", "title", "author", "time"),
    [
        ("<script>var msg_title = 'A &amp; B';var nickname = \"Some one\"; var ct = \"1700000000\";</script><h1>No</h1>", "A & B", "Some one", "2023-11-15 06:13"),
        ('<meta property="og:title" content="T"><meta property="og:article:author" content="W"><script>var oriCreateTime = 1700000000</script>', "T", "W", "2023-11-15 06:13"),
        ('<h1>H</h1><a id="js_name"> Acc </a><em id="publish_time">2024-01-02</em>', "H", "Acc", "2024-01-02"),
        ('<p class="x profile_nickname y">Nick</p>', None, "Nick", None), ("", None, None, None), (None, None, None, None),
    ],
)
def test_metadata_in_scripts(spark, page, title, author, time):
    assert (first(spark, pagemeta.page_title, page), first(spark, pagemeta.page_author, page), first(spark, pagemeta.page_time, page)) == (title, author, time)


def test_url_variants(spark):
    html, url = "a?x=%41&amp;y=1 a?x=%41&y=1 a?x=A&y=1", "a?x=%41&y=1"
    got = spark.createDataFrame([(html, url)], "h string, u string").select(pagemeta.replace_variants(F.col("h"), F.col("u"), F.lit("L")).alias("r")).head()["r"]
    assert got == "L L L"


@pytest.mark.parametrize(("url", "want"), [(" https://m.h.example/post/a12/ ", "https://h.example/p/12"), ("//h.example/read?id=7&x=1", "https://h.example/p/7"), ("https://www.h.example/article/9.html#a", "https://h.example/p/9"), ("https://h.example/134", "https://h.example/p/134"), ("https://h.example/about", "https://h.example/about"), (None, None)])
def test_id_urls(spark, url, want):
    assert first(spark, urls.id_url, url) == want


def test_post_titles(spark):
    def made(line=None, card=None, article=False, user=None, quoted=None, body=None):
        row = spark.createDataFrame([(line, card, article, user, quoted, body)], "l string, c string, a boolean, u string, q string, b string")
        return row.select(text.post_title(*[F.col(c) for c in "lcauqb"], F.lit("k")).alias("t")).head()["t"]

    assert made("转发微博", user="Ann", body="<b>Long</b> text of the quoted post here") == "转发@Ann: Long text of the quoted p"
    assert made("Mine", user="Ann", body="Quoted") == "Mine // 转发@Ann: Quoted"
    assert made("Mine", user="Ann", quoted="Its title") == "转发@Ann: Its title"
    assert made("Line", "Card", True) == "Card" and made("Line", "Card") == "Line" and made(" ", "Card") == "Card" and made() == "微博_k"
    assert made("x" * 41) == "x" * 38 + "..." and made("x" * 40) == "x" * 40


@pytest.mark.parametrize("line", ["欢迎关注我的公众号", "觉得不错请点赞转发", "版权声明：作者所有", "分享：", "喜欢 12", "收藏(javascript:;)", "阅读┊12", "加载中，请稍候", "字体大小：大 中 小", "顶(3) 踩(1)", "• 博客等级：3", "写留言 (http://h/#write)", "扫码回复即可获取资料", "商务合作请联系我们"])
def test_noise_of_blog_pages(spark, line):
    assert first(spark, noise.filter_noise, f"The text.\n{line}\nMore.") == "The text.\nMore."


def test_noise_ends_a_text(spark):
    for line in ("前一篇：另一篇", "某某公司版权所有", "意见反馈与留言板"):
        assert first(spark, noise.filter_noise, f"The text.\n{line}\nMore.") == "The text."


def test_keyed_upsert_rewrites_touched_buckets_only(spark):
    path = fresh_path(spark, "test-upsert")
    apply = progress.keyed_upsert(path, F.col("k"), ["at"], buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    apply(batch([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x"), ("e", 1, "x")]), 0)
    apply(batch([("a", 2, "y"), ("b", 0, "old")]), 1)
    apply(batch([("a", 2, "y"), ("b", 0, "old")]), 1)  # repeated after a failure
    apply(batch([("a", 3, "z"), (None, 1, "n")]), 2)
    apply(batch([("a", 4, "w")]), 3)
    got = {r["k"]: r["v"] for r in progress.read_upserted(spark, path).collect()}
    assert got == {"a": "w", "b": "x", "c": "x", "d": "x", "e": "x", None: "n"}
    versions = progress._versions(spark, path)
    assert len(versions) <= 4 and max(v[-1] for v in versions.values()) == 3 and min(v[-1] for v in versions.values()) < 3 and all(len(v) <= 2 for v in versions.values())


def test_merged_documents_of_comments_and_bounds(spark):
    comment = "array<struct<nick_name string, content string, like_num bigint, create_time string, ip_region string, replies array<struct<nick_name string, content string>>>>".replace(" string", ": string").replace(" bigint", ": bigint").replace(" array<", ": array<")
    schema = f"unit string, n long, title string, url string, platform string, author string, publish_time string, content_markdown string, tags array<string>, read_num long, like_count long, old_like_count long, share_count long, comment_count long, comments {comment}"
    row = lambda n, title, c: ("u", n, title, "http://h/1", "p", "w", "2024", "Body", ["t"], 5, None, None, None, 1, c)
    df = spark.createDataFrame([row(2, None, None), row(1, "A [b]", [("Ann", "hi\nyou", 2, "1", "X", [("Bob", "yes")])])], schema)
    got = render.merged_markdown(df, ["unit"], "n", F.lit("# Head"), "> foot").head()["document"]
    assert got.startswith("# Head (2)\n\n- [1. A \\[b\\]](#1-a-b) `(2024)`\n- [2. ](#2) `(2024)`\n\n---\n\n<a id=\"1-a-b\"></a>")
    assert "> - **Ann** [X] +2：hi you\n>   - ↳ **Bob回复**：yes" in got and got.endswith("> foot") and got.count("> foot") == 2
    with pytest.raises(ValueError):
        render.merged_markdown(df, ["unit"], "n", F.lit("#"), "", max_rows=1)


def test_runs_and_names_of_hot_keys(spark):
    df = spark.createDataFrame([("k", i, i % 7 < 3) for i in range(50)] + [("none", 1, False)], "k string, i int, c boolean")
    assert {r["k"]: r["longest"] for r in batches.longest_runs(df, "k", ["i"], F.col("c")).collect()} == {"k": 3}
    names = spark.createDataFrame([(i, "f", "same") for i in range(30)] + [(99, "g", "same"), (100, "f", None)], "i int, folder string, name string")
    got = {r["i"]: r["name"] for r in batches.collision_names(names, ["folder"], "name", ["i"]).collect()}
    assert got[0] == "same" and got[29] == "same (29)" and got[99] == "same" and got[100] is None


def test_the_dictionary_of_times_is_kept_from_run_to_run(spark, smallest):
    path = f"{shared_dir(spark)}/kept-times"
    spark.conf.set(problems.DICTIONARY_CONF, path)
    try:
        once = sorted(map(tuple, problems.p1_found(spark, smallest).collect()))
        known = TimestampDictionary(spark, path).open()
        size, batches_ = known.entries().count(), known.batches
        again = sorted(map(tuple, problems.p1_found(spark, smallest).collect()))
        after = TimestampDictionary(spark, path).open()
        assert once == again and size and after.entries().count() == size and after.batches == 2 * batches_
    finally:
        spark.conf.unset(problems.DICTIONARY_CONF)


def test_progress(spark):
    rows = [("listing", 1, 2, 37), ("listing", 0, 0, 0), ("listing", 9, 3, 75), ("waiting", 1, 1, 78), ("exporting", 1, 2, 84), ("merging", 1, 1, 99), ("done", None, None, 100), (None, 1, 1, 0), ("other", 1, 1, 0)]
    df = spark.createDataFrame(rows, "p string, i int, n int, want int")
    assert all(r["want"] == r["got"] for r in df.select("want", numbers.progress_percent(F.col("p"), F.col("i"), F.col("n")).alias("got")).collect())


def test_layout_of_pages(spark):
    html = '<p style="margin-top:-9px;color:red" class="a sticky b">x</p><p style="margin: 4px">y</p>'
    assert first(spark, pagemeta.strip_layout, html) == '<p style="color:red" class="a  b">x</p><p style="margin: 4px">y</p>'


def test_shapes_of_rows(spark):
    df = spark.createDataFrame([(1, " ", "x", None, "1700000000", None, "p"), (2, "a", None, " 2024 ", None, 5, "p"), (3, None, None, None, "soon", 1, None)], "k int, a string, b string, t string, e string, n int, _own string")
    got = {r["k"]: r for r in shape.article_rows(df, key="k", names={"title": ["a", "b"]}, counters={"n": "n"}, time="t", epoch="e").collect()}
    assert [(got[i]["title"], got[i]["publish_time"], got[i]["counters"]) for i in (1, 2, 3)] == [("x", "2023-11-15 06:13:20", {"n": 0}), ("a", "2024", {"n": 5}), (None, "", {"n": 1})]
    assert shape.drop_private(df).columns == ["k", "a", "b", "t", "e", "n"]
    old, new = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), spark.createDataFrame([(1, "c"), (2, "e"), (2, "d"), (None, "n")], "k int, v string")
    assert sorted((str(r["k"]), r["v"]) for r in shape.appended(old, new, "k").collect()) == [("1", "a"), ("1", "b"), ("2", "d"), ("None", "n")]
