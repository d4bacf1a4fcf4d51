"""Operators over pages: encodings, residue and main content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import blocks, boilerplate, encoding, ngrams, residue

CLEAN = [
    "我们决定先放着，因为数据库的连接还没有配置好。索引文件悄悄修好了消息队列。",
    "那么限流器到底跳过了老路由器了吗？原因其实在别处，后来还是还了这笔债。",
    "Die Warteschlange überschreibt den Zähler, während die Prüfung schläft. Größe und Maß müssen übereinstimmen.",
    "L’élève a déjà révélé la clé : ça tient depuis l’été, même à Noël. Où êtes-vous ?",
    "El guion de limpieza pisó la reserva de memoria; ¿qué pasó después? Todavía funciona así.",
    "The search box feeds the log viewer — “small steps”, as the team said. It’s been fine since.",
] * 30


@pytest.fixture(scope="module")
def model():
    return encoding.EncodingModel.train(CLEAN)


def labelled(model, text):
    return model.judged(text, model.spans([text])[0])


@pytest.mark.parametrize("text", [*CLEAN[:6], "", "plain ascii", "编码错了以后，é会显示成“Ã©”，这里就出现过。", "À L’ÂGE DE la pierre, ÇA VA", "★★★★★ 好评 ①②③ 🙂🙂"])
def test_correct_text_is_no_case(model, text):
    assert labelled(model, text) == []


@pytest.mark.parametrize("pair", ["utf8>cp1252", "utf8>latin1", "utf8>cp1252 twice", "utf8>cp1251", "utf8>cp437", "utf8>macroman", "gbk>cp1252", "gbk>cp1251", "gbk>big5", "utf8>gb18030", "utf8>sjis"])
def test_garbled_chinese_is_found_and_restored(model, pair):
    text = "索引文件悄悄修好了消息队列，原因其实在别处"
    bad = f"前面是好的。{encoding.garble(text, pair)}"
    kept = labelled(model, bad)
    assert kept, bad
    if encoding.restore(encoding.garble(text, pair), pair) == text:
        out, last = "", 0
        for a, b, _, fixed in kept:
            out, last = out + bad[last:a] + fixed, b
        assert sum(x != y for x, y in zip(out + bad[last:], "前面是好的。" + text)) <= 4


def test_round_trip_of_lossless_pairs():
    text = "größer, déjà vu, mañana"
    for pair in ("utf8>cp1252", "utf8>latin1", "utf8>cp1252 twice", "utf8>cp1251", "utf8>cp437", "utf8>macroman", "cp1252>cp1251"):
        assert encoding.restore(encoding.garble(text, pair), pair) == text, pair


def test_lost_characters_are_marked(model):
    bad = encoding.garble("我们决定先放着因为数据库", "gbk>utf8>gbk")
    assert "锟斤拷" in bad and labelled(model, "好的。" + bad)
    assert labelled(model, "The feature �flag� is off")


@pytest.mark.parametrize("pair", ["utf8>gbk", "utf8>big5"])
@pytest.mark.parametrize("text", ["Warum die Indexdatei hängt, ab von der Schalter für Funktionen", "Der Zähler und eine lange Reihe schlichter Worte ohne Zeichen, dann die Prüfung"])
def test_garbled_letters_far_apart_are_found(model, pair, text):
    bad = encoding.garble(text, pair)
    assert bad != text and labelled(model, bad), bad


def test_weak_letters_any_ascii_apart_add_up(model):
    row = np.zeros(len(model.states), dtype=np.float32)
    row[model.states.index("utf8>gbk")] = 6.5  # one is below the entry, two are above
    weak = encoding.EncodingModel(model.states, {**model.odds, "眉": row, "盲": row}, model.clean)
    assert not weak.spans(["- 眉 -"])[0] and len(weak.spans(["- 眉 - " + "x" * 500 + " - 盲 -"])[0]) == 2


@pytest.mark.parametrize("text", ["用Java和Python写脚本", "Java和Python", "K线 and T恤", "L’été à Noël, " + "plain words only, " * 20 + "où l’élève était", ("<a href='/n'>À propos</a>" + "plain words only, " * 9) * 6])
def test_scripts_side_by_side_are_no_case(model, text):
    assert labelled(model, text) == []


def test_encoding_of_a_table(spark):
    rows = [(1, None, None), (2, "", ""), (3, CLEAN[0], CLEAN[2]), (4, encoding.garble(CLEAN[0], "utf8>cp1252"), "x" * 100_000), (4, encoding.garble(CLEAN[0], "utf8>cp1252"), "ok"), (5, "ok", "<p>" + "".join(f"&#{ord(c)};" for c in encoding.garble("数据库的连接", "utf8>latin1")) + "</p>")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, title string, page string, field string, pairs string")
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    args = {"id_col": "id", "fields": {"title": False, "page": True}, "clean_col": "text"}
    got = sorted((r["id"], r["field"]) for r in encoding.find_garbled(df, clean, **args).collect())
    assert got == [(4, "title"), (4, "title"), (5, "page")]
    assert encoding.find_garbled(df.limit(0), clean, **args).count() == 0
    assert encoding.find_garbled(df.filter("id = 4"), clean.limit(0), **args).count() == 2  # the seed sentences serve


def test_encodings_are_learnt_from_every_clean_text(spark):
    texts = [f"Der Satz {i} nennt die Größe des Gartens, 第{i}句说的是放着的文章" for i in range(3000)]
    odd = "Ωμέγα стоит здесь"
    clean = spark.createDataFrame([(t,) for t in [*texts, odd, odd, None]], "t string").repartition(5)
    table, whole = encoding.train_model(clean, "t"), encoding.EncodingModel.train([*texts, odd])
    assert table.states == whole.states and table.odds.keys() == whole.odds.keys()
    assert all(np.array_equal(table.odds[ch], whole.odds[ch]) for ch in whole.odds)
    assert all(np.array_equal(x, y) for a, b in zip(table.clean.tables, whole.clean.tables) for x, y in zip(a, b))


# ---- blocks
def test_blocks_of_malformed_markup():
    page = "<html><title>T</title><body>lead<p>one <b>two</b>\n three<p>four<br>five<script>var x='<p>no</p>'</script><!-- <p>no</p> --><li><a href='/x'>link</a><li>a &amp; b&nbsp;c<div>n < 5 <%= text %></div><style>p{}</style>tail"
    got = blocks.parse_blocks(page)
    assert [b.text for b in got] == ["T", "lead", "one two three", "four", "five", "link", "a & b\xa0c", "n < 5 <%= text %>", "tail"]
    assert [b.inside for b in got][:2] == ["title", ""] and got[5].link_chars == 4 and got[2].bold_chars == 3
    assert blocks.parse_blocks("") == [] and blocks.parse_blocks("<p> </p>") == []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a</p>b <c d", ["a", "b <c d"]), ("<p>a</p>b<!-- c", ["a", "b"]), ("<p>a<script>x > y", ["a"]), ("<p>a<style>b", ["a"]), ("<p>a<!-- b > c", ["a"]), ("<p>a<!--> b", ["a"]), ("<script>x</script>a <b", ["a <b"]), ("a < b", ["a < b"]), ("<p>a<script>x</script>", ["a"]),
    ],
)
def test_blocks_behind_the_last_tag(page, texts):
    assert [b.text for b in blocks.parse_blocks(page)] == texts


def test_blocks_of_unclosed_tags_take_linear_time():
    assert len(blocks.parse_blocks("<a href=" * 30_000)) == 1
    assert boilerplate.frame("x" * 200_000, [])


# ---- a small invented site
RNG = random.Random(4)
NOUNS = "lamp river engine window garden market bridge letter kitchen harbour ladder pocket mirror candle forest".split()
VERBS = "opens follows keeps moves lifts paints turns leaves finds holds".split()


def sentence():
    return f"The old {RNG.choice(NOUNS)} {RNG.choice(VERBS)} the {RNG.choice(NOUNS)} while a {RNG.choice(NOUNS)} {RNG.choice(VERBS)} slowly near the {RNG.choice(NOUNS)}."


def article(i):
    title = f"{RNG.choice(NOUNS).title()} and {RNG.choice(NOUNS)} number {i}"
    body = [" ".join(sentence() for _ in range(3)) for _ in range(4)]
    page = (
        f"<html><head><title>{title}</title></head><body><nav><a href='/'>Home</a> <a href='/b'>About</a></nav><p>Accept all cookies to go on</p><h1>{title}</h1><p class='meta'>someone on Monday</p>"
        + "".join(f"<p>{b}</p>" for b in body)
        + "<div>Share this story with your friends</div><h4>Read next</h4><ul>"
        + "".join(f"<li><a href='/p'>{RNG.choice(NOUNS)} and {RNG.choice(NOUNS)}</a></li>" for _ in range(4))
        + "</ul><footer>All rights reserved, contact us</footer></body></html>"
    )
    return page, "\n\n".join([*body, "Share this story with your friends"]), title, body


BAD = ["<html><body><nav><a href='/'>Home</a></nav><p>{}</p><footer>All rights reserved, contact us</footer></body></html>".format(x) for x in ("404 Not Found", "{{ title }}", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.")]
SCHEMA = "id long, page string, md string, title string, block string, position string"


@pytest.fixture(scope="module")
def site(spark):
    pages = [article(i) for i in range(120)]
    rows = [(i, p, m, t, "c", "c") for i, (p, m, t, _) in enumerate(pages)] + [(200 + i, p, "", "Some title", "c", "c") for i, p in enumerate(BAD)]
    rows += [(300, None, None, None, "c", "c"), (301, "", "", "", "c", "c"), (302, "<p>" + "x" * 200_000, None, None, "c", "c")]
    return spark.createDataFrame(rows, SCHEMA), pages


PAGE = {"id_col": "id", "html_col": "page", "extracted_col": "md", "title_col": "title"}


def test_residue_pages(site):
    df, _ = site
    got = {r["id"]: r["is_residue"] for r in residue.find_residue_pages(df, **PAGE).collect()}
    assert all(not got[i] for i in range(120)) and all(got[200 + i] for i in range(len(BAD)))
    assert 300 not in got and 301 not in got
    assert residue.find_residue_pages(df.limit(0), **PAGE).count() == 0


def test_pages_whose_extracted_text_is_missing_are_no_residue(site, spark):
    df, pages = site
    third = df.withColumn("md", F.when(F.col("id") % 3 != 0, F.col("md")))
    got = {r["id"]: r["is_residue"] for r in residue.find_residue_pages(third, **PAGE).collect()}
    assert all(not got[i] for i in range(120)) and all(got[200 + i] for i in range(len(BAD)))
    found = {}
    for r in boilerplate.main_blocks(third, spark.createDataFrame([("Some Site",)], "site_name string"), **PAGE).orderBy("id", "position").collect():
        found.setdefault(r["id"], []).append(r["block"])
    assert sum(found.get(i) != [t, *body] for i, (_, _, t, body) in enumerate(pages)) <= 2


def test_sample_is_whole_beside_null_and_repeated_pages(spark):
    pages = [(f"page {i}", "text") for i in range(2000)]
    rows = [(None, "text")] * 1500 + [("", "text")] * 200 + [("no text", " ")] * 200 + [("copied", "text")] * 1500 + pages
    df = spark.createDataFrame(rows, "h string, m string")
    got, blank = residue._training_sample(df, "h", "m", 100)
    assert blank == ["no text"]
    assert len(got) == len(set(got)) == 100 and set(got) <= {("copied", "text"), *pages}
    alone = spark.createDataFrame([("copied", "text"), *pages], "h string, m string")
    assert residue._training_sample(alone, "h", "m", 100) == (got, [])
    assert residue._training_sample(df.filter("h is null"), "h", "m", 100) == ([], [])


SHOWN = ["Nothing to see at this address, turn round", "The kitchen is closed, our cooks are repairing it", "{{ widget }} {{ gadget }}", "Diese Seite macht gerade Pause", "本店今日休息，请改日光临"]
TOLD = ["ladder 7 fell over while painting", "harbour master refused the boat", "der Fährmann schläft noch", "油灯没有油了，已等候 30 分钟"]


@pytest.fixture(scope="module")
def noted(site, spark):
    """Pages that show notices, and notes that carry them or report of the collector."""
    df, _ = site
    pages = [(400 + i, BAD[0].replace("404 Not Found", t), "", "t", "c", "c") for i, t in enumerate(SHOWN * 6)]
    notes = [(i, f"{w}: {t}" if w else t, True) for i, (w, t) in enumerate((w, t) for w in ("", "page said", "mill") for t in SHOWN)]
    notes += [(100 + i, f"{w}: {t}" if w else t, False) for i, (w, t) in enumerate((w, t) for w in ("", "page said", "mill", "worker 3") for t in TOLD)]
    notes += [(200, None, False), (201, " ", False), (100, TOLD[0], False)]
    return df.union(spark.createDataFrame(pages, SCHEMA)), notes


def test_residue_is_learnt_from_every_page_and_note(noted, spark, monkeypatch):
    good = [(f"<p>{sentence()} {i}</p><p>Home {i}</p>", sentence()) for i in range(40)]
    rows = [(h, h[3:].split("</p>")[0]) for h, _ in good] + [(f"<p>{SHOWN[0]}</p><p>Home</p>", " ")] * 30
    df = spark.createDataFrame(rows, "h string, m string").repartition(3)
    monkeypatch.setattr(residue, "bounded_sample", lambda *_: pytest.fail("a sample is taken"))
    counts, texts = residue.whole_residue(df, "h", "m")
    article = [h[3:].split("</p>")[0] for h, _ in good]
    assert np.array_equal(counts["article"], ngrams.counted(article))
    assert np.array_equal(counts["around"], ngrams.counted([f"Home {i}" for i in range(40)]))
    assert [r["text"] for r in texts.collect()] == [SHOWN[0]] * 30
    notes = spark.createDataFrame([(f"report {i} of kind {chr(97 + i % 26) * 5}",) for i in range(5000)], "n string")
    model = residue.whole_notes(notes, texts)
    every = [r["n"] for r in notes.collect()]
    seeds = ngrams.counted(residue.residue_seeds.collector(), residue.NOTE_BITS)
    want = ngrams.NgramModels.of_counts({"collector": ngrams.counted(every, residue.NOTE_BITS) + seeds}, residue.NOTE_BITS)
    assert all(np.array_equal(x[1], y[0]) for x, y in zip(model.models.logs, want.logs))


def test_residue_notes(noted, spark):
    pages, notes = noted
    df = spark.createDataFrame([(i, n, "c") for i, n, _ in notes], "id long, note string, tbl string")
    args = {"id_col": "id", "note_col": "note", "html_col": "page", "extracted_col": "md"}
    assert sorted({r["id"] for r in residue.find_residue_notes(df, pages, **args).collect()}) == [i for i, _, bad in notes if bad]
    assert residue.find_residue_notes(df.limit(0), pages, **args).count() == 0
    assert residue.find_residue_notes(df, pages.limit(0), **args).filter("id >= 100").count() == 0


def test_reports_of_kinds_never_seen_are_no_residue(noted, spark):
    pages, notes = noted
    blank = [r["page"] for r in pages.filter("md = ''").collect() if r["page"]]
    good = [(r["page"], r["md"]) for r in pages.filter("length(md) > 0").collect()]
    model = residue.NoteModel([n for _, n, _ in notes if n], residue.learnt([(h, m) for h, m in good], blank)["residue"])
    unseen = ["Sitzung abgelaufen, bitte neu anmelden", "thread pool exhausted", "quota exceeded for worker 12", "out of memory while parsing", "任务超时被终止", "proxy timeout", "cookie invalid", "no space left"]
    assert not any(residue.residue_notes(model, unseen))
    # numbers and repeats of what pages show
    assert all(residue.residue_notes(model, [f"{SHOWN[0]}\n{SHOWN[0]}", f"harbour: {SHOWN[1]}"]))


def test_main_blocks_held_out(site, spark):
    df, pages = site
    sites = spark.createDataFrame([("Some Site",), (None,)], "site_name string")
    got: dict[int, list] = {}
    for r in boilerplate.main_blocks(df, sites, labelled_pages=60, **PAGE).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["block"])
    wrong = sum(got.get(i) != [t, *body] for i, (_, _, t, body) in enumerate(pages))
    assert wrong <= 2  # of 120 pages, half of them never labelled
    assert not any(200 <= i <= 301 for i in got)
    assert boilerplate.main_blocks(df.limit(0), sites, **PAGE).count() == 0


def test_main_blocks_of_an_article_copied_to_a_third_of_the_pages(site, spark):
    _, pages = site
    page, md, title, body = article(900)
    rows = [(i, p, m, t, "c", "c") for i, (p, m, t, _) in enumerate(pages)]
    rows += [(400 + i, page, md, title, "c", "c") for i in range(20)]
    rows += [(420 + i, page.replace("someone", f"someone{i}"), md, title, "c", "c") for i in range(20)]  # the same title
    rows += [(440 + i, page.replace(title, f"{title} again {i}"), md, f"{title} again {i}", "c", "c") for i in range(20)]  # the same body
    sites = spark.createDataFrame([("Some Site",)], "site_name string")
    got: dict[int, list] = {}
    for r in boilerplate.main_blocks(spark.createDataFrame(rows, SCHEMA), sites, **PAGE).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["block"])
    assert all(got.get(400 + i) == [title, *body] for i in range(40))
    assert all(got.get(440 + i) == [f"{title} again {i}", *body] for i in range(20))
    assert sum(got.get(i) != [t, *b] for i, (_, _, t, b) in enumerate(pages)) <= 2


def test_too_many_site_names_are_an_error(site, spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "MAX_SITES", 2)
    with pytest.raises(ValueError, match="at most 2 site names"):
        boilerplate.main_blocks(site[0], spark.createDataFrame([("a",), ("b",), ("c",)], "site_name string"), **PAGE)


def test_decision_tree_learns_a_rule():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (4000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    tree = boilerplate.DecisionTree.fit(x[:3000], y[:3000])
    assert ((tree.predict(x[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.98


def test_ngram_models_tell_classes_apart():
    models = ngrams.NgramModels({"a": [sentence() for _ in range(200)], "b": CLEAN[:60]})
    assert models.text_scores([sentence(), CLEAN[0]]).argmax(axis=1).tolist() == [0, 1]
    assert models.text_scores([]).shape == (0, 2)
