"""Operators over texts: defined results for nulls, empty, long, repeated and hot inputs, and brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.llm import leakage, lines, mixing, neardup, quality, registry, split

DOCS = "id long, text string, source string, key string, n string, a string, hash string"


def docs(spark, rows):
    """Rows (id, text, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)


# ---- lines of a source
ARGS = {"id_col": "id", "text_col": "text", "source_col": "source"}


def repeated(spark):
    rows = [(i, f"Eigener Satz {chr(97 + i % 26)}{chr(97 + i // 26)} hier\nTeilen Sie {i}!\n\n  teilen SIE ", "s1") for i in range(60)]
    rows += [(100 + i, f"Other {chr(97 + i % 26)}{chr(97 + i // 26)}\r\n123 456", "s2") for i in range(60)]
    return docs(spark, [*rows, (200, None, "s1"), (201, "", "s1"), (202, "Teilen Sie", None), (203, "x" * 50_000, "s2")])


def test_lines_match_brute_force(spark):
    df = repeated(spark)
    found = {(r["id"], r["line_no"]) for r in lines.find_excess_lines(df, lines.excess_lines(df, **ARGS), **ARGS).collect()}
    assert found == {(i, n) for i in range(60) for n in (2, 4)}


def test_lines_are_removed_by_position(spark):
    df = repeated(spark)
    clean = {r["id"]: r["text"] for r in lines.remove_excess_lines(df, lines.excess_lines(df, **ARGS), **ARGS).collect()}
    assert clean[0] == "Eigener Satz aa hier\n" and clean[200] is None and clean[201] == "" and clean[202] == "Teilen Sie" and len(clean) == df.count()
    assert lines.remove_excess_lines(df, lines.excess_lines(df, **ARGS), **ARGS).columns == df.columns


def test_many_excess_lines_take_the_shuffle(spark, monkeypatch):
    df = repeated(spark)
    excess = lines.excess_lines(df, **ARGS)
    small = sorted((r["id"], r["text"]) for r in lines.remove_excess_lines(df, excess, **ARGS).collect())
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted((r["id"], r["text"]) for r in lines.remove_excess_lines(df, excess, **ARGS).collect()) == small
    assert lines.find_excess_lines(df, excess, **ARGS).count() == 120


def test_repeated_ids_keep_their_own_lines_in_the_shuffle(spark, monkeypatch):
    df = repeated(spark)
    df = df.union(df.limit(3)).union(docs(spark, [(0, "Ein anderer Text\nTeilen Sie", "s1"), (0, "Noch einer", "s2"), (None, "Ohne Nummer", "s1")]))
    excess = lines.excess_lines(df, **ARGS)
    small = sorted((str(r["id"]), str(r["text"])) for r in lines.remove_excess_lines(df, excess, **ARGS).collect())
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted((str(r["id"]), str(r["text"])) for r in lines.remove_excess_lines(df, excess, **ARGS).collect()) == small


def test_line_in_every_source_still_stands_out(spark):
    df = docs(spark, [(100 * s + i, f"Nur {chr(97 + i)}{chr(97 + s)}\nGemeinsame Zeile", f"s{s}") for s in range(4) for i in range(25)])
    assert lines.find_excess_lines(df, lines.excess_lines(df, **ARGS), **ARGS).count() == 100


def test_line_at_the_limits_passes_without_significance(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    rows = [(i, f"Eigen {word(i)}\nFloskel {word(i % 60)}" + ("\nGemeinsame Zeile" if i < 10 else ""), "s1") for i in range(500)]
    rows += [(1000 + i, f"Anders {word(i)}" + (f"\nFloskel {word(i // 10)}" if i < 600 else "") + ("\nGemeinsame Zeile" if i < 38 else ""), "s2") for i in range(2000)]
    df = docs(spark, rows)
    excess = lines.excess_lines(df, **ARGS)
    assert [(r["n_rows"], r["significant"]) for r in excess.collect()] == [(10, False)]
    assert {r["id"] for r in lines.find_excess_lines(df, excess, **ARGS).collect()} == set(range(10))


def test_lines_are_found_without_tests_that_decide_nothing(spark, smallest, monkeypatch):
    df = repeated(spark)
    tested = {(r["source"], r["line"]) for r in lines.excess_lines(df, **ARGS).collect()}
    want = {str(r) for r in registry.QUERIES["p4_found"](spark, smallest).collect()}
    monkeypatch.setattr(lines, "_bh_threshold", lambda *_: pytest.fail("tests run"))
    assert {(r["source"], r["line"]) for r in lines.lines_over_limits(df, **ARGS).collect()} == tested
    assert lines.lines_over_limits(df.limit(0), **ARGS).count() == 0
    assert {str(r) for r in registry.QUERIES["p4_found"](spark, smallest).collect()} == want
    assert registry.QUERIES["p4_cleaned"](spark, smallest).count()


def test_lines_of_an_empty_table(spark):
    df = docs(spark, [])
    assert lines.find_excess_lines(df, lines.excess_lines(df, **ARGS), **ARGS).count() == 0


# ---- splitting
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。!？\r\t", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_split_is_exact(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    assert split.joined([(text[s:e], o) for s, e, o, _ in pieces]) == text
    for (s, e, o, cut), nxt in zip(pieces, [*pieces[1:], None]):
        assert 0 < e - s <= limit
        if nxt:
            assert nxt[2] == min(overlap, e - s - 1) and nxt[0] == e - nxt[2]


def test_split_prefers_larger_boundaries():
    text = "a" * 40 + "\n\n" + "b" * 30 + ". " + "c" * 60
    assert [c for *_, c in split.split_text(text, 50, 0)] == ["paragraph", "sentence", "hard", "end"]
    assert [c for *_, c in split.split_text("x" * 100, 40, 10)][:2] == ["hard", "hard"]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("a" * 30, "paragraph"), ("a\n\n" * 30, "paragraph"), (("a" * 8 + "\n") * 6, "line"), ("aaaa. " * 10, "sentence"), ("好好。" * 20, "sentence"), ("aaaa " * 12, "word"), ("a" * 31, "none"), ("a" * 15 + "\r\n" + "a" * 14, "paragraph"), ("a" * 15 + "\n" + "a" * 15, "line"),
    ],
)
def test_boundary_kind(text, kind):
    assert split.boundary_kind(text, 30) == kind


def plain_kind(text, limit):
    """The definition, line by line."""
    lines = re.split(r"\r?\n", text)
    longest = size = count = 0
    for line in lines:
        if line.strip(" \t\r\n"):
            size, count = size + len(line), count + 1
            longest = max(longest, size + count - 1)
        else:
            size = count = 0
    if longest <= limit:
        return "paragraph"
    if max(map(len, lines)) <= limit:
        return "line"
    sentences = [s for line in lines for s in re.split(r"(?<=[。！？])|(?<=[.!?])(?=[ \t])", line)]
    if max((len(s.strip(" \t\r\n")) for s in sentences), default=0) <= limit:
        return "sentence"
    return "word" if max(map(len, re.split(r"[ \t\r\n]+", text))) <= limit else "none"


@settings(max_examples=400, deadline=None)
@example("  ", 1)
@example("", 1)
@given(st.text(alphabet="ab .\n。!？\r\t", max_size=300), st.integers(1, 60))
def test_boundary_kind_is_the_definition(text, limit):
    assert split.boundary_kind(text, limit) == plain_kind(text, limit)


def test_split_of_a_table(spark):
    df = docs(spark, [(1, None, None), (2, "", None), (3, "short", None), (4, "word " * 2000, None), (4, "word " * 2000, None), (5, "好" * 10_000, None)])
    got = split.split_oversized(df, id_col="id", text_col="text", limit=3000, overlap=200)
    by = {i: [r for r in got.collect() if r["id"] == i] for i in range(1, 6)}
    assert not by[1] and not by[2] and [r["piece"] for r in by[3]] == ["short"] and len(by[4]) == 8
    assert {r["boundary"] for r in by[4]} == {"word"} and {r["boundary"] for r in by[5]} == {"none"} and by[3][0]["boundary"] is None
    assert all(len(r["piece"]) <= 3000 for r in got.collect())
    assert split.split_oversized(docs(spark, []), id_col="id", text_col="text").count() == 0


def test_split_by_tokens(spark):
    from inkloom.llm.tokens import DEFAULT_TOKENIZER, bpe

    text = "The quick brown fox jumps over the lazy dog. 敏捷的棕色狐狸。 " * 60
    got = split.split_oversized(docs(spark, [(1, text, None)]), id_col="id", text_col="text", limit=100, overlap=10, tokenizer_path=DEFAULT_TOKENIZER).orderBy("piece_no").collect()
    encode = bpe().encode_ordinary
    assert all(len(encode(r["piece"])) <= 100 for r in got)
    assert split.joined([(r["piece"], r["overlap"]) for r in got]) == text


# ---- near-duplicates
def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choice("abcdefgh") for _ in range(6))
    return " ".join(words)


def near_rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(80))
        rows.append((10 * i, base, "s"))
        for j in range(1, 4):
            rows.append((10 * i + j, edited(rng, base, j * 3), "s"))
        rows.append((10 * i + 4, base.upper().replace(" ", "\n "), "s"))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    near = neardup.NearDuplicates(docs(spark, rows), id_col="id", text_col="text")
    got = {(r["a"], r["b"]) for r in near.row_pairs().collect()}
    plain = [(i, re.sub(r"\s", "", t.lower())) for i, t, _ in rows]
    truth = {(i, j) for i, a in plain for j, b in plain if i < j and abs(len(a) - len(b)) < 200 and jaccard(a, b) >= 0.7}
    assert got <= truth and len(got) >= 0.98 * len(truth)
    groups = {r["id"]: r["group"] for r in near.groups().collect()}
    assert len(groups) == len(rows) and groups[4] == groups[0] == 0
    assert all(groups[a] == groups[b] for a, b in got)


def test_near_duplicates_of_odd_texts(spark):
    rows = [(1, None, None), (2, "", None), (3, "abc", None), (4, "abc", None), (5, "same text here", None), (6, "Same  text here", None), (7, "x" * 20_000, None), (8, "y" * 20_000, None)]
    near = neardup.NearDuplicates(docs(spark, rows), id_col="id", text_col="text")
    assert [(r["a"], r["b"]) for r in near.row_pairs().collect()] == [(5, 6)]
    assert neardup.NearDuplicates(docs(spark, []), id_col="id", text_col="text").row_pairs().count() == 0


def test_hot_group_of_copies(spark):
    near = neardup.NearDuplicates(docs(spark, [(i, "one text that many rows hold", None) for i in range(450)]), id_col="id", text_col="text")
    assert near.row_pairs().count() == 450 * 449 // 2 and near.links().count() == 0
    assert {r["group"] for r in near.groups().collect()} == {0}


def test_near_copies_that_are_a_third_of_the_rows(spark):
    rng = random.Random(8)
    text = lambda: [rng.choice("abcdefghijklmnop") + "".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(80)]
    base, rows = text(), [(i, " ".join(text()), None) for i in range(240)]
    for i in range(240, 360):
        words = list(base)
        for at in rng.sample(range(80), 3):
            words[at] = "".join(rng.choice("qrstuvwxyz") for _ in range(5))
        rows.append((i, " ".join(words), None))
    got = {(r["a"], r["b"]) for r in neardup.NearDuplicates(docs(spark, rows), id_col="id", text_col="text").row_pairs().collect()}
    groups = {r["id"]: r["group"] for r in neardup.NearDuplicates(docs(spark, rows), id_col="id", text_col="text").groups().collect()}
    assert len(groups) == 360 and {groups[i] for i in range(240, 360)} == {240}
    group = [(i, t.replace(" ", "")) for i, t, _ in rows[240:]]
    truth = {(i, j) for i, a in group for j, b in group if i < j and jaccard(a, b) >= 0.7}
    assert len(truth) > 6000 and got <= truth and len(got) >= 0.99 * len(truth)


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(1, 2**52, 400, dtype=np.uint64))
    w = rng.uniform(0.5, 3, 400)
    other = np.where(np.arange(400) % 4 == 0, 0, w)  # a quarter is missing
    doc = np.concatenate([np.zeros(400, int), np.ones((other > 0).sum(), int)])
    key, log_w = np.concatenate([keys, keys[other > 0]]), np.log(np.concatenate([w, other[other > 0]]))
    order = np.argsort(key, kind="stable")
    s = neardup.weighted_samples(doc[order], key[order], log_w[order], 2, 2000)
    assert abs((s[0] == s[1]).mean() - other.sum() / w.sum()) < 0.04


# ---- leakage
def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40)), "en") for i in range(20)] + [(50, "这是一条用来检验泄漏的中文句子，长度要超过二十四个字才会被认作同一段文字。", "zh"), (51, None, "en"), (52, "short", None)]
    rows = [(1, None, None), (2, "", None)]
    for i in range(3, 60):
        item = items[i % 20][1]
        cut = rng.randrange(0, 100)
        size = rng.choice([40, 59, 60, 61, 90])
        rows.append((i, " ".join(word() for _ in range(20)) + " " + item[cut : cut + size].upper().replace(" ", " - ") + " " + " ".join(word() for _ in range(20)), None))
    rows.append((90, "前文。" + items[20][1].replace("，", " ") + "后文", None))
    got = leakage.leaked_items(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string, lang string"), id_col="id", text_col="text", item_id_col="item_id", item_text_col="text", item_lang_col="lang")
    truth = set()
    for i, t, _ in rows:
        plain = leakage.normalise(t or "")
        for k, u, lang in items:
            run, v = (24 if lang == "zh" else 60), leakage.normalise(u or "")
            if any(v[p : p + run] in plain for p in range(len(v) - run + 1)):
                truth.add((i, k))
    least = {k: 24 if lang == "zh" else 60 for k, _, lang in items}
    assert truth and {(r["id"], r["item_id"]) for r in got.collect() if r["equal_chars"] >= least[r["item_id"]]} == truth


@pytest.mark.parametrize("run", [60, 24])
@pytest.mark.parametrize("edits", [1, 2, 3])
def test_leaks_with_edits_reach_the_recall(run, edits):
    """Passages of exactly ``run`` characters with ``edits`` edits at any place."""
    rng = np.random.default_rng(5 + run + edits)
    hits, n = 0, 0
    for _ in range(200):
        item = "".join(map(chr, rng.integers(97, 123, 200)))
        p = int(rng.integers(0, 200 - run - edits))
        passage = "".join(map(chr, leakage.edited(np.array([ord(c) for c in item[p : p + run + edits]]), edits, rng)))[:run]
        if len(passage) < run:
            continue
        around = "".join(map(chr, rng.integers(65, 91, int(rng.integers(0, 40)) + 30)))
        n += 1
        hits += bool(leakage.ItemIndex([(1, item, run)], max_edits=edits).search([around[30:] + passage + around[:30]]))
    assert hits >= 0.99 * n - 1
    assert not leakage.ItemIndex([(1, item, run)], max_edits=edits).search(["".join(map(chr, rng.integers(117, 123, 300)))])


def test_equal_runs_beside_edits():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    index = leakage.ItemIndex([(1, item, 60)], max_edits=1)
    ((_, _, size, begin, equal),) = index.search(["#" * 7 + item[:40] + "#" + item[41:70] + "#" * 9])
    assert (size, begin, equal) == (70, 7, 40)
    ((_, _, size, begin, equal),) = index.search(["#" * 7 + item[:65] + "%" * 9])
    assert begin in (6, 7) and equal == 65 and size >= 65


def test_many_items_are_searched_in_shards(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(90)) for _ in range(12)]
    items = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(99, None, "en")], "item_id long, text string, lang string")
    df = docs(spark, [(i, f"xx {texts[i % 12]} yy", "s") for i in range(24)] + [(50, None, "s"), (51, "", "s")])
    args = {"id_col": "id", "text_col": "text", "item_id_col": "item_id", "item_text_col": "text", "item_lang_col": "lang"}
    whole = sorted(map(tuple, leakage.leaked_items(df, items, **args).collect()))
    monkeypatch.setattr(leakage, "SHARD_CHARS", 200)
    assert sorted(map(tuple, leakage.leaked_items(df, items, **args).collect())) == whole
    assert {(r[0], r[1]) for r in whole} >= {(i, i % 12) for i in range(24)}


def test_characters_that_normalise_to_many(spark):
    """NFKC turns one character into up to 18: a text of few raw characters can hold a passage."""
    items = spark.createDataFrame([(1, "\ufdfa" * 3, "zh")], "item_id long, text string, lang string")
    df = docs(spark, [(1, "\ufdfa" * 3, "s")])
    got = leakage.leaked_items(df, items, id_col="id", text_col="text", item_id_col="item_id", item_text_col="text", item_lang_col="lang").collect()
    assert [(r["id"], r["item_id"]) for r in got] == [(1, 1)]


# ---- mixing
def test_mix_reaches_its_shares(spark):
    rows = [(i, "word " * (5 + i % 7), ("A ", "b", "C")[i % 3] if i % 10 else None) for i in range(3000)] + [(5000, None, "a"), (5001, "", "b"), (5002, "other", "none")]
    targets = spark.createDataFrame([("a", 2.0, 4), ("B", 1.0, 1), ("c", 1.0, 2), ("gone", 5.0, 1)], "source string, weight double, max_repeat int")
    chosen, report = mixing.mix(docs(spark, rows), targets, **ARGS)
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"a", "b", "c", "gone"} and by["gone"]["used_tokens"] == 0
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        assert abs(by[s]["actual_share"] - share) < 0.005 and by[s]["most_copies"] <= by[s]["max_repeat"]
    assert abs(sum(r["n_tokens"] * r["copies"] for r in chosen.collect()) - sum(r["used_tokens"] for r in by.values())) == 0
    assert chosen.filter("id = 5002").count() == 0


def test_mix_thresholds_match_a_sort(spark):
    counts = spark.createDataFrame([(i, "s", hash_, 1 + i % 5) for i, hash_ in enumerate(random.Random(1).sample(range(1 << 60), 500))], "id long, source string, hash long, n_tokens long")
    threshold = mixing._thresholds(counts, {"s": 700.0})["s"]
    taken = sum(r["n_tokens"] for r in counts.collect() if r["hash"] < threshold)
    assert abs(taken - 700) <= 5


def test_mix_of_empty_tables(spark):
    targets = spark.createDataFrame([], "source string, weight double, max_repeat int")
    chosen, report = mixing.mix(docs(spark, []), targets, **ARGS)
    assert chosen.count() == 0 and report.count() == 0


# ---- quality
PROSE = "Der Rechner lief die ganze Nacht, und am Morgen war die Arbeit getan. Wir haben lange auf das Ergebnis gewartet, aber es hat sich gelohnt. "
KINDS = {
    "prose": [PROSE * 3, "他说：“我们先等一等。”\n她没有回答，只是看着窗外的雨。\n后来他们都走了，谁也没有再提那件事。", "Tapol: Wir gehen heute nicht mehr aus.\nHogal: Das ist mir recht, denn es regnet ja.\nTapol: Dann bleiben wir eben hier."],
    "list": ["- Äpfel\n- Birnen\n- Kirschen\n- Pflaumen\n- Quitten", "Die alte Mühle am Bach\nWarum der Zähler stehen bleibt\nNotizen über das Archiv\nDas zweite Heft\nDer Sensor im Garten", "1. 第一项\n2. 第二项\n3. 第三项\n4. 第四项"],
    "table": ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |", "Name: 12\nWert: 13\nPreis: 14\nMenge: 99", "x\t1\t2\ny\t3\t4\nz\t5\t6"],
    "junk": ["QWAMgROP+X22aJfAG1aSPsWv5EverI1OZIgGE8w0CBQ405c5qKYiDVFzzk8mNpT5A/1wYAp2M9oKHRwd9mBkrVVLQJhbWjkIfDWCoKfjkRMMDezeh04M8Tv5v2hTdPtl" * 2, "buy cheap tool, best tool price, top tool guide, " * 20, "#-^$%*<|< %_/<=/#* /_>@%>%%#%&= =&&#_ #>+>/+ _+/ ^+*/>> " * 5, "首页 登录 注册 帮助 首页 登录 注册 帮助 " * 20],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kinds(kind, text):
    s = quality.text_statistics(pa.array([text]))
    assert quality.kinds(s, quality.failed_rules(s))[0] == kind


def test_published_rules_decide():
    pairs = ["Mühle Bach", "Brücke Fluss", "Lampe Tisch", "Garten Haus", "Fenster Wand", "Katze Ofen"]
    titles = "\n".join("Über die {0} neben dem {1}, und wie man {1} mit {0} zusammen denkt".format(*p.split()) for p in pairs)
    texts = [titles, *[t for ts in KINDS.values() for t in ts]]
    s = quality.text_statistics(pa.array(texts))
    failed = quality.failed_rules(s)
    whole = quality.kinds(s, failed)
    assert (quality.kinds(s, {}) == "prose").all()
    assert any((quality.kinds(s, {k: v for k, v in failed.items() if k != rule}) != whole).any() for rule in quality.PUBLISHED)
    low = {**quality.PUBLISHED, "gopher_word_count": ("n_words", 10, 20)}
    assert quality.failed_rules(s, low)["gopher_word_count"].sum() != failed["gopher_word_count"].sum()


def test_repeated_word_runs():
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words * 2), " ".join([*words, *words[:9]]), ""]
    assert np.allclose(quality.text_statistics(pa.array(texts))["duplicate_gram_chars"], [0, 0.5, 0, 0])


def test_statistics_of_a_table(spark):
    df = docs(spark, [(1, None, None), (2, " \n ", None), (3, PROSE, None), (3, PROSE, None), (4, PROSE * 2000, None)])
    got = {r["id"]: r for r in quality.quality_statistics(df, id_col="id", text_col="text").collect()}
    assert got[1]["kind"] == got[2]["kind"] == "empty" and got[1]["reasons"] == ["empty"] and got[1]["n_chars"] == 0
    assert got[3]["kind"] == "prose" and got[3]["n_chars"] == len(PROSE) and got[4]["kind"] == "junk" and "gopher_duplicate_10gram_chars" in got[4]["reasons"]
    assert quality.quality_statistics(docs(spark, []), id_col="id", text_col="text").count() == 0


def test_statistics_match_plain_python():
    texts = [PROSE, "Zwei Zeilen.\nohne Ende\n- Punkt", "数字 12 和 符号 #@", ""]
    s = quality.text_statistics(pa.array(texts))
    assert s["n_chars"].tolist() == [len(t) for t in texts]
    assert s["n_lines"].tolist() == [1, 3, 1, 0]  # lines with text
    grams = [len({t[i : i + 4] for i in range(len(t) - 3)}) / max(len(t) - 3, 1) for t in texts[:3]]
    assert np.allclose(s["distinct_gram_share"][:3], grams)


def test_batches_are_cut_by_rows_and_bytes():
    from inkloom.functions.batching import steps

    texts = ["a" * 10, None, "b" * 95, "c" * 300, "d", "e", "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "t"])
    parts = [s.column(1).to_pylist() for s in steps(batch, [1], rows=2, size=100)]
    assert [t for p in parts for t in p] == texts and [len(p) for p in parts] == [2, 1, 1, 2, 1]
    assert list(steps(batch.slice(0, 0), [1], 5)) == []
