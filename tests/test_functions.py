import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import htmlclean, markdown, noise, numbers, pagemeta, text, urls


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def of(column):
        return one.select(column.alias("x")).head()[0]

    return of


@pytest.mark.parametrize(("title", "expected"), [("T T", "T"), ("标题 标题", "标题"), (" a  b ", "a b"), ("ab ba", "ab ba"), ("", ""), (None, None), ("　x x　", "x")])
def test_undouble(value, title, expected):
    assert value(text.undouble(F.lit(title))) == expected


@pytest.mark.parametrize(("written", "n"), [("1.2万", 12000), ("8,634", 8634), ("3k", 3000), ("1亿", 100_000_000), ("abc", 0), ("", 0), (None, 0), ("1.15万", 11500)])
def test_parse_count(value, written, n):
    assert value(numbers.parse_count(F.lit(written))) == n


@pytest.mark.parametrize(("n", "shown"), [(9999, "9999"), (10000, "1万"), (12000, "1.2万"), (12345678, "1234.6万"), (None, None), (0, "0")])
def test_show_count(value, n, shown):
    assert value(numbers.show_count(F.lit(n).cast("long"))) == shown


def test_votes_tell_none_from_zero(value):
    assert value(numbers.parse_votes(F.lit(None).cast("string"))) is None
    assert value(numbers.parse_votes(F.lit("赞同"))) == 0
    assert value(numbers.parse_votes(F.lit("赞同 1.2 万"))) == 12000


def test_file_names(value):
    assert value(text.safe_filename(F.lit('a/b\\c:*?"<>|d '))) == "a_b_c_______d"
    assert value(text.safe_filename(F.lit("  "))) == "untitled"
    assert value(text.safe_filename(F.lit(None).cast("string"))) == "untitled"


def test_leading_title(value):
    body = "\n# 标题\n标题（续）\n\n正文\n标题"
    assert value(text.strip_leading_title(F.lit(body), F.lit("标题"))) == "正文\n标题"
    assert value(text.strip_leading_title(F.lit("标题"), F.lit("标题"))) == ""
    assert value(text.strip_leading_title(F.lit("x"), F.lit(None).cast("string"))) == "x"


def test_plain_text_variants(value):
    md = "# C# 与 [链接](u) ![i](v) snake_case **粗**\n\n\n\n尾"
    assert value(text.markdown_to_text(F.lit(md))) == "C与 链接  snakecase 粗\n\n尾"
    assert value(text.markdown_to_text_gently(F.lit(md))) == "C# 与 链接  snake_case 粗\n\n尾"


@pytest.mark.parametrize(
    ("url", "key"),
    [("https://A.example/x/?q=1#f", "a.example/x"), (" http://a.example/x", "a.example/x"), ("//a.example/x/", "a.example/x"), ("a.example/X", "a.example/X"), (None, None)],
)
def test_canonical_url(value, url, key):
    assert value(urls.canonical_url(F.lit(url))) == key


def test_urls_in_text(value):
    assert value(urls.urls_in(F.lit("1. https://a.example/x。 2) http://b.example/y,http://c.example;"))) == ["https://a.example/x", "http://b.example/y", "http://c.example"]


def test_image_original(value):
    assert value(urls.image_original(F.lit("//i.example/a.png?x-oss-process=image/watermark,t_1"))) == "https://i.example/a.png"
    assert value(urls.image_original(F.lit("https://pic.zhimg.com/80/v2-abc"))) == "https://pic.zhimg.com/v2-abc"


def test_pairs_keep_the_last(value):
    assert value(urls.parse_pairs(F.lit("a=1; b=x=y; a=2; flag"))) == {"a": "2", "b": "x=y"}


def test_hidden_styles_keep_fractions(value):
    assert value(pagemeta.strip_hidden(F.lit("visibility: hidden;opacity:0.5;opacity: 0;"))) == "opacity:0.5;;"


def test_charset():
    for charset in ("gbk", "gb2312", "utf-8", "utf-16le"):
        page = f'<meta charset="{charset}">中文'
        assert pagemeta.sniffed(page.encode(charset)) == page or charset == "utf-16le"
    assert pagemeta.sniffed(None) is None and pagemeta.sniffed(b"charset=nonsense x") == "charset=nonsense x"


def test_noise_filter(value):
    body = "正文一\n长按图片识别即可订阅\n\n\n\n正文二\n上一篇：x\n正文三"
    assert value(noise.filter_noise(F.lit(body))) == "正文一\n\n正文二"
    assert value(noise.filter_noise(F.lit(None).cast("string"))) == ""


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_html_cleaning_never_fails(page):
    clean, md, images = htmlclean.clean_page(page)
    assert isinstance(clean, str) and isinstance(md, str) and images == list(dict.fromkeys(images))


def test_html_to_markdown():
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>Eins <b>zwei</b><p>Drei <a href='u'>vier</a>"
        "<ul><li>a<li>b</ul><pre><code>x = 1\ny</code></pre><blockquote><p>q</p></blockquote><table><tr><th>h<th>i<tr><td>1<td>2</table><img data-src='//i.example/p.png?watermark=1' src='s'></article><footer>f</footer>"
    )
    clean, md, images = htmlclean.clean_page(page, "t")
    assert md == "Eins **zwei**\n\nDrei [vier](u)\n\n- a\n- b\n\n```\nx = 1\ny\n```\n\n> q\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n![](https://i.example/p.png)"
    assert images == ["https://i.example/p.png"] and "script" not in clean and "Home" not in clean


def test_markdown_blocks():
    md = "# H\n\np1\np2\n\n- a\n  - b\n1. c\n\n> q\n\n```\ncode # x\n```\n| x | y |\n|---|---|\n| 1 | 2 |\n\n---\n![i](u)\n-\n\nlone"
    assert [(k, n) for k, n, _ in markdown.blocks(md)] == [
        ("heading", 1), ("paragraph", 0), ("bullet", 0), ("bullet", 1), ("ordered", 0), ("quote", 1), ("code", 0), ("table", 0), ("table", 0), ("rule", 0), ("image", 0), ("bullet", 0),
    ]
    assert markdown.inline_runs("a **b** `c` [d](e) ~~f~~ *g*") == [
        ("text", "a ", ""), ("bold", "b", ""), ("text", " ", ""), ("code", "c", ""), ("text", " ", ""), ("link", "d", "e"), ("text", " ", ""), ("strike", "f", ""), ("text", " ", ""), ("italic", "g", ""),
    ]


def test_sanitise():
    assert markdown.sanitise("<em>x</em> \\_y\\_ **open") == "*x* _y_ open"
    assert "javascript" not in markdown.sanitise("[a](javascript:alert(1))")


def test_deep_and_unclosed_pages_are_walked():
    for page in ("<b>" * 3000 + "bold", "<div>" * 3000 + "<p>deep</p>", "<p>" + "<span>" * 2000 + "x" + "<p>y</p>", "<ul><li>" * 1500 + "item", "<blockquote>" * 1500 + "q", "<table><tr><td>" * 900 + "cell"):
        clean, md, _ = htmlclean.clean_page(page)
        assert clean and md
    assert htmlclean.clean_page("<p>a <b>b</p><p>c</p>")[1] == "a **b**\n\nc"
    many = "<p>x" + "<i>" * 50 + "y</p>" + "<p>plain</p>"
    assert htmlclean.clean_page(many)[1].endswith("plain")


def test_content_class_holds_the_content():
    page = "<div class='side'><p>" + "menu " * 50 + "</p></div><div class='x post-content'><p>The text.</p></div>"
    assert htmlclean.clean_page(page)[1] == "The text."


def test_code_is_left_as_it_is():
    md = "<b>x</b>\n```\nvector<int> a; **p\n&amp; \\_\n```\nuse `map<k, v>` and **open"
    assert markdown.sanitise(md) == "**x**\n```\nvector<int> a; **p\n&amp; \\_\n```\nuse `map<k, v>` and open"
    assert markdown.blocks(markdown.sanitise(md))[1] == ("code", 0, "vector<int> a; **p\n&amp; \\_")


@pytest.mark.parametrize("page", ["<a href=" * 30_000, "\n" * 60_000, "\r\n \t" * 20_000, "[a](" * 30_000, "**a" * 20_000, "<" * 50_000, "`" * 50_000])
def test_odd_texts_take_linear_time(page):
    began = time.time()
    htmlclean.clean_page(page)
    markdown.blocks(markdown.sanitise(page))
    markdown.inline_runs(page)
    assert time.time() - began < 5


def test_text_behind_the_last_tag():
    assert htmlclean.clean_page("<p>a</p> b <c &amp; d")[1] == "a\n\nb <c & d"
    assert htmlclean.clean_page("plain &lt; text")[1] == "plain < text" and htmlclean.clean_page("<p>a</p>x<!-- y")[1] == "a\n\nx"
