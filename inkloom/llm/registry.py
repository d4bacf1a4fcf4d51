"""Queries of the training-text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import boilerplate, encoding, leakage, lines, mixing, neardup, quality, residue, split, tokens
from inkloom.session import table

_LINES = {"id_col": "row_id", "text_col": "content_markdown", "source_col": "platform"}


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_blocks(
        table(spark, sf_dir, "article_cache"), table(spark, sf_dir, "site"), id_col="row_id", html_col="content_html", extracted_col="content_markdown", title_col="title"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct main blocks of every article page."""
    return _main(spark, sf_dir).select("row_id", F.md5(F.encode("block", "UTF-8")).alias("block_md5")).distinct()


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every article page, one block a line."""
    blocks = _main(spark, sf_dir).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("position", "block"))).alias("b"))
    return blocks.select("row_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("main_text"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(
        table(spark, sf_dir, "article_cache"), table(spark, sf_dir, "documents"), id_col="row_id", fields={"title": False, "content_html": True}, clean_col="text"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and pages that hold text read in a wrong encoding."""
    return _garbled(spark, sf_dir).select("row_id", "field")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored titles and pages, with the encodings found."""
    return _garbled(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that its platform shows in at least 2 % and 10 of its articles."""
    docs = table(spark, sf_dir, "article_cache")
    return lines.find_excess_lines(docs, lines.lines_over_limits(docs, **_LINES), **_LINES)


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without their platform's lines."""
    docs = table(spark, sf_dir, "article_cache")
    return lines.remove_excess_lines(docs, lines.lines_over_limits(docs, **_LINES), **_LINES).select("row_id", "platform", "content_markdown")


def p4_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the lines that stand in ten articles of a platform pass the test, within and below the limit of 2 %."""
    tests = lines.excess_lines(table(spark, sf_dir, "article_cache"), below_limit=True, **_LINES)
    within = F.col("n_rows") >= F.col("n_source_rows") * lines.MIN_SHARE
    return tests.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_tested"), F.count_if("significant").alias("n_significant"), F.count_if(within).alias("n_within"), F.count_if(within & F.col("significant")).alias("n_both"), F.round(F.min(F.when(within, F.col("ratio"))), 2).alias("least_ratio_within")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest natural unit that fits the limit everywhere, of each oversized article."""
    pieces = split.split_oversized(table(spark, sf_dir, "article_cache"), id_col="row_id", text_col="content_markdown")
    return pieces.filter((F.col("piece_no") == 0) & F.col("boundary").isNotNull()).select("row_id", "boundary")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all articles."""
    return split.split_oversized(table(spark, sf_dir, "article_cache"), id_col="row_id", text_col="content_markdown")


def p5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles in pieces of at most 800 tokens of a public tokenizer, overlapping by 50, without their texts."""
    pieces = split.split_oversized(table(spark, sf_dir, "article_cache"), id_col="row_id", text_col="content_markdown", limit=800, overlap=50, tokenizer_path=tokens.DEFAULT_TOKENIZER)
    return pieces.select("row_id", "piece_no", "start", "end", "overlap", "cut")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and items that hold residue instead of content."""
    cache, of_page = table(spark, sf_dir, "article_cache"), {"html_col": "content_html", "extracted_col": "content_markdown"}
    whole = residue.whole_residue(cache, "content_html", "content_markdown")
    pages = residue.find_residue_pages(cache, id_col="row_id", title_col="title", whole=whole, **of_page)
    notes = residue.find_residue_notes(table(spark, sf_dir, "article_item"), cache, id_col="row_id", note_col="error_reason", whole=whole, **of_page)
    return pages.filter("is_residue").select(F.lit("article_cache").alias("tbl"), "row_id").unionByName(notes.select(F.lit("article_item").alias("tbl"), "row_id"))


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, sf_dir, "article_cache"), id_col="row_id", text_col="content_markdown")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles with a similarity of at least 0.7."""
    return _near(spark, sf_dir).row_pairs().select(F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its group of near-duplicates."""
    return _near(spark, sf_dir).groups().select(F.col("id").alias("row_id"), F.col("group").alias("group_id"))


def _leaks(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return leakage.leaked_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", item_lang_col="lang", **more
    )


def _equal_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks whose passage has the required length without any edit."""
    items = table(spark, sf_dir, "eval_item").select("item_id", F.when(F.col("lang") == "zh", leakage.MIN_RUN_ZH).otherwise(leakage.MIN_RUN).alias("least"))
    return _leaks(spark, sf_dir).join(F.broadcast(items) if items.limit(100_001).count() <= 100_000 else items, "item_id").filter(F.col("equal_chars") >= F.col("least"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an evaluation item, with each such item."""
    return _equal_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at most two edits in the passage."""
    return _leaks(spark, sf_dir, max_edits=2).select("doc_id", "item_id", "passage_chars", "equal_chars")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each evaluation item leaked, and its longest equal passage."""
    leaks = _equal_leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("equal_chars").alias("longest_passage"))
    items = table(spark, sf_dir, "eval_item").select("item_id", "lang")
    return items.join(leaks, "item_id", "left").fillna(0, ["n_documents", "longest_passage"])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), id_col="doc_id", text_col="text", source_col="source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reaches."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    stats = quality.quality_statistics(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return stats.filter(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of all documents, with failed rules."""
    return quality.quality_statistics(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


def p10_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can say, of all documents with text: characters, lines, short lines, lines that end in punctuation or in an ellipsis."""
    stats = quality.quality_statistics(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text").filter("kind <> 'empty'")
    share = lambda c: F.round(F.col(c) * F.col("n_lines"), 0).cast("long")
    return stats.select("doc_id", "n_chars", "n_lines", share("short_line_share").alias("n_short"), share("punct_line_share").alias("n_ended"), share("ellipsis_line_share").alias("n_ellipsis"))


QUERIES = {f.__name__: f for f in (p2_found, p2_text, p3_found, p3_restored, p4_found, p4_cleaned, p4_tests, p5_found, p5_pieces, p5_tokens, p6_found, p7_found, p7_groups, p8_found, p8_edits, p8_report, p9_mix, p9_shares, p10_found, p10_statistics, p10_figures)}
_SAME_LINES = """
WITH lines AS (
  SELECT row_id, platform, unnest(string_split(content_markdown, chr(10))) AS line,
         unnest(range(1, len(string_split(content_markdown, chr(10))) + 1)) AS line_no
  FROM article_cache WHERE platform IS NOT NULL),
keyed AS (SELECT row_id, platform, line_no, line, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM lines),
shown AS (SELECT platform, k, count(DISTINCT row_id) AS n FROM keyed WHERE k <> '' GROUP BY ALL),
sizes AS (SELECT platform, count(*) AS n_rows FROM article_cache GROUP BY ALL),
excess AS (SELECT platform, k FROM shown JOIN sizes USING (platform) WHERE n >= 10 AND n >= 0.02 * n_rows)
"""

_UNITS = r"""
WITH big AS (SELECT row_id, replace(content_markdown, chr(13) || chr(10), chr(10)) AS t FROM article_cache WHERE length(content_markdown) > 3000),
l AS (SELECT row_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM big),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l),
g AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY row_id ORDER BY i) AS grp FROM b),
par AS (SELECT row_id, max(n) AS n FROM (SELECT row_id, sum(length(line)) + count(*) - 1 AS n FROM g WHERE NOT blank GROUP BY row_id, grp) GROUP BY row_id),
lin AS (SELECT row_id, max(length(line)) AS n FROM l GROUP BY row_id),
sen AS (SELECT row_id, max(length(trim(s, ' ' || chr(9) || chr(13)))) AS n FROM (SELECT row_id,
  unnest(string_split(regexp_replace(regexp_replace(line, '([。！？])', '\1' || chr(1), 'g'), '([.!?])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM l) GROUP BY row_id),
wor AS (SELECT row_id, max(length(w)) AS n FROM (SELECT row_id, unnest(regexp_split_to_array(t, '[ \t\r\n]+')) AS w FROM big) GROUP BY row_id)
SELECT big.row_id, CASE WHEN coalesce(par.n, 0) <= 3000 THEN 'paragraph' WHEN lin.n <= 3000 THEN 'line' WHEN sen.n <= 3000 THEN 'sentence' WHEN wor.n <= 3000 THEN 'word' ELSE 'none' END AS boundary
FROM big LEFT JOIN par USING (row_id) JOIN lin USING (row_id) JOIN sen USING (row_id) JOIN wor USING (row_id)"""

_SIMILAR = r"""
WITH d AS (SELECT row_id, regexp_replace(lower(content_markdown), '[ \t\r\n]+', '', 'g') AS t FROM article_cache),
s AS (SELECT DISTINCT row_id, substr(t, i, 5) AS g FROM (SELECT row_id, t, unnest(range(1, length(t) - 3)) AS i FROM d WHERE length(t) >= 5)),
n AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id),
c AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT row_a, row_b FROM c JOIN n x ON x.row_id = row_a JOIN n y ON y.row_id = row_b WHERE k / (x.n + y.n - k) >= 0.7"""

#: Compatibility forms are left as they are: the given tables hold none in what items and documents share.
_LEAKED = r"""
WITH it AS (SELECT item_id, CASE WHEN lang = 'zh' THEN 24 ELSE 60 END AS run, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM eval_item WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, run, substr(t, i, run) AS w FROM (SELECT item_id, run, t, unnest(range(1, length(t) - run + 2)) AS i FROM it WHERE length(t) >= run)),
d AS (SELECT doc_id, run, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM documents, (VALUES (24), (60)) r(run) WHERE text IS NOT NULL),
dw AS (SELECT doc_id, run, substr(t, i, run) AS w FROM (SELECT doc_id, run, t, unnest(range(1, length(t) - run + 2)) AS i FROM d WHERE length(t) >= run))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run, w)"""

_FIGURES = r"""
WITH l AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\r?\n|\r')) AS raw FROM documents),
t AS (SELECT doc_id, text, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM l)
SELECT doc_id, length(any_value(text)) AS n_chars, count(*) AS n_lines, count(*) FILTER (length(line) < 30) AS n_short,
  count(*) FILTER (regexp_matches(line, '[。！？.!?…]["”’»›」』)）\]*_]*$')) AS n_ended, count(*) FILTER (regexp_matches(line, '(?:\.\.\.|…)$')) AS n_ellipsis
FROM t WHERE line <> '' GROUP BY doc_id"""

_COMPONENTS = (
    _SIMILAR.replace("WITH d AS", "WITH RECURSIVE d AS")
    .replace("SELECT row_a, row_b FROM c JOIN", ", p AS (SELECT row_a, row_b FROM c JOIN")
    .replace(">= 0.7", ">= 0.7)")
    + """, e AS (SELECT row_a AS a, row_b AS b FROM p UNION SELECT row_b, row_a FROM p),
r AS (SELECT row_id, row_id AS g FROM n UNION SELECT e.b AS row_id, r.g FROM r JOIN e ON e.a = r.row_id)
SELECT row_id, min(g) AS group_id FROM r GROUP BY row_id"""
)

SQL: dict[str, str] = {
    "p7_groups": _COMPONENTS,
    "p8_found": _LEAKED,
    "p10_figures": _FIGURES,
    "p7_found": _SIMILAR,
    "p5_found": _UNITS,
    "p4_found": _SAME_LINES + "SELECT row_id, CAST(line_no AS BIGINT) AS line_no FROM keyed SEMI JOIN excess USING (platform, k)",
    "p4_cleaned": _SAME_LINES
    + """, kept AS (SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) AS md FROM keyed ANTI JOIN excess USING (platform, k) GROUP BY ALL)
SELECT a.row_id, a.platform, CASE WHEN a.platform IS NULL THEN a.content_markdown WHEN a.content_markdown IS NOT NULL THEN coalesce(kept.md, '') END AS content_markdown
FROM article_cache a LEFT JOIN kept ON kept.row_id = a.row_id""",
}
