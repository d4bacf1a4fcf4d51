"""Queries of the training-text operators on the smallest data."""

import os

import duckdb
import pytest

from inkloom.llm import registry


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for name in os.listdir(smallest):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{smallest}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, duck, smallest, name):
    ours = registry.QUERIES[name](spark, smallest)
    columns = sorted(ours.columns)
    theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(str, theirs))


COLUMNS = {
    "p2_found": ["row_id", "block_md5"], "p3_found": ["row_id", "field"], "p4_found": ["row_id", "line_no"], "p5_found": ["row_id", "boundary"], "p6_found": ["tbl", "row_id"],
    "p7_found": ["row_a", "row_b"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_with_its_columns(spark, smallest, name):
    df = registry.QUERIES[name](spark, smallest)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_pieces_join_to_the_text(spark, smallest):
    from pyspark.sql import functions as F

    from inkloom.session import table

    pieces = registry.QUERIES["p5_pieces"](spark, smallest)
    assert pieces.filter(F.length("piece") > 3000).count() == 0
    ordered = pieces.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", F.substr("piece", F.col("overlap").cast("int") + 1).alias("new")))).alias("p"))
    again = ordered.select("row_id", F.array_join(F.transform("p", lambda x: x["new"]), "").alias("again"))
    texts = table(spark, smallest, "article_cache").filter("content_markdown <> ''").select("row_id", "content_markdown")
    assert texts.join(again, "row_id").filter("content_markdown = again").count() == texts.count()
