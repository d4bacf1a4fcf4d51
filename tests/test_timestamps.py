from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from inkloom.functions.timeparse import local_to_utc, parse_written
from inkloom.operators.timestamps import TimestampDictionary, normalise_times
from inkloom.session import fresh_path


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("raw", "zone", "day_first", "expected"),
    [
        ("2024-05-01 10:00:00", "Asia/Shanghai", False, utc(2024, 5, 1, 2)),
        ("2024年5月1日 下午1:05", "Asia/Shanghai", False, utc(2024, 5, 1, 5, 5)),
        ("２０２４－０５－０１ １０：００", "Asia/Shanghai", False, utc(2024, 5, 1, 2)),
        ("发布于 2024.05.01 10:00", "Asia/Shanghai", False, utc(2024, 5, 1, 2)),
        ("05/04/2024 10:00", "Europe/Paris", True, utc(2024, 4, 5, 8)),
        ("05/04/2024 10:00", "America/New_York", False, utc(2024, 5, 4, 14)),
        ("1714528800", None, None, 1714528800),
        ("1714528800123", None, None, 1714528800),
        ("20240501100000", "Asia/Shanghai", False, utc(2024, 5, 1, 2)),
        ("2024-05-01T10:00:00.5+02:00", None, None, utc(2024, 5, 1, 8)),
        ("Wed, 01 May 2024 10:00:00 GMT", None, None, utc(2024, 5, 1, 10)),
        ("Wed May 01 10:00:00 +0800 2024", None, None, utc(2024, 5, 1, 2)),
        ("Wed May 01 2024 10:00:00 GMT+0800", None, None, utc(2024, 5, 1, 2)),
        ("May 1, 2024 10:00 PM", "America/New_York", False, utc(2024, 5, 2, 2)),
        ("1. Mai 2024, 10:00 Uhr", "Europe/Berlin", True, utc(2024, 5, 1, 8)),
        ("1 août 2024 à 10h05", "Europe/Paris", True, utc(2024, 8, 1, 8, 5)),
        ("1 de mayo de 2024, 10:00", "Europe/Madrid", True, utc(2024, 5, 1, 8)),
        ("2024-10-27 02:30 CEST", "Europe/Berlin", True, utc(2024, 10, 27, 0, 30)),
    ],
)
def test_instants(raw, zone, day_first, expected):
    assert parse_written(raw, zone, day_first)[:2] == ("instant", expected)


@pytest.mark.parametrize("raw", [None, "", "  ", "2024-05-01", "2024-13-01 10:00", "2024-02-30 10:00", "Invalid Date", "1.6e9", "刚刚", "昨天", "2024-05-01 25:00", "x" * 100_000])
def test_unknown(raw):
    assert parse_written(raw, "Asia/Shanghai", False)[0] == "unknown"


def test_clock_changes():
    assert local_to_utc(datetime(2024, 3, 31, 2, 30), "Europe/Berlin") is None  # skipped
    assert local_to_utc(datetime(2024, 10, 27, 2, 30), "Europe/Berlin") is None  # twice
    assert local_to_utc(datetime(2024, 10, 27, 2, 30), "Europe/Berlin", "CET") == utc(2024, 10, 27, 1, 30)
    assert local_to_utc(datetime(2024, 10, 27, 2, 30), None) is None


SITES = [("a.example", "Asia/Shanghai", False), ("b.example", "Europe/Berlin", True)]


def solve(spark, rows, path=None):
    df = spark.createDataFrame(rows, "id long, publish_time string, url string, ref long, utc_sec string, raw string, zone string")
    sites = spark.createDataFrame(SITES, "host string, zone string, day_first boolean")
    dictionary = TimestampDictionary(spark, path or fresh_path(spark, "d")).open()
    out = normalise_times(df, sites, dictionary, id_col="id", time_col="publish_time", url_col="url", reference=F.col("ref"))
    return sorted((r["id"], r["utc_sec"]) for r in out.collect()), dictionary


def row(i, time, url="https://a.example/x", ref=utc(2024, 5, 10, 4)):
    return (i, time, url, ref, "clash", "clash", "clash")


def test_rows_with_references(spark):
    rows = [
        row(1, "2小时前"), row(2, "昨天 10:00"), row(3, "5月1日 10:00"), row(4, "12月31日 10:00"), row(5, None), row(6, "2024-05-01 10:00"), row(6, "2024-05-01 10:00"),
        row(7, "2024-05-01 10:00", "ftp:nowhere"), row(8, "2小时前", ref=None), row(9, "2024-05-01 10:00", "b.example/y"), row(10, "3月31日 02:30", "https://B.example/"), row(11, "2月29日 08:00", ref=utc(2023, 6, 1)),
    ]
    got, _ = solve(spark, rows)
    assert got == [
        (1, utc(2024, 5, 10, 2)), (2, utc(2024, 5, 9, 2)), (3, utc(2024, 5, 1, 2)), (4, utc(2023, 12, 31, 2)), (5, None), (6, utc(2024, 5, 1, 2)), (6, utc(2024, 5, 1, 2)),
        (7, None), (8, None), (9, utc(2024, 5, 1, 8)), (10, None), (11, utc(2020, 2, 29)),
    ]


def test_empty_table(spark):
    assert solve(spark, [])[0] == []


def test_dictionary_only_grows_by_new_keys(spark):
    path = fresh_path(spark, "grow")
    _, first = solve(spark, [row(1, "2024-05-01 10:00"), row(2, "昨天 10:00")], path)
    assert first.entries().count() == 2
    _, second = solve(spark, [row(3, "2024-05-01 10:00"), row(4, "2024-06-01 10:00")], path)
    assert second.batches == 2 and second.entries().count() == 3
