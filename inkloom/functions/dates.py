"""Dates as filters need them: only the day, unknown where unreadable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import trim_ws


def fuzzy_date(text: Column, as_of: Column) -> Column:
    """Day of a written time, in its own offset; NULL where unreadable.

    In this order: a date with '-', '/', '.' or 年 anywhere; epoch
    milliseconds; epoch seconds (both as days in UTC+8); month and day in the
    year of ``as_of``, or the year before if that is still to come; the mail
    form; just now, yesterday, the day before; a stated distance.
    """
    s = trim_ws(text)
    ymd = r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    full = day(F.regexp_extract(s, ymd, 1), F.regexp_extract(s, ymd, 2), F.regexp_extract(s, ymd, 3))
    epoch0 = F.lit("1970-01-01").cast("date")
    ms = F.when(s.rlike("^[0-9]{13}$"), F.date_add(epoch0, F.floor((s.try_cast("long") / 1000 + 28800) / 86400).cast("int")))
    sec = F.when(s.rlike("^[0-9]{10}$"), F.date_add(epoch0, F.floor((s.try_cast("long") + 28800) / 86400).cast("int")))
    md = r"^([0-9]{1,2})[-/月]([0-9]{1,2})"
    m, d = F.regexp_extract(s, md, 1), F.regexp_extract(s, md, 2)
    this = day(F.year(as_of).cast("string"), m, d)
    short = F.when(s.rlike(md), F.when(this <= as_of, this).otherwise(day((F.year(as_of) - 1).cast("string"), m, d)))
    mail = r"([0-9]{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{4})"
    tail = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{1,2}) .*([0-9]{4})$"
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"

    def named(name: Column) -> Column:
        return F.floor((F.position(name, F.lit(months)) + 2) / 3).cast("string")

    rfc = F.when(s.rlike(mail), day(F.regexp_extract(s, mail, 3), named(F.regexp_extract(s, mail, 2)), F.regexp_extract(s, mail, 1)))
    blog = F.when(s.rlike(tail), day(F.regexp_extract(s, tail, 3), named(F.regexp_extract(s, tail, 1)), F.regexp_extract(s, tail, 2)))
    word = F.when(s.rlike("^刚刚|^今天"), as_of).when(s.rlike("^昨天"), F.date_sub(as_of, 1)).when(s.rlike("^前天"), F.date_sub(as_of, 2))
    ago = F.when(s.rlike("^[0-9]+ ?(?:分钟|小时)前"), as_of).when(s.rlike("^[0-9]{1,4} ?天前"), F.date_sub(as_of, F.regexp_extract(s, "^([0-9]{1,4})", 1).try_cast("int")))
    return F.coalesce(full, ms, sec, short, rfc, blog, word, ago)


def date_part(text: Column) -> Column:
    """First ``YYYY-MM-DD[ HH:MM[:SS]]`` of a text, '' if there is none."""
    return F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?)", 1)


def show_epoch(text: Column, zone_hours: int = 8) -> Column:
    """Epoch seconds or milliseconds as ``yyyy-MM-dd HH:mm:ss`` in UTC+zone_hours, '' where unreadable."""
    s = trim_ws(text)
    n = s.try_cast("long")
    sec = F.when(s.rlike("^[0-9]{13}$"), F.floor(n / 1000)).when(s.rlike("^[0-9]{10}$"), n)
    local = sec + zone_hours * 3600
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / 86400).cast("int")), "yyyy-MM-dd")
    t = F.pmod(local, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("int"), F.floor(t % 3600 / 60).cast("int"), (t % 60).cast("int"))
    return F.when(sec.isNull(), F.lit("")).otherwise(F.concat_ws(" ", day, clock))


def show_datetime(text: Column, zone_hours: int = 8) -> Column:
    """ISO times with 'T' and epoch seconds as ``yyyy-MM-dd HH:mm:ss``; others as they are."""
    s = trim_ws(text)
    iso = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    clock = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})", 2)
    return F.when(iso != "", F.concat_ws(" ", iso, clock)).when(s.rlike("^[0-9]{10}$"), show_epoch(s, zone_hours)).otherwise(s)
