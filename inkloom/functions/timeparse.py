"""Exhaustive parser for written points in time.

``parse_written`` turns one raw string, read with a site's zone and date order,
into a rule: an absolute second, or something that still needs the record's
reference instant (a stated distance, a day word, a date without year).
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

MONTHS: dict[str, int] = {}
for _i, _names in enumerate(
    (
        "jan january januar janvier enero",
        "feb february februar février fevrier febrero",
        "mar march märz maerz mars marzo",
        "apr april avril abril",
        "may mai mayo",
        "jun june juni juin junio",
        "jul july juli juillet julio",
        "aug august août aout agosto",
        "sep sept september septembre septiembre setiembre",
        "oct okt october oktober octobre octubre",
        "nov november novembre noviembre",
        "dec dez dic déc december dezember décembre decembre diciembre",
    ),
    1,
):
    for _n in _names.split():
        MONTHS[_n] = _i

UNITS: dict[str, int] = {}
for _secs, _names in (
    (1, "秒 秒钟 s sec secs second seconds sekunde sekunden seconde secondes segundo segundos"),
    (60, "分 分钟 分鐘 min mins minute minutes minuten minuto minutos"),
    (3600, "小时 小時 个小时 h hour hours hr hrs stunde stunden heure heures hora horas"),
    (86400, "天 日 d day days tag tage tagen jour jours día días dia dias"),
    (604800, "周 星期 个星期 week weeks woche wochen semaine semaines semana semanas"),
):
    for _n in _names.split():
        UNITS[_n] = _secs

DAY_WORDS: dict[str, int] = {
    "今天": 0, "昨天": 1, "昨日": 1, "前天": 2, "today": 0, "yesterday": 1,
    "heute": 0, "gestern": 1, "vorgestern": 2, "aujourd'hui": 0, "hier": 1, "avant-hier": 2,
    "hoy": 0, "ayer": 1, "anteayer": 2,
}

_PREFIX = re.compile(
    r"^(?:发布于|发表于|发布时间|更新于|编辑于|published(?:\s+on)?|posted(?:\s+on)?|updated(?:\s+on)?|ver[öo]ffentlicht\s+am|publi[ée]\s+le|publicado\s+el)\s*[:：]?\s*",
    re.I,
)
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}(?:[+-]\d{1,2}:?\d{2})?|[+-]\d{2}:?\d{2}|[+-]\d{2}))?"
_ISO = re.compile(rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ,]*{_CLOCK}{_HALF}{_ZONE}$")
_CJK = re.compile(rf"^(?:(\d{{4}})年)?(\d{{1,2}})月(\d{{1,2}})[日号]\s*(上午|下午|凌晨|早上|中午|晚上|傍晚)?\s*(\d{{1,2}})(?:[:时點点])(\d{{1,2}})?分?(?::?(\d{{2}})秒?)?{_ZONE}$")
_SHORT = re.compile(rf"^(\d{{1,2}})[-/](\d{{1,2}})[ ]+{_CLOCK}{_HALF}$")
_DMY = re.compile(rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})[ ,]*{_CLOCK}{_HALF}{_ZONE}$")
_RFC = re.compile(rf"^(?:[^\W\d_]{{2,10}}\.?,?\s+)?(\d{{1,2}})[. -]\s*([^\W\d_]{{3,9}})\.?[ ,-]+(\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$")
_CTIME = re.compile(rf"^(?:[^\W\d_]{{2,10}}\.?,?\s+)?([^\W\d_]{{3,9}})\.?\s+(\d{{1,2}}),?\s+{_CLOCK}{_ZONE}\s+(\d{{4}})$")
_MDY = re.compile(rf"^(?:[^\W\d_]{{2,10}}\.?,?\s+)?([^\W\d_]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE}(?:\s*\([^)]*\))?$")
_WORDY = re.compile(rf"^(\d{{1,2}})\.?\s+(?:de\s+)?([^\W\d_]{{3,10}})\.?\s+(?:de\s+)?(\d{{4}})\s*,?\s*(?:à|a\s+las|um|at)?\s*{_CLOCK}(?:\s*uhr)?{_ZONE}$", re.I)
_WORDY_SHORT = re.compile(rf"^(\d{{1,2}})\.?\s+(?:de\s+)?([^\W\d_]{{3,10}})\.?\s*,?\s*(?:à|a\s+las|um|at)?\s*{_CLOCK}(?:\s*uhr)?$", re.I)
_MD_SHORT = re.compile(rf"^([^\W\d_]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}$")
_AGO = re.compile(r"^(?:vor|hace|il y a)?\s*(\d{1,6}|an?|une?|ein(?:e[rm]?)?|半)\s*个?\s*([^\W\d_]+)\s*(?:前|ago)?$", re.I)
_DAYWORD = re.compile(rf"^({'|'.join(sorted(map(re.escape, DAY_WORDS), key=len, reverse=True))})[ ,]*(?:at|um|à|a\s+las)?\s*(上午|下午|凌晨|早上|中午|晚上|傍晚)?\s*{_CLOCK}{_HALF}(?:\s*uhr)?$", re.I)
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(Z)?$")
_OFFSET = re.compile(r"^(?:UTC|GMT|Z)?([+-])(\d{1,2}):?(\d{2})?$", re.I)
_UTC_WORDS = {"Z", "UTC", "GMT", "UT"}
_SPACES = re.compile(r"\s+")

#: (kind, utc_sec, distance_sec, day_back, month, day, second_of_day)
Parsed = tuple[str, int | None, int | None, int | None, int | None, int | None, int | None]


def _rule(kind: str, utc=None, distance=None, back=None, month=None, day=None, sod=None) -> Parsed:
    return (kind, utc, distance, back, month, day, sod)


UNKNOWN = _rule("unknown")


def _clock(h: str, m: str | None, s: str | None, half: str | None) -> int | None:
    """Seconds of the day, None where impossible."""
    hour, minute, second = int(h), int(m or 0), int(s or 0)
    if half:
        if half in "pP" or half in ("下午", "晚上", "傍晚"):
            if hour > 23 or (half in "pP" and not 1 <= hour <= 12):
                return None
            hour = hour + 12 if hour < 12 else hour
        elif half == "中午":
            hour = hour + 12 if hour < 11 else hour
        else:
            if half in "aA" and not 1 <= hour <= 12:
                return None
            hour = 0 if hour == 12 else hour
    if hour > 23 or minute > 59 or second > 59:
        return None
    return hour * 3600 + minute * 60 + second


_ZONES: dict[str, ZoneInfo | None] = {}


def _zone(name: str | None) -> ZoneInfo | None:
    if name not in _ZONES:
        try:
            _ZONES[name] = ZoneInfo(name) if name else None
        except Exception:
            _ZONES[name] = None
    return _ZONES[name]


def local_to_utc(local: datetime, zone: str | None, abbreviation: str | None = None) -> int | None:
    """The one UTC second of a wall-clock time; None if skipped, shown twice or without zone.

    A zone abbreviation decides between the two readings of a repeated hour.
    """
    z = _zone(zone)
    if z is None:
        return None
    found = []
    for fold in (0, 1):
        aware = local.replace(tzinfo=z, fold=fold)
        utc = aware.astimezone(timezone.utc)
        if utc.astimezone(z).replace(tzinfo=None) == local:
            found.append((int(utc.timestamp()), aware.tzname()))
    instants = {u for u, _ in found}
    if len(instants) > 1 and abbreviation:
        instants = {u for u, name in found if name == abbreviation.upper()}
    return instants.pop() if len(instants) == 1 else None


def _absolute(y, mo, d, sod, zone_text, zone) -> Parsed:
    if sod is None or mo is None:
        return UNKNOWN
    try:
        local = datetime(int(y), int(mo), int(d)) + timedelta(seconds=sod)
    except (ValueError, OverflowError):
        return UNKNOWN
    text = (zone_text or "").strip()
    if text.upper() in _UTC_WORDS:
        return _rule("instant", utc=int(local.replace(tzinfo=timezone.utc).timestamp()))
    if m := _OFFSET.match(text):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return UNKNOWN
        shift = (hours * 3600 + minutes * 60) * (1 if m[1] == "+" else -1)
        return _rule("instant", utc=int(local.replace(tzinfo=timezone.utc).timestamp()) - shift)
    utc = local_to_utc(local, zone, text or None)
    return UNKNOWN if utc is None else _rule("instant", utc=utc)


def _yearless(mo, d, sod) -> Parsed:
    if sod is None or mo is None:
        return UNKNOWN
    try:
        datetime(2000, int(mo), int(d))
    except ValueError:
        return UNKNOWN
    return _rule("yearless", month=int(mo), day=int(d), sod=sod)


def _am_pm_zone(half, zone_text):
    """An am/pm mark that the zone pattern swallowed."""
    if not half and zone_text and zone_text.upper() in ("AM", "PM"):
        return zone_text[0], None
    return half, zone_text


def parse_written(raw: str | None, zone: str | None, day_first: bool | None) -> Parsed:
    """Read one written time.

    Absolute forms come out as ``instant``; ``distance``, ``dayword`` and
    ``yearless`` need a reference instant; everything else (empty, a bare date,
    an impossible or unreadable value, a local time the zone skipped or showed
    twice) is ``unknown``.
    """
    if raw is None:
        return UNKNOWN
    s = unicodedata.normalize("NFKC", raw).replace("：", ":").replace("−", "-").replace("–", "-")
    s = _SPACES.sub(" ", s).strip()
    s = _PREFIX.sub("", s).strip()
    if not s:
        return UNKNOWN
    if s.isdigit() and s.isascii():
        if len(s) == 10:
            return _rule("instant", utc=int(s))
        if len(s) == 13:
            return _rule("instant", utc=int(s) // 1000)
        if len(s) == 16:
            return _rule("instant", utc=int(s) // 1_000_000)
    if m := re.match(r"^(\d{10})\.\d+$", s):
        return _rule("instant", utc=int(m[1]))
    if m := _COMPACT.match(s):
        return _absolute(m[1], m[2], m[3], _clock(m[4], m[5], m[6], None), m[7], zone)
    if m := _ISO.match(s):
        half, z = _am_pm_zone(m[8], m[9])
        return _absolute(m[1], m[2], m[3], _clock(m[4], m[5], m[6], half), z, zone)
    if m := _CJK.match(s):
        sod = _clock(m[5], m[6], m[7], m[4])
        return _absolute(m[1], m[2], m[3], sod, m[8], zone) if m[1] else _yearless(m[2], m[3], sod)
    if m := _DMY.match(s):
        half, z = _am_pm_zone(m[9], m[10])
        first = True if m[2] == "." or day_first is None else day_first
        d, mo = (m[1], m[3]) if first else (m[3], m[1])
        return _absolute(m[4], mo, d, _clock(m[5], m[6], m[7], half), z, zone)
    if m := _DAYWORD.match(s):
        sod = _clock(m[3], m[4], m[5], m[2] or m[7])
        return UNKNOWN if sod is None else _rule("dayword", back=DAY_WORDS[m[1].lower()], sod=sod)
    if m := _RFC.match(s):
        half, z = _am_pm_zone(m[8], m[9])
        return _absolute(m[3], MONTHS.get(m[2].lower()), m[1], _clock(m[4], m[5], m[6], half), z, zone)
    if m := _CTIME.match(s):
        return _absolute(m[8], MONTHS.get(m[1].lower()), m[2], _clock(m[3], m[4], m[5], None), m[7], zone)
    if m := _MDY.match(s):
        half, z = _am_pm_zone(m[8], m[9])
        return _absolute(m[3], MONTHS.get(m[1].lower()), m[2], _clock(m[4], m[5], m[6], half), z, zone)
    if m := _WORDY.match(s):
        return _absolute(m[3], MONTHS.get(m[2].lower()), m[1], _clock(m[4], m[5], m[6], None), m[8], zone)
    if m := _SHORT.match(s):
        first = bool(day_first) and "/" in s
        d, mo = (m[1], m[2]) if first else (m[2], m[1])
        return _yearless(mo, d, _clock(m[3], m[4], m[5], m[7]))
    if m := _WORDY_SHORT.match(s):
        if m[2].lower() in MONTHS:
            return _yearless(MONTHS[m[2].lower()], m[1], _clock(m[3], m[4], m[5], None))
    if m := _MD_SHORT.match(s):
        if m[1].lower() in MONTHS:
            return _yearless(MONTHS[m[1].lower()], m[2], _clock(m[3], m[4], m[5], m[7]))
    if m := _AGO.match(s):
        said = bool(re.search(r"前$|\bago$|^vor\b|^hace\b|^il y a\b", s, re.I))
        unit = UNITS.get(m[2].lower()) or UNITS.get(m[2].lower().removesuffix("前"))
        if said and unit:
            n = m[1].lower()
            size = unit // 2 if n == "半" else unit * (int(n) if n.isdigit() else 1)
            return _rule("distance", distance=size)
    return UNKNOWN
