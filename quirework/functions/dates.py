"""Parsing of written dates in many notations, and conversion of local times to UTC.

Everything here is plain Python on one string; ``operators/timestamps.py`` runs it in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names as written in the languages of publisher metadata, January to December.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "sv": "januari februari mars april maj juni juli augusti september oktober november december",
    "da": "januar februar marts april maj juni juli august september oktober november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia wrzesnia pazdziernika listopada grudnia",
    "cs": "ledna unora brezna dubna kvetna cervna cervence srpna zari rijna listopadu prosince",
    "tr": "ocak subat mart nisan mayis haziran temmuz agustos eylul ekim kasim aralik",
}

# Zone abbreviations with their fixed offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630,
    "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300, "BRT": -180, "ART": -180, "NST": -210, "NDT": -150,
}


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.replace("ı", "i").replace("ł", "l")) if not unicodedata.combining(c)).lower()


def _months() -> dict[str, int]:
    out: dict[str, int] = {}
    for names in MONTH_NAMES.values():
        for number, name in enumerate(names.split(), 1):
            out.setdefault(name, number)
    for number, name in enumerate(MONTH_NAMES["en"].split(), 1):
        out.setdefault(name[:3], number)
        out.setdefault(name[:4], number)
    for names in MONTH_NAMES.values():
        for number, name in enumerate(names.split(), 1):
            out.setdefault(name[:3], number)
    return out


MONTHS = _months()
_ORDINAL_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th|\.|er|º)?"
_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2}|[Zz])?\s*(?:\[(?P<zone>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]|(?P<zone2>[A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)|(?P<abbr>[A-Z]{1,5}))?)"
_TIME = rf"(?:(?:\s*,\s*|\s+|[Tt])(?P<time>{_CLOCK}{_ZONE}))?"
_WORD = r"(?P<mon>[^\W\d_]{3,})\.?"

_FORMS = [
    ("ymd", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_TIME}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<sep>[/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TIME}")),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[Tt ]?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,]\d+)?(?P<off>[Zz]|[+-]\d{2}:?\d{2})?)?")),
    ("numeric", re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<yy>\d{{4}}|\d{{2}}){_TIME}")),
    ("week", re.compile(rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})(?:-?(?P<wd>[1-7])){_TIME}")),
    ("ordinal", re.compile(rf"(?P<y>\d{{4}})-(?P<j>\d{{3}}){_TIME}")),
    ("month", re.compile(r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})")),
    ("month", re.compile(r"(?P<m>\d{1,2})[-/.](?P<y>\d{4})")),
    ("year", re.compile(r"(?P<y>\d{4})")),
    ("epoch", re.compile(r"(?P<n>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})")),
    ("words", re.compile(rf"(?:[^\W\d_]{{2,}}\.?,?\s+)?{_ORDINAL_DAY}(?:\s+|-|\s+de\s+){_WORD}(?:\s+|-|,\s*|\s+de\s+)(?P<y>\d{{4}}){_TIME}")),
    ("words", re.compile(rf"(?:[^\W\d_]{{2,}}\.?,\s+)?{_WORD}\s+{_ORDINAL_DAY},?\s+(?P<y>\d{{4}}){_TIME}")),
    ("monthword", re.compile(rf"{_WORD}(?:\s+|,\s*|\s+de\s+)(?P<y>\d{{4}})")),
]


@lru_cache(maxsize=1024)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown or malformed names
        return None


def to_utc(local: datetime, zone: ZoneInfo) -> datetime:
    """UTC of a wall time: the first of two occurrences; a skipped time is read with the offset before the change."""
    return (local - local.replace(tzinfo=zone, fold=0).utcoffset()).replace(tzinfo=timezone.utc)


def parse_date(text: str | None, order: str | None, tz: str | None) -> tuple[str | None, str]:
    """(normal form, status) of one written date.

    ``order`` is the order of all-numeric dates (dmy, mdy or ymd), ``tz`` the zone of times without one. Status is
    one of ``time``, ``day``, ``month``, ``year``; or, with no normal form: ``empty``, ``unparsed`` (approximate dates,
    ranges, words), ``impossible`` (no such date, time or zone) and ``no_zone`` (a local time with no usable zone).
    """
    raw = (text or "").strip()
    if not raw:
        return None, "empty"
    for kind, form in _FORMS:
        m = form.fullmatch(raw)
        if not m:
            continue
        g = m.groupdict()
        try:
            if kind == "epoch":
                return _epoch(g["n"])
            if kind in ("month", "year", "monthword"):
                if kind == "monthword" and _plain(g["mon"]) not in MONTHS:
                    continue
                year = int(g["y"])
                month = MONTHS[_plain(g["mon"])] if kind == "monthword" else int(g["m"]) if kind == "month" else None
                if month is None:
                    return f"{date(year, 1, 1).year:04d}", "year"
                return f"{date(year, month, 1):%Y-%m}".rjust(7, "0"), "month"
            day = _day(kind, g, order)
        except KeyError:
            continue
        except ValueError:
            return None, "impossible"
        if not g.get("H"):
            return f"{day.year:04d}-{day:%m-%d}", "day"
        try:
            return _moment(day, g, tz)
        except (ValueError, OverflowError):
            return None, "impossible"
    return None, "unparsed"


def _day(kind: str, g: dict, order: str | None) -> date:
    if kind in ("ymd", "compact"):
        return date(int(g["y"]), int(g["m"]), int(g["d"]))
    if kind == "week":
        return date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"]))
    if kind == "ordinal":
        day = date(int(g["y"]), 1, 1) + timedelta(int(g["j"]) - 1)
        if int(g["j"]) < 1 or day.year != int(g["y"]):
            raise ValueError("day of year")
        return day
    if kind == "words":
        return date(int(g["y"]), MONTHS[_plain(g["mon"])], int(g["d"]))
    a, b, last = int(g["a"]), int(g["b"]), g["yy"]
    if order == "ymd" and len(last) == 2:
        return date(2000 + a, b, int(last))
    year = int(last) if len(last) == 4 else 2000 + int(last)
    return date(year, a, b) if order == "mdy" else date(year, b, a)


def _epoch(digits: str) -> tuple[str | None, str]:
    scale = {10: 1, 9: 1, 13: 10**3, 12: 10**3, 16: 10**6, 15: 10**6, 19: 10**9, 18: 10**9}[len(digits)]
    return _written(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(digits) // scale)), "time"


def _written(moment: datetime) -> str:
    return f"{moment.year:04d}-{moment:%m-%dT%H:%M:%S}Z"


def _moment(day: date, g: dict, tz: str | None) -> tuple[str | None, str]:
    hour, minute, second = int(g["H"]), int(g["M"]), int(g["S"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            raise ValueError("hour")
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    midnight = hour == 24 and minute == second == 0
    local = datetime(day.year, day.month, day.day, 0 if midnight else hour, minute, 59 if second == 60 else second)
    local += timedelta(days=1) if midnight else timedelta(seconds=1) if second == 60 else timedelta()
    offset, abbr, name = g.get("off"), g.get("abbr"), g.get("zone") or g.get("zone2")
    if name in ABBREVIATIONS and not zone_of(name):
        abbr, name = name, None
    if offset:
        if offset in "Zz":
            minutes = 0
        else:
            digits = offset[1:].replace(":", "").ljust(4, "0")
            minutes = int(digits[:2]) * 60 + int(digits[2:])
            if int(digits[:2]) > 18 or int(digits[2:]) > 59:
                raise ValueError("offset")
            minutes = -minutes if offset[0] == "-" else minutes
    elif abbr:
        if abbr not in ABBREVIATIONS:
            return None, "unparsed"
        minutes = ABBREVIATIONS[abbr]
    else:
        zone = zone_of(name) if name else zone_of(tz) if tz else None
        if zone is None:
            return None, "no_zone"
        return _written(to_utc(local, zone)), "time"
    return _written((local - timedelta(minutes=minutes)).replace(tzinfo=timezone.utc)), "time"


def local_time(text: str | None, order: str | None) -> datetime | None:
    """The wall time of a string that gives a time of day without any zone; None for everything else."""
    if parse_date(text, order, None)[1] != "no_zone":
        return None
    written = parse_date(text, order, "UTC")[0]
    return datetime.strptime(written, "%Y-%m-%dT%H:%M:%SZ")
