import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions.dates import parse_date
from quirework.operators import timestamps
from quirework.operators.timestamps import estimate_zones, normalise_dates


@pytest.mark.parametrize(("text", "order", "tz", "expected"), [
    ("2013", "dmy", "UTC", "2013"), ("Dec 2015", "dmy", "UTC", "2015-12"), ("12/2014", "mdy", "UTC", "2014-12"), ("2014-084", "dmy", "UTC", "2014-03-25"), ("2024-W11-7", "dmy", "UTC", "2024-03-17"),
    ("04/05/22", "mdy", "UTC", "2022-04-05"), ("04/05/22", "dmy", "UTC", "2022-05-04"), ("13-12-2019", "dmy", "UTC", "2019-12-13"), ("13-12-2019", "mdy", "UTC", None), ("2023/02/14", "ymd", "UTC", "2023-02-14"),
    ("Fri, 18 Sep 2020 08:00:17 +0930", "dmy", "UTC", "2020-09-17T22:30:17Z"), ("January 24, 2022 12:03 AM", "mdy", "Asia/Tokyo", "2022-01-23T15:03:00Z"), ("24.10.11", "dmy", "UTC", "2011-10-24"),
    ("2009-08-26 19:34:44 Australia/Sydney", "dmy", "UTC", "2009-08-26T09:34:44Z"), ("2012-12-25 20:06:02 [Europe/Berlin]", "dmy", "UTC", "2012-12-25T19:06:02Z"), ("2021-07-07 23:11:18 EST", "mdy", "UTC", "2021-07-08T04:11:18Z"),
    ("2020-01-23T24:00:00Z", "dmy", "UTC", "2020-01-24T00:00:00Z"), ("2011-10-10T09:40:53+02:00[Europe/Berlin]", "dmy", "UTC", "2011-10-10T07:40:53Z"), ("20221015T213802Z", "dmy", "UTC", "2022-10-15T21:38:02Z"),
    ("1355886924", "dmy", "UTC", "2012-12-19T03:15:24Z"), ("1355886924203981", "dmy", "UTC", "2012-12-19T03:15:24Z"), ("4 de enero de 2018", "dmy", "UTC", "2018-01-04"), ("27. März 2008", "dmy", "UTC", "2008-03-27"), ("12 août 2014", "dmy", "UTC", "2014-08-12"),
    ("2018-10-28 02:30", "dmy", "Europe/Berlin", "2018-10-28T00:30:00Z"),  # occurs twice: the first
    ("2024-03-31T02:30:00", "dmy", "Europe/Berlin", "2024-03-31T01:30:00Z"),  # skipped: offset before the change
    ("2016-04-11T11:00:00,651z", "dmy", "UTC", "2016-04-11T11:00:00Z"), ("  11/07/2009 ", "dmy", "UTC", "2009-07-11"),
    ("2013-02-30", "dmy", "UTC", None), ("c. 2020", "dmy", "UTC", None), ("[2013?]", "dmy", "UTC", None), ("2016-2018", "dmy", "UTC", None), ("n.d.", "dmy", "UTC", None), ("", "dmy", "UTC", None), (None, None, None, None),
    ("2015-01-16 00:00", "dmy", None, None), ("2015-01-16 00:00", "dmy", "No/Where", None), ("2015-01-16 25:00Z", "dmy", "UTC", None), ("99/99/9999", "dmy", "UTC", None), ("x" * 10000, "dmy", "UTC", None),
])
def test_forms(text, order, tz, expected):
    assert parse_date(text, order, tz)[0] == expected


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=dt.datetime(1980, 1, 1), max_value=dt.datetime(2037, 12, 31)), st.integers(-12 * 4, 14 * 4))
def test_offsets_round_trip(moment, quarters):
    zone = dt.timezone(dt.timedelta(minutes=15 * quarters))
    text = moment.replace(microsecond=0, tzinfo=zone).isoformat()
    assert parse_date(text, "dmy", "Asia/Tokyo")[0] == moment.replace(microsecond=0, tzinfo=zone).astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_operator_edge_cases(spark):
    data = [(1, "2010-01-02 03:04", "dmy", "Asia/Tokyo", "a"), (1, "2010-01-02 03:04", "dmy", "Asia/Tokyo", "a"), (2, None, None, None, None), (3, "04/05/2010", None, None, "c")]
    frame = spark.createDataFrame(data, "id int, d string, o string, z string, normal_form string")  # a clashing extra column
    got = {(r.id, r.normal_form, r.date_status) for r in normalise_dates(frame, "d", "o", "z").collect()}
    assert got == {(1, "2010-01-01T18:04:00Z", "time"), (2, None, "empty"), (3, "2010-05-04", "day")}
    assert normalise_dates(frame.where("false"), "d", "o", "z").count() == 0


def test_zones_are_estimated_from_ingestion(spark):
    rows = []
    from zoneinfo import ZoneInfo

    for group, zone in ((1, "America/New_York"), (2, "Asia/Tokyo"), (3, "Europe/Berlin")):
        for day in range(1, 300, 7):
            at = dt.datetime(2022, 1, 1, 12, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)
            rows.append((group, at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M"), (at + dt.timedelta(minutes=3)).replace(tzinfo=None)))
    frame = spark.createDataFrame([*rows, (4, None, None), (4, "2020", dt.datetime(2022, 1, 1))], "g int, d string, at timestamp").withColumn("order", F.lit("dmy"))
    got = {r.g: (r.tz, r.n_violations) for r in estimate_zones(frame, "g", "d", "at").collect()}
    assert got == {1: ("America/New_York", 0), 2: ("Asia/Tokyo", 0), 3: ("Europe/Berlin", 0)}


def test_instants_equal_zoneinfo():
    import random

    from quirework.functions.dates import to_utc, zone_of

    rng = random.Random(1)
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Bogota", "Australia/Lord_Howe", "Asia/Kathmandu"):
        zone = zone_of(name)
        walls = [dt.datetime(2008, 1, 1) + dt.timedelta(seconds=rng.randrange(16 * 365 * 86400)) for _ in range(500)]
        walls += [dt.datetime(2012, m, d, h, 30) for m, d in ((3, 11), (3, 25), (10, 28), (11, 4), (4, 1), (10, 7)) for h in (0, 1, 2, 3)]
        first, last, skipped = timestamps.instants(np.array([int(w.replace(tzinfo=dt.timezone.utc).timestamp()) for w in walls]), timestamps._history_of(name))
        for w, a, b, gap in zip(walls, first, last, skipped):
            moment = to_utc(w, zone)
            assert a == moment.timestamp() and gap == (moment.astimezone(zone).replace(tzinfo=None) != w)
            assert gap or b == (w - w.replace(tzinfo=zone, fold=1).utcoffset()).replace(tzinfo=dt.timezone.utc).timestamp()


def test_every_history_is_a_candidate():
    zones = timestamps.histories()
    assert len(zones) > 200 and all(any(timestamps.same_history(z, n) for n in zones) for z in ("Asia/Kathmandu", "America/St_Johns", "Pacific/Chatham", "Europe/Rome"))
    assert timestamps.same_history("Europe/Rome", "Europe/Berlin") and not timestamps.same_history("Europe/Rome", None) and not timestamps.same_history("Europe/Rome", "Europe/Lisbon")


@pytest.mark.parametrize("parts", [1, 5])
def test_zones_are_told_by_order(spark, parts):
    """Hourly local times in sequence: only the right change of the clocks never steps back and skips none; ingestion is days late."""
    from zoneinfo import ZoneInfo

    rows = []
    for group, zone in ((1, "America/New_York"), (2, "Europe/Berlin"), (None, "Asia/Kathmandu")):
        for hour in range(0, 24 * 330, 5):
            at = dt.datetime(2022, 1, 1, 12, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour, minutes=30)
            rows.append((group, hour, at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M"), (at + dt.timedelta(minutes=hour % 7)).replace(tzinfo=None) if hour % 3 else None, "clash"))
    frame = spark.createDataFrame(rows, "g int, seq int, d string, at timestamp, w string").withColumn("order", F.lit("dmy")).repartition(parts)
    got = {r.g: r for r in timestamps.estimate_zones(frame, "g", "d", "at", sequence="seq").collect()}
    assert {g: (r.tz, r.n_violations, r.n_local) for g, r in got.items()} == {1: ("America/New_York", 0, 1584), 2: ("Europe/Berlin", 0, 1584), None: ("Asia/Kathmandu", 0, 1584)}
    limited = timestamps.estimate_zones(frame.where("g = 2"), "g", "d", "at", sequence="seq", candidates=["America/Chicago"]).first()
    assert limited.n_violations > 0
    assert timestamps.estimate_zones(frame.where("false"), "g", "d", "at", sequence="seq").count() == 0
