import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from newsloom.operators.stamps import parse_stamps, with_site_clock

UTC = timezone.utc


def us(d):
    return int((d - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def parse(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z string, o string")
    return [r["at"] for r in parse_stamps(df, "t", "z", "o", "at").orderBy("i").collect()]


CASES = [
    ("2026-07-08T19:33:22.668979958Z", "2026-07-08T19:33:22.668979+00:00"), ("20260704T093705Z", "2026-07-04T09:37:05+00:00"), ("1783240895848", "2026-07-05T08:41:35.848+00:00"),
    ("July 7, 2026 at 10:06 a.m. ET", "2026-07-07T14:06+00:00"), ("2026-07-08T19:33:22[Australia/Sydney]", "2026-07-08T09:33:22+00:00"), ("Sun, 12 Jul 2026 21:13:29 +0100", "2026-07-12T20:13:29+00:00"),
    ("11 jul 2026 18:19:12 UTC-5", "2026-07-11T23:19:12+00:00"), ("01 jul 2026 03:52:28 UTC+5:30", "2026-06-30T22:22:28+00:00"), ("1 juillet 2026 à 0h33", "2026-06-30T22:33+00:00"),
    ("9. März 2025, 08:04 Uhr", "2025-03-09T07:04+00:00"), ("13 de marzo de 2026, 18:52 h", "2026-03-13T17:52+00:00"), ("Friday 1 May 2026 01:47", "2026-04-30T23:47+00:00"),
    ("Jul 2, 2026, 12:03 AM JST", "2026-07-01T15:03+00:00"), (" 06/07/2026 08:28\n", "2026-07-06T06:28+00:00"), ("2026-01-06 22:22:53.872875 -06:00", "2026-01-07T04:22:53.872875+00:00"),
    ("2024-02-29 00:00", "2024-02-28T23:00+00:00"),
]
NONE = [None, "", " ", "TBD", "yesterday", "2 hours ago", "just now", "2026-07-08", "20260708", "July 10, 2026", "2026-13-05 08:00", "31/31/2026 10:00", "0000-00-00 00:00:00", "25:61", "1/0", "2025-02-30T10:15:00Z", "13:70", "2026-07-08 24:30", "7/7/2026 13:05 PM", "x" * 100_000]


def test_formats(spark):
    got = parse(spark, [(t, "Europe/Madrid", "DMY") for t, _ in CASES] + [(t, "Europe/Madrid", "DMY") for t in NONE])
    assert got == [us(datetime.fromisoformat(x)) for _, x in CASES] + [None] * len(NONE)


def test_date_order_and_unknown_sites(spark):
    rows = [("02/03/2026 10:00", "UTC", "MDY"), ("02/03/2026 10:00", "UTC", "DMY"), ("02/03/2026 10:00", "UTC", None), ("2026-03-02 10:00", None, None), ("2026-03-02 10:00", "Nowhere/Land", "DMY"), ("02.03.2026 10:00:00", "UTC", "MDY")]
    a, b = us(datetime(2026, 2, 3, 10, tzinfo=UTC)), us(datetime(2026, 3, 2, 10, tzinfo=UTC))
    assert parse(spark, rows) == [a, b, None, None, None, b]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles"])
def test_wall_clock_against_zoneinfo(spark, zone):
    rng = random.Random(zone)
    walls = [datetime(2025, 1, 1) + timedelta(minutes=rng.randrange(2 * 525_600)) for _ in range(150)]
    walls += [datetime(2025, m, d, h, 30) for m, d in ((3, 9), (11, 2), (3, 30), (10, 26), (4, 6), (10, 5)) for h in range(4)]
    want = []
    for w in walls:
        x = {w.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(UTC) for f in (0, 1)}
        x = {u for u in x if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == w}
        want.append(us(x.pop()) if len(x) == 1 else None)
    assert parse(spark, [(w.strftime("%Y-%m-%dT%H:%M"), zone, "DMY") for w in walls]) == want


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2026-07-08T00:00:00Z", "UTC", "DMY", 1, "x", 9)], "t string, z string, o string, __p int, __row string, at int")
    r = parse_stamps(df, "t", "z", "o", "at").first()
    assert (r["__p"], r["__row"], r["at"]) == (1, "x", us(datetime(2026, 7, 8, tzinfo=UTC)))
    assert parse_stamps(df.limit(0), "t", "z", "o").count() == 0


def test_site_clock(spark):
    sites = spark.createDataFrame([("a.example", "Asia/Tokyo", "DMY"), ("a.example", "Asia/Tokyo", "DMY"), (None, "UTC", "MDY")], "domain string, time_zone string, date_order string")
    df = spark.createDataFrame([("https://WWW.A.Example:443/x", "old"), ("https://b.example/", None), (None, None)], "url string, site_zone string")
    got = {r["url"]: r["site_zone"] for r in with_site_clock(df, "url", sites).collect()}
    assert got == {"https://WWW.A.Example:443/x": "Asia/Tokyo", "https://b.example/": None, None: None}
