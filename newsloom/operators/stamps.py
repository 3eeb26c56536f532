"""Timestamps in many formats and zones as one instant in UTC.

Every format is an alternative of one Java pattern with named groups. A single replace writes the groups of whichever
alternative matched as one delimited text, so each value is scanned once; ranges are checked and the instant is
assembled by integer day arithmetic. No step leaves the JVM. Wall-clock times are resolved by the offsets that the
zone has a day before and after: equal offsets give the instant at once, unequal ones (a transition is near) are tried
both ways, and a time that was skipped or came twice gives none.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import site
from newsloom.session import sealed

# Month names, by language.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
MORE_MONTHS = {"sept": 9, "setiembre": 9, "jänner": 1, "fevrier": 2, "aout": 8, "decembre": 12, "maerz": 3}

# Zone abbreviations with one meaning, in minutes from UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "bst": 60, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
# Abbreviations that name a wall clock rather than an offset.
WALL_CLOCKS = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

PARTS = ("epoch", "year", "month", "name", "day", "first", "second_no", "hour", "minute", "sec", "frac", "half", "sign", "oh", "om", "abbr", "region")
SEP = "\u0001"


def months() -> dict[str, int]:
    out = {n: i + 1 for names in MONTH_NAMES.values() for i, n in enumerate(names.split())}
    return out | MORE_MONTHS


def _formats() -> list[str]:
    """The alternatives; <x> opens the named group of part x."""
    name = "<name>" + "|".join(sorted(months(), key=lambda n: (-len(n), n))) + r")\.?"
    clock = r"<hour>\d{1,2}):<minute>\d{2})(?::<sec>\d{2})(?:[.,]<frac>\d+))?)?"
    offset = r"<sign>[+-])<oh>\d{1,2})(?::?<om>\d{2}))?"
    zone = rf"(?: ?(?:{offset}|(?:utc|gmt){offset}|<abbr>[a-z]{{1,5}})(?![a-z])))?(?: ?\[<region>[a-z0-9_+\-/]+)\])?"
    half = r"(?: ?<half>[ap]\.?m\.?)(?![a-z]))"
    return [
        rf"<year>\d{{4}})-<month>\d{{2}})-<day>\d{{2}})(?:t| ){clock}{zone}",
        rf"<year>\d{{4}})<month>\d{{2}})<day>\d{{2}})t<hour>\d{{2}})<minute>\d{{2}})(?:<sec>\d{{2}})(?:[.,]<frac>\d+))?)?{zone}",
        r"<epoch>\d{10}|\d{13}|\d{16}|\d{19})",
        rf"<first>\d{{1,2}})/<second_no>\d{{1,2}})/<year>\d{{4}}),? {clock}{half}?{zone}",
        rf"<day>\d{{1,2}})\.<month>\d{{1,2}})\.<year>\d{{4}}),? {clock}{half}?{zone}",
        rf"(?:[a-zéèû]{{2,10}}\.?,? )?<day>\d{{1,2}}) {name} <year>\d{{4}}),? {clock}{half}?{zone}",
        rf"(?:[a-z]{{3,9}},? )?{name} <day>\d{{1,2}})(?:st|nd|rd|th)?,? <year>\d{{4}})(?:,| at)? {clock}{half}?{zone}",
        rf"<day>\d{{1,2}})(?:er)? {name} <year>\d{{4}})(?:,| à) <hour>\d{{1,2}})h<minute>\d{{2}}){zone}",
        rf"<day>\d{{1,2}})\. {name} <year>\d{{4}}),? {clock} uhr{zone}",
        rf"<day>\d{{1,2}}) de {name} de <year>\d{{4}}),? {clock} h{zone}",
    ]


def compile_pattern() -> tuple[str, str]:
    """The pattern over all formats, and the replacement that lists the parts."""
    refs: dict[str, list[str]] = {p: [] for p in PARTS}
    alternatives = []
    for i, fmt in enumerate(_formats()):
        out, n = "", 0
        while "<" in fmt:
            k = fmt.index("<")
            if fmt[k - 2 : k] == "(?":  # a look-around, not a part
                raise ValueError(fmt)
            part = fmt[k + 1 : fmt.index(">", k)]
            group = f"f{i}x{n}{part.replace('_', '')}"
            refs[part].append("${" + group + "}")
            out, fmt, n = out + fmt[:k] + f"(?<{group}>", fmt[fmt.index(">", k) + 1 :], n + 1
        alternatives.append(out + fmt)
    pattern = r"(?iu)^[\s ]*(?:" + "|".join(alternatives) + r")[\s ]*$"
    return pattern, SEP + SEP.join("".join(refs[p]) for p in PARTS)


_KNOWN_ZONES = sorted(z for z in available_timezones() if "/" in z or z == "UTC")


def _offset_at(instant: Column, zone: Column) -> Column:
    """Microseconds that the zone's wall clock is ahead of UTC at an instant given in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def wall_to_instant(wall: Column, zone: Column) -> Column:
    """The instant at which the zone's clock shows `wall` (microseconds as if UTC); NULL if it never or twice did."""
    day = 86_400_000_000
    before, after = _offset_at(wall - day, zone), _offset_at(wall + day, zone)
    early, late = wall - before, wall - after
    ok = lambda u: _offset_at(u, zone) == wall - u
    return F.when(before == after, early).when(ok(early) & ~ok(late), early).when(ok(late) & ~ok(early), late)


# Stamps that name a day and no time.
DATE_ONLY = r"(?i)^[\s\u00a0]*(?:\d{4}-\d\d-\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{4}|[a-z]+\.? \d{1,2}, \d{4}|\d{1,2} [a-z]+\.? \d{4})[\s\u00a0]*$"


def parse_stamps(df: DataFrame, text: str, zone: str, order: str, out: str = "instant_us", date_only: bool = False) -> DataFrame:
    """`df` with `out`: microseconds since 1970-01-01 UTC, or NULL where the text fixes no instant.

    text: the column with the stamp. zone, order: columns with the IANA zone and the day/month order (DMY or MDY) that
    hold for stamps without them; NULL or unknown ones leave such stamps unresolved. NULL, empty, relative, date-only
    and impossible texts give NULL; with `date_only`, a day without a time is its midnight. Digits beyond microseconds are dropped. Other columns pass through unchanged,
    whatever their names; a column called like `out` is replaced.
    """
    pattern, replacement = compile_pattern()
    value = F.when(F.col(text).rlike(DATE_ONLY), F.concat(F.rtrim(text), F.lit(" 00:00"))).otherwise(F.col(text)) if date_only else F.col(text)
    parts = F.split(F.regexp_replace(value, F.lit(pattern), F.lit(replacement)), SEP, -1)
    kept = [c for c in df.columns if c != out]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(zone).alias("__zone_in"), F.col(order).alias("__order_in"), parts.alias("__p"))
    hit = F.size("__p") == len(PARTS) + 1
    part = {p: F.when(hit, F.nullif(F.get("__p", F.lit(i + 1)), F.lit(""))) for i, p in enumerate(PARTS)}
    num = lambda p: part[p].try_cast("int")
    numbers = F.create_map(*[F.lit(x) for kv in months().items() for x in kv])
    dmy = F.col("__order_in") == "DMY"
    known = F.col("__order_in").isin("DMY", "MDY")
    df = df.select(
        "*",
        part["epoch"].alias("__epoch"),
        num("year").alias("__y"),
        F.coalesce(num("month"), F.try_element_at(numbers, F.lower(part["name"])), F.when(known, F.when(dmy, num("second_no")).otherwise(num("first")))).alias("__m"),
        F.coalesce(num("day"), F.when(known, F.when(dmy, num("first")).otherwise(num("second_no")))).alias("__d"),
        num("hour").alias("__h"),
        num("minute").alias("__i"),
        F.coalesce(num("sec"), F.lit(0)).alias("__s"),
        F.coalesce(F.rpad(F.substring(part["frac"], 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("__f"),
        F.lower(F.substring(part["half"], 1, 1)).alias("__half"),
        part["sign"].alias("__sign"),
        num("oh").alias("__oh"),
        F.coalesce(num("om"), F.lit(0)).alias("__om"),
        F.lower(part["abbr"]).alias("__abbr"),
        part["region"].alias("__region"),
    )
    leap = "((__y % 4 = 0 AND __y % 100 <> 0) OR __y % 400 = 0)"
    month_days = f"CASE WHEN __m IN (4, 6, 9, 11) THEN 30 WHEN __m = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END"
    civil = "(__y - CASE WHEN __m <= 2 THEN 1 ELSE 0 END)"
    days = (
        f"(({civil} div 400) * 146097L + ({civil} % 400) * 365 + ({civil} % 400) div 4 - ({civil} % 400) div 100"
        " + (153 * (__m + CASE WHEN __m > 2 THEN -3 ELSE 9 END) + 2) div 5 + __d - 1 - 719468)"
    )
    hour = "(CASE WHEN __half IS NULL THEN __h ELSE __h % 12 + CASE WHEN __half = 'p' THEN 12 ELSE 0 END END)"
    valid = (
        f"__y BETWEEN 1600 AND 9000 AND __m BETWEEN 1 AND 12 AND __d BETWEEN 1 AND {month_days} AND __i <= 59 AND __s <= 59"
        " AND (CASE WHEN __half IS NULL THEN __h <= 23 ELSE __h BETWEEN 1 AND 12 END)"
    )
    wall = f"CASE WHEN {valid} THEN (({days} * 24 + {hour}) * 3600L + __i * 60L + __s) * 1000000L + __f END"
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    clocks = F.create_map(*[F.lit(x) for kv in WALL_CLOCKS.items() for x in kv])
    signed = F.when(F.col("__sign") == "-", -1).otherwise(1) * (F.col("__oh") * 60 + F.col("__om"))
    zones = F.coalesce(F.col("__region"), F.try_element_at(clocks, F.col("__abbr")), F.when(F.col("__abbr").isNull(), F.col("__zone_in")))
    df = df.select(
        "*",
        F.expr(wall).alias("__wall"),
        F.coalesce(F.when((F.col("__oh") <= 15) & (F.col("__om") <= 59), signed), F.try_element_at(abbreviations, F.col("__abbr"))).alias("__off"),
        F.when(zones.isin(*_KNOWN_ZONES), zones).alias("__zone"),
    )
    digits = F.length("__epoch")
    scaled = F.col("__epoch").try_cast("long")
    epoch = F.when(digits == 10, scaled * 1_000_000).when(digits == 13, scaled * 1000).when(digits == 16, scaled).when(digits == 19, F.expr("try_cast(__epoch as bigint) div 1000"))
    by_zone = wall_to_instant(F.col("__wall"), F.col("__zone"))
    instant = F.coalesce(
        epoch,
        F.when(F.col("__sign").isNotNull() | F.col("__off").isNotNull(), F.col("__wall") - F.col("__off").cast("long") * 60_000_000).when(F.col("__zone").isNotNull() & F.col("__wall").isNotNull(), by_zone),
    )
    return df.select("__row.*", sealed(instant).alias(out))


def with_site_clock(df: DataFrame, url: str, sites: DataFrame, zone: str = "site_zone", order: str = "site_order") -> DataFrame:
    """`df` with the clock and date order of the site that `url` belongs to; NULL where the site is unknown.

    `sites` may list a domain more than once; the smallest zone and order then hold. Spark broadcasts it only below
    its size threshold.
    """
    df = df.drop(zone, order)
    clocks = sites.where(F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("__clock_domain")).agg(F.min("time_zone").alias(zone), F.min("date_order").alias(order))
    return df.join(clocks, site(F.col(url)) == F.col("__clock_domain"), "left").drop("__clock_domain")
