"""Problem 5: timestamps as instants."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.stamps import ABBREVIATIONS, WALL_CLOCKS, months, parse_stamps, with_site_clock
from newsloom.session import table


def _long(df: DataFrame, name: str, key: str, url: str, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("stamp")) for f in fields])
    return df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.col(url).alias("url"), F.explode(pairs).alias("x")).select(
        "table_name", "row_id", "url", "x.field_name", "x.stamp"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp of article_data and listing_cards that fixes one instant."""
    rows = _long(table(spark, sf_dir, "article_data"), "article_data", "record_id", "source_url", ["published_at", "updated_at"]).unionByName(
        _long(table(spark, sf_dir, "listing_cards"), "listing_cards", "card_id", "url", ["preview_timestamp"])
    )
    rows = with_site_clock(rows.where(F.col("stamp").isNotNull()), "url", table(spark, sf_dir, "sites"))
    found = parse_stamps(rows, "stamp", "site_zone", "site_order").select("table_name", "row_id", "field_name", "instant_us")
    return found.where(F.col("instant_us").isNotNull())




_SITE = r"regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)', 1)"
_FIXED = ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items())
_CLOCKS = ", ".join(f"'{k}': '{v}'" for k, v in WALL_CLOCKS.items())
_MONTHS = ", ".join(f"'{k}': {v}" for k, v in months().items())
_ABBR = "|".join([*ABBREVIATIONS, *WALL_CLOCKS])
_AT = "epoch_us(timezone({z}, make_timestamptz({u}))) - ({u})"


def stamp_sql(rows: str, date_only: bool = False) -> str:
    """SQL over rows(..., url, stamp, zone, dmy) with `instant_us` for stamps that fix one, step by step: trailing zone,
    half of the day, words of the language, then day and clock."""
    clock = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?$"
    midnight = r"CASE WHEN regexp_matches(t0, '^(?:\d{4}-\d\d-\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{4}|[a-z]+\.? \d{1,2}, \d{4}|\d{1,2} [a-z]+\.? \d{4})$') THEN t0 || ' 00:00' ELSE t0 END" if date_only else "t0"
    return rf"""r0 AS (SELECT *, regexp_replace(stamp, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS o0 FROM ({rows}) WHERE stamp IS NOT NULL),
    r1 AS (SELECT *, lower(o0) AS t0, nullif(regexp_extract(o0, '\[([A-Za-z0-9_+/-]+)\]$', 1), '') AS region FROM r0),
    r2 AS (SELECT *, trim(regexp_replace({midnight}, ' ?\[[^\]]*\]$', '')) AS u FROM r1),
    r3 AS (SELECT *, CASE WHEN regexp_matches(u, '\d:\d\d|t\d{{4}}') THEN nullif(regexp_extract(u, '(?:[0-9]|[ap]\.?m\.?) ?(?:utc|gmt)?([+-][0-9]{{1,2}}(?::?[0-9]{{2}})?)$', 1), '') END AS off FROM r2),
    r4 AS (SELECT *, CASE WHEN off IS NULL THEN u ELSE regexp_replace(u, ' ?(?:utc|gmt)?[+-][0-9]{{1,2}}(?::?[0-9]{{2}})?$', '') END AS v FROM r3),
    r5 AS (SELECT *, CASE WHEN off IS NULL THEN nullif(regexp_extract(v, '(?:[0-9]|[ap]m|[ap]\.m\.) ?({_ABBR})$', 1), '') END AS abbr FROM r4),
    r6 AS (SELECT *, CASE WHEN abbr IS NULL THEN v ELSE regexp_replace(v, ' ?(?:{_ABBR})$', '') END AS w FROM r5),
    r7 AS (SELECT *, nullif(regexp_extract(w, '[0-9] ?([ap])\.?m\.?$', 1), '') AS half, regexp_replace(regexp_replace(w, ' ?[ap]\.?m\.?$', ''), '([0-9])(?: uhr| h)$', '\1') AS x0 FROM r6),
    r8 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x0, ' de ', ' ', 'g'), '^(\d{{1,2}})(?:\.|er) ', '\1 '), '(?:,| à)? (\d{{1,2}})h(\d\d)$', ' \1:\2') AS x FROM r7),
    r9 AS (SELECT *, CASE
        WHEN regexp_matches(x, '^\d{{4}}-\d\d-\d\d[t ]{clock}') THEN regexp_extract(x, '^(\d{{4}})-(\d\d)-(\d\d)[t ]{clock}', ['y', 'm', 'd', 'h', 'i', 's', 'f'])
        WHEN regexp_matches(x, '^\d{{8}}t\d{{4}}(?:\d\d(?:[.,]\d+)?)?$') THEN regexp_extract(x, '^(\d{{4}})(\d\d)(\d\d)t(\d\d)(\d\d)(?:(\d\d)(?:[.,](\d+))?)?$', ['y', 'm', 'd', 'h', 'i', 's', 'f'])
        WHEN regexp_matches(x, '^\d{{1,2}}/\d{{1,2}}/\d{{4}},? {clock}') THEN CASE WHEN dmy THEN regexp_extract(x, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {clock}', ['d', 'm', 'y', 'h', 'i', 's', 'f'])
            WHEN NOT dmy THEN regexp_extract(x, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {clock}', ['m', 'd', 'y', 'h', 'i', 's', 'f']) END
        WHEN regexp_matches(x, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}},? {clock}') THEN regexp_extract(x, '^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {clock}', ['d', 'm', 'y', 'h', 'i', 's', 'f'])
        WHEN regexp_matches(x, '^(?:\pL+\.?,? )?\d{{1,2}} \pL+\.? \d{{4}},? {clock}') THEN regexp_extract(x, '^(?:\pL+\.?,? )?(\d{{1,2}}) (\pL+)\.? (\d{{4}}),? {clock}', ['d', 'm', 'y', 'h', 'i', 's', 'f'])
        ELSE regexp_extract(x, '^(?:\pL+,? )?(\pL+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,| at)? {clock}', ['m', 'd', 'y', 'h', 'i', 's', 'f']) END AS p FROM r8),
    r10 AS (SELECT *, coalesce(try_cast(p.m AS INT), map {{{_MONTHS}}}[p.m]) AS mm, try_cast(p.h AS INT) AS hh FROM r9),
    r11 AS (SELECT *, epoch_us(try_cast(printf('%s-%02d-%02d %02d:%s:%s', p.y, mm, try_cast(p.d AS INT), CASE WHEN half IS NULL THEN hh WHEN hh BETWEEN 1 AND 12 THEN hh % 12 + CASE half WHEN 'p' THEN 12 ELSE 0 END ELSE 99 END, p.i, CASE WHEN p.s = '' THEN '00' ELSE p.s END) AS TIMESTAMP))
        + coalesce(try_cast(rpad(substr(p.f, 1, 6), 6, '0') AS INT), 0) AS wall FROM r10 WHERE true),
    r12 AS (SELECT *, coalesce(CASE WHEN off IS NOT NULL THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (try_cast(regexp_extract(off, '^[+-](\d{{1,2}})', 1) AS INT) * 60 + coalesce(try_cast(nullif(regexp_extract(off, '(\d\d)$', 1), '') AS INT) * (length(replace(off, ':', '')) > 3)::INT, 0)) END,
        map {{{_FIXED}}}[abbr]) AS minutes, coalesce(region, map {{{_CLOCKS}}}[abbr], CASE WHEN abbr IS NULL THEN zone END) AS tz FROM r11),
    r13 AS (SELECT *, try({_AT.format(z='tz', u='wall - 86400000000')}) AS o1, try({_AT.format(z='tz', u='wall + 86400000000')}) AS o2 FROM r12),
    r14 AS (SELECT *, try({_AT.format(z='tz', u='wall - o1')}) = o1 AS ok1, try({_AT.format(z='tz', u='wall - o2')}) = o2 AS ok2 FROM r13),
    instants AS (SELECT *, CASE WHEN regexp_matches(u, '^(?:\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}})$') THEN CASE length(u) WHEN 10 THEN u::BIGINT * 1000000 WHEN 13 THEN u::BIGINT * 1000 WHEN 16 THEN u::BIGINT ELSE u::BIGINT // 1000 END
        WHEN minutes IS NOT NULL THEN wall - minutes::BIGINT * 60000000 WHEN o1 = o2 THEN wall - o1 WHEN ok1 AND NOT ok2 THEN wall - o1 WHEN ok2 AND NOT ok1 THEN wall - o2 END AS instant_us FROM r14)"""


_ROWS = f"""SELECT l.*, z.time_zone AS zone, z.date_order = 'DMY' AS dmy FROM (SELECT 'article_data' AS table_name, record_id AS row_id, source_url AS url, 'published_at' AS field_name, published_at AS stamp FROM article_data
    UNION ALL SELECT 'article_data', record_id, source_url, 'updated_at', updated_at FROM article_data UNION ALL SELECT 'listing_cards', card_id, url, 'preview_timestamp', preview_timestamp FROM listing_cards) l
    LEFT JOIN sites z ON z.domain = {_SITE}"""
QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {"p5_found": f"WITH {stamp_sql(_ROWS)} SELECT table_name, row_id, field_name, instant_us FROM instants WHERE instant_us IS NOT NULL"}
