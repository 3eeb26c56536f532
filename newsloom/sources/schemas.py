"""Tables of the engine: columns, and how they are laid out where a look-up would want an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUS_WORDS = ("success", "partial_extraction", "failed")
STAGES = ("listing", "article")

ARTICLES = (
    "id bigint, source_url string, title string, summary string, full_content string, full_content_markdown string, authors array<struct<name:string,url:string>>, "
    "published_at timestamp, updated_at timestamp, first_seen_at timestamp, scraped_at timestamp, category string, tags array<string>, related_tickers array<string>, "
    "source_publisher string, top_image_url string, language string, extraction_tier_used map<string,string>, status string, raw_html_compressed binary, search_vector array<string>"
)
RUNS = (
    "id bigint, run_uuid string, stage string, started_at timestamp, ended_at timestamp, pages_fetched int, new_articles int, duplicate_articles int, failed_articles int, "
    "rate_limit_hits int, cooldown_events int, errors array<map<string,string>>, extra_metrics map<string,bigint>"
)
# columns that no row may leave empty
REQUIRED = {"articles": ("source_url", "first_seen_at", "scraped_at", "status"), "scrape_runs": ("run_uuid", "stage", "started_at")}
SCHEMAS = {"articles": ARTICLES, "scrape_runs": RUNS}


def conform(df: DataFrame, table: str) -> DataFrame:
    """`df` with the columns of a table in their order and types; missing ones are NULL, others dropped."""
    fields = T._parse_datatype_string(SCHEMAS[table]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that leave a required column empty or repeat no known status, with `broken`: the names of these columns."""
    empty = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[table]]
    word = [F.when(~F.col("status").isin(*STATUS_WORDS), F.lit("status"))] if table == "articles" else [F.when(~F.col("stage").isin(*STAGES), F.lit("stage"))]
    return df.withColumn("broken", F.array_compact(F.array(*empty, *word))).where(F.size("broken") > 0)
