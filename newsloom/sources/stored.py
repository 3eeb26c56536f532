"""Stored pages, feeds and settings as inputs."""

from __future__ import annotations

import json
import os
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import gunzip_text
from newsloom.operators.incremental import CrawlSettings
from newsloom.operators.tiers import DEFAULT, Rule, SiteConfig

PAGE_SCHEMA = "url string, status int, html string, raw_markdown string, cleaned_html string, via string, fetched_at timestamp"


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages in the common schema; missing columns are NULL, others dropped."""
    df = spark.read.schema(PAGE_SCHEMA).json(path) if fmt == "json" else spark.read.format(fmt).load(path)
    wanted = [c.split() for c in PAGE_SCHEMA.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted])


def archived_pages(articles: DataFrame) -> DataFrame:
    """(url, html) of accepted articles that keep their page, unpacked, to be extracted again."""
    return articles.where(F.col("raw_html_compressed").isNotNull()).select(F.col("source_url").alias("url"), gunzip_text("raw_html_compressed").alias("html"))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries stored as JSON lines, as the rss tier takes them."""
    return spark.read.schema("url string, title string, summary string, published_at string, authors array<struct<name:string,url:string>>, tags array<string>").json(path)


def site_config(path: str) -> SiteConfig:
    """A site's selectors from a JSON file: the sections article, schema, cards and cards_fallback, each field -> {css,
    attribute, multiple, transform}. Sections the file lacks keep their defaults; unknown sections and keys are refused."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return replace(DEFAULT, **{section: {name: Rule(**rule) for name, rule in rules.items()} for section, rules in given.items()})


def settings_from_env(prefix: str = "NEWSLOOM_", env: dict[str, str] | None = None) -> CrawlSettings:
    """Crawl settings from environment variables, whatever their case; others keep their defaults."""
    given = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    out = {}
    for f in fields(CrawlSettings):
        v = given.get((prefix + f.name).lower())
        if v is not None:
            out[f.name] = v.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(v.strip())
    return CrawlSettings(**out)
