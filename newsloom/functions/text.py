"""Text columns: title keys, cleaning, tickers, markers of blocked pages, gzip."""

from __future__ import annotations

import gzip
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that titles are compared without.
TITLE_NOISE = r"[\s​‌‍﻿\-_–—·•|,.:;!?\"'‘’“”()\[\]{}<>]+"
# Signs of a page that asks whether its reader is human.
CAPTCHA_SIGNS = (r"are you a (?:robot|human)", r"pardon our interruption", r"access denied", r"please verify", r"captcha", r"<title>\s*just a moment")
CAPTCHA_CHARS = 20_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def nfkc(text) -> Column:
    """Compatibility form; only texts beyond ASCII cross into Python."""
    t = _col(text)
    odd = t.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfkc(F.when(odd, t))).otherwise(t)


def title_key(title) -> Column:
    """Compatibility form in lower case without blanks, zero-width characters and punctuation; NULL and empty give ''."""
    return F.coalesce(F.regexp_replace(F.lower(nfkc(title)), "(?U)" + TITLE_NOISE, ""), F.lit(""))


def safe_text(value) -> Column:
    """Text without blanks around it; empty becomes NULL."""
    return F.nullif(F.regexp_replace(_col(value).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def is_filled(value: Column, kind: str) -> Column:
    """Whether a value is neither NULL nor empty. Blank texts are filled; trimming is the tiers' task."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(F.length(value.cast("string")) > 0, F.lit(False))


def ticker(text) -> Column:
    """The symbol at the start (brackets allowed) or else the first run of one to five capitals; NULL if there is none."""
    t = F.trim(_col(text))
    head = F.regexp_extract(t, r"^\(?([A-Z]{1,5})(?:\.|\b)", 1)
    anywhere = F.regexp_extract(t, r"\b[A-Z]{1,5}\b", 0)
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(anywhere, F.lit("")))


def keyword_list(text) -> Column:
    """Comma-separated words, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def upper_tickers(values) -> Column:
    return F.transform(F.filter(_col(values), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.upper(F.trim(x)))


def join_paragraphs(values) -> Column:
    return F.array_join(F.filter(_col(values), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def has_captcha(html) -> Column:
    """Whether the first 20,000 characters of a page hold a sign of a bot check. Never NULL."""
    return F.coalesce(F.substring(_col(html), 1, CAPTCHA_CHARS).rlike("(?i)(?:" + "|".join(CAPTCHA_SIGNS) + ")"), F.lit(False))


def is_block(status) -> Column:
    return F.coalesce(_col(status).isin(403, 429), F.lit(False))


def backoff_seconds(attempt, base: float, cap: float) -> Column:
    """Seconds slept after the attempt with that number (from 1)."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), _col(attempt) - 1))


def jitter_seconds(low: float, high: float, seed: int | None = None) -> Column:
    """A random wait between two bounds; the upper one counts as the lower one if it is below it."""
    return F.lit(float(low)) + F.rand(seed) * (max(high, low) - low)


@F.pandas_udf(T.BinaryType())
def gzip_text(s: pd.Series) -> pd.Series:
    """UTF-8 text as gzip; NULL stays NULL."""
    return s.map(lambda x: gzip.compress(x.encode("utf-8"), mtime=0) if x is not None else None)


@F.pandas_udf(T.StringType())
def gunzip_text(s: pd.Series) -> pd.Series:
    """The text of a gzip blob; NULL stays NULL and damaged blobs become NULL."""

    def one(x):
        try:
            return gzip.decompress(x).decode("utf-8", "replace") if x is not None else None
        except (OSError, EOFError):
            return None

    return s.map(one)
