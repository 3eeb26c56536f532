"""URL columns: host, site, canonical address, page key, pagination.

All functions take and return Columns and stay inside the JVM, except `rewrite_query`, which rows with percent
escapes or repeated keys need.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track the visit.
TRACKING_PARAMS = ("guccounter", "guce_referrer", "fr", "utm_source", "utm_medium", "utm_campaign", "ncid")
# Host labels that lead to another rendering of the same page.
MIRROR_LABELS = ("www", "m", "amp", "mobile")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def netloc(url) -> Column:
    """Authority part as written (keeps user info and port); empty when there is none."""
    return F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(url) -> Column:
    """Lower-case host without user info and port; NULL when the text has no authority."""
    h = F.regexp_extract(F.lower(_col(url)), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(h, F.lit(""))


def site(url) -> Column:
    """Last two labels of the host; the host itself when it has one label."""
    h = host(url)
    two = F.regexp_extract(h, r"([^.]+\.[^.]+)\.?$", 1)
    return F.when(two != "", two).otherwise(h)


def page_key(url) -> Column:
    """A text that is equal for addresses leading to the same page.

    Scheme, port, host case, mirror labels (www, m, amp), tracking parameters, fragment, a closing slash or /amp are
    dropped and the remaining parameters sorted. NULL for a NULL, blank or host-less address: such never match.
    """
    u = F.regexp_replace(F.trim(_col(url)), r"#.*$", "")
    h = F.regexp_replace(host(u), rf"^(?:{'|'.join(MIRROR_LABELS)})\.(?=[^.]+\.)", "")
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?]*)", 1)
    path = F.regexp_replace(path, r"(?:/amp)?/*$", "")
    params = F.filter(
        F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(rf"^(?:{'|'.join(TRACKING_PARAMS)}|utm_\w+)$"),
    )
    q = F.array_join(F.array_sort(params), "&")
    return F.when(h.isNotNull(), F.concat(h, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


@F.pandas_udf(T.StringType())
def _reencode(query: pd.Series, drop: pd.Series) -> pd.Series:
    from urllib.parse import parse_qs, urlencode

    def one(q, d):
        if q is None:
            return None
        kept = {k: v for k, v in parse_qs(q, keep_blank_values=True).items() if k not in set(d.split(","))}
        return urlencode(kept, doseq=True)

    return pd.Series([one(q, d) for q, d in zip(query, drop)])


def _plain(query: Column) -> Column:
    """Queries that re-encoding leaves as they are: plain key=value pairs. Repeated keys keep their order only when
    they stand together, so any repeated key goes to the exact path."""
    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"^([^=]*)", 1))
    return query.rlike(r"^(?:[\w.~-]+=[\w.~-]*)(?:&[\w.~-]+=[\w.~-]*)*$") & (F.size(F.array_distinct(keys)) == F.size(keys))


def rewrite_query(query: Column, drop: tuple[str, ...]) -> Column:
    """The query without the named parameters, re-encoded as a form."""
    drop_list = ",".join(drop)
    plain = query
    if drop:
        plain = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*drop)), "&")
    # only rows outside the plain path cross into Python
    slow = _reencode(F.when(~_plain(query) & (query != ""), query), F.lit(drop_list))
    return F.when(query == "", F.lit("")).when(_plain(query), plain).otherwise(slow)


def canonical_url(url, base, target_domain: str, default_host: str) -> Column:
    """Absolute address; on the target site also without tracking parameters and fragment.

    Empty -> NULL. `//x` gets https:, `/x` the scheme and host of `base` (or `default_host`), other relative texts and
    other sites stay as they are. The domain matches itself and its subdomains.
    """
    u = F.trim(_col(url))
    root = F.regexp_extract(_col(base), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    root = F.when(F.coalesce(root, F.lit("")) != "", root).otherwise(F.lit(default_host))
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(u)
    h = F.regexp_extract(F.lower(full), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    ours = (h == target_domain) | h.endswith("." + target_domain)
    bare = F.regexp_replace(full, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    q = rewrite_query(query, TRACKING_PARAMS)
    rebuilt = F.concat(head, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit(None)).when(ours, rebuilt).otherwise(full)


def with_pagination(url, start: Column, count: Column) -> Column:
    """Set or overwrite `start` and `count`, keeping the other parameters."""
    u = _col(url)
    frag = F.regexp_extract(u, r"(#.*)$", 1)
    bare = F.regexp_replace(u, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = rewrite_query(F.regexp_extract(bare, r"\?(.*)$", 1), ())
    has = lambda k: query.rlike(rf"(?:^|&){k}=")
    put = lambda q, k, v: F.when(
        has(k), F.regexp_replace(q, F.lit(rf"(^|&){k}=[^&]*"), F.concat(F.lit(rf"$1{k}="), v.cast("string")))
    ).otherwise(F.concat(q, F.when(q != "", "&").otherwise(""), F.lit(f"{k}="), v.cast("string")))
    return F.concat(head, F.lit("?"), put(put(query, "start", start), "count", count), frag)


def is_article_url(url, pattern: str) -> Column:
    """Whether the address, from its start, has the article form."""
    return F.coalesce(_col(url).rlike("^(?:" + pattern + ")"), F.lit(False))
