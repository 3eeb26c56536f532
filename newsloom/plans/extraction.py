"""Extraction tiers over stored pages, and over pages composed from known fields."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import gunzip_text, gzip_text, join_paragraphs, keyword_list, safe_text, upper_tickers
from newsloom.operators.tiers import DEFAULT, Rule, complete_missing, derive_status, extract_cards, extract_tiers, listing_items, merge_candidates, probe_pages, prompt_html, rss_records, structure_alert
from newsloom.plans.addresses import ARTICLE_PATTERN, HOME, ORACLES as ADDRESSES, TARGET
from newsloom.session import table


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "article_data").where(F.col("raw_html").isNotNull()).select("record_id", F.col("source_url").alias("url"), F.col("raw_html").alias("html"))


def _one(df: DataFrame, tier: str) -> DataFrame:
    """Records of one tier beside the other columns."""
    return extract_tiers(df, (tier,)).select("record_id", F.explode("candidates").alias("c"))


def _escaped(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _each(values, before: str, after: str):
    """Values of an array between two pieces of markup, joined."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.concat(F.lit(before), _escaped(v), F.lit(after))), ""), F.lit(""))


def _composed(spark, sf_dir):
    """Records that pages are composed from, with the fields that those pages hold."""
    r = table(spark, sf_dir, "article_data").where(F.col("title").isNotNull() & F.col("source_publisher").isNotNull() & F.col("source_url").rlike("^https?://[^/?#]+"))
    lines = F.filter(F.split("full_content", "\n"), lambda x: F.trim(x) != "")
    names = F.transform(F.filter("authors", lambda a: a["name"].isNotNull()), lambda a: a["name"])
    return r.select(
        "record_id", "batch_no", F.col("source_url").alias("url"), "title", "summary", "category", "source_publisher", "authors", "tags", "language", "related_tickers", "published_at", "updated_at",
        F.concat(F.lit("/img/"), F.col("record_id"), F.lit(".jpg")).alias("image"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), lines.alias("lines"), names.alias("names"), "full_content",
    )


def opengraph_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta tags of both kinds: the first in the page that says something wins."""
    r = _composed(spark, sf_dir)
    html = F.concat(
        F.lit('<head><meta name="twitter:title" content=" "><meta property="og:title" content="'), _escaped("title"), F.lit('"><meta name="twitter:description" content="'), _escaped("summary"),
        F.lit('"><meta property="og:description" content="late"><meta name="twitter:title" content="late"><meta content="'), F.col("image"), F.lit('" property="OG:image"><meta property="og:site_name" content="'),
        _escaped("source_publisher"), F.lit('"></head>'),
    )
    return _one(r.select("record_id", "url", html.alias("html")), "opengraph").select("record_id", "c.title", "c.summary", "c.top_image_url", "c.source_publisher")


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the page as a whole, its image made absolute."""
    r = _composed(spark, sf_dir)
    html = F.concat(
        F.lit('<html lang="'), _escaped("language"), F.lit('"><head><title>late</title><meta name="description" content="'), _escaped("summary"), F.lit('"><meta property="og:image" content="'), F.col("image"),
        F.lit('"><meta property="article:published_time" content="'), F.coalesce("stamp", F.lit("")), F.lit('"></head><body><h1>'), _escaped("title"), F.lit("</h1></body></html>"),
    )
    return _one(r.select("record_id", "url", html.alias("html")), "newspaper").select("record_id", "c.title", "c.language", "c.summary", "c.top_image_url", "c.published_at")


def stored_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that the stored pages themselves show: the heading's, and the one for cards."""
    got = extract_tiers(_pages(spark, sf_dir), ("opengraph", "newspaper")).select("record_id", F.map_from_entries(F.transform("candidates", lambda c: F.struct(c["tier"], c["title"]))).alias("t"))
    return got.select("record_id", F.try_element_at("t", F.lit("opengraph")).alias("card_title"), F.try_element_at("t", F.lit("newspaper")).alias("title"))


def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages with a menu and a rail around it."""
    r = _composed(spark, sf_dir).where(F.length("full_content") > 200)
    html = F.concat(F.lit('<body><nav><a href="/">Home</a><a href="/m">Markets</a></nav><div class="c">'), _each(F.col("lines"), "<p>", "</p>"), F.lit('</div><aside><p><a href="/x">Read next: more of this</a></p></aside></body>'))
    return _one(r.select("record_id", "url", html.alias("html")), "trafilatura").select("record_id", F.md5("c.full_content").alias("digest"), (F.col("c.full_content_markdown") == F.replace("c.full_content", F.lit("\n"), F.lit("\n\n"))).alias("same"))


def jsonld_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article node stands in a graph, behind a decoy and a broken block."""
    node = F.struct(
        F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"), F.col("title").alias("headline"), F.col("summary").alias("description"), F.col("category").alias("articleSection"),
        F.array_join("tags", ", ").alias("keywords"), F.struct(F.col("source_publisher").alias("name")).alias("publisher"), F.array(F.struct(F.col("image").alias("url"))).alias("image"),
        F.col("stamp").alias("datePublished"), F.concat(F.lit("on "), F.col("stamp")).alias("dateModified"), F.col("language").alias("inLanguage"), F.col("authors").alias("creator"),
        F.transform("related_tickers", lambda t: F.struct(F.lower(t).alias("name"))).alias("about"),
    )
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebSite").alias("@type"), F.lit("decoy").alias("headline"))).alias("first"), F.array(node).alias("@graph")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">{broken</script><script type="application/ld+json">'), F.regexp_replace(graph, "<", "\\\\u003c"), F.lit("</script></head></html>"))
    got = _one(_composed(spark, sf_dir).select("record_id", "url", html.alias("html")), "jsonld")
    return got.select(
        "record_id", "c.title", "c.summary", "c.category", "c.source_publisher", F.array_join("c.tags", "|").alias("tags"), "c.top_image_url", "c.published_at", "c.updated_at", "c.language",
        F.array_join(F.transform("c.authors", lambda a: F.concat_ws(" ", a["name"], a["url"])), "|").alias("authors"), F.array_join("c.related_tickers", "|").alias("tickers"),
    )


def css_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages composed of a heading, bylines, description, times, image, topic and quote links, provider and an unclosed
    paragraph, beside elements that the selectors must not take."""
    r = _composed(spark, sf_dir)
    html = F.concat(
        F.lit('<html><head><meta content="'), _escaped("summary"), F.lit('" name="description"><meta property="og:image" content="'), F.col("image"), F.lit('"></head><body><h2 class="title">no</h2><article><h1>'),
        _escaped("title"), F.lit("</h1>"), _each(F.col("names"), '<span class="x byline-y">', "</span>"), F.lit('<time datetime="'), _escaped("published_at"), F.lit('">no</time><time class="modified" datetime="'),
        _escaped("updated_at"), F.lit('"></time><a href="/topic/x">'), _escaped("category"), F.lit('</a><div><a class="provider-link">no</a></div><div class="provider-box"><a>'), _escaped("source_publisher"),
        F.lit("</a></div><p>First <b>part<p>Second</article>"), _each(F.col("related_tickers"), '<a href="/quote/q">', "</a>"), F.lit("</body></html>"),
    )
    got = _one(r.select("record_id", "url", html.alias("html")), "css_fallback")
    return got.select(
        "record_id", "c.title", "c.summary", "c.category", "c.source_publisher", F.array_join(F.transform("c.authors", lambda a: a["name"]), "|").alias("authors"), "c.published_at", "c.updated_at",
        "c.top_image_url", "c.full_content", F.array_join("c.related_tickers", "|").alias("tickers"),
    )


def schema_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema tier over pages with all paragraphs of the record."""
    r = _composed(spark, sf_dir)
    html = F.concat(
        F.lit('<html><head><meta name="description" content="'), _escaped("summary"), F.lit('"></head><body><p>no</p><h1 data-test-l10n-id="title">'), _escaped("title"), F.lit('</h1><time>no</time><time datetime="'), F.coalesce("stamp", F.lit("")),
        F.lit('"></time><span class="the-provider">'), _escaped("source_publisher"), F.lit('</span><div class="my-body"><section>'), _each(F.col("lines"), "<p>", ""), F.lit("</section></div></body></html>"),
    )
    got = _one(r.select("record_id", "url", html.alias("html")), "crawl4ai_schema")
    return got.select("record_id", "c.title", "c.summary", "c.published_at", "c.source_publisher", F.md5("c.full_content").alias("digest"))


def _listing(spark, sf_dir):
    """Listing pages composed of each run's cards."""
    cards = table(spark, sf_dir, "listing_cards")
    li = F.concat(
        F.lit('<li class="js-stream-content x"><a href="'), _escaped("url"), F.lit('"><h3>'), _escaped("preview_title"), F.lit('</h3></a><time datetime="'), _escaped("preview_timestamp"),
        F.lit('"></time><span class="provider">'), _escaped("source_publisher"), F.lit("</span></li>"),
    )
    # a page has a fixed number of places
    pages = cards.groupBy("run_uuid", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", li.alias("li")))), lambda x: x["li"]), "").alias("body"))
    return pages.select("run_uuid", "page_num", F.concat(F.lit("<html><body><ul>"), F.col("body"), F.lit("</ul></body></html>")).alias("html"))


def listing_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages composed of each run's cards, read back card by card."""
    return extract_cards(_listing(spark, sf_dir)).select("run_uuid", "page_num", "url", "preview_title", "preview_timestamp", "source_publisher")


def listing_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which the schema finds no card: the fallback's rules, with headlines in boxes and stamps as text."""
    cards = table(spark, sf_dir, "listing_cards").where(F.col("url").contains("/news/"))
    html = F.concat(
        F.lit('<ul><li class="other"><a href="'), _escaped("url"), F.lit('"><div><img src="/i.jpg"></div><div>'), _escaped("preview_title"), F.lit("</div></a><footer><span>"), _escaped("preview_timestamp"),
        F.lit('</span></footer><span class="a source">'), _escaped("source_publisher"), F.lit("</span></li><li class='other'><h3>no link</h3></li></ul>"),
    )
    config = replace(DEFAULT, cards_fallback={**DEFAULT.cards_fallback, "card": Rule("li.other")})
    return extract_cards(cards.select("card_id", html.alias("html")), config).select("card_id", "url", "preview_title", "preview_thumbnail_url", "preview_timestamp", "source_publisher")


def listing_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as a crawl takes them: canonical, articles only."""
    items = listing_items(extract_cards(_listing(spark, sf_dir)), F.lit(HOME), TARGET, HOME, ARTICLE_PATTERN)
    return items.groupBy("run_uuid", "url").agg(F.count("*").alias("n_cards"), F.min("preview_title").alias("first_title"))


def _merged(spark, sf_dir):
    """Pages on which different tiers fill the fields: structured data where the record has a category, a card title,
    a heading, a description for cards only, and the text in a place that no selector names."""
    r = _composed(spark, sf_dir)
    ld = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("language").alias("inLanguage")))
    html = F.concat(
        F.lit('<html lang="xx"><head><meta property="og:title" content="card"><meta property="og:description" content="'), _escaped("summary"), F.lit('">'),
        F.when(F.col("category").isNotNull(), F.concat(F.lit('<script type="application/ld+json">'), F.regexp_replace(ld, "<", "\\\\u003c"), F.lit("</script>"))).otherwise(""),
        F.lit("</head><body><h1>"), _escaped("title"), F.lit("</h1><main>"), _each(F.col("lines"), "<p>", "</p>"), F.lit("</main></body></html>"),
    )
    pages = r.select("record_id", "url", html.alias("html"), F.concat(F.lit("batch "), F.col("batch_no")).alias("via"))
    return merge_candidates(extract_tiers(pages), via="via")


def tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers merged field by field, with the tiers that filled them, the backend and the status."""
    m = _merged(spark, sf_dir)
    tier = lambda f, name: F.try_element_at("extraction_tier_used", F.lit(f)).alias(name)
    return m.select("record_id", "title", "summary", "language", "status", tier("title", "title_tier"), tier("summary", "summary_tier"), tier("language", "language_tier"), tier("full_content", "content_tier"), tier("_crawl_via", "via"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("status", F.try_element_at("extraction_tier_used", F.lit("title")).alias("title_tier")).agg(F.count("*").alias("n"))


def rss_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries before the tiers of the stored page: what the feed lacks comes from the page."""
    entries = table(spark, sf_dir, "article_data").where(F.col("raw_html").isNotNull()).select(F.col("record_id").cast("string").alias("url"), "title", "summary", "published_at", "authors", "tags")
    pages = extract_tiers(_pages(spark, sf_dir), ("newspaper",)).join(rss_records(entries).withColumnRenamed("url", "entry"), F.col("record_id") == F.col("entry").cast("long"))
    m = merge_candidates(pages.withColumn("candidates", F.concat("candidates", F.array("candidate"))))
    tier = lambda f, name: F.try_element_at("extraction_tier_used", F.lit(f)).alias(name)
    return m.select("record_id", "title", tier("title", "title_tier"), "language", tier("language", "language_tier"), "published_at", tier("published_at", "published_tier"), F.greatest(F.size("authors"), F.lit(0)).alias("n_authors"))


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook for an expensive tier: here records without a title take the first line of their text, and say so."""

    def from_text(batches):
        for pdf in batches:
            title = [t if t else (x or "").split("\n")[0] for t, x in zip(pdf["title"], pdf["full_content"])]
            yield pdf.assign(title=title, status=["filled"] * len(pdf))

    r = table(spark, sf_dir, "article_data").select("record_id", "title", "full_content", derive_status(F.col("title"), F.col("full_content")).alias("status"))
    return complete_missing(r, from_text).select("record_id", "title", "status", F.length(prompt_html("full_content")).alias("n_chars"))


def structure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which the selectors find nothing: stored ones, and records' bare texts in a form they don't know."""
    r = table(spark, sf_dir, "article_data").where(F.col("raw_html").isNotNull() | F.col("full_content").isNotNull())
    html = F.coalesce("raw_html", F.concat(F.lit("<html><body><div>"), _escaped("full_content"), F.lit("</div></body></html>")))
    found = extract_tiers(r.select("record_id", F.col("source_url").alias("url"), html.alias("html")), ("css_fallback",))
    return found.where(structure_alert(F.col("candidates"))).select("record_id")


def selector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_pages(_pages(spark, sf_dir), {"h1": "h1", "p": "p", "li": "li", "og": "meta[property='og:title']"})


def html_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("record_id", gzip_text("html").alias("blob"))
    return p.select("record_id", F.md5(F.encode(gunzip_text("blob"), "UTF-8")).alias("digest"))


def stored_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted articles' stored pages, unpacked."""
    a = table(spark, sf_dir, "articles").where(F.col("raw_html_compressed").isNotNull())
    return a.select("id", F.length(gunzip_text("raw_html_compressed")).alias("n_chars"))


def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as text and back, tickers in capitals, cleaned category, paragraphs joined."""
    r = table(spark, sf_dir, "article_data")
    return r.select(
        "record_id", F.array_join(keyword_list(F.array_join("tags", " , ")), "|").alias("tags"), F.array_join(upper_tickers("related_tickers"), "|").alias("tickers"),
        safe_text("category").alias("category"), F.length(join_paragraphs(F.split("full_content", "\n"))).alias("n_joined"),
    )


_H1 = "trim(regexp_extract(raw_html, '<h1[^>]*>(.*?)</h1>', 1, 's'))"
_UN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"
_NZ = lambda x: f"nullif(trim({x}), '')"
_STRIP = lambda x: f"nullif(trim({x}, ' ' || chr(9) || chr(10)), '')"
_COMPOSED = "FROM article_data WHERE title IS NOT NULL AND source_publisher IS NOT NULL AND regexp_matches(source_url, '^https?://[^/?#]+')"
_IMAGE = "'/img/' || record_id || '.jpg'"
_ROOTED = f"regexp_extract(source_url, '^https?://[^/?#]+') || {_IMAGE}"
_STAMP = lambda end: f"strftime(make_timestamp(epoch_us(scraped_at)), '%Y-%m-%dT%H:%M:%S{end}')"
_WORDS = lambda c, x="{}": f"nullif(array_to_string(list_filter(list_transform({c}, lambda t: {x.format('t')}), lambda t: t <> ''), '|'), '')"
_PARAGRAPHS = lambda by: f"array_to_string(list_filter(list_transform(string_split(full_content, chr(10)), lambda t: trim(t)), lambda t: t <> ''), {by})"
_MERGED = f"""SELECT record_id, coalesce({_NZ('title')}, 'card') AS title, {_NZ('summary')} AS summary, coalesce(CASE WHEN category IS NOT NULL THEN {_NZ('language')} END, 'xx') AS language,
    CASE WHEN nullif({_PARAGRAPHS("''")}, '') IS NOT NULL THEN 'success' ELSE 'partial_extraction' END AS status,
    CASE WHEN {_NZ('title')} IS NULL THEN 'opengraph' WHEN category IS NOT NULL THEN 'jsonld' ELSE 'crawl4ai_schema' END AS title_tier, CASE WHEN {_NZ('summary')} IS NOT NULL THEN 'opengraph' END AS summary_tier,
    CASE WHEN category IS NOT NULL AND {_NZ('language')} IS NOT NULL THEN 'jsonld' ELSE 'newspaper' END AS language_tier, CASE WHEN nullif({_PARAGRAPHS("''")}, '') IS NOT NULL THEN 'trafilatura' END AS content_tier,
    'batch ' || batch_no AS via {_COMPOSED}"""
_LISTED = f"""SELECT *, {ADDRESSES['url_canonicalize'].split('SELECT record_id,')[1].split(' AS url')[0].replace('source_url', 'url')} AS link FROM listing_cards WHERE contains(url, '/news/')"""
QUERIES = {
    "opengraph_extract": opengraph_extract, "page_extract": page_extract, "stored_titles": stored_titles, "text_extract": text_extract, "jsonld_extract": jsonld_extract, "css_extract": css_extract,
    "schema_extract": schema_extract, "listing_extract": listing_extract, "listing_fallback": listing_fallback, "listing_queue": listing_queue, "tier_merge": tier_merge, "status_rollup": status_rollup,
    "rss_merge": rss_merge, "fill_missing": fill_missing, "structure_alerts": structure_alerts, "selector_health": selector_health, "html_roundtrip": html_roundtrip, "stored_html": stored_html, "list_fields": list_fields,
}
ORACLES = {
    "opengraph_extract": f"""SELECT record_id, coalesce({_NZ('title')}, 'late') AS title, coalesce({_NZ('summary')}, 'late') AS summary, {_ROOTED} AS top_image_url, {_NZ('source_publisher')} AS source_publisher {_COMPOSED}""",
    "page_extract": f"""SELECT record_id, coalesce({_NZ('title')}, 'late') AS title, {_NZ('language')} AS language, {_NZ('summary')} AS summary, {_ROOTED} AS top_image_url, {_STAMP('Z')} AS published_at {_COMPOSED}""",
    "stored_titles": f"""SELECT record_id, CASE WHEN contains(raw_html, 'og:title') THEN {_UN("regexp_extract(raw_html, '<meta property=.og:title. content=.([^>]*?). ?/?>', 1)")} END AS card_title, {_UN(_H1)} AS title
        FROM article_data WHERE raw_html IS NOT NULL""",
    "text_extract": f"SELECT record_id, md5({_PARAGRAPHS('chr(10)')}) AS digest, true AS same {_COMPOSED} AND length(full_content) > 200",
    "jsonld_extract": f"""SELECT record_id, {_NZ('title')} AS title, {_NZ('summary')} AS summary, {_NZ('category')} AS category, source_publisher,
        {_WORDS("string_split(array_to_string(tags, ', '), ',')", 'trim({})')} AS tags, {_IMAGE} AS top_image_url, {_STAMP('+00:00')} AS published_at, 'on ' || {_STAMP('Z')} AS updated_at, {_NZ('language')} AS language,
        nullif(array_to_string(list_transform(list_filter(authors, lambda a: a.name <> ''), lambda a: concat_ws(' ', a.name, nullif(a.url, ''))), '|'), '') AS authors, {_WORDS('related_tickers', 'upper({})')} AS tickers {_COMPOSED}""",
    "css_extract": f"""SELECT record_id, {_NZ('title')} AS title, {_NZ('summary')} AS summary, {_NZ('category')} AS category, {_NZ('source_publisher')} AS source_publisher,
        {_WORDS('list_transform(authors, lambda a: a.name)', 'trim({})')} AS authors, coalesce({_STRIP('published_at')}, {_STRIP('updated_at')}) AS published_at, {_STRIP('updated_at')} AS updated_at, {_IMAGE} AS top_image_url,
        'First part' AS full_content, {_WORDS('related_tickers', 'upper(trim({}))')} AS tickers {_COMPOSED}""",
    "schema_extract": f"""SELECT record_id, {_NZ('title')} AS title, {_NZ('summary')} AS summary, {_STAMP('Z')} AS published_at, {_NZ('source_publisher')} AS source_publisher,
        md5(nullif({_PARAGRAPHS('chr(10) || chr(10)')}, '')) AS digest {_COMPOSED}""",
    "listing_extract": f"""SELECT run_uuid, page_num, url, {_NZ('preview_title')} AS preview_title, {_NZ('preview_timestamp')} AS preview_timestamp, {_NZ('source_publisher')} AS source_publisher FROM listing_cards WHERE contains(url, '/news/')""",
    "listing_fallback": f"""SELECT card_id, url, {_NZ('preview_title')} AS preview_title, '/i.jpg' AS preview_thumbnail_url, {_NZ('preview_timestamp')} AS preview_timestamp, {_NZ('source_publisher')} AS source_publisher
        FROM listing_cards WHERE contains(url, '/news/')""",
    "listing_queue": f"""SELECT run_uuid, link AS url, count(*) AS n_cards, min({_NZ('preview_title')}) AS first_title FROM ({_LISTED}) WHERE regexp_matches(link, '^(?:{ARTICLE_PATTERN})') GROUP BY 1, 2""",
    "tier_merge": _MERGED,
    "status_rollup": f"SELECT status, title_tier, count(*) AS n FROM ({_MERGED}) GROUP BY 1, 2",
    "rss_merge": f"""SELECT record_id, coalesce(nullif(title, ''), {_UN(_H1)}) AS title, CASE WHEN title <> '' THEN 'rss' ELSE 'newspaper' END AS title_tier, regexp_extract(raw_html, '<html lang=.([^>"]*)', 1) AS language, 'newspaper' AS language_tier,
        nullif(published_at, '') AS published_at, CASE WHEN published_at <> '' THEN 'rss' END AS published_tier, coalesce(len(authors), 0)::INT AS n_authors FROM article_data WHERE raw_html IS NOT NULL""",
    "fill_missing": """SELECT record_id, CASE WHEN coalesce(title, '') <> '' THEN title ELSE string_split(coalesce(full_content, ''), chr(10))[1] END AS title,
        CASE WHEN coalesce(title, '') <> '' AND coalesce(full_content, '') <> '' THEN 'success' ELSE 'filled' END AS status, length(substr(full_content, 1, 50000))::INT AS n_chars FROM article_data""",
    "structure_alerts": """SELECT record_id FROM article_data WHERE (raw_html IS NOT NULL OR full_content IS NOT NULL)
        AND NOT coalesce(regexp_matches(raw_html, '<h1|<article|og:image|<time|byline|provider|/topic/|/quote/'), false)""",
    "selector_health": """SELECT probe, count(*) AS pages, sum(n)::BIGINT AS matches, count(*) FILTER (n = 0) AS empty_pages FROM (
        SELECT unnest(['h1', 'p', 'li', 'og']) AS probe, unnest([len(regexp_extract_all(raw_html, '<h1[ >]')), len(regexp_extract_all(raw_html, '<p[ >]')), len(regexp_extract_all(raw_html, '<li[ >]')), len(regexp_extract_all(raw_html, 'property=.og:title'))]) AS n
        FROM article_data WHERE raw_html IS NOT NULL) GROUP BY probe""",
    "html_roundtrip": "SELECT record_id, md5(raw_html) AS digest FROM article_data WHERE raw_html IS NOT NULL",
    "list_fields": """SELECT record_id, array_to_string(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
        array_to_string(list_transform(list_filter(related_tickers, lambda t: trim(t) <> ''), lambda t: upper(trim(t))), '|') AS tickers, nullif(trim(category), '') AS category,
        length(array_to_string(list_filter(string_split(full_content, chr(10)), lambda x: x <> ''), chr(10) || chr(10)))::INT AS n_joined FROM article_data""",
}
