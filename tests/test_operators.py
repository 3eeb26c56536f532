import os
import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions.dom import parse, select
from newsloom.functions.text import backoff_seconds, gunzip_text, gzip_text, has_captcha, ticker, title_key
from newsloom.functions.urls import canonical_url, page_key, with_pagination
from newsloom.operators import dedupe, health, incremental, store, tiers
from newsloom.operators.scans import running, since_reset
from newsloom.sources.stored import site_config

UTC = timezone.utc


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_titles(spark):
    assert one(spark, "  Hello,  World!  ", title_key) == "helloworld"
    assert one(spark, "Hello – World?", title_key) == one(spark, "hello-world", title_key) == "helloworld"
    assert one(spark, "Ｆｕｌｌ​ １", title_key) == "full1"
    assert one(spark, None, title_key) == one(spark, "", title_key) == ""


def test_addresses(spark):
    canon = lambda u: canonical_url(u, F.lit("https://a.example/list?x=1"), "a.example", "https://a.example")
    assert one(spark, "https://a.example/n.html?utm_source=x&id=2&fr=y#top", canon) == "https://a.example/n.html?id=2"
    assert one(spark, "/news/1.html", canon) == "https://a.example/news/1.html"
    assert one(spark, "//m.a.example/1?guccounter=1", canon) == "https://m.a.example/1"
    assert one(spark, "https://other.example/?utm_source=x#f", canon) == "https://other.example/?utm_source=x#f"
    assert one(spark, "https://nota.example/?fr=x", canon) == "https://nota.example/?fr=x"
    assert one(spark, "https://a.example/s?q=a%20b&q=c&x", canon) == "https://a.example/s?q=a+b&q=c&x="
    assert one(spark, "  ", canon) is None and one(spark, None, canon) is None
    page = lambda u: with_pagination(u, F.lit(20), F.lit(10))
    assert one(spark, "https://a.example/?start=5&tab=1", page) == "https://a.example/?start=20&tab=1&count=10"
    assert one(spark, one(spark, "https://a.example/", page), page) == "https://a.example/?start=20&count=10"
    same = ["https://www.a.example/x.html", "http://M.A.Example:80/x.html#c", "https://amp.a.example:443/x.html?utm_medium=s&ncid=1", "https://a.example/x.html/"]
    assert len({one(spark, u, page_key) for u in same}) == 1
    assert one(spark, "https://a.example/x?id=1", page_key) != one(spark, "https://a.example/x?id=2", page_key)
    assert one(spark, "", page_key) is None


def test_small_functions(spark):
    assert [one(spark, t, ticker) for t in ("(AAPL) up", "buy TSLA now", "none", None)] == ["AAPL", "TSLA", None, None]
    assert one(spark, "x" * 20_001 + "captcha", has_captcha) is False and one(spark, "Please VERIFY", has_captcha) and one(spark, None, has_captcha) is False
    assert [r[0] for r in spark.range(1, 8).select(backoff_seconds("id", 2.0, 60.0)).collect()] == [2, 4, 8, 16, 32, 60, 60]
    assert one(spark, "äöü", lambda c: gunzip_text(gzip_text(c))) == "äöü"
    assert spark.sql("select cast('zz' as binary) b").select(gunzip_text("b").alias("y")).first()["y"] is None


PAGE = """<html lang="en"><head><title>T</title><meta content="Card title" property="og:title"><meta name="twitter:title" content="Other">
<meta property="og:image" content="/i.jpg"><meta name="description" content="Sum"><script type="application/ld+json">{bad</script>
<script type="application/ld+json">{"@graph":[{"@type":"WebSite","headline":"no"},{"@type":["X","NewsArticle"],"headline":" Head ","datePublished":"2026-10-05T12:00:00Z",
"author":[{"name":"A"},{"givenName":"B","url":"u"}],"image":[{"url":"z.jpg"}],"publisher":{"name":"P"},"keywords":"x, ,y","about":[{"name":"aapl"}]}]}</script></head>
<body><nav><a href="/">Home</a></nav><article><h1 class="big title">Heading</h1><span class="byline-x">Ann</span><p>One <b>bold<p>Two &amp; three</p><a href="/quote/T">T (TSLA)</a></article></body></html>"""


def test_dom():
    d = parse(PAGE)
    assert [n.text() for n in select(d, "article > p")] == ["One bold", "Two & three"] or len(select(d, "article p")) == 2
    assert select(d, "meta[property='og:title'], meta[name=\"description\"]")[0].attrs["content"] == "Card title"
    assert [n.tag for n in select(d, "nav a, h1.big, *[class*='byline']")] == ["a", "h1", "span"]
    assert [n.attrs["id"] for n in select(parse("<ul><li id=a><li id=b></ul>"), "li:last-child")] == ["b"]
    assert select(parse(""), "p") == [] and parse("<p>" * 300).tag == ""
    with pytest.raises(ValueError):
        select(d, "p:nth-child(2)")


def test_tiers_and_merge(spark):
    pages = spark.createDataFrame([("https://s.example/a", PAGE, "httpx", 1), ("u", "<html><body></body></html>", "x", 2), ("n", None, "x", 3), ("e", "", None, 4)], "url string, html string, via string, tier int")
    got = {r["url"]: r for r in tiers.merge_candidates(tiers.extract_tiers(pages), via="via").collect()}
    r = got["https://s.example/a"]
    assert (r["title"], r["status"], r["published_at"], r["language"]) == ("Head", "success", "2026-10-05T12:00:00+00:00", "en")
    assert [a["name"] for a in r["authors"]] == ["A", "B"] and r["tags"] == ["x", "y"] and r["related_tickers"] == ["AAPL"] and r["top_image_url"] == "z.jpg"
    assert r["extraction_tier_used"]["title"] == "jsonld" and r["extraction_tier_used"]["full_content"] == "crawl4ai_schema" and r["extraction_tier_used"]["_crawl_via"] == "httpx"
    assert "Two & three" in r["full_content"] and r["tier"] == 1
    assert [got[u]["status"] for u in ("u", "n", "e")] == ["failed"] * 3
    og = tiers.tier_opengraph(PAGE, "https://s.example/a", parse(PAGE))
    assert og["title"] == "Card title" and og["top_image_url"] == "https://s.example/i.jpg"
    assert tiers.tier_css(PAGE, "", parse(PAGE), each=True)["related_tickers"] == ["T"]
    ld = lambda v: tiers.tier_jsonld('<script type="application/ld+json">// note\n{"@type":"Article","dateModified":%s,"author":"A","image":[],"keywords":["x",1]}</script>' % v, "", parse(""))
    assert ld('"soon"')["updated_at"] == "soon" and ld('""')["updated_at"] is None and ld("7")["updated_at"] is None
    assert ld("1")["authors"] is None and ld("1")["top_image_url"] is None and ld("1")["tags"] == ["x", "1"]


STORY = """<html lang="en"><head><meta name="description" content="Sum"><meta property="og:image" content="https://s.example/og.jpg"></head><body><article><h1 data-test-l10n-id="title">Head</h1>
<div class="byline"><a class="byline" href="/a">Ann</a><span class="byline">Bo</span></div><time datetime="2026-10-05T12:00:00Z">Oct 5</time><div class="article-body"><p>One.</p><p>Two.</p></div>
<div class="provider"><a>Wire</a></div><ul><li><a href="/quote/AB">AB</a></li><li><a href="/quote/CD">CD</a></li></ul></article></body></html>"""


def test_selectors_of_both_tiers():
    css, schema = tiers.tier_css(STORY, "", parse(STORY)), tiers.tier_schema(STORY, "", parse(STORY))
    for r in (css, schema):
        assert (r["title"], r["summary"], r["published_at"], r["top_image_url"], r["source_publisher"], r["related_tickers"]) == ("Head", "Sum", "2026-10-05T12:00:00Z", "https://s.example/og.jpg", "Wire", ["AB", "CD"])
    assert css["full_content"] == "One." and schema["full_content"] == "One.\n\nTwo." and [a["name"] for a in css["authors"]] == ["Ann", "Bo"]
    assert tiers.tier_css("", "", parse('<div><a class="provider-link">no</a></div>')) is None


def test_site_configurations(spark, tmp_path):
    path = tmp_path / "site.json"
    path.write_text('{"article": {"title": {"css": "h4"}, "related_tickers": {"css": "i", "transform": "twice"}}}')
    config = site_config(str(path))
    assert config.schema == tiers.DEFAULT.schema and config.article["title"].css == "h4"
    tiers.register_transform("twice", lambda v: v * 2)
    pages = spark.createDataFrame([("u", "<h4>T</h4><i>a</i>", None), ("c", "<h1>T</h1>", "<h1>Clean</h1>")], "url string, html string, cleaned_html string")
    got = {(r["url"], c["tier"]): c for r in tiers.extract_tiers(pages, config=config).collect() for c in r["candidates"]}
    assert got[("u", "css_fallback")]["title"] == "T" and got[("u", "css_fallback")]["related_tickers"] == ["AA"] and got[("c", "crawl4ai_schema")]["title"] == "Clean"
    path.write_text('{"articel": {}}')
    with pytest.raises(TypeError):
        site_config(str(path))


def test_deep_pages(spark):
    deep = "<div>" * 3000 + "<p>x<li class='stream-item'><a href='/news/1'>y</a>"
    d = parse(deep)
    assert d.text() == "x y" and len(select(d, "div div")) == 2999 and len(d.walk()) == 3003
    pages = spark.createDataFrame([(1, "u", deep), (2, "v", None)], "page_num int, url string, html string")
    assert tiers.extract_cards(pages).count() == 1 and tiers.probe_pages(pages).count() == 5
    assert [r["n"] for r in tiers.extract_tiers(pages).orderBy("page_num").select(F.size("candidates").alias("n")).collect()][1] == 0


def test_listing_fallback_and_items(spark):
    base = '<ul><li class="x stream-item"><a href="/news/%s.html"><div>i</div><div>Head %s</div></a>%s</li></ul>'
    config = replace(tiers.DEFAULT, cards={**tiers.DEFAULT.cards, "card": tiers.Rule("li.none")})
    pages = spark.createDataFrame([(1, base % (1, 1, "<footer><span>2h ago</span></footer>")), (2, base % (2, 2, '<span class="time"></span><time datetime="2026-01-01">x</time>')), (3, "<li class='stream-item'><h3>no link</h3></li>")], "page_num int, html string")
    got = {r["page_num"]: (r["preview_title"], r["preview_timestamp"]) for r in tiers.extract_cards(pages, config).collect()}
    assert got == {1: ("Head 1", "2h ago"), 2: ("Head 2", "2026-01-01")}
    items = tiers.listing_items(tiers.extract_cards(pages, config), F.lit("https://a.example/t"), "a.example", "https://a.example", r"https://a\.example/news/1\.html$")
    assert [r["url"] for r in items.collect()] == ["https://a.example/news/1.html"]
    alerts = tiers.extract_tiers(pages.withColumn("url", F.lit("u")), ("css_fallback",))
    assert {r["page_num"] for r in alerts.where(tiers.structure_alert(F.col("candidates"))).collect()} == {1, 3}


def test_cards_probes_and_hooks(spark):
    li = '<li class="stream-item-x"><a href="/news/1.html"><h3>One</h3></a><span class="time">2h ago</span></li><li class="js-stream-content"><h3>No link</h3></li>'
    pages = spark.createDataFrame([(1, f"<ul>{li}</ul>"), (2, None)], "page_num int, html string")
    (r,) = tiers.extract_cards(pages).collect()
    assert (r["page_num"], r["pos"], r["url"], r["preview_title"], r["preview_timestamp"]) == (1, 0, "/news/1.html", "One", "2h ago")
    assert {x["probe"]: x["matches"] for x in tiers.probe_pages(pages, {"h3": "h3", "p": "p"}).collect()} == {"h3": 2, "p": 0}
    merged = tiers.merge_candidates(tiers.extract_tiers(spark.createDataFrame([("u", "<h1>T</h1>")], "url string, html string")))
    done = tiers.complete_missing(merged, lambda it: (p.assign(status="success") for p in it))
    assert done.first()["status"] == "success" and tiers.complete_missing(merged, None) is merged
    feed = spark.createDataFrame([("u", "T", None, None, None, None)], "url string, title string, summary string, published_at string, authors array<struct<name:string,url:string>>, tags array<string>")
    assert tiers.rss_records(feed).first()["candidate"]["tier"] == "rss"


def sequential_kept(rows):
    urls, keys, kept = {}, {}, set()
    for g, _, u, k, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[4])):
        if u in urls.setdefault(g, set()) or (k is not None and k in keys.setdefault(g, set())):
            continue
        urls[g].add(u)
        if k is not None:
            keys.setdefault(g, set()).add(k)
        kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedupe_against_sequential_pass(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 15, 30])
    rows = [(rng.choice(["r", "s"]), p, f"u{rng.randrange(n)}", rng.choice([None, f"k{rng.randrange(n)}"]), p) for p in range(120)]
    df = spark.createDataFrame(rows, "run string, pos int, url string, key string, id int")
    assert {r["id"] for r in dedupe.greedy_kept(df, "run", ["pos", "id"], "id", step_rows=rng.choice([0, 40])).collect()} == sequential_kept(rows)
    assert {r["id"] for r in dedupe.greedy_kept(df, "run", ["pos", "id"], "id").collect()} == sequential_kept(rows)


def test_greedy_long_chain(spark):
    rows = [("r", i, f"u{(i + 1) // 2}", f"k{i // 2}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, pos int, url string, key string, id int")
    assert {r["id"] for r in dedupe.greedy_kept(df, "run", ["pos", "id"], "id", step_rows=0).collect()} == sequential_kept(rows)


def test_greedy_chain_and_empty(spark):
    df = spark.createDataFrame([("r", 1, "u1", "k1", 1), ("r", 2, "u2", "k1", 2), ("r", 3, "u2", "k2", 3)], "run string, pos int, url string, key string, id int")
    assert {r["id"] for r in dedupe.greedy_kept(df, "run", ["pos"], "id").collect()} == {1, 3}
    assert dedupe.greedy_kept(df.limit(0), "run", ["pos"], "id").count() == 0


def test_scans_against_loops(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.2, rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, reset boolean, add int").withColumn("b", F.floor(F.col("i") / 17))
    got = {r["i"]: (r["v"], r["s"], r["m"]) for r in running(since_reset(df, ["k"], "b", ["i"], F.col("reset"), F.col("add"), "v"), ["k"], "b", ["i"], {"s": F.col("add")}, {"m": F.col("add")}).collect()}
    state = {}
    for k, i, reset, add in rows:
        v, s, m = state.get(k, (0, 0, 0))
        state[k] = ((0 if reset else v) + add, s + add, max(m, add))
        assert got[i] == state[k]


def test_incremental(spark):
    now = datetime(2026, 7, 1, tzinfo=UTC)
    a = spark.createDataFrame([(1, now - timedelta(days=1), now - timedelta(hours=5)), (2, None, None)], "id int, published_at timestamp, first_seen_at timestamp")
    assert incremental.cutoff(a, now).first()["cutoff"].replace(tzinfo=UTC) == now - timedelta(hours=5, minutes=2)
    assert incremental.cutoff(a.limit(0), now).first()["cutoff"].replace(tzinfo=UTC) == now - timedelta(days=3)
    assert incremental.cutoff(a.where("id = 2"), now).first()["cutoff"].replace(tzinfo=UTC) == now - timedelta(minutes=2)
    cards = spark.createDataFrame([(i, "r", i // 10, i % 10, f"u{i if i < 12 else 0}", None, None) for i in range(40)], "card_id int, run_uuid string, page_num int, pos int, url string, key string, preview_published_at timestamp")
    marked = incremental.mark_known(cards, spark.createDataFrame([], "url string, key string"))
    counted = incremental.old_runs(marked, F.lit(now))
    stop = incremental.early_stop(counted).first()
    assert (stop["pages"], stop["stopped_old"]) == (2, True)
    assert incremental.crawl_queue(counted, incremental.early_stop(counted)).count() == 12
    for wrong in ({"page_size": 0}, {"min_delay_sec": -1.0}, {"min_delay_sec": 3.0, "max_delay_sec": 2.0}):
        with pytest.raises(ValueError):
            incremental.CrawlSettings(**wrong)
    art = spark.createDataFrame([("u1", "k1", now - timedelta(hours=1)), ("u2", "k2", now - timedelta(hours=20)), ("u3", None, now)], "url string, key string, scraped_at timestamp")
    c = spark.createDataFrame([("u1", None), ("u2", "k9"), ("u9", "k2"), ("u8", None)], "url string, key string")
    assert {r["url"] for r in incremental.fresh_cards(c, art, now).collect()} == {"u2", "u8"}
    assert incremental.fresh_cards(c, art, now, incremental.CrawlSettings(force_refresh=True)).count() == 4


def test_near_time(spark):
    t = datetime(2026, 7, 1, 12, 0, tzinfo=UTC)
    a = spark.createDataFrame([(1, "A b", t - timedelta(minutes=1)), (2, "a-B", t + timedelta(minutes=1)), (3, "A b", t + timedelta(minutes=1, seconds=1)), (4, "", t), (5, None, t)], "id int, title string, published_at timestamp")
    rows = spark.createDataFrame([(1, "a b!", t + timedelta(seconds=40)), (2, "a b", None), (3, "", t), (4, "a b", t + timedelta(minutes=5))], "row_id int, title string, published_at timestamp")
    assert {r["row_id"]: r["match_id"] for r in dedupe.near_time_matches(rows, a).collect()} == {1: 1}


def test_health(spark):
    t0 = datetime(2026, 7, 1, tzinfo=UTC)
    rng = random.Random(3)
    log, at = [], t0
    for i in range(600):
        at += timedelta(seconds=rng.choice([5, 40, 200, 400]))
        log.append((i, at - (timedelta(hours=1) if rng.random() < 0.03 else timedelta()), f"https://{rng.choice('ab')}.example/x", rng.choice([200, 403, 429, 500, None, 403]), rng.choice([None, "captcha", "ok"])))
    df = spark.createDataFrame(log + log[:5], "seq int, ts timestamp, url string, status int, html string")
    out = health.outcomes(df)
    assert out.count() == 600
    want, state = [], {}
    for i, ts, url, status, html in log:
        d = url.split("/")[2]
        streak, until, now = state.get(d, (0, 0, 0))
        failed = status in (403, 429) or html == "captcha"
        clean = not failed and status is not None and 200 <= status < 400
        if failed or clean:
            now = max(now, int(ts.timestamp() * 1e6))
            if until and now >= until:
                streak, until = 0, 0
            if failed:
                streak += 1
                if streak >= 3:
                    if until:
                        want[-1 - [w[0] for w in want[::-1]].index(d)][2] = now + 300_000_000
                    else:
                        want.append([d, now, now + 300_000_000])
                    until = now + 300_000_000
            else:
                streak = 0
        state[d] = (streak, until, now)
    got = health.circuit_intervals(out).select("domain", F.unix_micros("opened_at"), F.unix_micros("closed_at")).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(w) for w in want)
    counters = {r["domain"]: r for r in health.domain_counters(out).collect()}
    assert sum(r["total_blocks"] for r in counters.values()) == sum(x[3] in (403, 429) for x in log)
    assert health.circuit_intervals(out.limit(0)).count() == 0


def test_robots(spark):
    rules = spark.createDataFrame([("a.example", ["Disallow: /admin"]), ("b.example", None), ("c.example", [])], "domain string, rules array<string>")
    urls = spark.createDataFrame([("https://www.a.example/admin/x",), ("https://a.example/index.html",), ("https://b.example/admin",), ("https://z.example/admin",), (None,)], "url string")
    from newsloom.functions.urls import site

    got = {r["url"]: r["allowed"] for r in health.robots_allowed(urls, rules, site("url")).collect()}
    assert list(got.values()) == [False, True, True, True, True]


def test_upsert_is_idempotent(spark, tmp_path):
    cur = spark.createDataFrame([(1, "a", "old", 10), (2, "b", "b", 11)], "id int, source_url string, title string, first_seen_at int")
    batch = spark.createDataFrame([(9, "a", "new", 99, 2), (8, "a", "mid", 98, 1), (7, "c", None, 97, 1), (6, None, "x", 1, 1)], "id int, source_url string, title string, first_seen_at int, seq int")
    once = store.upsert(cur, batch, order=["seq"])
    got = {r["source_url"]: (r["id"], r["title"], r["first_seen_at"]) for r in once.collect()}
    assert got == {"a": (1, "new", 10), "b": (2, "b", 11), "c": (7, None, 97)}
    assert sorted(map(tuple, store.upsert(once, batch, order=["seq"]).collect())) == sorted(map(tuple, once.collect()))
    now = datetime(2026, 8, 1, tzinfo=UTC)
    table = spark.createDataFrame([(5, "a", "old", now - timedelta(days=1))], "id bigint, source_url string, title string, first_seen_at timestamp")
    more = spark.createDataFrame([(f"u{k}", f"t{k}") for k in range(50)] + [("a", "new")], "source_url string, title string")
    after = {r["source_url"]: r for r in store.upsert(table, more, now=now).collect()}
    assert after["a"]["id"] == 5 and after["a"]["title"] == "new" and after["a"]["first_seen_at"].day == 31
    fresh = [r["id"] for u, r in after.items() if u != "a"]
    assert len(set(fresh)) == 50 and min(fresh) > 5 and max(fresh) <= 5 + 51 and all(r["first_seen_at"].day == 1 for u, r in after.items() if u != "a")
    run = store.start_run(spark, "article", datetime.now(UTC))
    store.end_run(spark, str(tmp_path / "runs"), run, datetime.now(UTC), {"new_articles": 3})
    assert spark.read.parquet(str(tmp_path / "runs")).first()["new_articles"] == 3


def test_store_rewrites_touched_buckets(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "t"), buckets=4)
    assert s.read() is None
    rows = lambda pairs: spark.createDataFrame(pairs, "source_url string, title string, seq int")
    s.upsert(rows([(f"u{k}", "old", k) for k in range(40)]))
    first = s._folders(s.version())
    s.upsert(rows([("u1", "late", 2), ("u1", "new", 3), (None, "x", 1)]), order=["seq"])
    second = s._folders(s.version())
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 4
    got = {r["source_url"]: r["title"] for r in s.read().collect()}
    assert len(got) == 40 and got["u1"] == "new" and got["u2"] == "old"
    for k in range(3):
        s.upsert(rows([("u2", f"v{k}", 1), (f"x{k}", "n", 1)]))
    assert len(s._versions()) == 2 and s.read().count() == 43 and s.read().where("title = 'v2'").count() == 1
    left = {p for p in os.listdir(tmp_path / "t") if p.startswith("data-")}
    named = {f.split("/")[0] for v in s._versions() for f in s._folders(v).values()}
    assert named <= left
    empty = store.SnapshotStore(spark, str(tmp_path / "e"))
    empty.write(rows([]))
    assert empty.read().count() == 0 and empty.read().columns == ["source_url", "title", "seq"]


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_against_sequential_pass(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2026, 7, 1, tzinfo=UTC)
    when = lambda: rng.choice([None, t0 + timedelta(seconds=rng.randrange(900))])
    table = [(i, f"u{i}", rng.choice(["A b", "C", None]), when()) for i in range(4)]
    rows = [(i, rng.choice("rs"), rng.choice([None, *[f"u{k}" for k in range(25)]]), rng.choice(["a-B", "A b!", "c", "D e", "", None]), when(), rng.choice([None] * 12 + ["blocked", "circuit_open"])) for i in range(80)]
    minute = lambda t: int(t.timestamp()) // 60
    norm = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    urls, kept, aborted, want = {u for _, u, _, _ in table}, [], set(), {}
    for i, run, url, title, at, error in rows:
        if run in aborted:
            want[i] = ("aborted", "none")
        elif error or url is None:
            want[i] = ("failed", "none")
            aborted |= {run} if error == "circuit_open" else set()
        else:
            key = norm(title) and at and (norm(title), minute(at))
            near = key and (any(norm(t) == key[0] and x and (key[1] - 1) * 60 <= x.timestamp() <= (key[1] + 1) * 60 for _, _, t, x in table) or any(k[0] == key[0] and abs(k[1] - key[1]) <= 1 for k in kept))
            want[i] = ("duplicate", "skip") if near else ("duplicate", "update") if url in urls else ("new", "insert")
            if not near:
                urls.add(url)
                kept += [key] if key else []
    cur = spark.createDataFrame(table, "id int, source_url string, title string, published_at timestamp").withColumn("outcome", F.lit(1))
    batch = spark.createDataFrame(rows, "seq int, run_uuid string, source_url string, title string, published_at timestamp, error_type string")
    assert {r["seq"]: (r["outcome"], r["action"]) for r in store.outcomes(cur, batch).collect()} == want
    assert store.outcomes(cur.limit(0), batch.limit(0)).count() == 0


def test_bucket_waits(spark):
    rng = random.Random(4)
    at, log = 0, []
    for i in range(400):
        at += rng.choice([0, 1, 3, 20])
        log.append((i, rng.choice("ab"), datetime(2026, 7, 1, tzinfo=UTC) + timedelta(seconds=at - (50 if rng.random() < 0.05 else 0))))
    df = spark.createDataFrame(log, "seq int, domain string, ts timestamp")
    want, state = {}, {}
    for i, d, ts in log:
        tat, clock = state.get(d, (None, 0))
        clock = max(clock, int(ts.timestamp() * 1e6))
        go = clock if tat is None else max(clock, tat - 7 * 7_500_000)
        state[d] = (max(clock, tat or 0) + 7_500_000, clock)
        want[i] = go - clock
    from newsloom.operators import health as h

    old, h.by_blocks = h.by_blocks, lambda order: F.floor(F.col(order) / 30)
    try:
        assert {r["seq"]: r["waited_us"] for r in h.bucket_waits(df).collect()} == want and max(want.values()) > 0
    finally:
        h.by_blocks = old


def test_fetch_results(spark):
    from newsloom.operators.fetch import fetch_results

    a, b, c, d = (f"https://s.example/{x}" for x in ("ok", "blocked", "admin/x", "short"))
    log = [(1, a, 403, None), (2, a, None, "captcha"), (2, a, None, "captcha"), (3, a, 500, "x"), (4, a, 200, "x"), (10, c, 200, "x"), (20, d, 429, None), (30, None, 200, "x")] + [(40 + k, b, 403 if k < 4 else 200, None) for k in range(6)]
    df = spark.createDataFrame([(i, datetime(2026, 7, 1), u, s, h) for i, u, s, h in log], "seq int, ts timestamp, url string, status int, html string")
    rules = spark.createDataFrame([("s.example", ["Disallow: /admin"])], "domain string, rules array<string>")
    got = {r["url"]: tuple(r)[1:] for r in fetch_results(df, rules).collect()}
    assert got == {a: ("fetched", 3, 500, 3, 6.0), b: ("blocked", None, None, 4, 30.0), c: ("forbidden", None, None, 0, 0.0), d: ("unfinished", None, None, 1, 2.0)}
    assert fetch_results(df.limit(0), rules.limit(0)).count() == 0
    free = incremental.CrawlSettings(respect_robots_txt=False)
    assert {r["url"]: r["outcome"] for r in fetch_results(df, rules, free).collect()}[c] == "fetched"


def test_schemas_and_stream_log(spark, caplog):
    from newsloom.sources import schemas
    from newsloom.streaming.progress import ProgressLog

    df = schemas.conform(spark.createDataFrame([("u", "odd", 7), (None, "success", 8)], "source_url string, status string, extra int"), "articles")
    assert df.columns[:2] == ["id", "source_url"] and "extra" not in df.columns
    broken = {r["source_url"]: set(r["broken"]) for r in schemas.violations(df, "articles").collect()}
    assert broken == {"u": {"first_seen_at", "scraped_at", "status"}, None: {"source_url", "first_seen_at", "scraped_at"}}

    class Event:
        id, runId, name, timestamp, exception = 1, 2, "n", "t", "boom"

    with caplog.at_level("INFO", logger="newsloom.streams"):
        ProgressLog().onQueryStarted(Event())
        ProgressLog(as_json=False).onQueryTerminated(Event())
    assert '"event": "started"' in caplog.text and "event=ended id=1 error=boom" in caplog.text


def test_content_copies(spark):
    d = spark.createDataFrame([(3, "x"), (1, "x"), (2, ""), (4, None), (5, "")], "doc_id int, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in dedupe.content_copies(d).collect()} == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2)}


def test_sources(spark, tmp_path):
    from newsloom.sources import stored

    s = stored.settings_from_env(env={"newsloom_MAX_PAGES": "7", "NEWSLOOM_FORCE_REFRESH": "true"})
    assert (s.max_pages, s.force_refresh, s.page_size) == (7, True, 10)
    (tmp_path / "p.json").write_text('{"url": "u", "html": "<p>x</p>"}\n')
    assert stored.pages(spark, str(tmp_path / "p.json"), "json").first()["html"] == "<p>x</p>"


def test_streams(spark, tmp_path):
    from newsloom.streaming import articles as st

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "u", "<h1>A</h1><p>text</p>"), (2, "u", "<h1>B</h1><p>text</p>"), (3, "e", "")], "seq int, url string, html string").write.parquet(src)
    s = store.SnapshotStore(spark, str(tmp_path / "t"))
    st.upsert_stream(st.read_pages(spark, src, "seq int, url string, html string"), s, str(tmp_path / "cp"), None).awaitTermination()
    got = {r["source_url"]: r for r in s.read().collect()}
    assert got["u"]["title"] == "B" and got["e"]["status"] == "failed" and got["u"]["first_seen_at"] == got["u"]["scraped_at"] and bytes(got["u"]["raw_html_compressed"])[:2] == b"\x1f\x8b"
    ev = str(tmp_path / "ev")
    spark.createDataFrame([("d", i, i * 1_000_000, True, False) for i in range(4)] + [("d", 9, 400_000_000, True, False)], "domain string, seq int, ts_us long, failed boolean, clean boolean").coalesce(1).write.parquet(ev)
    stream = st.circuits(st.read_pages(spark, ev, "domain string, seq int, ts_us long, failed boolean, clean boolean"))
    q = stream.writeStream.format("memory").queryName("openings").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["opened_us"] for r in spark.table("openings").collect()) == [2_000_000, 3_000_000]
    spark.createDataFrame([("u", datetime(2026, 7, 1)), ("u", datetime(2026, 7, 2)), (None, datetime(2026, 7, 2))], "url string, seen_at timestamp").write.parquet(str(tmp_path / "c"))
    q = st.first_sightings(st.read_pages(spark, str(tmp_path / "c"), "url string, seen_at timestamp")).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 1


def test_entry_works_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("newsloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "newsloom.llm", None)  # as if it, or what it needs, could not be imported
    names = e.queries()
    assert "p5_found" in names and "greedy_dedupe" in names and not any(n.startswith("p1_") for n in names)
    assert set(e.oracle_sql()) <= set(names)
