"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import site
from newsloom.llm import boilerplate, known, leaks, names, packing, sitelines, splitting, survivors, truncation
from newsloom.llm.values import STAND_INS
from newsloom.operators.stamps import parse_stamps, with_site_clock
from newsloom.session import scratch, stage, table


# --- problem 1 -------------------------------------------------------------------------------------------------------
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value survives, for each group of dup_members and field."""
    return survivors.survivors(table(spark, sf_dir, "dup_members"), table(spark, sf_dir, "article_data"))


def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article for each group, with undated rows placed by value transitions."""
    g = survivors.golden_records(table(spark, sf_dir, "dup_members"), table(spark, sf_dir, "article_data"))
    return g.withColumn("sources", F.to_json("sources"))


# --- problem 2 -------------------------------------------------------------------------------------------------------
def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct spellings with counts: (kind, name, n)."""
    records = table(spark, sf_dir, "article_data")
    authors = records.select(F.explode("authors").alias("x")).select(F.lit("author").alias("kind"), F.col("x.name").alias("name"))
    outlets = records.select(F.lit("publisher").alias("kind"), F.col("source_publisher").alias("name"))
    return authors.unionByName(outlets).where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that stand for the same person or publisher."""
    return names.variant_pairs(stage(names.name_groups(_spellings(spark, sf_dir)), "name-groups"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with a variant: the spelling that stands for its person or publisher, and how many it is linked to."""
    groups = stage(names.name_groups(_spellings(spark, sf_dir)), "name-groups")
    sizes = groups.groupBy("kind", "entity").agg((F.count("*") - 1).alias("n_links"))
    return groups.join(sizes, ["kind", "entity"])


# --- problem 3 -------------------------------------------------------------------------------------------------------
def _text_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "article_data")
    pair = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"))
    values = records.select(F.col("record_id").alias("row_id"), site("source_url").alias("site"), "full_content", "summary")
    values = values.select("row_id", "site", F.explode(F.array(pair("full_content"), pair("summary"))).alias("x"))
    values = values.select("row_id", "site", "x.field_name", "x.value").where(F.col("value").isNotNull())
    return values, records.select(F.col("title").alias("value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of full_content and summary that stop before they were finished."""
    return truncation.truncated(*_text_values(spark, sf_dir)).select(F.col("row_id").alias("record_id"), "field_name")


def p3_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each site truncates each field."""
    values, titles = _text_values(spark, sf_dir)
    return truncation.share_by_site(values, truncation.truncated(values, titles))


# --- problem 4 -------------------------------------------------------------------------------------------------------
def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boilerplate.Model]:
    pages = table(spark, sf_dir, "article_data").where(F.col("raw_html").isNotNull())
    pages = pages.select(F.col("record_id").alias("doc"), F.col("raw_html").alias("source"), F.col("full_content").alias("content"))
    texts = table(spark, sf_dir, "articles").select("id", F.col("full_content").alias("text"), "title")
    return pages, boilerplate.fit(pages, texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of full_content that are not paragraphs of the article, in records with page source."""
    return boilerplate.page_lines(*_pages(spark, sf_dir)).select(F.col("doc").alias("record_id"), "line_no")


def p4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's own text of every record with page source; where the record has no content, from the source alone."""
    return boilerplate.main_text(*_pages(spark, sf_dir)).select(F.col("doc").alias("record_id"), "text")


# --- problem 6 -------------------------------------------------------------------------------------------------------
def _site_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "article_data").where(F.col("raw_html").isNull() & F.col("full_content").isNotNull())
    return docs.select(F.col("record_id").alias("doc"), site("source_url").alias("site"), F.col("full_content").alias("text"))


def _counted(spark: SparkSession, sf_dir: str, digests: DataFrame) -> DataFrame:
    """Digests of records that are no known copies: only these are counted."""
    copies = table(spark, sf_dir, "dup_members").select(F.col("record_id").alias("doc")).distinct()
    return digests.join(copies, "doc", "left_anti")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that one site repeats, in records without page source that are no known copies."""
    digests = stage(_counted(spark, sf_dir, sitelines.digest(_site_docs(spark, sf_dir))), "line-digests")
    return sitelines.repeated_lines(digests).select(F.col("doc").alias("record_id"), "line_no")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all records without page source, known copies too, without the lines that their site repeats."""
    docs = _site_docs(spark, sf_dir)
    digests = stage(sitelines.digest(docs), "line-digests")
    hot = sitelines.hot_lines(stage(_counted(spark, sf_dir, digests), "counted-digests"))
    return sitelines.cut_lines(docs, sitelines.lines_like(digests, hot)).select(F.col("doc").alias("record_id"), "text")


# --- problem 7 -------------------------------------------------------------------------------------------------------
def _dated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as rows to be judged: id, batch, url, title, at (publication time in microseconds)."""
    records = table(spark, sf_dir, "article_data").select("record_id", "batch_no", "source_url", "title", "published_at")
    clocked = with_site_clock(records, "source_url", table(spark, sf_dir, "sites"))
    stamped = parse_stamps(clocked, "published_at", "site_zone", "site_order", "at")
    return stamped.select(F.col("record_id").alias("id"), F.col("batch_no").cast("int").alias("batch"), F.col("source_url").alias("url"), "title", "at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of batches 1 to 12 whose article is in articles or came in an earlier batch."""
    accepted = table(spark, sf_dir, "articles").select("id", F.lit(-1).alias("batch"), F.col("source_url").alias("url"), "title", F.unix_micros("published_at").alias("at"))
    return known.find_known(_dated_records(spark, sf_dir).unionByName(accepted), scratch(spark, "accepted-hashes")).select(F.col("id").alias("record_id"))


# --- problem 8 -------------------------------------------------------------------------------------------------------
CAPACITY = 4096


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, in tokens of a public tokenizer."""
    return packing.fill_containers(packing.token_sizes(table(spark, sf_dir, "documents")), CAPACITY)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers over the capacity, texts cut though they fit one, and texts whose pieces have gaps."""
    sized = stage(packing.token_sizes(table(spark, sf_dir, "documents")), "token-sizes")
    packed = stage(packing.fill_containers(sized, CAPACITY), "containers")
    over = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.sum(F.when(F.col("n") > CAPACITY, 1).otherwise(0)).cast("bigint").alias("n_over"))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_packed"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end")).join(sized, "doc_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    told = texts.agg(F.count("*").alias("n_docs"), n((F.col("n_pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("n_cut_in_vain"), n((F.col("n_packed") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("n_gaps"))
    n_over = over.first()[0] or 0  # one number
    return told.withColumn("n_over", F.lit(n_over).cast("bigint"))


# --- problem 9 -------------------------------------------------------------------------------------------------------
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and an evaluation item that it holds a passage of."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# --- problem 10 ------------------------------------------------------------------------------------------------------
PIECE_LIMIT, PIECE_OVERLAP = 512, 48


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document over the limit."""
    return splitting.split_documents(table(spark, sf_dir, "documents"), PIECE_LIMIT, PIECE_OVERLAP)


def p10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that their pieces give back, by digest; pieces over the limit and pieces that share too little count as wrong."""
    docs = table(spark, sf_dir, "documents")
    pieces = stage(splitting.split_documents(docs, PIECE_LIMIT, PIECE_OVERLAP), "pieces")
    before = F.coalesce(F.lag("char_to").over(Window.partitionBy("doc_id").orderBy("piece_no")), F.lit(0))  # bounded by a document's pieces
    own = pieces.withColumn("before", before).select("doc_id", "piece_no", F.expr("substring(piece, before - char_from + 1)").alias("own"), ((F.col("n_tokens") > PIECE_LIMIT) | (F.col("char_from") > F.col("before")) | ((F.col("piece_no") > 0) & (F.col("n_shared") < PIECE_OVERLAP))).alias("wrong"))
    whole = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "").alias("text"), F.max("wrong").alias("wrong"))
    told = whole.join(docs.select("doc_id", F.md5("text").alias("digest")), "doc_id").where((F.md5("text") != F.col("digest")) | F.col("wrong"))
    return told.agg(F.count("*").alias("n_wrong")).select("n_wrong", F.lit(docs.count()).alias("n_docs"))


QUERIES = {
    "p1_found": p1_found,
    "p1_golden": p1_golden,
    "p2_found": p2_found,
    "p2_members": p2_members,
    "p3_found": p3_found,
    "p3_by_site": p3_by_site,
    "p4_found": p4_found,
    "p4_main_text": p4_main_text,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p10_pieces": p10_pieces,
    "p10_checks": p10_checks,
}

_SAYS = """(trim(regexp_replace({0}, '^[\\s]+|[\\s]+$', '', 'g')) <> '' AND lower(trim(regexp_replace({0}, '^[\\s]+|[\\s]+$', '', 'g'))) NOT IN ({1}))"""
_STAND_INS = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)


_TIERS = "[" + ", ".join(f"'{t}'" for t in survivors.TIER_ORDER) + "]"  # the fixed order of the operator


def _p1_sql() -> str:
    """The best claim by row_number over all members of a group, for each field."""

    def word(x: str) -> str:
        return f"regexp_replace(lower({x}), '[\\s_-]+', '', 'g')"

    status = f"CASE {word('status')} WHEN 'success' THEN 0 WHEN 'partialextraction' THEN 1 WHEN 'partial' THEN 1 WHEN 'failed' THEN 2 ELSE 99 END"
    parts = []
    for f in survivors.FIELDS:
        tier = f"coalesce(list_position({_TIERS}, {word(f"extraction_tier_used['{f}']")}), 99)"
        says = f"len(list_filter(authors, lambda a: {_SAYS.format('a.name', _STAND_INS)})) > 0" if f == "authors" else _SAYS.format(f, _STAND_INS)
        parts.append(f"SELECT '{f}' AS field_name, record_id, {status} AS s, {tier} AS t, scraped_at FROM article_data WHERE {says}")
    return f"""
    WITH m AS (SELECT DISTINCT group_id, record_id FROM dup_members WHERE group_id IS NOT NULL AND record_id IS NOT NULL),
    c AS ({' UNION ALL '.join(parts)}),
    r AS (SELECT m.group_id, c.field_name, m.record_id,
                 row_number() OVER (PARTITION BY m.group_id, c.field_name ORDER BY s, t, scraped_at DESC NULLS LAST, m.record_id) AS n
          FROM m JOIN c USING (record_id))
    SELECT group_id, field_name, record_id FROM r WHERE n = 1"""


_SITE_SQL = r"regexp_extract(lower(source_url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)', 1)"
_P6_SQL = f"""
    WITH d AS (SELECT record_id, {_SITE_SQL} AS site, string_split(full_content, chr(10)) AS lines
               FROM article_data WHERE raw_html IS NULL AND full_content IS NOT NULL AND record_id NOT IN (SELECT record_id FROM dup_members)),
    l AS (SELECT record_id, site, unnest(range(1, len(lines) + 1))::INT AS line_no,
                 unnest(list_transform(lines, lambda x: lower(regexp_replace(x, '[^\\pL]', '', 'g')))) AS k FROM d),
    n AS (SELECT site, count(*) AS docs FROM d GROUP BY site),
    h AS (SELECT site, k FROM l JOIN n USING (site) WHERE k <> '' GROUP BY site, k, docs HAVING count(DISTINCT record_id) >= 4 AND count(DISTINCT record_id) >= docs * 0.05)"""
_P6_CLEAN = _P6_SQL.replace("AND record_id NOT IN (SELECT record_id FROM dup_members)", "") + """, x AS (SELECT record_id, list(line_no) AS gone FROM l JOIN g USING (site, k) GROUP BY 1)
    SELECT record_id, CASE WHEN gone IS NULL THEN full_content ELSE array_to_string(list_filter(lines, lambda t, i: NOT list_contains(gone, i::INT)), chr(10)) END AS text
    FROM d JOIN article_data USING (record_id) LEFT JOIN x USING (record_id) WHERE site IS NOT NULL"""
_P6_CLEAN = _P6_CLEAN.replace("n AS (SELECT site, count(*) AS docs FROM d", "u AS (SELECT * FROM l WHERE record_id NOT IN (SELECT record_id FROM dup_members)), n AS (SELECT site, count(*) AS docs FROM d WHERE record_id NOT IN (SELECT record_id FROM dup_members)").replace("h AS (SELECT site, k FROM l JOIN n", "g AS (SELECT site, k FROM u JOIN n")

ORACLES: dict[str, str] = {
    "p1_found": _p1_sql(), "p6_found": _P6_SQL + " SELECT record_id, line_no FROM l JOIN h USING (site, k)", "p6_clean": _P6_CLEAN,
    "p8_checks": "SELECT count(doc_id) AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_cut_in_vain, 0::BIGINT AS n_gaps FROM documents",
    "p10_checks": "SELECT 0::BIGINT AS n_wrong, count(*) AS n_docs FROM documents",
}
