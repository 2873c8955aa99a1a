"""Queries over stored documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import documents as docs
from .bindings import table
from .define import query

_LANGS = list(docs.STOPWORDS)
_SCORE_SQL = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(chr(39) + s + chr(39) for s in docs.STOPWORDS[k])}], x))) AS {k}" for k in _LANGS)
_BEST = " ".join(f"WHEN s[1] = {k} THEN '{k}'" for k in _LANGS)


@query(
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{{L}}]+)', 1) AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {_SCORE_SQL} FROM w), o AS (SELECT *, list_reverse_sort([{", ".join(_LANGS)}]) AS s FROM c)
SELECT doc_id, CASE WHEN n >= 15 AND s[1] >= 5 AND s[1] - s[2] >= 2 THEN CASE {_BEST} END ELSE '' END AS language FROM o"""
)
def language_by_stopwords(spark: SparkSession, d: str) -> DataFrame:
    """The language whose function words lead clearly in the whole text."""
    return docs.stopword_scores(table(spark, d, "documents")).select("doc_id", docs.detected_language().alias("language"))


@query(
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{{L}}]+)', 1) AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {_SCORE_SQL} FROM w), o AS (SELECT *, list_reverse_sort([{", ".join(_LANGS)}]) AS s FROM c)
SELECT doc_id, n AS n_words, CASE WHEN n >= 15 AND s[1] >= 5 AND s[1] - s[2] >= 2 THEN CASE {_BEST} END ELSE '' END AS language FROM o"""
)
def language_of_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same with the number of words."""
    return docs.stopword_scores(table(spark, d, "documents")).select("doc_id", "n_words", docs.detected_language().alias("language"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<html[^>]*\blang\s*=\s*["'']?([a-zA-Z_-]+)', 1), ''), '') AS declared, lower(regexp_extract(html, '(?is)<html[^>]*\blang\s*=\s*["'']?([a-zA-Z]+)', 1)) AS language FROM pages""")
def page_language(spark: SparkSession, d: str) -> DataFrame:
    """Declared language of a page, and its code; the code is told from the text where nothing is declared."""
    pages = table(spark, d, "pages").select("page_id", "html", docs.page_language("html").alias("declared"))
    code = t.language_code(F.col("declared"), tuple(_LANGS), {"gb": "en", "us": "en"})
    told = docs.language_of_text(pages, F.col("declared") == "")
    return told.select("page_id", "declared", F.when(F.col("declared") == "", F.col("text_language")).otherwise(code).alias("language"))


@query(
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, '(?is)\bhref\s*=\s*"([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM a WHERE regexp_extract(a, '(?is)\bhref\s*=\s*"([^"]*)"', 1) NOT IN ('', '#')"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with a target."""
    return docs.links(table(spark, d, "pages"), "page_id").select("page_id", "href", "text")


_TEMPLATE = r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)', 1) AS host,
  list_filter(string_split(regexp_extract(url, '^[^?#]*?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS parts,
  list_sort(list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda c: c <> ''), lambda c: string_split(c, '=')[1]))) AS keys FROM pages),
t AS (SELECT page_id, CASE WHEN host = '' THEN '' ELSE scheme || '://' || host || '/' || coalesce(array_to_string(list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '^(\d+|[0-9a-fA-F]{8,}|[\w-]{8,}-\d+)$') THEN ':id' ELSE s END), '/'), '') ||
  CASE WHEN len(keys) > 0 THEN '?' || array_to_string(list_transform(keys, lambda k: k || '=:val'), '&') ELSE '' END END AS template FROM u)"""


@query(_TEMPLATE + " SELECT template, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY template")
def url_templates(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of URLs with ids and values left open."""
    return docs.dominant_share(table(spark, d, "pages").select(t.url_template(F.col("url")).alias("template")), "template")


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, starts_with(url, 'http') AS is_url FROM pages""")
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A query value, and URLs told from scalars."""
    return table(spark, d, "pages").select("page_id", t.query_value(F.col("url"), "page").alias("page"), F.startswith("url", F.lit("http")).alias("is_url"))


_HEADS = ["Avril 2026", "2026 december", "Août, 2025", "printemps 2026"]


@query(
    f"""WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS dmy, [{", ".join(f"'{h}'" for h in _HEADS)}][CAST(o_orderkey % 4 AS INTEGER) + 1] AS head, CAST(o_orderkey % 40 AS VARCHAR) AS day FROM orders)
SELECT o_orderkey, strftime(strptime(dmy, '%d/%m/%Y'), '%Y-%m-%d') AS iso,
       CASE WHEN CAST(day AS INTEGER) BETWEEN 1 AND 31 THEN CASE head WHEN 'Avril 2026' THEN '2026-04' WHEN '2026 december' THEN '2026-12' WHEN 'Août, 2025' THEN '2025-08' END || '-' || lpad(day, 2, '0') END AS calendar FROM x"""
)
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Dates to ISO text, and calendar cells with their heading."""
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy"), head.alias("head"), (F.col("o_orderkey") % 40).cast("string").alias("day"))
    return rows.select("o_orderkey", t.date_to_iso(F.col("dmy")).alias("iso"), t.calendar_day(F.col("head"), F.col("day")).alias("calendar"))


@query(r"SELECT page_id, substring(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug, md5(url) AS digest, sha1(url) AS sha FROM pages")
def slug_and_digest(spark: SparkSession, d: str) -> DataFrame:
    """File-name slugs and digests of URLs."""
    return table(spark, d, "pages").select("page_id", t.slug(F.col("url")).alias("slug"), F.md5("url").alias("digest"), F.sha1("url").alias("sha"))


@query("SELECT page_id, " + " OR ".join(f"contains(html, '{m}')" for m in t.SCRIPTED_MARKERS) + " AS scripted FROM pages")
def js_heavy(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a script fills in."""
    return table(spark, d, "pages").select("page_id", t.is_scripted_page(F.col("html")).alias("scripted"))


@query("SELECT page_id AS id, url AS href, 'pages' AS source_url FROM pages WHERE starts_with(url, 'http') AND url <> ''")
def link_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an http target, in the link layout."""
    return table(spark, d, "pages").where(F.startswith("url", F.lit("http"))).select(F.col("page_id").alias("id"), F.col("url").alias("href"), F.lit("pages").alias("source_url"))


@query("SELECT page_id, './?cs=4.' || page_id AS target, 'https://site.example/search?q=' || page_id AS search FROM pages")
def onclick_urls(spark: SparkSession, d: str) -> DataFrame:
    """Targets out of onclick scripts, and search URLs from values."""
    click = F.concat(F.lit("$.ajax({ type: 'GET', url : './?cs=4."), F.col("page_id"), F.lit("', async: true })"))
    return table(spark, d, "pages").select("page_id", t.onclick_url(click).alias("target"), F.concat(F.lit("https://site.example/search?q="), F.url_encode(F.col("page_id").cast("string"))).alias("search"))
