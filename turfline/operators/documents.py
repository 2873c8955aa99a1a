"""Language, links and templates of stored documents, in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html_rows

#: Function words by which a text's language is told; a parameter.
STOPWORDS = {
    "fr": "le la les de des du et est une un que qui dans pour pas sur avec ce il elle au aux en par plus ou".split(),
    "en": "the of and to in is that it for was on are with as be at by this from or have an not which".split(),
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem des sich auch als an es bei".split(),
    "es": "el la los las de y que en un una por con no para es se del al lo como más su pero".split(),
}


def stopword_scores(docs: DataFrame, text: str = "text", sample: int | None = None) -> DataFrame:
    """Adds n_words and score_<lang> over the whole text, or over its first `sample` characters as the reference does."""
    read = F.lower(text) if sample is None else F.substring(F.lower(text), 1, sample)
    words = F.regexp_extract_all(read, F.lit(r"([\p{L}]+)"), 1)
    docs = docs.withColumn("_words", words).withColumn("n_words", F.size("_words"))

    def hits(stop: list[str]) -> Column:
        return F.size(F.filter("_words", lambda w: w.isin(*stop)))

    return docs.withColumns({f"score_{lang}": hits(stop) for lang, stop in STOPWORDS.items()}).drop("_words")


def detected_language(least_words: int = 15, least_hits: int = 5, lead: int = 2) -> Column:
    """The best-scoring language of stopword_scores, "" if the text is short or the lead small."""
    scores = F.array_sort(F.array(*[F.struct((-F.col(f"score_{x}")).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(STOPWORDS)]))
    best, second = scores[0], scores[1]
    clear = (F.col("n_words") >= least_words) & (-best["s"] >= least_hits) & (second["s"] - best["s"] >= lead)
    return F.when(clear, best["lang"]).otherwise("")


def page_language(html: str) -> Column:
    """The html element's lang, else a content-language, language or og:locale meta, attributes in any order; "" without."""
    meta = r"""(?is)<meta(?=[^>]*\b%s\s*=\s*["']?%s["'\s/>])[^>]*\bcontent\s*=\s*["']?([a-zA-Z_-]+)"""
    forms = [
        r"""(?is)<html[^>]*\blang\s*=\s*["']?([a-zA-Z_-]+)""",
        meta % ("http-equiv", "content-language"),
        meta % ("name", "language"),
        meta % ("property", "og:locale"),
    ]
    return F.coalesce(*[F.nullif(F.regexp_extract(html, f, 1), F.lit("")) for f in forms], F.lit(""))


def language_of_text(pages: DataFrame, where: Column, html: str = "html") -> DataFrame:
    """Adds text_language, told by the stopwords of a page's whole text where `where` holds, else ""."""
    read = pages.withColumn("_text", html_rows.visible_text()(F.when(where, F.col(html))))
    scores = [f"score_{lang}" for lang in STOPWORDS]
    return stopword_scores(read, "_text").withColumn("text_language", detected_language()).drop("_text", "n_words", *scores)


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position, href, text of the anchors with a target other than "#"."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)(<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>)"""), 1)
    rows = pages.select(key, F.posexplode(found).alias("position", "_a"))
    href = F.regexp_extract("_a", r"""(?is)\bhref\s*=\s*"([^"]*)\"""", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("_a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "position", href.alias("href"), text.alias("text")).where("href NOT IN ('', '#')")


def dominant_share(rows: DataFrame, template: str) -> DataFrame:
    """template, n, share of all, and whether it is the largest cluster."""
    clusters = rows.groupBy(F.col(template).alias("template")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))  # one row
    out = clusters.join(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_total"), 6)).drop("_total")
    return out


def structure_similarity(rows: DataFrame, group: str, fingerprint: str) -> DataFrame:
    """group, pages, clusters, similarity, dominant, dominant_pages: 1 - clusters / pages over all pages of a group, and its largest cluster, the smallest digest on ties."""
    clusters = rows.groupBy(group, F.col(fingerprint).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    of_group = clusters.groupBy(group).agg(F.sum("_n").alias("pages"), F.count(F.lit(1)).alias("clusters"), F.max("_n").alias("dominant_pages"), F.min_by("_f", F.struct(-F.col("_n"), "_f")).alias("dominant"))
    return of_group.select(group, "pages", "clusters", F.round(1 - F.col("clusters") / F.col("pages"), 3).alias("similarity"), "dominant", "dominant_pages")
