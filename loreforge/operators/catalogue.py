"""Ingest and catalogue: pages, links, counts and metadata search."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->"
BLANKS = r"[ \t\n\x0B\f\r]+"


def canonical_pages(pages: DataFrame) -> DataFrame:
    """One page per canonical URL, the one with the smallest id. Without scheme, query, fragment, www./m. and last slash."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^(www|m)\.", "")
    key = F.regexp_replace(F.concat(host, F.regexp_replace(bare, r"^[^/]*", "")), r"/$", "")
    return pages.groupBy(key.alias("key")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n_pages"))


def page_text(pages: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", BLOCKS, " "), r"<[^>]*>", " "), BLANKS, " ")
    return pages.select("page_id", F.trim(text).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def catalogue(documents: DataFrame) -> DataFrame:
    """Counts by language and source with all subtotals. level: bit 2 if over all languages, bit 1 if over all sources."""
    return documents.cube("lang", "source").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def find_docs(documents: DataFrame, lang: str, source: str, min_chars: int, k: int) -> DataFrame:
    found = documents.where((F.col("lang") == lang) & (F.col("source") == source) & (F.col("n_chars") >= min_chars))
    return found.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(k)


def length_stats(documents: DataFrame, ps=(0.25, 0.5, 0.9)) -> DataFrame:
    return documents.groupBy("lang").agg(*[F.percentile("n_chars", p).alias(f"p{round(100 * p)}") for p in ps], F.count(F.lit(1)).alias("n_docs"))
