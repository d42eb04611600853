"""Cleaning: quality measures, personal data and repeated lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PATTERNS, tokens, with_array


def quality_measures(documents: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = with_array(with_array(documents.select("doc_id", "text"), "w", tokens("text")), "lines", lines)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_tokens"),
        F.round(F.length(F.array_join("w", "")) / F.nullif(F.size("w"), F.lit(0)), 6).alias("mean_token_length"),
        F.round(1 - letters / F.nullif(F.length("text"), F.lit(0)), 6).alias("non_letter_share"),
        F.round(1 - F.size(F.array_distinct("lines")) / F.nullif(F.size("lines"), F.lit(0)), 6).alias("repeated_line_share"),
    )


def find_pii(documents: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("bigint").alias("n")) for k, p in patterns.items()])
    return documents.select("doc_id", F.inline(counts)).where("n > 0")


def mask_pii(documents: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    text = F.col("text")
    for kind, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return documents.select("doc_id", text.alias("text"))


def repeated_lines(documents: DataFrame, min_docs: int = 2) -> DataFrame:
    lines = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """The texts without those lines, in order. A document of such lines alone keeps an empty text."""
    each = documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    left = each.join(lines.select("line"), "line", "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    texts = left.select("doc_id", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
    return documents.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
