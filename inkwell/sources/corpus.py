"""Tables of a data folder as rows to index: which column is the mailbox, the id, the time and the attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, page_links, page_title
from .schemas import CONTENT

#: 2024-01-01, the first day of the tables that have no time.
FIRST = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(content: Column, title: Column, links: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(content.alias("content"), title.alias("title"), (none if links is None else links).alias("links"), none.alias("images")).cast(CONTENT)


def _texts(**attrs: Column) -> Column:
    return F.create_map(*[x for name, text in attrs.items() for x in (F.lit(name), text)])


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the language is the mailbox; the title is the first line."""
    d = table(spark, sf_dir, "documents")
    text, day = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id") % 30
    title = F.substring_index(text, "\n", 1)
    source = F.coalesce(F.col("source"), F.lit(""))
    return d.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("mbox"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"),
        source.alias("author"),
        (F.lit(FIRST) + day * 86_400 + (F.col("doc_id") * 7_919) % 86_400).cast("long").alias("tsec"),
        _content(text, title).alias("content"),
        _texts(fulltext=text, title=title, author=source).alias("index"),
        F.col("doc_id").cast("long").alias("seq"),
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: the host is the mailbox."""
    p = table(spark, sf_dir, "pages")
    html = F.coalesce(F.col("html"), F.lit(""))
    return p.select(
        F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit("")).alias("mbox"),
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"),
        F.lit("").alias("author"),
        (F.lit(FIRST) + F.col("page_id") % 30 * 86_400).cast("long").alias("tsec"),
        _content(html, page_title(html), page_links(html)).alias("content"),
        _texts(fulltext=html_text(html), title=page_title(html)).alias("index"),
        F.col("page_id").cast("long").alias("seq"),
    )
