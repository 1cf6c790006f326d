"""Looking into tables: lists, checks, index descriptions, merges and compaction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_hex, id_time, index_base, index_key
from ..sources.files import dealt
from ..sources.store import IDENTITY
from .indexing import POSTING_BYTES
from .ordered import boundaries, greedy_chunks, with_previous, with_running
from .search import with_documents

#: Days above this are reported as implausible; days of this century are.
LARGEST_SHARD = 10_000


def document_bytes() -> Column:
    """Bytes of a stored document's texts."""
    parts = [F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "author", "content.content", "content.title")]
    for c in ("content.links", "content.images"):
        parts.append(F.octet_length(F.coalesce(F.array_join(c, ""), F.lit(""))))
    return reduce(lambda a, b: a + b, parts).cast("long")


def document_keys(documents: DataFrame) -> DataFrame:
    """key, shard, bytes of each stored document, and seq and id, which order documents that share a key."""
    return documents.select(id_hex(F.col("indexed_id")).alias("key"), "shard", document_bytes().alias("bytes"), "seq", "id")


def _order(keys: DataFrame) -> list[str]:
    return [c for c in ("key", "seq", "id") if c in keys.columns]


def posting_keys(postings: DataFrame) -> DataFrame:
    """key, shard, bytes of each posting list: a key per token and day, 8 bytes for each id."""
    lists = postings.groupBy("shard", "mbox", "attr", "token").agg(F.countDistinct("indexed_id").alias("n"))
    return lists.select(index_key(F.col("shard"), F.col("mbox"), F.col("attr"), F.col("token")).alias("key"), "shard", (F.col("n") * 8).alias("bytes"))


def list_running(keys: DataFrame) -> DataFrame:
    """key, bytes, number, running_bytes in key order. Documents that share a key are numbered as they were written and
    have the running bytes of all of them."""
    rows = with_running(keys.select(*_order(keys), "bytes"), ["key"], "number", {"running_bytes": "bytes"}, _order(keys)[1:])
    return rows.select("key", "bytes", "number", "running_bytes")


def list_totals(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def key_bounds(keys: DataFrame) -> DataFrame:
    return keys.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def shard_documents(documents: DataFrame) -> DataFrame:
    return documents.groupBy("shard").agg(F.count("*").alias("n_docs"))


def out_of_order(keys: DataFrame) -> DataFrame:
    """Keys whose shard is below that of the key before; none in a sound table."""
    return with_previous(keys.select("key", "shard"), ["key"], "shard", "previous").where("previous > shard")


def shard_boundaries(keys: DataFrame) -> DataFrame:
    """First keys of each shard but the first, in key order."""
    rows = with_previous(keys.select("key", "shard"), ["key"], "shard", "previous")
    return rows.where(boundaries("shard", "previous"))


def large_shards(keys: DataFrame, largest: int = LARGEST_SHARD) -> DataFrame:
    return keys.where(F.col("shard") > largest).select("key", "shard")


def check_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """What the check tool reports."""
    keys = document_keys(documents)
    return {"documents": shard_documents(documents), "out_of_order": out_of_order(keys), "boundaries": shard_boundaries(keys), "large": large_shards(keys)}


def one_index(postings: DataFrame, mbox: str, attr: str, token: str) -> DataFrame:
    return postings.where((F.col("mbox") == mbox) & (F.col("attr") == attr) & (F.col("token") == token))


def index_shard_counts(postings: DataFrame, mbox: str, attr: str, token: str) -> DataFrame:
    """shard, n_ids of one token."""
    return one_index(postings, mbox, attr, token).groupBy("shard").agg(F.countDistinct("indexed_id").alias("n_ids"))


def index_merged(postings: DataFrame, mbox: str, attr: str, token: str) -> DataFrame:
    """name, n_shards, n_ids of one token."""
    totals = one_index(postings, mbox, attr, token).agg(F.countDistinct("shard").alias("n_shards"), F.countDistinct("indexed_id").alias("n_ids"))
    return totals.select(index_base(F.lit(mbox), F.lit(attr), F.lit(token)).alias("name"), "n_shards", "n_ids")


def index_dump(postings: DataFrame, documents: DataFrame, mbox: str, attr: str, token: str) -> DataFrame:
    """key, time, id, author, title of the documents of one token; `documents` holds all writes."""
    found = with_documents(one_index(postings, mbox, attr, token).select("indexed_id").distinct(), documents)
    i = F.col("indexed_id")
    return found.select(id_hex(i).alias("key"), id_time(i).alias("time"), "id", "author", F.col("content.title").alias("title"))


def save_index(postings: DataFrame, mbox: str, attr: str, token: str, folder: str, separator: str | None = None) -> None:
    """One token's index: its shards with their counts, its ids by shard (a directory each), and the merged list in order.

    Parquet, or with a separator text with the fields of a row joined by it.
    """
    ids = one_index(postings, mbox, attr, token).select("shard", "indexed_id").distinct()
    parts = {"shards": index_shard_counts(postings, mbox, attr, token).orderBy("shard"), "merged": ids.orderBy("indexed_id")}
    for name, rows in parts.items():
        if separator is None:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        else:
            rows.select(joined_fields(rows, separator).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    by_shard = ids.sortWithinPartitions("shard", "indexed_id")
    if separator is None:
        by_shard.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/ids")
    else:
        by_shard.select(F.col("indexed_id").cast("string").alias("value"), "shard").write.mode("overwrite").partitionBy("shard").text(f"{folder}/ids")


def joined_fields(rows: DataFrame, separator: str, formats: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The fields of a row as one text: each by its formatter, or as text, null as nothing, with a separator between."""
    formats = formats or {}
    each = [formats[c](F.col(f"`{c}`")) if c in formats else F.col(f"`{c}`").cast("string") for c in rows.columns]
    return F.array_join(F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in each]), separator)


def rates(spark: SparkSession, steps: list[tuple[str, int, int, float]]) -> DataFrame:
    """step, n_keys, bytes, seconds, and keys and megabytes a second, of steps with their seconds."""
    out = [(s, n, b, t, n / t if t else 0.0, b / t / 1e6 if t else 0.0) for s, n, b, t in steps]
    return spark.createDataFrame(out, "step string, n_keys long, bytes long, seconds double, keys_per_second double, mb_per_second double")


def _numbered(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn("__input", F.lit(n)) for n, t in enumerate(tables)])


def merge_postings(tables: list[DataFrame]) -> DataFrame:
    """The union of posting tables as sets.

    Rows are dealt out by token and day, of which they hold neighbours, so that they shuffle small, and are compared there
    only: before the shuffle few rows are copies of each other.
    """
    if not tables:
        raise ValueError("nothing to merge")
    every = reduce(lambda a, b: a.unionByName(b), tables)
    return dealt(every, POSTING_BYTES, "mbox", "attr", "token", "shard").distinct()


def merge_documents(tables: list[DataFrame], key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Rows by key; where several inputs have a key, the last input's."""
    if not tables:
        raise ValueError("nothing to merge")
    every = _numbered(tables)
    kept = [c for c in tables[0].columns if c not in key]
    # within one input the last write counts, where it says which that is
    order = F.struct("__input", *[c for c in ("batch", "seq") if c in kept])
    last = every.groupBy(*key).agg(F.max_by(F.struct(*kept), order).alias("row"))
    return last.select(*key, "row.*").select(*tables[0].columns)


def compact_chunks(keys: DataFrame, limit: int) -> DataFrame:
    """chunk, first_key, last_key, n_keys, bytes: ranges of keys of about `limit` bytes that can be rewritten one by one."""
    rows = greedy_chunks(keys.select(*_order(keys), "bytes"), _order(keys), "bytes", limit)
    return rows.groupBy("chunk").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_keys"), F.sum("bytes").alias("bytes"))
