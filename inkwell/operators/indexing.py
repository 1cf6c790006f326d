"""Documents and postings of rows to index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import document_id, shard_number
from ..functions.text import tokens, words
from ..sources.files import dealt
from ..sources.schemas import CONTENT

#: Bytes of input for a task that gets arrays of tokens.
ARRAY_BYTES = 16 << 20
#: Bytes of stored postings for a task that gets postings: a million takes about 3 MB.
POSTING_BYTES = 4 << 20
#: The document columns besides batch.
_FIELDS = ("indexed_id", "id", "author", "is_comment", "tsec", "content", "seq", "shard")


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows that have a mailbox, an id and attributes, with indexed_id and shard; a missing time is now."""
    rows = rows.where(F.col("mbox").isNotNull() & F.col("id").isNotNull() & F.col("index").isNotNull())
    tsec = F.coalesce("tsec", F.unix_timestamp())
    # negative times would give ids above all others
    rows = rows.withColumn("tsec", tsec).where("tsec >= 0").withColumn("indexed_id", document_id(F.col("tsec"), F.col("id")))
    return rows.withColumn("shard", shard_number(F.col("indexed_id")))


def documents_of(rows: DataFrame) -> DataFrame:
    """Stored documents. A mailbox is not stored: one id in two mailboxes on one day is one document."""
    empty = F.from_json(F.lit('{"content":"","title":"","links":[],"images":[]}'), CONTENT)
    out = with_ids(rows).select("*", F.lit(False).alias("is_comment"))
    out = out.withColumn("author", F.coalesce("author", F.lit(""))).withColumn("content", F.coalesce("content", empty))
    return out.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id())).select(*_FIELDS)


def attribute_texts(rows: DataFrame) -> DataFrame:
    """mbox, indexed_id, attr, text: a row per attribute that has a text."""
    return with_ids(rows).select("mbox", "indexed_id", F.explode("index").alias("attr", "text")).where("text IS NOT NULL")


def token_positions(rows: DataFrame, short: int = 0, lowercase: bool = True) -> DataFrame:
    """mbox, attr, token, indexed_id, positions (ascending).

    All of a group comes from rows of one document, so these are brought together by their texts, and occurrences are
    grouped within an array: they are neither rows nor shuffled.
    """
    texts = dealt(attribute_texts(rows), ARRAY_BYTES, "indexed_id").groupBy("mbox", "attr", "indexed_id").agg(F.collect_list("text").alias("texts"))
    each = F.flatten(F.transform("texts", lambda x: tokens(x, short, lowercase)))
    return texts.select("mbox", "attr", "indexed_id", F.inline(_grouped(each))).select("mbox", "attr", "token", "indexed_id", "positions")


def _grouped(each: Column) -> Column:
    """(token, positions) of an array of (token, pos): it is sorted, and each run of a token is a slice."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))
        bound = F.array(F.struct(s["token"].alias("token"), s["pos"].alias("pos"), firsts.alias("firsts")))
        return F.transform(bound, cut)[0]

    def cut(b: Column) -> Column:
        def one(first: Column, k: Column) -> Column:
            end = F.coalesce(F.get(b["firsts"], k + 1), F.size(b["pos"]))
            return F.struct(F.get(b["token"], first).alias("token"), F.slice(b["pos"], first + 1, end - first).alias("positions"))

        return F.transform(b["firsts"], one)

    # bound to a variable first: a lambda would sort the array anew for each token; an empty one has no runs
    return F.flatten(F.transform(F.filter(F.array(F.sort_array(each)), lambda s: F.size(s) > 0), runs))


def postings_of(rows: DataFrame, short: int = 0, lowercase: bool = True) -> DataFrame:
    """mbox, attr, token, shard, indexed_id: each token once per row and attribute.

    Rows of one document that were indexed twice repeat postings; readers take them as sets and compaction drops them.
    The tokens of a row are shuffled as one array and become rows after that: dealing rows out in ranges reads its input
    twice, and so reads arrays twice instead of cutting the texts twice.
    """
    text = F.col("text")
    each = F.transform(tokens(text, short, lowercase), lambda t: t["token"]) if short > 0 else words(text, lowercase)
    arrays = attribute_texts(rows).select("mbox", "attr", "indexed_id", F.array_distinct(each).alias("tokens"))
    out = dealt(arrays, ARRAY_BYTES, "indexed_id").select("mbox", "attr", "indexed_id", F.explode("tokens").alias("token"))
    return out.select("mbox", "attr", "token", shard_number(F.col("indexed_id")).alias("shard"), "indexed_id")


def posting_lists(postings: DataFrame) -> DataFrame:
    """mbox, attr, token, shard, ids: the sorted set of ids of each token and day.

    A list per day, as an array, is bounded by the day's documents; a token's whole list stays rows.
    """
    return postings.groupBy("mbox", "attr", "token", "shard").agg(F.array_sort(F.collect_set("indexed_id")).alias("ids"))


def sorted_postings(postings: DataFrame, *order: str) -> DataFrame:
    """Postings once each, in the order of their columns. Rows go to their ranges at once; copies are dropped as neighbours
    after the sort, so no task holds a table of the rows that it has seen."""
    each = Window.partitionBy(*order).orderBy(*order)
    rows = dealt(postings.select(*order), POSTING_BYTES, *order, ranged=True)
    return rows.withColumn("nth", F.row_number().over(each)).where("nth = 1").select(*order)


def token_days(postings: DataFrame) -> DataFrame:
    """mbox, attr, token, shard, each once."""
    key = ("mbox", "attr", "token", "shard")
    return dealt(postings.select(*key), POSTING_BYTES, *key).distinct()


def token_shards(postings: DataFrame) -> DataFrame:
    """mbox, attr, token, shards: the sorted days that have the token."""
    days = token_days(postings)
    return days.groupBy("mbox", "attr", "token").agg(F.array_sort(F.collect_set("shard")).alias("shards"))


def document_ids(documents: DataFrame) -> DataFrame:
    """id, indexed_id: where each external id was written last."""
    return documents.groupBy("id").agg(F.max_by("indexed_id", F.struct("batch", "seq")).alias("indexed_id"))


def terms_per_document(rows: DataFrame, short: int = 0) -> DataFrame:
    """indexed_id, terms: how many attribute and token pairs each document has."""
    return postings_of(rows, short).select("indexed_id", "attr", "token").distinct().groupBy("indexed_id").agg(F.count("*").alias("terms"))
