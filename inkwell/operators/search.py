"""Search: all-of and none-of terms as one aggregation, late document lookup, phrases, ranges and paging.

Every term of a request, positive or negated, is a bit. One scan of the postings keeps the rows of the request's
terms (filters on mbox, attr, token and id reach the Parquet reader), and one aggregation by document combines the
bits: map-side first, so a document moves at most once per task. Bits are a set, so repeated postings do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_aux, id_hex, id_seconds, shard_number
from ..functions.text import has_phrase
from ..plans.request import Check, Phrase, SearchRequest, Term

#: Bits of a long that terms may take.
_WIDTH = 62
#: Term tables of many requests are broadcast up to this many rows.
BROADCAST_TERMS = 100_000
#: Up to this many words of many requests are a filter that reaches the Parquet reader.
FILTER_WORDS = 2_000


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def term_filter(terms: Iterable[Term]) -> Column:
    """Rows of any of the terms: a list of tokens per mailbox and attribute."""
    by: dict[tuple[str, str], list[str]] = {}
    for mbox, attr, token in terms:
        by.setdefault((mbox, attr), []).append(token)
    return _any((F.col("mbox") == m) & (F.col("attr") == a) & F.col("token").isin(sorted(set(ts))) for (m, a), ts in by.items())


def in_range(postings: DataFrame, lowest: int | None, highest: int | None) -> DataFrame:
    """Rows with ids of a range; bounds on the day follow from those on the id and prune by its statistics too."""
    if lowest is not None and lowest > 0:
        postings = postings.where((F.col("indexed_id") >= min(lowest, 2**63 - 1)) & (F.col("shard") >= min(lowest >> 32, 2**31 - 1)))
    if highest is not None:
        postings = postings.where((F.col("indexed_id") <= min(highest, 2**63 - 1)) & (F.col("shard") <= min(highest >> 32, 2**31 - 1)))
    return postings


def term_postings(postings: DataFrame, mbox: str, attr: str, token: str) -> DataFrame:
    """The posting list of one term, ascending by id."""
    return postings.where(term_filter([(mbox, attr, token)])).select("shard", "indexed_id").distinct().orderBy("indexed_id")


def common_shards(postings: DataFrame, terms: Iterable[Term]) -> DataFrame:
    """Days on which every term has a posting."""
    wanted = sorted(set(terms))
    rows = postings.where(term_filter(wanted)).select("shard", F.struct("mbox", "attr", "token").alias("term"))
    return rows.distinct().groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("shard")


def matching_ids(postings: DataFrame, request: SearchRequest) -> DataFrame:
    """indexed_id of the documents that have all positive terms and no negated one, within the range."""
    if not request.positive:
        return postings.sparkSession.createDataFrame([], "indexed_id long")
    every = sorted({*request.positive, *request.negative})
    rows = in_range(postings.where(term_filter(every)), request.lowest, request.end)
    words = range(0, len(every), _WIDTH)
    bits = [_bits(every[i : i + _WIDTH]).alias(f"b{i}") for i in words]
    found = rows.select("indexed_id", *bits).groupBy("indexed_id").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in words])
    for i in words:
        need, deny = (sum(1 << k for k, t in enumerate(every[i : i + _WIDTH]) if t in set(side)) for side in (request.positive, request.negative))
        found = found.where((F.col(f"b{i}").bitwiseAND(F.lit(need)) == need) & (F.col(f"b{i}").bitwiseAND(F.lit(deny)) == 0))
    return found.select("indexed_id")


def _bits(terms: list[Term]) -> Column:
    out = None
    for k, (m, a, t) in enumerate(terms):
        hit = (F.col("mbox") == m) & (F.col("attr") == a) & (F.col("token") == t)
        out = F.when(hit, F.lit(1 << k).cast("long")) if out is None else out.when(hit, F.lit(1 << k).cast("long"))
    return out.otherwise(F.lit(0).cast("long"))


def chained_ids(postings: DataFrame, request: SearchRequest) -> DataFrame:
    """The same ids by a chain of semi and anti joins; better where one term is rare and the others are very frequent."""
    def one(term: Term) -> DataFrame:
        return in_range(postings.where(term_filter([term])), request.lowest, request.end).select("indexed_id").distinct()

    if not request.positive:
        return postings.sparkSession.createDataFrame([], "indexed_id long")
    first, *rest = dict.fromkeys(request.positive)
    out = one(first)
    for t in rest:
        out = out.join(one(t), "indexed_id", "left_semi")
    for t in dict.fromkeys(request.negative):
        out = out.join(one(t), "indexed_id", "left_anti")
    return out


def matching_many(postings: DataFrame, requests: dict[str, SearchRequest]) -> DataFrame:
    """query_id, indexed_id for many requests in one scan of the postings; limits are not applied here."""
    spark = postings.sparkSession
    rows, needs = [], []
    for q, r in requests.items():
        if not r.positive:
            continue
        low, high = r.lowest or 0, 2**63 - 1 if r.end is None else r.end
        rows += [(q, *t, k, False, low, high) for k, t in enumerate(dict.fromkeys(r.positive))]
        rows += [(q, *t, -1, True, low, high) for t in dict.fromkeys(r.negative)]
        needs.append((q, len(set(r.positive))))
    terms = spark.createDataFrame(rows, "query_id string, mbox string, attr string, token string, k int, negated boolean, low long, high long")
    counts = spark.createDataFrame(needs, "query_id string, needed int")
    if len(rows) <= BROADCAST_TERMS:
        terms, counts = F.broadcast(terms), F.broadcast(counts)
    words = sorted({r[3] for r in rows})
    if len(words) <= FILTER_WORDS:
        postings = postings.where(F.col("token").isin(words))
    hits = postings.join(terms, ["mbox", "attr", "token"]).where("indexed_id BETWEEN low AND high")
    per = hits.groupBy("query_id", "indexed_id").agg(F.collect_set(F.when(~F.col("negated"), F.col("k"))).alias("had"), F.max("negated").alias("bad"))
    return per.where("NOT bad").join(counts, "query_id").where("size(had) = needed").select("query_id", "indexed_id")


_KEY = ["shard", "indexed_id", "id", "batch"]
#: Documents are looked up by a broadcast of keys up to this many.
BROADCAST_KEYS = 100_000
#: With a phrase or a check, so many of the lowest ids are tried for a page before all are.
SLICES = (512, 16_384)


def stored_keys(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """shard, indexed_id, id, batch of the last write of each document of the ids; ids without one are dropped. Reads no
    contents.

    The day is a join key beside the id, so that partitions without hits are pruned at run time; AQE broadcasts the
    ids where they are few.
    """
    keyed = ids.withColumn("shard", shard_number(F.col("indexed_id")))
    found = documents.select(_KEY).join(keyed, ["shard", "indexed_id"], "left_semi")
    return found.groupBy("shard", "indexed_id", "id").agg(F.max("batch").alias("batch"))


def with_documents(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """The stored documents of ids; `documents` holds all writes, of which only the last ones' contents are read."""
    return documents.join(stored_keys(ids, documents), _KEY, "left_semi")


def _of_keys(keys: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """The documents of at most `n` keys."""
    return documents.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, _KEY, "left_semi")


def phrase_filter(phrases: list[Phrase]) -> Column:
    """All phrases, each in the stored title or content by its attribute's name."""
    out = F.lit(True)
    for p in phrases:
        out = out & has_phrase(F.col("content.title" if p.in_title else "content.content"), list(p.words))
    return out


def search(postings: DataFrame, documents: DataFrame, request: SearchRequest, check: Check | None = None) -> DataFrame:
    """The documents that a request finds, ascending by id, at most its limit; with a check that says so, their relevance.

    Under a limit contents are read for the page only. Without phrases and check the lowest ids that have a document
    are the page. With them, the lowest ids are tried in slices that grow; only if these don't fill the page are all
    tried. The slices run while the plan is built: what the driver gets is the keys of a page.
    """
    ids = matching_ids(postings, request)
    if not request.limit:
        return _checked(with_documents(ids, documents), request, check).orderBy("indexed_id", "id")
    keys = stored_keys(ids, documents).orderBy("indexed_id", "id")
    if not request.phrases and check is None:
        return _of_keys(keys.limit(request.limit), documents, request.limit).orderBy("indexed_id", "id")
    local = partial(postings.sparkSession.createDataFrame, schema="shard long, indexed_id long, id string, batch long")
    for n in (*(s for s in SLICES if s > request.limit), None):
        lowest = keys.limit(n).collect() if n else []
        tried = _of_keys(local(lowest), documents, n) if n else documents.join(keys, _KEY, "left_semi")
        page = _checked(tried, request, check).select(_KEY).orderBy("indexed_id", "id").limit(request.limit).collect()
        if len(page) == request.limit or (n and len(lowest) < n):
            break
    return _checked(_of_keys(local(page), documents, request.limit), request, check).orderBy("indexed_id", "id")


def _checked(found: DataFrame, request: SearchRequest, check: Check | None) -> DataFrame:
    """Documents that hold the phrases and that the caller's check keeps."""
    if request.phrases:
        found = found.where(phrase_filter(request.phrases))
    if check is not None:
        says = check(found)
        keep, relevance = says if isinstance(says, tuple) else (says, None)
        if relevance is not None:
            found = found.withColumn("relevance", relevance.cast("float"))
        found = found.where(keep)
    return found


def reply(documents: DataFrame) -> DataFrame:
    """The columns that a client gets; without a check that sets it the relevance is 0."""
    i = F.col("indexed_id")
    relevance = F.col("relevance") if "relevance" in documents.columns else F.lit(0.0).cast("float")
    return documents.select(
        "id",
        id_hex(i).alias("indexed_id"),
        "author",
        "content",
        relevance.alias("relevance"),
        F.struct(id_seconds(i).alias("tsec"), id_aux(i).alias("tnsec")).alias("timestamp"),
    )


def page_state(page: DataFrame, limit: int | None) -> DataFrame:
    """completed, next_document_id of a page of found documents: one row.

    A full page is not completed, even if nothing is left. The next id is the page's last plus one, 0 if it is empty.
    """
    n, last = F.count("*"), F.max("indexed_id")
    full = n == limit if limit else F.lit(False)
    return page.agg((~full).alias("completed"), F.coalesce(last + 1, F.lit(0).cast("long")).alias("next_document_id"))


def dangling(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids that are posted but not stored."""
    return postings.select("indexed_id").distinct().join(documents.select("indexed_id"), "indexed_id", "left_anti")
