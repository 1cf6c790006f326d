"""Index requests: {mailbox, docs: [{id, author, timestamp, content, index}]} as rows to index."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.props import get_int, get_string, get_strings
from ..plans.errors import BadRequest, EngineError, NotFound
from .schemas import INPUT


def _text(x: object, default: str = "") -> str:
    return x if isinstance(x, str) else default


def _strings(x: object) -> list[str]:
    return [s for s in x if isinstance(s, str)] if isinstance(x, list) else []


def _row(mbox: str, doc: object, seq: int, now: int) -> tuple:
    if not isinstance(doc, dict):
        raise BadRequest("a document must be an object")
    if not isinstance(doc.get("id"), str):
        raise BadRequest("a document needs an id")
    stamp = doc.get("timestamp") if isinstance(doc.get("timestamp"), dict) else {}
    tsec = stamp.get("tsec")
    tsec = tsec if isinstance(tsec, int) and not isinstance(tsec, bool) else now
    if tsec < 0:
        raise BadRequest("times before 1970 are not supported")
    index = doc.get("index")
    if not isinstance(index, dict):
        raise BadRequest(f"document {doc['id']!r}: 'index' must be an object")
    c = doc.get("content") if isinstance(doc.get("content"), dict) else {}
    content = (_text(c.get("content")), _text(c.get("title")), _strings(c.get("links")), _strings(c.get("images")))
    return mbox, doc["id"], _text(doc.get("author")), tsec, content, {k: v for k, v in index.items() if isinstance(v, str)}, seq


def read_request(request: str | bytes | dict, now: int | None = None) -> tuple[list[tuple], EngineError | None]:
    """Rows of one request up to its first bad document, and what is wrong with that one. Earlier rows count."""
    if isinstance(request, (str, bytes)):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise BadRequest(f"not JSON: {e}") from e
    if not isinstance(request, dict) or not isinstance(request.get("mailbox"), str) or not isinstance(request.get("docs"), list):
        raise BadRequest("a request needs a 'mailbox' and an array 'docs'")
    if not request["docs"]:
        raise NotFound("'docs' is empty")
    rows: list[tuple] = []
    now = int(time.time()) if now is None else now
    for seq, doc in enumerate(request["docs"]):
        try:
            rows.append(_row(request["mailbox"], doc, seq, now))
        except EngineError as e:
            return rows, e
    return rows, None


def to_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), INPUT)


def from_json_text(frame: DataFrame, column: str) -> DataFrame:
    """Rows of a column of requests, which may be a stream; a missing time stays missing until the rows are indexed."""
    docs = F.try_variant_get(F.try_parse_json(F.col(column)), "$.docs", "array<variant>")
    each = frame.select(get_string(F.col(column), "mailbox", "\0").alias("mbox"), F.posexplode(docs).alias("pos", "doc"))
    each = each.where(F.col("mbox") != "\0").select("mbox", "pos", F.to_json("doc").alias("doc"))
    doc = F.col("doc")

    def member(name: str) -> Column:
        return F.coalesce(F.get_json_object(doc, f"$.{name}"), F.lit("{}"))

    content, entries = member("content"), F.try_variant_get(F.try_parse_json(doc), "$.index", "map<string,variant>")
    texts = F.map_filter(F.transform_values(entries, lambda _, v: F.to_json(v)), lambda _, v: v.startswith('"'))
    index = F.transform_values(texts, lambda _, v: F.from_json(F.concat(F.lit('{"x":'), v, F.lit("}")), "x string")["x"])
    rows = each.select(
        "mbox",
        get_string(doc, "id", "\0").alias("id"),
        get_string(doc, "author").alias("author"),
        get_int(member("timestamp"), "tsec", -1).alias("tsec"),
        F.struct(
            get_string(content, "content").alias("content"),
            get_string(content, "title").alias("title"),
            get_strings(content, "links").alias("links"),
            get_strings(content, "images").alias("images"),
        ).alias("content"),
        index.alias("index"),
        F.col("pos").cast("long").alias("seq"),
    )
    rows = rows.where((F.col("id") != "\0") & F.col("index").isNotNull())
    return rows.withColumn("tsec", F.when(F.col("tsec") >= 0, F.col("tsec")))
