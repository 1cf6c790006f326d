"""Line dedup: line hashes are range-partitioned and sorted by (hash, document descending, position), so that the
document that keeps a line comes first and each partition is decided in one streaming pass. The result is a
compressed bitmap per document; texts never move through the sort.

Cases: a null or empty text is one empty line; rows with equal doc_id are one document when documents are counted
and keep or lose a line together; a null doc_id is one document, lower than all others; an empty table gives an
empty result. Columns beside doc_id and text are passed on by `drop_lines`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text, written

MIN_CHARS = 20
MIN_DOCS = 3
_WS = b" \t\n\x0b\x0c\r"
_NULL_DOC = -(2**63)
_LINES = "h1 long, h2 long, doc long, tk long, pos int"
_OUT = "kind int, h1 long, h2 long, doc long, tk long, pos int, n long"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(_WS).lower()


def _chars(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "surrogatepass"))


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, docs, tks, poss = [], [], [], []
            for doc, tk, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    k = line.strip(_WS).lower()
                    if len(k) >= min_chars and _chars(k) >= min_chars:
                        out.append(xxhash.xxh3_128_digest(k))
                        docs.append(doc)
                        tks.append(tk)
                        poss.append(i)
            h = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(tks, pa.int64()), pa.array(poss, pa.int32())], names=["h1", "h2", "doc", "tk", "pos"])

    return run


def _decide(min_docs: int):
    """One sorted partition. kind 0: a dropped line; 1: a line of a group that may go on in another partition; 2: how many documents of such a group are here, with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "tk", "pos"]
        group, first, n_docs, top, last, held, held_docs = None, True, 0, 0, None, [], 0
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", *names, "n"])

        for b in batches:
            for h1, h2, doc, tk, pos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h1, h2) != group:
                    if group is not None and first:
                        out.append((2, *group, top, 0, 0, n_docs))
                        first = False
                    group, n_docs, top, last, held = (h1, h2), 0, doc, None, []
                if doc != last:
                    n_docs, last = n_docs + 1, doc
                    if n_docs == min_docs and not first:
                        out.extend((0, *r, 0) for r in held if r[2] != top)
                        held = []
                row = (h1, h2, doc, tk, pos)
                if first:
                    out.append((1, *row, 0))
                elif n_docs < min_docs:
                    held.append(row)
                elif doc != top:
                    out.append((0, *row, 0))
            if len(out) > 50_000:
                yield flush()
        if group is not None:
            out.extend((1, *r, 0) for r in held)
            out.append((2, *group, top, 0, 0, n_docs))
        yield flush()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for p in b["positions"].to_pylist():
            bits = np.zeros(max(p) + 1, dtype=np.uint8)
            bits[p] = 1
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([b["doc"], b["tk"], pa.array(maps, pa.binary())], names=["doc", "tk", "dropped"])


def dropped_line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, tk (hash of the text) and the compressed bitmap of dropped lines, for documents that lose any.

    Lines whose key has at least `min_chars` code points and stands in at least `min_docs` documents stay in the
    largest doc_id only. A group of one hot line may span many partitions: only the summaries of the first and last
    group of each partition are joined back, at most two rows a partition.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), F.xxhash64(whole_text()).alias("tk"), whole_text().alias("text"))
    lines = written(rows.mapInArrow(_hashes(min_chars), _LINES), "lines")
    dealt = lines.repartitionByRange("h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "tk", "pos")
    decided = written(dealt.mapInArrow(_decide(min_docs), _OUT), "line-decisions")
    ends = decided.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    late = decided.where("kind = 1").join(F.broadcast(ends), ["h1", "h2"]).where("doc < top")
    gone = decided.where("kind = 0").select("doc", "tk", "pos").unionByName(late.select("doc", "tk", "pos"))
    lists = gone.groupBy("doc", "tk").agg(F.collect_set("pos").alias("positions"))
    return lists.mapInArrow(_bitmaps, "doc long, tk long, dropped binary")


def _apply(text: str, dropped: bytes | None) -> tuple[int, int, str]:
    lines = text.split("\n")
    if dropped is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), dtype=np.uint8), bitorder="little")
    gone = set(np.flatnonzero(bits).tolist())
    return len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _with_bitmaps(docs: DataFrame, kept: list, **params: int) -> DataFrame:
    maps = dropped_line_bitmaps(docs, **params)
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("__doc"), F.xxhash64(whole_text()).alias("__tk"), *kept)
    return rows.join(maps.withColumnsRenamed({"doc": "__doc", "tk": "__tk"}), ["__doc", "__tk"], "left")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t if t is None else _apply(t, d)[2] for t, d in zip(b["text"].to_pylist(), b["dropped"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string())], names=["row", "text"])


def drop_lines(docs: DataFrame, **params: int) -> DataFrame:
    """The documents without their dropped lines, with the columns of `docs`; a null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    joined = _with_bitmaps(docs, [row, F.col("text")], **params).select("row", "text", "dropped")
    schema = joined.select("row", "text").schema
    out = joined.mapInArrow(_texts, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [_apply(t, d) for t, d in zip(b["text"].to_pylist(), b["dropped"].to_pylist(), strict=True)]
        sha = [hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in done]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_report(docs: DataFrame, **params: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    joined = _with_bitmaps(docs, [F.col("doc_id"), whole_text().alias("text")], **params).select("doc_id", "text", "dropped")
    return joined.mapInArrow(_report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
