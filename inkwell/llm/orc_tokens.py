"""Token ids in ORC: range-partitioned by document, integer run-length encoding, row indexes, and Bloom filters on
the document id. Each row holds its shard and its start within the shard, so readers can take stripes in parallel
and add the shard's own start, a running sum over one row per shard.

Texts are encoded where they are read, slice by slice: what stands between two spaces is numbered by Arrow, encoded by the
library when a worker first meets it, many at a time, and remembered as long as there is room, also for later tasks. Only
compressed ids are shuffled.

Cases: a null text is empty and has the end id only; tokens that the file adds to its model have their own id; a null doc_id comes first; repeated rows are written once each,
side by side; rows of one doc_id are ordered by a hash of the text, and a doc_id with a large share of the rows is
spread over several shards in that order; an empty table gives an empty folder's schema and result; other columns are
not written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ODD_ARROW, START_ARROW, Cutter, Vocabulary, gather
from .common import shared_folder, ship, whole_text

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.compress": "ZSTD"}
_NULL_DOC = -(2**63)
#: Bytes that a Python worker may spend on what it remembers from one task to the next, about; and what an entry takes beside its text and ids.
_CACHE_BYTES, _ENTRY_BYTES = 60_000_000, 60
#: Longer pieces, in bytes, are cut into words by themselves and forgotten after their slice.
_CACHE_CHARS = 100
#: Bytes of a slice of texts, and pieces whose ids are put together at a time, about.
_SLICE_CHARS, _GATHERED = 12_000_000, 200_000
#: Put where texts are cut; texts that hold it are cut in Python.
_MARK = "\0"
_KNOWN: dict[str, Known] = {}
_ENCODED = "shard int, doc long, tk long, codes binary"


def shard_of(doc: np.ndarray, tk: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ascending by (doc, tk). A doc_id that equals several cuts is spread over their shards by tk."""
    low, high = np.searchsorted(cuts, doc, side="left"), np.searchsorted(cuts, doc, side="right")
    share = (tk.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


class Known:
    """The ids of pieces that a Python worker remembers, the bytes that they take, and the encoders of the file."""

    def __init__(self, vocabulary: Vocabulary, stamp: tuple):
        self.stamp, self.encode, self.encode_pieces = stamp, vocabulary.encoder(), vocabulary.piece_encoder()
        self.cutter = Cutter(vocabulary.pattern, vocabulary.added())
        self._forget()

    def __len__(self) -> int:
        return len(self.pieces)

    def __iter__(self) -> Iterator[str]:
        return iter(self.pieces.to_pylist())

    def _forget(self) -> None:
        self._hold(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u2"))

    def _hold(self, pieces: pa.Array, lens: np.ndarray, flat: np.ndarray) -> None:
        self.pieces, self.lens, self.flat = pieces, lens, flat
        self.size = (pc.sum(pc.binary_length(pieces)).as_py() or 0) + flat.nbytes + _ENTRY_BYTES * len(pieces)

    def _by_words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids, each distinct word encoded once."""
        cut = list(map(self.cutter.words, pieces.to_pylist()))
        words = list(set().union(*cut))
        ids = dict(zip(words, self.encode(words), strict=True))
        codes = [b"".join([ids[w] for w in own]) for own in cut]
        return np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 2, np.frombuffer(b"".join(codes), dtype="<u2")

    def look_up(self, own: pa.Array, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: starts and lengths in the flat array of ids. New ones are encoded and taken in; if all would
        take more than `room` bytes, only these pieces are kept, or none."""
        found = pc.fill_null(pc.index_in(own, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        short = pc.binary_length(own).to_numpy() <= _CACHE_CHARS
        new, long = np.flatnonzero((found < 0) & short), np.flatnonzero(~short)
        new_pieces = own.take(pa.array(new))
        new_lens, new_flat = (self.encode_pieces or self._by_words)(new_pieces)
        long_lens, long_flat = self._by_words(own.take(pa.array(long)))
        kept_lens, kept_flat = np.concatenate([self.lens, new_lens]), np.concatenate([self.flat, new_flat])
        lens, flat = np.concatenate([kept_lens, long_lens]), np.concatenate([kept_flat, long_flat])
        found[new] = len(self) + np.arange(len(new))
        found[long] = len(kept_lens) + np.arange(len(long))
        starts, lens = (np.cumsum(lens) - lens)[found], lens[found]
        self._hold(pa.concat_arrays([self.pieces, new_pieces]), kept_lens, kept_flat)
        if self.size > room:
            self._hold(own.take(pa.array(np.flatnonzero(short))), lens[short], gather(starts[short], lens[short], flat))
        if self.size > room:
            self._forget()
        return starts, lens, flat

    def codes(self, texts: pa.Array, room: int) -> Iterator[bytes]:
        """The ids of each text, packed."""
        apart = pc.match_substring(texts, _MARK)
        for token in self.cutter.added:
            apart = pc.or_(apart, pc.match_substring(texts, token))
        whole, odd = pc.if_else(apart, "", texts), pc.match_substring_regex(texts, ODD_ARROW)
        if pc.any(odd).as_py():
            plain, other = pc.if_else(odd, "", whole), pc.if_else(odd, whole, "")
            split = pc.split_pattern(pc.if_else(odd, pc.replace_substring_regex(other, START_ARROW, f"{_MARK}\\1"), pc.replace_substring(plain, " ", _MARK)), _MARK)
            del plain, other
        else:
            split = pc.split_pattern(whole, " ")
        at, pieces = split.offsets.to_numpy().astype(np.int64), split.values
        heads = list(map(self.cutter.find, pieces.take(pa.array(at[:-1])).to_pylist()))
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            head, rest = self.cutter.cut(texts[i].as_py())
            heads[i] = [*head, *(w for p in rest for w in self.cutter.words(p))]
        words = list(set().union(*heads))
        of_word = dict(zip(words, self.encode(words), strict=True))
        after = np.ones(len(pieces), dtype=bool)
        after[at[:-1]] = False
        pieces = pieces.filter(pa.array(after)).dictionary_encode()
        at -= np.arange(len(at))
        starts, lens, flat = self.look_up(pieces.dictionary, room)
        numbers = pieces.indices.to_numpy()
        del whole, split, pieces, after
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _GATHERED, side="right")) - 1)
            some = numbers[at[i] : at[j]]
            n = lens[some]
            ids = gather(starts[some], n, flat).tobytes()
            ends = (2 * np.concatenate([[0], np.cumsum(n)])[at[i : j + 1] - at[i]]).tolist()
            for head, a, b in zip(heads[i:j], ends, ends[1:], strict=False):
                yield b"".join([*map(of_word.__getitem__, head), ids[a:b]])
            i = j


def remembered(vocabulary: Vocabulary) -> Known:
    """What this worker remembers of the file, as long as it is the same. Tasks find this function by its name; what a
    task's own function refers to is sent to it anew each time."""
    stat = os.stat(vocabulary.file)
    stamp = stat.st_mtime_ns, stat.st_size, vocabulary.library, vocabulary.pattern
    if vocabulary.file not in _KNOWN or _KNOWN[vocabulary.file].stamp != stamp:
        _KNOWN[vocabulary.file] = Known(vocabulary, stamp)
    return _KNOWN[vocabulary.file]


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about _SLICE_CHARS bytes of text, at least one row each."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _SLICE_CHARS)) + 1
        yield batch.slice(i, j - i)
        i = j


def _encode(vocabulary: Vocabulary, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for part in text_slices(b):
                doc, tk = (part[c].to_numpy() for c in ("doc", "tk"))
                out = list(map(squeeze, remembered(vocabulary).codes(part["text"].cast(pa.string()), _CACHE_BYTES)))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(doc, tk, cuts).astype(np.int32)), pa.array(doc), pa.array(tk), pa.array(out, pa.binary())], names=["shard", "doc", "tk", "codes"])
                pa.default_memory_pool().release_unused()

    return run


def _rows(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        expand = zstandard.ZstdDecompressor().decompress
        docs, starts, lens, flat = [], [], [], []

        def flush():
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
            out = pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int32()), pa.array(starts, pa.int64()), pa.array(lens, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )
            for x in (docs, starts, lens, flat):
                x.clear()
            return out

        held = 0
        for b in batches:
            for doc, packed in zip(b["doc"].to_pylist(), b["codes"].to_pylist(), strict=True):
                codes = np.frombuffer(expand(packed), dtype="<u2")
                docs.append(None if doc == _NULL_DOC else doc)
                starts.append(start)
                lens.append(len(codes) + 1)
                flat += [codes, np.array([end_id], dtype=np.uint16)]
                start += len(codes) + 1
                held += len(codes) + 1
                if held > 1_000_000:
                    held = 0
                    yield flush()
        yield flush()

    return run


def write_tokens(docs: DataFrame, vocabulary: Vocabulary, path: str, shards: int | None = None) -> None:
    """Encode all documents and write them to `path` in ascending order of doc_id, a file per shard.

    Shard bounds are quantiles of doc_id, so neither texts nor ids are read twice to deal them out.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC)).alias("doc"), F.xxhash64(whole_text()).alias("tk"), whole_text().alias("text"))
    cuts = rows.agg(F.percentile_approx("doc", [i / shards for i in range(1, shards)] or [0.5], 100 * shards)).first()[0] or []
    cuts = np.array(sorted(cuts), dtype=np.int64)
    coded = rows.mapInArrow(_encode(vocabulary, cuts), _ENCODED)
    dealt = coded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("doc", "tk")
    dealt.select("doc", "codes").mapInArrow(_rows(vocabulary.end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a written folder; filters on doc_id use its row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b["ids"]
        data = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        crcs = [zlib.crc32(data[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def orc_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files that were written to the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, path)
    return read_tokens(spark, path).mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
