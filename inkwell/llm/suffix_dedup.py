"""Suffix-array dedup: removes every byte that a LENGTH-byte string covers which also starts anywhere else.

One suffix array of the whole corpus would need several bytes of shuffle for each byte of text. Here the shards of
the array are cut by content, so that equal strings always meet in one shard and unique text never moves:

1. Each LENGTH-byte window has an anchor, the leftmost smallest hash among its GRAM-byte substrings. Windows with the
   same anchor are consecutive and form a block. Equal windows have equal anchors at equal offsets.
2. Blocks are sorted by (anchor hash, block hash). One whose anchor occurs nowhere else is unique. Every other block
   goes to a shard: once if it is the only one of its kind, else its first two rows do. Further rows of a block, which
   are the same bytes by 128 bits of hashes, take the result of those two, so a hot block costs no more than a rare one.
3. The bytes of those blocks are gathered by anchor into shards; induced sorting and permuted common prefixes of a
   shard tell which of their windows repeat.
An anchor with more than HOT distinct blocks is split: its windows are halved by their offset to the anchor, and each half
gets the bytes that all of its windows share as its key, until groups are small or are single windows.

Cases: null and empty texts and texts under LENGTH bytes lose nothing; strings never span documents; repeated rows
are documents of their own (each repeats the other); a null doc_id is allowed; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text, written
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 64
HOT = 4096
SHARD_BYTES = 1_500_000
#: Bytes of text in which blocks are looked for at once: some ten 64-bit arrays of that length are alive.
_PART = 500_000
_NULL_DOC = -(2**63)
_BASE = 0x9E3779B97F4A7C15 | 1
_POS = 24
_KEYS = "g long, b long, doc long, tk long, lo int, m int, off int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


class Anchors:
    """Finds blocks in runs of bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def hashes(self, t: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each gram."""
        if len(self.up) < len(t):
            self.up, self.down = _powers(len(t))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(t) + 1, dtype=np.uint64)
            own = sums[1:]
            np.add(t, np.uint64(1), out=own, casting="unsafe")
            own *= self.up[: len(t)]
            np.cumsum(own, out=own)
            h = sums[self.gram :] - sums[: -self.gram]
            h *= self.down[: len(h)]
            for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
                h ^= h >> np.uint64(shift)
                h *= np.uint64(factor)
            h ^= h >> np.uint64(32)
        return h

    def blocks(self, t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lo, m, anchor, hash) of the blocks of the texts t[start:end]: windows lo to lo + m - 1 have that anchor."""
        ok = ends - starts >= self.length
        starts, ends = starts[ok], ends[ok]
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        h = self.hashes(t)
        mask = np.uint64((1 << _POS) - 1)
        n, w = len(h), self.window
        x = np.full(n + -n % w, np.uint64(2**64 - 1))
        np.bitwise_and(h, ~mask, out=x[:n])
        x[:n] |= np.arange(n, dtype=np.uint64)
        x = x.reshape(-1, w)
        left = np.minimum.accumulate(x, axis=1).ravel()
        right = x[:, ::-1]
        np.minimum.accumulate(right, axis=1, out=right)
        low = np.minimum(x.ravel()[: n - w + 1], left[w - 1 : n])
        del x, left, right
        low &= mask
        anchor = low.view(np.int64)
        change = np.zeros(len(low) + 1, dtype=np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, ends - self.length + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        other = anchor[1:] != anchor[:-1]
        first = valid & np.concatenate([[True], other | ~valid[:-1]])
        last = valid & np.concatenate([other | ~valid[1:], [True]])
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        return lo, hi - lo + 1, anchor[lo], h[anchor[lo]]


def _blocks(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        digest = xxhash.xxh3_64_intdigest

        def out(parts: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
            data = b"".join(p[0] for p in parts)
            ends = np.cumsum([len(p[0]) for p in parts])
            starts = ends - [len(p[0]) for p in parts]
            lo, m, anchor, h = find.blocks(np.frombuffer(data, np.uint8), starts, ends)
            of = np.searchsorted(ends, lo, side="right")
            b = np.fromiter((digest(data[i:j]) for i, j in zip(lo.tolist(), (lo + m + length - 1).tolist(), strict=True)), dtype=np.uint64, count=len(lo))
            doc, tk, base = (np.array([p[k] for p in parts], dtype=np.int64) for k in (1, 2, 3))
            cols = [h.view(np.int64), b.view(np.int64), doc[of], tk[of], (lo - starts[of] + base[of]).astype(np.int32), m.astype(np.int32), (anchor - lo).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "b", "doc", "tk", "lo", "m", "off"])

        parts, size = [], 0
        for batch in batches:
            for doc, tk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for i in range(0, max(len(raw) - length + 1, 0), _PART):
                    part = raw[i : i + _PART + length - 1]
                    if parts and size + len(part) > _PART:
                        yield out(parts)
                        parts, size = [], 0
                    parts.append((part, doc, tk, i))
                    size += len(part)
        if parts:
            yield out(parts)

    return run


#: What becomes of a row: its block's first two rows are in a shard; it is in a shard; so, and it stands for rows that are
#: equal to it in all columns; not known in its partition alone; it tells what a partition holds.
_COPY, _IN, _TWICE, _ALONE, _EDGE = 0, 1, 2, 3, 9
_UNKNOWN = -1


class _Runs:
    """Rows of one or more anchors, sorted by all columns: how often each block and how many blocks an anchor has."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        g, b, *rest = (batch[c].to_numpy(zero_copy_only=False) for c in ("g", "b", "doc", "tk", "lo"))
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_b = new_g | np.concatenate([[True], b[1:] != b[:-1]])
        new = new_b.copy()
        for c in rest:
            new[1:] |= c[1:] != c[:-1]
        self.b = b
        self.starts = np.flatnonzero(new_b)
        self.n = np.diff(self.starts, append=len(g))
        self.group = np.cumsum(new_g[self.starts]) - 1
        #: Different rows, and by row: the run that holds it, and its place among the different rows of the run.
        self.distinct = np.flatnonzero(new)
        self.run = (np.cumsum(new_b) - 1)[self.distinct]
        rank = np.arange(len(self.distinct))
        self.rank = rank - rank[np.searchsorted(self.run, np.arange(len(self.n)))][self.run]
        self.only = np.bincount(self.run)[self.run] == 1

    def rows(self, kind: int, chosen: np.ndarray, blocks: np.ndarray | int) -> pa.RecordBatch:
        taken = self.batch.take(pa.array(self.distinct[chosen]))
        n = taken.num_rows
        blocks = blocks[self.run[chosen]] if isinstance(blocks, np.ndarray) else np.full(n, blocks)
        extra = [pa.array(np.full(n, kind, np.int32)), pa.array(blocks.astype(np.int64)), pa.nulls(n, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*taken.columns, *extra], names=[*taken.schema.names, "kind", "blocks", "edge"])

    def _repeated(self, blocks: np.ndarray | int) -> Iterator[pa.RecordBatch]:
        again = self.n[self.run] > 1
        yield self.rows(_COPY, again & (self.rank > 1), 2)
        yield self.rows(_IN, again & (self.rank < 2) & ~self.only, blocks)
        yield self.rows(_TWICE, again & self.only, blocks)

    def within(self) -> Iterator[pa.RecordBatch]:
        """Rows of anchors that stand in this partition only."""
        blocks = np.bincount(self.group)[self.group]
        yield from self._repeated(blocks)
        yield self.rows(_IN, ((self.n == 1) & (blocks > 1))[self.run], blocks)

    def at_edge(self, opens: bool, closes: bool, partition: int) -> Iterator[pa.RecordBatch]:
        """Rows of one anchor that may go on in other partitions. All but the first and the last block are whole here."""
        yield from self._repeated(_UNKNOWN)
        yield self.rows(_ALONE, (self.n == 1)[self.run], _UNKNOWN)
        told = self.rows(_EDGE, np.arange(len(self.distinct)) == 0, _UNKNOWN)
        edge = [partition, len(self.n), int(self.b[0]), int(self.b[-1]), int(opens), int(closes)]
        yield told.set_column(told.schema.get_field_index("edge"), "edge", pa.array([edge], pa.list_(pa.int64())))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g, b, doc, tk and lo, with their kind. Where the anchor may go on in another partition `blocks` is
    unknown, and a row of kind _EDGE says what is here."""
    held: list[pa.RecordBatch] = []
    first = None
    partition = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch["g"].to_numpy(zero_copy_only=False)
        first = g[0] if first is None else first
        change = np.flatnonzero(g[1:] != g[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if held and held[0]["g"][0].as_py() != g[0] or cut:
            whole = pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]).combine_chunks().to_batches()[0]
            wg = whole["g"].to_numpy(zero_copy_only=False)
            k = int(np.searchsorted(wg != first, True)) if wg[0] == first else 0
            if k:
                yield from _Runs(whole.slice(0, k)).at_edge(True, False, partition)
            if k < len(wg):
                yield from _Runs(whole.slice(k)).within()
            held = []
        held.append(batch.slice(cut))
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield from _Runs(whole).at_edge(whole["g"][0].as_py() == first, True, partition)


def edge_groups(edges: list[list[int]]) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """From rows (g, what a partition says): how many blocks an anchor has, and the blocks that go over a partition's bound."""
    groups: dict[int, int] = {}
    again: set[tuple[int, int]] = set()
    by: dict[int, list[list[int]]] = {}
    for g, *edge in edges:
        by.setdefault(g, []).append(edge)
    for g, parts in by.items():
        blocks, last = 0, None
        for _, n, b0, b1, _, _ in sorted(parts):
            blocks += n - (last == b0)
            if last == b0:
                again.add((g, b0))
            last = b1
        groups[g] = blocks
    return groups, again


def _resolve(groups: dict[int, int], again: set[tuple[int, int]]):
    """Rows with unknown `blocks`, decided by what all partitions say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, kinds, counts = [], [], []
            for i, (g, b, kind) in enumerate(zip(*(batch[c].to_pylist() for c in ("g", "b", "kind")), strict=True)):
                if kind != _ALONE or groups[g] > 1 or (g, b) in again:
                    keep.append(i)
                    kinds.append(_IN if kind == _ALONE else kind)
                    counts.append(groups[g])
            taken = batch.take(pa.array(keep, pa.int64()))
            taken = taken.set_column(taken.schema.get_field_index("kind"), "kind", pa.array(kinds, pa.int32()))
            yield taken.set_column(taken.schema.get_field_index("blocks"), "blocks", pa.array(counts, pa.int64()))

    return run


def _kinds(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (written, with g, b, doc, tk and lo) of the kinds _COPY, _IN and _TWICE, with kind and the number of blocks of
    their anchor; rows that are equal come once.

    Rows are dealt out in ranges of their columns, so one hot block or anchor spans many partitions. What the driver joins is
    at most two rows of a partition; a block may stand in a shard twice for each partition that holds it.
    """
    keys = ["g", "b", "doc", "tk", "lo"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = rows.select("*", F.lit(0).cast("int").alias("kind"), F.lit(0).cast("long").alias("blocks"), F.lit(None).cast("array<long>").alias("edge")).schema
    decided = written(dealt.mapInArrow(_decide, schema), name)
    edges = [[r.g, *r.edge] for r in decided.where(F.col("kind") == _EDGE).select("g", "edge").collect()]
    late = decided.where((F.col("blocks") == _UNKNOWN) & (F.col("kind") != _EDGE)).mapInArrow(_resolve(*edge_groups(edges)), schema)
    return decided.where(F.col("blocks") != _UNKNOWN).unionByName(late).drop("edge")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=1)
    for b in batches:
        z = [c.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc"], b["tk"], pa.array(z, pa.binary())], names=["doc", "tk", "z"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), F.xxhash64(whole_text()).alias("tk"), whole_text().alias("text"))


_BODIES = "kind int, g long, doc long, tk long, lo int, m int, off int, body binary"


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        names = ["kind", "g", "doc", "tk", "lo", "m", "off", "body"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            out.clear()
            return batch

        last = None
        for b in batches:
            for doc, tk, z, wanted in zip(*(b[c].to_pylist() for c in ("doc", "tk", "z", "wanted")), strict=True):
                if (doc, tk) == last:
                    continue  # an equal row: its blocks are there
                last, raw = (doc, tk), d.decompress(z)
                for i in range(0, len(wanted), 10_000):
                    out.extend((w["kind"], w["g"], doc, tk, w["lo"], w["m"], w["off"], raw[w["lo"] : w["lo"] + w["m"] + length - 1]) for w in wanted[i : i + 10_000])
                    if len(out) >= 10_000:
                        yield flush()
        yield flush()

    return run


def _found(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions of the joined blocks of a shard are windows that start elsewhere in it too, and the blocks' starts."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    s = np.frombuffer(b"\0".join(bodies) + b"\0\0", np.uint8)
    if int(s.max()) > 253:
        s = s.astype(np.uint16)
    s = s + s.dtype.type(2)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    s[ends] = 1
    s[-1] = 0
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)
    windows = np.maximum(sizes - length + 1, 0)
    window = np.repeat(np.tile([True, False], len(sizes)), np.stack([windows, sizes + 1 - windows], axis=1).ravel())
    window = np.append(window, False)
    # two windows are equal if no slot after the first up to the second has a shorter prefix
    slots = np.flatnonzero(window[sa])
    shorter = np.cumsum((lcp < length)[sa])[slots]
    hit = np.flatnonzero(shorter[1:] == shorter[:-1])
    found = np.zeros(len(s), dtype=bool)
    found[sa[slots[hit]]] = True
    found[sa[slots[hit + 1]]] = True
    return found, starts


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each block of a shard, which of its windows start elsewhere in the shard too."""
    found, starts = _found(bodies, length)
    return [found[i : i + max(len(b) - length + 1, 0)] for i, b in zip(starts.tolist(), bodies, strict=True)]


_SPANS = "doc long, tk long, start int, end int"


def _shard_spans(kind: np.ndarray, doc: np.ndarray, tk: np.ndarray, lo: np.ndarray, bodies: list[bytes], length: int) -> pa.RecordBatch:
    """Spans of the windows of a shard's rows that repeat."""
    # a row that stands for several is in the shard twice; its second body has no place of its own
    row = np.repeat(np.arange(len(kind)), kind)
    own = np.concatenate([[True], row[1:] != row[:-1]])
    found, starts = _found([bodies[i] for i in row.tolist()], length)
    # each body ends in positions that are no windows
    edge = np.diff(found.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    of = np.searchsorted(starts, first, side="right") - 1
    first, last, of = (x.compress(own[of]) for x in (first, last, of))
    r = row[of]
    shift = lo[r] - starts[of]
    return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tk[r]), pa.array((first + shift).astype(np.int32)), pa.array((last + shift + length).astype(np.int32))], names=["doc", "tk", "start", "end"])


def _shards(length: int, shard_bytes: int):
    """Blocks sorted by anchor; whole groups are gathered into shards. Spans of the windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], list[bytes]]] = []
        size, last = 0, None

        def done():
            columns = [np.concatenate(c) for c in zip(*(c for c, _ in held), strict=True)]
            return _shard_spans(*columns, [body for _, bodies in held for body in bodies], length)

        for b in batches:
            if not b.num_rows:
                continue
            g, *columns = (b[c].to_numpy(zero_copy_only=False) for c in ("g", "kind", "doc", "tk", "lo"))
            bodies = b["body"].to_pylist()
            weights = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)) * columns[0])
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if g[0] != last:
                cuts = np.concatenate([[0], cuts])
            full = np.concatenate([[0], weights])[cuts]  # bytes of this batch before each cut
            start, before = 0, 0
            while True:
                # the first bound of groups at which the shard is full
                k = int(np.searchsorted(full, max(shard_bytes, 1) - size + before))
                end = int(cuts[k]) if k < len(cuts) else len(g)
                if end > start:
                    held.append(([c[start:end] for c in columns], bodies[start:end]))
                if k == len(cuts):
                    break
                yield done()
                held, size, start, before = [], 0, end, int(full[k])
            size += int(weights[-1]) - before
            last = g[-1]
        if held:
            yield done()

    return run


def _halve(length: int, gram: int, level: int):
    """Cut blocks at the bounds of 2**level ranges of offsets; g becomes the hash of what a range's windows share."""
    window, ranges = length - gram + 1, 2**level
    bounds = [-(-r * window // ranges) for r in range(ranges + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "g", "b", "doc", "tk", "lo", "m", "off", "body"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for kind, doc, tk, lo, m, off, body in zip(*(batch[c].to_pylist() for c in ("kind", "doc", "tk", "lo", "m", "off", "body")), strict=True):
                i = 0
                while i < m:
                    o = off - i  # the offset of window i; later windows have smaller ones
                    r = int(np.searchsorted(bounds, o, side="right")) - 1
                    k = min(m, off - bounds[r] + 1)
                    own = body[i : k + length - 1]
                    shared = body[off - bounds[r] : off - bounds[r + 1] + 1 + length] if bounds[r + 1] - bounds[r] > 1 else own
                    key = xxhash.xxh3_64_intdigest(shared, seed=level * 1000 + r)
                    # one that stands for several is several
                    out += [(kind, key - (1 << 64) if key >> 63 else key, int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own)))), doc, tk, lo + i, k - i, o, own)] * kind
                    i = k
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, tk (hash of the text), start, end: byte spans, which may overlap, of the repeated strings."""
    ship(docs.sparkSession)
    rows = _rows(docs)
    blocks = written(rows.mapInArrow(_blocks(length, gram), _KEYS), "blocks")
    decided = _kinds(blocks, "block-kinds")
    place = ["doc", "tk", F.col("lo").alias("start"), (F.col("lo") + F.col("m") + length - 1).cast("int").alias("end")]
    spans = decided.where(F.col("kind") == _COPY).select(*place)
    wanted = decided.where(F.col("kind") != _COPY).withColumn("kind", F.col("kind") + F.when(F.col("blocks") > hot, 10).otherwise(0))
    wanted = wanted.groupBy("doc", "tk").agg(F.collect_list(F.struct("kind", "g", "lo", "m", "off")).alias("wanted"))
    texts = rows.mapInArrow(_squeeze, "doc long, tk long, z binary")
    # a merge join brings equal rows side by side
    bodies = texts.hint("merge").join(wanted, ["doc", "tk"]).select("doc", "tk", "z", "wanted").mapInArrow(_bodies(length), _BODIES)
    bodies = written(bodies, "block-bodies")
    ready, heavy, level = bodies.where("kind < 10").drop("off", "m"), bodies.where("kind > 10").withColumn("kind", F.col("kind") - 10), 0
    while heavy.limit(1).count():
        level += 1
        cut = written(heavy.mapInArrow(_halve(length, gram, level), "kind int, g long, b long, doc long, tk long, lo int, m int, off int, body binary"), "halves")
        settled = _kinds(cut.drop("kind"), "half-kinds")
        spans = spans.unionByName(settled.where(F.col("kind") == _COPY).select(*place))
        left = settled.where(F.col("kind") != _COPY)
        ready = ready.unionByName(left.where(F.col("blocks") <= hot).select("kind", "g", "doc", "tk", "lo", "body"))
        heavy = left.where(F.col("blocks") > hot).select("kind", "g", "doc", "tk", "lo", "m", "off", "body")
    found = ready.repartition("g").sortWithinPartitions("g").mapInArrow(_shards(length, shard_bytes), _SPANS)
    return spans.unionByName(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in batches:
        docs, sizes, gone, runs, sha = [], [], [], [], []
        for doc, z, start, end in zip(*(b[c].to_pylist() for c in ("doc", "z", "starts", "ends")), strict=True):
            raw = d.decompress(z)
            merged = merge(start or [], end or [])
            at, kept = 0, hashlib.sha256()
            for i, j in merged:
                kept.update(raw[at:i])
                at = j
            kept.update(raw[at:])
            docs.append(None if doc == _NULL_DOC else doc)
            sizes.append(len(raw))
            gone.append(sum(j - i for i, j in merged))
            runs.append(len(merged))
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merge(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of spans, as maximal runs."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(zip(starts, ends, strict=True)):
        if out and i <= out[-1][1]:
            if j > out[-1][1]:
                out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
    return out


def suffix_report(docs: DataFrame, **params: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = removed_spans(docs, **params).groupBy("doc", "tk").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    spans = spans.select("doc", "tk", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    texts = _rows(docs).mapInArrow(_squeeze, "doc long, tk long, z binary")
    joined = texts.join(spans, ["doc", "tk"], "left").select("doc", "z", "starts", "ends")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
