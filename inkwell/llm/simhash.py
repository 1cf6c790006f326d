"""SimHash near-dedup by the generalised pigeonhole principle.

Distinct 64-bit fingerprints are linked where they differ in at most DISTANCE bits. Correlated bits are grouped into
PARTS partitions; with thresholds t_i (-1: partition not probed) that satisfy sum(t_i + 1) = DISTANCE + 1, two linked
fingerprints differ by at most t_i in some partition. Dynamic programming picks the thresholds from the candidate
pairs that each would give, estimated from counts over all fingerprints. Candidates of a bucket are verified by
popcount. A bucket of more than PAIRS fingerprints is verified by middle points instead: two values within two bits
of each other have a value within one bit of both. One of more than BUCKET is not collected; its middle points are
grouped by Spark, and no middle point has more than 65 neighbours.

Cases: a text without words (null, empty, white space) has fingerprint 0 and links like any other; fewer than three
words are one shingle; repeated rows and ids share a component; a null doc_id counts as the lowest and is given back
as null; other columns are ignored by the report and passed on by `keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text, written
from .graph import connected_components

BITS = 64
DISTANCE = 2
PARTS = 3
SEED = 42
WORDS = 3
PAIRS = 1024
BUCKET = 100_000
_NULL_DOC = -(2**63)
_ONE = np.uint64(1)
_BALL = np.concatenate([[np.uint64(0)], _ONE << np.arange(BITS, dtype=np.uint64)])


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[words - 1 :], strict=False)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_signed(fingerprint(t)) for t in b["text"].to_pylist()]
        own = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in own), pa.array(out, pa.int64())], names=[*own, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc, fp per document."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc long, fp long")


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all fingerprints of a task: how many have bits i and j both set."""
    total = np.zeros((BITS, BITS))
    for b in batches:
        x = np.unpackbits(b["fp"].to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += x.T @ x
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])


def group_bits(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Partitions of almost equal width; each takes the free bit that correlates most with its own."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        first = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        own = [first]
        free.remove(first)
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], distance: int = DISTANCE) -> list[int]:
    """Thresholds with sum(t + 1) = distance + 1 and the least total cost; costs[i][t] for t from 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance - used + 1):
                c = cost + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in new or c < new[used + t + 1][0]:
                    new[used + t + 1] = (c, [*ts, t])
        best = new
    return best[distance + 1][1]


def _masks(part: list[int], t: int) -> list[int]:
    out = [0]
    if t >= 1:
        out += [1 << b for b in part]
    if t >= 2:
        out += [1 << a | 1 << b for i, a in enumerate(part) for b in part[:i]]
    return out


def plan_probes(fps: DataFrame) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, from counts over all distinct fingerprints."""
    n = fps.count()
    sums = fps.select("fp").mapInArrow(_bit_sums, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2080 rows
    both = np.zeros((BITS, BITS))
    for i, j, c in sums:
        both[i, j] = both[j, i] = c
    parts = group_bits(both, n)
    p = np.diag(both) / max(n, 1)
    differ = np.minimum(2 * p * (1 - p), 0.999)
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("val")) for k, bits in enumerate(parts)])
    counts = fps.select(F.inline(keys)).groupBy("part", "val").count()
    equal = dict(counts.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).collect())  # PARTS rows
    costs = []
    for k, bits in enumerate(parts):
        odds = differ[bits] / (1 - differ[bits])
        e1 = float(odds.sum())
        e2 = float((e1**2 - (odds**2).sum()) / 2)
        pairs = max(float(equal.get(k, 0.0)), n * n / 2 * float(np.prod(1 - differ[bits])))
        row, probes = [], 0
        for t, factor in enumerate((1.0, 1 + e1, 1 + e1 + e2)):
            probes = len(_masks(bits, t))
            row.append(pairs * factor + n * probes)
        costs.append(row)
    return parts, allocate(costs)


def _roots(values: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, root) of a bucket: values that hold its key, probes that reach it from other keys."""
    every = np.unique(np.concatenate([values, probes]))
    n = len(every)
    root = np.arange(n)
    if n < 2:
        return every[:0], every[:0]
    if n <= PAIRS:
        a, b = np.nonzero(np.triu(np.bitwise_count(every[:, None] ^ every[None, :]) <= DISTANCE, 1))
    else:
        middle = (every[:, None] ^ _BALL[None, :]).ravel()
        owner = np.repeat(np.arange(n), len(_BALL))
        order = np.argsort(middle, kind="stable")
        middle, owner = middle[order], owner[order]
        same = np.flatnonzero(middle[1:] == middle[:-1])
        a, b = owner[same], owner[same + 1]
    while True:  # lower each root to that of its neighbours, then jump
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return every[moved], every[root[moved]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and val; a bucket has BUCKET rows at most."""
    key, held, flags = None, [], []
    us, vs = [], []

    def close():
        fp, probe = np.concatenate(held).astype("<i8").view("<u8"), np.concatenate(flags)
        if len(fp) > 1 and not probe.all():
            u, v = _roots(fp[~probe], fp[probe])
            us.append(u.view("<i8"))
            vs.append(v.view("<i8"))

    def out():
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        us.clear()
        vs.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        part, val, fp, probe = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "val", "fp", "probe"))
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (val[1:] != val[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if i == j:
                continue
            if key is not None and key != (part[i], val[i]):
                close()
                held, flags = [], []
            key = (part[i], val[i])
            held.append(fp[i:j])
            flags.append(probe[i:j])
        yield out()
    if held:
        close()
    yield out()


def near_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: for distinct fingerprints `fp`, links that join exactly those that chains of near pairs join."""
    parts, thresholds = plan_probes(fps)
    keys = []
    for k, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t >= 0:
            own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
            for m in _masks(bits, t):
                keys.append(F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(_signed(m))).alias("val"), F.lit(m != 0).alias("probe")))
    rows = fps.select("fp", F.inline(F.array(*keys)))
    sizes = rows.groupBy("part", "val").agg(F.count("*").alias("n"), F.max(~F.col("probe")).alias("held")).where("n > 1 AND held")
    sizes = written(sizes, "simhash-buckets")
    found = rows.join(sizes.where(F.col("n") <= bucket).select("part", "val"), ["part", "val"])
    found = found.repartition("part", "val").sortWithinPartitions("part", "val")
    links = found.select("part", "val", "fp", "probe").mapInArrow(_verify, "u long, v long")
    large = sizes.where(F.col("n") > bucket).select("part", "val")
    if large.limit(1).count():
        hot = rows.join(large, ["part", "val"]).select("fp").distinct()
        ball = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(int(m)))) for m in _BALL])
        middles = hot.select("fp", F.explode(ball).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
        links = links.unionByName(middles.select(F.array_min("near").alias("v"), F.explode("near").alias("u")).where("u <> v").select("u", "v"))
    return links


def _grouped(fps: DataFrame, rep: F.Column) -> DataFrame:
    """fp, rep, root: for each distinct fingerprint the lowest `rep` of its rows, and its component's root."""
    distinct = written(fps.groupBy("fp").agg(F.min(rep).alias("rep")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct.select("fp")), "simhash-links").withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame) -> DataFrame:
    """doc, fp, component per document."""
    fps = written(fingerprints(docs), "fingerprints")
    named = _grouped(fps, F.col("doc"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    table = written(named.join(lowest, "root").select("fp", "component"), "simhash-components")
    return fps.join(table, "fp")


def _doc(col: str):
    return F.when(F.col(col) != _NULL_DOC, F.col(col))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    c = components(docs)
    return c.select(_doc("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), _doc("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of `docs`: of the smallest doc_id, and of its texts the one of the smallest hash."""
    ship(docs.sparkSession)
    doc, tk = F.coalesce("doc_id", F.lit(_NULL_DOC)), F.xxhash64(whole_text())
    rows = docs.select(doc.alias("doc"), tk.alias("tk"), whole_text().alias("text"))
    fps = written(rows.mapInArrow(_fingerprints, "doc long, tk long, fp long"), "fingerprints")
    # an id may stand for several groups; with the hash of its text it is in one
    kept = _grouped(fps, F.struct("doc", "tk")).groupBy("root").agg(F.min("rep").alias("rep"))
    own = ["doc", "tk"]
    kept = written(kept.select("rep.doc", "rep.tk"), "simhash-kept")
    # the documents' columns may have any names, so they travel in a struct
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, doc.alias("doc"), tk.alias("tk")).join(kept, own, "left_semi")
    copies = fps.select(own).join(kept, own, "left_semi").groupBy(own).count()
    if copies.where("count > 1").limit(1).count():
        # rows of one id and text: always the same one
        out = out.groupBy(own).agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return out.select("row.*")
