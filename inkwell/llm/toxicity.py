"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a lexicon (seed words, and words and stems that labelled toxic documents favour), how close its words
stand to second-person words, capitals, punctuation and obfuscation rates. Only the text is an input of a score.

Training takes at most `SAMPLE_ROWS` labelled documents, drawn by a hash of doc_id, none of them held out, and one text
of each (the one of the smallest hash, where an id has several); their texts stay on the executors, which count and rank
words by evidence; the driver sees the documents' features and the best words until the lexicon is full. The model
(lexicon, trees, calibration) has a bounded size. Scoring reads every whole text once.

Cases: a null or empty text is scored like any other (all features 0); labels that are null or name no document
are not used, and a document labelled twice is toxic if either label is; without labels of both classes the score
is 0.5 times the seed lexicon's evidence; repeated rows get repeated results; a null doc_id is not held out; other
columns are ignored by the report and passed on by `drop_toxic`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ship, whole_text, written

#: Labelled documents that train the model, at most.
SAMPLE_ROWS = 12_000
#: Words and stems with the strongest evidence that become the learned lexicon.
LEXICON_WORDS = 200
#: A learned entry stands in this share of the toxic documents; its log odds and its likelihood ratio are at least these.
LEXICON_SHARE, LEXICON_ODDS, LEXICON_RATIO = 0.015, 1.5, 30.0
#: Lengths in bytes of the stems: entries that end with a star stand for all words that begin so.
STEMS = range(4, 9)
_TERMS_KEPT = 400_000
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 20
SEED_LEXICON = ("idiot", "idiots", "stupid", "moron", "morons", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "loser", "losers", "dumb", "garbage", "filth", "vermin", "hate", "ugly", "shut")
SECOND_PERSON = frozenset(w.encode() for w in ("you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "te", "ti", "usted", "ustedes", "vosotros"))
NEAR = 4
FEATURES = 16

_PLAIN = bytes((i + 32 if 65 <= i <= 90 else 32 if i < 128 and not chr(i).isalnum() and chr(i) not in "@$*" else i) for i in range(256))
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_CAPS_KEPT = bytes(i for i in range(256) if not 65 <= i <= 90)
_LETTERS_KEPT = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))
_MARKS_KEPT = bytes(i for i in range(256) if i not in b"!?")
_PUNCT_KEPT = bytes(i for i in range(256) if i not in b".,;:-'\"()[]{}<>/\\|_#%&*+=^`~@$!?")
_MIXED = re.compile(rb"[a-z][0-9@$*]+[a-z]")
_REPEAT = re.compile(rb"([a-z])\1\1")
_CAP_WORD = re.compile(rb"\b[A-Z]{3,}\b")
_SPACED = re.compile(rb"\b(?:[a-z] ){3,}[a-z]\b")


class Terms(dict):
    """The lexicon's weight of each word met so far: its own, or that of its strongest stem; 0 for most."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > _TERMS_KEPT:
            self.clear()
        get = self.lexicon.get
        weight = self[word] = max(get(word, 0.0), *(get(word[:k] + b"*", 0.0) for k in STEMS if k < len(word)), 0.0)
        return weight


def word_and_stems(word: bytes) -> list[bytes]:
    """What a word counts for when the lexicon is learned."""
    return [word, *(word[:k] + b"*" for k in STEMS if k < len(word))]


def text_features(raw: bytes, terms: Terms, seeds: frozenset[bytes]) -> list[float]:
    """Dense features of one UTF-8 text."""
    lexicon = terms.lexicon
    plain = raw.translate(_PLAIN)
    words = plain.split()
    n = max(len(words), 1)
    every = list(map(terms.__getitem__, words))
    hits = [i for i, x in enumerate(every) if x] if any(every) else []
    distinct = {words[i] for i in hits}
    weights = [every[i] for i in hits]
    seed_hits = sum(words[i] in seeds for i in hits)
    near = 0
    for i in hits:
        near += any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1])
    masked = 0
    if _MIXED.search(plain):
        masked += sum(w not in lexicon and w.translate(_LEET) in lexicon for w in words if not w.isalpha())
    if _SPACED.search(plain):
        masked += sum(m.replace(b" ", b"") in lexicon for m in _SPACED.findall(plain))
    caps, letters = len(raw.translate(None, _CAPS_KEPT)), max(len(raw.translate(None, _LETTERS_KEPT)), 1)
    marks, size = len(raw.translate(None, _MARKS_KEPT)), max(len(raw), 1)
    stretched = sum(1 for _ in _REPEAT.finditer(plain))
    shouted = sum(1 for _ in _CAP_WORD.finditer(raw))
    return [
        len(hits) / n,
        seed_hits / n,
        float(len(hits)),
        float(len(distinct)),
        sum(weights) / n,
        sum(weights),
        max(weights, default=0.0),
        near / n,
        float(near),
        caps / letters,
        shouted / n,
        marks / size,
        len(raw.translate(None, _PUNCT_KEPT)) / size,
        masked / n,
        float(masked),
        stretched / n,
    ]


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    start: float = 0.0
    #: Per tree: the features and thresholds of its inner nodes in heap order, and its leaves.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Calibration: raw probabilities and what they mean, both ascending.
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    means: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw probability keeps the order within the steps of the calibration."""
        if not self.trees:
            return 0.5 * np.minimum(1.0, x[:, 2] / 2)
        p = 1 / (1 + np.exp(-self.margin(x)))
        return 0.999 * np.interp(p, self.raw, self.means) + 0.001 * p


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the means of the blocks at the blocks' mean probabilities."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(p[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2] or blocks[-2][0] / blocks[-2][2] == blocks[-1][0] / blocks[-1][2]):
            c = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], c, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Histogram boosting for the logistic loss, with whole trees of DEPTH levels."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    for j in range(len(cuts)):  # features that are mostly 0 still get cuts among their other values
        some = x[x[:, j] > 0, j]
        if len(some):
            cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(some, np.linspace(0, 1, BINS // 2)[:-1])]))[: 2 * BINS - 1]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    flat = codes + np.arange(x.shape[1]) * width
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = float(np.log(rate / (1 - rate)))
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * LEAF:
                    at = flat[rows].ravel()
                    size = x.shape[1] * width
                    gs, hs, ns = (np.bincount(at, np.repeat(v, x.shape[1]) if v is not None else None, size).reshape(-1, width).cumsum(1) for v in (g[rows], h[rows], None))
                    gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain = np.where((nl >= LEAF) & (nt - nl >= LEAF), gain, -1)
                    j, c = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, c] > 1e-6 and c < len(cuts[j]):
                        feature[k], cut[k] = j, cuts[j][c]
                right = x[rows, feature[k]] > cut[k]
                node[rows] = 2 * k + 1 + right
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        margin += leaf[at]
        trees.append((feature, cut, leaf))
    return start, trees


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and how many other texts each word and stem stands."""
    for b in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            found = {w for w in text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if 3 <= len(w) <= 24}
            counts[toxic].update({t for w in found for t in word_and_stems(w)})
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))], names=["word", "bad", "good"])


def ranked_words(sample: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """word, odds of the words and stems with enough evidence, the strongest first.

    odds: log of how much more often the word stands in toxic documents. Evidence: how much likelier the counts are with a
    share of documents for each class than with one for both, as 2 log.
    """
    counts = sample.select("text", "toxic").mapInArrow(_sample_words, "word binary, bad long, good long")
    bad, good = F.col("bad"), F.col("good")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(bad >= max(3, int(LEXICON_SHARE * n_bad)))
    share = (bad + good) / (n_bad + n_good)
    ratio = F.lit(0.0)
    for k, n in ((bad, n_bad), (good, n_good)):
        ratio += F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
    rows = counts.select("word", odds.alias("odds"), (2 * ratio).alias("ratio"))
    return rows.where((F.col("odds") >= LEXICON_ODDS) & (F.col("ratio") >= LEXICON_RATIO)).orderBy(F.round("ratio", 9).desc(), "word").select("word", "odds")


def _feature_rows(lexicon: dict[bytes, float], seeds: frozenset[bytes], keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(lexicon)
        for b in batches:
            x = [text_features(t.encode("utf-8", "surrogatepass"), terms, seeds) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


_SEEDS = frozenset(w.encode() for w in SEED_LEXICON)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled rows that aren't held out; a fold of them calibrates."""
    ship(docs.sparkSession)
    base = Model({w: 1.0 for w in _SEEDS})
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(rows, "toxic-sample")
    n_bad, n_all = sample.agg(F.sum("toxic"), F.count("*")).first()
    if not n_bad or n_bad == n_all:
        return base
    ranked = ranked_words(sample, n_bad, n_all - n_bad).toLocalIterator()
    lexicon = base.lexicon | dict(independent((bytes(r.word), r.odds) for r in ranked))
    keep = ("doc_id", "toxic")
    table = sample.mapInArrow(_feature_rows(lexicon, _SEEDS, keep), "doc_id long, toxic int, x array<double>").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).orderBy("doc_id", "x").toArrow()
    x = np.array(table["x"].to_pylist())
    y = table["toxic"].to_numpy().astype(float)
    fold = table["fold"].to_numpy()
    calibrates = fold == 1
    if len(set(y[calibrates])) < 2 or len(set(y[~calibrates])) < 2:
        calibrates = np.zeros(len(y), dtype=bool)
    start, trees = fit_trees(x[~calibrates], y[~calibrates])
    model = Model(lexicon, start, trees)
    on = calibrates if calibrates.any() else ~calibrates
    p = 1 / (1 + np.exp(-model.margin(x[on])))
    model.raw, model.means = isotonic(p, y[on])
    return model


def independent(terms: Iterable[tuple[bytes, float]], most: int = LEXICON_WORDS) -> list[tuple[bytes, float]]:
    """The first `most` terms, best first, without those that begin like a better one or that a better one begins like."""
    chosen: list[tuple[bytes, float]] = []
    for t, odds in terms:
        stem = t.rstrip(b"*")
        if not any((c.endswith(b"*") and stem.startswith(c[:-1])) or (t.endswith(b"*") and c.rstrip(b"*").startswith(stem)) for c, _ in chosen):
            chosen.append((t, odds))
            if len(chosen) == most:
                break
    return chosen


def _score(model: Model, text: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.lexicon)
        for b in batches:
            x = [text_features((t or "").encode("utf-8", "surrogatepass"), terms, _SEEDS) for t in b[text].to_pylist()]
            score = model.score(np.array(x).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(score, pa.float64())], names=[*keep, "score"])

    return run


def toxicity_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample_rows)
    rows = docs.select("doc_id", "text").mapInArrow(_score(model, "text", ("doc_id",)), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below the threshold, with the columns of `docs`."""
    model = train(docs, labels, sample_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])  # not as text: columns may have any names
    out = rows.mapInArrow(_score(model, "text", ("row",)), schema)
    return out.where(F.col("score") < threshold).select("row.*")
