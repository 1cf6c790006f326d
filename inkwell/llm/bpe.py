"""Byte-level BPE by a global shuffle of distinct words.

1. Documents are taken in blocks of bounded size, in the order in which a task reads them. The distinct words of a
   block, numbered, are dealt out by word; those that go the same way travel as one row.
2. Where a word arrives it is encoded once, whatever number of blocks hold it, and its ids go back to the blocks.
3. The block's documents, as positions in its word list, meet the ids and are put together by position.
A word is one entry per block, so frequent words need no salt: they were aggregated before they were shuffled.
Decoding joins ids to the token-byte table, whose size is that of the vocabulary.

Blocks are cut twice, for their words and for their documents; both must give the same words. A digest in every row
guards that: an input whose order changes between the two fails instead of giving wrong ids.

Cases: a null text is empty and has no tokens; repeated rows each get a result; a null doc_id is allowed; an empty
table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text

#: A block is closed once it has this many characters or distinct pieces.
BLOCK_CHARS, BLOCK_PIECES = 16_000_000, 400_000
#: Documents of a block are sent in rows of about so many words.
_ROW_WORDS = 500_000
#: Words whose ids a task remembers, at most; beyond, it starts again. Longer words are not remembered.
_CACHE_WORDS, _CACHE_BYTES = 1_000_000, 100
#: Ids are packed as 16-bit numbers.
_MOST_IDS = 1 << 16
#: Sizes of the ranks of frequent words that get the smallest numbers of a block.
_TIERS = (256, 65_536)
#: Blocks of a task.
_TASK_BLOCKS = 1 << 20
#: Unicode's White_Space, as the pattern's \s is understood by the tokenizer libraries.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space that does not start a word: only texts without any can be cut at every space.
_ODD = re.compile(f" (?:[{_SPACES}]|\\Z)")
#: The same for Arrow's expressions, and a space that does start a word.
_SPACES_ARROW = _SPACES.encode().decode("unicode_escape")
ODD_ARROW, START_ARROW = f" (?:[{_SPACES_ARROW}]|\\z)", f" ([^{_SPACES_ARROW}])"
#: What the tokenizers library's ByteLevel cuts by.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that the library gets as one text.
_JOINED = 2000


def pretokenizer(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern, with its white space classes spelled out."""
    plain = pattern.replace("[^\\s", f"[^{_SPACES}").replace("\\S", f"[^{_SPACES}]").replace("\\s", f"[{_SPACES}]")
    return regex.compile(plain).findall


def ascii_pretokenizer(pattern: str) -> Callable[[str], list[str]]:
    """The same for ASCII text, where letters and digits are few."""
    for name, members in (("\\p{L}", "A-Za-z"), ("\\p{N}", "0-9")):
        head, *rest = pattern.split(name)
        for part in rest:
            inside = head.rfind("[") > head.rfind("]")
            head += (members if inside else f"[{members}]") + part
        pattern = head
    return re.compile(pattern, re.A).findall


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(free)) for b in range(256))


class Vocabulary:
    """Which files and library encode a word. `library`: "tiktoken" (rank file) or "tokenizers" (JSON file)."""

    def __init__(self, library: str, file: str, pattern: str, end_id: int | None = None):
        self.library, self.file, self.pattern, self.end_id = library, file, pattern, end_id

    def added(self) -> dict[str, int]:
        """Tokens that the JSON file adds to its model: they stand for themselves wherever a text holds them."""
        if self.library == "tiktoken":
            return {}
        with open(self.file, encoding="utf-8") as f:
            tokens = json.load(f)["added_tokens"]
        for t in tokens:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} has rules that are not supported")
        return {t["content"]: t["id"] for t in tokens}

    def encoder(self) -> Callable[[list[str]], list[bytes]]:
        """Encodes words: the ids of each, packed as 16-bit numbers."""
        if self.library == "tiktoken":
            import tiktoken

            if len(ranks := read_ranks(self.file)) > _MOST_IDS:
                raise ValueError(f"{self.file} has {len(ranks)} tokens; ids are packed in 16 bits")
            enc = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda words: [array("H", enc.encode_ordinary(w)).tobytes() for w in words]
        # the file's model without its splitting, as the words are cut already
        tok = self._model()
        added = {t: array("H", [i]).tobytes() for t, i in self.added().items()}
        letters = dict(enumerate(byte_letters()))
        space = letters[32]
        vocabulary = tok.get_vocab()
        if max([*vocabulary.values(), *self.added().values()]) >= _MOST_IDS:
            raise ValueError(f"{self.file} has ids over {_MOST_IDS - 1}; ids are packed in 16 bits")
        sizes = _token_bytes(vocabulary)

        def spelled(w: str) -> str:
            if w.isascii() and w.isprintable():
                return w.replace(" ", space)
            return w.encode().decode("latin-1").translate(letters)

        def encode(words: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(words), 4000):
                some = list(map(spelled, words[i : i + 4000]))
                ids = np.array(tok.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u2")
                # tokens do not span words: a word ends with the token that makes up its length
                ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(list(map(len, some)))) + 1
                flat, cut = ids.tobytes(), (2 * ends).tolist()
                out += [flat[a:b] for a, b in zip([0, *cut], cut, strict=False)]
            return [added.get(w, ids) for w, ids in zip(words, out, strict=True)] if added else out

        return encode

    def piece_encoder(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None:
        """Encodes pieces, which are what stands between spaces that start words, without added tokens: the number of ids of
        each, and all ids. The library cuts them too, many at a time: no token spans two. None if the file does not cut
        by the pattern."""
        if self.library != "tokenizers" or self.pattern != _BYTE_LEVEL:
            return None
        with open(self.file, encoding="utf-8") as f:
            cut = json.load(f)["pre_tokenizer"] or {}
        if (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            return None
        from tokenizers import pre_tokenizers

        tok = self._model()
        tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        sizes = _token_bytes(tok.get_vocab())

        def encode(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            if not len(pieces):
                return np.zeros(0, np.int64), np.zeros(0, "<u2")
            cuts = np.append(np.arange(0, len(pieces), _JOINED), len(pieces)).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces), " ").to_pylist()
            ids = np.concatenate([np.array(tok.encode_batch_fast([" " + t], add_special_tokens=False)[0].ids, dtype="<u2") for t in texts])
            at, ends = np.cumsum(sizes[ids]), np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
            last = np.searchsorted(at, ends)
            if last[-1] != len(ids) - 1 or (at[last] != ends).any():
                raise RuntimeError("a token spans two pieces")
            return np.diff(last, prepend=-1), ids

        return encode

    def _model(self):
        """A tokenizer with the file's model alone."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer(Tokenizer.from_file(self.file).model)


def _token_bytes(vocabulary: dict[str, int]) -> np.ndarray:
    """The number of bytes of each id's token, which has a letter for each byte."""
    sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    sizes[list(vocabulary.values())] = list(map(len, vocabulary))
    return sizes


class Cutter:
    """Cuts texts into words. Most texts are cut at spaces first, and each distinct piece between spaces once."""

    def __init__(self, pattern: str, added: Iterable[str] = ()):
        self.find, self.find_ascii = pretokenizer(pattern), ascii_pretokenizer(pattern)
        #: Tokens that are words wherever they stand, the longest first.
        self.added = sorted(added, key=len, reverse=True)
        self.find_added = re.compile(f"({'|'.join(map(re.escape, self.added))})")
        #: Whether letters after a space are one word, and a mark after them is another.
        self.plain = {r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+"} <= set(pattern.split("|"))

    def words(self, piece: str) -> list[str]:
        """Words of a piece that follows a space."""
        if self.plain:
            if piece.isalpha():
                return [" " + piece]
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():
                return [" " + piece[:-1], piece[-1]]
        return self.find_ascii(" " + piece) if piece.isascii() else self.find(" " + piece)

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Words, and the pieces after them."""
        if any(t in text for t in self.added):
            # what is between added tokens is cut by itself
            parts = self.find_added.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.find(part))], []
        if _ODD.search(text):
            return self.find(text), []
        first, space, tail = text.partition(" ")
        return self.find(first), tail.split(" ") if space else []


class Block:
    """Texts, their distinct words, and each text as a list of word numbers."""

    def __init__(self, cutter: Cutter, texts: list[str]):
        pieces: Counter = Counter()
        loose: Counter = Counter()
        self.cutter, self.texts = cutter, texts
        for text in texts:
            head, rest = cutter.cut(text)
            loose.update(head)
            pieces.update(rest)
        self.pieces = {p: cutter.words(p) for p in pieces}
        for p, n in pieces.items():
            for w in self.pieces[p]:
                loose[w] += n
        self.words, self.counts = list(loose), np.fromiter(loose.values(), dtype=np.int64, count=len(loose))

    def packed(self, code: dict[str, bytes]) -> Iterator[bytes]:
        """Each text as its words' codes, joined."""
        of_piece = {p: b"".join([code[w] for w in ws]) if len(ws) > 1 else code[ws[0]] if ws else b"" for p, ws in self.pieces.items()}
        for head, rest in map(self.cutter.cut, self.texts):
            yield b"".join([*map(code.__getitem__, head), *map(of_piece.__getitem__, rest)])


def blocks(batches: Iterator[pa.RecordBatch], cutter: Cutter, text: str = "text") -> Iterator[tuple[list[tuple], Block]]:
    """Runs of rows (without the text) and their block, cut at the same rows whenever the rows are the same."""
    rows: list[tuple] = []
    texts: list[str] = []
    size, seen = 0, 0
    for b in batches:
        others = [b[c].to_pylist() for c in b.schema.names if c != text]
        for t, *row in zip(b[text].to_pylist(), *others, strict=True):
            rows.append(tuple(row))
            texts.append(t)
            size += len(t)
            seen += t.count(" ") if len(t) < 1_000_000 else len(set(t.split(" ")))
            # pieces are counted with repeats; about one in seven is new, so this closes a block before it has too many
            if size >= BLOCK_CHARS or seen >= 7 * BLOCK_PIECES:
                yield rows, Block(cutter, texts)
                rows, texts, size, seen = [], [], 0, 0
    if rows:
        yield rows, Block(cutter, texts)


def _dealt(words: list[str], counts: np.ndarray, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words as bytes, the part of each, its tier of frequency, and the order by tier and part in which they are numbered."""
    raw = [w.encode() for w in words]
    part = np.fromiter(map(zlib.crc32, raw), dtype=np.int64, count=len(raw)) % parts
    tier = np.full(len(raw), len(_TIERS), dtype=np.int64)
    rank = np.argsort(-counts, kind="stable")
    for k in reversed(range(len(_TIERS))):
        tier[rank[: _TIERS[k]]] = k
    return raw, part, tier, np.lexsort((part, tier))


def _digest(raw: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\0".join(raw)) - (1 << 63)


_SQUEEZE = 3
_WORD_ROWS = "part int, block long, digest long, tiers array<int>, lens binary, words binary"
_PARTS = "block long, kind int, seq int, digest long, docs array<long>, counts array<int>, lens binary, data binary"


def _word_rows(vocabulary: Vocabulary, parts: int):
    """The words of each block, a row for each part that gets some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, squeeze = Cutter(vocabulary.pattern), zstandard.ZstdCompressor(level=_SQUEEZE).compress
        base = TaskContext.get().partitionId() * _TASK_BLOCKS
        for k, (_, block) in enumerate(blocks(batches, cutter)):
            raw, part, tier, _ = _dealt(block.words, block.counts, parts)
            digest = _digest(raw)
            order = np.lexsort((tier, part))
            part, tier = part[order], tier[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            raw = [raw[i] for i in order.tolist()]
            out = []
            for p in np.unique(part).tolist():
                i, j = int(edges[p]), int(edges[p + 1])
                lens = np.fromiter(map(len, raw[i:j]), dtype="<u4", count=j - i)
                out.append((p, base + k, digest, np.bincount(tier[i:j], minlength=len(_TIERS) + 1).tolist(), squeeze(lens.tobytes()), squeeze(b"".join(raw[i:j]))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "block", "digest", "tiers", "lens", "words"])

    return run


def _encode_words(vocabulary: Vocabulary):
    """The ids of each row's words, each distinct word of the partition encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = None, {}
        squeeze, expand = zstandard.ZstdCompressor(level=_SQUEEZE).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            encode = encode or vocabulary.encoder()
            lens_out, ids_out = [], []
            for lens, words in zip(b["lens"].to_pylist(), b["words"].to_pylist(), strict=True):
                data = expand(words)
                ends = np.cumsum(np.frombuffer(expand(lens), dtype="<u4")).tolist()
                own = [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
                if len(known) > _CACHE_WORDS:
                    known.clear()
                new = [w for w in own if w not in known]
                known.update(zip(new, encode([w.decode() for w in new]), strict=True))
                ids = list(map(known.__getitem__, own))
                for w in new:
                    if len(w) > _CACHE_BYTES:
                        known.pop(w, None)
                lens_out.append(squeeze((np.fromiter(map(len, ids), dtype="<u4", count=len(ids)) // 2).tobytes()))
                ids_out.append(squeeze(b"".join(ids)))
            n = len(ids_out)
            yield pa.RecordBatch.from_arrays(
                [b["block"], pa.array([0] * n, pa.int32()), b["part"], b["digest"], pa.nulls(n, pa.list_(pa.int64())), b["tiers"], pa.array(lens_out, pa.binary()), pa.array(ids_out, pa.binary())],
                names=["block", "kind", "seq", "digest", "docs", "counts", "lens", "data"],
            )

    return run


def _planes(codes: np.ndarray) -> bytes:
    """32-bit numbers as three planes of bytes: a block has fewer than 2**24 words."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(3, -1).T
    return out.view("<u4").ravel()


def _document_rows(vocabulary: Vocabulary, parts: int):
    """The documents of each block as word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, squeeze = Cutter(vocabulary.pattern), zstandard.ZstdCompressor(level=_SQUEEZE).compress
        base = TaskContext.get().partitionId() * _TASK_BLOCKS
        for k, (rows, block) in enumerate(blocks(batches, cutter)):
            raw, _, _, order = _dealt(block.words, block.counts, parts)
            digest = _digest(raw)
            number = np.empty(len(raw), dtype="<u4")
            number[order] = np.arange(len(raw), dtype="<u4")
            flat = number.tobytes()
            code = {w: flat[4 * i : 4 * i + 4] for i, w in enumerate(block.words)}
            out: list[tuple] = []
            docs: list[int | None] = []
            held: list[bytes] = []
            size = 0

            def close(out=out, docs=docs, held=held, k=k, digest=digest) -> None:
                codes = np.frombuffer(b"".join(held), dtype="<u4")
                out.append((base + k, 1, len(out), digest, list(docs), [len(h) // 4 for h in held], None, squeeze(_planes(codes))))
                docs.clear()
                held.clear()

            for (doc,), data in zip(rows, block.packed(code), strict=True):
                docs.append(doc)
                held.append(data)
                size += len(data) // 4
                if size >= _ROW_WORDS:
                    close()
                    size = 0
            if docs:
                close()
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "kind", "seq", "digest", "docs", "counts", "lens", "data"])

    return run


def _dictionary(replies: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's words in the order of their numbers: starts and lengths in the flat array of ids."""
    expand = zstandard.ZstdDecompressor().decompress
    starts, lens, flats = [[] for _ in range(len(_TIERS) + 1)], [[] for _ in range(len(_TIERS) + 1)], []
    base = 0
    for tiers, packed_lens, packed_ids in replies:
        n, ids = np.frombuffer(expand(packed_lens), dtype="<u4").astype(np.int64), np.frombuffer(expand(packed_ids), dtype="<u2")
        first = base + np.cumsum(n) - n
        at = 0
        for t, count in enumerate(tiers):
            starts[t].append(first[at : at + count])
            lens[t].append(n[at : at + count])
            at += count
        flats.append(ids)
        base += len(ids)
    empty = np.zeros(0, np.int64)
    return np.concatenate([x for t in starts for x in t] or [empty]), np.concatenate([x for t in lens for x in t] or [empty]), np.concatenate(flats or [np.zeros(0, "<u2")])


def gather(starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + len] of all, joined."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc ids, the ids of their texts joined, and where each ends; rows are sorted by block, kind and seq."""
    expand = zstandard.ZstdDecompressor().decompress
    key, replies, table = None, [], None
    for b in batches:
        for block, kind, digest, docs, counts, lens, data in zip(*(b[c].to_pylist() for c in ("block", "kind", "digest", "docs", "counts", "lens", "data")), strict=True):
            if (block, digest) != key:
                if key is not None and block == key[0]:
                    raise RuntimeError("the input's rows came in another order when they were read again")
                key, replies, table = (block, digest), [], None
            if kind == 0:
                replies.append((counts, lens, data))
                continue
            table = table or _dictionary(replies)
            starts, sizes, flat = table
            numbers = _unplanes(expand(data))
            if len(numbers) and int(numbers.max()) >= len(starts):
                raise RuntimeError("words of a block are missing")
            n = sizes[numbers]
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
            yield docs, gather(starts[numbers], n, flat), ends


def encoded_blocks(docs: DataFrame, vocabulary: Vocabulary, parts: int | None = None) -> DataFrame:
    """Rows that `_assembled` takes, in its order."""
    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("text"))
    words = rows.select("text").mapInArrow(_word_rows(vocabulary, parts), _WORD_ROWS)
    replies = words.repartitionById(parts, "part").mapInArrow(_encode_words(vocabulary), _PARTS)
    # documents first: their tasks then have the same numbers as those that sent the words
    both = rows.mapInArrow(_document_rows(vocabulary, parts), _PARTS).unionByName(replies)
    task, own = F.floor(F.col("block") / _TASK_BLOCKS), F.col("block") % _TASK_BLOCKS
    place = F.pmod(task + own * 97, F.lit(parts)).cast("int")  # blocks of a task go to different places
    return both.repartitionById(parts, place).sortWithinPartitions("block", "kind", "seq")


def _ids_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, ids, ends in _assembled(batches):
        data, cut = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([data[i:j] for i, j in zip([0, *cut], cut, strict=False)], pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each document."""
    return encoded_blocks(docs, vocabulary).mapInArrow(_ids_out, "doc_id long, ids binary")


class Decoder:
    """Joins ids to the token-byte table."""

    def __init__(self, table: dict[bytes, int]):
        size = max(table.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in table.items():
            by_id[i] = token
        self.lens = np.fromiter(map(len, by_id), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gather(self.starts[ids], self.lens[ids], self.flat).tobytes()


def _report(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = None
        for docs, ids, ends in _assembled(batches):
            decode = decode or Decoder(read_ranks(file))
            edges = np.concatenate([[0], ends])
            sha = [hashlib.sha256(ids[i:j].astype("<u4").tobytes()).hexdigest() for i, j in zip(edges, edges[1:], strict=False)]
            back = [hashlib.sha256(decode(ids[i:j])).hexdigest() for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.diff(edges).astype(np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; `vocabulary` names a rank file."""
    return encoded_blocks(docs, vocabulary).mapInArrow(_report(vocabulary.file), REPORT)
