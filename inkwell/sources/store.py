"""A store: documents and postings as Parquet pieces, and a metadata file per commit.

A piece is a folder of its own for each write, never written to again, so writers don't touch each other's files. It
is visible once a commit file lists it, so readers never see half a piece and a failed write leaves nothing behind but
files that nobody reads. Commit files are created exclusively: of two writers that race for a sequence number one
fails, reads what the other committed, and tries the next number for the piece that it has written already.

A commit lists pieces with their batch numbers, which order the writes of a document. A compacted piece has the largest
number of those that it stands for; where it stands for a range of ids only, the others keep their other rows and
that range of theirs is hidden.

Postings are range-partitioned by (mbox, attr, token, indexed_id) and sorted by (token, mbox, attr, indexed_id) in each
file: a term is a few row groups of a few files, whatever the size of the index, and a frequent token is split over files
by id. The token column has a Bloom
filter. Documents are partitioned by shard (day) and sorted by id, so lookups by id prune days and row groups.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, fields, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.errors import BadRequest, BadStore, Conflict, ReadOnly
from . import files
from .schemas import DOCUMENTS, META_VERSION, POSTINGS, STORED_DOCUMENTS

TABLES = {"documents": DOCUMENTS, "postings": POSTINGS}
_STORED = {"documents": STORED_DOCUMENTS, "postings": POSTINGS}
#: Ids are from 0 to this.
LARGEST = 2**63 - 1
#: What tells documents apart: two external ids of one day may have the same hash, and with it the same indexed_id.
IDENTITY = ("indexed_id", "id")
#: Bytes of input for a task that sorts and writes rows.
INPUT_BYTES = 6 << 20
#: How often a commit is tried again after others were faster.
_TRIES = 100


@dataclass(frozen=True)
class EngineConfig:
    """`read_only` refuses writes; `short` joins words of fewer characters to their neighbours when indexing."""

    read_only: bool = False
    short: int = 0
    lowercase: bool = True
    codec: str = "zstd"
    row_group: int = 64 << 20

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        """Read an object with some of the fields; others keep their defaults."""
        try:
            given = json.loads(text)
        except ValueError as e:
            raise BadRequest(f"not JSON: {e}") from e
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if not isinstance(given, dict) or (wrong := {k for k, v in given.items() if type(v) is not kinds.get(k)}):
            raise BadRequest(f"not a configuration: {sorted(wrong) if isinstance(given, dict) else given!r}")
        return cls(**given)


@dataclass(frozen=True)
class Piece:
    """A batch number and a folder, and the tables that were written; rows with ids of the hidden ranges (both ends
    included) don't count."""

    number: int
    name: str
    hidden: tuple[tuple[int, int], ...] = ()
    tables: tuple[str, ...] = tuple(TABLES)

    def hide(self, first: int, last: int) -> Piece | None:
        """With one more hidden range; None if nothing is left."""
        ranges: list[tuple[int, int]] = []
        for a, b in sorted([*self.hidden, (first, last)]):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        return None if ranges == [(0, LARGEST)] else replace(self, hidden=tuple(ranges))


@dataclass(frozen=True)
class Meta:
    """What a commit says: its number and the pieces that count."""

    sequence: int = 0
    live: tuple[Piece, ...] = field(default_factory=tuple)

    def to_json(self) -> str:
        live = [{"number": p.number, "name": p.name, "hidden": p.hidden, "tables": p.tables} for p in self.live]
        return json.dumps({"version": META_VERSION, "sequence": self.sequence, "live": live})

    @classmethod
    def from_json(cls, text: str) -> Meta:
        try:
            x = json.loads(text)
        except ValueError as e:
            raise BadStore(f"metadata can't be read: {e}") from e
        if not isinstance(x, dict) or x.get("version") != META_VERSION:
            raise BadStore(f"metadata of version {x.get('version') if isinstance(x, dict) else None}, not {META_VERSION}")
        live = (Piece(p["number"], p["name"], tuple(map(tuple, p["hidden"])), tuple(p.get("tables", TABLES))) for p in x["live"])
        return cls(x["sequence"], tuple(live))

    def having(self, table: str) -> tuple[Piece, ...]:
        """The pieces that have rows of a table."""
        return tuple(p for p in self.live if table in p.tables)



class Store:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()

    def meta(self) -> Meta:
        """The last commit."""
        names = [n for n in files.list_names(self.spark, f"{self.path}/meta") if n.endswith(".json")]
        if not names:
            return Meta()
        path = f"{self.path}/meta/{names[-1]}"
        for _ in range(50):  # a commit file is created first and filled at once after that
            if text := files.read_text(self.spark, path):
                return Meta.from_json(text)
            time.sleep(0.1)
        raise BadStore(f"{path} is empty: its writer was lost; remove it to go on")

    def table(self, name: str, meta: Meta | None = None) -> DataFrame:
        """Rows of all pieces that count, as they were written, in one scan."""
        live = (meta or self.meta()).having(name)
        if not live:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [f"{self.path}/{name}/piece={p.name}" for p in live]
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{_STORED[name]}, piece string").parquet(*paths)
        for p in live:
            for first, last in p.hidden:
                rows = rows.where((F.col("piece") != p.name) | (F.col("indexed_id") < first) | (F.col("indexed_id") > last))
        if name == "documents":
            if len(live) == 1:
                rows = rows.withColumn("batch", F.lit(live[0].number).cast("long"))
            else:  # a row per piece that the commit file lists
                numbers = self.spark.createDataFrame([(p.name, p.number) for p in live], "piece string, batch long")
                rows = rows.join(F.broadcast(numbers), "piece")
        return rows.select(*self.spark.createDataFrame([], TABLES[name]).columns)

    def postings(self) -> DataFrame:
        return self.table("postings")

    def documents(self, meta: Meta | None = None) -> DataFrame:
        """The last write of each document. A piece holds a document once, so the only piece needs no resolving."""
        meta = meta or self.meta()
        rows = self.table("documents", meta)
        return rows if len(meta.having("documents")) <= 1 else last_writes(rows)

    def write(self, documents: DataFrame | None, postings: DataFrame | None) -> Meta:
        """Add a batch, or one table of it."""
        given = {"documents": documents, "postings": postings}
        return self.commit(self.stage(documents, postings), tables=tuple(t for t, rows in given.items() if rows is not None))

    def stage(self, documents: DataFrame | None, postings: DataFrame | None) -> str:
        """Write a piece that no commit lists yet."""
        if self.config.read_only:
            raise ReadOnly()
        name = f"p{uuid.uuid4().hex}"
        if documents is not None:
            self._write_documents(documents, f"{self.path}/documents/piece={name}")
        if postings is not None:
            self._write_postings(postings, f"{self.path}/postings/piece={name}")
        return name

    def commit(self, name: str, replaces: tuple[Piece, ...] = (), first: int = 0, last: int = LARGEST, tables: tuple[str, ...] = tuple(TABLES)) -> Meta:
        """Make a staged piece count; with `replaces`, in the place of those pieces' rows with ids from first to last."""
        for _ in range(_TRIES):
            now = self.meta()
            if missing := [p.name for p in replaces if p not in now.live]:
                raise Conflict(f"another compaction replaced {missing[0]} first")
            kept = [q for p in now.live if (q := p.hide(first, last) if p in replaces else p)]
            number = max((p.number for p in replaces), default=now.sequence + 1)
            meta = Meta(now.sequence + 1, (*kept, Piece(number, name, tables=tables)))
            try:
                files.write_new(self.spark, f"{self.path}/meta/{meta.sequence:012d}.json", meta.to_json())
                return meta
            except Py4JJavaError as e:
                if "Exist" not in str(e.java_exception):
                    raise
        raise Conflict("other writers were always faster")

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Remove pieces that the last commit doesn't list and that are older than so many seconds, so that neither
        searches that run nor pieces that are being written lose files. Returns their names."""
        if self.config.read_only:
            raise ReadOnly()
        live, gone = {p.name for p in self.meta().live}, set()
        for table in TABLES:
            for folder, age in files.list_ages(self.spark, f"{self.path}/{table}"):
                name = folder.removeprefix("piece=")
                if name != folder and name not in live and age >= older_than:
                    files.remove(self.spark, f"{self.path}/{table}/{folder}")
                    gone.add(name)
        return sorted(gone)

    def _options(self, bloom: str) -> dict[str, str]:
        return {"compression": self.config.codec, "parquet.block.size": str(self.config.row_group), f"parquet.bloom.filter.enabled#{bloom}": "true"}

    def _write_documents(self, documents: DataFrame, path: str) -> None:
        """Each document once: its last write by seq. Two external ids may share an indexed_id, as it holds 32 bits of a
        hash; they are two documents. The ranges that the files need hold all writes of an id, too."""
        columns = self.spark.createDataFrame([], _STORED["documents"]).columns
        order = Window.partitionBy("indexed_id", "id").orderBy(F.col("seq").desc(), F.xxhash64("author", "tsec", "content"))
        dealt = files.dealt(documents.select(*columns), INPUT_BYTES, "indexed_id", ranged=True).withColumn("nth", F.row_number().over(order))
        last = dealt.where("nth = 1").drop("nth").sortWithinPartitions("shard", "indexed_id", "id")
        last.write.options(**self._options("id")).partitionBy("shard").parquet(path)

    def _write_postings(self, postings: DataFrame, path: str) -> None:
        keys = ["mbox", "attr", "token", "indexed_id"]
        rows = postings.select("mbox", "attr", "token", "shard", "indexed_id")
        # by token first: the sort compares 8 bytes of its first column, which a mailbox and an attribute share with most rows
        dealt = files.dealt(rows, INPUT_BYTES, *keys, ranged=True).sortWithinPartitions("token", "mbox", "attr", "indexed_id")
        dealt.write.options(**self._options("token")).parquet(path)


def last_writes(rows: DataFrame) -> DataFrame:
    """Of the rows of each document the one of the highest batch, which holds a document once.

    Columns are resolved one by one, so that those that nobody asks for are not read.
    """
    last = [F.max_by(c, "batch").alias(c) for c in rows.columns if c not in IDENTITY]
    return rows.groupBy(*IDENTITY).agg(*last).select(*rows.columns)
