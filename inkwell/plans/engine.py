"""The engine: index, search and look after one store."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import from_hex, split_index_name, to_hex
from ..operators import indexing, search, tools
from ..sources import ingest
from ..sources.schemas import CONTENT, REPLY
from ..sources.store import LARGEST, EngineConfig, Meta, Piece, Store
from .errors import BadRequest, Conflict, NotFound
from .request import Check, SearchRequest

#: How often a compaction is tried again after another was faster.
_TRIES = 5


@dataclass
class SearchResult:
    """`documents` is lazy. `completed` and `next_document_id` run the search; with a limit, its page is kept."""

    documents: DataFrame
    limit: int | None = None

    @property
    def rows(self) -> DataFrame:
        """The columns that a client gets, ascending by id: of a page that was fetched already, its rows."""
        if "_page" in self.__dict__ and self._page is not None:
            return self.documents.sparkSession.createDataFrame(self._page, REPLY)
        return search.reply(self.documents)

    @cached_property
    def _page(self) -> list[Row] | None:
        """The page's replies with their ids, where the request bounds their number."""
        if not self.limit:
            return None
        return search.reply(self.documents).collect()

    @cached_property
    def _state(self) -> tuple[bool, int]:
        if self._page is None:
            row = search.page_state(self.documents, None).first()
            return row.completed, row.next_document_id
        last = from_hex(self._page[-1].indexed_id) + 1 if self._page else 0
        return len(self._page) < self.limit, last

    @property
    def completed(self) -> bool:
        return self._state[0]

    @property
    def next_document_id(self) -> str:
        """Where the next request's cursor stands."""
        return to_hex(self._state[1])

    def to_json(self) -> str:
        """The reply of a request with a limit; without one the documents stay on the cluster: use `rows`."""
        if self._page is None:
            raise BadRequest("only a request with max_number gives a reply as text")
        ids = [r.asDict(recursive=True) for r in self._page]
        return json.dumps({"ids": ids, "completed": self.completed, "next_document_id": self.next_document_id}, indent=4, ensure_ascii=False)


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = Store(spark, path, self.config)

    def ping(self) -> bool:
        return True

    def index(self, request: DataFrame | str | bytes | dict) -> Meta:
        """Index a request, or rows (mbox, id, author, tsec, content, index, seq).

        Of a request whose n-th document is bad the earlier ones are indexed, and then the error is raised.
        """
        error = None
        if isinstance(request, DataFrame):
            rows = request
            for name in ("author", "tsec", "content", "seq"):
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(None))
            rows = rows.withColumns({"author": F.col("author").cast("string"), "tsec": F.col("tsec").cast("long"), "seq": F.col("seq").cast("long"), "content": F.col("content").cast(CONTENT)})
        else:
            read, error = ingest.read_request(request)
            if error and not read:
                raise error
            rows = ingest.to_rows(self.spark, read)
        # documents and postings are two jobs: what has no time gets one and the same
        rows = rows.withColumn("tsec", F.coalesce("tsec", F.lit(int(time.time())).cast("long")))
        meta = self.store.write(indexing.documents_of(rows), indexing.postings_of(rows, self.config.short, self.config.lowercase))
        if error:
            raise error
        return meta

    @property
    def postings(self) -> DataFrame:
        return self.store.postings()

    @property
    def documents(self) -> DataFrame:
        return self.store.documents()

    def search(self, request: str | bytes | dict | SearchRequest, check: Check | None = None) -> SearchResult:
        r = request if isinstance(request, SearchRequest) else SearchRequest.from_json(request, self.config.short, self.config.lowercase)
        meta = self.store.meta()
        found = search.search(self.store.table("postings", meta), self.store.table("documents", meta), r, check)
        return SearchResult(found, r.limit)

    def search_many(self, requests: dict[str, str | dict | SearchRequest]) -> DataFrame:
        """query_id, indexed_id for many requests of terms and ranges at once; phrases and limits need `search`."""
        read = {q: r if isinstance(r, SearchRequest) else SearchRequest.from_json(r, self.config.short, self.config.lowercase) for q, r in requests.items()}
        if any(r.phrases or r.limit for r in read.values()):
            raise BadRequest("search_many takes no phrases and no limits")
        return search.matching_many(self.postings, read)

    def get(self, indexed_id: str) -> Row:
        """A document by its id in hex."""
        value = from_hex(indexed_id)
        rows = self.store.table("documents").where((F.col("indexed_id") == value) & (F.col("shard") == value >> 32))
        found = rows.orderBy(F.col("batch").desc(), F.col("seq").desc()).first()
        if found is None:
            raise NotFound(f"no document {indexed_id}")
        return found

    def list(self, table: str) -> DataFrame:
        return tools.list_running(self._keys(table))

    def _keys(self, table: str) -> DataFrame:
        kinds = {"documents": lambda: tools.document_keys(self.documents), "postings": lambda: tools.posting_keys(self.postings)}
        if table not in kinds:
            raise BadRequest(f"no table {table!r}; there are {', '.join(kinds)}")
        return kinds[table]()

    def check(self, rates: bool = False) -> dict[str, DataFrame]:
        """What the check tool reports; with `rates`, counts how many documents and bytes were read a second."""
        documents = self.documents
        out = tools.check_documents(documents)
        if rates:
            out["rates"] = self._rates("check", tools.document_keys(documents))
        return out

    def _rates(self, step: str, keys: DataFrame) -> DataFrame:
        """One row: the step, keys, bytes, seconds, and keys and megabytes a second."""
        began = time.perf_counter()
        n, size = tools.list_totals(keys).first()
        return tools.rates(self.spark, [(step, n, size, time.perf_counter() - began)])

    def describe(self, index: str, dump: bool = False, save: str | None = None) -> dict[str, DataFrame]:
        """One index, named mailbox.attribute.token: its shards, totals and, if asked for, its documents.

        `save` is a folder that gets the index: its shards, its ids by shard and the merged list.
        """
        name = split_index_name(index)
        out = {"shards": tools.index_shard_counts(self.postings, *name), "merged": tools.index_merged(self.postings, *name)}
        if dump:
            out["documents"] = tools.index_dump(self.postings, self.store.table("documents"), *name)
        if save:
            tools.save_index(self.postings, *name, save)
        return out

    def compact(self, keep_seconds: float | None = 86_400.0) -> Meta:
        """Rewrite all pieces as one: each document's last write, each posting once. Pieces that no commit lists any more
        are removed once they are `keep_seconds` old (None: never)."""
        for _ in range(_TRIES):
            meta = self.store.meta()
            if not meta.live:
                return meta
            try:
                return self._compact_range(meta.live, 0, LARGEST, keep_seconds)[0]
            except Conflict:
                continue
        raise Conflict("other compactions were always faster")

    def compact_range(self, first: str, last: str, keep_seconds: float | None = 86_400.0) -> Meta:
        """Rewrite what has ids from `first` to `last` (hex, both included) as one piece; the rest stays where it is."""
        a, b = from_hex(first), from_hex(last)
        if a > b:
            raise BadRequest("the range ends before it begins")
        meta = self.store.meta()
        return self._compact_range(meta.live, a, b, keep_seconds)[0] if meta.live else meta

    def compact_chunks(self, max_bytes: int = 1 << 30, keep_seconds: float | None = 86_400.0) -> DataFrame:
        """Rewrite the store range by range, each of about `max_bytes` of documents and committed by itself, so that one
        that breaks off has lost a range's work at most. Gives the rates of each range and of all.

        Each range reads the postings once, so ranges should be few and large.
        """
        olds, done, first = self.store.meta().live, [], 0
        ends = [from_hex(r.last_key) for r in self.compaction_plan("documents", max_bytes).orderBy("chunk").select("last_key").collect()]  # a row per max_bytes
        for n, last in enumerate([*ends[:-1], LARGEST] if olds else []):
            began = time.perf_counter()
            meta, keys = self._compact_range(olds, first, last, None)
            count, size = tools.list_totals(keys).first()
            done.append((f"range {n}", count, size, time.perf_counter() - began))
            names = {p.name for p in olds}
            olds, first = tuple(p for p in meta.live if p.name in names), last + 1
        if keep_seconds is not None:
            self.store.vacuum(keep_seconds)
        done.append(("all", *(sum(x) for x in zip(*(d[1:] for d in done), strict=True))) if done else ("all", 0, 0, 0.0))
        return tools.rates(self.spark, done)

    def _compact_range(self, olds: tuple[Piece, ...], first: int, last: int, keep_seconds: float | None) -> tuple[Meta, DataFrame]:
        """The commit, and the keys of the documents that were rewritten."""
        part = Meta(live=olds)

        def within(rows: DataFrame) -> DataFrame:
            return search.in_range(rows, first, None if last == LARGEST else last)

        name = self.store.stage(within(self.store.documents(part)), within(self.store.table("postings", part)).distinct())
        meta = self.store.commit(name, olds, first, last)
        if keep_seconds is not None:
            self.store.vacuum(keep_seconds)
        new = Meta(live=tuple(p for p in meta.live if p.name == name))
        return meta, tools.document_keys(self.store.documents(new))

    def compaction_plan(self, table: str = "documents", max_bytes: int = 1 << 30) -> DataFrame:
        """Ranges of keys to rewrite one by one."""
        return tools.compact_chunks(self._keys(table), max_bytes)

    def merge(self, paths: list[str], compact: bool = False) -> DataFrame:
        """Take in other stores: postings as sets, documents of later inputs over those of earlier ones. With `compact`,
        all pieces are then rewritten as one. Gives the rates of each step."""
        if not paths:
            raise NotFound("nothing to merge")
        inputs = [Store(self.spark, p, EngineConfig(read_only=True)) for p in paths]
        documents = tools.merge_documents([s.documents() for s in inputs])
        began = time.perf_counter()
        meta = self.store.write(documents, tools.merge_postings([s.postings() for s in inputs]))
        seconds = time.perf_counter() - began
        n, size = tools.list_totals(tools.document_keys(self.store.documents(Meta(live=meta.live[-1:])))).first()
        steps = [("merge", n, size, seconds)]
        if compact:
            began = time.perf_counter()
            self.compact()
            n, size = tools.list_totals(tools.document_keys(self.documents)).first()
            steps.append(("compact", n, size, time.perf_counter() - began))
        return tools.rates(self.spark, steps)
