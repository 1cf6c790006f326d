"""The engine on the hand-made rows of FIXTURES.md, and against plain sets."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions.ids import to_hex
from inkwell.operators import indexing, search, tools
from inkwell.operators.ordered import greedy_chunks, with_previous, with_running
from inkwell.plans.engine import Engine
from inkwell.plans.errors import BadRequest, Conflict, EngineError, NotFound, ReadOnly
from inkwell.plans.request import SearchRequest
from inkwell.sources.store import EngineConfig
from inkwell.streaming.ingest import index_stream

DAY = 86_400
TEXTS = [("a", "m1", 100, "red green blue"), ("b", "m1", 100, "green red"), ("c", "m1", 101, "red  BLUE, red"), ("d", "m1", 102, "red green"), ("e", "m1", 103, "red green blue"), ("e", "m2", 103, "extra"), ("f", "m1", 103, "")]


def doc(id_, day, text):
    return {"id": id_, "timestamp": {"tsec": day * DAY, "tnsec": 5}, "content": {"content": text, "links": ["l", 3]}, "index": {"fulltext": text, "n": 7}}


def put(engine, *rows):
    for id_, mbox, day, text in rows:
        engine.index({"mailbox": mbox, "docs": [doc(id_, day, text)]})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    put(e, *TEXTS)
    return e


def req(query="red", mbox="m1", more=None, **other):
    return {"request": {mbox: {"query": {"fulltext": query}, **other}} | (more or {})}


def names(result):
    return [r.id for r in result.rows.collect()]


def test_ids(engine):
    rows = {(r.id): to_hex(r.indexed_id) for r in engine.documents.collect()}
    assert rows == {"a": "000000640cc175b9", "b": "0000006492eb5ffe", "c": "000000654a8a08f0", "d": "000000668277e091", "e": "00000067e1671797", "f": "000000678fa14cdd"}


@pytest.mark.parametrize(
    ("request_", "expected"),
    [
        (req("red green"), "a b d e"),
        (req(negation={"fulltext": "blue"}), "b d"),
        (req("red green", exact={"fulltext": "red green"}), "a d"),
        (req("red", more={"m2": {"query": {"fulltext": "extra"}}}), "e"),
        (req() | {"time": {"start": 100 * DAY + 5, "end": 102 * DAY + 86_399}}, "a b c"),
        (req("red blue", exact={"fulltext": "red blue"}), "c"),
        (req() | {"time": {"start": 102 * DAY}}, "d e"),
        (req() | {"time": {"start": 102 * DAY}, "paging": {"next_document_id": "000000640cc175b9"}}, "a b c d e"),
        (req("purple"), ""),
        (req("red", negation={"fulltext": "red"}), ""),
        ({"request": {}}, ""),
        (req() | {"paging": {"max_number": 0}}, "a b c d e"),
        (req() | {"paging": {"max_number": -1}}, "a b c d e"),
    ],
)
def test_searches(engine, request_, expected):
    result = engine.search(json.dumps(request_))
    assert names(result) == expected.split()
    assert result.completed


def test_many_terms(engine):
    words = " ".join(f"w{i}" for i in range(70))
    e = SearchRequest.from_json(req("red green", negation={"fulltext": words + " blue"}))
    assert names(engine.search(e)) == ["b", "d"]


def test_paging(engine):
    r = req() | {"paging": {"max_number": 2}}
    pages = []
    for _ in range(3):
        result = engine.search(r)
        pages.append((names(result), result.next_document_id, result.completed))
        r = req() | {"paging": {"max_number": 2, "next_document_id": result.next_document_id}}
    assert pages == [(["a", "b"], "0000006492eb5fff", False), (["c", "d"], "000000668277e092", False), (["e"], "00000067e1671798", True)]


def test_full_last_page(engine):
    result = engine.search(req() | {"paging": {"max_number": 5}})
    assert not result.completed
    rest = engine.search(req() | {"paging": {"max_number": 5, "next_document_id": result.next_document_id}})
    assert names(rest) == [] and rest.completed and rest.next_document_id == "0" * 16


def test_reply_text(engine):
    reply = json.loads(engine.search(req("extra", "m2") | {"paging": {"max_number": 3}}).to_json())
    assert reply["completed"] and reply["next_document_id"] == "00000067e1671798"
    assert reply["ids"] == [{"id": "e", "indexed_id": "00000067e1671797", "author": "", "content": {"content": "extra", "title": "", "links": ["l"], "images": []}, "relevance": 0.0, "timestamp": {"tsec": 103 * DAY, "tnsec": 0xE1671797}}]
    with pytest.raises(BadRequest):
        engine.search(req()).to_json()


@pytest.mark.parametrize("parts", [{"exact": {"fulltext": "red"}}, {"negation": {"fulltext": "red"}}, {"query": {"fulltext": " ,. "}}, {"query": {"fulltext": 5}}])
def test_no_positive_words(parts):
    with pytest.raises(NotFound) as e:
        SearchRequest.from_json({"request": {"m1": parts}})
    assert e.value.code == -2 and e.value.to_json()["error"]["code"] == -2


@pytest.mark.parametrize("text", ["", "[]", "{", '{"request": 5}', '{"request": {"m": 5}}', "{}"])
def test_bad_requests(text):
    with pytest.raises(BadRequest):
        SearchRequest.from_json(text)


def test_indexing_again(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    put(e, *TEXTS, ("a", "m1", 100, "yellow"))
    assert names(e.search(req("green"))) == ["a", "b", "d", "e"]
    assert names(e.search(req("green", exact={"fulltext": "green"}))) == ["b", "d"]
    put(e, ("b", "m1", 105, "green red"))
    found = [r.indexed_id for r in e.search(req("green")).rows.collect()]
    assert len(found) == 5 and found[-1].startswith("00000069")
    before = sorted(e.postings.distinct().collect())
    e.compact(keep_seconds=0)
    assert [p.number for p in e.store.meta().live] == [9] and sorted(e.postings.collect()) == before
    assert len(list((tmp_path / "s" / "documents").iterdir())) == 1
    assert names(e.search(req("green"))) == ["a", "b", "d", "e", "b"]
    assert {r.id: r.indexed_id for r in indexing.document_ids(e.store.table("documents")).collect()}["b"] >> 32 == 105


def test_bad_document_stops(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    with pytest.raises(EngineError):
        e.index({"mailbox": "m", "docs": [doc("x", 1, "one"), {"id": 5}, doc("y", 1, "one")]})
    assert names(e.search(req("one", "m"))) == ["x"]
    for bad in ({"docs": []}, {"mailbox": "m", "docs": []}, {"mailbox": "m", "docs": [{"id": "z"}]}, "{"):
        with pytest.raises(EngineError):
            e.index(bad)


def test_read_only_and_missing(spark, tmp_path, engine):
    e = Engine(spark, str(tmp_path / "none"), EngineConfig(read_only=True))
    assert names(e.search(req())) == []
    with pytest.raises(ReadOnly):
        put(e, TEXTS[0])
    with pytest.raises(NotFound):
        engine.get("00000000000000ff")
    assert engine.get("000000640cc175b9").id == "a" and engine.ping()


def test_config():
    c = EngineConfig.from_json('{"read_only": true, "short": 3}')
    assert (c.read_only, c.short, c.codec) == (True, 3, EngineConfig().codec)
    for bad in ("{", "[]", '{"short": "3"}', '{"nothing": 1}', '{"short": true}'):
        with pytest.raises(BadRequest):
            EngineConfig.from_json(bad)


def test_tools(spark, engine, tmp_path):
    assert [(r.shard, r.n_ids) for r in engine.describe("m1.fulltext.red")["shards"].orderBy("shard").collect()] == [(100, 2), (101, 1), (102, 1), (103, 1)]
    assert engine.describe("m1.fulltext.red", dump=True, save=str(tmp_path / "saved"))["documents"].count() == 5
    saved = {n: spark.read.parquet(str(tmp_path / "saved" / n)) for n in ("shards", "ids", "merged")}
    assert [tuple(r) for r in saved["shards"].orderBy("shard").collect()] == [(100, 2), (101, 1), (102, 1), (103, 1)]
    ids = [r.indexed_id for r in saved["merged"].orderBy("indexed_id").collect()]
    assert len(ids) == 5 and sorted(ids) == sorted(r.indexed_id for r in saved["ids"].collect()) and saved["ids"].where("shard = 100").count() == 2
    tools.save_index(engine.postings, "m1", "fulltext", "red", str(tmp_path / "text"), separator=";")
    assert {r.value for r in spark.read.text(str(tmp_path / "text" / "shards")).collect()} == {"100;2", "101;1", "102;1", "103;1"}
    rates = engine.check(rates=True)["rates"].first()
    assert (rates.step, rates.n_keys) == ("check", 6) and rates.keys_per_second > 0
    checked = engine.check()
    assert checked["out_of_order"].count() == 0 and checked["boundaries"].count() == 3 and checked["large"].count() == 0
    assert [r.number for r in engine.list("documents").orderBy("key").collect()] == list(range(1, 7))
    with pytest.raises(BadRequest):
        engine.list("nothing")


def state(e):
    return sorted((r.id, r.indexed_id, r.content.content) for r in e.documents.collect()), sorted(map(tuple, e.postings.distinct().collect()))


def stage(e, *rows):
    from inkwell.sources import ingest

    read = [r for id_, mbox, day, text in rows for r in ingest.read_request({"mailbox": mbox, "docs": [doc(id_, day, text)]})[0]]
    df = ingest.to_rows(e.spark, read)
    return e.store.stage(indexing.documents_of(df), indexing.postings_of(df))


def test_racing_writers(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "s")), Engine(spark, str(tmp_path / "s"))
    put(a, ("o", "m", 1, "old"))
    # both write before either commits; a compaction starts before both and commits between them
    olds = a.store.meta().live
    compacted = a.store.stage(a.store.documents(), a.store.postings().distinct())
    one, two = stage(a, ("x", "m", 1, "from a"), ("o", "m", 1, "newer")), stage(b, ("y", "m", 1, "from b"), ("x", "m", 1, "later"))
    a.store.commit(one)
    a.store.commit(compacted, olds)
    meta = b.store.commit(two)
    assert sorted(p.number for p in meta.live) == [1, 2, 4] and len({p.name for p in meta.live}) == 3
    assert sorted((r.id, r.content.content) for r in b.documents.collect()) == [("o", "newer"), ("x", "later"), ("y", "from b")]
    assert sorted(names(a.search(req("from", "m")))) == ["x", "y"]
    # two compactions of the same pieces: the second is told, and nothing is lost
    again = a.store.stage(a.store.documents(), a.store.postings().distinct())
    b.compact()
    with pytest.raises(Conflict):
        a.store.commit(again, meta.live)
    assert sorted(r.id for r in a.documents.collect()) == ["o", "x", "y"] and len(a.store.meta().live) == 1


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def work(k):
        e = Engine(spark, str(tmp_path / "s"))
        put(e, (f"d{k}", "m", k, f"text {k}"))
        if k % 3 == 0:
            e.compact(keep_seconds=None)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(work, range(6)))
    e = Engine(spark, str(tmp_path / "s"))
    assert sorted(r.id for r in e.documents.collect()) == [f"d{k}" for k in range(6)]
    assert len(names(e.search(req("text", "m")))) == 6


def test_range_compaction(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    put(e, *TEXTS, ("a", "m1", 100, "yellow"), ("d", "m1", 102, "red"))
    before = state(e)
    e.compact_range(to_hex(101 << 32), to_hex((102 << 32) + (1 << 32) - 1))
    assert state(e) == before
    inside = {p.name for p in e.store.meta().live if not p.hidden}
    assert len(inside) == 1 and sum(1 for p in e.store.meta().live if p.hidden == ((101 << 32, (103 << 32) - 1),)) == 9
    put(e, ("c", "m1", 101, "newest"))  # a later write is not hidden
    assert names(e.search(req("newest"))) == ["c"]
    before = state(e)
    done = e.compact_chunks(max_bytes=12, keep_seconds=0)
    steps = [(r.step, r.n_keys) for r in done.collect()]
    assert state(e) == before and len(steps) > 3 and steps[-1] == ("all", 6)
    assert not any(p.name in inside for p in e.store.meta().live)
    e.compact(keep_seconds=0)
    assert state(e) == before and len(e.store.meta().live) == 1
    with pytest.raises(BadRequest):
        e.compact_range("2", "1")


def test_limited_search_reads_the_page_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    put(e, *TEXTS)
    put(e, ("a", "m1", 100, "red again"))
    found = e.search(req() | {"paging": {"max_number": 2}}).documents
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    scans = [s for s in found._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:] if "PartitionFilters" in s]
    reads = [s.split("ReadSchema: ")[1].split(chr(10))[0] for s in scans]
    assert sum("content" in r for r in reads) == 1 and "GlobalLimit 2" in plan
    # contents are in no aggregate, also where an id was written twice
    assert not any("content" in line for line in plan.split(chr(10)) if "Aggregate" in line)
    assert [r.content.content for r in found.collect()] == ["red again", "green red"]
    shards = tools.shard_documents(e.documents)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in shards


@pytest.mark.parametrize("slices", [(1, 2), (512, 16_384)])
def test_limits_with_filters(engine, slices, monkeypatch):
    monkeypatch.setattr(search, "SLICES", slices)
    limited = {"paging": {"max_number": 2}}
    assert names(engine.search(req("red green", exact={"fulltext": "red green"}) | limited)) == ["a", "d"]
    assert names(engine.search(req("red blue", exact={"fulltext": "red blue"}) | limited)) == ["c"]
    assert names(engine.search(req() | limited, check=lambda d: d.id > "c")) == ["d", "e"]


def test_check_sets_relevance(engine):
    rows = engine.search(req(), check=lambda d: (d.id != "b", F.length(d["content.content"]) / 2)).rows.collect()
    assert [(r.id, r.relevance) for r in rows] == [("a", 7.0), ("c", 7.0), ("d", 4.5), ("e", 2.5)]
    page = engine.search(req() | {"paging": {"max_number": 1}}, check=lambda d: (d.id != "a", F.lit(3)))
    assert json.loads(page.to_json())["ids"][0]["relevance"] == 3.0 and page.rows.first().relevance == 3.0


def test_one_time_for_a_request(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.index({"mailbox": "m", "docs": [{"id": "now", "index": {"fulltext": "red"}}]})
    assert names(e.search(req("red", "m"))) == ["now"]


def test_merge(spark, tmp_path):
    a, b, out = (Engine(spark, str(tmp_path / n)) for n in "abo")
    put(a, ("x", "m", 1, "one two"))
    put(b, ("x", "m", 1, "three"), ("y", "m", 2, "two"))
    out.merge([a.store.path, b.store.path])
    assert names(out.search(req("two", "m"))) == ["x", "y"]
    assert names(out.search(req("one", "m", exact={"fulltext": "three"}))) == ["x"]
    once = sorted(out.postings.distinct().collect())
    steps = out.merge([b.store.path, a.store.path], compact=True)
    assert [(r.step, r.n_keys) for r in steps.collect()] == [("merge", 2), ("compact", 2)] and len(out.store.meta().live) == 1
    assert sorted(out.postings.distinct().collect()) == once
    with pytest.raises(NotFound):
        out.merge([])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join([json.dumps({"mailbox": m, "docs": [doc(i, d, t), {"id": 4}]}) for i, m, d, t in TEXTS] + ["junk", '{"mailbox": 3}']))
    e = Engine(spark, str(tmp_path / "s"))
    index_stream(e, spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert names(e.search(req("red green"))) == ["a", "b", "d", "e"]


def test_search_many(engine):
    found = engine.search_many({"p": req("red green"), "q": req(negation={"fulltext": "blue"}), "r": req("purple")})
    ids = {r.indexed_id: r.id for r in engine.documents.select("indexed_id", "id").collect()}
    assert sorted((r.query_id, ids[r.indexed_id]) for r in found.collect()) == [("p", "a"), ("p", "b"), ("p", "d"), ("p", "e"), ("q", "b"), ("q", "d")]


def test_worked_example(spark):
    lists = {"w": "02345", "x": "234", "y": "345", "z": "345"}
    postings = spark.createDataFrame([("m", "t", w, 0, int(d)) for w, ds in lists.items() for d in ds], "mbox string, attr string, token string, shard long, indexed_id long")
    r = SearchRequest(positive=[("m", "t", w) for w in lists])
    for f in (search.matching_ids, search.chained_ids):
        assert sorted(x.indexed_id for x in f(postings, r).collect()) == [3, 4]
    merged = tools.merge_postings([postings, postings.limit(3)])
    assert sorted(merged.collect()) == sorted(postings.collect())


def test_pushdown(engine):
    plan = engine.search(req("red green"))._page is None and search.matching_ids(engine.postings, SearchRequest.from_json(req("red green")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(mbox,m1)" in plan and "token" in plan.split("PushedFilters")[1] and plan.count("Exchange") == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcd"), max_size=4), min_size=1, max_size=12), st.sets(st.sampled_from("abcd"), min_size=1, max_size=3), st.sets(st.sampled_from("abcd"), max_size=2))
def test_against_sets(spark, docs, want, deny):
    rows = [("m", "t", w, 0, i) for i, ws in enumerate(docs) for w in ws] * 2
    postings = spark.createDataFrame(rows, "mbox string, attr string, token string, shard long, indexed_id long")
    r = SearchRequest(positive=[("m", "t", w) for w in want], negative=[("m", "t", w) for w in deny])
    expected = [i for i, ws in enumerate(docs) if want <= ws and not deny & ws]
    assert sorted(x.indexed_id for x in search.matching_ids(postings, r).collect()) == expected
    assert sorted(x.indexed_id for x in search.chained_ids(postings, r).collect()) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 400))
def test_ordered(spark, sizes, limit):
    df = spark.createDataFrame([(f"{i:04d}", n) for i, n in enumerate(sizes)], "key string, bytes long").repartition(4)
    expected, chunk, filled = [], 0, 0
    for n in sizes:
        expected.append(chunk)
        filled += n
        if filled >= limit:
            chunk, filled = chunk + 1, 0
    assert [r.chunk for r in greedy_chunks(df, ["key"], "bytes", limit).orderBy("key").collect()] == expected
    running = with_running(df, ["key"], "n", {"total": "bytes"}).orderBy("key").collect()
    assert [(r.n, r.total) for r in running] == [(i + 1, sum(sizes[: i + 1])) for i in range(len(sizes))]
    assert [r.p for r in with_previous(df, ["key"], "bytes", "p").orderBy("key").collect()] == [None, *sizes[:-1]]


def test_two_documents_of_one_hash(spark, tmp_path):
    """doc123918 and doc168108 have the same 32 bits of MD5: on one day they share an id and are two documents all the same."""
    e = Engine(spark, str(tmp_path / "s"))
    put(e, ("doc123918", "m", 100, "red one"), ("doc168108", "m", 100, "red two"))
    assert names(e.search(req(mbox="m"))) == ["doc123918", "doc168108"]
    assert names(e.search(req("two", mbox="m", exact={"fulltext": "two"}))) == ["doc168108"]
    assert names(e.search({**req(mbox="m"), "paging": {"max_number": 2}})) == ["doc123918", "doc168108"]
    put(e, ("doc123918", "m", 100, "red three"))
    wanted = [("doc123918", "red three"), ("doc168108", "red two")]
    for _ in range(2):
        assert sorted((r.id, r.content.content) for r in e.documents.collect()) == wanted
        assert sorted((r.id, r.content.content) for r in e.search(req(mbox="m")).rows.collect()) == wanted
        e.compact(None)


def test_tables_are_written_one_by_one(spark, tmp_path):
    """What reads documents alone does not wait for postings, and the other way round; together they are a store."""
    from inkwell.plans import catalog
    from inkwell.sources import files

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "the and from", "en", "src7"), (2, "the", "en", "src1")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    s = catalog.store(spark, folder, "documents")
    assert catalog.QUERIES["list_totals"](spark, folder).first().n_keys == 2
    assert files.list_names(spark, f"{s.path}/postings") == []
    assert catalog.QUERIES["and_search"](spark, folder).count() == 1
    assert catalog.QUERIES["search_documents"](spark, folder).count() == 1
    assert [p.tables for p in s.meta().live] == [("documents",), ("postings",)] and s.documents().count() == 2


def test_tasks_grow_with_the_input(spark, tmp_path):
    from inkwell.sources.files import dealt, input_bytes

    spark.range(100_000).selectExpr("id", "uuid() AS x").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = input_bytes(df)
    assert size > 1_000_000 and input_bytes(df.unionByName(df)) == 2 * size
    one, two = (dealt(x, 100_000, "id").rdd.getNumPartitions() for x in (df, df.unionByName(df)))
    assert one == -(-size // 100_000) and two == -(-2 * size // 100_000)
    assert sorted(dealt(df.limit(50), 100_000, "id", ranged=True).collect()) == sorted(df.limit(50).collect())
    assert input_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")) is None


def test_texts_are_cut_before_a_shuffle(spark, smoke_dir):
    """Dealing postings out in ranges runs what is below the last shuffle twice: arrays become rows, no texts are cut."""
    from inkwell.sources import corpus

    plan = indexing.postings_of(corpus.document_rows(spark, smoke_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(tokens") < plan.index("Exchange hashpartitioning(indexed_id") < plan.index("split(")


def test_sets_of_postings(spark):
    """Copies are dropped, wherever they lie; of all plans none keeps a table of rows before its shuffle."""
    from inkwell.plans import catalog

    rows = [("m", "t", f"w{i % 7}", i % 3, (i % 3) << 32 | i % 11) for i in range(300)]
    postings = spark.createDataFrame(rows * 2, "mbox string, attr string, token string, shard long, indexed_id long").repartition(5)
    order = sorted({(s, m, a, t, i) for m, a, t, s, i in rows})
    assert list(map(tuple, catalog.scan_postings(postings).collect())) == order
    assert sorted(map(tuple, tools.merge_postings([postings, postings]).collect())) == sorted(set(rows))
    days = sorted({r[:4] for r in rows})
    assert sorted(map(tuple, indexing.token_days(postings).collect())) == days
    assert sorted(r.key for r in catalog.index_key(postings).collect()) == sorted(f"{s:016x}.{m}.{a}.{t}" for m, a, t, s in days)
    for df in (catalog.scan_postings(postings), tools.merge_postings([postings, postings]), catalog.index_key(postings)):
        below = df._jdf.queryExecution().executedPlan().toString().split("+- Exchange", 1)[1]
        assert "Aggregate" not in below


@pytest.mark.parametrize("short", [0, 3])
def test_positions(spark, short):
    """Positions of texts by hand: of one document that comes twice all, ascending; and no row for an occurrence is shuffled."""
    texts = [("a", "red a of Red; red"), ("a", "of red"), ("b", ""), ("c", "Ünï ünï x"), ("d", " ".join(f"w{i % 50}" for i in range(3_000)))]
    rows = spark.createDataFrame([("m", i, "", 100 * DAY, {"t": t, "none": None}, 0) for i, t in texts], "mbox string, id string, author string, tsec long, index map<string,string>, seq long")
    expected = {}
    for i, t in texts:
        ws = t.lower().replace(";", "").split()
        for k, w in enumerate(ws):
            joined = [a + b for a, b in ((ws[k - 1] if k else "", w), (w, ws[k + 1] if k + 1 < len(ws) else "")) if a and b]
            for token in [w] if len(w) >= short else joined:
                expected.setdefault((i, token), []).append(k)
    df = indexing.token_positions(rows, short)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Exchange") and plan.count("Exchange") == 1
    names_ = {r.indexed_id: r.id for r in indexing.with_ids(rows).collect()}
    assert {(names_[r.indexed_id], r.token): r.positions for r in df.collect()} == {k: sorted(v) for k, v in expected.items()}
