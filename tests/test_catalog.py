import uuid

import pytest
from pyspark.sql import functions as F

from corvid.catalog import Catalog, Control
from corvid.engine import Engine
from corvid.functions import guards
from corvid.functions import text as t
from corvid.model import EngineError, ObjectConfig
from corvid.operators import browse, chunk, crawl, index, jobs, keys, order, search
from corvid.operators.postings import Postings
from corvid.session import shared_folder
from corvid.sources import flatten, registry
from corvid.streaming import feed


def folder(spark):
    return f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"


def listing(spark, rows):
    return spark.createDataFrame(rows, "object_uri string, content string")


def summary(df):
    return {(r.change, r.action): r.n for r in df.collect()}


def test_add_resync_rename_delete(spark):
    own = Catalog(spark, folder(spark), buckets=4)
    first = own.add("docs://a", listing(spark, [("docs://a/x.md", "alpha beta"), ("docs://a/y.md", "gamma"), ("docs://a/z.py", "def f():\n    pass"), ("docs://a/e.md", " "), ("docs://a/b.bin", "binary")]))
    assert summary(first) == {("added", "pipeline"): 4, ("added", "metadata"): 1}
    own.add("docs://b", listing(spark, [("docs://b/other.md", "alpha elsewhere")]))
    assert {r.object_uri: (r.search_status, r.chunk_count) for r in own.objects.read().collect()} == {"docs://a/x.md": ("indexed", 1), "docs://a/y.md": ("indexed", 1), "docs://a/z.py": ("indexed", 1), "docs://a/e.md": ("not_indexed", 0), "docs://a/b.bin": ("not_indexed", 0), "docs://b/other.md": ("indexed", 1)}
    told = []
    second = own.add("docs://a", listing(spark, [("docs://a/x.md", "alpha changed"), ("docs://a/moved/y.md", "gamma"), ("docs://a/e.md", " "), ("docs://a/b.bin", "binary"), ("docs://a/new.md", "delta")]), on_success=lambda df: told.append(summary(df)))
    want = {("modified", "pipeline"): 1, ("renamed", "rename"): 1, ("unchanged", "keep"): 2, ("added", "pipeline"): 1, ("deleted", "delete"): 1}
    assert summary(second) == want and told == [want]
    assert sorted((r.object_uri, r.content) for r in own.chunks.read().collect()) == [("docs://a/moved/y.md", "gamma"), ("docs://a/new.md", "delta"), ("docs://a/x.md", "alpha changed"), ("docs://b/other.md", "alpha elsewhere")]
    assert all(len(r.dense_vec) == 64 for r in own.chunks.read().collect()) and own.cache.read().count() == 6
    engine = own.engine(["docs://a", "docs://b"])
    assert {h.source for h in engine.search("alpha", mode="keyword").collect()} == {"docs://a/x.md", "docs://b/other.md"}
    assert [h.source for h in engine.search("gamma", mode="hybrid").collect()][0] == "docs://a/moved/y.md"
    assert engine.search("beta", mode="keyword").collect() == []
    again = own.add("docs://a", listing(spark, [("docs://a/x.md", "alpha changed")]), incremental=True)
    assert summary(again) == {("unchanged", "keep"): 1} and own.chunks.read().count() == 4
    own.remove("docs://a")
    assert [r.object_uri for r in own.objects.read().collect()] == ["docs://b/other.md"]
    assert [h.source for h in own.engine(["docs://b"]).search("alpha", mode="keyword").collect()] == ["docs://b/other.md"]


def test_snapshots_rewrite_touched_buckets_only(spark):
    schema = spark.createDataFrame([], "object_uri string, n int").schema
    table = index.Snapshots(spark, folder(spark), schema, buckets=8)
    rows = spark.createDataFrame([(f"u{i}", i) for i in range(100)], schema)
    assert table.commit(rows) == 1
    before = table.folders()
    new = spark.createDataFrame([("u7", -7)], schema)
    assert table.merge(new, lambda current: index.upsert(current, new, "object_uri")) == 2
    after = table.folders()
    assert sum(before[k] != after[k] for k in before) == 1
    assert table.read().where("object_uri = 'u7'").first().n == -7 and table.read().count() == 100
    slow = table.ledger.begin()  # a writer that hasn't seen version 3
    table.merge(new, lambda current: index.upsert(current, new, "object_uri"))
    table.commit(rows, slow)
    with pytest.raises(EngineError, match="version_conflict"):
        slow.commit()
    assert table.version() == 3 and table.ledger.names("_intents") == []
    table.vacuum()
    assert table.read().count() == 100


def test_postings_equal_a_scan_after_replacing_and_compacting(spark):
    rows = spark.createDataFrame([(f"c{i}", f"u{i % 7}", "docs://a", "body", " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + ["w"] * (i % 5))) for i in range(60)], "chunk_id string, object_uri string, connector_uri string, chunk_kind string, content string")
    own = Postings(spark, folder(spark))
    assert own.bm25("alpha").collect() == []
    own.add(rows.withColumn("content", F.concat(F.lit("alpha "), "content")))
    own.add(rows.where("object_uri <> 'u3'"), rows.withColumn("content", F.concat(F.lit("alpha "), "content")))
    living = rows.where("object_uri <> 'u3'")
    for _ in range(2):
        for where in (None, search.in_scope("docs://a", kinds=["body"])):
            assert own.bm25("Alpha, beta?", where, 20).collect() == search.bm25(living, "alpha beta", where, 20).collect()
        own.compact()


def test_text_chunks_tell_pieces_of_one_line_apart(spark):
    long = "x" * 5000
    df = listing(spark, [("u", f"# A\n{long}\nend"), ("e", " \n"), ("n", None)]).withColumn("connector_uri", F.lit("docs://a"))
    made = chunk.located_chunks(df, size=2048).orderBy("chunk_index").collect()
    assert "".join(r.content for r in made) == f"# A\n{long}\nend" and len({r.chunk_id for r in made}) == len(made) == 4
    assert [r.locator for r in made] == ['{"lines":[1,2]}', '{"chunk_index":1,"lines":[2,3]}', '{"chunk_index":2,"lines":[2,3]}', '{"lines":[2,4]}']
    assert [r.partial for r in chunk.text_chunks(df, size=2048, most=2).collect()] == [True, True]
    assert [b for _, b in chunk.split_text("aa bb. cc dd! ee", 8)] == [7, 14, 16] and chunk.split_text("ab", 5) == [(0, 2)] and chunk.split_text("", 5) == []


def test_record_chunks(spark):
    records = spark.createDataFrame([(1, "short", ["a", "b"], True), (2, "word " * 900, None, None), (3, " ", [], False)], "id int, body string, tags array<string>, open boolean")
    config = ObjectConfig(["body"], ["open", "tags[*]"], ["id"])
    made = chunk.record_chunks(records, "db://t/rows.jsonl", config).collect()
    assert {r.locator: r.metadata for r in made if r.chunk_index == 0} == {'{"id":1}': '{"open":true,"tags[*]":["a","b"]}', '{"chunk_index":0,"id":2}': '{"open":null,"tags[*]":[]}'}
    assert "".join(r.content for r in sorted(made, key=lambda r: r.chunk_index) if '"id":2' in r.locator) == "word " * 900
    capped = chunk.record_chunks(records, "db://t/rows.jsonl", ObjectConfig(["body"], [], ["id"], chunk_max=1), order=["id"]).collect()
    assert [(r.locator, r.partial) for r in capped] == [('{"id":1}', True)]
    seen = {r.field: r.seen for r in chunk.missing_fields(records, ["body", "tags[].x", "nope"]).collect()}
    assert seen == {"body": True, "tags[].x": True, "nope": False}
    with pytest.raises(EngineError):
        chunk.thread_key(records.select("body"))


def test_reading_records_and_errors(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string").repartition(5)
    objects = spark.createDataFrame([("db://t", "db://t/rows.jsonl", "", "indexed"), ("db://t", "db://t/p.png", "x", "indexed"), ("db://t", "db://t/a.md", "one\ntwo\nthree", "indexed")], "connector_uri string, object_uri string, content string, search_status string")
    engine = Engine(["db://t"], objects, objects, records={"db://t/rows.jsonl": (rows, ["id"], ["id"])})
    content = lambda df: [r.content for r in df.collect()]
    assert content(engine.cat("db://t/rows.jsonl", locator='{"id":"7"}')) == ['{"id":7,"name":"n7"}']
    assert content(engine.cat("db://t/rows.jsonl", lines="3:5")) == ['{"id":2,"name":"n2"}', '{"id":3,"name":"n3"}'] == content(engine.head("db://t/rows.jsonl", 4))[2:]
    assert len(content(engine.cat("db://t/rows.jsonl"))) == 50 and content(engine.cat("db://t/a.md", locator='{"chunk_index":1,"lines":[2,3]}')) == ["two"]
    for code, call in {"locator_not_found": lambda: engine.cat("db://t/rows.jsonl", locator='{"id":99}'), "tail_unsupported": lambda: engine.tail("db://t/rows.jsonl"), "range_unsupported": lambda: engine.cat("db://t/p.png", lines="1:2")}.items():
        with pytest.raises(EngineError, match=code):
            call()
    to = folder(spark)
    assert engine.export("db://t/rows.jsonl", to, 7) is True and sorted(r.id for r in spark.read.json(to).collect()) == list(range(7))
    assert engine.export("db://t/rows.jsonl", to) is False and spark.read.json(to).count() == 50
    with pytest.raises(EngineError, match="missing_option"):
        browse.export(rows, to, 3)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="dimension_mismatch"):
        search.dense(vectors, [1.0, 2.0]).collect()


def test_positions_and_sums_over_several_tasks(spark):
    rows = spark.createDataFrame([((i * 37) % 1000, i % 5) for i in range(1000)], "k int, v int").repartition(6)
    got = {r.k: (r._row, r.before) for r in order.sums_before(order.positions(rows, ["k"]), ["k"], "v", "before").collect()}
    value, total = {(i * 37) % 1000: i % 5 for i in range(1000)}, 0
    for k in range(1000):
        assert got[k] == (k, total)
        total += value[k]
    assert [r.k for r in browse.page(rows, ["k"], 17_000, 17_005).collect()] == [] and keys.primary_key(rows) == ["k"]


def test_json_text_names_and_secrets(spark):
    df = spark.createDataFrame([('a\tb\r\n"\\\x01é',), ("",), (None,)], "v string")
    import json

    assert [r[0] and json.loads(r[0]) for r in df.select(t.json_text(F.col("v"))).collect()] == ['a\tb\r\n"\\\x01é', "", None]
    names = spark.createDataFrame([("a b/ç!", "1"), ("--", "2"), (None, "3")], "n string, i string").select(t.safe_name(F.col("n"), F.col("i")), t.rfc3339(F.lit("2024-05-01")))
    assert [tuple(r) for r in names.collect()] == [("a-b-ç__1", "2024-05-01T00:00:00"), ("unnamed__2", "2024-05-01T00:00:00"), ("unnamed__3", "2024-05-01T00:00:00")]
    assert guards.has_password("see db://u:p@h/x now") and not guards.has_password("http://h/a:b@c mail u@h") and not guards.has_password("http://[bad")
    assert guards.target("github:owner/repo") == ("github", "github://owner/repo")


def test_control(spark):
    tasks = spark.createDataFrame([(1, 1, "running", 0, None), (2, 1, "succeeded", 0, None), (3, 2, "running", 1, None), (4, 2, "failed", 1, "timeout"), (5, 2, "failed", 3, "timeout"), (6, 2, "failed", 0, "401")], "id int, job_id int, status string, attempts int, error string")
    own = spark.createDataFrame([(1, "running", 5), (2, "queued", 3), (3, "succeeded", 1), (4, "queued", 2)], "id int, status string, queued_at int")
    after = Control(own, tasks).cancel(1)
    assert {r.id: r.status for r in after.tasks.collect()}[1] == "cancelled" and {r.id: r.status for r in after.jobs.collect()}[1] == "cancelled"
    assert Control(own, tasks).show(2).first().failed == 3
    for bad in (3, 9):
        with pytest.raises(EngineError):
            Control(own, tasks).cancel(bad)
    assert [r.id for r in jobs.oldest_queued(own).collect()] == [4, 2]
    assert {r.id: r.status for r in jobs.requeued(tasks, spark.createDataFrame([(2,)], "job_id int")).collect()} == {1: "running", 2: "succeeded", 3: "pending", 4: "failed", 5: "failed", 6: "failed"}
    assert {r.id: (r.next, r.wait) for r in jobs.retried(tasks).where("status = 'failed'").collect()} == {4: ("pending", 2.0), 5: ("failed", None), 6: ("abort", None)}


def test_conditional_crawl_keeps_links_and_state(spark):
    stored = spark.createDataFrame([("a", "1", ["x"]), ("b", "1", ["y"]), ("c", "1", ["z"]), ("g", "1", ["w"])], "url string, etag string, links array<string>")
    now = spark.createDataFrame([("a", 304, None, None), ("b", 200, "2", ["q"]), ("c", 500, None, None), ("d", 200, "1", [])], "url string, status int, etag string, links array<string>")
    got = {r.url: (r.change, r.etag, r.links) for r in crawl.conditional(now, stored).collect()}
    assert got == {"a": ("unchanged", "1", ["x"]), "b": ("modified", "2", ["q"]), "c": ("failed", "1", ["z"]), "d": ("added", "1", []), "g": ("not_visited", "1", ["w"])}


def test_streams(spark):
    work = folder(spark)
    schema = spark.createDataFrame([], "chunk_id string, object_uri string, content string").schema
    for k in range(3):
        spark.createDataFrame([(f"c{k}", "u", f"text {k}"), (f"d{k}", f"v{k}", "more")], schema).coalesce(1).write.mode("append").parquet(f"{work}/in")
    table, done, watcher = index.Snapshots(spark, f"{work}/t", schema, buckets=4), [], feed.Watcher()
    spark.streams.addListener(watcher)
    try:
        feed.sync(feed.bounded(spark, f"{work}/in", schema, 1), table, f"{work}/c", whole_objects=False, on_success=lambda n, v: done.append((n, v)))
        import time

        for _ in range(50):
            if watcher.ended:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watcher)
    assert done == [(0, 1), (1, 2), (2, 3)] and table.read().count() == 6
    assert sum(rows for _, rows, _ in watcher.progress.values()) > 0 and list(watcher.ended.values()) == [None]
    query = feed.sync(feed.bounded(spark, f"{work}/in", schema), table, f"{work}/c2", seconds=1)
    query.processAllAvailable()
    query.stop()
    assert table.read().count() == 6


def test_sources_by_scheme(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def alpha():\n    return 1\n")
    (tmp_path / "README.md").write_text("# Read me\nalpha text")
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    own = Catalog(spark, folder(spark), buckets=4)
    tree = registry.source_of("file")(str(tmp_path))
    assert summary(own.sync(f"file://local{tmp_path}", tree)) == {("added", "pipeline"): 3}
    rows = spark.createDataFrame([(i, f"name {i}", "alpha " * (i % 3)) for i in range(30)], "id int, name string, note string")
    tables = registry.Tables("postgres://db", {"people": lambda s: rows}, {"people": ["id"]}, max_read_rows=20)
    own.sync("postgres://db", tables)
    state = {r.object_uri: (r.search_status, r.chunk_count) for r in own.objects.read().where("connector_uri = 'postgres://db'").collect()}
    assert state == {"postgres://db/people/rows.jsonl": ("partial", 20), "postgres://db/people/schema.json": ("indexed", 1)}
    hit = own.engine(["postgres://db", f"file://local{tmp_path}"]).search("name 7", "postgres://db", "keyword", 1).first()
    assert hit.locator == '{"id":7}' and hit.metadata == '{"chunk_kind":"row_text","fields":{},"kind":"search"}'
    assert summary(own.sync("postgres://db", tables)) == {("unchanged", "keep"): 2}
    with pytest.raises(EngineError):
        registry.source_of("nope")
    registry.register_source("mine", registry.Pages)
    assert registry.source_of("mine") is registry.Pages and "gmail" in registry.schemes() and registry.detection_of("slack") == "never"
    pages = registry.Pages(lambda s: s.createDataFrame([("http://h/a", "<h1>T</h1>alpha")], "url string, html string"))
    assert [tuple(r) for r in pages.listing(spark).collect()] == [("web://crawl/pages/h/a.md", "document", "\n# T\nalpha")]
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "m.jsonl").write_text('{"text": "hello"}\n{"text": "bye"}')
    chat = registry.RecordFolder("slack://w", f"file://{tmp_path}/rec")
    assert [r.object_uri for r in chat.listing(spark).collect()] == ["slack://w/m.jsonl"] and chat.records(spark, "slack://w/m.jsonl")[0].count() == 2


def test_more_flatteners(spark):
    chat = spark.createDataFrame([("1.5", None), ("2.5", "1.5")], "ts string, thread_ts string")
    assert [(r.ts, r.thread_ts) for r in flatten.slack_messages(chat, 2.0).collect()] == [("2.5", "1.5")]
    pull = spark.createDataFrame([(1, "t", None, "open", None, ("ann",), [("bug",)], None, "now")], "number int, title string, body string, state string, draft boolean, user struct<login:string>, labels array<struct<name:string>>, merged_at string, updated_at string")
    assert [(r.author, r.labels, r.draft, r.body) for r in flatten.github_pulls(pull).collect()] == [("ann", ["bug"], False, "")]
    users = spark.createDataFrame([("1", "A", "a@x", None)], "id string, name string, email string, active boolean")
    assert flatten.linear_users(users).first().active is True
    kind = "p struct<type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,number:double,select:struct<name:string>,multi_select:array<struct<name:string>>,checkbox:boolean,date:struct<start:string>,url:string>"
    none = (None,) * 8
    cells = [("title", [("a",), ("b",)], *none[1:]), ("number", None, None, 2.5, *none[3:]), ("select", None, None, None, ("s",), *none[4:]), ("multi_select", None, None, None, None, [("x",), ("y",)], *none[5:]), ("checkbox", *none[:5], True, None, None), ("date", *none[:6], ("2024-01-01",), None), ("url", *none[:7], "u")]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cells], kind).select(flatten.notion_property(F.col("p"))).collect()] == ["ab", "2.5", "s", "x, y", "true", "2024-01-01", "u"]
    issue = spark.createDataFrame([("K-1", ("s", "d", ("Open",), ("High",), None, ("rep",), ["l"], "now", ([("c1",), ("",)],)))], "key string, fields struct<summary:string,description:string,status:struct<name:string>,priority:struct<name:string>,assignee:struct<displayName:string>,reporter:struct<displayName:string>,labels:array<string>,updated:string,comment:struct<comments:array<struct<body:string>>>>")
    row = flatten.jira_issues(issue).first()
    assert (row.status, row.assignee, row.reporter, [c.body for c in row.comments]) == ("Open", None, "rep", ["c1"])
    tickets, notes = spark.createDataFrame([(1, "s")], "id int, subject string"), spark.createDataFrame([(5, 1, "b"), (6, 2, "c")], "id int, ticket_id int, body string")
    assert [tuple(r) for r in flatten.zendesk_comments(tickets, notes).collect()] == [(1, "s", 5, "b")]
    crm = spark.createDataFrame([("1", ("Ann", "x"))], "id string, properties struct<firstname:string,email:string>")
    assert flatten.hubspot_objects(crm).columns == ["id", "firstname", "email"]
