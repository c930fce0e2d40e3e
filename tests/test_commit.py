"""One commit over all tables: a writer that fails anywhere leaves the state before it, and the next one finishes the work."""

import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from corvid.catalog import Catalog
from corvid.model import EngineError
from corvid.operators import index, postings, search
from corvid.operators.ledger import Ledger, Transaction
from corvid.operators.postings import RANGE, Postings
from corvid.session import shared_folder


class Crash(Exception):
    pass


def listing(spark, rows):
    return spark.createDataFrame(rows, "object_uri string, content string")


OLD = [("docs://a/x.md", "alpha beta"), ("docs://a/y.md", "gamma"), ("docs://a/gone.md", "alpha omega")]
NEW = [("docs://a/x.md", "alpha changed"), ("docs://a/moved/y.md", "gamma"), ("docs://a/new.md", "delta alpha")]


def state(own):
    rows = lambda table, *cols: sorted(tuple(r) for r in table.read().select(*cols).collect())
    hits = {w: sorted(r.object_uri for r in own.postings.bm25(w).collect()) for w in ("alpha", "omega", "delta", "gamma", "beta")}
    return rows(own.objects, "object_uri", "fingerprint", "chunk_count"), rows(own.chunks, "object_uri", "content"), rows(own.cache, "cache_key"), sorted(tuple(r) for r in own.postings.vocabulary().collect()), hits, tuple(own.postings.stats().first())


@pytest.fixture(scope="module")
def states(spark):
    root = f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"
    Catalog(spark, f"{root}-old", buckets=4).add("docs://a", listing(spark, OLD))
    shutil.copytree(f"{root}-old".removeprefix("file://"), f"{root}-new".removeprefix("file://"))
    after = Catalog(spark, f"{root}-new", buckets=4)
    after.add("docs://a", listing(spark, NEW))
    return root, state(Catalog(spark, f"{root}-old", buckets=4)), state(after)


#: What a second sync writes, in order: cache, chunks, objects, postings, the manifest.
STEPS = [(index.Snapshots, "_stage", 0), (index.Snapshots, "_stage", 1), (index.Snapshots, "_stage", 2), (Postings, "_write", 0), (Ledger, "_rename", 0)]


@pytest.mark.parametrize(("step", "when"), [*((k, "before") for k in range(len(STEPS))), (4, "after")])  # after one is before the next
def test_a_crash_between_any_two_writes(spark, states, monkeypatch, step, when):
    root, old, new = states
    copy = f"{root}-{uuid.uuid4().hex}"
    shutil.copytree(f"{root}-old".removeprefix("file://"), copy.removeprefix("file://"))
    owner, name, nth = STEPS[step]
    real, calls = getattr(owner, name), []

    def crashing(self, *args, **more):
        calls.append(1)
        if len(calls) == nth + 1 and when == "before":
            raise Crash
        out = real(self, *args, **more)
        if len(calls) == nth + 1:
            raise Crash
        return out

    with monkeypatch.context() as m:
        m.setattr(owner, name, crashing)
        m.setattr(Transaction, "abort", lambda self: None)  # the writer is dead: it can't clean up
        with pytest.raises((Crash, EngineError)):
            Catalog(spark, copy, buckets=4).add("docs://a", listing(spark, NEW))
    done = owner is Ledger and when == "after"
    assert state(Catalog(spark, copy, buckets=4)) == (new if done else old)
    again = Catalog(spark, copy, buckets=4, stale=0)
    assert len(again.recovered) == 1 and again.ledger.names("_intents") == [] and all(n.isdigit() for n in again.ledger.names("_commits"))
    left = {f for t in ("cache", "chunks", "objects", "postings") for f in again.ledger.names(t) if f.startswith(again.recovered[0])}
    assert bool(left) == done
    changes = {r.change for r in again.add("docs://a", listing(spark, NEW)).collect()}
    assert changes == ({"unchanged"} if done else {"modified", "renamed", "added", "deleted"}) and state(again) == new


def test_two_writers_and_vacuum(spark, states):
    root, old, new = states
    copy = f"{root}-{uuid.uuid4().hex}"
    shutil.copytree(f"{root}-old".removeprefix("file://"), copy.removeprefix("file://"))
    own = Catalog(spark, copy, buckets=4)
    slow = own.ledger.begin()
    own.add("docs://a", listing(spark, NEW))
    own.objects.commit(own.objects.read().limit(0), slow)
    with pytest.raises(EngineError, match="version_conflict"):
        slow.commit()
    own.ledger.vacuum()
    assert state(own) == new and own.ledger.names("_commits") == [f"{own.ledger.version():020d}"]


def test_removed_connectors_are_not_found(spark, states):
    root, _, _ = states
    copy = f"{root}-{uuid.uuid4().hex}"
    shutil.copytree(f"{root}-old".removeprefix("file://"), copy.removeprefix("file://"))
    own = Catalog(spark, copy, buckets=4)
    own.add("docs://b", listing(spark, [(f"docs://b/{k}.md", "alpha alpha alpha") for k in range(20)]))
    both = own.engine(["docs://a", "docs://b"])
    for mode in ("keyword", "hybrid"):
        assert {h.source for h in both.search("alpha", mode=mode, top_k=5).collect()} <= {f"docs://b/{k}.md" for k in range(20)}
        left = both.remove("docs://b")
        assert {"docs://a/x.md", "docs://a/gone.md"} <= {h.source for h in left.search("alpha", mode=mode, top_k=5).collect()} <= {o for o, _ in OLD}
    assert {h.source for h in both.grep("omega", "docs://a").collect()} == {"docs://a/gone.md"}
    own.remove("docs://b")
    assert {h.source for h in own.engine(["docs://a", "docs://b"]).search("alpha", mode="keyword").collect()} == {"docs://a/x.md", "docs://a/gone.md"}


def test_few_blocks_are_read_and_hits_are_those_of_a_scan(spark, monkeypatch):
    """Objects of one kind stand together: words of a topic lie in few ranges, and common words everywhere."""
    monkeypatch.setattr(postings, "WHOLE", 0)
    n = 40_000
    topic = F.concat(F.lit("topic"), F.floor(F.col("id") / 500).cast("string"))
    often = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod(F.xxhash64("id"), F.lit(7)) + 1), lambda k: F.lit("common")), " ")
    rare = F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(900)) == 0, " rare rare").otherwise("")
    fill = F.array_join(F.transform(F.sequence(F.lit(0), F.pmod("id", F.lit(40))), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(50)).cast("string"))), " ")
    rows = spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.format_string("u%06d", "id").alias("object_uri"), F.lit("docs://a").alias("connector_uri"), F.when(F.col("id") % 2 == 0, "body").otherwise("row_text").alias("chunk_kind"), F.concat_ws(" ", topic, often, fill, rare).alias("content"))
    rows.write.parquet(at := f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}/rows")
    rows = spark.read.parquet(at)
    own = Postings(spark, f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}")
    own.add(rows)
    for query, where, k in (("topic7 common", None, 10), ("rare common w3", None, 10), ("rare", search.in_scope(kinds=["row_text"]), 25), ("common", None, 5)):
        hits, read, every = own.skipping(query, where, k)
        assert [tuple(r) for r in hits.collect()] == [tuple(r) for r in search.bm25(rows, query, where, k).collect()], query
        assert every <= -(-n // RANGE)
        if query not in ("common", "rare"):  # the former's best chunks are everywhere, the latter's ranges are few from the start
            assert read <= every / 3, (query, read, every)
    # a later segment with other lengths: bounds of the first one still hold
    longer = rows.where("object_uri < 'u004000'").withColumn("content", F.concat_ws(" ", "content", F.lit("tail " * 60)))
    own.add(longer, rows.where("object_uri < 'u004000'"))
    now = rows.where("object_uri >= 'u004000'").unionByName(longer)
    for query in ("rare common w3", "topic7 tail", "topic60 common"):
        assert own.bm25(query).collect() == search.bm25(now, query).collect()
    own.compact()
    assert own.segments() == 1 and own.bm25("rare tail w3").collect() == search.bm25(now, "rare tail w3").collect()
    assert sorted(own.vocabulary().where("term like 'topic1%'").collect()) == sorted(now.select("chunk_id", F.explode(F.array_distinct(F.split("content", " "))).alias("term")).where("term like 'topic1%'").groupBy("term").agg(F.count("*").alias("df"), F.count("*").alias("cf")).collect())
