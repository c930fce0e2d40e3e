import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.engine import Engine
from corvid.functions import guards
from corvid.functions import text as t
from corvid.model import EngineError
from corvid.operators import crawl, index

OBJECTS = [
    ("docs://a", "docs://a/src/x.md", "# One\nalpha beta\nbeta", "indexed"),
    ("docs://a", "docs://a/src/y.md", "gamma beta\n", "indexed"),
    ("docs://a", "docs://a/src-old/z.md", "alpha alpha", "not_indexed"),
    ("docs://a/sub", "docs://a/sub/w.md", "alpha", "indexed"),
]


@pytest.fixture(scope="module")
def engine(spark):
    objects = spark.createDataFrame(OBJECTS, "connector_uri string, object_uri string, content string, search_status string")
    parts = objects.where("search_status = 'indexed'").select("connector_uri", "object_uri", F.posexplode(F.split("content", "\n")).alias("i", "content")).where("content <> ''")
    locator = t.lines_locator(F.col("i") + 1, F.col("i") + 2)
    chunks = parts.select(t.chunk_id(F.col("connector_uri"), F.col("object_uri"), F.lit("body"), locator).alias("chunk_id"), "connector_uri", "object_uri", locator.alias("locator"), "content", F.lit("body").alias("chunk_kind"), index.hash_embedding(F.col("content")).alias("dense_vec"))
    return Engine(["docs://a", "docs://a/sub"], objects, chunks)


def test_search(engine):
    for mode in ("keyword", "semantic", "hybrid"):
        hits = engine.search("beta", "docs://a/src", mode, top_k=5).collect()
        assert hits[0].content == "beta" and all(h.source.startswith("docs://a/src/") for h in hits)
        assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    sources = [h.source for h in engine.search("beta", mode="keyword", collapse=True).collect()]
    assert sources == ["docs://a/src/x.md", "docs://a/src/y.md"]
    assert engine.search(" ").collect() == [] and engine.search("beta", top_k=0).collect() == []
    for bad in ({"path": "web://x"}, {"mode": "nope"}, {"kinds": ["nope"]}, {"top_k": 10**6}):
        with pytest.raises(EngineError):
            engine.search("beta", **bad)


def test_grep(engine):
    assert {(h.source, h.via) for h in engine.grep("alpha", "docs://a").collect()} == {("docs://a/src/x.md", "bm25"), ("docs://a/src-old/z.md", "linear")}
    assert [h.locator for h in engine.grep("alpha", "docs://a/src", pushdown=True).collect()] == ['{"lines":[2,3]}']
    with pytest.raises(EngineError):
        engine.grep("alpha", "docs://a/none")


def test_browse(engine):
    assert {(r.name, r.is_dir, r.search_status) for r in engine.ls("docs://a/src").collect()} == {("x.md", False, "indexed"), ("y.md", False, "indexed")}
    assert {r.path for r in engine.tree("docs://a", 1).collect()} == {"docs://a/src", "docs://a/src-old"}
    x = "docs://a/src/x.md"
    assert engine.cat(x).first().content == OBJECTS[0][2] and engine.cat(x, lines="2:3").first().content == "alpha beta"
    assert engine.cat(x, density="peek").first().content == "# One" and engine.cat(x, meta=True).first().media_type == "text/markdown"
    assert engine.head(x, 1).first().content == "# One" and engine.tail(x, 1).first().content == "beta"
    with pytest.raises(EngineError):
        engine.cat("docs://a/src/none.md")


def test_manage(engine):
    assert {(r.connector_uri, r.objects, r.chunks, r.indexed) for r in engine.status().collect()} == {("docs://a", 3, 4, 2), ("docs://a/sub", 1, 1, 1)}
    assert engine.probe("docs://a/sub").first().object_uri == "docs://a/sub/w.md" and engine.estimate("docs://a").first().objects == 3
    left = engine.remove("docs://a/sub")
    assert left.objects.count() == 3 and left.chunks.count() == 4 and left.connectors == ["docs://a"]
    with pytest.raises(EngineError):
        engine.remove("docs://b")


def test_crawl(spark):
    links = {"h://a/": ["h://a/2", "h://b/1", "h://a/gone"], "h://a/2": ["h://a/", "h://a/3"], "h://b/1": ["h://a/4"], "h://a/3": ["h://a/4"], "h://a/4": [], "h://a/9": ["h://a/"]}
    pages = spark.createDataFrame([*links.items()], "url string, links array<string>")
    visits = lambda **more: [(r.url, r.depth) for r in crawl.crawl(pages, ["h://a/", "h://a/"], **more).orderBy("nth").collect()]
    assert visits() == [("h://a/", 0), ("h://a/2", 1), ("h://b/1", 1), ("h://a/3", 2), ("h://a/4", 2)]
    assert visits(most=3) == visits()[:3] and visits(domains=["a"]) == [("h://a/", 0), ("h://a/2", 1), ("h://a/3", 2), ("h://a/4", 3)]
    assert visits(most=0) == [] and crawl.crawl(pages, []).collect() == []
    whole = spark.createDataFrame([("/x",), ("y",), ("//c/z",), ("h://d/e",)], "l string").select(crawl.absolute(F.col("l"), F.lit("h://a/p/q?r#s")))
    assert [r[0] for r in whole.collect()] == ["h://a/x", "h://a/p/y", "h://c/z", "h://d/e"]


def test_guards(monkeypatch, tmp_path):
    schema = T.StructType([T.StructField(n, k) for n, k in (("id", T.StringType()), ("code", T.StringType()), ("n", T.LongType()), ("Title_en", T.StringType()), ("body", T.StringType()))])
    assert guards.text_columns(schema, ("id",)) == ["Title_en", "body", "code"]
    assert guards.identifier("a_1$") == "a_1$"
    for bad in ("1a", "a b", "", "a;drop"):
        with pytest.raises(EngineError):
            guards.identifier(bad)
    assert guards.target("file:///x/../y") == ("file", "file://local/y") and guards.target("file://c1/x") == ("file", "file://c1/x")
    assert guards.target("/r") == ("file", "file://local/r") and guards.target("postgres://p") == ("postgres", "postgres://p")
    config = {"api_token": "abc", "nested": [{"dsn": "env:D", "url": "db://u:p@h/x", "n": 3}], "password": "", "refresh_n": 5}
    assert guards.redacted(config) == {"api_token": None, "nested": [{"dsn": "env:D", "url": None, "n": 3}], "password": "", "refresh_n": None}
    with pytest.raises(EngineError, match="api_token, url"):
        guards.check_secrets(config)
    guards.check_secrets({"api_token": "env:X", "n": 1})
    (tmp_path / "s").write_text("from file\n")
    monkeypatch.setenv("CORVID_TEST", "from env")
    assert [guards.credential(v) for v in ("env:CORVID_TEST", f"file:{tmp_path / 's'}", "plain", 7)] == ["from env", "from file", "plain", 7]
    for bad in ("env:CORVID_NONE", "vault:x", "file:/none/there"):
        with pytest.raises(EngineError):
            guards.credential(bad)
