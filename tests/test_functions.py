import pytest
from pyspark.sql import functions as F

from corvid import model
from corvid.functions import records as r
from corvid.functions import text as t
from corvid.operators import browse, chunk, search
from corvid.sources import files, flatten
from corvid.sources.datasource import register


def values(spark, column, rows, schema="v string"):
    return [x[0] for x in spark.createDataFrame([(v,) for v in rows], schema).select(column).collect()]


def test_tokens_and_lines(spark):
    assert values(spark, t.tokens(F.col("v")), ["Hé, you-2!", ""]) == [["hé", "you", "2"], []]
    assert values(spark, t.lines(F.col("v")), ["a\nb\n", "a", ""]) == [["a", "b"], ["a"], []]


def test_locators_and_ids(spark):
    one = t.locator_json(b=F.lit(1), a=t.json_text(F.lit('x"y')))
    assert values(spark, one, ["_"]) == ['{"a":"x\\"y","b":1}']
    ids = [values(spark, t.chunk_id(F.lit("c"), F.lit("o"), F.lit("body"), x), ["_"])[0] for x in (F.lit(None).cast("string"), F.lit(""))]
    assert ids[0] == ids[1]


def test_paths(spark):
    df = spark.createDataFrame([({"k": 1}, [("x", ["p", "q"]), ("", ["r"])], "one")], "m map<string,int>, a array<struct<b:string,c:array<string>>>, s string")
    got = df.select(r.texts(df, "a[*].b"), r.texts(df, "a[].c[]"), r.texts(df, "a[1].c"), r.texts(df, "a[0:1].b"), r.texts(df, "s[]"), r.texts(df, "nope.x"), r.texts(df, "a[9].b")).first()
    assert [list(x) for x in got][:2] == [["x"], ["p", "q", "r"]] and list(got[3]) == ["x"] and list(got[4]) == ["one"] and list(got[5]) == [] and list(got[6]) == []


def test_render(spark):
    df = spark.createDataFrame([("hi", None, ["l1", "l2"]), (None, "b", [])], "text string, title string, labels array<string>")
    assert [x[0] for x in df.select(r.render(df, ["text"])).collect()] == ["hi", ""]
    assert [x[0] for x in df.select(r.render(df, ["text", "title", "labels[]"])).collect()] == ["text: hi\n\nlabels[]:\n- l1\n- l2", "title: b"]
    author = spark.createDataFrame([(("ann",), "yo")], "author struct<username:string>, content string")
    assert author.select(r.render_template(author, "{author[username]}: {content}{gone}")).first()[0] == "ann: yo"


def test_ignore_rules(spark):
    rules = [x for x in (t.ignore_rule("", "*.log"), t.ignore_rule("", "build/"), t.ignore_rule("", "!keep.log"), t.ignore_rule("sub", "/top"), t.ignore_rule("sub", "a/b"), t.ignore_rule("", "# no"), t.ignore_rule("", "")) if x]
    paths = ["x.log", "d/x.log", "keep.log", "build/x", "d/build/y", "buildx", "sub/top", "sub/q/top", "sub/a/b/c", "q/a/b", "ok.txt"]
    assert values(spark, t.ignored(F.col("v"), rules), paths) == [True, True, False, True, True, False, True, False, True, False, False]


def test_file_tree(spark, tmp_path):
    for name, text in {"README.md": "# hi", "src/a.py": "def f(x): pass", "src/.gitignore": "*.tmp\n", "src/b.tmp": "t", "node_modules/x.js": "x", "img.png": "p"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {x.path: (x.okind, x.priority) for x in files.objects(files.scan(spark, str(tmp_path))).drop("content").collect()}
    assert got == {"README.md": ("document", -350), "src/a.py": ("code", -220), "img.png": ("image", 0)}


def test_data_source_pushes_filters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": "needle"}\n\n{"x": "hay"}\n')
    (tmp_path / "b.jsonl").write_text('{"x": "needle"}')
    register(spark)
    df = spark.read.format("corvid_records").option("path", f"file://{tmp_path}").load()
    assert {tuple(x) for x in df.collect()} == {("a.jsonl", 0, '{"x":"needle"}'), ("a.jsonl", 1, '{"x":"hay"}'), ("b.jsonl", 0, '{"x":"needle"}')}
    found = df.where((F.col("object") == "a.jsonl") & F.col("record").contains("needle"))
    assert [tuple(x) for x in found.collect()] == [("a.jsonl", 0, '{"x":"needle"}')]


def test_ranges_and_locators(spark):
    df = spark.createDataFrame([("u", "l1\nl2\nl3\n")], "object_uri string, content string")
    assert browse.cat_range(df, "1:3").first().content == "l1\nl2" and browse.tail(df, 2).first().content == "l2\nl3" and browse.tail(df, 0).first().content == ""
    for bad in ("3", "0:2", "3:2", "a:b"):
        with pytest.raises(model.EngineError):
            browse.parse_range(bad)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    one = lambda x: [tuple(y) for y in browse.locate(rows, x, ["id"], ["id"]).collect()]
    assert one('{"id": "2"}') == [(2, "b")] and one('{"_row": 0}') == [(1, "a")] and one("{}") == [] and one('{"lines":[1,2]}') == []


def test_outlines(spark):
    df = spark.createDataFrame([("m", "# A\n\n body \n## B\nx"), ("p", "plain\ntext")], "object_uri string, content string")
    got = {x.object_uri: x.content for x in browse.outline(df, "skim").collect()}
    assert got == {"m": "# A\n    body\n## B\n    x", "p": "plain\ntext"}
    code = spark.createDataFrame([("c", "import x\ndef f(a):\n  pass\nclass K(B):")], "object_uri string, content string")
    assert browse.outline(code, "peek", markdown=False).first().content == "def f\nclass K"


def test_scope_boundary(spark):
    df = spark.createDataFrame([("c", "r/src", "body"), ("c", "r/src/a", "body"), ("c", "r/src-old/a", "body"), ("c", "r/src/b", "row_text")], "connector_uri string, object_uri string, chunk_kind string")
    assert [x.object_uri for x in df.where(search.in_scope("c", "r/src/", ["body"])).collect()] == ["r/src", "r/src/a"]
    with pytest.raises(model.EngineError):
        search.in_scope(kinds=["nope"])
    assert not search.check_request(" ", 5) and not search.check_request("x", 0)
    with pytest.raises(model.EngineError):
        search.check_request("x", 100_000)


def test_text_splitter():
    text = "# T\nintro. " + "Word one. " * 40 + "\n## S\n" + "tail " * 30
    cuts = chunk.split_text(text, 120)
    assert "".join(text[a:b] for a, b in cuts) == text and max(b - a for a, b in cuts) <= 120
    assert any(text[a:b].startswith("## S") for a, b in cuts)
    assert [b - a for a, b in chunk.split_text("x" * 1000, 300)] == [300, 300, 300, 100]
    code = "import os\n\ndef a():\n    pass\n\ndef b():\n    return 1\n"
    assert [code[a:b].split("(")[0] for a, b in chunk.split_code(code, 30)] == ["import os\n\ndef a", "def b"]


def test_flatteners(spark):
    issue = spark.createDataFrame([(1, "t", None, "open", ("ann",), [("bug",)], "now", None), (2, "p", "", "open", ("bob",), [], "now", "x")], "number int, title string, body string, state string, user struct<login:string>, labels array<struct<name:string>>, updated_at string, pull_request string")
    assert [(x.number, x.author, x.labels, x.body) for x in flatten.github_issues(issue).collect()] == [(1, "ann", ["bug"], "")]
    chat = spark.createDataFrame([('{"text":"hi"}', "text"), ('{"title":"T","content":[[{"tag":"text","text":"a"},{"tag":"at"}],[{"tag":"text","text":"b"}]]}', "post"), ("{}", "image")], "content string, msg_type string")
    assert [x[0] for x in chat.select(flatten.feishu_text()).collect()] == ["hi", "T a b", ""]
    drive = spark.createDataFrame([("a", "root", None), ("b", "x", "a"), ("c", "y.md", "b")], "id string, name string, parent string")
    assert {x.id: x.path for x in flatten.drive_paths(drive).collect()} == {"a": "/root", "b": "/root/x", "c": "/root/x/y.md"}
    channel = spark.createDataFrame([("1", None, 0), ("2", "1", 11)], "id string, parent_id string, type int")
    assert [x.path for x in flatten.discord_path(channel).collect()] == ["/channels/1/messages.jsonl", "/channels/1/threads/2/messages.jsonl"]
    mail = spark.createDataFrame([("i", "t", ([("Subject", "Hi"), ("From", "x")], [("text/html", ("PGI-SGk8L2I-",))]), "s", ["L"])], "id string, threadId string, payload struct<headers:array<struct<name:string,value:string>>,parts:array<struct<mimeType:string,body:struct<data:string>>>>, snippet string, labelIds array<string>")
    assert [(x.subject, x.to, x.body) for x in flatten.gmail_messages(mail).collect()] == [("Hi", None, "Hi")]
    kinds = spark.createDataFrame([("heading_2", "H"), ("to_do", "d"), ("paragraph", "p")], "k string, x string")
    assert [x[0] for x in kinds.select(flatten.notion_markdown(F.col("k"), F.col("x"))).collect()] == ["## H", "- [ ] d", "p"]


def test_presets_and_moves():
    assert len(model.PRESETS) == 15 and len(model.TASK_MOVES) == 9 and len(model.JOB_MOVES) == 11
    with pytest.raises(model.EngineError):
        model.ObjectConfig(locator_fields=["lines"])
