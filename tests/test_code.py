import random

import pytest

from corvid.functions.code import blanked, definitions, units, walk, LANGUAGES
from corvid.operators.chunk import split_code

PY = '''import os

"""
def hidden():
    class AlsoHidden: pass
"""
x = 'def not_this():'  # def nor_this():

@decorated(
    "class Fake:")
class Outer(Base):
    y = """
def inside_a_string(): pass
"""

    @property
    async def method(self, a="def b():",
                     c=(1,
                        2)):
        def nested():
            return {
"def": 1}

        return nested

    def other(self): return 1

def last():
    pass
'''
TS = """// class Comment {
/* function old() { */
export default class Shop extends Base {
  private name = "class X {";
  async buy(item: string): Promise<void> {
    if (item) { return `function ${item}() {`; }
  }
  static of() { return new Shop(); }
}
interface Point { x: number }
function free(a, b) {
  const inner = function named() { return 1; };
}
type Alias = string;
"""
GO = "package main\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Get() int {\n\tx := `func raw() {`\n\treturn t.a\n}\n"
RUST = "pub struct A<'a> { x: &'a str }\n\nimpl<'a> A<'a> {\n    pub fn get(&self) -> char { '{' }\n}\n/* outer /* fn nested() {} */ fn still() {} */\n#[test]\nfn t() { let s = \"fn s() {\"; }\n"
C = "#include <x.h>\nstatic int add(int a,\n               int b)\n{\n    return a; /* } */\n}\nint declared(void);\nstruct p { int x; };\nint main() { if (add(1, 2)) { return '}'; } }\n"


def names(text, ext):
    return [(d.kind, d.name, d.depth) for d in walk(definitions(text, ext))]


def test_definitions_of_every_level():
    assert names(PY, ".py") == [("class", "Outer", 0), ("def", "method", 1), ("def", "nested", 2), ("def", "other", 1), ("def", "last", 0)]
    assert names(TS, ".ts") == [("class", "Shop", 0), ("function", "buy", 1), ("function", "of", 1), ("interface", "Point", 0), ("function", "free", 0), ("type", "Alias", 0)]
    assert names(GO, ".go") == [("type", "T", 0), ("func", "Get", 0)]
    assert names(RUST, ".rs") == [("struct", "A", 0), ("impl", "A", 0), ("fn", "get", 1), ("fn", "t", 0)]
    assert names(C, ".c") == [("function", "add", 0), ("struct", "p", 0), ("function", "main", 0)]
    lines = PY.split("\n")
    outer, method = walk(definitions(PY, ".py"))[:2]
    assert lines[method.begin].strip() == "@property" and lines[outer.end - 1].strip() == "def other(self): return 1"
    last = walk(definitions(RUST, ".rs"))[-1]
    assert RUST.split("\n")[last.begin] == "#[test]"


@pytest.mark.parametrize("ext", [".py", ".ts", ".go", ".rs", ".c", ".rb", ".sql", ".sh", ".lua", ".php", ".nope", ""])
def test_any_text_keeps_its_length_and_lines(ext):
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(["'", '"', "`", '"""', "/*", "*/", "//", "#", "\\", "\n", "{", "}", "(", ")", "def f", "class A:", "    ", "x ", "ü", "--", "[["]) for _ in range(r.randrange(80)))
        clean = blanked(text, LANGUAGES.get(ext, LANGUAGES[".c"]))
        assert len(clean) == len(text) and [i for i, c in enumerate(clean) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        parts = units(text, ext, 10)
        assert "".join(text[a:b] for a, b in parts) == text
        assert "".join(text[a:b] for a, b in split_code(text, 10, ext)) == text and all(b - a <= 10 for a, b in split_code(text, 10, ext))


def nested(r, depth, name):
    """A made-up Python definition, and the (name, depth) of all that it defines."""
    pad, lines, told = "    " * depth, [], [(name, depth)]
    lines.append(f"{pad}{r.choice(['def', 'class'])} {name}():")
    for k in range(r.randrange(1, 4)):
        what = r.randrange(4)
        if what == 0 and depth < 4:
            body, inner = nested(r, depth + 1, f"{name}_{k}")
            lines += body
            told += inner
        elif what == 1:
            lines += [f'{pad}    s = """', f"def hidden_{k}(): pass", f'{pad}    class Hidden: """']
        elif what == 2:
            lines += [f"{pad}    x = (1,  # def no():", "def_ :=", f"{pad}    2)", ""]
        else:
            lines.append(f"{pad}    y = 'class Z:' + \"it's\"")
    return lines, told


def test_made_up_nesting():
    r = random.Random(8)
    for _ in range(40):
        lines, told = ["import x", ""], []
        for k in range(r.randrange(1, 5)):
            body, names_ = nested(r, 0, f"n{k}")
            lines += [*body, ""]
            told += names_
        assert [(d.name, d.depth) for d in walk(definitions("\n".join(lines), ".py"))] == told


def test_chunks_begin_at_definitions():
    body = "\n".join(f"        line_{i} = {i}" for i in range(20))
    text = "import a\n\n" + "".join(f"class C{k}:\n    def one(self):\n{body}\n\n    def two(self):\n{body}\n\n" for k in range(3))
    parts = [text[a:b] for a, b in split_code(text, 700, ".py")]
    assert "".join(parts) == text and all(len(p) <= 700 for p in parts)
    assert [p.lstrip().split("(")[0].split(":")[0].split("\n")[0] for p in parts] == ["import a", "def two", "class C1", "def two", "class C2", "def two"]
