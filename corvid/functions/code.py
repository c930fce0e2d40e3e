"""The structure of source code: strings and comments told apart from the rest, and a tree of definitions from brackets or indentation.

It is no parser: a lexer of strings, comments and brackets by language, and rules for what a line that defines something looks like.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """How a language writes comments and strings, and what makes its blocks."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")  # longer ones first
    raw: tuple[str, ...] = ()  # quotes in which a backslash is itself
    multiline: tuple[str, ...] = ()  # quotes whose strings go over lines
    indented: bool = False
    nested: bool = False  # block comments nest


PYTHON = Language(("#",), (), ('"""', "'''", '"', "'"), (), ('"""', "'''"), True)
SCRIPT = Language(("//",), (("/*", "*/"),), ('"', "'", "`"), (), ("`",))
CURLY = Language()
LANGUAGES = {
    ".py": PYTHON, ".js": SCRIPT, ".jsx": SCRIPT, ".ts": SCRIPT, ".tsx": SCRIPT, ".go": Language(quotes=('"', "'", "`"), raw=("`",), multiline=("`",)), ".rs": Language(quotes=('"',), multiline=('"',), nested=True),
    ".java": Language(quotes=('"""', '"', "'"), multiline=('"""',)), ".kt": Language(quotes=('"""', '"', "'"), raw=('"""',), multiline=('"""',), nested=True), ".scala": Language(quotes=('"""', '"', "'"), raw=('"""',), multiline=('"""',), nested=True), ".swift": Language(quotes=('"""', '"'), multiline=('"""',), nested=True),
    ".c": CURLY, ".h": CURLY, ".cpp": CURLY, ".hpp": CURLY, ".cc": CURLY, ".php": Language(("//", "#"), multiline=('"', "'")), ".r": Language(("#",), ()), ".sql": Language(("--",), multiline=("'",)),
    ".rb": Language(("#",), (("\n=begin", "\n=end"),), indented=True), ".lua": Language(("--",), (("--[[", "]]"),), indented=True), ".sh": Language(("#",), (), multiline=('"', "'")), ".bash": Language(("#",), (), multiline=('"', "'")),
}
#: A line that defines something: words before it, what it defines, its name.
WORDS = "def|class|func|fn|function|interface|struct|enum|trait|impl|module|namespace|object|record|protocol|extension|type|mod|sub|macro_rules!"
BEFORE = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|open|data|inline|const|unsafe|extern|pub(?:\([^)]*\))?|local|declare|partial|suspend|fileprivate|case|implicit|lazy)\s+)*"
DEFINES = re.compile(rf"[ \t]*{BEFORE}({WORDS})\b[ \t]*(?:<[^>\n]*>[ \t]*)?(?:\([^)\n]*\)[ \t]*)?((?:[\w$]+(?:(?:::|\.)[\w$]+)*)?)")
#: In languages with braces: a name with brackets after it, then a block (functions of C and Java, methods).
CALLED = re.compile(r"[ \t]*(?:[\w$<>\[\],.:*&?~@]+[ \t]+)*[*&]*([\w$~:]+)[ \t]*\([^;{}]*\)[^;{}=]*\{", re.S)
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "with", "match", "loop", "elif", "sizeof", "new", "await", "throw", "synchronized", "using", "lock", "foreach", "unless", "until", "when", "guard", "defer", "go", "select"}
#: What may stand right above a definition and belongs to it.
ABOVE = re.compile(r"[ \t]*(?:@|#\[|\[)")


@dataclass
class Definition:
    """A definition: its first and last line (from 0, the latter not included), what it is, its name, and what it holds."""

    begin: int
    end: int
    kind: str
    name: str
    depth: int = 0
    inner: list[Definition] = field(default_factory=list)


def blanked(text: str, language: Language) -> str:
    """The text with blanks for what is in strings and comments; lines stay lines."""
    marks = [*((m, "line", "\n") for m in language.line), *((a, "block", b) for a, b in language.block), *((q, "string", q) for q in language.quotes)]
    marks.sort(key=lambda m: -len(m[0]))
    start = re.compile("|".join(re.escape(m[0]) for m in marks))
    kinds = {m[0]: m for m in marks}
    out, at = [], 0
    while (found := start.search(text, at)) is not None:
        mark, kind, close = kinds[found[0]]
        begin, end = found.start(), found.end()
        if kind == "string" and mark == "'" and language.block and not _is_quote(text, begin):
            out.append(text[at:end])  # a lifetime, or an apostrophe in a number
            at = end
            continue
        if kind == "line":
            stop = text.find("\n", end)
            stop = len(text) if stop < 0 else stop
        elif kind == "block":
            stop, depth = end, 1
            while depth:
                a, b = (text.find(mark, stop) if language.nested else -1), text.find(close, stop)
                if b < 0:
                    stop, depth = len(text), 0
                elif 0 <= a < b:
                    stop, depth = a + len(mark), depth + 1
                else:
                    stop, depth = b + len(close), depth - 1
        else:
            stop = end
            while stop < len(text):
                if text[stop] == "\\" and mark not in language.raw:
                    stop += 2
                elif text.startswith(close, stop):
                    stop += len(close)
                    break
                elif text[stop] == "\n" and mark not in language.multiline:
                    break  # an unclosed string ends with its line
                else:
                    stop += 1
            stop = min(stop, len(text))
        inside = text[begin:stop]
        # a string keeps its quotes, so that what is around it still looks like code
        out += [text[at:begin], "".join(c if c == "\n" else " " for c in inside) if kind != "string" or len(inside) < 2 else mark[0] + "".join(c if c == "\n" else " " for c in inside[1:-1]) + (inside[-1] if inside[-1] == "\n" else mark[0])]
        at = stop
    return "".join(out) + text[at:]


def _is_quote(text: str, at: int) -> bool:
    """Whether an apostrophe opens a character or string: it isn't within a word or number, and another one follows in its line."""
    return not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and "'" in text[at + 1 : text.find("\n", at) if "\n" in text[at:] else len(text)]


def _by_braces(clean: str, lines: list[str]) -> list[Definition]:
    """Definitions whose blocks are in braces; one without a block ends with its statement."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    closing, stack, depth_at = {}, [], []
    for i, line in enumerate(lines):
        depth_at.append(len(stack))
        for k, c in enumerate(line):
            if c == "{":
                stack.append(starts[i] + k)
            elif c == "}" and stack:
                closing[stack.pop()] = i
    import bisect

    opens = sorted(closing)
    found = []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        m, kind, name = DEFINES.match(line), "", ""
        if m:
            kind, name = m[1], m[2]
        elif "(" in line and (c := CALLED.match(clean, starts[i])) and c[1] not in NOT_NAMES and clean.count("\n", starts[i], c.end()) < 12 and line.split(None, 1)[0].rstrip("(") not in NOT_NAMES:
            kind, name = "function", c[1]
        if not kind:
            continue
        k = bisect.bisect_left(opens, starts[i])
        opened = opens[k] if k < len(opens) else len(clean)
        ended = clean.find(";", starts[i])
        own = closing.get(opened) if opened < len(clean) and (ended < 0 or opened < ended) and "}" not in clean[starts[i] : opened] else None
        found.append(Definition(i, (own if own is not None else i) + 1, kind, name, depth_at[i]))
    return found


def _by_indentation(lines: list[str]) -> list[Definition]:
    """Definitions whose blocks are indented deeper than they are; brackets that are open join lines."""
    open_brackets, joined = 0, []
    for line in lines:
        joined.append(open_brackets > 0)
        open_brackets = max(0, open_brackets + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    indent = [len(x) - len(x.lstrip(" \t")) if x.strip() else -1 for x in lines]
    found = []
    for i, line in enumerate(lines):
        m = None if joined[i] else DEFINES.match(line)
        if not m or not m[2]:
            continue
        end, last = i + 1, i + 1
        while end < len(lines) and (indent[end] < 0 or indent[end] > indent[i] or joined[end] or lines[end].strip() == "end" and indent[end] == indent[i]):
            last = end + 1 if indent[end] >= 0 else last
            end += 1
        found.append(Definition(i, last, m[1], m[2], indent[i]))
    return found


def definitions(text: str, ext: str) -> list[Definition]:
    """The tree of a text's definitions: those of the outermost level, each with what it holds. Decorators and attributes above a
    definition are part of it."""
    language = LANGUAGES.get(ext.lower(), PYTHON if ext == "" else CURLY)
    clean = blanked(text, language)
    lines = clean.split("\n")
    flat = _by_indentation(lines) if language.indented else _by_braces(clean, lines)
    out: list[Definition] = []
    stack: list[Definition] = []
    for d in flat:
        while d.begin and ABOVE.match(lines[d.begin - 1]):
            d.begin -= 1
        while stack and d.begin >= stack[-1].end:
            stack.pop()
        if stack and d.end > stack[-1].end:
            d.end = stack[-1].end
        d.depth = len(stack)
        (stack[-1].inner if stack else out).append(d)
        stack.append(d)
    return out


def walk(tree: list[Definition]) -> list[Definition]:
    """All definitions of a tree in the order of their lines."""
    return [x for d in tree for x in (d, *walk(d.inner))]


def units(text: str, ext: str, size: int) -> list[tuple[int, int]]:
    """(begin, end) of parts of at most about size characters: whole definitions where they fit, with what stands before them; of
    one that doesn't fit its head, and the definitions in it. What has no definitions stays one part, whatever its size."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    starts[-1] = len(text)

    heads: set[int] = set()

    def cut(tree: list[Definition], begin: int, end: int) -> list[tuple[int, int]]:
        marks, out = sorted({begin, end, *(starts[d.begin] for d in tree if begin < starts[d.begin] < end)}), []
        inside = {starts[d.begin]: d for d in tree}
        if begin in heads and len(marks) > 2 and marks[2] - begin <= size:
            del marks[1]  # a head stays with the first definition after it
        for a, b in zip(marks[:-1], marks[1:]):
            d = inside.get(a)
            if d is not None and b - a > size and d.inner:
                done = starts[min(d.end, len(starts) - 1)]
                heads.add(a)
                out += cut(d.inner, a, min(done, b))
                if done < b:
                    out.append((done, b))
            else:
                out.append((a, b))
        return out

    return cut(definitions(text, ext), 0, len(text)) if text else []
