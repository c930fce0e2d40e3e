"""Column functions on text: tokens, lines, ids, html, classification."""

from __future__ import annotations

import mimetypes
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid import model


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lines(text: Column) -> Column:
    """Lines of a text; the empty piece after a final line end doesn't count."""
    split = F.split(text, "\n")
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line that the character at a 0-based offset is in."""
    return F.regexp_count(F.substring(text, F.lit(1), offset.cast("int")), F.lit("\n")) + 1


def json_text(value: Column) -> Column:
    """A JSON string literal; control characters are escaped too."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def locator_json(**fields: Column) -> Column:
    """Canonical JSON of a locator: keys sorted, no blanks. Values must be JSON already (numbers, json_text)."""
    parts: list[Column] = []
    for i, (key, value) in enumerate(sorted(fields.items())):
        parts += [F.lit(("," if i else "") + f'"{key}":'), F.coalesce(value.cast("string"), F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def lines_locator(start: Column, end: Column) -> Column:
    return F.concat(F.lit('{"lines":['), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]}"))


def chunk_id(connector: Column, object_uri: Column, kind: Column, locator: Column, namespace: str = "default") -> Column:
    """The id of a chunk by its position; a null locator counts as empty."""
    return F.sha1(F.concat_ws("|", F.lit(namespace), connector, object_uri, kind, F.coalesce(locator, F.lit(""))))


def cache_key(text: Column, kind: str, provider: str, name: str, version: str = "1", config: str = "") -> Column:
    return F.sha1(F.concat_ws("|", F.sha1(text), *map(F.lit, (kind, provider, name, version, config))))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


# paths


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def object_kind(path: Column) -> Column:
    ext = extension(path)
    kind = F.when(ext.isin(model.CODE_EXT), "code").when(ext.isin(model.DOC_EXT), "document")
    return kind.when(ext.isin(model.IMAGE_EXT), "image").when(ext.isin(model.TEXT_BLOB_EXT), "text_blob").otherwise("binary")


def producer_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in model.PRODUCERS.items() for x in pair]), kind)


def media_type(path: Column) -> Column:
    """The media type by extension: our own few, else the standard library's table."""
    known = {e: t for e in [*model.CODE_EXT, *model.DOC_EXT, *model.IMAGE_EXT, *model.TEXT_BLOB_EXT] if (t := mimetypes.guess_type(f"x{e}")[0])} | model.MEDIA_TYPES
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), extension(path))


def task_priority(path: Column) -> Column:
    """The bucket of a path relative to its root; a file's name beats its top folder."""
    base, parts = F.lower(basename(path)), F.split(path, "/")
    out = F
    for value, names in model.PRIORITY_NAMES:
        out = out.when(base.isin(names), value)
    out = out.when(F.size(parts) < 2, 0)
    for value, names in model.PRIORITY_DIRS:
        out = out.when(F.lower(parts[0]).isin(names), value)
    return out.otherwise(0)


def safe_name(name: Column, id: Column | None = None) -> Column:
    """A name as a folder: runs of anything but letters, digits, _, . and - become one -; with an id, name__id."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{M}\p{N}_.-]+", "-"), "^-+|-+$", "")
    clean = F.when(clean == "", "unnamed").otherwise(clean)
    return clean if id is None else F.concat(clean, F.lit("__"), id.cast("string"))


# html and urls


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, then tags, then the common entities."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<h([1-6])[^>]*>", "\n# ")
    out = F.regexp_replace(out, r"(?i)<(p|br|li|div|tr|/h[1-6]|/p|/li)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def links(html: Column) -> Column:
    """Targets of links, without fragments, distinct, in order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), 1), lambda u: F.regexp_replace(u, "#.*$", ""))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def url_path(url: Column) -> Column:
    """Where a crawled url lives: /pages/<host>/<path>.md"""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+/?([^?#]*)", 1), "/+$", "")
    return F.concat(F.lit("/pages/"), host, F.lit("/"), F.when(path == "", "index").otherwise(path), F.lit(".md"))


def allowed_domain(url: Column, domains: list[str]) -> Column:
    """Whether a url's host, or host and port, is one of domains."""
    where = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))
    return where.isin(domains) | F.regexp_replace(where, r":\d+$", "").isin(domains)


# errors and times


def error_class(message: Column) -> Column:
    """auth, quota or retryable"""
    text = F.lower(message)
    holds = lambda words: reduce(Column.__or__, [text.contains(w) for w in words])
    return F.when(holds(model.AUTH_MARKERS), "auth").when(holds(model.QUOTA_MARKERS), "quota").otherwise("retryable")


def backoff(attempt: Column, initial: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt), F.lit(most))


def time_bound(value: Column, now: Column) -> Column:
    """Unix seconds of a unix number, now-<n>[dwhm], an ISO date or date and time (UTC); else null."""
    amount = F.regexp_extract(value, r"^now-(\d+)[dwhm]$", 1).try_cast("double")
    unit = F.regexp_extract(value, r"^now-\d+([dwhm])$", 1)
    seconds = F.when(unit == "d", 86400).when(unit == "w", 604800).when(unit == "h", 3600).when(unit == "m", 60)
    return F.coalesce(value.try_cast("double"), now - amount * seconds, F.when(value.rlike(r"^\d{4}-\d\d-\d\d"), F.unix_timestamp(value.try_cast("timestamp")).cast("double")))


def rfc3339(value: Column) -> Column:
    """A date as the beginning of that day; a date and time stays."""
    text = F.trim(value)
    return F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T00:00:00")))


def ignore_rule(folder: str, line: str) -> tuple[bool, str] | None:
    """(keeps, regular expression on root-relative paths) of one line of an ignore file found in folder; None for blanks and comments."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    keeps = rule.startswith("!")
    rule = rule[1:] if keeps else rule
    only_dirs, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    body = rule.strip("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") and len(part) > 1 else re.escape(part))
    start = re.escape(folder) + "/" if folder else ""
    return keeps, f"^{start}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_dirs else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches a path drops it."""
    out = F.lit(False)
    for keeps, pattern in rules:
        out = F.when(path.rlike(pattern), not keeps).otherwise(out)
    return out
