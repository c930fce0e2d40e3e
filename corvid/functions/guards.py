"""Guards at the edge of the engine: identifiers, text columns, targets, credentials in configurations."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import types as T

from corvid.model import EngineError

# Names of columns that hold prose
TEXT_NAMES = ["title", "name", "label", "subject", "summary", "description", "detail", "details", "body", "content", "text", "message", "comment", "note", "notes", "memo", "excerpt", "abstract", "category", "tag", "reason", "status", "html", "markdown", "caption"]

# Parts of keys that hold secrets, and what a reference to a secret begins with
SECRET_WORDS = ["token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "private_key", "refresh", "credential", "dsn", "session_id"]
REFERENCES = ("env:", "file:")
UNKNOWN_REFERENCES = ("secret:", "vault:")



def has_password(text: str) -> bool:
    """Whether any word of a text is a url with a password."""
    for word in text.split():
        try:
            if urlsplit(word).password:
                return True
        except ValueError:  # no url at all
            continue
    return False


def identifier(name: str) -> str:
    """A table or column name that may stand in SQL as it is; anything else raises."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", name or ""):
        raise EngineError("unsafe_identifier", repr(name))
    return name


def text_columns(schema: T.StructType, keys: tuple[str, ...] = ()) -> list[str]:
    """String columns that may hold prose: those named like it first, each group in the schema's order; keys are left out."""
    prose = re.compile(rf"(?:{'|'.join(TEXT_NAMES)})(?:_\w+)?", re.IGNORECASE)
    strings = [f.name for f in schema if isinstance(f.dataType, T.StringType | T.VarcharType | T.CharType | T.VariantType) and f.name not in keys]
    return sorted(strings, key=lambda n: prose.fullmatch(n) is None)


def target(text: str) -> tuple[str, str]:
    """(scheme, uri) that a user's target names; a bare path is a local file tree, and so is file:///path."""
    scheme, mark, rest = text.partition("://")
    if not mark and re.fullmatch(r"github:[\w.-]+/[\w.-]+", text):
        return "github", f"github://{text.partition(':')[2]}"
    if not mark:
        return "file", f"file://local{posixpath.normpath(posixpath.join(os.getcwd(), text))}"
    if scheme == "file" and rest.startswith("/"):
        return "file", f"file://local{posixpath.normpath(rest)}"
    if not re.fullmatch(r"[a-z][a-z0-9+.\-]*", scheme):
        raise EngineError("unknown_scheme", repr(text))
    return scheme, text


def mapped(config: Any, decide: Callable[[str, Any], Any], key: str = "") -> Any:
    """A copy of a nested configuration with decide(key, value) in place of each plain value; items of a list have its key."""
    if isinstance(config, dict):
        return {k: mapped(v, decide, str(k)) for k, v in config.items()}
    if isinstance(config, list):
        return [mapped(v, decide, key) for v in config]
    return decide(key, config)


def exposed(key: str, value: Any) -> bool:
    """Whether a value is a secret in plain sight."""
    if value is None or value == "" or isinstance(value, str) and value.startswith(REFERENCES):
        return False
    return any(w in key.lower() for w in SECRET_WORDS) or isinstance(value, str) and has_password(value)


def redacted(config: Any) -> Any:
    """A copy with null in place of every secret in plain sight."""
    return mapped(config, lambda k, v: None if exposed(k, v) else v)


def check_secrets(config: Any) -> None:
    """Raises where a text is a secret in plain sight; references to secrets pass."""
    found: list[str] = []
    mapped(config, lambda k, v: found.append(k) if isinstance(v, str) and exposed(k, v) else None)
    if found:
        raise EngineError("plaintext_secret", ", ".join(sorted(found)), ("env:NAME", "file:/path"))


def credential(value: Any) -> Any:
    """What a reference to a secret stands for; other values pass."""
    if not isinstance(value, str):
        return value
    if value.startswith(UNKNOWN_REFERENCES):
        raise EngineError("unknown_reference", value.partition(":")[0], REFERENCES)
    scheme, mark, rest = value.partition(":")
    if not mark or not value.startswith(REFERENCES):
        return value
    try:
        if scheme == "env":
            return os.environ[rest]
        with open(rest, encoding="utf-8") as f:
            return f.read().strip()
    except (KeyError, OSError) as e:
        raise EngineError("missing_secret", value) from e
