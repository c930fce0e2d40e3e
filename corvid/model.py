"""Data model: enums, projection specs and the presets of well-known record sources."""

from __future__ import annotations

from dataclasses import dataclass, field

# The closed sets of kinds
OBJECT_KINDS = ("document", "code", "image", "binary", "text_blob", "table_rows", "table_schema", "message_stream", "record_collection", "directory")
CHUNK_KINDS = ("body", "row_text", "thread_aggregate", "record_aggregate", "summary", "vlm_description", "directory_summary", "schema_summary")
#: What makes the chunks of each kind of object; other kinds are never indexed.
PRODUCERS = {"document": "text", "code": "text", "text_blob": "text", "image": "vision", "message_stream": "threads", "table_rows": "records", "record_collection": "records", "table_schema": "schema"}

# limits
CHUNK_SIZE, CHUNK_MAX, CONTENT_CAP = 2048, 1_000_000, 65_000
BARE_READ_BYTES, GREP_HITS, GREP_OBJECTS, GREP_HITS_PER_OBJECT = 5 * 1024 * 1024, 100, 200, 200
RESULT_WINDOW, OVERFETCH, QUERY_CHARS = 16_384, 3, 8000
THREAD_CHARS, THREAD_OVERLAP = 1500, 2
CHILD_EXCERPT, FOLDER_TEXT, QUEUED_JOBS = 16 * 1024, 64 * 1024, 8

# Codes of errors
CODES = ("bad_range", "dimension_mismatch", "invalid_config", "locator_not_found", "missing_option", "missing_secret", "not_found", "object_too_large_for_cat", "plaintext_secret", "query_too_long", "range_unsupported", "stale_lease", "tail_unsupported", "top_k_too_large", "unknown_chunk_kind", "unknown_mode", "unknown_reference", "unknown_scheme", "unsafe_identifier", "version_conflict")


@dataclass(frozen=True)
class ObjectConfig:
    """How the records of an object become text, metadata and locators."""

    text_fields: list[str] = field(default_factory=list)
    metadata_fields: list[str] = field(default_factory=list)
    locator_fields: list[str] = field(default_factory=list)
    group_by: str | None = None
    render_template: str | None = None
    indexable: bool = True
    chunk_max: int = CHUNK_MAX
    priority: int = 0

    def __post_init__(self):
        if "lines" in self.locator_fields:
            raise EngineError("invalid_config", "the locator key 'lines' is reserved")


class EngineError(ValueError):
    """An error with a stable code, a detail and suggestions."""

    def __init__(self, code: str, detail: str, suggestions: tuple[str, ...] = ()):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail, self.suggestions = code, detail, suggestions


# The projection of well-known sources
PRESETS = {
    "github.issues": ObjectConfig(["title", "body", "comments[].body"], ["state", "labels[*]", "author", "assignees[*]", "updated_at"], ["number"]),
    "github.pulls": ObjectConfig(["title", "body", "reviews[].body", "comments[].body"], ["state", "draft", "labels[*]", "author", "merged_at", "updated_at"], ["number"]),
    "jira.issues": ObjectConfig(["summary", "description", "comments[].body"], ["status", "priority", "assignee", "reporter", "labels[*]", "updated"], ["key"]),
    "slack.messages": ObjectConfig(["text"], ["channel", "user", "ts"], ["thread_ts"], group_by="thread_ts", render_template="{user}: {text}"),
    "slack.users": ObjectConfig(["name", "real_name", "profile.display_name", "profile.title", "profile.email"], ["is_admin", "is_bot", "deleted", "tz"], ["id"]),
    "discord.messages": ObjectConfig(["content"], ["channel_id", "author", "timestamp"], ["id"], group_by="id", render_template="{author[username]}: {content}"),
    "gmail.messages": ObjectConfig(["subject", "from", "to", "body", "snippet"], ["from", "to", "date", "labelIds[*]"], ["threadId", "id"], group_by="threadId"),
    "zendesk.tickets": ObjectConfig(["subject", "description"], ["status", "priority", "tags[*]", "updated_at"], ["id"]),
    "feishu.messages": ObjectConfig(["text"], ["msg_type", "create_time", "sender"], ["message_id"], group_by="thread_id", render_template="{sender}: {text}"),
    "hubspot.contacts": ObjectConfig(["firstname", "lastname", "email"], ["createdate", "lastmodifieddate"], ["id"]),
    "hubspot.companies": ObjectConfig(["name", "domain"], ["createdate"], ["id"]),
    "hubspot.deals": ObjectConfig(["dealname", "dealstage"], ["createdate"], ["id"]),
    "hubspot.tickets": ObjectConfig(["subject", "content"], ["createdate"], ["id"]),
    "linear.issues": ObjectConfig(["title", "description"], ["state", "priority", "assignee", "labels[*]", "updatedAt"], ["identifier"]),
    "linear.users": ObjectConfig(["name", "email"], ["active"], ["id"]),
}

# What tells a message's thread, the first that it has, and its place without one
THREAD_KEYS, PLACE_KEYS = ("thread_ts", "threadId", "thread_id", "thread"), ("ts", "id")

# Legal moves of a task and of a job
TASK_MOVES = [("pending", "running"), ("pending", "cancelled"), ("pending", "pending"), ("running", "succeeded"), ("running", "failed"), ("running", "skipped"), ("running", "cancelled"), ("running", "pending"), ("failed", "pending")]
JOB_MOVES = [("preparing", "queued"), ("preparing", "failed"), ("preparing", "cancelled"), ("queued", "running"), ("queued", "failed"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "partial"), ("running", "failed"), ("running", "cancelled"), ("running", "queued")]

# Kinds of files by extension
CODE_EXT = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bash", ".sql", ".lua", ".r"]
DOC_EXT = [".md", ".markdown", ".rst", ".txt", ".pdf", ".docx", ".doc", ".pptx", ".xlsx", ".html", ".htm"]
IMAGE_EXT = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".tiff"]
TEXT_BLOB_EXT = [".json", ".csv", ".tsv", ".log", ".jsonl", ".ndjson", ".yaml", ".yml", ".toml", ".ini"]
MARKDOWN_EXT = [".md", ".markdown", ".rst", ".txt", ""]
MEDIA_TYPES = {".md": "text/markdown", ".jsonl": "application/x-ndjson", ".ndjson": "application/x-ndjson", ".py": "text/x-python", ".toml": "application/toml"}

# What is indexed first; smaller is earlier
PRIORITY_NAMES = [
    (-350, ["readme.md", "claude.md", "skill.md", "index.md"]),
    (-260, ["pyproject.toml", "package.json", "cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg", "gemfile", "pom.xml", "build.gradle", "build.gradle.kts", "makefile", "cmakelists.txt", "tsconfig.json", "deno.json", "composer.json"]),
]
PRIORITY_DIRS = [(-220, ["src", "lib", "app"]), (-190, ["docs", "guides"]), (80, ["tests", "test", "__tests__", "fixtures"]), (260, ["dist", "build", "vendor", "node_modules", "target", "out"])]

# What a line that defines a symbol begins with
SYMBOL_WORDS = ["def ", "class ", "func ", "fn ", "public ", "private ", "func(", "type "]

# Parts of messages that tell failed authentication, and a spent quota
AUTH_MARKERS = ["invalid_api_key", "invalid x-api-key", "authentication", "unauthorized", "permission denied", "401"]
QUOTA_MARKERS = ["insufficient_quota", "402"]

# Ignored by default
DEFAULT_IGNORE = [".git/", ".hg/", ".svn/", "node_modules/", "__pycache__/", ".venv/", "venv/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", "dist/", "build/", ".idea/", ".vscode/", "*.pyc", "*.pyo", "*.so", "*.o", "*.a", "*.dll", "*.dylib", "*.exe", "*.class", "*.jar", "*.zip", "*.tar", "*.gz", "*.tgz", "*.bz2", "*.7z", "*.rar", "*.mp4", "*.mov", "*.avi", "*.mkv", "*.mp3", "*.wav", "*.flac", ".DS_Store", "*.swp", "*.lock"]
