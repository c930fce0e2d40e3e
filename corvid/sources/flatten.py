"""Raw records of chat, ticket and knowledge systems as flat records, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions.records import resolve

#: Columns that aren't the record's own: every flattener passes them on.
PLACE = ("_object_uri", "_row")


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _place(df: DataFrame) -> list[str]:
    return [c for c in PLACE if c in df.columns]


def _at(df: DataFrame, path: str, name: str | None = None) -> Column:
    """A path's value under its last name; null where these records don't have it."""
    return resolve(df, path)[0].alias(name or path.rsplit(".", 1)[-1])


def _names(df: DataFrame, path: str, name: str) -> Column:
    """The `name` of each entry of a list."""
    return resolve(df, f"{path}[*].{name}")[0]


def slack_messages(df: DataFrame, oldest: float | None = None) -> DataFrame:
    """A message outside any thread starts its own; with oldest only later ones."""
    df = df.where(F.col("ts").cast("double") >= oldest) if oldest is not None else df
    return df.withColumn("thread_ts", F.coalesce("thread_ts", "ts") if _has(df, "thread_ts") else F.col("ts"))


def github_issues(df: DataFrame) -> DataFrame:
    """Issues without pull requests, with plain author, label and assignee names."""
    issues = df.where(F.col("pull_request").isNull()) if _has(df, "pull_request") else df
    return issues.select(*_place(df), *(_at(df, x) for x in ("number", "title")), F.coalesce(_at(df, "body"), F.lit("")).alias("body"), _at(df, "state"), _at(df, "user.login", "author"), _names(df, "labels", "name").alias("labels"), _names(df, "assignees", "login").alias("assignees"), _at(df, "updated_at"))


def github_pulls(df: DataFrame) -> DataFrame:
    """Pull requests with plain author and label names."""
    return df.select(*_place(df), *(_at(df, x) for x in ("number", "title")), F.coalesce(_at(df, "body"), F.lit("")).alias("body"), _at(df, "state"), F.coalesce(_at(df, "draft").cast("boolean"), F.lit(False)).alias("draft"), _at(df, "user.login", "author"), _names(df, "labels", "name").alias("labels"), _at(df, "merged_at"), _at(df, "updated_at"))


def jira_issues(df: DataFrame) -> DataFrame:
    """Issue key, summary, description, names of status, priority and people, labels, and comments as [{body}]."""
    f = "fields."
    bodies = F.filter(resolve(df, f + "comment.comments[*].body")[0], lambda c: c.isNotNull() & (c != ""))
    named = {"status": "status.name", "priority": "priority.name", "assignee": "assignee.displayName", "reporter": "reporter.displayName"}
    return df.select(*_place(df), "key", *(_at(df, f + x) for x in ("summary", "description")), *(_at(df, f + x, k) for k, x in named.items()), _at(df, f + "labels"), _at(df, f + "updated"), F.transform(bodies, lambda c: F.struct(c.alias("body"))).alias("comments"))


def linear_issues(df: DataFrame) -> DataFrame:
    """Issues with plain names of state, assignee and labels."""
    return df.select(*_place(df), *(_at(df, x) for x in ("identifier", "title", "description")), _at(df, "state.name", "state"), _at(df, "priority"), _at(df, "assignee.name", "assignee"), _names(df, "labels.nodes", "name").alias("labels"), _at(df, "updatedAt"))


def linear_users(df: DataFrame) -> DataFrame:
    return df.select(*_place(df), *(_at(df, x) for x in ("id", "name", "email")), F.coalesce(_at(df, "active").cast("boolean"), F.lit(True)).alias("active"))


def zendesk_comments(tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """Each ticket's comments, by ticket id."""
    return tickets.select(F.col("id").alias("ticket_id"), "subject").join(comments, "ticket_id").select("ticket_id", "subject", F.col("id").alias("comment_id"), "body")


def hubspot_objects(df: DataFrame) -> DataFrame:
    """Properties raised to the top level."""
    own = [c for c in df.schema["properties"].dataType.fieldNames() if c not in ("id", *PLACE)]
    return df.select(*_place(df), "id", *(F.col("properties")[c].alias(c) for c in own))


def discord_path(df: DataFrame) -> DataFrame:
    """Where a channel's messages live; a thread lives under its parent channel."""
    thread = F.col("parent_id").isNotNull() & F.col("type").isin(10, 11, 12)
    own = F.concat(F.lit("/channels/"), F.when(thread, F.concat(F.col("parent_id"), F.lit("/threads/"), F.col("id"))).otherwise(F.col("id")), F.lit("/messages.jsonl"))
    return df.withColumn("path", own)


def feishu_text(content: str = "content", kind: str = "msg_type"):
    """The text of a text message, or of a post: its title and the text runs of its paragraphs."""
    run = T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
    body = T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.ArrayType(T.ArrayType(run)))])
    parsed = F.from_json(content, body)
    runs = F.filter(F.transform(F.flatten(parsed["content"]), lambda r: r["text"]), lambda x: x.isNotNull() & (x != ""))
    post = F.concat_ws(" ", F.when(parsed["title"] != "", parsed["title"]), F.array_join(runs, " "))
    return F.when(F.col(kind) == "text", F.coalesce(parsed["text"], F.lit(""))).when(F.col(kind) == "post", F.trim(post)).otherwise("")


def gmail_messages(df: DataFrame) -> DataFrame:
    """Headers by name and the body: the first plain part, else the first html part without its tags."""
    headers = F.map_from_entries(F.transform("payload.headers", lambda h: F.struct(F.lower(h["name"]), h["value"])))

    def decoded(mime: str):
        found = F.filter("payload.parts", lambda p: p["mimeType"] == mime)
        data = F.translate(F.try_element_at(F.transform(found, lambda p: p["body"]["data"]), F.lit(1)), "-_", "+/")
        padded = F.rpad(data, (F.ceil(F.length(data) / 4) * 4).cast("int"), F.lit("="))
        return F.unbase64(padded).cast("string")

    html = F.trim(F.regexp_replace(F.regexp_replace(decoded("text/html"), "<[^>]+>", " "), r"\s+", " "))
    wanted = {k: F.try_element_at(headers, F.lit(k)) for k in ("subject", "from", "to", "date")}
    return df.select(*_place(df), "id", "threadId", *(v.alias(k) for k, v in wanted.items()), F.coalesce(decoded("text/plain"), html, F.lit("")).alias("body"), "snippet", "labelIds")


def notion_markdown(kind, text, checked=None, language=None):
    """One block as a line of markdown."""
    done = F.coalesce(checked, F.lit(False)) if checked is not None else F.lit(False)
    out = F.when(kind == "heading_1", F.concat(F.lit("# "), text)).when(kind == "heading_2", F.concat(F.lit("## "), text)).when(kind == "heading_3", F.concat(F.lit("### "), text))
    out = out.when(kind == "bulleted_list_item", F.concat(F.lit("- "), text)).when(kind == "numbered_list_item", F.concat(F.lit("1. "), text)).when(kind == "quote", F.concat(F.lit("> "), text))
    out = out.when(kind == "to_do", F.concat(F.when(done, "- [x] ").otherwise("- [ ] "), text))
    return out.when(kind == "code", F.concat(F.lit("```"), language if language is not None else F.lit(""), F.lit("\n"), text, F.lit("\n```"))).otherwise(text)


def notion_property(value):
    """A property's value (a struct with its type and one field for each type) as text."""
    kind = value["type"]
    plain = lambda f: F.array_join(F.transform(value[f], lambda x: x["plain_text"]), "")
    out = F.when(kind == "title", plain("title")).when(kind == "rich_text", plain("rich_text")).when(kind == "number", value["number"].cast("string"))
    out = out.when(kind == "select", value["select"]["name"]).when(kind == "multi_select", F.array_join(F.transform(value["multi_select"], lambda x: x["name"]), ", "))
    return out.when(kind == "checkbox", value["checkbox"].cast("string")).when(kind == "date", value["date"]["start"]).when(kind == "url", value["url"])


def drive_paths(files: DataFrame, most: int = 64) -> DataFrame:
    """(id, path) of files (id, name, parent): names joined along the parent chain, at most `most` levels up.

    Each round doubles the levels that a file's chain covers, so a chain of 64 takes six joins.
    """
    step = files.select("id", F.col("name").alias("path"), F.col("parent").alias("up"))
    for _ in range(most.bit_length() - 1):
        above = step.select(F.col("id").alias("up_id"), F.col("path").alias("up_path"), F.col("up").alias("next"))
        step = step.join(above, F.col("up") == F.col("up_id"), "left").select("id", F.concat_ws("/", "up_path", "path").alias("path"), F.col("next").alias("up"))
    return step.select("id", F.concat(F.lit("/"), "path").alias("path"))


def feishu_messages(df: DataFrame) -> DataFrame:
    """Messages with their text, and the sender's id."""
    kind = "msg_type" if _has(df, "msg_type") else "message_type"
    body = "body.content" if _has(df, "body") else "content"
    return df.withColumns({"text": feishu_text(body, kind), "sender": _at(df, "sender.id") if isinstance(df.schema["sender"].dataType, T.StructType) else F.col("sender")} if _has(df, "sender") else {"text": feishu_text(body, kind)})


#: By preset: the flattener of its raw records, and the field by which raw records are known (flat ones pass as they are).
FLATTENERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "slack.messages": (slack_messages, "ts"), "github.issues": (github_issues, "user"), "github.pulls": (github_pulls, "user"), "jira.issues": (jira_issues, "fields"), "linear.issues": (linear_issues, "identifier"), "linear.users": (linear_users, "email"),
    "hubspot.contacts": (hubspot_objects, "properties"), "hubspot.companies": (hubspot_objects, "properties"), "hubspot.deals": (hubspot_objects, "properties"), "hubspot.tickets": (hubspot_objects, "properties"),
    "gmail.messages": (gmail_messages, "payload"), "feishu.messages": (feishu_messages, "content"),
}


def flattened(preset: str | None, rows: DataFrame) -> DataFrame:
    """Raw records of a preset's source as its flat records."""
    flat, raw = FLATTENERS.get(preset or "", (None, ""))
    known = flat is not None and (_has(rows, raw) or preset == "feishu.messages" and _has(rows, "body"))
    return flat(rows) if known else rows
