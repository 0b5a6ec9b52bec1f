"""Session files of both producers as sessions, messages and written files.

Every parser takes lines ``(path, line_no, raw)`` and returns one row a message
or a session, so files are never read by the driver. Lines of a file meet only
in aggregates of scalars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from . import jsonl

_WRITE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
_CWD = r"Current working directory:[^\S\n]*([^\n]*\S)"


@dataclass
class Parsed:
    """sessions: a row a file with messages; messages: (path, line_no, role,
    text); files: (path, file, line_no); skipped: (path, skipped)."""

    sessions: DataFrame
    messages: DataFrame
    files: DataFrame
    skipped: DataFrame


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\.jsonl$", 1)


def _first(value: Column, line: Column) -> Column:
    """The value of the first line that has one."""
    return F.min_by(value, F.when(value.isNotNull(), line))


def _given(value: Column) -> Column:
    return F.when(value != "", value)


def _finish(per_file: DataFrame, messages: DataFrame, files: DataFrame, lines: DataFrame) -> Parsed:
    sessions = per_file.join(messages.select("path").distinct(), "path", "left_semi")
    sessions = sessions.filter("session_id <> ''")
    return Parsed(sessions, messages.filter(stem(F.col("path")) != ""), files.filter(stem(F.col("path")) != ""), jsonl.skipped_lines(lines))


def parse_a(lines: DataFrame) -> Parsed:
    """The first producer's files: typed entries with a message each."""
    v = F.col("v")
    meta = F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)) & (jsonl.kind(jsonl.at(v, "$.isMeta")) == "BOOLEAN")
    entries = jsonl.parsed(lines).filter(v.isNotNull() & ~F.coalesce(meta, F.lit(False)))
    slug = F.when(jsonl.at(v, "$.slug").isNotNull(), _given(jsonl.string_at(v, "$.slug"))).otherwise(_given(jsonl.string_at(v, "$.leafName")))
    message, kind, role = jsonl.at(v, "$.message"), jsonl.string_at(v, "$.type"), jsonl.string_at(v, "$.role")
    content = F.when(jsonl.kind(message) == "OBJECT", jsonl.at(v, "$.message.content")).when(jsonl.kind(message) == "STRING", message).otherwise(jsonl.at(v, "$.content"))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    is_user = either(role == "user", kind.isin("user", "human"))
    is_assistant = either(role == "assistant", kind == "assistant")
    entries = entries.select(
        "path", "line_no", jsonl.string_at(v, "$.cwd").alias("cwd"), slug.alias("slug"), jsonl.time_at(v, "$.timestamp").alias("ts"),
        F.when(is_user, "user").when(is_assistant, "assistant").alias("role"), content.alias("content"),
    )
    name = stem(F.col("path"))
    per_file = entries.groupBy("path").agg(_first(_given(F.col("cwd")), F.col("line_no")).alias("project"), _first(F.col("slug"), F.col("line_no")).alias("slug"), F.min("ts").alias("timestamp_ms"))
    per_file = per_file.select(
        name.alias("session_id"), F.lit(model.SOURCES[0]).alias("source"), "path", F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce("slug", F.substring(name, 1, 12)).alias("slug"), "timestamp_ms",
    )
    said = entries.filter("role is not null")
    messages = said.select("path", "line_no", "role", jsonl.text_of(F.col("content")).alias("text")).filter("text <> ''")
    block = F.col("block")
    target = F.when(jsonl.at(block, "$.input.file_path").isNotNull(), jsonl.string_at(block, "$.input.file_path")).otherwise(jsonl.string_at(block, "$.input.notebook_path"))
    tools = said.select("path", "line_no", F.posexplode(jsonl.blocks(F.col("content"))).alias("pos", "block"))
    tools = tools.filter((jsonl.string_at(block, "$.type") == "tool_use") & jsonl.string_at(block, "$.name").isin(*_WRITE_TOOLS))
    files = tools.select("path", target.alias("file"), "line_no", "pos").filter(valid_path(F.col("file")))
    files = files.groupBy("path", "file").agg(F.min(F.struct("line_no", "pos")).alias("first"))
    return _finish(per_file, messages, files, lines)


def valid_path(path: Column) -> Column:
    return (path != "") & ~path.rlike(r"[\r\n]") & (F.octet_length(path) <= model.PATH_BYTES)


def date_of_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?:^|[/\\])sessions[/\\]([0-9]{4}[/\\][^/\\]{2}[/\\][^/\\]{2})(?:[/\\]|$)", 1)
    return F.when(found != "", F.regexp_replace(found, r"[/\\]", "-"))


def short_uuid(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?:^|-)([0-9A-Fa-f]{8})-[0-9A-Fa-f]{4}-[^-]{4}-[^-]{4}-[^-]{12,}", 1)
    return F.when(found != "", found)


def cwd_of_text(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, _CWD, 1)), F.lit(""))


def parse_b(lines: DataFrame) -> Parsed:
    """The second producer's files: typed lines, or old ones with a role on top."""
    v, name = F.col("v"), stem(F.col("path"))
    entries = jsonl.parsed(lines).filter(v.isNotNull())
    kind = F.coalesce(jsonl.string_at(v, "$.type"), F.lit(""))
    known = kind.isin("session_meta", "response_item", "event_msg", "turn_context")
    top = jsonl.string_at(v, "$.role")
    old = ~known & F.coalesce(top.isin("user", "assistant"), F.lit(False))
    role = F.when(kind == "response_item", jsonl.string_at(v, "$.payload.role")).when(old, top)
    content = F.when(kind == "response_item", jsonl.at(v, "$.payload.content")).when(old, jsonl.at(v, "$.content"))
    # the first line of an old entry's blocks that names a folder
    cwds = F.filter(F.transform(jsonl.blocks(content), lambda b: cwd_of_text(jsonl.string_at(b, "$.text"))), lambda c: c.isNotNull())
    cwd = F.when(kind == "session_meta", _given(jsonl.string_at(v, "$.payload.cwd"))).when(old, F.get(cwds, F.lit(0)))
    own = F.when((kind == "session_meta") & name.startswith("rollout-"), _given(jsonl.string_at(v, "$.payload.id")))
    entries = entries.select("path", "line_no", jsonl.time_at(v, "$.timestamp").alias("ts"), role.alias("role"), content.alias("content"), cwd.alias("cwd"), own.alias("id"))
    # an id that does not start like a file's name is not replaced by later ones
    replaced = F.coalesce(_first(F.when(~F.col("id").startswith("rollout-"), F.col("id")), F.col("line_no")), F.max_by("id", F.when(F.col("id").isNotNull(), F.col("line_no"))))
    per_file = entries.groupBy("path").agg(replaced.alias("id"), _first(F.col("cwd"), F.col("line_no")).alias("project"), F.min("ts").alias("timestamp_ms"))
    day, short = date_of_path(F.col("path")), short_uuid(name)
    session = F.coalesce("id", name)
    slug = F.coalesce(F.concat_ws("-", day, short), F.lit(""))
    per_file = per_file.select(
        session.alias("session_id"), F.lit(model.SOURCES[1]).alias("source"), "path", F.coalesce("project", F.lit("")).alias("project"),
        F.when(slug != "", slug).otherwise(F.substring(session, 1, 8)).alias("slug"), "timestamp_ms",
    )
    said = entries.filter(F.col("role").isin(*model.ROLES))
    messages = said.select("path", "line_no", "role", jsonl.text_of(F.col("content")).alias("text")).filter((F.col("text") != "") & ~tx.is_boilerplate(F.col("text")))
    files = messages.sparkSession.createDataFrame([], "path string, file string, first struct<line_no: bigint, pos: int>")
    return _finish(per_file, messages, files, lines)


PARSERS = {model.SOURCES[0]: parse_a, model.SOURCES[1]: parse_b}


def parse(lines: DataFrame, source: str) -> Parsed:
    return PARSERS[source](lines)
