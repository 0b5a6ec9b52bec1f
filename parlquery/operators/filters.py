"""Filters of a search, as one set of sessions for every leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx


def allowed_sessions(sessions: DataFrame, files: DataFrame | None, opts: model.SearchOptions, now_ms: int) -> DataFrame:
    """``(session_id)`` of the sessions that a search may return."""
    out = sessions.filter("session_id is not null")
    if opts.project is not None:
        out = out.filter(tx.ascii_lower(F.col("project")).startswith(tx.fold(opts.project)))
    if opts.days is not None:
        out = out.filter(F.col("timestamp_ms") >= now_ms - opts.days * model.DAY_MS)
    if opts.source is not None:
        out = out.filter(F.col("source") == opts.source)
    if opts.current.mode == "exclude":
        out = out.filter(F.col("session_id") != opts.current.session_id)
    if opts.current.mode == "only":
        out = out.filter(F.col("session_id") == opts.current.session_id)
    if not opts.include_automated:
        out = out.filter(F.coalesce("session_type", F.lit(model.INTERACTIVE)) != model.AUTOMATED)
    if opts.file is not None:
        if files is None:
            raise model.UsageError("files are not indexed", "run index first")
        wanted = (F.col("path") == opts.file) | tx.ascii_lower(F.col("path")).endswith(tx.fold("/" + opts.file))
        out = out.join(files.filter(wanted).select("session_id"), "session_id", "left_semi")
    return out.select("session_id")


def open_to_all(opts: model.SearchOptions) -> bool:
    """Whether no filter is given, so that hits without a session matter too."""
    given = (opts.project, opts.days, opts.source, opts.file)
    return opts.include_automated and opts.current.mode == "ignore" and all(x is None for x in given)


def resolve_current(exclude: bool = False, only: bool = False, environ: dict[str, str] | None = None, variable: str = "SESSION_ID") -> model.CurrentSession:
    """What flags and the environment say about the asking session."""
    if exclude and only:
        raise model.UsageError("exclude and only exclude one another")
    own = (environ or {}).get(variable, "").strip()
    if only:
        if not own:
            raise model.UsageError("no session asks", f"set {variable}")
        return model.CurrentSession("only", own)
    return model.CurrentSession("exclude", own) if exclude and own else model.CurrentSession()


def known_sources(hits: DataFrame) -> DataFrame:
    """Hits whose session has a source that is known; they go before any limit."""
    return hits.filter(F.coalesce(F.col("source").isin(*model.SOURCES), F.lit(False)))
