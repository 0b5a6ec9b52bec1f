"""The search: filters, legs, fusion, recency and excerpts in one plan."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from ..functions.time import format_day
from ..functions.vector import Embedder
from ..operators import excerpt, filters, fts, rank, vector

Tables = dict[str, DataFrame]

_PAGE = ("session_id", "source", "project", "slug", "timestamp_ms")


def now(opts: model.SearchOptions) -> int:
    return int(time.time() * 1000) if opts.now_ms is None else opts.now_ms


def keyword_leg(t: Tables, groups: fts.Groups, opts: model.SearchOptions) -> DataFrame:
    """``(session_id, rank, msg_id)`` of the best sessions that are allowed. The
    statistics of the ranks are those of all messages; where the tables have an
    index of trigrams, only messages that it points to are read."""
    allowed = filters.allowed_sessions(t["sessions"], t.get("session_files"), opts, now(opts))
    ranked = fts.bm25(t["messages"], groups, t.get("postings"), t.get("facts")).join(allowed, "session_id", "left_semi")
    return fts.candidates(ranked, opts.limit)


def vector_leg(t: Tables, query: list[float], opts: model.SearchOptions) -> DataFrame:
    allowed = filters.allowed_sessions(t["sessions"], t.get("session_files"), opts, now(opts))
    return vector.nearest_sessions(t["vec_chunks"], t["qa_chunks"], allowed, query, opts.limit, opts.prefilter)


def with_sessions(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hits with what is known of their sessions; unknown sources go."""
    return filters.known_sources(hits.join(sessions.select(*_PAGE), "session_id"))


def keyword_ranked(t: Tables, groups: fts.Groups, opts: model.SearchOptions) -> DataFrame:
    return rank.by_rank(with_sessions(keyword_leg(t, groups, opts), t["sessions"]), now(opts), opts.limit)


def hybrid_ranked(fts_leg: DataFrame, vec_leg: DataFrame, sessions: DataFrame, opts: model.SearchOptions) -> DataFrame:
    return rank.by_score(with_sessions(rank.fuse(fts_leg, vec_leg), sessions), now(opts), opts.limit)


def file_list(t: Tables, opts: model.SearchOptions) -> DataFrame:
    """The newest sessions that are allowed, without a query."""
    allowed = filters.allowed_sessions(t["sessions"], t.get("session_files"), opts, now(opts))
    own = t["sessions"].join(allowed, "session_id", "left_semi").select(*_PAGE)
    return rank.newest(filters.known_sources(own), opts.limit)


def results(page: DataFrame) -> DataFrame:
    """The columns that callers get."""
    return page.select(
        "session_id", "project", "slug", "source", format_day(F.col("timestamp_ms")).alias("timestamp"), "excerpt",
        F.col("chunk_id").alias("chunk"), tx.inspect_hint(F.col("session_id"), F.col("chunk_id")).alias("inspect"),
    )


def _dropped(hits: DataFrame, sessions: DataFrame) -> bool:
    return hits.join(with_sessions(hits.select("session_id"), sessions).select("session_id"), "session_id", "left_anti").limit(1).count() > 0


def _legs(hits: DataFrame) -> DataFrame:
    """A page of hits, computed once: a few hundred rows at most."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def search(t: Tables, query: str | None, opts: model.SearchOptions, embedder: Embedder | None = None) -> tuple[DataFrame, model.SearchMeta]:
    """A page of results, best first, and what the caller has to know of it."""
    meta, spark = model.SearchMeta(), t["sessions"].sparkSession
    schema = "session_id string, project string, slug string, source string, timestamp string, excerpt string, chunk bigint, inspect string"
    nothing = spark.createDataFrame([], schema)
    if opts.limit <= 0:
        return nothing, meta
    if query is None:
        if opts.file is None:
            raise model.UsageError("a query or a file is needed")
        meta.mode = "files"
        page = _legs(file_list(t, opts))
        return results(page.withColumns({"excerpt": F.lit(""), "chunk_id": F.lit(None).cast("bigint")})), meta
    if not query.strip():
        return nothing, meta
    groups = fts.prepare(t["messages"], query, t.get("postings"))
    empty = spark.createDataFrame([], "session_id string, rank double, msg_id bigint")
    words = _legs(keyword_leg(t, groups, opts)) if groups else empty
    if groups and filters.open_to_all(opts):
        # a message without a session is a hit that cannot be shown
        lost = fts.bm25(t["messages"], groups, t.get("postings"), t.get("facts")).filter("session_id is null").count()
        if lost and words.isEmpty():
            raise model.DataError(f"none of {lost} rows could be read", "run doctor")
        if lost:
            meta.results_incomplete = True
            meta.notes.append(f"{lost} rows could not be read")
    near = None
    if embedder is not None:
        try:
            if not t["vec_chunks"].isEmpty():
                [q] = embedder.embed([query])
                near = _legs(vector_leg(t, [float(x) for x in q], opts))
        except Exception as e:  # one leg is enough to answer, but the caller is told
            meta.vec_degraded = True
            meta.notes.append("semantic search failed: " + tx.cap_note(str(e)))
    if near is None:
        page = rank.by_rank(with_sessions(words, t["sessions"]), now(opts), opts.limit)
        meta.results_incomplete |= _dropped(words, t["sessions"])
        score = "rank"
    else:
        meta.mode = "hybrid"
        page = hybrid_ranked(words, near, t["sessions"], opts)
        meta.results_incomplete |= _dropped(words.select("session_id").unionByName(near.select("session_id")), t["sessions"])
        score = "score"
    page = _legs(page)
    hits = page.select("session_id", score).join(words.select("session_id", "msg_id"), "session_id", "left")
    tiers = []
    if groups:
        flat = [p for g in groups for p in g]
        own = t["messages"].join(F.broadcast(page.select("session_id")), "session_id", "left_semi")  # a page of results
        tiers += [excerpt.by_range(hits, t["qa_chunks"]), excerpt.by_substring(hits, own, t["qa_chunks"]), excerpt.by_snippet(hits, own, fts.matches(own, groups), flat)]
    if near is not None:
        tiers.append(excerpt.by_vector(near.join(page.select("session_id"), "session_id", "left_semi"), t["qa_chunks"]))
    if not tiers:
        return nothing, meta
    shown = results(excerpt.attach(page, tiers).join(hits.select("session_id", F.col(score).alias("__s")), "session_id"))
    order = [r[0] for r in page.select("session_id").collect()]  # a page of results
    if not order:
        return nothing, meta
    return shown.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("session_id"))), meta
