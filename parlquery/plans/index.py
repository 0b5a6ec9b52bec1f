"""Incremental indexing: files to sessions, messages, chunks and embeddings."""

from __future__ import annotations

import contextlib
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from ..functions.vector import Embedder, embed_batches
from ..operators import chunking, fts, maintain
from ..operators.numbering import dense_ids
from ..sources import jsonl, manifest, producers
from ..sources.warehouse import Change, Conflict, Warehouse


#: Shares of the sessions that messages are numbered in.
SHARES = 1 << 16


@dataclass
class IndexStats:
    new: int = 0
    changed: int = 0
    unchanged: int = 0
    preserved: int = 0
    removed: int = 0
    skipped_lines: int = 0
    chunks: int = 0
    embedded: int = 0
    failed: int = 0
    first_error: str | None = None
    skipped_roots: list = field(default_factory=list)


def index(spark: SparkSession, house: Warehouse, roots: dict[str, str], embedder: Embedder | None = None, force: bool = False, budget: int | None = None, token_budget: int | None = None) -> IndexStats:
    """Bring the tables up to date with the files, in one version. All of a
    changed session goes before it is read anew; sessions whose file is gone go
    only if their root was read whole. Without an embedder, sessions that have
    embeddings stay. If another run adds a version meanwhile, this one starts anew
    from what that one left."""
    for tries in range(model.BUSY_TRIES):
        change = house.change()
        stats = _index(spark, change, roots, embedder, force, budget, token_budget)
        try:
            change.commit()
            break
        except Conflict:
            if tries + 1 == model.BUSY_TRIES:
                raise
    if force or stats.new + stats.changed >= model.OPTIMIZE_FROM:
        with contextlib.suppress(Conflict):  # the next run merges what this one cannot
            house.compact()
    return stats


def _index(spark: SparkSession, change: Change, roots: dict[str, str], embedder: Embedder | None, force: bool, budget: int | None, token_budget: int | None) -> IndexStats:
    stats, t = IndexStats(), change.read()
    listed, states = manifest.scan(spark, roots)
    found = manifest.diff(listed, t["sessions"], force)
    if embedder is None:
        kept = maintain.embedded_sessions(t["qa_chunks"], t["vec_chunks"])
        held = found.filter("state = 'changed'").join(kept, "session_id", "left_semi").select("path", F.lit(True).alias("held"))
        found = found.join(held, "path", "left").withColumn("state", F.when(F.col("held"), "preserved").otherwise(F.col("state"))).drop("held")
    counted = {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
    stats.new, stats.changed, stats.unchanged, stats.preserved = (counted.get(k, 0) for k in ("new", "changed", "unchanged", "preserved"))
    stats.skipped_roots = [r.asDict() for r in manifest.skipped_roots(t["sessions"], states).collect()]
    todo = found.filter("state in ('new', 'changed')")
    # a file that has no messages any more leaves no session
    gone = found.filter("state = 'changed'").select("path", "session_id").unionByName(manifest.orphans(found, states).select("path", "session_id"))
    stats.removed = manifest.orphans(found, states).count()
    sessions, messages, files = [], [], []
    for source in roots:
        paths = [r[0] for r in todo.filter(F.col("source") == source).select("path").collect()]  # names to open
        if not paths:
            continue
        parsed = producers.parse(jsonl.read_lines(spark, paths), source)
        stats.skipped_lines += parsed.skipped.agg(F.sum("skipped")).first()[0] or 0
        sessions.append(parsed.sessions)
        messages.append(parsed.messages)
        files.append(parsed.files)
    fresh, gone = None, gone.select("session_id")
    if sessions:
        union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # of files with the same session id the last one by name counts
        fresh = union(sessions).join(listed.select("path", "mtime"), "path")
        fresh = fresh.groupBy("session_id").agg(F.max_by(F.struct("*"), "path").alias("r")).select("r.*")
        # new sessions have nothing to take away, unless chunks are left of their ids
        known = t["sessions"].select("session_id").unionByName(t["qa_chunks"].select("session_id"))
        gone = gone.unionByName(fresh.select("session_id").join(known, "session_id", "left_semi"))
    _remove(change, t, gone)
    if fresh is not None:
        own = union(messages).join(fresh.select("path", "session_id"), "path")
        own = own.select("session_id", "line_no", "role", tx.strip_control(F.col("text")).alias("text")).filter("text <> ''")
        first = t["messages"].agg(F.coalesce(F.max("msg_id"), F.lit(0)).alias("m")).select("m").scalar()
        # ids rise along each session, which is all that their order means; a
        # block is a share of the sessions, and a long session has many
        block = F.pmod(F.xxhash64("session_id"), F.lit(SHARES)) * F.lit(1 << 24) + F.floor(F.col("line_no") / (1 << 20))
        own = dense_ids(own, "k", ["session_id", "line_no"], block).withColumn("msg_id", F.col("k") + first)
        own = change.append("messages", own.repartitionByRange("msg_id").sortWithinPartitions("msg_id"))
        add_postings(change, own)
        paths = union(files).join(fresh.select("path", "session_id"), "path").select("session_id", F.col("file").alias("path")).distinct()
        paths = change.append("session_files", paths)
        scanned = paths.groupBy("session_id").agg(F.count("*").cast("int").alias("files_scanned"))
        kinds = maintain.first_user_turns(own).select("session_id", tx.classify_first_turn(F.col("text")).alias("session_type"))
        rows = fresh.join(scanned, "session_id", "left").join(kinds, "session_id", "left")
        rows = rows.select(
            "session_id", "source", F.col("path").alias("file_path"), "project", "slug", "timestamp_ms", "mtime",
            F.coalesce("session_type", F.lit(model.INTERACTIVE)).alias("session_type"), F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"),
        )
        change.append("sessions", rows)
    stats.chunks = add_chunks(change)
    if embedder is not None:
        stats.embedded, stats.failed, stats.first_error = embed_pending(change, embedder, budget, token_budget)
    return stats


def _remove(change: Change, t: dict[str, DataFrame], gone: DataFrame) -> None:
    """Take away sessions and all that hangs on them."""
    chunks, messages = t["qa_chunks"], t["messages"]
    ids = change.remove(("sessions", "messages", "session_files", "qa_chunks"), gone)
    if ids is None:
        return
    change.remove(("vec_chunks",), chunks.join(ids, "session_id", "left_semi").select("chunk_id"))
    if "postings" in t:
        left = messages.join(ids, "session_id", "left_semi")
        _count(change, left, -1)
        change.remove(("postings",), left.select("msg_id"))


def _count(change: Change, messages: DataFrame, sign: int) -> None:
    """Keep what ranks need to know of all messages."""
    n, grams = messages.agg(F.count("*"), F.coalesce(F.sum(fts.length()), F.lit(0))).first()
    change.manifest["facts"]["messages"] += sign * n
    change.manifest["facts"]["trigrams"] += sign * grams


def add_postings(change: Change, messages: DataFrame) -> None:
    """Index the trigrams of messages, unless others are there without an index."""
    if "postings" in change.manifest["tables"]:
        _count(change, messages, 1)
        change.append("postings", fts.in_order(fts.postings(messages)))


def add_chunks(change: Change) -> int:
    """Chunk the sessions that have none."""
    t = change.read()
    todo = chunking.unchunked(t["sessions"], t["qa_chunks"]).select("session_id", "timestamp_ms")
    own = t["messages"].join(todo, "session_id", "left_semi")
    first = t["qa_chunks"].agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("m")).select("m").scalar()
    found = chunking.numbered(chunking.chunks(own), own, first).join(todo, "session_id")
    return change.append("qa_chunks", found).count()


def embed_pending(change: Change, embedder: Embedder, budget: int | None = None, token_budget: int | None = None) -> tuple[int, int, str | None]:
    """Embed the newest pending chunks; failed batches stay pending."""
    t = change.read()
    done = embed_batches(maintain.pending_chunks(t["qa_chunks"], t["vec_chunks"], budget), embedder, token_budget=token_budget).persist()
    right, wrong = F.col("error").isNull(), F.col("error").isNotNull()
    told = done.agg(F.count_distinct(F.when(right, F.col("chunk_id"))).alias("ok"), F.count_if(wrong).alias("bad"), F.min_by("error", F.when(wrong, F.col("chunk_id"))).alias("e")).first()
    if told["ok"]:
        change.append("vec_chunks", done.filter("error is null"))
    done.unpersist()
    return told["ok"], told["bad"], told["e"]


def backfill_files(house: Warehouse) -> tuple[int, int]:
    """Read the written files of sessions that never had them recorded. Returns
    how many sessions are settled, and how many stay because their file cannot
    be read now; a file without written files settles its session too."""
    t, spark = house.read(), house.spark
    todo = t["sessions"].filter("files_scanned is null").select("session_id", "source", F.col("file_path").alias("path"))
    found = {source: [r[0] for r in todo.filter(F.col("source") == source).select("path").collect()] for source in model.SOURCES}  # names to open
    there = {s: [p for p in paths if os.access(p, os.R_OK)] for s, paths in found.items()}
    settled, away = sum(map(len, there.values())), sum(map(len, found.values())) - sum(map(len, there.values()))
    if not settled:
        return 0, away
    parts = [producers.parse(jsonl.read_lines(spark, paths), s).files.select("path", "file") for s, paths in there.items() if paths]
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    own = files.join(todo.select("path", "session_id"), "path").select("session_id", F.col("file").alias("path")).distinct()
    counted = own.groupBy("session_id").agg(F.count("*").cast("int").alias("__n"))
    read = spark.createDataFrame([(p,) for paths in there.values() for p in paths], "__path string")
    rows = t["sessions"].join(counted, "session_id", "left").join(read, F.col("file_path") == F.col("__path"), "left")
    new = F.coalesce("files_scanned", F.when(F.col("__path").isNotNull(), F.coalesce("__n", F.lit(0))))
    columns = [f.name for f in model.SESSIONS]
    sessions = rows.withColumn("files_scanned", new).select(*columns)
    house.write({"sessions": sessions, "session_files": t["session_files"].unionByName(own.select("session_id", "path")).distinct()})
    return settled, away


def write_postings(house: Warehouse) -> None:
    """Index the trigrams of all messages, where the tables came without."""
    change = house.change()
    messages = change.read()["messages"]
    change.manifest["facts"] = {"messages": 0, "trigrams": 0}
    change.replace("postings", fts.in_order(fts.postings(messages)))
    _count(change, messages, 1)
    change.commit()
