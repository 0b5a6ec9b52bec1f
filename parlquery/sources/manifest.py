"""Which session files there are, and which changed since they were indexed."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


@dataclass
class Root:
    """One producer's folder: scanned whole, missing, or only in part."""

    source: str
    path: str
    state: str = "scanned"  # scanned, missing_root, incomplete_enumeration


def resolve_root(source: str, environ: dict[str, str] | None = None) -> str:
    """The folder of a producer: an override, else its own setting, else below home."""
    env = os.environ if environ is None else environ
    home = env.get("HOME", str(Path.home()))
    override = env.get(f"PARLQUERY_{source.upper()}_DIR", "").strip()
    if override:
        return override
    own, tail = {"claude": ("CLAUDE_CONFIG_DIR", "projects"), "codex": ("CODEX_HOME", "sessions")}[source]
    base = env.get(own, "").strip() or os.path.join(home, f".{source}")
    return os.path.join(base, tail)


def walk(root: str, depth: int = model.SCAN_DEPTH) -> tuple[list[tuple[str, float]], bool]:
    """``(path, mtime)`` of all ``.jsonl`` files below a folder, and whether all
    of it could be read. Links are not followed, nor folders from ``depth`` on."""
    found, whole, todo = [], True, [(root, 0)]
    while todo:
        folder, level = todo.pop()
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    try:
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if level + 1 < depth:
                                todo.append((e.path, level + 1))
                        elif e.name.endswith(".jsonl"):
                            found.append((e.path, e.stat(follow_symlinks=False).st_mtime))
                    except OSError:
                        whole = False
        except OSError:
            whole = False
    return sorted(found), whole


def scan(spark: SparkSession, roots: dict[str, str]) -> tuple[DataFrame, list[Root]]:
    """The manifest ``(path, source, mtime)`` of all roots and how each went."""
    rows, states = [], []
    for source, path in roots.items():
        if not os.path.isdir(path):
            states.append(Root(source, path, "missing_root"))
            continue
        found, whole = walk(path)
        rows += [(p, source, m) for p, m in found]
        states.append(Root(source, path, "scanned" if whole else "incomplete_enumeration"))
    return spark.createDataFrame(rows, model.MANIFEST), states


def scan_store(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The manifest of a folder in any store that Spark reads, listed by Spark;
    it cannot tell a folder that was read in part, so it deletes nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select("path", F.lit(source).alias("source"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def diff(manifest: DataFrame, sessions: DataFrame, force: bool = False) -> DataFrame:
    """``(path, source, session_id, state)``: new, changed, unchanged or orphan.
    A time that is not known counts as changed."""
    old = sessions.select(F.col("file_path").alias("old_path"), "session_id", F.col("mtime").alias("old_mtime"), F.col("source").alias("old_source"))
    both = manifest.join(old, F.col("path") == F.col("old_path"), "full_outer")
    fresh = F.coalesce(F.abs(F.col("mtime") - F.col("old_mtime")) < model.FRESH_SECONDS, F.lit(False)) & F.lit(not force)
    state = F.when(F.col("path").isNull(), "orphan").when(F.col("old_path").isNull(), "new").when(fresh, "unchanged").otherwise("changed")
    return both.select(F.coalesce("path", "old_path").alias("path"), F.coalesce("source", "old_source").alias("source"), "session_id", state.alias("state"))


def orphans(found: DataFrame, roots: list[Root]) -> DataFrame:
    """Orphans that may go: only of sources whose folder was read whole."""
    whole = [r.source for r in roots if r.state == "scanned"]
    return found.filter((F.col("state") == "orphan") & F.col("source").isin(whole))


def skipped_roots(sessions: DataFrame, roots: list[Root]) -> DataFrame:
    """``(source, path, reason, preserved)`` of the roots that were not read
    whole; a missing one is only told where sessions of it are kept."""
    spark = sessions.sparkSession
    skipped = spark.createDataFrame([(r.source, r.path, r.state) for r in roots if r.state != "scanned"], "source string, path string, reason string")
    kept = sessions.groupBy("source").agg(F.count("*").alias("preserved"))
    out = skipped.join(kept, "source", "left").withColumn("preserved", F.coalesce("preserved", F.lit(0)))
    return out.filter("preserved > 0 or reason <> 'missing_root'")
