"""The engine as one object: index, search, show, classify, status, doctor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions.vector import Embedder
from .operators import chunking, conversation, maintain
from .plans import index as indexing
from .plans import search as searching
from .sources import manifest
from .sources.warehouse import Warehouse


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, embedder: Embedder | None = None):
        self.spark, self.house, self.embedder = spark, Warehouse(spark, path), embedder

    def index(self, roots: dict[str, str] | None = None, force: bool = False, budget: int | None = None, token_budget: int | None = None) -> indexing.IndexStats:
        """budget: chunks to embed in this run; token_budget: tokens of one forward
        pass of the embedder, ``model.TOKEN_BUDGET`` at most."""
        roots = roots or {s: manifest.resolve_root(s) for s in model.SOURCES}
        if token_budget is not None:
            token_budget = min(token_budget, model.TOKEN_BUDGET)
        return indexing.index(self.spark, self.house, roots, self.embedder, force, budget, token_budget)

    def rebuild(self, roots: dict[str, str] | None = None, token_budget: int | None = None) -> indexing.IndexStats:
        """Index every file anew and drop what nothing owns."""
        stats = self.index(roots, force=True, token_budget=token_budget)
        self.house.write(maintain.repaired(self.house.read()))
        self.house.vacuum()
        return stats

    def tables(self) -> dict[str, DataFrame]:
        if self.house.state() == "stale":
            raise model.UsageError("the tables are of another version", "run rebuild")
        return self.house.read()

    def search(self, query: str | None = None, opts: model.SearchOptions | None = None) -> tuple[DataFrame, model.SearchMeta]:
        opts = opts or model.SearchOptions()
        if not 0 <= opts.limit <= model.LIMIT_MOST:
            raise model.UsageError(f"a limit is from 1 to {model.LIMIT_MOST}")
        return searching.search(self.tables(), query, opts, self.embedder)

    def show(self, prefix: str, chunk: int | None = None, window: int = model.WINDOW_DEFAULT) -> DataFrame:
        t = self.tables()
        session = conversation.resolve(t["sessions"], prefix)
        if chunk is None:
            return conversation.ordered(t["messages"], session)
        return conversation.around_chunk(t["messages"], t["qa_chunks"], session, chunk, window)

    def classify(self, all_sessions: bool = False, dry_run: bool = False) -> DataFrame:
        t = self.tables()
        if not dry_run:
            change, new = self.house.change(), maintain.reclassified(t["sessions"], t["messages"], all_sessions)
            new = new.join(t["sessions"].select("session_id", F.col("session_type").alias("old")), "session_id").filter(~F.col("session_type").eqNullSafe(F.col("old")))
            if change.remove(("sessions",), new.select("session_id")) is not None:
                change.append("sessions", new)
                change.commit()
        return maintain.classify(t["sessions"], t["messages"], all_sessions)

    def backfill(self) -> int:
        """Give chunks without a range the one that their content proves."""
        t = self.tables()
        found = chunking.backfill_ranges(t["qa_chunks"], t["messages"]).withColumnsRenamed({"lo": "__lo", "hi": "__hi"}).persist()
        n = found.count()
        if n:
            out = t["qa_chunks"].join(found, "chunk_id", "left")
            out = out.withColumns({"lo": F.coalesce("lo", "__lo"), "hi": F.coalesce("hi", "__hi")})
            self.house.write({"qa_chunks": out.select(*[f.name for f in model.CHUNKS])})
        found.unpersist()
        return n

    def backfill_files(self) -> tuple[int, int]:
        """Record the written files of sessions that lack them."""
        return indexing.backfill_files(self.house)

    def optimize(self) -> None:
        """Merge the segments of all tables; index the trigrams of messages where
        the tables came without an index."""
        if "postings" not in self.tables():
            indexing.write_postings(self.house)
        self.house.compact(whole=True)

    def status(self) -> DataFrame:
        return maintain.status(self.tables())

    def doctor(self, fix: bool = False) -> DataFrame:
        t = self.tables()
        if fix:
            self.house.write(maintain.repaired(t))
            t = self.tables()
        return maintain.doctor(t, self.embedder.dims if self.embedder else None)
