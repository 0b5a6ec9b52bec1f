"""Schemas, constants, options and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

# Fixed values that results depend on.
RRF_K = 60
HALF_LIFE_DAYS = 30
RECENCY_WEIGHT = 0.2
OVERSAMPLE = 3
DAY_MS = 86_400_000
CHUNK_BYTES = 16_000
EMBED_BATCH = 128
WINDOW_DEFAULT, WINDOW_MOST = 5, 50
LIMIT_DEFAULT, LIMIT_MOST = 10, 100
MESSAGE_CHARS = 4_000
NOTE_CHARS = 120
SNIPPET_TRIGRAMS = 20
SHORT_COMBINATIONS = 100
TOKEN_BUDGET = 256_000
SCAN_DEPTH = 10
PATH_BYTES = 4_096
FRESH_SECONDS = 0.001
OPTIMIZE_FROM = 500
BUSY_TRIES = 5

SOURCES = ("claude", "codex")
ROLES = ("user", "assistant")
INTERACTIVE, AUTOMATED = "interactive", "automated"

_S, _L = T.StringType(), T.LongType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SESSIONS = _schema(("session_id", _S), ("source", _S), ("file_path", _S), ("project", _S), ("slug", _S), ("timestamp_ms", _L), ("mtime", T.DoubleType()), ("session_type", _S), ("files_scanned", T.IntegerType()))
MESSAGES = _schema(("msg_id", _L), ("session_id", _S), ("role", _S), ("text", _S))
CHUNKS = _schema(("chunk_id", _L), ("session_id", _S), ("content", _S), ("timestamp_ms", _L), ("lo", _L), ("hi", _L))
VECTORS = _schema(("chunk_id", _L), ("sub_idx", T.IntegerType()), ("embedding", T.ArrayType(T.FloatType())))
SESSION_FILES = _schema(("session_id", _S), ("path", _S))
LINES = _schema(("path", _S), ("line_no", _L), ("raw", _S))
MANIFEST = _schema(("path", _S), ("source", _S), ("mtime", T.DoubleType()))

#: Which messages hold which trigrams.
POSTINGS = _schema(("trigram", _S), ("msg_id", _L))

TABLES = {"sessions": SESSIONS, "messages": MESSAGES, "qa_chunks": CHUNKS, "vec_chunks": VECTORS, "session_files": SESSION_FILES}


@dataclass(frozen=True)
class CurrentSession:
    """What to do with the session that asks: ignore it, leave it out, or search it alone."""

    mode: str = "ignore"  # ignore, exclude, only
    session_id: str | None = None


@dataclass(frozen=True)
class SearchOptions:
    project: str | None = None
    days: int | None = None
    source: str | None = None
    file: str | None = None
    limit: int = LIMIT_DEFAULT
    current: CurrentSession = field(default_factory=CurrentSession)
    include_automated: bool = False
    now_ms: int | None = None
    #: Filters before the nearest-neighbour limit; off, they come after it.
    prefilter: bool = False


@dataclass
class SearchMeta:
    """What a caller has to know beside the hits."""

    mode: str = "fts"
    vec_degraded: bool = False
    results_incomplete: bool = False
    notes: list[str] = field(default_factory=list)


class ErrorCode(IntEnum):
    USAGE_ERROR = 64
    DATA_ERROR = 65
    INTERNAL = 70
    IO_ERROR = 74
    TEMP_FAILURE = 75
    UNKNOWN = 104


class EngineError(Exception):
    """A failure with a code, and what to do next."""

    code = ErrorCode.UNKNOWN

    def __init__(self, message: str, next_step: str = "", candidates: list[str] | None = None):
        super().__init__(message)
        self.next_step, self.candidates = next_step, candidates or []


class UsageError(EngineError):
    code = ErrorCode.USAGE_ERROR


class DataError(EngineError):
    code = ErrorCode.DATA_ERROR


class TemporaryError(EngineError):
    code = ErrorCode.TEMP_FAILURE


def classify_error(error: BaseException) -> ErrorCode:
    if isinstance(error, EngineError):
        return error.code
    if isinstance(error, OSError):
        return ErrorCode.IO_ERROR
    if isinstance(error, (AssertionError, TypeError)):
        return ErrorCode.INTERNAL
    return ErrorCode.UNKNOWN
