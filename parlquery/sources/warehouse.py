"""Tables as segments of Parquet under numbered versions.

A version is a small file that names the segments of every table. A run adds
segments with what is new and lists of the keys that go, and then its version in
one step, so that what it writes is in proportion to what changed, readers see
all tables of one version, and a run that fails leaves the last one as it was.
Two runs that start from one version cannot both add the next: the later one gets
``Conflict`` and begins anew from what the first one left.

Every row has the number of the version that wrote it. A key goes from segments
older than its list, so a session can be replaced within one version. Segments
are merged by size (``compact``), so each row is written again a number of times
that grows with the logarithm of the archive alone.
"""

from __future__ import annotations

import copy
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

SCHEMA_VERSION = 2

#: By which column the rows of a table go.
KEYS = {"sessions": "session_id", "messages": "session_id", "session_files": "session_id", "qa_chunks": "session_id", "vec_chunks": "chunk_id", "postings": "msg_id"}

#: Segments and lists of a table from which small ones are merged.
SEGMENTS = 32

#: The number of the version that wrote a row, and up to which one a key goes.
_AT, _UPTO = "written_at_version", "upto_version"


class Conflict(model.TemporaryError):
    """Another run added its version first."""


def default_path(environ: dict[str, str] | None = None) -> str:
    """Below the data home if that is absolute, else below the home folder."""
    env = os.environ if environ is None else environ
    base = env.get("XDG_DATA_HOME", "").strip()
    if not os.path.isabs(base):
        base = os.path.join(env.get("HOME", os.path.expanduser("~")), ".local", "share")
    return os.path.join(base, "parlquery")


def _schema(name: str) -> T.StructType:
    return model.POSTINGS if name == "postings" else model.TABLES[name]


class Warehouse:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or default_path()

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _list(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(e.getPath().getName() for e in fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._list("versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``schema``, ``facts`` and, by table, ``segments`` and ``gone``."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": SCHEMA_VERSION, "facts": {"messages": 0, "trigrams": 0}, "tables": {"postings": {"segments": [], "gone": []}}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{version:010d}.json").first()[0]
        return json.loads(text)

    def state(self) -> str:
        """``empty``, ``current``, or ``stale`` if the tables are of other columns."""
        if not self.version():
            return "empty"
        found = self.manifest()
        own = found["schema"] == SCHEMA_VERSION and all(found.get("columns", {}).get(n) == s.simpleString() for n, s in model.TABLES.items())
        return "current" if own else "stale"

    def tables(self, manifest: dict) -> dict[str, DataFrame]:
        """The tables that a manifest names; columns that older segments lack are
        null. ``postings`` and ``facts`` are there if they cover all messages."""
        out = {name: self._table(name, manifest["tables"].get(name, {})) for name in model.TABLES}
        if "postings" in manifest["tables"] and manifest["facts"]:
            out["postings"] = self._table("postings", manifest["tables"]["postings"])
            facts = manifest["facts"]
            out["facts"] = self.spark.createDataFrame([(facts["messages"], facts["trigrams"])], "messages bigint, trigrams bigint")
        return out

    def _table(self, name: str, parts: dict) -> DataFrame:
        schema, segments, lists = _schema(name), parts.get("segments", []), parts.get("gone", [])
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self._live(name, segments, lists).drop(_AT)

    def _gone(self, name: str, lists: list[str]) -> DataFrame:
        """``(key, up to which version its rows go)``."""
        schema = T.StructType().add("key", _schema(name)[KEYS[name]].dataType).add(_UPTO, T.LongType())
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}" for s in lists]).groupBy("key").agg(F.max(_UPTO).alias(_UPTO))

    def _live(self, name: str, segments: list[str], lists: list[str]) -> DataFrame:
        """The rows of segments that no list takes away, with their versions."""
        rows = self.spark.read.schema(T.StructType(list(_schema(name).fields)).add(_AT, T.LongType())).parquet(*[f"{self.path}/{s}" for s in segments])
        if not lists:
            return rows
        gone = self._gone(name, lists)
        return rows.join(gone, (rows[KEYS[name]] == gone["key"]) & (rows[_AT] < gone[_UPTO]), "left_anti")

    def read(self) -> dict[str, DataFrame]:
        return self.tables(self.manifest())

    def change(self) -> Change:
        """What will be the next version."""
        return Change(self)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A version with these tables in place of what they were."""
        change = self.change()
        for name, df in tables.items():
            if name in model.TABLES:
                change.replace(name, df)
        return change.commit()

    def compact(self, whole: bool = False) -> int:
        """Merge small segments of tables that have many; ``whole`` merges all and
        drops the lists of what has gone. Returns how many tables were merged."""
        change, merged = self.change(), 0
        for name, parts in change.manifest["tables"].items():
            if whole and (len(parts["segments"]) > 1 or parts["gone"]):
                take = list(parts["segments"])
            elif len(parts["segments"]) + len(parts["gone"]) > SEGMENTS:
                take, held = [], 0
                for size, s in sorted((self._fs(f"{self.path}/{s}")[0].getContentSummary(self._fs(f"{self.path}/{s}")[1]).getLength(), s) for s in parts["segments"]):
                    if len(take) > 1 and size > held:
                        break
                    take.append(s)
                    held += size
            else:
                continue
            change.merge(name, take)
            merged += 1
        if merged:
            change.commit()
        return merged

    def vacuum(self) -> int:
        """Delete what the last version does not name."""
        last, gone = self.version(), 0
        parts = self.manifest()["tables"].values()
        named = {s.split("/")[1] for p in parts for s in (*p["segments"], *p["gone"])}
        old = [f"versions/{n}" for n in self._list("versions") if n != f"{last:010d}.json"]
        for name in [*old, *(f"data/{n}" for n in self._list("data") if n not in named)]:
            fs, at = self._fs(f"{self.path}/{name}")
            gone += fs.delete(at, True)
        return gone


class Change:
    """The next version, as far as it is written."""

    def __init__(self, house: Warehouse):
        self.house, self.base = house, house.version()
        self.manifest = copy.deepcopy(house.manifest(self.base))
        self.number = self.base + 1
        self._token = f"data/{self.number:010d}-{uuid.uuid4().hex}"

    def read(self) -> dict[str, DataFrame]:
        return self.house.tables(self.manifest)

    def _save(self, df: DataFrame, name: str) -> str:
        at = f"{self._token}/{name}-{uuid.uuid4().hex[:8]}"
        fs, folder = self.house._fs(self.house.path)
        if not fs.exists(folder):
            fs.mkdirs(folder)
            # what assistants were told is for the owner alone
            fs.setPermission(folder, self.house.spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
        df.write.parquet(f"{self.house.path}/{at}")
        return at

    def _parts(self, name: str) -> dict:
        return self.manifest["tables"].setdefault(name, {"segments": [], "gone": []})

    def _rows(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in _schema(name)], F.lit(self.number).cast("bigint").alias(_AT))

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to a table; returns them as written."""
        at = self._save(self._rows(name, df), name)
        self._parts(name)["segments"].append(at)
        return self.house.spark.read.schema(_schema(name)).parquet(f"{self.house.path}/{at}")

    def remove(self, names: tuple[str, ...], keys: DataFrame) -> DataFrame | None:
        """Take away the rows of all earlier versions that have these keys, from
        tables with one kind of key; returns the keys as written, None if none."""
        [column] = keys.columns
        own = keys.select(F.col(column).alias("key")).filter("key is not null").distinct().withColumn(_UPTO, F.lit(self.number).cast("bigint"))
        at = self._save(own, "gone")
        kind = _schema(names[0])[KEYS[names[0]]].dataType
        rows = self.house.spark.read.schema(T.StructType().add("key", kind)).parquet(f"{self.house.path}/{at}")
        if rows.isEmpty():
            return None
        for name in names:
            if self._parts(name)["segments"]:
                self._parts(name)["gone"].append(at)
        return rows.select(F.col("key").alias(column))

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a table whole. Messages take the index of their trigrams along."""
        at = self._save(self._rows(name, df), name)
        self.manifest["tables"][name] = {"segments": [at], "gone": []}
        if name == "messages":
            self.manifest["tables"].pop("postings", None)
            self.manifest["facts"] = None

    def merge(self, name: str, take: list[str]) -> None:
        """Some segments of a table as one; rows keep their versions."""
        parts = self._parts(name)
        rows = self.house._live(name, take, parts["gone"])
        if order := {"messages": ["msg_id"], "postings": ["trigram", "msg_id"]}.get(name):
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        at = self._save(rows, name)
        rest = [s for s in parts["segments"] if s not in take]
        gone = parts["gone"] if rest else []
        if len(gone) > 1:
            gone = [self._save(self.house._gone(name, gone), "gone")]
        self.manifest["tables"][name] = {"segments": [*rest, at], "gone": gone}

    def commit(self) -> int:
        """Make this the last version, unless another run has made one."""
        self.manifest["schema"] = SCHEMA_VERSION
        self.manifest["columns"] = {n: s.simpleString() for n, s in model.TABLES.items()}
        fs, folder = self.house._fs(f"{self.house.path}/versions")
        fs.mkdirs(folder)
        name, data = f"{self.house.path}/versions/{self.number:010d}.json", json.dumps(self.manifest)
        fs, new = self.house._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(data.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                plain = lambda p: self.house._fs(p)[1].toUri().getPath()
                os.link(new.toUri().getPath(), plain(name))  # fails if it is there, at one step
                fs.delete(new, False)
            elif not fs.rename(new, self.house._fs(name)[1]):  # renames do not replace in a shared store
                raise FileExistsError(name)
        except FileExistsError:
            fs.delete(new, False)
            data_fs, data_at = self.house._fs(f"{self.house.path}/{self._token}")
            data_fs.delete(data_at, True)
            raise Conflict("another run wrote the tables first", "run it again") from None
        return self.number
