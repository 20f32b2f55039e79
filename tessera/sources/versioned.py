"""SNK-09, SNK-15, SNK-16: Parquet tables that change by commits.

A table is a folder of data files and a log. Version n is one file of JSON lines in the log: the files it adds and
removes and, if they changed, the columns. A commit is a rename to the next number that fails where that number is
taken, so of two writers one wins; the other finds what was committed meanwhile and either goes one number up (it
touched nothing of it) or fails. A reader sees the files of one version, whatever is written next to it. Updates
rewrite the files that hold their keys and no others.

The driver handles a line a file (names, not rows), as any listing of a table does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another commit changed what this one was made from."""


@dataclass(frozen=True)
class Snapshot:
    """A version: its live files (name below the table, version that added it) and its columns."""

    version: int
    files: dict[str, int]
    columns: tuple[dict, ...]  # name, type, since (version), default


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------- log

    def _fs_path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _log_files(self) -> dict[int, str]:
        at = self._fs_path("log")
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return {int(n[:20]): n for n in sorted(names) if n.endswith(".json") and n[:20].isdigit()}

    def _read(self, name: str) -> list[dict]:
        at = self._fs_path(f"log/{name}")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def _publish(self, version: int, actions: list[dict]) -> bool:
        """Whether this version is ours: written aside, then renamed unless the name is taken."""
        aside, to = self._fs_path(f"log/.{uuid.uuid4().hex}"), self._fs_path(f"log/{version:020}.json")
        fs = aside.getFileSystem(self._conf)
        out = fs.create(aside, False)
        out.write(bytearray("".join(json.dumps(a) + "\n" for a in actions).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf).rename(aside, to, options)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state at a version, or now."""
        files: dict[str, int] = {}
        columns: tuple[dict, ...] = ()
        last = 0
        for n, name in self._log_files().items():
            if version is not None and n > version:
                break
            last = n
            for a in self._read(name):
                if "remove" in a:
                    files.pop(a["remove"], None)
                elif "add" in a:
                    files[a["add"]] = n
                elif "columns" in a:
                    columns = tuple(a["columns"])
        if not last or (version is not None and version != last):
            raise ValueError(f"{self.path} has no version {version if version is not None else ''}".rstrip())
        return Snapshot(last, files, columns)

    def commit(self, base: int, added: list[str], removed: list[str], columns: tuple[dict, ...] | None = None, blind: bool = False) -> int:
        """Make a version of ``base``; ``blind`` writers (appends) read nothing and never conflict. Others conflict
        with commits since ``base`` that add files or remove those they remove or change the columns."""
        actions = [{"remove": f} for f in removed] + [{"add": f} for f in added]
        if columns is not None:
            actions.insert(0, {"columns": [c | {"since": c["since"] or base + 1} for c in columns]})
        version = base + 1
        while not self._publish(version, actions):
            theirs = self._read(f"{version:020}.json")
            if not blind or any("columns" in a for a in theirs):
                raise CommitConflict(f"version {version} was committed since {base}")
            version += 1
        return version

    # ------------------------------------------------------------- data

    def _files(self, df: DataFrame, prefix: str) -> list[str]:
        """Write rows to a folder of their own; the names of its files."""
        folder = f"data/{prefix}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        at = self._fs_path(folder)
        return [f"{folder}/{s.getPath().getName()}" for s in at.getFileSystem(self._conf).listStatus(at) if s.getPath().getName().endswith(".parquet")]

    def _frame(self, snap: Snapshot, files: dict[str, int]) -> DataFrame:
        """Rows of files with the columns of the snapshot; a column that is younger than a file has its default."""
        schema = T.StructType([T.StructField(c["name"], T._parse_datatype_json_string(json.dumps(c["type"]))) for c in snap.columns])
        out = None
        for version in sorted(set(files.values())):
            part = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f, n in files.items() if n == version])
            late = {c["name"]: F.lit(c["default"]).cast(schema[c["name"]].dataType) for c in snap.columns if c["since"] > version}
            part = part.withColumn("_file", F.col("_metadata.file_path")).withColumns(late)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema.add("_file", "string"))

    def read(self, version: int | None = None) -> DataFrame:
        snap = self.snapshot(version)
        return self._frame(snap, snap.files).drop("_file")

    def create(self, df: DataFrame) -> int:
        columns = tuple({"name": f.name, "type": f.dataType.jsonValue(), "since": 1, "default": None} for f in df.schema)
        files = self._files(df, "v1")
        if not self._publish(1, [{"columns": list(columns)}, *[{"add": f} for f in files]]):
            raise CommitConflict(f"{self.path} is there already")
        return 1

    def append(self, df: DataFrame) -> int:
        snap = self.snapshot()
        return self.commit(snap.version, self._files(df.select(*[c["name"] for c in snap.columns]), "a"), [], blind=True)

    def _touched(self, snap: Snapshot, keys: DataFrame, key: list[str]) -> dict[str, int]:
        rows = self._frame(snap, snap.files).join(keys.select(*key).distinct(), key, "left_semi")
        names = {"data/" + r._file.rsplit("/data/", 1)[-1] for r in rows.select("_file").distinct().collect()}  # a name a file
        return {f: n for f, n in snap.files.items() if f in names}

    def _rewrite(self, keys: DataFrame, key: list[str], change, extra: DataFrame | None = None, snap: Snapshot | None = None) -> int:
        snap = snap or self.snapshot()
        touched = self._touched(snap, keys, key)
        rows = change(self._frame(snap, touched).drop("_file")) if touched else None
        if extra is not None:
            extra = extra.select(*[c["name"] for c in snap.columns])
            rows = extra if rows is None else rows.unionByName(extra)
        if rows is None:
            return snap.version
        return self.commit(snap.version, self._files(rows, "r"), list(touched))

    def upsert(self, updates: DataFrame, key: list[str], snap: Snapshot | None = None) -> int:
        """Rows of ``updates`` replace those of their key or are added."""
        return self._rewrite(updates, key, lambda rows: rows.join(updates, key, "left_anti"), updates, snap)

    def patch(self, updates: DataFrame, key: list[str], allowed: list[str]) -> int:
        """The allowed columns change where an update states them; nulls change nothing, other columns are refused."""
        if refused := set(updates.columns) - set(key) - set(allowed):
            raise ValueError(f"may not change {', '.join(sorted(refused))}")
        stated = [c for c in allowed if c in updates.columns]
        new = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in stated])

        def change(rows: DataFrame) -> DataFrame:
            both = rows.join(new, key, "left")
            return both.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in stated else F.col(c) for c in rows.columns])

        return self._rewrite(updates, key, change)

    def delete(self, keys: DataFrame, key: list[str]) -> int:
        return self._rewrite(keys, key, lambda rows: rows.join(keys, key, "left_anti"))

    def add_columns(self, columns: dict[str, tuple[str, object]]) -> int:
        """SNK-16: new columns (name: type, default) at once and without a rewrite; those that are there stay."""
        snap = self.snapshot()
        have = {c["name"] for c in snap.columns}
        fresh = [{"name": n, "type": T.StructType.fromDDL(f"x {kind}")["x"].dataType.jsonValue(), "since": None, "default": v} for n, (kind, v) in columns.items() if n not in have]
        return self.commit(snap.version, [], [], (*snap.columns, *fresh)) if fresh else snap.version
