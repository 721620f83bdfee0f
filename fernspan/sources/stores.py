"""Sinks: split files, result files, append-only CSV, and a keyed table changed by commits."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernspan.session import drop_path, fits_broadcast

#: Bytes of a changed key in a broadcast.
KEY_BYTES = 64


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split, overwritten as a whole."""
    df.write.mode("overwrite").partitionBy(split).option("header", "true").option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Quoted as RFC 4180 asks: fields with commas, quotes or line breaks, quotes doubled."""
    df.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON, one object a row, nulls written out, replaced as a whole."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


class Conflict(RuntimeError):
    """Another writer committed after the version that a change was made from."""


class KeyedTable:
    """A table of rows by key on Parquet, changed by commits.

    A commit writes its rows to a folder of its own and then puts a manifest, numbered one higher than the last, in place by a rename
    that fails if the number is taken: of two writers one is refused.  A manifest lists the folders that are live, the first one the
    base, the others changes since; readers take the newest manifest (or the one of a number asked for) and read just these folders.
    Only changes are sorted, to find the newest of each key; the base loses the keys they have by an anti-join.  After ``MOST_CHANGES`` changes, or
    when asked, all is written as a new base.  Folders that no manifest names any more go with vacuum().

    Writers number their batches: a batch that has been committed is not committed again, so a retried one changes nothing.  Keys are
    distinct within a batch.  A key that is deleted may be inserted again.
    """

    MOST_CHANGES = 16
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"row_id string, version long, deleted boolean, {schema}"
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        at, conf = self._p(self.path), spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = at.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    # -- the log

    def _log(self) -> list[int]:
        folder = self._p(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The number of the newest manifest; 0 where there is none."""
        return max(self._log(), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.version() if number is None else number
        if number == 0:
            return {"number": 0, "batches": [], "folders": []}
        return json.loads(self.spark.read.text(f"{self.path}/log/{number:020d}.json", wholetext=True).first()[0])

    def _put(self, manifest: dict) -> None:
        """Puts a manifest in place, or raises Conflict if its number is taken."""
        final, temporary = self._p(f"{self.path}/log/{manifest['number']:020d}.json"), self._p(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._files.rename(temporary, final, self._no_options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {manifest['number']} is taken") from None
            raise

    # -- changes

    def ensure(self) -> KeyedTable:
        return self

    def _write(self, df: DataFrame, key: str, batch: int, deleted: bool) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        d = df.withColumns({"row_id": F.col(key).cast("string"), "version": F.lit(batch).cast("long"), "deleted": F.lit(deleted)})
        fields = self.spark.createDataFrame([], self.schema).schema
        d.select(*((F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "rows": self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()}

    def commit(self, df: DataFrame, batch: int, key: str, base: int | None = None, deleted: bool = False) -> int:
        """Inserts rows, replaces those whose key is there, or deletes keys; the number of the version that has them.

        base: the version that the change was made from; if another commit has come since, Conflict. Without it the change is put on
        top of whatever is newest.
        """
        if (known := self._number_of(batch)) is not None:
            return known
        change = None
        for _ in range(self.TRIES):
            last = self.manifest()
            if base is not None and last["number"] != base:
                raise Conflict(f"made from version {base}, but {last['number']} is there")
            change = change or self._write(df, key, batch, deleted)
            number = last["number"] + 1
            try:
                self._put({"number": number, "batches": [*last["batches"], [batch, number]], "folders": [*last["folders"], change]})
            except Conflict:
                if base is not None:
                    raise
                continue
            if len(last["folders"]) >= self.MOST_CHANGES:
                self.compact()
            return number
        raise Conflict(f"no version was free in {self.TRIES} tries")

    def _number_of(self, batch: int) -> int | None:
        return next((n for b, n in self.manifest()["batches"] if b == batch), None)

    def insert(self, df: DataFrame, version: int, key: str) -> None:
        self.commit(df, version, key)

    update = insert

    def delete(self, keys: DataFrame, version: int, key: str) -> None:
        self.commit(keys, version, key, deleted=True)

    def compact(self) -> None:
        """All live rows as one base; a writer that comes first wins, and this is left for another time."""
        last = self.manifest()
        if len(last["folders"]) < 2:
            return
        folder = f"data/{uuid.uuid4().hex}"
        self.rows(last["number"]).write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        try:
            self._put({"number": last["number"] + 1, "batches": last["batches"], "folders": [{"folder": folder, "rows": n}]})
        except Conflict:
            pass

    def vacuum(self, keep_versions: int = 1) -> None:
        """Removes manifests but the newest ones, and folders that these do not name. Not while others write or read older versions."""
        numbers = self._log()
        kept = numbers[-keep_versions:]
        live = {f["folder"].split("/")[1] for n in kept for f in self.manifest(n)["folders"]}
        for n in numbers[: len(numbers) - len(kept)]:
            drop_path(self.spark, f"{self.path}/log/{n:020d}.json")
        folder = self._p(f"{self.path}/data")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            if s.getPath().getName() not in live:
                drop_path(self.spark, f"{self.path}/data/{s.getPath().getName()}")

    # -- reading

    def before(self, batch: int) -> int:
        """The version that a batch was or would be put on: a batch that is run again does not see its own rows."""
        number = self._number_of(batch)
        return self.version() if number is None else number - 1

    def rows(self, number: int | None = None) -> DataFrame:
        """The newest row of every key, as of a version (the last one, if none is given)."""
        folders = self.manifest(number)["folders"]
        read = lambda f: self.spark.read.schema(self.schema).parquet(f"{self.path}/{f['folder']}")
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        if len(folders) == 1:
            return read(folders[0]).filter("not deleted")
        changes = reduce(DataFrame.unionByName, (read(f).withColumn("__at", F.lit(i)) for i, f in enumerate(folders[1:])))
        newest = changes.withColumn("__n", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("__at")))).filter("__n = 1").drop("__n", "__at")
        keys = changes.select("row_id").distinct()
        if fits_broadcast(sum(f["rows"] for f in folders[1:]), KEY_BYTES):
            keys = F.broadcast(keys)
        return read(folders[0]).join(keys, "row_id", "left_anti").unionByName(newest).filter("not deleted")

    def reset(self) -> None:
        drop_path(self.spark, self.path)
