"""Tables made of whole commits, in plain folders.

A save writes its rows to a folder of its own (``save=...``), then a list of all current entries (key, save,
attributes), then one commit file whose number must be new. Readers take the highest commit: they see a save whole or not at all, and
what a failed or repeated task or job left behind is never named by a commit. A key saved again replaces its
rows. Rows and entries stay DataFrames; the driver only handles the commit file, which names folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meshtally.operators.ranks import join_on

SAVE = "save"


class Conflict(RuntimeError):
    """Other writers kept committing first."""


class _Files:
    """The few file operations that a commit needs, on whatever file system ``path`` is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self.gateway, self.hadoop = sc._gateway, sc._jvm.org.apache.hadoop.fs
        self.path, self.conf = path.rstrip("/"), sc._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.gateway.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a whole file there; False if there is one already."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._at(name).getParent())
        whole = self.fs.makeQualified(self._at(name))
        none = self.gateway.new_array(self.gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # unlike FileSystem.rename this never replaces a file
            self.hadoop.FileContext.getFileContext(whole.toUri(), self.conf).rename(
                self.fs.makeQualified(self._at(draft)), whole, none)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" not in str(getattr(e, "java_exception", e)):
                raise
            self.fs.delete(self._at(draft), False)
            return False
        return True


class Store:
    """A table under ``path`` whose rows belong to keys, the values of the columns ``key``.

    Keys are data: any text, number or NULL is one. Columns may differ between saves; a missing one reads as NULL.
    ``partitions`` are columns that folders are made of, the same for all saves.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], partitions: Sequence[str] = ()) -> None:
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), list(key), list(partitions)
        self._files = _Files(spark, self.path)

    def _commit(self) -> dict | None:
        numbers = [n for n in self._files.names("_commits") if n.isdigit()]
        return json.loads(self._files.read(f"_commits/{max(numbers)}")) if numbers else None

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        commit = self._commit()
        return commit["number"] if commit else 0

    def _entries_of(self, commit: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(commit["entry_schema"])).parquet(
            f"{self.path}/_entries/{commit['entries']}")

    def entries(self) -> DataFrame | None:
        """The current keys with their attributes; None before the first commit."""
        commit = self._commit()
        return None if commit is None else self._entries_of(commit).drop(SAVE)

    def _rows(self, saves: Sequence[str], schema: StructType) -> DataFrame:
        with_save = StructType([*schema.fields, StructField(SAVE, StringType())])
        return self.spark.read.schema(with_save).option("basePath", self.path).parquet(
            *[f"{self.path}/{SAVE}={s}" for s in saves])

    def put(self, rows: DataFrame, keys: DataFrame | None = None, gone: DataFrame | None = None, tries: int = 5) -> int:
        """Replace the rows of the keys in ``rows``; returns the commit's number.

        ``keys`` names the keys itself, with attributes in further columns: one without rows then becomes empty.
        Keys in ``gone`` are dropped. Saving the same again changes nothing but the number.
        """
        save = uuid.uuid4().hex
        rows.write.partitionBy(*self.partitions).parquet(f"{self.path}/{SAVE}={save}")
        if keys is None:
            keys = self._rows([save], rows.schema).select(*self.key).distinct()
        drafts = f"{self.path}/_entries/{save}-new"
        keys.withColumn(SAVE, F.lit(save)).write.parquet(drafts)
        keys = self.spark.read.schema(keys.withColumn(SAVE, F.lit(save)).schema).parquet(drafts)
        count = keys.count()
        for _ in range(tries):
            last = self._commit()
            out = keys
            if last is not None:
                kept = join_on(self._entries_of(last), keys.select(*self.key), self.key, "left_anti")
                if gone is not None:
                    kept = join_on(kept, gone.select(*self.key), self.key, "left_anti")
                out = kept.unionByName(keys, allowMissingColumns=True)
            name = uuid.uuid4().hex
            out.write.parquet(f"{self.path}/_entries/{name}")
            commit = {"number": last["number"] + 1 if last else 1, "entries": name, "entry_schema": out.schema.jsonValue(),
                      "schema": _merged(last and StructType.fromJson(last["schema"]), rows.schema).jsonValue()}
            first = {**(last["saves"] if last else {}), save: [count, count]}
            alive = {r[SAVE]: r["count"] for r in self._entries_of(commit).groupBy(SAVE).count().collect()}
            # keys of each save when it was made, and now; saves that have none left are read no more
            commit["saves"] = {s: [first[s][0], n] for s, n in alive.items()}
            if self._files.create(f"_commits/{commit['number']:012d}", json.dumps(commit)):
                return commit["number"]
        raise Conflict(f"{tries} other commits to {self.path} came first")

    def read(self, keys: Sequence | None = None) -> DataFrame | None:
        """The rows of the last commit, or of the given values of the first key column; None before the first."""
        commit = self._commit()
        if commit is None:
            return None
        schema = StructType.fromJson(commit["schema"])
        entries, saves, wanted = self._entries_of(commit), commit["saves"], F.lit(True)
        if keys is not None:
            own = F.col(self.key[0])
            wanted = own.isin([k for k in keys if k is not None]) | (own.isNull() if None in keys else F.lit(False))
            entries = entries.where(wanted)
            saves = {r[SAVE]: saves[r[SAVE]] for r in entries.select(SAVE).distinct().collect()}
        whole = [s for s, (made, now) in saves.items() if made == now]
        partly = [s for s in saves if s not in whole]
        found = []
        if whole:
            found.append(self._rows(whole, schema).where(wanted))
        if partly:  # some of their keys were saved again since
            found.append(join_on(self._rows(partly, schema).where(wanted), entries.select(*self.key, SAVE),
                                 [*self.key, SAVE], "left_semi"))
        out = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)
        return out.select(*schema.names)


def _merged(before: StructType | None, new: StructType) -> StructType:
    """All fields by name, in the order of their first use; one name has one type."""
    out = StructType(list(before)) if before else StructType()
    for f in new:
        if f.name not in out.names:
            out = out.add(f.name, f.dataType, True)
        elif out[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} was {out[f.name].dataType.simpleString()}, is {f.dataType.simpleString()}")
    return out
