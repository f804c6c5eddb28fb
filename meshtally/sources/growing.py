"""Folders of logs that grow: only new and changed files are parsed again.

The list of known files (path, length, time of change) is committed with the rows parsed from them, so both are always
of one moment. A refresh compares it with the folder; a file that changed replaces its rows, one that is
gone loses them, all others are not opened.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.operators.ranks import join_on
from meshtally.session import settle
from meshtally.sources.logs import read_logs
from meshtally.sources.store import Store

KNOWN = ["file", "length", "modified"]


@dataclass(frozen=True)
class Refresh:
    """What a refresh found: numbers of files, and the commit that holds the result."""

    new: int
    changed: int
    gone: int
    version: int


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified, path) of all files under ``folder``; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified"), "path")


def _literal(path: str) -> str:
    """A path as it is, for readers that take patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


class GrowingLogs:
    """The parsed rows of all logs under ``folder``, kept in a store.

    ``parse`` maps lines (``value``, ``file``, ``line_id``) to rows; they must keep ``file``.
    """

    def __init__(self, spark: SparkSession, folder: str, store: str, parse: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.parse = spark, folder, parse
        self.store = Store(spark, store, ["file"])

    def refresh(self) -> Refresh:
        """Take in what changed since the last refresh. Nothing changed: no commit.

        Only paths of new and changed files pass through the driver, which lists them for the scan anyway.
        """
        found, known = settle(listing(self.spark, self.folder)), self.store.entries()
        if known is None:
            fresh, gone, changed = found, None, 0
        else:
            fresh = settle(join_on(found, known.select(*KNOWN), KNOWN, "left_anti"))
            gone = settle(join_on(known.select("file"), found.select("file"), ["file"], "left_anti"))
            changed = join_on(fresh, known.select("file"), ["file"], "left_semi").count()
        paths = [_literal(r["path"]) for r in fresh.select("path").collect()]
        lost = gone.count() if gone is not None else 0
        if not paths and not lost and known is not None:
            return Refresh(0, 0, 0, self.store.version())
        lines = read_logs(self.spark, paths) if paths else read_logs_of_nothing(self.spark)
        version = self.store.put(self.parse(lines), fresh.select(*KNOWN), gone)
        return Refresh(len(paths) - changed, changed, lost, version)

    def rows(self) -> DataFrame:
        """All rows as of the last refresh."""
        found = self.store.read()
        if found is None:
            raise LookupError(f"{self.folder} was not read yet")
        return found


def read_logs_of_nothing(spark: SparkSession) -> DataFrame:
    """What ``read_logs`` gives, without lines."""
    return spark.createDataFrame([], "value string, file string, line_id bigint")
