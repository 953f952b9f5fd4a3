"""Records of logs that go on growing: lines come in micro-batches and files, the open record is kept as state.

A record is a starting line with all lines up to the next start of its log, in whatever batch and file they come.
It goes out when the next one starts, or when its log has been silent for a while.

Defined results: lines that follow no starting line (at the head of a log, or behind a record that silence has closed)
are a record of their own, ``headless``; the batch form drops those at the head. A null line is an empty one. A log
that never starts a record keeps what it has as state until it is silent. The state of a log is its open record,
line by line, so a record of any length is appended to and never rewritten; one batch's lines of one log are
sorted by one task, which ``maxFilesPerTrigger`` of the source bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlens.functions import text as T
from emberlens.session import ship_package
from emberlens.sources.lines import record_columns

#: The store that keeps lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ["modified", "file", "block", "at"]
OUT = "log string, seq long, file string, line string, rest array<string>, headless boolean"
#: What rotation appends to the name of a log.
ROTATED = r"[.\-_]\d[\d.\-]*(?=\.[A-Za-z]+$|$)|\.(?:gz|bz2)$"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task with their place ``at`` in it; streams have no ids of rows."""
    n = 0
    for b in batches:
        yield b.append_column("at", pa.array(range(n, n + b.num_rows), pa.int64()))
        n += b.num_rows


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100, rotated: str = ROTATED) -> DataFrame:
    """log, line and the ORDER of lines of the text files that appear below a path; the files of a rotated log are one
    log, in the order of their last change."""
    r = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    m = lambda name: F.col(f"_metadata.{name}")
    log = F.regexp_replace(m("file_path"), rotated, "")
    ship_package(spark)
    d = r.text(path).select(log.alias("log"), m("file_modification_time").alias("modified"), m("file_path").alias("file"), m("file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))
    return d.mapInArrow(_counted, "log string, modified timestamp, file string, block long, line string, at long")


class OpenRecord(StatefulProcessor):
    """Keeps the open record of each log: its number, first line and file, and the lines behind it."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "file string, line string, headless boolean")
        self.rest = handle.getListState("rest", "line string")
        self.seq = handle.getValueState("seq", "n long")

    def _next(self) -> int:
        n = self.seq.get()[0] + 1 if self.seq.exists() else 1
        self.seq.update((n,))
        return n

    def _closed(self, log: str, behind: list[str]) -> tuple:
        """The open record with what this batch has of it; nothing is open afterwards."""
        file, line, headless = self.head.get()
        kept = [r[0] for r in self.rest.get()] if self.rest.exists() else []
        self.head.clear()
        self.rest.clear()
        return log, self._next(), file, line, kept + behind, headless

    def _keep(self, behind: list[str]) -> None:
        if behind:
            self.rest.appendList([(x,) for x in behind])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        out, behind = [], []
        for file, line, starts in zip(d["file"], d["line"], d["starts"], strict=True):
            if starts or not self.head.exists():
                if self.head.exists():
                    out.append(self._closed(key[0], behind))
                behind = []
                self.head.update((file, line, not starts))
            else:
                behind.append(line)
        self._keep(behind)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["log", "seq", "file", "line", "rest", "headless"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = [self._closed(key[0], [])] if self.head.exists() else []
        yield pd.DataFrame(out, columns=["log", "seq", "file", "line", "rest", "headless"])

    def close(self) -> None:
        pass


def stream_records(lines: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Records of a stream of lines (log, line, and the columns of ORDER): the columns of ``sources.lines.read_records``
    but for places, and log, seq (from 1 within a log), file of the first line, n_continuations, headless."""
    spark = lines.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    line = F.coalesce("line", F.lit(""))
    d = lines.select("log", *ORDER, line.alias("line"), (~T.is_continuation(line)).alias("starts"))
    r = d.groupBy("log").transformWithStateInPandas(OpenRecord(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
    return r.select("log", "seq", "file", *record_columns(F.col("line"), F.col("rest")), F.size("rest").alias("n_continuations"), "headless")
