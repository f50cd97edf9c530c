"""Shared pieces: bounded broadcasts, joins that survive a hot key, and text helpers."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than space, tab and the line ends \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"
WORD_RE = re.compile("[^\x20\x09-\x0d]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_AZ = str.maketrans(UPPER, LOWER)

#: Keys with more than 1/HOT_SHARE of the rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: So many rows at most may meet in one task without being split.
TASK_ROWS = 20_000
#: Arrow batches hold at most this many rows, as a row may be a very long text.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size; never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


#: Tables that operators keep in a worker process for their next task, by operator.
WORKER_TABLES: dict[str, dict] = {}


def _drop_tables(owner: str | None) -> None:
    """Empties the tables of all operators but ``owner``; what they hold may refer to itself, so it is collected."""
    others = [kept for name, kept in WORKER_TABLES.items() if name != owner and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()


def _trim() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task function that drops the tables other operators than ``owner`` keep in its worker, and leaves no freed memory behind.

    Workers are used again and again, by the tasks of all operators in turn.
    """

    def task(batches: Iterator) -> Iterator:
        _drop_tables(owner)
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else. ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint if the stored relation has at most ``rows`` rows, else the planner's shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows to one right row per key, where ``right[weight]`` counts the left rows of the key.

    Keys above total/HOT_SHARE rows (fewer than HOT_SHARE keys) meet their
    rows by broadcast, so no task receives a hot key; the others are
    shuffled. Both sides should be stored, as the left is read twice.
    """
    if total <= TASK_ROWS:
        return left.join(right, on, how)
    limit = max(total // HOT_SHARE, 1)
    hot = right.filter(F.col(weight) > limit)
    if not hot.limit(1).count():
        return left.join(right, on, how)
    warm = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(weight) <= limit), on, how)
    return warm.unionByName(rest)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
