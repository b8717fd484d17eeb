"""Old partitions and old dead-letter files go, by the date in their names."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import SparkSession

from spanloom.sources.telemetry import RETENTION_DAYS

PARTITION = re.compile(r"dt=(\d{4}-\d{2}-\d{2})")


def _drop_before(spark: SparkSession, folder: str, pattern: re.Pattern[str], today: str, days: int) -> list[str]:
    """Deletes the entries of a folder whose name matches and whose date is more than ``days`` before today; their names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if days <= 0 or not fs.exists(path):
        return []
    first = datetime.date.fromisoformat(today) - datetime.timedelta(days=days)
    gone = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        m = pattern.fullmatch(name)
        try:
            old = m is not None and datetime.date.fromisoformat(m[1]) < first
        except ValueError:  # no date after all
            continue
        if old:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def drop_partitions(spark: SparkSession, table: str, days: int, today: str) -> list[str]:
    """Whole partitions (dt=...) of a written table that are past their days; nothing is rewritten."""
    return _drop_before(spark, table, PARTITION, today, days)


def drop_all_partitions(spark: SparkSession, root: str, today: str, days: dict[str, int] = RETENTION_DAYS) -> dict[str, list[str]]:
    """drop_partitions() of every table below a folder."""
    return {name: gone for name, d in days.items() if (gone := drop_partitions(spark, f"{root}/{name}", d, today))}


def drop_dead_letters(spark: SparkSession, folder: str, days: int, today: str) -> list[str]:
    """Dead-letter files and folders ({signal}-date) past their days; other names stay, as does everything if days isn't positive."""
    return _drop_before(spark, folder, re.compile(r"[^-]+-(\d{4}-\d{2}-\d{2})(?:\.jsonl)?"), today, days)
