"""Dead letters written back exactly once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.files import Folder
from spanloom.sources.otlp import dlq_rows


def pending(spark: SparkSession, path: str, signal: str, today: str) -> list[str]:
    """Dead-letter files of a signal of days before today."""
    day = re.compile(rf"/{re.escape(signal)}-(\d{{4}}-\d{{2}}-\d{{2}})[^/]*(?:/|$)")
    return [p for p in Folder(spark, path).files() if (m := day.search(p)) and m[1] != today]


def replay(spark: SparkSession, path: str, signal: str, today: str, target: str, ledger: str, most_files: int = 1000, before_removal: Callable[[], None] = lambda: None) -> int:
    """Writes the rows of the dead-letter files of days before today to ``target`` and removes the files; returns how many files
    were replayed.  Files come in groups of ``most_files``.

    A group is written down in the ledger before anything else, and its rows go to a folder of its own under target, named for
    it (``replay=...``).  Stopped before it is marked as done, a group is written anew into the same folder, with just the files that it
    names; stopped after, only its files are removed.  So no row is lost or doubled.  One replay of a signal runs at a time.
    """
    book = Folder(spark, ledger)
    names = book.names()
    open_ = [n.removesuffix(".files") for n in names if n.startswith(f"{signal}-") and n.endswith(".files") and n.removesuffix(".files") + ".removed" not in names]
    named = {p for g in open_ for p in book.read(f"{g}.files")}
    new = [p for p in pending(spark, path, signal, today) if p not in named]
    for k in range(0, len(new), most_files):
        files = new[k : k + most_files]
        group = f"{signal}-{today}-{hashlib.sha256('|'.join(files).encode()).hexdigest()[:16]}"
        book.write(f"{group}.files", files)
        open_.append(group)
    done = 0
    for group in open_:
        files = book.read(f"{group}.files")
        if f"{group}.done" not in names:
            rows = dlq_rows(spark.read.text(files), signal)
            rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/replay={group}")
            book.write(f"{group}.done", len(files))
        before_removal()
        for p in files:
            book.remove(p)
        book.write(f"{group}.removed", len(files))
        done += len(files)
    return done


def replayed(spark: SparkSession, target: str, ledger: str) -> DataFrame | None:
    """The rows of all groups that are marked as done; None if there are none."""
    groups = [n.removesuffix(".done") for n in Folder(spark, ledger).names() if n.endswith(".done")]
    paths = [f"{target.rstrip('/')}/replay={g}" for g in groups]
    return spark.read.parquet(*paths).drop("replay") if paths else None
