"""Rollup folders of micro-batches merged, while readers go on.

A rollup that a stream writes has a folder for each batch, some 43,000 a day, and every reader opens all of them.  merge() writes
the partial rows of all closed folders anew, one folder a merge, and then a manifest: the folders that count, and the last
batch in them.  A reader takes the newest manifest and the batches after it, so it sees each partial row once before, during and after a merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.files import Folder

_NONE = {"version": 0, "last": -1, "folders": [], "dropped": []}


def _newest(spark: SparkSession, path: str) -> dict:
    book = Folder(spark, f"{path}/_manifests")
    names = [n for n in book.names() if n.startswith("v")]
    return book.read(max(names)) if names else _NONE


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in Folder(spark, path).names() if n.startswith("batch="))


def read_rollup(spark: SparkSession, path: str, attempts: int = 3) -> DataFrame:
    """The partial rows of a rollup: merged folders by the newest manifest, and the batches after it.  A reader that began
    before clean() took its folders away begins again."""
    for left in reversed(range(attempts)):
        m = _newest(spark, path)
        paths = [f"{path}/{f}" for f in m["folders"]] + [f"{path}/batch={b}" for b in _batches(spark, path) if b > m["last"]]
        try:
            return spark.read.parquet(*paths)
        except AnalysisException:
            if not left:
                raise
    raise AssertionError


def merge(spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame], through: int, most_folders: int = 32, files: int = 8) -> dict:
    """Merges the batches up to ``through``, which must be closed, and returns the new manifest.

    combine: partial rows to fewer partial rows of the same columns that mean the same, such as sums by key.  A merge takes the
    batches since the last one; once there are ``most_folders`` merged folders it takes these in too, so a reader opens at most that
    many and the open batches.  A merge that is stopped leaves a folder that no manifest names.
    """
    old = _newest(spark, path)
    new = [b for b in _batches(spark, path) if old["last"] < b <= through]
    if not new:
        return old
    again = old["folders"] if len(old["folders"]) + 1 > most_folders else []
    took = [*again, *(f"batch={b}" for b in new)]
    version = old["version"] + 1
    folder = f"merged={version:08d}"
    rows = spark.read.parquet(*[f"{path}/{f}" for f in took])
    combine(rows).coalesce(files).write.mode("overwrite").parquet(f"{path}/{folder}")
    made = {"version": version, "last": new[-1], "folders": [*(f for f in old["folders"] if f not in again), folder], "dropped": took}
    Folder(spark, f"{path}/_manifests").write(f"v{version:08d}", made)
    return made


def clean(spark: SparkSession, path: str, keep_versions: int = 1) -> list[str]:
    """Removes folders that no manifest but those older than the last ``keep_versions`` names; returns them.  Readers that hold an
    older manifest's folders must be done, so run it well after the merge."""
    book = Folder(spark, f"{path}/_manifests")
    names = [n for n in book.names() if n.startswith("v")]
    if not names:
        return []
    kept = [book.read(n) for n in names[-keep_versions:]]
    # what the oldest kept manifest has taken in isn't named by it or any later one
    first = kept[0]
    used = {f for m in kept for f in m["folders"]} | {f for m in kept[1:] for f in m["dropped"]}
    there = Folder(spark, path).names()
    gone = [f for f in there if f not in used and (f.startswith("batch=") and int(f.removeprefix("batch=")) <= first["last"] or f.startswith("merged=") and int(f.removeprefix("merged=")) <= first["version"])]
    for f in gone:
        Folder(spark, path).remove(f"{path}/{f}")
    for n in names[:-keep_versions]:
        book.remove(n)
    return gone
