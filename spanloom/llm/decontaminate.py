"""Benchmark decontamination (operator 5): rare n-grams as seeds join passages to items, then Smith-Waterman alignment of words.

An alignment that reaches the score matches at least that share of the item's words and has few edits; runs of matched words
lie between edits, so at least some of the item's n-grams are matched whole: of m words all matched with e edits there are
e + 1 runs at most, and m - (n - 1)(e + 1) n-grams.  Of the item's n-grams by how rare they are in the corpus,
those that an alignment may leave out and AGREE more are its seeds; AGREE of them are matched, whatever the edits.  The longest n
for which that says anything is taken: two words at a score of 0.6, one for items of up to five words.

Items and texts are tables of seeds and places: the corpus counts of all n-grams of items are summed, seeds are joined with the
places of texts that have them, AGREE of an item's seeds within its reach make a stretch, and a stretch is aligned in the task that
is sent its words and the item's.  Texts are told apart by two hashes; copies of a text are looked at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import cut
from spanloom.llm.words import LOWER, buffers, hashes, mix, slices, spans, windows

MATCH, MISMATCH, GAP = 2, 1, 1
#: Seeds of an item that a stretch of text must have (all that must match, in an item with fewer).
AGREE = 4
#: Longest n-grams looked at.
LONGEST = 5
#: Bytes of text of a piece.
PIECE = 1 << 20
#: Hashes that are sent to all tasks at most (16 MB); beyond it a bitmap of as many bytes is.
SENT = 2 << 20
BITS = 27
TEXT = ["h1", "h2"]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    starts, ends, at = spans(data, offsets)
    return hashes(data, starts, ends, LOWER), at


def align(item: np.ndarray, text: np.ndarray) -> float:
    """The best local alignment of an item with a stretch of text, 1 for a whole copy.

    Row by row over the item; the gaps along the text are a running maximum.
    """
    j = np.arange(len(text) + 1) * GAP
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for w in item:
        t = np.zeros_like(row)
        t[1:] = np.maximum(row[:-1] + np.where(text == w, MATCH, -MISMATCH), row[1:] - GAP)
        np.maximum(t, 0, out=t)
        row = np.maximum.accumulate(t + j) - j
        best = max(best, int(row.max()))
    return best / (MATCH * len(item)) if len(item) else 0.0


def matched_whole(m: int, n: int, score: float) -> int:
    """The n-grams of an item of m words that any alignment of this score matches whole, at least."""
    least = m
    for words in range(max(1, int(np.ceil(score * m - 1e-9))), m + 1):
        edits = int(np.floor(2 * words - 2 * score * m + 1e-9))
        least = min(least, words - (n - 1) * (edits + 1))
    return max(least, 0)


def seed_length(m: int, score: float) -> int:
    """The longest n for which some n-gram of an item of m words is matched whole, at most LONGEST."""
    return next((n for n in range(min(LONGEST, m), 1, -1) if matched_whole(m, n, score)), 1)


def _grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of n words within a text, and the place of its first word."""
    if n == 1:
        return words, np.arange(len(words))
    h = windows(words, n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.empty(0, np.int64)
    return mix(h[inside] + np.uint64(n)), inside


_ITEM = "twin long, m int, n int, least int, keep int, reach int, words binary, gram long"


def _item_rows(score: float, shortest: int, kind: pa.DataType):
    """For each item its words, and a row for each of its n-grams, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = _words(b.column(1))
            out = []
            for k, (item, twin) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                mine = words[at[k] : at[k + 1]]
                m = len(mine)
                if m < max(shortest, 1):
                    continue
                n = seed_length(m, score)
                sure = matched_whole(m, n, score)
                least = min(AGREE, sure)
                grams = _grams(mine, np.array([0, m]), n)[0]
                # words of text that an alignment of that score covers at most: 2 matches - edits >= 2 score m
                row = {"item": item, "twin": twin, "m": m, "n": n, "least": least, "keep": len(grams) - sure + least, "reach": int(np.floor(3 * m - 2 * score * m + 1e-9))}
                out.append(row | {"words": mine.tobytes(), "gram": None})
                out += [row | {"gram": g} for g in grams.view(np.int64).tolist()]
            schema = pa.schema([("item", kind), ("twin", pa.int64()), *[(c, pa.int32()) for c in ("m", "n", "least", "keep", "reach")], ("words", pa.binary()), ("gram", pa.int64())])
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 50_000], schema)

    return run


def sent(grams: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that all hashes of the column ``gram`` pass: exact up to SENT of them, beyond it a bitmap of fixed size that few others pass."""
    kinds = cut(grams.select("gram").distinct())
    if kinds.limit(SENT + 1).count() <= SENT:
        known = np.sort(kinds.toArrow().column("gram").to_numpy())

        def exact(h: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(h), bool)
            return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h

        return exact
    bit = F.shiftrightunsigned("gram", 64 - BITS)
    # at most 2^BITS / 64 rows, whatever the number of hashes
    rows = kinds.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()

    def near(h: np.ndarray) -> np.ndarray:
        place = h.view(np.uint64) >> np.uint64(64 - BITS)
        return (bits[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1

    return near


def _counted(passes: Callable, lengths: list[int]):
    """How often each gram that passes is in the texts of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, PIECE):
            words, at = _words(b.column(0))
            for n in lengths:
                h = _grams(words, at, n)[0].view(np.int64)
                kinds, times = np.unique(h[passes(h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(times.astype(np.int64))], ["gram", "n"])
        pa.default_memory_pool().release_unused()

    return run


def _probes(passes: Callable, lengths: list[int]):
    """The places of grams that pass, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, PIECE):
            words, at = _words(b.column(0))
            for n in lengths:
                h, place = _grams(words, at, n)
                h = h.view(np.int64)
                hit = np.flatnonzero(passes(h))
                h, place = h[hit], place[hit]
                text = np.searchsorted(at, place, "right") - 1
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(1).take(rows), b.column(2).take(rows), pa.array(h), pa.array((place - at[text]).astype(np.int32))], [*TEXT, "gram", "place"])
        pa.default_memory_pool().release_unused()

    return run


def _cut_out(item: pa.DataType):
    """The words of the stretches of each text, clipped to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("item", item), ("twin", pa.int64()), ("stretch", pa.binary())])
        for b in slices(batches, 0, PIECE):
            words, at = _words(b.column(0))
            out, size = [], 0
            for k, (h1, h2, parts) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                mine = words[at[k] : at[k + 1]]
                for p in parts:
                    piece = mine[max(p["low"], 0) : p["high"]].tobytes()
                    out.append({"h1": h1, "h2": h2, "item": p["item"], "twin": p["twin"], "stretch": piece})
                    size += len(piece)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        pa.default_memory_pool().release_unused()

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = [align(np.frombuffer(i, np.uint64), np.frombuffer(t, np.uint64)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(score, pa.float64())], ["h1", "h2", "item", "score"])


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """docs with two hashes of the text as h1 and h2; their own columns of these names are left out."""
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.hash(text)})


def found(docs: DataFrame, benchmark: DataFrame, score: float, shortest: int, text: str, item_key: str, item_text: str) -> DataFrame:
    """``h1, h2, item, score`` of each text, by its hashes, and each item of which it holds a copy."""
    kind = benchmark.schema[item_key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    rows = cut(items.withColumn("twin", F.xxhash64("text")).mapInArrow(_item_rows(score, shortest, arrow), f"item {kind}, {_ITEM}"))
    grams = rows.filter("gram is not null").drop("words")
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # LONGEST at most
    texts = _hashed(docs.select(F.col(text).alias("text")).filter("text is not null"), "text")
    # how rare each gram is, and the seeds
    counts = texts.select("text").mapInArrow(_counted(sent(grams), lengths), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("times"))
    rarest = Window.partitionBy("item", "twin").orderBy(F.coalesce("times", F.lit(0)), "gram")
    seeds = grams.join(counts, "gram", "left").withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= F.col("keep"))
    seeds = cut(seeds.select("gram", "item", "twin", "least", "reach").distinct())
    # where texts have them: AGREE within an item's reach
    probes = texts.select("text", *TEXT).mapInArrow(_probes(sent(seeds), lengths), "h1 long, h2 int, gram long, place int").distinct()
    own = [*TEXT, "item", "twin"]
    hits = probes.join(seeds, "gram").select(*own, "place", "least", "reach").distinct()
    by_place = Window.partitionBy(*own).orderBy("place")
    last = F.col("place")
    for k in range(2, AGREE + 1):
        last = F.when(F.col("least") == k, F.lead("place", k - 1).over(by_place)).otherwise(last)
    ends = hits.withColumn("last", last).filter("last is not null and last - place < reach")
    ends = ends.withColumns({"low": F.col("last") - F.col("reach") + 1, "high": F.col("place") + F.col("reach")})
    before = F.max("high").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", (before.isNull() | (F.col("low") > before)).cast("int")).withColumn("run", F.sum("new").over(by_place))
    stretches = cut(runs.groupBy(*own, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    # the words of both, in one task
    parts = stretches.groupBy(*TEXT).agg(F.collect_list(F.struct("item", "twin", "low", "high")).alias("parts"))  # of one text
    have = sent(stretches.select(F.col("h1").alias("gram")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(have(b.column(1).to_numpy(zero_copy_only=False))))

    # copies become one before they leave their task
    once = texts.select("text", *TEXT).mapInArrow(some, "text string, h1 long, h2 int").groupBy(*TEXT).agg(F.first("text").alias("text")).join(parts, TEXT)
    # written, so that no task runs two Python workers
    cut_out = cut(once.select("text", *TEXT, "parts").mapInArrow(_cut_out(arrow), f"h1 long, h2 int, item {kind}, twin long, stretch binary"))
    pairs = cut_out.join(rows.filter("gram is null").select(F.col("item").alias("_i"), F.col("twin").alias("_t"), "words"), (F.col("item").eqNullSafe(F.col("_i"))) & (F.col("twin") == F.col("_t")))
    pairs = pairs.select("words", "stretch", *TEXT, "item").mapInArrow(_aligned, f"h1 long, h2 int, item {kind}, score double")
    return pairs.filter(F.col("score") >= score).groupBy(*TEXT, "item").agg(F.max("score").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = 0.6, shortest: int = 3, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item_key, score`` for each row of docs and each item of which it holds an exact or edited copy.

    score: alignment (match 2, mismatch and gap -1) over that of a whole copy, over 0.5; letters A-Z in either case.  Null
    texts and items have no words and match nothing.  Items of fewer than ``shortest`` words are left alone, as two words in a row are
    no sign of a copy; with 1 they are found like others.  Rows are independent: repeated rows each give their rows; equal items count
    once, and of an id with several texts the best score.  Of equally rare n-grams those of the least hashes are seeds, which changes
    no result.  Texts of any length are searched whole.  Empty tables give no rows; other columns are not read.
    """
    hit = found(docs, benchmark, score, shortest, text, item_key, item_text)
    rows = _hashed(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text").drop("text")
    return rows.join(hit, TEXT).select(F.col("key").alias(key), F.col("item").alias(item_key), "score")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, score: float = 0.6, shortest: int = 3, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that hold a copy of no item; see contaminated()."""
    bad = found(docs, benchmark, score, shortest, text, item_key, item_text).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    test = (F.xxhash64(f"`{text}`") == F.col("_h1")) & (F.hash(f"`{text}`") == F.col("_h2"))
    return docs.join(bad, test & F.col(f"`{text}`").isNotNull(), "left_anti")
