"""N-gram Jaccard join by vertical partitioning (operator 1).

1. Every text becomes its set of word n-gram hashes.  One exchange by hash counts in how
   many sets each n-gram is: a piece of input (4 MB of texts) sends each of its n-grams once with the
   number of its texts that have it, so one that all texts have costs no more than a piece's share.
   The answer goes back to the pieces, and only for n-grams in two sets or more (the others can't be shared).
2. The global order of n-grams is (power of two below the set count, hash), rare first.
   It is cut into fragments by that power; a set becomes one short segment for each fragment.
3. Equal sets are one class, found by fingerprint, and its least key stands for it.
4. Two sets that link share an n-gram among the first ``n - ceil(t*n) + 1`` of each in the
   order.  Sets that share such an n-gram form a block.  Pairs are never made within whole
   blocks: first each set meets the least key of its blocks; where a block's members
   still aren't connected, they meet the block's least member, then one drawn for it;
   what is then left of pairs across components, by bands of sizes and tiles of them, is held
   against the threshold, unless sizes and places in the order exclude it, or the distances
   of the two to a common first partner (Jaccard distance is a metric).
5. A pair's overlap is counted fragment by fragment and summed, then compared exactly in
   integers.  Links give components.

The only approximation is that n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import components, cut, parts
from spanloom.llm.words import LOWER, buffers, hashes, mix, slices, spans, windows

LOW = np.uint64((1 << 48) - 1)


def rows_by_number(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc long, text`` with a number for each row, and the key of each number (doc, key).  Where keys are there and don't
    repeat they are the numbers, and the second is None; else the rows are numbered in a written table, so that a task that runs again sees the same ones."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if rows.groupBy("key").count().filter("key is null or count > 1").isEmpty():
        return rows.select(F.col("key").alias("doc"), "text"), None
    rows = cut(rows.withColumn("doc", F.monotonically_increasing_id()))
    return rows.select("doc", "text"), rows.select("doc", "key")


def _sets(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, end to end, and how many each has."""
    data, offsets = buffers(b.column(1))
    starts, ends, at = spans(data, offsets)
    words = hashes(data, starts, ends, LOWER)
    grams, out = windows(words, n), []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= n:
            out.append(np.unique(grams[i : j - n + 1]))
        else:  # a short text is one n-gram; its length keeps it apart from longer ones
            out.append(mix(windows(words[i:j], j - i) + np.uint64(j - i)) if j > i else np.empty(0, np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array([len(x) for x in out], np.int64)


def _scatter(n: int, buckets: int):
    """Texts to the distinct n-gram hashes of their piece for each bucket (lo, hi: 48 bits; times: how many texts of
    the piece have each; start: the place of the first among all of the piece) and a row for the piece itself: keys,
    sizes and fingerprints of its texts, times, and the texts that have each hash (owners), in the hashes' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = (TaskContext.get().partitionId() << 32) - 1
        for b in slices(batches, 1, 4 << 20):
            piece += 1
            grams, counts = _sets(b, n)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            prints = [np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(k)))]) for k in (1, 2)]
            prints = [x[bounds[1:]] - x[bounds[:-1]] for x in prints]
            owners = np.repeat(np.arange(len(counts)), counts).astype(np.uint16)
            order = np.argsort(grams)
            grams, owners = grams[order], owners[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(grams))).astype(np.uint16)
            grams = grams[first]
            bucket = ((grams >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)  # in the hashes' order
            low = grams & LOW
            lo, hi = low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            head = {"bucket": piece % buckets, "piece": piece, "times": times.tobytes(), "owners": owners.tobytes(), "doc": np.asarray(b.column(0)).astype(np.int64).tobytes()}
            rows = [head | {"n": counts.astype(np.int32).tobytes(), "print1": prints[0].tobytes(), "print2": prints[1].tobytes()}]
            for k, i, j in zip(range(buckets), cuts, cuts[1:]):
                if i < j:
                    rows.append({"bucket": k, "piece": piece, "start": i, "lo": lo[i:j].tobytes(), "hi": hi[i:j].tobytes(), "times": times[i:j].tobytes()})
            yield _batch(rows, SCATTERED)

    return run


SCATTERED = "bucket int, piece long, start int, lo binary, hi binary, times binary, owners binary, doc binary, n binary, print1 binary, print2 binary"
COUNTED = SCATTERED + ", shared binary, power binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of one bucket: those in one set only go, the others get the power of two of their set count.
    Each piece sends an n-gram once, however many of its texts have it.  Rows of pieces themselves pass."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if r["lo"] is None:
                yield _batch([r], COUNTED)
            else:
                rows.append(r)
    if not rows:
        return
    of = [np.frombuffer(r["hi"], np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["lo"], np.uint32) for r in rows]
    keys, times = np.concatenate(of), np.concatenate([np.frombuffer(r["times"], np.uint16) for r in rows])
    ends = np.cumsum([len(k) for k in of]).tolist()
    del of
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sets = np.add.reduceat(times[order].astype(np.int64), first)
    power = np.empty(len(keys), np.uint8)
    power[order] = np.repeat(np.log2(sets).astype(np.uint8), np.diff(np.append(first, len(keys))))
    out, i = [], 0
    for r, j in zip(rows, ends):
        p, i = power[i:j], j
        shared = p > 0
        if shared.any():
            out.append({k: r[k] for k in ("bucket", "piece", "start")} | {"lo": np.frombuffer(r["lo"], np.uint32)[shared].tobytes(), "hi": np.frombuffer(r["hi"], np.uint16)[shared].tobytes(), "shared": np.packbits(shared).tobytes(), "power": p[shared].tobytes()})
        if len(out) == 256:
            yield _batch(out, COUNTED)
            out = []
    if out:
        yield _batch(out, COUNTED)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], types[t]) for name, t in columns], [name for name, _ in columns])


GATHERED = "doc long, n long, own long, print1 long, print2 long, first array<long>, segments array<struct<f:int,grams:array<long>>>"


def _gather(percent: int):
    """The rows of whole pieces to a row for each text: size, fingerprint, first n-grams, segments.
    Texts with enough n-grams of their own can't link and keep no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, rows = {}, defaultdict(list)
        for b in batches:
            for r in b.to_pylist():
                if r["doc"] is not None:
                    heads[r["piece"]] = r
                else:
                    rows[r["piece"]].append(r)
        for piece, head in heads.items():
            doc, n = np.frombuffer(head["doc"], np.int64), np.frombuffer(head["n"], np.int32).astype(np.int64)
            times = np.frombuffer(head["times"], np.uint16)
            power, gram = np.zeros(len(times), np.uint8), np.zeros(len(times), np.uint64)
            for r in rows.pop(piece, []):
                at = r["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["shared"], np.uint8)))
                power[at] = np.frombuffer(r["power"], np.uint8)
                gram[at] = np.uint64(r["bucket"] << 48) | np.frombuffer(r["hi"], np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["lo"], np.uint32)
            shared = power > 0
            owner = np.frombuffer(head["owners"], np.uint16)[np.repeat(shared, times)].astype(np.int64)
            power, gram = (np.repeat(x[shared], times[shared]) for x in (power, gram))
            own = n - np.bincount(owner, minlength=len(doc))
            wanted = n - -(-percent * n // 100) + 1 - own  # first n-grams beyond those that no other text has
            keep = (wanted > 0)[owner] if len(owner) else np.empty(0, bool)
            owner, power, gram = owner[keep], power[keep], gram[keep]
            order = np.lexsort((gram, power, owner))
            owner, power, gram = owner[order], power[order], gram[order]
            counts = np.bincount(owner, minlength=len(doc))
            start = np.cumsum(counts) - counts
            rank = np.arange(len(owner)) - start[owner]
            head_of = rank < wanted[owner]
            grams = pa.array(gram.view(np.int64))
            f = power.astype(np.int32)
            new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(f) != 0)]) if len(owner) else np.empty(0, bool)
            at = np.flatnonzero(new)
            segments = pa.StructArray.from_arrays([pa.array(f[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)).astype(np.int32)), grams)], ["f", "grams"])
            bounds = lambda x: pa.array(np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(doc)))]).astype(np.int32))
            out = [pa.array(doc), pa.array(n), pa.array(own), *[pa.array(np.frombuffer(head[k], np.int64)) for k in ("print1", "print2")], pa.ListArray.from_arrays(bounds(owner[head_of]), grams.filter(pa.array(head_of))), pa.ListArray.from_arrays(bounds(owner[at]), segments)]
            yield pa.RecordBatch.from_arrays(out, ["doc", "n", "own", "print1", "print2", "first", "segments"])

    return run


def gram_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of GATHERED for ``doc, text``."""
    spark = docs.sparkSession
    buckets = min(parts(spark), 1 << 16)
    rows = docs.mapInArrow(_scatter(n, buckets), SCATTERED).repartitionById(buckets, F.col("bucket"))
    rows = rows.mapInArrow(_count, COUNTED).repartitionById(buckets, (F.col("piece") % buckets).cast("int"))
    return rows.mapInArrow(_gather(percent), GATHERED)


def overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """``a, b, distance, linked`` for pairs (a, b) that share an n-gram: overlaps of segments, summed over the fragments."""
    one, two = segments.toDF("a", "na", "f", "ga"), segments.toDF("b", "nb", "f", "gb")
    each = pairs.select("a", "b").join(one, "a").join(two, ["b", "f"])
    total = each.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("both"), (F.max("na") + F.max("nb")).alias("sum"))
    return total.select("a", "b", (1 - F.col("both") / (F.col("sum") - F.col("both"))).alias("distance"), (100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).alias("linked"))


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key long, n_shingles long, component_id long``: for each document the size of its set of
    word n-grams and the least key that links lead to; two documents link when the Jaccard
    similarity of their sets is at least ``percent``/100.

    Words are lower-cased in A-Z.  A text of fewer than n words has its whole word sequence as
    its one n-gram.  Null, empty and wordless texts have empty sets and no links.  Repeated rows and keys, and
    rows without a key, are documents like others, each with a row; a null key is no least one, so where
    there are only such the component has none.
    Texts of any length are read whole; n-grams of equal count are ordered by their hashes, which
    changes no result.  Empty tables give no rows; other columns are not read.
    """
    docs, names = rows_by_number(docs, key, text)
    out = _components(docs, n, percent)
    if names is not None:
        out = out.join(names, "doc")
        least = out.groupBy("component").agg(F.min("key").alias("least"))
        out = out.join(least, "component").select(F.col("key").alias("doc"), "n", F.col("least").alias("component"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc, n, component`` of rows with numbers of their own."""
    sets = cut(gram_sets(docs, n, percent))
    classes = sets.filter("n > 0").groupBy("n", "print1", "print2").agg(F.min("doc").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    classes = cut(sets.join(classes, ["n", "print1", "print2"]).select("doc", "least"))
    copies = classes.filter("doc <> least")
    alone = sets.filter("size(first) > 0").join(copies, "doc", "left_anti")
    # blocks of n-grams among the first of two sets or more; i: the n-gram's place in the set's order
    first = alone.select("doc", "n", "own", F.posexplode("first").alias("i", "gram")).withColumn("i", F.col("own") + F.col("i")).drop("own")
    least = first.groupBy("gram").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    blocks = cut(first.join(least.select("gram", "hub"), "gram"))
    segments = cut(alone.join(blocks.select("doc").distinct(), "doc", "left_semi").select("doc", "n", F.explode("segments").alias("s")).select("doc", "n", "s.f", "s.grams"))
    hubs = blocks.groupBy("doc").agg(F.min("hub").alias("hub")).filter("doc <> hub")
    met = cut(overlaps(hubs.select(F.col("hub").alias("a"), F.col("doc").alias("b")), segments, percent))
    away = met.select(F.col("b").alias("doc"), F.col("a").alias("hub"), "distance")
    blocks = blocks.drop("hub").join(away, "doc", "left")
    links, met = met.filter("linked").select("a", "b"), met.select("a", "b")
    for draw in (F.col("doc"), F.xxhash64("doc", "gram")):
        # where a block still falls apart, its members meet one of it, across components
        left = cut(_apart(blocks, components(links)))
        drawn = left.groupBy("gram").agg(F.min_by(F.struct(*SIDE), draw).alias("d")).select("gram", *[F.col(f"d.{c}").alias(f"b_{c}") for c in SIDE])
        some = _new_pairs(left.select("gram", *[F.col(c).alias(f"a_{c}") for c in SIDE]).join(drawn, "gram"), met, percent)
        found = cut(overlaps(some, segments, percent))
        links, met = links.union(found.filter("linked").select("a", "b")), met.union(found.select("a", "b"))
    # the rest: pairs across components that neither sizes and places nor distances exclude
    left = cut(_apart(blocks, components(links)))
    rest = _new_pairs(_within(left, percent), met, percent)
    links = links.union(overlaps(rest, segments, percent).filter("linked").select("a", "b"))
    joined = components(links.union(copies.select(F.col("least").alias("a"), F.col("doc").alias("b"))))
    out = sets.select("doc", "n").join(joined, F.col("doc") == F.col("node"), "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def _apart(blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of blocks whose members are in two components or more, with ``component``."""
    rows = blocks.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = rows.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("gram")
    return rows.join(open_, "gram", "left_semi")


SIDE = ("doc", "n", "i", "component", "hub", "distance")
#: Rows of a block and size band that meet the others of the block in one task.
TILE = 1024


def _within(left: DataFrame, percent: int) -> DataFrame:
    """Two rows of a block (a the one of fewer n-grams) whose sizes don't exclude a link.  Sizes fall into bands such that
    a link's are in one or in two next to each other; a band of many rows is dealt into tiles that meet the rest apart."""
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    rows = left.withColumn("band", F.floor(F.log("n") / width))
    tiles = rows.groupBy("gram", "band").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in SIDE]
    one = rows.join(tiles, ["gram", "band"]).select("gram", "band", F.pmod(F.xxhash64("doc"), "tiles").alias("tile"), *side("a"))
    two = rows.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).join(tiles, ["gram", "band"])
    two = two.select("gram", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), *side("b"))
    return one.join(two, ["gram", "band", "tile"]).filter("a_n < b_n or (a_n = b_n and a_doc < b_doc)")


def _new_pairs(both: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """``a, b`` (a < b) of the rows of two sides in one block that can link and haven't met.

    If the block's n-gram is the first that the two share, they share no more than what follows
    it in either; if it isn't, they are held together in another block.  With distances to the
    same partner known, these must not differ by more than a link's distance.
    """
    most = F.least(F.expr("a_n - a_i"), F.expr("b_n - b_i"))
    can = 100 * most >= percent * (F.col("a_n") + F.col("b_n") - most)
    within = F.coalesce((F.col("a_hub") != F.col("b_hub")) | (F.abs(F.col("a_distance") - F.col("b_distance")) <= 1 - percent / 100 + 1e-9), F.lit(True))
    pairs = both.filter(F.col("a_component") != F.col("b_component")).filter(can & within)
    return pairs.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
