"""Substring deduplication by fixed-block anchors (operator 8).

A window is w consecutive words of one text.  Texts are cut into blocks of ``(w + 1) // 2``
words, so each window holds exactly one whole block (its anchor), for odd w.

1. Probe: one exchange by hash brings each block to all rolling windows of a block's length,
   both reduced beforehand to distinct hashes of each piece of input, so a block that all texts have
   costs no more than its pieces.  The pieces get back which of their blocks were hit.  A block
   that only it itself matches is no anchor.
2. Extend: around the anchors that are left, every window with such an anchor is hashed whole and
   counted in a second exchange; a window that starts in two places or more is a repeat.  Repeats
   that overlap run together into the maximal ones.
3. The words that repeats cover are removed.

Windows are compared by 64-bit hashes (probes by 32 bits besides the bucket, which can only add
anchors that the second step drops: about one in 400 with ten million windows in a bucket).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.ngram_join import rows_by_number
from spanloom.llm.shared import parts
from spanloom.llm.words import buffers, hashes, mix, ranges, slices, spans, windows


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts of a piece, and each text's first word."""
    data, offsets = buffers(b.column(1))
    starts, ends, at = spans(data, offsets)
    return hashes(data, starts, ends), at


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _probe(block: int, buckets: int):
    """Rows for each bucket: the distinct rolling windows (32 bits, one more where a piece has it twice) and the
    distinct blocks (start: the place of the first among all of the piece); and a row for the piece itself:
    how many places each block has, those places and their texts, in the blocks' order, and the texts' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = (TaskContext.get().partitionId() << 32) - 1
        for b in slices(batches, 1):
            piece += 1
            words, at = _words(b)
            n = np.diff(at)
            rolling = windows(words, block)
            start = at[:-1]
            every = ranges(start, np.maximum(n - block + 1, 0))
            blocks = n // block
            places = ranges(np.zeros(len(n), np.int64), blocks) * block
            texts = np.repeat(np.arange(len(n)), blocks)
            anchors = rolling[start[texts] + places] if len(texts) else np.empty(0, np.uint64)
            found, counts = np.unique(rolling[every] if len(every) else np.empty(0, np.uint64), return_counts=True)
            of = _bucket(found, buckets)
            order = np.argsort(of, kind="stable")
            low, many = found[order].astype(np.uint32), (counts > 1)[order]
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            sort = np.lexsort((anchors, _bucket(anchors, buckets)))
            anchors, texts, places = anchors[sort], texts[sort].astype(np.uint16), places[sort].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(anchors))).astype(np.uint32)
            anchors = anchors[first]
            ends = np.searchsorted(_bucket(anchors, buckets), np.arange(buckets + 1))
            anchors = anchors.astype(np.uint32)
            rows = [(k, piece, p, low[i:j].tobytes(), np.packbits(many[i:j]).tobytes(), anchors[p:q].tobytes(), *[None] * 4) for k, i, j, p, q in zip(range(buckets), cuts.tolist(), cuts[1:].tolist(), ends.tolist(), ends[1:].tolist()) if j > i or q > p]
            if len(anchors):
                rows.append((piece % buckets, piece, None, None, None, None, times.tobytes(), texts.tobytes(), places.tobytes(), np.asarray(b.column(0)).astype(np.int64).tobytes()))
            if rows:
                yield _rows(rows, PROBED)

    return run


PROBED = "bucket int, piece long, start int, low binary, many binary, anchors binary, times binary, texts binary, places binary, keys binary"
HIT = "piece long, start int, hit binary, times binary, texts binary, places binary, keys binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(zip(*rows), columns)], [name for name, _ in columns])


def _joined(rows: list, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows] or [np.empty(0, kind)])


def _hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which blocks of a bucket some other place has too, a bit for each block of a piece.  Each piece sends a
    block once, in however many places it stands.  Rows of pieces themselves pass."""
    rows = []
    for b in batches:
        for r in b.to_pylist():
            if r["keys"] is None:
                rows.append(r)
            else:
                yield _rows([(r["piece"], None, None, r["times"], r["texts"], r["places"], r["keys"])], HIT)
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(r["low"]) // 4) for r in rows] or [np.empty(0, np.uint8)])
    packed = _joined(rows, "low", np.uint32).astype(np.uint64) << np.uint64(1) | many
    packed.sort()
    windows_, many = (packed >> np.uint64(1)).astype(np.uint32), (packed & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.concatenate([[True], np.diff(windows_) != 0])) if len(windows_) else np.empty(0, np.int64)
    twice = (np.diff(np.append(first, len(windows_))) > 1) | (np.logical_or.reduceat(many, first) if len(first) else np.empty(0, bool))
    repeated = windows_[first[twice]]
    out = []
    for r in rows if len(repeated) else []:
        anchors = np.frombuffer(r["anchors"], np.uint32)
        hit = repeated[np.minimum(np.searchsorted(repeated, anchors), len(repeated) - 1)] == anchors
        if hit.any():
            out.append((r["piece"], r["start"], np.packbits(hit).tobytes(), *[None] * 4))
    for i in range(0, len(out), 256):
        yield _rows(out[i : i + 256], HIT)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole pieces to the places of the blocks that were hit, a row for each text that has any."""
    heads, rows = [], defaultdict(list)
    for b in batches:
        for r in b.to_pylist():
            if r["keys"] is None:
                rows[r["piece"]].append(r)
            else:
                heads.append(r)
    for head in heads:
        times = np.frombuffer(head["times"], np.uint32)
        hit = np.zeros(len(times), bool)
        for r in rows.pop(head["piece"], []):
            hit[r["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["hit"], np.uint8)))] = True
        of = np.repeat(hit, times)
        texts, places = np.frombuffer(head["texts"], np.uint16)[of], np.frombuffer(head["places"], np.int32)[of]
        order = np.lexsort((places, texts))
        texts, places = texts[order], places[order]
        first = np.flatnonzero(np.diff(texts.astype(np.int64), prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(texts)).astype(np.int32)), pa.array(places))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(head["keys"], np.int64)[texts[first]]), lists], ["doc", "places"])


def _extend(window: int, block: int, buckets: int):
    """Rows for each bucket: the whole windows whose anchor was hit, with text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            words, at = _words(b)
            n = np.diff(at)
            whole = windows(words, window)
            lists = b.column(2)
            places = np.asarray(lists.flatten()).astype(np.int64)
            texts = np.repeat(np.arange(len(b)), np.asarray(lists.value_lengths().fill_null(0)))
            first = np.maximum(places - (window - block), 0)
            last = np.minimum(places, n[texts] - window)
            counts = np.maximum(last - first + 1, 0)
            starts = ranges(first, counts)
            texts = np.repeat(texts, counts)
            h = whole[at[:-1][texts] + starts] if len(texts) else np.empty(0, np.uint64)
            keys, starts = np.asarray(b.column(0)).astype(np.int64)[texts], starts.astype(np.int32)
            # windows that the piece itself has twice are settled; one entry without a place (-1) tells the others
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            settled = times[back] > 1 if len(h) else np.empty(0, bool)
            told = np.unique(h[settled])
            done = (keys[settled], starts[settled])
            h = np.concatenate([h[~settled], told])
            keys, starts = np.append(keys[~settled], np.zeros(len(told), np.int64)), np.append(starts[~settled], np.full(len(told), -1, np.int32))
            of = _bucket(h, buckets)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            h, keys, starts = h[order], keys[order], starts[order]
            rows = [(k, h[i:j].tobytes(), keys[i:j].tobytes(), starts[i:j].tobytes()) for k, i, j in zip(range(buckets), cuts, cuts[1:]) if j > i]
            if len(done[0]):
                rows.append((int(done[0][0] % buckets), b"", *[x.tobytes() for x in done]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 3])], ["bucket", "hashes", "docs", "places"])

    return run


def _repeats(buckets: int):
    """Starts of the windows of a bucket that start in two places or more, by group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [r for b in batches for r in b.to_pylist()]
        rows, done = [r for r in every if r["hashes"]], [r for r in every if not r["hashes"]]
        h, docs, places = _joined(rows, "hashes", np.uint64), _joined(rows, "docs", np.int64), _joined(rows, "places", np.int32)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(h)))
        told = np.logical_or.reduceat(places[order] < 0, first) if len(h) else np.empty(0, bool)
        keep = order[np.repeat((counts > 1) | told, counts)]
        keep = keep[places[keep] >= 0]
        docs, places = np.append(docs[keep], _joined(done, "docs", np.int64)), np.append(places[keep], _joined(done, "places", np.int32))
        group = (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        docs, places = docs[order], places[order]
        cuts = np.searchsorted(group[order], np.arange(buckets + 1))
        rows = [(k, docs[i:j].tobytes(), places[i:j].tobytes()) for k, i, j in zip(range(buckets), cuts, cuts[1:]) if j > i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary()])], ["bucket", "docs", "places"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All starts of each text of a group."""
    rows = [r for b in batches for r in b.to_pylist()]
    docs, places = _joined(rows, "docs", np.int64), _joined(rows, "places", np.int32)
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(docs) != 0])) if len(docs) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)).astype(np.int32)), pa.array(places))
    yield pa.RecordBatch.from_arrays([pa.array(docs[first]), lists], ["doc", "starts"])


def _remove(window: int, with_text: bool):
    """Texts and the starts of their repeats to what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            data, offsets = buffers(b.column(1))
            firsts, ends, at = spans(data, offsets)
            removed, digests, texts = np.zeros(len(b), np.int64), [], []
            lists = b.column(2).to_pylist()
            raw = data.tobytes()
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                places = np.arange(i, j)
                if lists[k]:
                    step = np.zeros(j - i + 1, np.int64)
                    starts = np.asarray(lists[k], np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    places = places[np.cumsum(step[:-1]) == 0]
                    removed[k] = j - i - len(places)
                kept = b" ".join([raw[s:e] for s, e in zip(firsts[places].tolist(), ends[places].tolist())])
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            columns = [b.column(0), pa.array(np.diff(at)), pa.array(removed), pa.array(digests, pa.string())]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key long, n_words long, n_removed long, kept_sha256 string`` for each document, and with
    ``with_text`` the kept words, joined by spaces, as ``kept``.

    Every word goes that is in a window of ``window`` words whose sequence also starts in another
    place, of the same text or another; the first place has no privilege.  Words are
    compared as they are.  window: odd, so that each window has one anchor.  A null text has no
    words; its digest is that of the empty string.  Repeated rows and keys, and rows without a key, are
    texts like others, each with a row; so a row that is there twice keeps nothing that is a window long.  Texts of any length are read whole, and there
    are no ties: all places of a repeated window lose their words.  An empty table gives no rows; other columns are not read.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    docs, names = rows_by_number(docs, key, text)
    docs = docs.filter("doc is not null")  # numbers are there; said here, both joins below read one exchange of the texts
    buckets, block = parts(docs.sparkSession), (window + 1) // 2
    hits = docs.mapInArrow(_probe(block, buckets), PROBED).repartitionById(buckets, F.col("bucket")).mapInArrow(_hit, HIT)
    hits = hits.repartitionById(buckets, (F.col("piece") % buckets).cast("int")).mapInArrow(_places, "doc long, places array<int>")
    near = docs.join(hits, "doc").select("doc", "text", "places")
    found = near.mapInArrow(_extend(window, block, buckets), "bucket int, hashes binary, docs binary, places binary").repartitionById(buckets, F.col("bucket")).mapInArrow(_repeats(buckets), "bucket int, docs binary, places binary")
    found = found.repartitionById(buckets, F.col("bucket")).mapInArrow(_merge, "doc long, starts array<int>")
    out = docs.join(found, "doc", "left").select("doc", "text", "starts").mapInArrow(_remove(window, with_text), "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    if names is not None:
        out = out.join(names, "doc").drop("doc").withColumnRenamed("key", "doc")
    return out.select("doc", *[c for c in out.columns if c != "doc"]).withColumnRenamed("doc", key)
