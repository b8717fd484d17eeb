"""Language-model scoring with causal self-attention (operator 6).

The model reads subword ids of a public tokenizer, word by word, and predicts the next id in two steps: its class, and then the id
among its class's members; classes are ranges of the pieces in alphabetical order with about equal shares of the counts.
What an id says about the next one by itself, its direct path, starts from counts over all training texts: of the next class
for each frequent id, and of the next member for each very frequent one.  A single layer of causal self-attention over embeddings
(query, key, value and a direct one for each frequent id; the rare ids of a class share theirs) is fitted on top of it.
Texts are scored in blocks: each block's tokens are predicted once, with the tokens before it as context, under a causal
mask, many blocks at a time.

Texts are read once: what leaves a piece of input is its ids, and its distinct words by range of hash for the base score's
counts.  The texts' ids are put in order by unit, a range of hashes of the text and its key, and by key; so what a
unit holds doesn't depend on how the input lies in partitions.  The layer is fitted in a few rounds: in each a part of the units, each
unit on its own copy, and the copies are averaged by their numbers of windows.  Every block of every training text is a target once a pass.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import cut, parts
from spanloom.llm.words import LOWER, P, buffers, hashes, mix, ranges, slices, spans

#: Classes, members of a class that are told apart, ids with embeddings of their own, and ids with member counts of their own.
CLASSES, MEMBERS, KNOWN, NEAR = 32, 32, 4096, 480
WIDTH, HIDDEN, BLOCK, CONTEXT = 4, 16, 16, 8
LENGTH = BLOCK + CONTEXT
#: Offsets from a query to a key; keys after it are masked.
OFFSET = np.arange(CONTEXT, LENGTH)[:, None] - np.arange(LENGTH)
SEEN = OFFSET >= 0
AHEAD = np.maximum(OFFSET, 0)
#: Rows of the embeddings beyond those of known ids and of classes: the beginning of a text, and nothing.
BEGIN, NONE = KNOWN + CLASSES, KNOWN + CLASSES + 1
ROWS, GROUPS = KNOWN + CLASSES + 2, NEAR + CLASSES + 1
NEVER = np.float32(-1e9)
_table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words whose ids are remembered, and bytes of text of a piece.
KEEP, PIECE = 400_000, 2 << 20
#: Bound of queries and keys, so that no product of two overflows.
MOST = 2.0
#: Blocks whose classes are told at a time; of members, as many tokens.
FEW = 512
#: How much the counts after any id weigh against those after one id.
WEIGHT = 20.0
#: Bytes of text of a unit at most, on average, and ids of which a larger one is cut.
UNIT, UNIT_IDS = 8 << 20, 1 << 22


class Subwords:
    """Ids of words by a sentencepiece model, remembered for words met before."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size, self.end = self.sp.get_piece_size(), self.sp.eos_id()
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.size)]
        self.clear()

    def clear(self) -> None:
        self.known, self.starts, self.counts, self.met = (np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.uint8))
        self.flat = np.empty(0, np.int32)

    def forget(self) -> None:
        """Leaves the words that were met again since they came or since the last time; if those are too many, none."""
        some = np.flatnonzero(self.met > 1)
        if len(some) > KEEP // 2:
            return self.clear()
        counts = self.counts[some]
        self.flat, self.known, self.counts = self.flat[ranges(self.starts[some], counts)], self.known[some], counts
        self.starts, self.met = np.cumsum(counts) - counts, np.ones(len(some), np.uint8)

    def __call__(self, words: np.ndarray, spell: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words, as hashes in order: ids that hold each word's end to end, where a word's begin, and how many it has.
        ``spell`` tells the words at some places."""
        if len(self.known) > KEEP:
            self.forget()
        at = np.searchsorted(self.known, words)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != words) if len(self.known) else np.arange(len(words))
        if len(new):
            unknown = [self.sp.unk_id()]
            got = [x or unknown for x in self.sp.encode(spell(new), num_threads=1)]
            counts = np.fromiter(map(len, got), np.int64, len(got))
            starts = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(got), np.int32, counts.sum()))
            place = at[new]
            self.known, self.starts, self.counts, self.met = (np.insert(x, place, y) for x, y in ((self.known, words[new]), (self.starts, starts), (self.counts, counts), (self.met, 0)))
            at += np.searchsorted(new, np.arange(len(words)))  # new words before each have moved it
        self.met[at] = np.minimum(self.met[at], 1) + 1
        return self.flat, self.starts[at], self.counts[at]


_made: dict[str, Subwords] = {}


def subwords(model: str) -> Subwords:
    if model not in _made:
        _made[model] = Subwords(model)
    return _made[model]


def id_type(model: str) -> type:
    """The least whole number that holds a model's ids."""
    return np.uint16 if subwords(model).size <= 1 << 16 else np.uint32


def in_order(h: np.ndarray) -> np.ndarray:
    """Places of hashes in order of hash and place: sorted as values, with the places in their last bits, which is faster than a stable argsort."""
    bits = np.uint64(max(1, len(h) - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    order = (both & low).astype(np.int64)
    sorted_ = h.take(order)
    if (sorted_[1:] < sorted_[:-1]).any():  # different hashes that only differ in the last bits
        return np.argsort(h, kind="stable")
    return order


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes the number of each among the distinct ones in order, the first place of each distinct one, and in_order()."""
    order = in_order(h)
    sorted_ = h.take(order)
    new = np.ones(len(h), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new], order


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable, np.ndarray]:
    """Of the texts of a piece: each text's first word, the hashes of the distinct words, which of them
    each word is, a function that tells distinct words at some places in lower case, and all words' places in order of word and text."""
    data, offsets = buffers(column)
    starts, ends, at = spans(data, offsets)
    h = hashes(data, starts, ends, LOWER)
    of, one, order = numbered(h)
    raw = data.tobytes().translate(_table)

    def spell(places: np.ndarray) -> list[str]:
        some = one[places]
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[some].tolist(), ends[some].tolist())]

    return at, h.take(one), of, spell, order


def expand(tokens: Subwords, at: np.ndarray, of: np.ndarray, words: np.ndarray, spell: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts end to end, each with an end id, and each text's number of them; see distinct_words()."""
    ids, starts, counts = tokens(words, spell)
    each = counts.take(of)
    bounds = np.concatenate([[0], np.cumsum(each)])[at].astype(np.int64)
    return np.insert(ids.take(ranges(starts.take(of), each)), bounds[1:], tokens.end), np.diff(bounds) + 1


def text_ids(model: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts end to end, each with an end id, and each text's number of them."""
    at, words, of, spell, _ = distinct_words(column)
    return expand(subwords(model), at, of, words, spell)


@lru_cache(1 << 10)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


@lru_cache(1 << 10)
def _square(n: int, m: int) -> np.ndarray:
    return np.ones((n, m), np.float32)


def _chances(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of each row but for a factor, the row's sum, and the log of the factor: 1, unless a row would overflow."""
    e = np.exp(z)
    total = e @ _ones(z.shape[1])
    if not len(total) or (total.min() > 0 and total.max() < np.inf):
        return e, total, 0.0
    most = z.max(1)
    e = np.exp(z - most[:, None])
    return e, e @ _ones(z.shape[1]), most


def _sums_of(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of rows that begin at ``first``; as complex, two numbers are added at a time."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


@dataclass
class Attention:
    """What is fixed by the counts (for each id its row of the embeddings, class, place among members, and log share of
    the ids that share a place; for each row its group; the counts of members), the layer's weights, and what rows and groups say
    of the next class and member."""

    row: np.ndarray
    of: np.ndarray
    place: np.ndarray
    share: np.ndarray
    group: np.ndarray
    counted: np.ndarray
    w: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)
    after: np.ndarray | None = None
    within: np.ndarray | None = None
    #: The same as within, but by class and then group, so that what tokens of one class read lies close together.
    near: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.kind = np.append(self.of, CLASSES).astype(np.uint8)  # the last is for -1, no id
        self.row_ = self.row.astype(np.int16)

    @staticmethod
    def start(counts: np.ndarray, pieces: list[str] | None = None, seed: int = 5) -> Attention:
        """From the counts of all ids; before any fit, ids have the chances of their counts."""
        counts, n = counts.astype(float) + 0.5, len(counts)
        order = np.array(sorted(range(n), key=lambda i: pieces[i])) if pieces else np.arange(n)
        of = np.empty(n, np.int64)
        of[order] = np.minimum(((np.cumsum(counts[order]) - counts[order] / 2) / counts.sum() * CLASSES).astype(np.int64), CLASSES - 1)
        frequent = np.argsort(-counts, kind="stable")
        row, group = KNOWN + of, NEAR + of
        row[frequent[:KNOWN]] = np.arange(min(KNOWN, n))
        group[frequent[:NEAR]] = np.arange(min(NEAR, n))
        of_row = np.full(ROWS, GROUPS - 1)
        of_row[row] = group
        of_row[KNOWN : KNOWN + CLASSES] = NEAR + np.arange(CLASSES)
        # the most frequent ids of a class are members of their own, the last place is for all others
        by = np.lexsort((-counts, of))
        rank = np.empty(n, np.int64)
        rank[by] = np.arange(n) - np.searchsorted(of[by], of[by])
        place = np.minimum(rank, MEMBERS - 1)
        members = np.bincount(of * MEMBERS + place, counts, CLASSES * MEMBERS).reshape(CLASSES, MEMBERS)
        r = np.random.default_rng(seed)
        shapes = {"qo": (ROWS, WIDTH + HIDDEN), "kv": (ROWS, 2 * WIDTH), "mix": (WIDTH, HIDDEN), "out": (HIDDEN, CLASSES), "unit": (CLASSES, HIDDEN, MEMBERS)}
        w = {k: r.normal(0, 0.05 if k in ("out", "unit") else 0.3, s).astype(np.float32) for k, s in shapes.items()}
        w["far"] = (-0.15 * np.arange(LENGTH)).astype(np.float32)
        layer = Attention(row, of, place, np.log(counts / members[of, place]).astype(np.float32), of_row, members, w)
        return layer.with_pairs(np.zeros(ROWS * CLASSES + GROUPS * CLASSES * MEMBERS))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of windows the place of each pair of ids in the counts that with_pairs() takes: by row and class, and by group, class and member."""
        there = np.flatnonzero(y.ravel() >= 0)
        return self._pairs(x[:, CONTEXT:].ravel().take(there), y.ravel().take(there))

    def pairs_of(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same of texts whose ids lie end to end, without making windows."""
        last = np.empty(len(ids), np.int16)
        last[1:] = self.row_.take(ids[:-1])
        last[(np.cumsum(counts) - counts)[counts > 0]] = BEGIN
        return self._pairs(last, ids)

    def _pairs(self, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
        of, out = self.of.take(ids), np.empty((2, len(ids)), np.int64)
        np.multiply(last, CLASSES, out=out[0], dtype=np.int64)
        out[0] += of
        np.multiply(self.group.take(last), CLASSES, out=out[1])
        out[1] += of
        out[1] *= MEMBERS
        out[1] += self.place.take(ids)
        out[1] += ROWS * CLASSES
        return out.ravel()

    def with_pairs(self, counts: np.ndarray) -> Attention:
        """The layer with the logs of what rows and groups say of the next class and member, from start()'s counts of members and those of pairs."""
        members = self.counted
        first, second = counts[: ROWS * CLASSES].reshape(ROWS, CLASSES), counts[ROWS * CLASSES :].reshape(GROUPS, CLASSES, MEMBERS)
        by_class = members.sum(1) / members.sum()
        by_member = members / np.maximum(members.sum(1, keepdims=True), 1e-9)
        with np.errstate(divide="ignore"):
            self.after = np.maximum(np.log((first + WEIGHT * by_class) / (first.sum(1, keepdims=True) + WEIGHT)), -30).astype(np.float32)
            within = np.log((second + WEIGHT * by_member) / (second.sum(2, keepdims=True) + WEIGHT))
        within = np.maximum(within, NEVER).astype(np.float32)
        self.within = within.reshape(GROUPS * CLASSES, MEMBERS)
        self.near = within.transpose(1, 0, 2).reshape(CLASSES * GROUPS, MEMBERS)
        return self

    def copy(self) -> Attention:
        return Attention(self.row, self.of, self.place, self.share, self.group, self.counted, {k: v.copy() for k, v in self.w.items()}, {}, self.after, self.within, self.near)

    def hidden(self, x: np.ndarray) -> tuple:
        """x: [block, LENGTH] rows of the embeddings; what the layer makes of each of the last BLOCK."""
        w = self.w
        qo, kv = w["qo"].take(x[:, CONTEXT:], axis=0), w["kv"].take(x, axis=0)  # faster than w[...]
        q, k, v = qo[..., :WIDTH], kv[..., :WIDTH], kv[..., WIDTH:]
        a = q @ k.transpose(0, 2, 1)
        a += np.where(SEEN, w["far"][AHEAD], NEVER)
        np.exp(a, out=a)
        over = (1 / (a.reshape(-1, LENGTH) @ _square(LENGTH, WIDTH))).reshape(*a.shape[:2], WIDTH)  # the same for each of WIDTH
        seen = a @ v
        seen *= over
        h = seen.reshape(-1, WIDTH) @ w["mix"]
        h += qo[..., WIDTH:].reshape(-1, HIDDEN)
        h += np.abs(h)
        h *= np.float32(0.5)  # the positive part, faster than a maximum
        return q, k, v, a, over, seen, h

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places of ids (-1: none, left out) in order of class, and (class, from, to) of those that there are."""
        c = self.kind.take(ids)
        cuts = [0, *np.cumsum(np.bincount(c, minlength=CLASSES + 1)).tolist()]
        order = np.argsort(c, kind="stable")[: cuts[CLASSES]]
        return order, [(k, i, j) for k, i, j in zip(range(CLASSES), cuts, cuts[1:]) if i < j]

    def chances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each id of y (-1: none, 0) after what x holds before it."""
        w, flat, last = self.w, y.ravel(), x[:, CONTEXT:].ravel()
        h, out = np.empty((len(flat), HIDDEN), np.float32), np.empty(len(flat), np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            # classes, in order of text
            for s in range(0, len(x), FEW):
                i, j = s * BLOCK, min(s + FEW, len(x)) * BLOCK
                h[i:j] = self.hidden(x[s : s + FEW])[-1]
                z = h[i:j] @ w["out"]
                z += self.after.take(last[i:j], axis=0)
                got = z.take(np.arange(0, z.size, CLASSES) + self.of.take(flat[i:j]))
                _, sums, moved = _chances(z)
                got -= np.log(sums) + moved
                out[i:j] = got
            # members, class by class
            order, cuts = self.by_class(flat)
            for c, first, end in cuts:
                near = self.near[c * GROUPS : (c + 1) * GROUPS]
                for s in range(first, end, FEW * BLOCK):
                    at = order[s : min(s + FEW * BLOCK, end)]
                    ids = flat.take(at)
                    z = h.take(at, axis=0) @ w["unit"][c]
                    z += near.take(self.group.take(last.take(at)), axis=0)
                    got = z.take(np.arange(0, z.size, MEMBERS) + self.place.take(ids))
                    got += self.share.take(ids)
                    _, sums, moved = _chances(z)
                    got -= np.log(sums) + moved
                    out[at] += got
        out[flat < 0] = 0
        return out.reshape(y.shape)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 1, batch: int = 256, rate: float = 1.0, seed: int = 6) -> Attention:
        """Adagrad on the mean log-likelihood of the next id, going on from the fit before; y: [block, BLOCK], -1 where there is none."""
        r = np.random.default_rng(seed)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(epochs):
                order = r.permutation(len(x))
                for s in range(0, len(x), batch):
                    self._step(x[order[s : s + batch]], y[order[s : s + batch]], rate)
        return self

    def _move(self, name: str, g: np.ndarray, rate: float, at: np.ndarray | None = None) -> None:
        """One Adagrad step of weights, or of the rows ``at`` of a table."""
        w = self.w[name]
        if name not in self.squares:
            self.squares[name] = np.full_like(w, 1e-3)
        squares = self.squares[name]
        if at is None:
            squares += g * g
            step = np.sqrt(squares)
            np.divide(g, step, out=step)
            step *= rate
            w -= step
            if name == "far":
                np.minimum(w, 20, out=w)
                np.maximum(w, -20, out=w)
        else:
            step = squares.take(at, axis=0)
            step += g * g
            squares[at] = step
            np.sqrt(step, out=step)
            np.divide(g, step, out=step)
            step *= rate
            new = w.take(at, axis=0)
            new -= step
            bound = new[:, :WIDTH]  # queries and keys stand first
            np.minimum(bound, MOST, out=bound)
            np.maximum(bound, -MOST, out=bound)
            w[at] = new

    def _step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        w = self.w
        q, k, v, a, over, seen, h = self.hidden(x)
        flat, last = y.ravel(), x[:, CONTEXT:].ravel()
        there, cuts = self.by_class(flat)
        if not len(there):
            return
        ids, ht, before = flat.take(there), h.take(there, axis=0), last.take(there)
        of, scale = self.of.take(ids), np.float32(1 / len(ids))
        # classes
        p = ht @ w["out"]
        p += self.after.take(before, axis=0)
        p, total, _ = _chances(p)
        p *= (scale / total)[:, None]
        p.reshape(-1)[np.arange(0, p.size, CLASSES) + of] -= scale
        dh = p @ w["out"].T
        slopes = {"out": ht.T @ p}
        # members; dot has less to do before each product than matmul
        hs, units = [ht[i:j] for _, i, j in cuts], [w["unit"][c] for c, _, _ in cuts]
        z = np.empty((len(ids), MEMBERS), np.float32)
        for hc, unit, (_, i, j) in zip(hs, units, cuts):
            np.dot(hc, unit, z[i:j])
        z += self.near.take(of * GROUPS + self.group.take(before), axis=0)
        z, total, _ = _chances(z)
        z *= (scale / total)[:, None]
        z.reshape(-1)[np.arange(0, z.size, MEMBERS) + self.place.take(ids)] -= scale
        slopes["unit"], more = np.zeros_like(w["unit"]), np.empty_like(dh)
        for hc, unit, (c, i, j) in zip(hs, units, cuts):
            zc = z[i:j]
            np.dot(hc.T, zc, slopes["unit"][c])
            np.dot(zc, unit.T, more[i:j])
        dh += more
        # the layer
        dh *= ht > 0
        back = np.full(len(h), -1)  # the last row is for those without an id
        back[there] = np.arange(len(there))
        d = np.concatenate([dh, np.zeros((1, HIDDEN), np.float32)]).take(back, axis=0, mode="wrap")
        slopes["mix"] = seen.reshape(-1, WIDTH).T @ d
        dseen = (d @ w["mix"].T).reshape(seen.shape)
        dseen *= over
        dv = a.transpose(0, 2, 1) @ dseen
        da = dseen @ v.transpose(0, 2, 1)
        da -= ((dseen * seen).reshape(-1, WIDTH) @ _square(WIDTH, LENGTH)).reshape(da.shape)
        da *= a
        slopes["far"] = np.bincount(AHEAD.ravel(), (_ones(len(x)) @ da.reshape(len(x), -1)) * SEEN.ravel(), LENGTH).astype(np.float32)
        dk, dq = da.transpose(0, 2, 1) @ q, da @ k
        for name, g in slopes.items():
            self._move(name, g, rate)
        for rows, name, both in ((last, "qo", (dq, d)), (x.ravel(), "kv", (dk, dv))):
            order = np.argsort(rows, kind="stable")
            sorted_ = rows[order]
            new = np.ones(len(rows), bool)
            np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
            first = np.flatnonzero(new)
            sums = [_sums_of(g.reshape(len(rows), -1).take(order, axis=0), first) for g in both]
            self._move(name, np.concatenate(sums, axis=1), rate, sorted_[first])

    def score(self, ids: np.ndarray, counts: np.ndarray, most: int = 8192) -> np.ndarray:
        """log10 probability of each text; ids end to end."""
        x, y, text = self.blocks(ids, counts)
        out = np.zeros(len(counts))
        for s in range(0, len(x), most):
            got = self.chances(x[s : s + most], y[s : s + most])
            out += np.bincount(text[s : s + most], got.sum(1, dtype=np.float64), len(counts))
        return out / np.log(10)

    def blocks(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of texts whose ids lie end to end: rows of the embeddings [n, LENGTH] (BEGIN stands before a text, NONE
        where there is nothing), the ids after each of the last BLOCK (-1 beyond the end), and the text."""
        n = -(-counts // BLOCK)
        text, places = np.repeat(np.arange(len(counts)), n), n * BLOCK
        if not len(text):
            return np.empty((0, LENGTH), np.int16), np.empty((0, BLOCK), np.int32), text
        # texts padded to whole blocks; as input one place later, after BEGIN and a context of nothing
        base = np.cumsum(places) - places
        there = np.ones(places.sum(), bool)
        there[ranges(base + counts, places - counts)] = False
        y = np.full(len(there), -1, np.int32)
        y[there] = ids
        x = np.full(len(there) + CONTEXT * len(counts) + 1, NONE, np.int16)
        lead = CONTEXT * (np.arange(len(counts)) + 1)
        there, starts, ends = np.ones(len(x), bool), base + lead + 1, base + lead + 1 + counts
        gaps = np.append(0, ends)
        there[ranges(gaps, np.append(starts, len(x)) - gaps)] = False
        x[there] = self.row_.take(ids)
        last = (base + lead + counts)[counts % BLOCK == 0]  # the last id of a whole block has nothing after it
        x[last] = NONE
        x[base + lead] = BEGIN
        rows = np.lib.stride_tricks.sliding_window_view(x, LENGTH)
        first = np.arange(len(text)) * BLOCK + CONTEXT * text
        return rows[first], y.reshape(-1, BLOCK), text


SCATTERED = "bucket int, unit int, doc long, tie long, piece long, at int, held boolean, hashes binary, train binary, texts binary, docs binary, times binary, keys binary, blank binary, words binary, ids binary"
COUNTED = "piece long, sums binary, known binary, kinds long, total long, unit int, keys binary, blank binary, held binary, words binary, tokens binary, pieces binary, ats binary, ids binary"


def _arrays(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, types[t]) for n, t in (x.split() for x in schema.split(", "))]))


def _scatter(model: str, buckets: int, units: int):
    """Texts to their ids, by unit; to the keys and words of their piece; and to its distinct words by range of hash, each with its
    count in training texts and its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = (TaskContext.get().partitionId() << 32) - 1
        for b in slices(batches, 1, PIECE):
            piece += 1
            at, words, of, spell, order = distinct_words(b.column(1))
            n, train = np.diff(at), ~np.asarray(b.column(2).cast(pa.int8())).astype(bool)
            ids, counts = expand(subwords(model), at, of, words, spell)
            keys, blank = np.asarray(b.column(0).fill_null(0)).astype(np.int64), np.asarray(b.column(0).is_null().cast(pa.int8())).astype(bool)
            yield _arrays([{"bucket": piece % buckets, "piece": piece, "keys": keys.tobytes(), "blank": blank.tobytes(), "words": n.astype(np.int64).tobytes(), "train": train.tobytes()}], SCATTERED)
            # each text's ids, to its unit
            flat, ends = ids.astype(id_type(model)), np.cumsum(counts)
            each_ids = [flat[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
            ties = np.array([zlib.crc32(x) for x in each_ids], np.int64)
            unit = (mix(keys.astype(np.uint64) * np.uint64(P) + ties.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) * units >> 24
            columns = {"bucket": pa.array((unit * buckets // units).astype(np.int32)), "unit": pa.array(unit.astype(np.int32)), "doc": b.column(0).cast(pa.int64()), "tie": pa.array(ties), "piece": pa.array(np.full(len(keys), piece)), "at": pa.array(np.arange(len(keys), dtype=np.int32)), "held": pa.array(~train), "ids": pa.array(each_ids, pa.binary())}
            names = [x.split()[0] for x in SCATTERED.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(keys), pa.binary()) for c in names], names)
            # pairs of a word and a text, with how often
            text = np.repeat(np.arange(len(n)), n)
            seen = np.bincount(of, train[text], len(words)).astype(np.uint32)
            word, doc = of[order], text[order]
            first = np.ones(len(order), bool)
            first[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(first)
            docs, texts = doc[first].astype(np.uint16), np.bincount(word[first], minlength=len(words)).astype(np.uint16)
            times = np.diff(np.append(first, len(order))).astype(np.uint32)
            bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            each, rows = np.concatenate([[0], np.cumsum(texts, dtype=np.int64)]), []
            for k, i, j in zip(range(buckets), cuts, cuts[1:]):
                if i < j:
                    p, q = each[i], each[j]
                    rows.append({"bucket": k, "piece": piece, "hashes": words[i:j].tobytes(), "train": seen[i:j].tobytes(), "texts": texts[i:j].tobytes(), "docs": docs[p:q].tobytes(), "times": times[p:q].tobytes()})
            yield _arrays(rows, SCATTERED)
        pa.default_memory_pool().release_unused()

    return run


def _unit(rows: list[dict], width: int) -> dict:
    """The texts of a unit, or of a part of a very large one, as one row."""
    pack = lambda c, kind: np.array([r[c] for r in rows], kind).tobytes()
    size = np.array([len(r["ids"]) // width for r in rows], np.int64)
    return {"piece": -2, "unit": rows[0]["unit"], "held": pack("held", bool), "tokens": size.tobytes(), "pieces": pack("piece", np.int64), "ats": pack("at", np.int32), "ids": b"".join(r["ids"] for r in rows)}


def _count(width: int):
    """Counts of a bucket's words over all pieces, as sums for each text of each piece; its units, whose texts come in order after the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, texts, held = [], [], 0
        for b in batches:
            for k in range(0, len(b), 512):
                for r in b.slice(k, 512).to_pylist():
                    if r["keys"] is not None:
                        yield _arrays([{c: r[c] for c in ("piece", "keys", "blank", "words")} | {"held": np.logical_not(np.frombuffer(r["train"], bool)).tobytes()}], COUNTED)
                    elif r["unit"] is None:
                        words.append(r)
                    else:
                        if words:
                            yield from _sums(words)
                            words = []
                        if texts and (texts[0]["unit"] != r["unit"] or held + len(r["ids"]) > UNIT_IDS * width):
                            yield _arrays([_unit(texts, width)], COUNTED)
                            texts, held = [], 0
                        texts.append(r)
                        held += len(r["ids"])
        if words:
            yield from _sums(words)
        if texts:
            yield _arrays([_unit(texts, width)], COUNTED)
        pa.default_memory_pool().release_unused()

    return run


def _sums(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    of, _, _ = numbered(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]))
    seen = np.concatenate([np.frombuffer(r["train"], np.uint32) for r in rows])
    total = np.bincount(of, seen)
    out, at = [{"piece": -1, "kinds": int((total > 0).sum()), "total": int(total.sum())}], 0
    logs = np.log10(total + 1)  # 0 for a word that isn't known, and only then
    for r in rows:
        texts = np.frombuffer(r["texts"], np.uint16)
        c = np.repeat(logs.take(of[at : at + len(texts)]), texts)
        at += len(texts)
        docs, times = np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["times"], np.uint32)
        out.append({"piece": r["piece"], "sums": np.bincount(docs, c * times).tobytes(), "known": np.bincount(docs, times * (c > 0)).astype(np.int64).tobytes()})
    for i in range(0, len(out), 256):
        yield _arrays(out[i : i + 256], COUNTED)


SCORED = "piece long, ats binary, score binary"


def _score(model: str, layer: Attention):
    """Units' ids to their texts' scores, by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                score = layer.score(np.frombuffer(r["ids"], id_type(model)), np.frombuffer(r["tokens"], np.int64))
                piece, at = np.frombuffer(r["pieces"], np.int64), np.frombuffer(r["ats"], np.int32)
                order = np.argsort(piece, kind="stable")
                first = np.flatnonzero(np.diff(piece[order], prepend=piece[order][:1] - 1)).tolist()
                ends = [*first[1:], len(order)]
                at, score = at[order], score[order]
                columns = [pa.array(piece[order[first]]), *(pa.array([v[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()) for v in (at, score))]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "ats", "score"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads, rows = {}, defaultdict(list)
    for b in batches:
        for r in b.to_pylist():
            if r["keys"] is not None:
                heads[r["piece"]] = r
            else:
                rows[r["piece"]].append(r)
    for piece, head in heads.items():
        keys = np.frombuffer(head["keys"], np.int64)
        sums, known, score = np.zeros(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        for r in rows.pop(piece, []):
            if r["score"] is not None:
                score[np.frombuffer(r["ats"], np.int32)] = np.frombuffer(r["score"])
                continue
            s, k = np.frombuffer(r["sums"]), np.frombuffer(r["known"], np.int64)
            sums[: len(s)] += s
            known[: len(k)] += k
        columns = [pa.array(keys, mask=np.frombuffer(head["blank"], bool)), *map(pa.array, (np.frombuffer(head["held"], bool), np.frombuffer(head["words"], np.int64), known, sums, score))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "held", "words", "known", "sums", "score"])


def training_ids(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (ids, tokens, held) of units: the ids of each unit's training texts end to end, and each text's number."""
    for b in batches:
        for r in b.to_pylist():
            ids, counts, held = np.frombuffer(r["ids"], id_type(model)), np.frombuffer(r["tokens"], np.int64), np.frombuffer(r["held"], bool)
            yield ids[np.repeat(~held, counts)], counts[~held]


#: Numbers of a row when many are summed.
SUMS = 1 << 13


def _pack(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole numbers as rows of SUMS of them, but for rows of zeros."""
    for k in range(0, len(total), SUMS):
        if total[k : k + SUMS].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // SUMS], pa.int32()), pa.array([total[k : k + SUMS].tobytes()], pa.binary())], ["part", "sums"])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for b in batches:
        for part, sums in zip(b.column(0).to_pylist(), b.column(1)):
            sums = np.frombuffer(sums.as_buffer(), np.int64)
            total[part] = total[part] + sums if part in total else sums
    for part, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])


def _added(units: DataFrame, size: int, run: Callable) -> np.ndarray | None:
    """The sum of ``size`` whole numbers over all tasks, each of which makes them by ``run(batches)`` (None: none); the model's size, not the input's, bounds
    what comes back.  None if no task has any."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        if total is not None:
            yield from _pack(total)

    tasks = min(parts(units.sparkSession), -(-size // SUMS))
    rows = units.mapInArrow(packed, "part int, sums binary").repartitionById(tasks, F.col("part") % tasks).mapInArrow(_sum_parts, "part int, sums binary").toArrow()
    if not rows.num_rows:
        return None
    out = np.zeros(size, np.int64)
    for part, sums in zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist()):
        out[part * SUMS : (part + 1) * SUMS] = np.frombuffer(sums, np.int64)
    return out


def _named(units: DataFrame, model: str, size: int, places) -> np.ndarray:
    """How often each of ``size`` places is named by ``places(ids, counts)`` over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for ids, counts in training_ids(model, batches):
            total += np.bincount(places(ids, counts), minlength=size)
        return total

    got = _added(units, size, run)
    return np.zeros(size, np.int64) if got is None else got


def id_counts(units: DataFrame, model: str, size: int) -> np.ndarray:
    """How often each id is in the training texts of units."""
    return _named(units, model, size, lambda ids, counts: ids)


def pair_counts(units: DataFrame, model: str, layer: Attention) -> np.ndarray:
    """How often each pair that with_pairs() counts is in the training texts of units."""
    return _named(units, model, ROWS * CLASSES + GROUPS * CLASSES * MEMBERS, layer.pairs_of)


#: Weights are summed as whole numbers of this, so the order of tasks changes nothing.
GRAIN = 2.0**-20


def fit_all(layer: Attention, units: DataFrame, model: str, number: int, rounds: int, epochs: int = 1) -> Attention:
    """The layer after ``rounds``, in each of which the next range of the ``number`` of units is fitted, each ``epochs`` times over on a copy
    of its own, and the copies are averaged by numbers of windows.  Files tell their ranges, so those of other rounds aren't read."""
    names = sorted(layer.w)
    size = sum(layer.w[k].size for k in names)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for ids, counts in training_ids(model, batches):
            x, y, _ = layer.blocks(ids, counts)
            if not len(x):
                continue
            mine = layer.copy().fit(x, y, epochs)
            flat = np.concatenate([mine.w[k].ravel() - layer.w[k].ravel() for k in names]).astype(float)
            sums = np.append(np.rint(flat * len(x) / GRAIN), len(x)).astype(np.int64)
            total = sums if total is None else total + sums
        return total

    for k in range(rounds):
        first, end = k * number // rounds, (k + 1) * number // rounds
        by, at = _added(units.filter((F.col("unit") >= first) & (F.col("unit") < end)), size + 1, run), 0
        if by is not None:
            for name in names:
                v = layer.w[name]
                layer.w[name] = v + (by[at : at + v.size] * GRAIN / by[-1]).reshape(v.shape).astype(np.float32)
                at += v.size
    return layer


def language_model_scores(docs: DataFrame, model: str, rounds: int = 4, least_steps: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of docs.

    Texts whose crc32 of the key as text leaves 2 modulo 7 are held out, the others train.  Base: words
    in lower-cased A-Z and one end, by add-one unigram counts over all training texts.  score: log10
    probability by the attention model over the subword ids of ``model``.  Its layer is fitted on all blocks of all training
    texts in at most ``rounds`` rounds, see fit_all(); over little input several times, so that there are ``least_steps`` steps.

    How the input lies in partitions changes nothing but the last digits of sums.  A null text counts as empty: one token, the end.
    A row with a null key trains; repeated rows each count and give a row.  An empty table gives no rows; without training texts
    all counts are 0.  A text of any length is scored whole, in blocks.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    docs = docs.withColumn("held", F.coalesce(F.pmod(F.crc32(F.col("doc").cast("string")), F.lit(7)) == 2, F.lit(False)))
    known = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.sum((~F.col("held")).cast("long")).alias("ends")).first()
    size, ends = known["size"] or 0, known["ends"] or 0
    # units are as many as the input asks for; a bucket, which its task holds whole, has several of them or is one
    units = 1 << max(0, int(-(-size // UNIT) - 1).bit_length())
    buckets = min(units, 1 << (2 * parts(spark) - 1).bit_length())
    placed = docs.mapInArrow(_scatter(model, buckets, units), SCATTERED).repartitionById(buckets, F.col("bucket"))
    placed = placed.sortWithinPartitions(F.col("unit").asc_nulls_first(), "doc", "tie")
    counted = cut(placed.mapInArrow(_count(np.dtype(id_type(model)).itemsize), COUNTED))
    rows = counted.filter("ids is not null").select("unit", "ids", "tokens", "held")
    layer = Attention.start(id_counts(rows, model, subwords(model).size), subwords(model).pieces)
    pairs = pair_counts(rows, model, layer)
    layer.with_pairs(pairs)
    steps = pairs[: ROWS * CLASSES].sum() / (BLOCK * 256)
    layer = fit_all(layer, rows, model, units, min(rounds, units), max(1, int(-(-least_steps // max(steps, 1)))) if steps < least_steps else 1)
    all_ = counted.filter("piece = -1").agg(F.sum("kinds"), F.sum("total")).first()
    kinds, total = (all_[0] or 0) + (ends > 0), (all_[1] or 0) + ends
    scored = counted.filter("ids is not null").select("pieces", "ats", "tokens", "ids").mapInArrow(_score(model, layer), SCORED)
    rest = counted.filter("piece >= 0").select("piece", "sums", "known", "keys", "blank", "held", "words")
    rows = rest.unionByName(scored, allowMissingColumns=True).repartitionById(buckets, (F.col("piece") % buckets).cast("int")).mapInArrow(_gather, "doc long, held boolean, words long, known long, sums double, score double")
    tokens = F.col("words") + 1
    base = F.col("sums") + float(np.log10(ends + 1)) - tokens * float(np.log10(total + kinds + 1))
    return rows.select(F.col("doc").alias(key), F.col("held").alias("held_out"), tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
