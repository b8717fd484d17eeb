"""A linear-chain conditional random field over words, in numpy (operators 2 and 4).

Labels are outside, begin and inside.  Emissions are sums of weights of hashed features,
transitions a 3x3 table.  Training maximises the log-likelihood of a small labelled table by
full-batch gradient steps (forward-backward in log space over padded sequences); decoding is
Viterbi over all words of all texts.  A word whose lead for outside is more than all that labels of the words
beside it can make up for is outside on every best path, so the path falls into the runs between such words; a very long
run is decoded in stretches side by side, joined by the best scores from each label to each.

Features are numbers made from bytes by array operations over the distinct words of many texts at once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from spanloom.llm.words import buffers, hashes, mix, powers, ranges, spans

O, B, I = range(3)
#: Hashed feature places; the model is three weights for each.
PLACES = 1 << 16
#: Times that a feature must stand in the labelled table to be used; rare spellings would hide what shapes say.
RARE = 4
#: Transitions that no labelling has: inside can't follow outside or open a sequence.
NEVER = -1e4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = "\"'`()[]{}<>,.;:!?"
#: Bytes to classes: capitals, small letters, digits, parts of other characters; signs are classes of their own.
UPPER, LOWER, DIGIT, OTHER = 1, 2, 3, 4
_class = np.arange(256, dtype=np.int64)
for _c, _range in ((UPPER, range(65, 91)), (LOWER, range(97, 123)), (DIGIT, range(48, 58)), (OTHER, range(128, 256))):
    _class[list(_range)] = _c
_is = lambda x: np.isin(np.arange(256), list(x.encode()))
_trim, _hex, _vowel = _is(TRIM), _is("0123456789abcdef"), _is("aeiouAEIOU")
_small = np.where(_is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.arange(256) + 32, np.arange(256)).astype(np.uint64)
SIGNS_OF_WORDS = "@=_-./+:$%"
#: Runs of a word's shape and letters of its spelling that are looked at.
RUNS, LETTERS = 24, 12
BASE = 0xD6E8FEB86659FD93
#: Words beside a word whose looks are features.
BESIDE = (-2, -1, 1, 2)
#: What stands beyond the ends of a text.
EDGE = np.uint64(0x5851F42D4C957F2D)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from each of first to the next; none may be empty."""
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _place(kind: int, value: np.ndarray) -> np.ndarray:
    """Where the feature of a kind with a value lies."""
    return (mix(value.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) % np.uint64(PLACES)).astype(np.int64)


def own(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the places of their own features, hashes of their shapes, and two of how they look to their neighbours:
    the word, and the stop at its end."""
    if not len(starts):
        return np.empty((0, 18), np.int64), np.empty(0, np.uint64), np.empty((0, 2), np.uint64)
    # quotes, brackets and stops at either end don't count, unless there is nothing else
    s, e = starts.copy(), ends.copy()
    for _ in range(4):
        s += (s < e - 1) & _trim[data[s]]
        e -= (s < e - 1) & _trim[data[e - 1]]
    size = e - s
    first = np.cumsum(size) - size
    raw = data[ranges(s, size)]
    c = _class[raw]
    digits, upper, lower, other = (_sums((c == k).astype(np.int64), first) for k in (DIGIT, UPPER, LOWER, OTHER))
    letters = upper + lower + other
    hexes, vowels = _sums(_hex[raw].astype(np.int64), first), _sums(_vowel[raw].astype(np.int64), first)
    signs = np.zeros(len(s), np.int64)
    for k, x in enumerate(SIGNS_OF_WORDS.encode()):
        signs |= (_sums((raw == x).astype(np.int64), first) > 0).astype(np.int64) << k
    # shapes: runs of one class, with their lengths by class, and without
    new = np.append(True, c[1:] != c[:-1])
    new[first] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, len(c)))
    of = np.searchsorted(runs, first)
    many = np.diff(np.append(of, len(runs)))
    rank = np.arange(len(runs)) - np.repeat(of, many)
    k = c[runs]
    grade = np.where(k == DIGIT, np.minimum(length, 5), np.where((k == UPPER) | (k == LOWER), (length > 1).astype(np.int64) + (length > 3), 0))
    weight = np.where(rank < RUNS, powers(BASE, RUNS + 1)[np.minimum(rank, RUNS)], 0).astype(np.uint64)
    short = mix(_sums(k.astype(np.uint64) * weight, of))
    long = mix(_sums((k * 8 + grade).astype(np.uint64) * weight, of))
    # spelling: the first letters, in small ones
    letter = (c == UPPER) | (c == LOWER) | (c == OTHER)
    at = np.cumsum(letter) - 1
    at -= np.repeat(at[first] - letter[first] + 1, size)
    weight = np.where(letter & (at < LETTERS), powers(BASE, LETTERS + 1)[np.minimum(at, LETTERS)], 0).astype(np.uint64)
    spelled = mix(_sums(_small[raw] * weight, first) + np.uint64(7))
    plain = letters == size
    zero = np.zeros(len(s), np.int64)
    features = (
        zero, long, short, np.minimum(size // 4, 12), np.minimum(digits, 20), digits * 8 // size, many * 8 // size, (hexes == size) * 2 + (digits > 0) * (letters > 0),
        signs, np.where(_class[raw[first]] > OTHER, raw[first], 0), np.where(letters * 2 >= size, spelled, np.uint64(1)), np.where(letters > 5, vowels * 8 // np.maximum(letters, 1), 15),
        (upper > 0) * 2 + (upper == letters) + 4 * plain, np.minimum(many, 12), np.where(plain, np.minimum(size, 20), 0), np.where(signs > 0, short, np.uint64(2)), size - (ends - starts), np.minimum(size, 70) // 2,
    )
    places = np.stack([_place(n, np.asarray(f)) for n, f in enumerate(features)], 1)
    stop = np.where(e < ends, data[ends - 1], 0).astype(np.uint64)
    return places, short, np.stack([np.where(plain, spelled, short + np.uint64(1)), stop], 1)


def _beside(look: np.ndarray) -> np.ndarray:
    """The places of a look at each of BESIDE."""
    return np.stack([_place(32 + k, look) for k in range(len(BESIDE))], 1)


def _pairs(shape: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The places of a word's shape after the word before it, and after the stop before it."""
    return np.stack([_place(48 + k, mix(shape) + before[:, k]) for k in range(2)], 1)


def file_features(n_chars: np.ndarray, n_digits: np.ndarray, n_signs: np.ndarray) -> np.ndarray:
    """Places of the shares of digits and of code-like signs in whole texts, by powers of two."""

    def share(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, 12 + np.trunc(np.log2(n / np.maximum(n_chars, 1) + 2.0**-12)), 20).astype(np.int64)

    return np.stack([_place(50, share(n_digits)), _place(51, share(n_signs))], 1)


DIGITS, SIGNS = "0123456789", "{};=_/<>"


def file_of(text: str) -> np.ndarray:
    """The places of a text's file features."""
    count = lambda x: np.array([sum(map(text.count, x))])
    return file_features(np.array([len(text)]), count(DIGITS), count(SIGNS))[0]


def feature_places(texts: list[str]) -> list[np.ndarray]:
    """[word, feature] places of each text: of a word itself, of its neighbours, and of its file."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    starts, ends, at = spans(data, offsets)
    places, shape, look = own(data, starts, ends)
    out = []
    for text, i, j in zip(texts, at[:-1], at[1:]):
        seen = np.concatenate([[[EDGE, EDGE]] * 2, look[i:j], [[EDGE, EDGE]] * 2]).astype(np.uint64)
        around = [_place(32 + k, seen[2 + d : 2 + d + j - i, 0]) for k, d in enumerate(BESIDE)]
        out.append(np.column_stack([places[i:j], *around, _pairs(shape[i:j], seen[1 : 1 + j - i]), np.tile(file_of(text), (j - i, 1))]))
    return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[sequence, word, feature] places, and lengths; PLACES is the empty place."""
    lengths = np.array([len(x) for x in sequences])
    width = max((np.shape(x)[1] for x in sequences if len(x)), default=1)
    out = np.full((len(sequences), lengths.max(initial=1), width), PLACES, np.int64)
    for k, x in enumerate(sequences):
        if len(x):
            out[k, : len(x)] = x
    return out, lengths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Crf:
    def __init__(self) -> None:
        self.weights = np.zeros((PLACES + 1, 3))
        self.moves = np.zeros((3, 3))
        self._forbid()

    def _forbid(self) -> None:
        self.weights[PLACES] = 0
        self.moves[O, I] = NEVER
        self.start = np.array([0, 0, NEVER])

    def fit(self, sequences: list[np.ndarray], labels: list[list[int]], steps: int = 80, rate: float = 0.15, decay: float = 3e-4) -> Crf:
        """Adam on the mean log-likelihood, with a decay of the weights; the same input gives the same model."""
        seen = np.bincount(np.concatenate([np.ravel(x) for x in sequences]), minlength=PLACES + 1)
        rare = seen < min(RARE, len(sequences))
        order = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: len(sequences[k]))
        groups = []  # sequences of like lengths, padded together
        for keys in np.array_split(order, 8) if order else []:
            if not len(keys):
                continue
            mask = np.arange(len(sequences[keys[-1]])) < np.array([len(sequences[k]) for k in keys])[:, None]
            x, y = np.concatenate([sequences[k] for k in keys]), np.zeros(mask.shape, np.int64)
            y[mask] = np.concatenate([labels[k] for k in keys])
            groups.append((mask, np.where(rare[x], PLACES, x), np.eye(3)[y] * mask[..., None]))
        n = max(len(sequences), 1)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (self.weights, self.moves)]
        for step in range(1, steps + 1):
            slope, turn = np.zeros_like(self.weights), np.zeros_like(self.moves)
            for mask, x, hot in groups:
                off, joint = self._off(mask, self.weights[x].sum(1), hot)
                for c in range(3):
                    slope[:, c] += np.bincount(x.ravel(), np.repeat(off[:, c], x.shape[1]), PLACES + 1)
                turn += joint
            for v, g, (m, s) in zip((self.weights, self.moves), (slope / n - decay * self.weights, turn / n - decay * self.moves), state):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            self._forbid()
        return self

    def _off(self, mask: np.ndarray, words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one group: what the labels are beyond what is expected, by word, and by move in sum."""
        e = np.zeros((*mask.shape, 3))
        e[mask] = words
        width = mask.shape[1]
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + self.start
        for t in range(1, width):
            f = _logsum(forward[:, t - 1, :, None] + self.moves, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], f, forward[:, t - 1])
        total = _logsum(forward[:, -1], 1)
        for t in range(width - 2, -1, -1):
            b = _logsum(self.moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], b, 0)
        chance = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        joint = np.exp(forward[:, :-1, :, None] + self.moves + (e + backward)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        return (hot - chance)[mask], np.einsum("kti,ktj->ij", hot[:, :-1], hot[:, 1:]) - joint.sum((0, 1))

    def decode(self, sequences: list[np.ndarray], most: int = 4096) -> list[list[int]]:
        """The best labels of each sequence, by Viterbi over batches of about ``most`` words."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(sequences[order[to]]) * (to + 1 - at) <= most:
                to += 1
            x, lengths = padded([sequences[k] for k in order[at:to]])
            e = self.weights[x].sum(2)
            best, back = e[:, 0] + self.start, []
            for t in range(1, x.shape[1]):
                each = best[:, :, None] + self.moves
                go = t < lengths
                back.append(np.where(go[:, None], each.argmax(1), np.arange(3)))
                best = np.where(go[:, None], each.max(1) + e[:, t], best)
            label = best.argmax(1)
            path = [label]
            for b in reversed(back):
                label = b[np.arange(len(label)), label]
                path.append(label)
            for k, n, row in zip(order[at:to], lengths, np.array(path[::-1]).T):
                out[k] = row[:n].tolist()
            at = to
        return out


@lru_cache(4)
def _trained(rows: tuple[tuple[str, int, int], ...]) -> Crf:
    labels = []
    for text, start, end in rows:
        inside = [m.start() < end and m.end() > start and end > start for m in WORD.finditer(text)]
        labels.append([O if not x else I if i and inside[i - 1] else B for i, x in enumerate(inside)])
    return Crf().fit(feature_places([text for text, _, _ in rows]), labels)


def train(rows: list[tuple[str, int, int]]) -> Crf:
    """A model from labelled rows (text, start, end): one span of code points, none when end <= start.  The same rows
    are trained on once in a process."""
    return _trained(tuple(map(tuple, rows)))


class Tagger:
    """Spans of many texts by a model; outside is preferred by ``margin``, so that what is tagged is likely so."""

    def __init__(self, model: Crf, margin: float = 1.0):
        self.margin = np.array([margin, 0, 0])
        self.weights = model.weights
        self.model = model
        t = model.moves
        self.edge = model.weights[_beside(np.array([EDGE], np.uint64))[0]]
        # what other labels' moves can make up for at most, see labels()
        self.most = max(0, *(t[p, y] - t[p, O] for p, y in ((O, B), (B, B), (B, I), (I, B), (I, I))))
        self.most += max(0, *(t[y, n] - t[O, B if n == I else n] for y in (B, I) for n in (O, B, I)))
        self.most += max(0, *(t[I] - t[B]))

    def emissions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """First bytes and ends of all words, texts' word offsets, what each word says for each label, and how many
        words of its text stand before and after it."""
        starts, ends, at = spans(data, offsets)
        _, one, of = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        weights = self.weights
        places, shape, look = own(data, starts[one], ends[one])
        mine, beside = weights[places].sum(1), weights[_beside(look[:, 0])]
        size = np.diff(at)
        place = np.arange(len(of)) - np.repeat(at[:-1], size)
        left = np.repeat(size, size) - 1 - place
        e, before = mine[of], np.full((len(of), 2), EDGE)
        for k, d in enumerate(BESIDE):
            there = np.flatnonzero(place >= -d if d < 0 else left >= d)
            more = np.tile(self.edge[k], (len(of), 1))
            more[there] = beside[of[there + d], k]
            e += more
            if d == -1:
                before[there] = look[of[there - 1]]
        e += weights[_pairs(shape[of], before)].sum(1)
        counts = [np.diff(np.concatenate([[0], np.cumsum(wanted[data], dtype=np.int64)])[offsets]) for wanted in (_first, _digits, _signs)]
        file = weights[file_features(*counts)].sum(1)
        return starts, ends, at, e + np.repeat(file, size, 0) + self.margin, place, left

    def labels(self, e: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The best labels of all words of all texts."""
        out = np.zeros(len(e), np.int64)
        lead = e[:, O] - np.maximum(e[:, B], e[:, I])
        lead[:-1] -= np.where(left[:-1] > 0, np.maximum(e[1:, I] - e[1:, B], 0), 0)
        open_ = lead <= self.most + 1e-9
        if not open_.any():
            return out
        new, end = open_.copy(), open_.copy()
        new[1:] &= ~open_[:-1] | (place[1:] == 0)
        end[:-1] &= ~open_[1:] | (left[:-1] == 0)
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        t = self.model.moves
        for f, z in zip(first[last - first >= LONG].tolist(), last[last - first >= LONG].tolist()):
            out[f : z + 1] = best_path(e[f : z + 1], t[O] if place[f] else self.model.start, t[:, O] if left[z] else np.zeros(3), t)
        short = last - first < LONG
        first, last = first[short], last[short]
        order = np.argsort(last - first, kind="stable")
        first, last = first[order], last[order]
        size, i = last - first + 1, 0
        while i < len(size):
            j = min(int(np.searchsorted(size, max(size[i] + 3, size[i] * 5 // 4), "right")), i + max(1, 200_000 // int(size[i])))
            f, n = first[i:j], size[i:j]
            best, back = e[f] + np.where(place[f, None] > 0, t[O], self.model.start), []
            for k in range(1, n[-1]):
                each = best[:, :, None] + t
                go = (k < n)[:, None]
                back.append(np.where(go, each.argmax(1), np.arange(3)))
                best = np.where(go, each.max(1) + e[np.minimum(f + k, last[i:j])], best)
            label = (best + np.where(left[last[i:j], None] > 0, t[:, O], 0)).argmax(1)
            for k in range(n[-1] - 1, -1, -1):
                there = k < n
                out[f[there] + k] = label[there]
                if k:
                    label = back[k - 1][np.arange(len(label)), label]
            i = j
        return out

    def spans(self, column: pa.Array) -> list[list[tuple[int, int]]]:
        """The spans of each text, in code points."""
        data, offsets = buffers(column)
        starts, ends, at, e, place, left = self.emissions(data, offsets)
        label = self.labels(e, place, left)
        begin = np.flatnonzero(label == B)
        stop = np.append(np.flatnonzero(label != I), len(label))
        last = stop[np.searchsorted(stop, begin, "right")] - 1 if len(begin) else begin
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        chars, raw = np.concatenate([[0], np.cumsum(_first[data], dtype=np.int64)]), data.tobytes()
        trim = TRIM.encode()
        for k, first, t in zip((np.searchsorted(at, begin, "right") - 1).tolist(), starts[begin].tolist(), ends[last].tolist()):
            s = first
            while s < t and raw[s] in trim:
                s += 1
            while t > s and raw[t - 1] in trim:
                t -= 1
            if t > s:
                s -= s > first and raw[s - 1 : s] == b"(" and b")" in raw[s:t]
                zero = chars[offsets[k]]
                out[k].append((int(chars[s] - zero), int(chars[t] - zero)))
        return out


#: Words from which on a run is decoded in stretches.
LONG = 1024


def best_path(e: np.ndarray, begin: np.ndarray, end: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Viterbi over one long run: begin and end are added for its first and last label, t for each move.

    Stretches of about the root of its length are read side by side for the best score from each label before them to
    each of their last ones; one pass over the stretches picks the labels between them, and these fix the rest.
    """
    n = len(e)
    step = int(np.ceil(np.sqrt(n)))
    pad = -n % step
    # beyond the end only one label, which all can move to for nothing
    e = np.concatenate([e, np.tile([0, NEVER, NEVER], (pad, 1))]).reshape(-1, step, 3)
    free = np.where(np.arange(3)[None, :] == O, 0.0, NEVER) * np.ones((3, 1))

    def move(c: int, k: int) -> np.ndarray:
        at = c * step + k
        return free + end[:, None] if at == n else free if at > n else t

    moves = np.array([[move(c, k) for k in range(step)] if c == len(e) - 1 else [t] * step for c in range(len(e))])
    moves[0, 0] = begin
    if not pad:
        e[-1, -1] += end
    score = moves[:, 0] + e[:, 0][:, None, :]
    for k in range(1, step):
        score = (score[:, :, :, None] + moves[:, None, k]).max(2) + e[:, k][:, None, :]
    value, back = score[0][0], []
    for x in score[1:]:
        each = value[:, None] + x
        back.append(each.argmax(0))
        value = each.max(0)
    last = [int(value.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last = np.array(last[::-1])
    before = np.concatenate([[0], last[:-1]])
    rows = np.arange(len(e))
    best, back = moves[rows, 0, before] + e[:, 0], []
    for k in range(1, step):
        each = best[:, :, None] + moves[:, k]
        back.append(each.argmax(1))
        best = each.max(1) + e[:, k]
    out, label = np.empty((len(e), step), np.int64), last
    for k in range(step - 1, -1, -1):
        out[:, k] = label
        if k:
            label = back[k - 1][rows, label]
    return out.ravel()[:n]


#: Bytes that begin a character, digits, and signs.
_first = (np.arange(256) & 0xC0) != 0x80
_digits, _signs = _is(DIGITS), _is(SIGNS)
_made: dict[bytes, Tagger] = {}


def tagger(model: Crf) -> Tagger:
    """One for each model and process."""
    mark = model.weights.tobytes() + model.moves.tobytes()
    if mark not in _made:
        _made.clear()
        _made[mark] = Tagger(model)
    return _made[mark]


def model_spans(model: Crf, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Spans that the model tags in each text."""
    return tagger(model).spans(pa.array(texts, pa.string()))
