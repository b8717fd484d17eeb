"""Token counts by a compiled finite-state transducer (operator 10).

The transducer reads a text character by character; each transition carries the number of
tokens that it adds (it may be negative, when a longer piece replaces shorter ones).  A text is cut into pieces,
and each piece is a map from the state before it to the state after it and the tokens added; the maps of a text's pieces
compose, and their composition from the start state gives its count.

A byte-pair vocabulary whose pieces hold the word mark only in front synchronises at
every mark: what stands before it can't change what follows.  So the map of a piece that begins at a mark is constant; it is read once
and remembered.  A long stretch without marks is cut anywhere, after every PIECE characters.  Each piece's map is made over
the states that can be there: that which the characters just before it lead to, and all that the map of the piece
before it, over its own states, ends in; all pieces are read side by side, again and again until no map ends outside the
next one's states.  Then the maps compose by a parallel prefix scan, in as many steps as the logarithm of their number.

States are made when a transition is first needed and kept for the life of the Python
worker.  A state holds all that later characters can depend on: the longest suffix that
begins some piece, and, for each position in that suffix, the last token of the prefix
that ends there and its count relative to the current one.  A token follows another
only if merging the two from single characters gives back just these two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Kept transitions and chunk counts; beyond it they are made anew, with the same results.
KEEP = 1_000_000
#: Characters of a piece, those read before it to guess its first state, and from which length on a stretch is cut.
PIECE, BEFORE, LONG = 256, 32, 2048
RUNS = re.compile(r" *[^ ]+| +")


class Transducer:
    """Counts the tokens of chunks for one vocabulary; see the module's text."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has the word mark inside; chunks wouldn't synchronise")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.fit: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", (None,), (0,))
        self.states, self.ids, self.next, self.counts = [start], {start: 0}, [{}], {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the definition: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fit:
            if len(self.fit) > KEEP:
                self.fit.clear()
            self.fit[key] = self.merged(a + b) == [a, b]
        return self.fit[key]

    def step(self, s: int, c: str) -> tuple[int, int]:
        """The transition of state s at c, made and kept: (state, tokens added)."""
        suffix, last, count = self.states[s]
        full, d = suffix + c, len(suffix) + 1
        for j in range(d):
            t = full[j:]
            if (t in self.score or len(t) == 1) and (last[j] is None or self.follows(last[j], t)):
                break
        else:
            raise AssertionError(f"no token ends at {full!r}")
        added = count[j] + (1 if t in self.score else len(t.encode()))
        j = next((k for k in range(d) if full[k:] in self.begins), d)
        state = (full[j:], (*last, t)[j:], tuple(x - added for x in (*count, added)[j:]))
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        self.next[s][c] = out = (self.ids[state], added)
        return out

    def __call__(self, chunk: str) -> int:
        """Tokens of a chunk that begins with marks and has none after another character."""
        if len(self.states) > KEEP:
            self.reset()
        s, n, table = 0, 0, self.next
        for c in chunk:
            s, added = table[s].get(c) or self.step(s, c)
            n += added
        return n

    def side_by_side(self, states: np.ndarray, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of many pieces (rows of code points, with their lengths), each at one state: states after them, tokens added."""
        states, added = states.copy(), np.zeros(len(states), np.int64)
        for t in range(chars.shape[1]):
            at = np.flatnonzero(t < size)
            keys, of = np.unique(states[at] << 21 | chars[at, t], return_inverse=True)
            got = [self.next[k >> 21].get(c := chr(k & 0x1FFFFF)) or self.step(k >> 21, c) for k in keys.tolist()]
            got = np.array(got, np.int64).reshape(-1, 2)[of]
            states[at] = got[:, 0]
            added[at] += got[:, 1]
        return states, added

    def long(self, chunk: str) -> int:
        """Tokens of a chunk of any length, as the composition of its pieces' maps."""
        if len(chunk) < LONG:
            return self(chunk)
        if len(self.states) > KEEP:
            self.reset()
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = -(-len(codes) // PIECE)
        chars = np.zeros((n, PIECE), np.int64)
        chars.ravel()[: len(codes)] = codes
        size = np.full(n, PIECE)
        size[-1] = len(codes) - PIECE * (n - 1)
        guess = np.zeros(n, np.int64)
        guess[1:] = self.side_by_side(guess[1:], chars[:-1, -BEFORE:], np.full(n - 1, BEFORE))[0]
        # the states that can be before each piece, and where each of them leads
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        todo = list(enumerate(guess.tolist()))
        while todo:
            pieces, states = np.array(todo).T
            after, added = self.side_by_side(states, chars[pieces], size[pieces])
            for k, s, t, a in zip(pieces.tolist(), states.tolist(), after.tolist(), added.tolist()):
                maps[k][s] = t, a
            todo = sorted({(k + 1, t) for k, t in zip(pieces.tolist(), after.tolist()) if k + 1 < n and t not in maps[k + 1]})
        return composed(maps)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        counts, firsts, n = self.counts, np.zeros(len(texts), np.int64), 0
        out: list[int] = []
        for k, text in enumerate(texts):
            firsts[k] = len(out)
            if not text:
                continue
            text = text.replace(MARK, " ")
            if "  " in text or text[0] == " " or text[-1] == " ":
                chunks = RUNS.findall(f" {text}")
                out += [self.long(x.replace(" ", MARK)) for x in chunks]
                continue
            for x in text.split(" "):
                n = counts.get(x)
                if n is None:
                    n = self.long(MARK + x)
                    if len(x) < 40:
                        if len(counts) > KEEP:
                            counts.clear()
                        counts[x] = n
                out.append(n)
        total = np.concatenate([[0], np.cumsum(np.array(out, np.int64))])
        return total[np.append(firsts[1:], len(out))] - total[firsts] if len(texts) else firsts


def composed(maps: list[dict[int, tuple[int, int]]]) -> int:
    """Tokens added by maps in a row, from state 0: each leads from states to (state of the next one's, tokens)."""
    n, most = len(maps), max(map(len, maps))
    place = [{s: i for i, s in enumerate(m)} for m in maps]
    to, added = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
    for k, m in enumerate(maps):
        for i, (t, a) in enumerate(m.values()):
            to[k, i], added[k, i] = place[k + 1][t] if k + 1 < n else 0, a
    step = 1
    while step < n:  # map k becomes that of pieces k - 2 step + 1 to k
        through = to[:-step].copy()
        more = np.take_along_axis(added[step:], through, 1) + added[:-step]
        further = np.take_along_axis(to[step:], through, 1)
        added[step:], to[step:] = more, further
        step *= 2
    return int(added[-1, place[0][0]])


_made: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    if model not in _made:
        _made[model] = Transducer(model)
    return _made[model]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row of docs.

    model: path of a sentencepiece byte-pair model, readable on every executor.  A null text
    counts as empty: no bytes, no tokens.  Rows are independent: repeated rows and null keys
    each give a row, an empty table gives none, other columns are not read.  A text of any length is read whole, also one
    without a space; its pieces' maps compose.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(model)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counter.texts(texts)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
