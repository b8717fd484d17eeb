"""SentencePiece encoding and decoding with a byte-pair model (operator 13).

The pieces of a text are read off a table with one row for each of its prefixes: the last piece of that prefix's
encoding.  There is exactly one, and it doesn't depend on what follows: of the pieces that end at the position (found
by one pass of an automaton over the text), it is the one that may stand after the last piece of the prefix
before it.  Two pieces may stand side by side if encoding them joined gives back just these two.  The ids
are then recovered from the end backwards.  So a text of any length takes time in proportion to its length.

No piece has the word mark behind another character, so a text is cut in front of its marks first, and
the ids of short chunks are remembered.  Characters that the vocabulary lacks become the pieces of their bytes.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.tokencount import MARK, RUNS
from spanloom.llm.words import slices

#: Chunks and pairs that a Python worker remembers; beyond it they are worked out anew, with the same results.
KEEP = 400_000
#: Chunks of so many characters are remembered.
SHORT = 40
#: What an unknown id is decoded as.
UNKNOWN = " ⁇ "

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Ids of texts and texts of ids, as the library gives them for the same model."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in ids]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has the word mark inside; chunks wouldn't be independent")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte)}
        surface = [b"" if sp.is_control(i) or sp.is_unused(i) else UNKNOWN.encode() if sp.is_unknown(i) else byte_of.get(i) or self.piece[i].replace(MARK, " ").encode() for i in ids]
        self.surface = np.array(surface, object)
        # the order in which pieces are made, and the two parts that each is made of last; single characters are there from the start
        self.made = {p: k for k, p in enumerate(sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p]))}
        named = [self.score[p] for p in self.made if p.strip(MARK)]
        if len(set(named)) < len(named):
            raise ValueError("two pieces have one score; which is made first would depend on their places")
        self.parts = {p: parts for p in self.made if len(parts := self.merged(p, 2)) == 2 and "".join(parts) in self.score}
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) == 1 or p in self.parts:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces of a short text by the definition: best score first, leftmost of equals; as soon as there are ``stop`` of them."""
        parts = list(text)
        while True:
            if len(parts) <= stop:
                return parts
            best = max(((self.score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fit(self, a: str, b: str) -> bool:
        """Whether piece b may stand right after piece a: whether no merge across the border comes before one inside them.

        The merges are undone from the last one back; whenever the parts at the border would have made a piece that comes
        before the merge undone last, that would have been made instead.  Of two equal ones the left is made first.
        """
        out = self.fits.get((a, b))
        if out is None:
            if len(self.fits) > KEEP:
                self.fits.clear()
            # runs of marks may have one score for all lengths: they are merged by the definition
            out = self.fits[a, b] = self._fit(a, b) if a.strip(MARK) else self.merged(a + b) == [a, b]
        return out

    def _fit(self, a: str, b: str) -> bool:
        made, parts, before = self.made, self.parts, len(self.made)
        while True:
            if made.get(a + b, before) < before:
                return False
            at, bt = made.get(a, -1), made.get(b, -1)
            if at > bt:
                before, a = at, parts[a][1]
            elif bt >= 0:
                before, b = bt + 1, parts[b][0]
            else:
                return True

    def prefixes(self, chunk: str) -> list[str]:
        """The last piece of the encoding of each prefix of the chunk, or its last character where no piece ends there."""
        last: list[str] = []
        known, done = self.fits.get, 0
        for at, piece in self.automaton.iter(chunk):  # by end, and of one end the longest first
            if done > at:
                continue
            while done < at:
                last.append(chunk[done])
                done += 1
            before = at - len(piece)
            if before >= 0:
                fits = known((last[before], piece))
                if fits is None:
                    fits = self.fit(last[before], piece)
                if not fits:
                    continue
            last.append(piece)
            done += 1
        last += chunk[done:]
        return last

    def chunk(self, chunk: str) -> bytes:
        """The packed ids of a chunk that begins with marks and has none after another character."""
        last, at, out, ids = self.prefixes(chunk), len(chunk) - 1, [], self.id
        while at >= 0:
            piece = last[at]
            i = ids.get(piece)
            if i is None:
                out += [self.byte[b] for b in reversed(piece.encode())]
            else:
                out.append(i)
            at -= len(piece)
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def remembered(self, chunk: str) -> bytes:
        out = self.known.get(chunk)
        if out is None:
            out = self.chunk(chunk)
            if len(chunk) < SHORT:
                if len(self.known) > KEEP:
                    self.known.clear()
                self.known[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([self.remembered(x.replace(" ", MARK)) for x in RUNS.findall(f" {text}")])
        known, out = self.known, []
        for x in text.split(" "):
            x = MARK + x
            out.append(known.get(x) or self.remembered(x))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: the first piece loses one leading space, control ids are nothing, bytes that aren't UTF-8 are replaced one by one."""
        ids = np.frombuffer(packed, "<u4")
        surface = self.surface[ids].tolist()
        out = b"".join(surface)
        first = next((i for i, x in zip(ids, surface) if x), None)
        if first is not None and self.piece[first].startswith(MARK):
            out = out[1:]
        return out.decode("utf-8", "each_byte")


_made: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    if model not in _made:
        _made[model] = PieceCodec(model)
    return _made[model]


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for each row of docs: the ids of its whole text, packed as little-endian unsigned 32-bit integers.

    model: path of a sentencepiece byte-pair model, readable on every executor.  A null text counts as empty: it
    has begin and end only.  Rows are independent, so repeated rows and null keys each give a row, an empty table gives
    none, and other columns are not read.  A text of any length is encoded whole.  There are no ties: of equal
    scores the leftmost pair is merged first, as the library does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        head, tail = (np.array([i] if wanted else [], "<u4").tobytes() for i, wanted in ((c.begin, begin), (c.end, end)))
        for b in slices(batches, 1):
            ids = [head + c.encode(x or "") + tail for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of each row's packed ids; null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                texts = [None if x is None else c.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.drop(text).schema.fields)
    return encoded.drop(text).mapInArrow(run, f"{schema}, `{text}` string")
