"""What the span finders of operators 2 and 4 have in common."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.crf import Crf, tagger
from spanloom.llm.words import buffers, slices

Spans = list[tuple[str, int, int]]


def chosen_rows(labelled: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """At most ``most`` labelled rows, in an order that reruns repeat."""
    rows = labelled.select("text", "start", "end").filter(F.col("text").isNotNull()).orderBy("text", "start", "end").limit(most)
    return [tuple(r) for r in rows.collect()]


def apart(found: list[tuple[int, int]], base: Spans) -> list[tuple[int, int]]:
    """The spans that meet no base span."""
    taken = sorted((s, e) for _, s, e in base)
    reach, most = [], 0
    for _, e in taken:
        reach.append(most := max(most, e))
    starts = [s for s, _ in taken]
    return [(s, e) for s, e in found if (k := bisect_left(starts, e)) == 0 or reach[k - 1] <= s]


def joined(spans: Spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def finder(kinds: tuple[str, ...], base: Callable[[str], Spans], needs: Callable[[np.ndarray, np.ndarray], np.ndarray], order: Callable, model: Crf, extra: str):
    """A mapInArrow function: (key, text) to key, counts by kind, the digest of base spans, all spans.

    needs: which texts of a piece can have any base span, from their bytes and offsets.  The model
    looks at all words of all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            data, offsets = buffers(b.column(1))
            found = tagger(model).spans(b.column(1))
            look = np.flatnonzero(needs(data, offsets) | np.array([bool(x) for x in found]))
            texts = [x or "" for x in b.column(1).take(pa.array(look)).to_pylist()]
            bases = [base(x) for x in texts]
            counts = {k: np.zeros(len(b), np.int64) for k in kinds}
            digest, every = [hashlib.sha256(b"").hexdigest()] * len(b), [""] * len(b)
            for k, mine, more in zip(look.tolist(), bases, [found[k] for k in look.tolist()]):
                mine.sort(key=order)
                for kind, _, _ in mine:
                    counts[kind][k] += 1
                digest[k] = hashlib.sha256(joined(mine).encode()).hexdigest()
                every[k] = joined(sorted([*mine, *((extra, s, e) for s, e in apart(more, mine))], key=order))
            columns = [b.column(0), *[pa.array(counts[k]) for k in kinds], pa.array(digest), pa.array(every)]
            yield pa.RecordBatch.from_arrays(columns, ["key", *[f"n_{k}" for k in kinds], "base_sha256", "spans"])

    return run


def has(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which texts have a byte of those that ``wanted`` (256 booleans) marks."""
    total = np.concatenate([[0], np.cumsum(wanted[data], dtype=np.int64)])
    return total[offsets[1:]] > total[offsets[:-1]]


def bytes_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


#: Beginnings, middles and ends that made-up words of several languages are put together from.
SYLLABLES = "the ing and ion ent her for tha nth int ere tio ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont une que les ait our ais eur ment ción que ado ente los aci ren sch ein ich und die der ung gen lich keit zu ß ñ é".split()
#: Capitalised phrases that name no one.
PHRASES = "General Public License|Apache License, Version|United Nations|New Year|Terms of Service|Privacy Policy|All Rights Reserved|Creative Commons|Read More|Table of Contents|Chapter One|World War|High School|Monday Morning|Open Source|Software Foundation|North America|Prime Minister|Supreme Court|Home Page".split("|")


def made_up(pick: random.Random) -> str:
    """A word of no language: letters, or syllables of several."""
    if pick.random() < 0.3:
        return "".join(pick.choices("abcdefghijklmnopqrstuvwxyzaeioutnrsé", k=pick.randint(1, 12)))
    return "".join(pick.choices(SYLLABLES, k=pick.randint(1, 4)))


def prose(pick: random.Random, sentences: int) -> str:
    """Sentences of made-up words; some have capitals in the middle, some are all capitals, some say one word again and again."""
    out = []
    for _ in range(sentences):
        words = [made_up(pick) for _ in range(pick.randint(1, 8))]
        kind = pick.random()
        if kind < 0.2:
            words = [w.capitalize() for w in words]
        elif kind < 0.23:
            words = [w.upper() for w in words]
        elif kind < 0.28:
            words = [words[0].capitalize() + pick.choice(["", "."])] * pick.randint(2, 12)
        elif kind < 0.33:
            words.insert(pick.randint(0, len(words)), pick.choice(PHRASES))
        out.append(" ".join([words[0][:1].upper() + words[0][1:], *words[1:]]) + pick.choice([".", ".", ".", ",", "?", "!", "", "\n", ".\n"]))
    return " ".join(out)


def code(pick: random.Random) -> str:
    word = lambda: made_up(pick)
    line = lambda: pick.choice([f"{word()} = {word()}({word()});", f"if ({word()} < {pick.randint(0, 99)}) {{", f"return {word()}_{word()} / {pick.randint(1, 9)};", f"<{word()}>{word()}</{word()}>", "}", f"int {word()} = {pick.randint(0, 999)};"])
    return "\n".join(line() for _ in range(pick.randint(1, 5)))


def in_file(pick: random.Random, row: tuple[str, int, int]) -> tuple[str, int, int]:
    """A labelled row as a line of its own, or set in a prose-like or code-like file."""
    kind = pick.choice(("line", "prose", "prose", "code"))
    if kind == "line":
        return row
    text, start, end = row
    left, right = (prose(pick, pick.randint(1, 4)) + " ", " " + prose(pick, pick.randint(1, 3))) if kind == "prose" else (code(pick) + "\n", "\n" + code(pick))
    return left + text + right, start + len(left) * (end > start), end + len(left) * (end > start)
