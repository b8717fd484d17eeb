"""Conversation structure repair by a weighted generalised LR parse (operator 12).

The role grammar (s system, u user, a assistant) is left-recursive, so its stacks are shallow:

    D -> (nothing) | P | s P        P -> u a | P u a

A conversation is read turn by turn with all stacks that edits may lead to.  Stacks are linked cells that share what lies
below; a cell may be the top of many ways of editing, which are merged to the one of least (cost, audit).  Edits: K keeps a
turn, R gives it the role that the stack wants, D deletes it, I inserts an empty turn.  The audit is their letters; since the letters
fix the cost, two audits of one top and equal cost never begin one another, and merging early loses nothing.

What a set of tops turns into at a turn depends only on the tops, their costs over the least and the order of their audits.  Tops
that cost SLACK more than the least can't win any more (ten buys any other stack's place), so there are few such sets; they and
their steps are made when first needed and kept.  A turn then costs one look-up, and the audit is read backwards at the end.

Conversations lie sorted in range partitions, and one that lies within a partition is repaired there.  The first and last of a
partition may go on in the next, and one conversation may fill many: such a piece becomes a map from each top it may begin with to the
tops it may end with, and the maps of a conversation's pieces are composed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import cut, join_same, parts

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: No top that costs so much more than the least is part of a cheapest repair.
SLACK = 12
# The automaton: what a state shifts to, how many cells a finished rule takes off, where its head leads, where input may end.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = (0, 3, 4)
#: Faults of a turn: none, last character no sentence end, blank, same role and text before; GONE rows only name their conversation.
FINE, CUT_OFF, BLANK, REPEATED, GONE = range(5)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Cell = tuple  # (state, cell below or None)
Top = tuple[Cell, int, int]  # cell, cost over the least, rank of its audit


def shift(cell: Cell, symbol: str) -> Cell | None:
    """The top after a symbol, finished rules reduced."""
    state = SHIFT.get((cell[0], symbol))
    if state is None:
        return None
    cell = (state, cell)
    if state in REDUCE:
        for _ in range(REDUCE[state]):
            cell = cell[1]
        cell = (GOTO[cell[0]], cell)
    return cell


START: Cell = (0, None)


def _all_tops() -> list[Cell]:
    found = [START]
    for cell in found:
        found += [to for x in "sua" if (to := shift(cell, x)) and to not in found]
    return found


TOPS = _all_tops()


class Parser:
    """Steps between sets of tops, made when first needed."""

    def __init__(self) -> None:
        self.sets: list[tuple[Top, ...]] = []
        self.number: dict[tuple[Top, ...], int] = {}
        self.steps: dict[tuple[int, str, int], tuple[int, int, tuple[tuple[int, str], ...]]] = {}

    def set_of(self, tops: tuple[Top, ...]) -> int:
        if tops not in self.number:
            self.number[tops] = len(self.sets)
            self.sets.append(tops)
        return self.number[tops]

    def with_inserts(self, tops: tuple[Top, ...]) -> dict[Cell, tuple[int, int, str, int]]:
        """Least (cost, rank, letters, index of the top it came from) of each top that inserts lead to."""
        best = {cell: (cost, rank, "", i) for i, (cell, cost, rank) in enumerate(tops)}
        todo = list(best)
        for cell in todo:
            cost, rank, letters, i = best[cell]
            for symbol in "ua":
                to, new = shift(cell, symbol), (cost + INSERT, rank, letters + "I", i)
                if to is not None and (to not in best or new < best[to]):
                    best[to] = new
                    todo.append(to)
        return best

    def step(self, at: int, initial: str, fault: int) -> tuple[int, int, tuple[tuple[int, str], ...]]:
        """The set after a turn, what the least cost grows by, and for each new top the top it came from and its letters."""
        out: dict[Cell, tuple[int, int, str, int]] = {}

        def offer(cell: Cell | None, new: tuple[int, int, str, int]) -> None:
            if cell is not None and (cell not in out or new < out[cell]):
                out[cell] = new

        for cell, (cost, rank, letters, i) in self.with_inserts(self.sets[at]).items():
            offer(cell, (cost + DELETE, rank, letters + "D", i))
            if fault in (FINE, CUT_OFF):
                more = cost + (TRUNCATED if fault == CUT_OFF else 0)
                offer(shift(cell, initial), (more, rank, letters + "K", i))
                for symbol in "ua":
                    offer(shift(cell, symbol), (more + REROLE, rank, letters + "R", i))
        least = min(v[0] for v in out.values())
        kept = sorted((TOPS.index(cell), cell, v) for cell, v in out.items() if v[0] <= least + SLACK)
        ranks = {a: k for k, a in enumerate(sorted({(v[1], v[2]) for _, _, v in kept}))}
        to = self.set_of(tuple((cell, v[0] - least, ranks[v[1], v[2]]) for _, cell, v in kept))
        self.steps[at, initial, fault] = step = (to, least, tuple((v[3], v[2]) for _, _, v in kept))
        return step

    def run(self, turns: Iterable[tuple[str, int]], start: Cell = START) -> tuple[int, int, list]:
        """The set of tops after turns (initial, fault), its least cost and the way back."""
        at, cost, back, steps = self.set_of(((start, 0, 0),)), 0, [], self.steps
        for initial, fault in turns:
            at, more, came = steps.get((at, initial, fault)) or self.step(at, initial, fault)
            cost += more
            back.append(came)
        return at, cost, back

    def ends(self, turns: list[tuple[str, int]], start: Cell) -> list[tuple[Cell, int, str]]:
        """Each top that turns from ``start`` may end with, with cost and audit."""
        at, cost, back = self.run(turns, start)
        return [(cell, cost + more, audit(back, i)) for i, (cell, more, _) in enumerate(self.sets[at])]

    def repair(self, turns: list[tuple[str, int]]) -> tuple[int, str]:
        """The cheapest repair: cost and audit."""
        at, cost, back = self.run(turns)
        more, _, letters, i = min(v for cell, v in self.with_inserts(self.sets[at]).items() if cell[0] in ACCEPT)
        return cost + more, audit(back, i) + letters


def audit(back: list, i: int) -> str:
    out = []
    for came in reversed(back):
        i, letters = came[i]
        out.append(letters)
    return "".join(reversed(out))


@dataclass
class Counts:
    """What is counted of a run of turns, and what is needed to join it with the next run."""

    gone_only: bool = True
    least: int | None = None
    most: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    edge: list = field(default_factory=lambda: [None, None, None, None])  # first and last turn that isn't null, first and last initial

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.join(Counts(False, turn, turn, int(turn is not None), int(fault == BLANK), int(fault == REPEATED), int(fault == CUT_OFF), 0, [turn, turn, initial, initial]))

    def join(self, b: Counts) -> None:
        if b.gone_only:
            return
        if not self.gone_only and (self.edge[3], b.edge[2]) not in LEGAL:
            self.illegal += 1
        self.illegal += b.illegal
        self.distinct += b.distinct - (b.distinct > 0 and self.edge[1] == b.edge[0])
        self.least = b.least if self.least is None else self.least if b.least is None else min(self.least, b.least)
        self.most = b.most if self.most is None else self.most if b.most is None else max(self.most, b.most)
        self.blank, self.duplicate, self.truncated = self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated
        first, last, head, tail = self.edge
        self.edge = [b.edge[0] if first is None else first, last if b.edge[1] is None else b.edge[1], b.edge[2] if self.gone_only else head, b.edge[3]]
        self.gone_only = False

    def row(self) -> dict[str, int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}

    def packed(self) -> list[str]:
        return [*(None if x is None else str(x) for x in (self.least, self.most, self.distinct, self.blank, self.duplicate, self.truncated, self.illegal)), *(None if x is None else str(x) for x in self.edge), str(int(self.gone_only))]

    @classmethod
    def unpacked(cls, v: list[str]) -> Counts:
        n = [None if x is None else int(x) for x in v[:9]]
        return cls(v[11] == "1", n[0], n[1], *n[2:7], [n[7], n[8], v[9], v[10]])


def edited(letters: str, turns: Iterator[tuple[str, str]], done: int, headed: bool) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that letters leave; done: turns left before, headed: whether the first of all is a system turn."""
    for x in letters:
        role, text = ("", "") if x == "I" else next(turns)
        if x == "D":
            continue
        if x != "K":
            role = "assistant" if (done - headed) % 2 else "user"
        done += 1
        yield x, role, text


def line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


_parser: list[Parser] = []


def parser() -> Parser:
    if not _parser:
        _parser.append(Parser())
    return _parser[0]


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "position long, edit string, role string, text string"
_EDGE = "turn long, fault int, part int, seq long"
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return [of[c.split()[1]] for c in schema.split(", ")]


def _batches(rows: Iterator[dict], key: pa.DataType, schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    form = pa.schema([("key", key), *zip(_names(schema), _types(schema))])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + len(r.get("text") or "") + len(r.get("audit") or "") + len(r.get("blob") or b"")
        if size > most:
            yield pa.RecordBatch.from_pylist(held, form)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, form)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, len(b), 1024):
            yield from b.slice(k, 1024).to_pylist()


def _with_repeats(rows: list[dict]) -> list[tuple[str, int]]:
    """(initial, fault) of a conversation's turns; a turn that isn't blank and whose role and text came before is REPEATED."""
    seen: set[tuple[str, str]] = set()
    out = []
    for r in rows:
        fault = r["fault"]
        if fault != BLANK:
            if (said := (r["role"], r["text"])) in seen:
                fault = REPEATED
            seen.add(said)
        out.append((r["role"][:1], fault))
    return out


def _whole(key: Any, rows: list[dict], turns: bool) -> Iterator[dict]:
    """A conversation that lies in one partition."""
    rows = [r for r in rows if r["fault"] != GONE]
    kinds, counts = _with_repeats(rows), Counts()
    for r, (initial, fault) in zip(rows, kinds):
        counts.add(r["turn"], initial, fault)
    cost, letters = parser().repair(kinds)
    headed = (len(letters) - letters.count("D")) % 2 == 1
    left = edited(letters, iter([(r["role"], r["text"]) for r in rows]), 0, headed)
    if turns:
        yield from ({"key": key, "position": k, "edit": x, "role": role, "text": text} for k, (x, role, text) in enumerate(left))
    else:
        digest = hashlib.sha256(b"\n".join(line(role, text) for _, role, text in left)).hexdigest()
        yield {"key": key, **counts.row(), "cost": cost, "audit": letters, "repaired_sha256": digest}


def _first_pass(turns: bool, key: pa.DataType, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repairs the conversations inside a partition; the turns of the first and the last one pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            part, held, first, seq = TaskContext.get().partitionId(), [], True, 0
            for r in _rows(batches):
                if held and held[-1]["key"] != r["key"]:
                    if not first:
                        yield from _whole(held[0]["key"], held, turns)
                    first, held = False, []
                if first:  # passes through as it comes; only its key is held
                    yield {**r, "part": part, "seq": seq}
                    held = [{"key": r["key"]}]
                else:
                    held.append(r)
                seq += 1
            if not first:
                yield from ({**r, "part": part, "seq": seq + k} for k, r in enumerate(held))

        return _batches(out(), key, schema)

    return run


def _pieces(key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A piece's counts and, for each top before it, the tops after it with cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for (k, part), rows in groupby(_rows(batches), lambda r: (r["key"], r["part"])):
                counts, kinds = Counts(), []
                for r in rows:
                    if r["fault"] != GONE:
                        kinds.append((r["role"][:1], r["fault"]))
                        counts.add(r["turn"], *kinds[-1])
                maps = [f"{i} {TOPS.index(cell)} {cost} {letters}" for i, top in enumerate(TOPS) for cell, cost, letters in parser().ends(kinds, top)]
                yield {"key": k, "part": part, "counts": counts.packed(), "maps": maps}

        return _batches(out(), key, "part int, counts array<string>, maps array<string>")

    return run


def _folded(key: pa.DataType, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A conversation's row from its pieces in order, and for each piece its edits, the turns left before it and whether a system turn leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for k, pieces in groupby(_rows(batches), lambda r: r["key"]):
                counts, best, order = Counts(), {0: (0, "", ())}, []
                for p in pieces:
                    order.append(p["part"])
                    counts.join(Counts.unpacked(p["counts"]))
                    new: dict[int, tuple[int, str, tuple]] = {}
                    for text in p["maps"]:
                        a, b, more, letters = text.split(" ")
                        if int(a) in best:
                            cost, audit_, ends = best[int(a)]
                            offer = (cost + int(more), audit_ + letters, (*ends, len(audit_) + len(letters)))
                            if int(b) not in new or offer < new[int(b)]:
                                new[int(b)] = offer
                    best = new
                last = tuple((TOPS[i], v[0], rank) for rank, (i, v) in enumerate(sorted(best.items(), key=lambda x: x[1][1])))
                cost, rank, letters, _ = min(v for cell, v in parser().with_inserts(last).items() if cell[0] in ACCEPT)
                _, audit_, ends = best[TOPS.index(last[rank][0])]
                whole = audit_ + letters
                headed = (len(whole) - whole.count("D")) % 2 == 1
                yield {"key": k, **counts.row(), "cost": cost, "audit": whole}
                at = done = 0
                for part, to in zip(order, (*ends[:-1], len(whole))):
                    yield {"key": k, "part": part, "edits": whole[at:to], "done": done, "headed": headed}
                    done += to - at - whole.count("D", at, to)
                    at = to

        return _batches(out(), key, schema)

    return run


def _edited(turns: bool, key: pa.DataType, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The turns that a piece's edits leave, or their lines joined; a piece's edits come before its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for (k, part), rows in groupby(_rows(batches), lambda r: (r["key"], r["part"])):
                e = next(rows)
                left = edited(e["edits"], ((r["role"], r["text"]) for r in rows if r["fault"] != GONE), e["done"], e["headed"])
                if turns:
                    yield from ({"key": k, "position": e["done"] + n, "edit": x, "role": role, "text": text} for n, (x, role, text) in enumerate(left))
                elif lines := [line(role, text) for _, role, text in left]:
                    yield {"key": k, "part": part, "blob": b"\n".join(lines)}
                for _ in rows:  # the rest of a piece that ends in deleted turns
                    pass

        return _batches(out(), key, schema)

    return run


def _hashed(key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for k, pieces in groupby(_rows(batches), lambda r: r["key"]):
                h = hashlib.sha256()
                for n, p in enumerate(pieces):
                    h.update(b"\n" * (n > 0) + p["blob"])
                yield {"key": k, "digest": h.hexdigest()}

        return _batches(out(), key, "digest string")

    return run


def fault(text: Column) -> Column:
    """FINE, CUT_OFF or BLANK, by a text's last character that isn't white space."""
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(CUT_OFF)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, turns: bool = False) -> DataFrame:
    """Repairs each conversation of ``rows``.

    A row each: ``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` (of the lines ``role:text``), or
    with ``turns`` a row for each turn left: ``key, position, edit, role, text``.  gone: rows of which only the conversation
    counts; one that has no other rows has counts of 0, an empty audit and the empty text's digest.

    A null key is a conversation; null roles and texts are one space; null turns come first and count for no gap.  Turns of equal
    number are taken by role, then text, so equal rows lie side by side and all but the first are repeated.  Of repairs of equal cost
    the one whose audit is least by code points is taken.  Texts of any length are read whole; an empty table gives no rows; other columns are not read.

    The result row of a conversation holds its audit, a letter for each turn, and the digest of a conversation that fills
    many partitions is one SHA-256 over their lines in order, which no split can speed up: its pieces go through one task as one row each.
    """
    plain = rows.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone")
    )
    plain = plain.withColumn("fault", F.when(F.col("gone"), GONE).otherwise(fault(F.col("text"))).cast("int")).drop("gone")
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text", "fault")]
    sorted_ = plain.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    kind = rows.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    result = TURN if turns else SUMMARY
    schema = ", ".join(dict.fromkeys(f"{result}, {_EDGE}, role string, text string".split(", ")))
    both = cut(sorted_.mapInArrow(_first_pass(turns, arrow, schema), f"key {kind}, {schema}"))
    done = both.filter("part is null").select("key", *_names(result))
    # pieces of conversations at the borders of partitions
    edge = both.filter("part is not null").select("key", "part", "seq", "turn", "role", "text", "fault")
    first = edge.filter(~F.col("fault").isin(BLANK, GONE)).groupBy("key", "role", F.sha2("text", 256)).agg(F.min(F.struct("part", "seq")).alias("at"))
    edge = edge.join(first.select("at.part", "at.seq", F.lit(True).alias("is_first")), ["part", "seq"], "left")
    repeated = F.col("is_first").isNull() & ~F.col("fault").isin(BLANK, GONE)
    edge = cut(edge.withColumn("fault", F.when(repeated, REPEATED).otherwise(F.col("fault"))).drop("is_first"))
    by_piece = lambda df: df.repartition("key", "part").sortWithinPartitions("key", "part", "seq")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "part")
    maps = by_piece(edge.select("key", "part", "seq", "turn", "role", "fault")).mapInArrow(_pieces(arrow), f"key {kind}, part int, counts array<string>, maps array<string>")
    schema = ", ".join(dict.fromkeys(f"{SUMMARY}, part int, edits string, done long, headed boolean".split(", ")))
    folded = cut(by_key(maps).mapInArrow(_folded(arrow, schema), f"key {kind}, {schema}"))
    orders = folded.filter("part is not null").select("key", "part", F.lit(-1).cast("long").alias("seq"), "edits", "done", "headed")
    pieces = by_piece(orders.unionByName(edge.drop("turn"), allowMissingColumns=True))
    schema = TURN if turns else "part int, blob binary"
    left = pieces.mapInArrow(_edited(turns, arrow, schema), f"key {kind}, {schema}")
    if turns:
        return done.unionByName(left).withColumnRenamed("key", key)
    digests = by_key(left).mapInArrow(_hashed(arrow), f"key {kind}, digest string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    across = join_same(folded.filter("part is null").select("key", *_names(SUMMARY)), digests, ["key"], "left")
    across = across.withColumn("repaired_sha256", F.coalesce("digest", empty)).drop("digest")
    return done.unionByName(across).withColumnRenamed("key", key)
