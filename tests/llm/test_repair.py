import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import queries
from spanloom.llm.repair import BLANK, CUT_OFF, FINE, REPEATED, Parser, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(turns):
    """Least (cost, audit) by a plain table over (turn, state), with whole audits."""

    def inserts(row):
        for _ in range(4):
            for state, (cost, letters) in list(row.items()):
                for x in "ua":
                    if (state, x) in NEXT:
                        to, new = NEXT[state, x], (cost + 5, letters + "I")
                        row[to] = min(row.get(to, new), new)
        return row

    row = {0: (0, "")}
    for initial, fault in turns:
        new = {}
        for state, (cost, letters) in inserts(row).items():
            offers = [(state, cost + 2, "D")]
            if fault in (FINE, CUT_OFF):
                more = cost + 5 * (fault == CUT_OFF)
                offers += [(NEXT[state, initial], more, "K")] if (state, initial) in NEXT else []
                offers += [(NEXT[state, x], more + 1, "R") for x in "ua" if (state, x) in NEXT]
            for to, c, x in offers:
                new[to] = min(new.get(to, (c, letters + x)), (c, letters + x))
        row = new
    return min(v for s, v in inserts(row).items() if s in (0, 3))


def test_repairs_are_cheapest_of_all_edits_of_short_conversations():
    """Against every sequence of edits with up to four inserts."""
    parser = Parser()
    for n in (0, 1, 2):
        for turns in itertools.product(itertools.product("suax", (FINE, CUT_OFF, BLANK)), repeat=n):
            best = None
            for size in range(n, n + 5):
                for letters in itertools.product("DIKR", repeat=size):
                    if sum(x != "I" for x in letters) != n:
                        continue
                    left = iter(turns)
                    states, cost = {0}, 0
                    for x in letters:
                        i, f = ("", FINE) if x == "I" else next(left)
                        cost += {"I": 5, "D": 2, "R": 1, "K": 0}[x] + 5 * (x in "KR" and f == CUT_OFF)
                        if x == "D":
                            continue
                        if x in "KR" and f == BLANK:
                            states = set()
                        states = {NEXT[s, c] for s in states for c in (i if x == "K" else "ua") if (s, c) in NEXT}
                    if states & {0, 3} and (best is None or (cost, "".join(letters)) < best):
                        best = cost, "".join(letters)
            assert parser.repair(list(turns)) == best, turns


def test_repairs_equal_a_plain_table():
    pick, parser = random.Random(3), Parser()
    for k in range(3000):
        weights = [(1, 4, 4, 1), (0, 1, 1, 0), (3, 1, 1, 3), (1, 9, 1, 0)][k % 4]
        turns = [(pick.choices("suax", weights)[0], pick.choices((FINE, CUT_OFF, BLANK, REPEATED), (8, 1 + k % 5, 1, 1))[0]) for _ in range(pick.randint(0, 40))]
        assert parser.repair(turns) == cheapest(turns), turns
    assert len(parser.sets) < 20_000  # of 60,000 turns


def brute(rows):
    """Each conversation's row in plain Python, from (conv_id, turn, role, text, gone)."""
    out = []
    for key in {r[0] for r in rows}:
        mine = [(t, a or " " if a is None else a, " " if x is None else x) for k, t, a, x, gone in rows if k == key and not gone]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in mine:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = BLANK if not end else REPEATED if (role, text) in seen else FINE if end in ".!?" else CUT_OFF
            seen.add((role, text))
            kinds.append((role[:1], fault))
        cost, letters = cheapest(kinds)
        left, place, odd = [], iter(mine), sum(x != "D" for x in letters) % 2
        for x in letters:
            role, text = ("", "") if x == "I" else next(place)[1:]
            if x != "D":
                left.append((x, role if x == "K" else ("user", "assistant")[(len(left) - odd) % 2], text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(kinds, kinds[1:]))
        n = [sum(f == want for _, f in kinds) for want in (BLANK, REPEATED, CUT_OFF)]
        out.append(((key, gaps, *n, illegal, cost, letters, hashlib.sha256("\n".join(f"{a}:{t}" for _, a, t in left).encode()).hexdigest()), [(key, k, *x) for k, x in enumerate(left)]))
    return sorted((x for x, _ in out), key=str), sorted((y for _, ys in out for y in ys), key=str)


def some_rows(seed, sizes):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "what", "", " \n", None, "Why?", "end. \t", "漢字。", "cut, "]
    rows = []
    for key, size in sizes.items():
        for t in range(size):
            text = pick.choice(texts) if pick.random() < 0.4 else f"turn {t} of it."
            rows.append((key, None if pick.random() < 0.02 else t + 3 * (t > 4), pick.choice(["user", "assistant"][t % 2 :] + ["system", "tool", "", None][: pick.randint(0, 4)]), text, pick.random() < 0.05))
    rows += [r for r in rows if pick.random() < 0.1]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("places", ("4", "23"))
def test_conversations_of_any_size_in_any_number_of_partitions(spark, places):
    """One conversation holds half of all turns and fills many partitions; others are small, empty, or without a key."""
    rows = some_rows(7, {1: 600, 2: 1, 3: 40, None: 30, **{k: 8 for k in range(10, 60)}}) + [(99, 1, "user", "gone.", True), (98, None, None, None, False), (97, 5, "user", "x" * 300_000, False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").withColumn("audit", F.lit("clash")).repartition(3)
    want, left = brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", places)
    try:
        got = repair(df, gone=F.col("gone"))
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.select(names).collect()), key=str) == want
        turns = repair(df, gone=F.col("gone"), turns=True)
        assert sorted(map(tuple, turns.select("conv_id", "position", "edit", "role", "text").collect()), key=str) == left
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair(df).count() == 0


def test_damage_is_that_of_the_contract(spark):
    import zlib

    rows = [(k, t, "assistant", f"a.b!c? {k}") for k in (*range(40), None) for t in (0, 1, None)]
    got = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for k, t, role, text in rows:
        h = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        new = (k, t, "user" if h == 4 else role, "" if h in (0, 1) else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text, h == 0)
        want += [new] * (2 if h == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
