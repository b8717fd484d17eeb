import random

import numpy as np

from spanloom.llm import decontaminate
from spanloom.llm.decontaminate import align, contaminated, matched_whole, seed_length, without_contaminated


def plain(item, text):
    best, h = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


def test_alignment_equals_the_recurrence():
    pick = random.Random(1)
    for _ in range(200):
        item, text = ([pick.randrange(6) for _ in range(pick.randint(1, 15))] for _ in range(2))
        assert align(np.array(item), np.array(text)) == plain(item, text)


def test_whole_n_grams_of_any_alignment():
    """No edited copy of a score has fewer n-grams whole than is said: every way to edit short items, and random ways."""
    assert [seed_length(m, 0.6) for m in (1, 5, 6, 40)] == [1, 1, 2, 2] and seed_length(40, 0.95) == 5 and matched_whole(40, 2, 0.6) == 7
    pick = random.Random(6)
    for _ in range(3000):
        m, score = pick.randint(1, 14), pick.choice((0.6, 0.7, 0.9))
        text = []
        for i in range(m):  # item words i in order; a new word is -1
            if pick.random() < 0.15:
                text.append(-1)  # put for it
            else:
                text += [-1] * (pick.random() < 0.3)
                text.append(i)
        if plain(list(range(m)), text) >= score:
            for n in (1, 2, 3):
                whole = sum(text[j : j + n] == list(range(text[j], text[j] + n)) for j in range(len(text) - n + 1) if text[j] >= 0)
                assert whole >= matched_whole(m, n, score), (m, score, n, text)


def test_more_hashes_than_are_sent(spark, monkeypatch):
    """With a bitmap in place of the hashes the same copies are found."""
    pick = random.Random(7)
    fresh = lambda n: [f"w{pick.randrange(400)}" for _ in range(n)]
    items = [fresh(pick.randint(3, 30)) for _ in range(60)]
    texts = [[*fresh(20), *(w for w in pick.choice(items) if pick.random() < 0.9), *fresh(20)] for _ in range(80)]
    docs = spark.createDataFrame([(k % 50, " ".join(t)) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = sorted(map(tuple, contaminated(docs, bench).collect()))
    full = sorted((k % 50, i, s) for k, t in enumerate(texts) for i, w in enumerate(items) if (s := align(np.array(w), np.array(t))) >= 0.6)
    assert want == sorted(full * 2)
    monkeypatch.setattr(decontaminate, "SENT", 10)
    monkeypatch.setattr(decontaminate, "BITS", 14)
    assert sorted(map(tuple, contaminated(docs, bench).collect())) == want


def test_copies_are_found_and_clean_texts_left(spark):
    pick = random.Random(2)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    items = [(i, fresh(pick.randint(12, 40))) for i in range(12)] + [(20, ["one", "two"]), (21, ["a", "b", "c"])]
    rows, want = [], set()
    for k in range(200):
        text = fresh(60)
        if k % 3 == 0:  # whole, edited or, in many documents, the same item
            i, words = items[0] if k % 2 else items[pick.randrange(12)]
            copy = list(words)
            for _ in range(len(copy) // 9 if k % 4 else 0):
                j = pick.randrange(len(copy))
                copy[j : j + 1] = pick.choice([[], ["new"], [copy[j], "more"]])
            text[20:20] = copy
            want.add((k, i))
        rows.append((k, " ".join(text).upper() if k % 5 == 0 else " ".join(text), k))
    rows += [(500, None, 1), (501, "", 1), (502, "one two", 1), (503, "x a b c y", 1), (504, "W1 " * 20000, 1)]
    want.add((503, 21))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(0, " ".join(items[0][1])), (30, None), (31, "")], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, shortest=1).collect()} == want | {(502, 20)}
    left = without_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {k for k, _ in want}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_edits_up_to_the_limit_are_found_as_by_full_alignment(spark):
    pick = random.Random(3)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    common = [f"c{k}" for k in range(40)]
    items = [[pick.choice(common) if pick.random() < 0.5 else w for w in fresh(pick.choice([3, 4, 5, 8, 16, 16, 30]))] for _ in range(150)]
    texts = []
    for words in items:
        copy = []
        for i, w in enumerate(words):  # substitutions, insertions or both, up to and beyond what the score allows
            copy += [f"x{pick.randrange(10**6)}"] if len(texts) % 3 != 1 and pick.random() < 0.2 else [w]
            copy += fresh(1) if len(texts) % 3 and i % 2 and pick.random() < 0.8 else []
        texts.append([*pick.choices(common, k=30), *copy, *pick.choices(common, k=30)])
    score = [[align(np.array(i), np.array(t)) for i in items] for t in texts]
    want = {(k, i): s for k, row in enumerate(score) for i, s in enumerate(row) if s >= 0.6}
    assert len(want) > 100 and sum(s < 0.7 for s in want.values()) > 20
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in contaminated(docs, bench).collect()} == want
    assert {r.doc_id for r in without_contaminated(docs, bench).collect()} == set(range(len(texts))) - {k for k, _ in want}
