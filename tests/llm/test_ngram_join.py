import random
import re

from spanloom.llm.ngram_join import ngram_jaccard_join


def brute(rows, n=4, percent=85):
    sets = {}
    for number, (_, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[number] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    keys = {}
    for k in sets:
        keys.setdefault(root(k), []).append(rows[k][0])
    return sorted(((rows[k][0], len(v), min((x for x in keys[root(k)] if x is not None), default=None)) for k, v in sets.items()), key=str)


def corpus(seed, size=160):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "OF"]
    passage = pick.choices(vocabulary, k=30)
    rows, key = [], 0
    for g in range(size // 8):
        base = pick.choices(vocabulary, k=pick.choice([1, 2, 3, 4, 6, 12, 40, 90]))
        if g % 3 == 0:
            base = passage + base
        for c in range(8):
            text = list(base)
            for _ in range(c // 2):  # chains of edits: links need not be direct
                text[pick.randrange(len(text))] = pick.choice(vocabulary)
            if c > 4 and rows:
                text = rows[-1][1].split() if rows[-1][1].split() else text
                text[pick.randrange(len(text))] = pick.choice(vocabulary)
            rows.append((key := key + pick.randint(1, 3), " ".join(text)))
    pick.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=str) == brute(rows)


def test_a_large_near_group_and_other_cases(spark):
    pick = random.Random(3)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(pick.choice([0, 1, 2, 4, 6])):
            text[pick.randrange(120)] = f"y{pick.randrange(1000)}"
        rows.append((k + 10, " ".join(text)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE Two"), (6, "one two three"), (7, "a " * 30000), (8, "a a a a"), (9, "a a a a a")]
    rows += [(4, "one two"), (None, "one two"), (None, None), (None, "only rows without a key"), (None, "Only rows without a key"), (4, "other words of a known key")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int")
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=str) == brute(rows)
    assert ngram_jaccard_join(docs.limit(0)).count() == 0


def test_one_passage_in_every_text(spark):
    pick = random.Random(4)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for k in range(300):
        own = rows[-1][1].split()[12:] if k % 10 == 9 else [f"v{pick.randrange(500)}" for _ in range(pick.choice([5, 20, 60]))]
        if k % 10 == 9:
            own[0] = "changed"
        rows.append((k, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=str) == brute(rows)


def test_an_ngram_leaves_a_piece_once():
    import pyarrow as pa

    from spanloom.llm import ngram_join

    texts = [f"the same four words x{i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], ["doc", "text"])
    grams, counts = ngram_join._sets(batch, 4)
    assert len(grams) == 2000 and counts.sum() == 2000
    import pyspark

    real, pyspark.TaskContext = pyspark.TaskContext, type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)})())})
    try:
        rows = [r for b in ngram_join._scatter(4, 7)(iter([batch])) for r in b.to_pylist()]
    finally:
        pyspark.TaskContext = real
    sent = [r for r in rows if r["lo"] is not None]
    assert sum(len(r["lo"]) // 4 for r in sent) == 1001
    assert sorted({r["bucket"] for r in sent}) == list(range(7))
