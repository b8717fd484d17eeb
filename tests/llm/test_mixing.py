import heapq
import random

from pyspark.sql import functions as F

from spanloom.llm.mixing import mix, sainte_lague


def test_seats_equal_highest_quotients(spark):
    pick = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        weights = [pick.choice([0.0, 1.0, 2.0, pick.random() * 100, 1e6]) for _ in range(pick.randint(1, 30))]
        seats = pick.choice([0, 1, 7, 100, 5000])
        got = [0] * len(weights)
        heap = [(-w, i) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
        want |= {(g, i): n for i, n in enumerate(got)}
        rows += [(g, i, w, seats) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, i int, w double, q long")
    assert {(r.g, r.i): r.n for r in sainte_lague(df, ["g"], ["i"], "w", "q", "n").collect()} == want


def test_mix(spark):
    pick = random.Random(4)
    rows = []
    for k in range(3000):
        s = pick.choice(["a"] * 10 + ["b", "c", "Z", "é", None])
        rows.append((k, pick.choice([None, "", "x"] + [" ".join("w" * pick.randint(1, 200))] * 20), s))
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y z", "b")]
    docs = spark.createDataFrame([(k, t, s, 1) for k, t, s in rows], "doc_id long, text string, source string, size int")
    got = mix(docs, shard_docs=100).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in docs.select("source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"), "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + (r.n if r.text else 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, capped = {}, set()
    while True:  # share, cap, share anew
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        want = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    by_id = {k: s for k, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 64 * (2 + len(rows) // 100)
    assert sorted(map(str, mix(docs.repartition(7), shard_docs=100).collect())) == sorted(map(str, got))
    assert mix(docs.limit(0)).count() == 0 and mix(docs.filter("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_rows_without_a_key_are_dealt_over_shards(spark):
    """20,000 of them, equal ones too, take about the same share as rows with keys, and reruns agree."""
    rows = [(None if k < 20_000 else k, "w " * (1 + k % 3), "a" if k % 4 else "b") for k in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    one, two = (sorted(map(tuple, mix(d).collect()), key=str) for d in (docs, docs.repartition(2)))
    assert one == two
    for source, least in (("a", 0.9), ("b", 0.9)):
        size = sum(len(t.split()) for k, t, s in rows if s == source)
        taken = [(r.doc_id, r.taken, r.target) for r in mix(docs.filter(docs.source == source)).collect()]
        assert least * taken[0][2] <= sum(x[1] for x in taken) <= taken[0][2] / least and size
        share = [sum(x[1] for x in taken if (x[0] is None) == none) / sum(len(t.split()) for k, t, s in rows if s == source and (k is None) == none) for none in (True, False)]
        assert abs(share[0] - share[1]) < 0.25


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x", "a"), (3, "y z", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix(docs).collect()}
    assert got[1].size == 300_000 and abs(sum(r.taken for r in got.values() if r.doc_id < 3) - got[1].target) < 200 and got[1].taken <= 600_000
