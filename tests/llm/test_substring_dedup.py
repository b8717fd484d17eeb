import hashlib
import random
import re
from collections import Counter

import pytest

from spanloom.llm.substring_dedup import substring_dedup


def brute(rows, w=35):
    words = {n: re.findall(r"[^\x20\x09-\x0D]+", t or "") for n, (_, t) in enumerate(rows)}
    count = Counter(tuple(x[i : i + w]) for x in words.values() for i in range(len(x) - w + 1))
    out = []
    for k, x in words.items():
        gone = {j for i in range(len(x) - w + 1) if count[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        kept = " ".join(y for j, y in enumerate(x) if j not in gone)
        out.append((rows[k][0], len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    pick = random.Random(seed)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (33, 34, 35, 36, 52, 70, 120)]
    rows = []
    for k in range(120):
        text = fresh(pick.choice([0, 3, 20, 60]))
        for _ in range(pick.choice([0, 0, 1, 2, 3])):
            p = pick.choice(passages)
            a = pick.choice([0, 0, 1, 5])
            text += p[a:] + fresh(pick.choice([0, 1, 18, 40]))
        rows.append((k, pick.choice([" ", "\n", " \t"]).join(text)))
    rows += [(500, None), (501, ""), (502, "a " * 5000), (503, "A " * 36), (504, rows[5][1]), (505, "é " * 35), (506, " ".join(map(str, range(3000)))), (5, rows[5][1]), (None, rows[7][1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_words int")
    got = substring_dedup(docs, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup(docs.limit(0)).count() == 0


def test_one_passage_in_every_text_and_many_times_in_one(spark):
    pick = random.Random(5)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    passage = fresh(72)  # four whole blocks: at the start of texts they are the same ones everywhere
    rows = [(k, " ".join(passage + fresh(pick.choice([0, 10, 90])))) for k in range(200)]
    rows += [(900, " ".join((passage + fresh(1)) * 60)), (901, " ".join(fresh(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute(rows)


def test_texts_are_exchanged_once(spark, tmp_path):
    """Both joins read one exchange of the texts; a second one would take as much disk as the input."""
    pick = random.Random(8)
    fresh = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(k, " ".join(fresh(30) + passage * (k % 3 == 0))) for k in range(40)]
    for name, more in (("keys", []), ("numbers", [(None, "no key"), (3, "again")])):
        spark.createDataFrame(rows + more, "doc_id long, text string").write.parquet(str(tmp_path / name))
        out = substring_dedup(spark.read.parquet(str(tmp_path / name)))
        kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert sorted(map(tuple, out.collect()), key=str) == brute(rows + more)
            plan = out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        assert "ReusedExchange" in plan, plan
