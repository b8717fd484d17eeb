import random
import re

import numpy as np

from spanloom.llm.quality_rules import RATIOS, cover, keep_good, quality_rules, with_statistics


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(threes) if threes.count(x) > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(hit), failed


def test_statistics_equal_brute_force(spark):
    pick = random.Random(4)
    parts = ["a", "b", "the", "é", "漢字", "x#", "*|", "\n", " \n", "\t", "  ", "\x0b", "A!!", " ", "line of words\n"]
    texts = [pick.choice([" ", ""]).join(pick.choices(parts, k=pick.choice([0, 1, 2, 3, 60, 120]))) for _ in range(300)]
    texts += [None, "", " ", "a a a a", "a b " * 400, " ".join(map(str, range(3000))), " ".join(map(str, range(60)))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules(docs, labels).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), *r[1:7], r.kept) for r in got) == sorted(((k is None, k or 0), *(p := plain(t)), not p[5]) for k, t, _ in rows)
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_covering_finds_planted_rules():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    bad = (x[:, 0] > 0.9) | ((x[:, 1] <= 0.3) & (x[:, 2] > 0.8))
    rules = cover(x, bad, r.random(3000) < 0.66, ["a", "b", "c"])
    said = np.zeros(3000, bool)
    for rule in rules:
        m = np.ones(3000, bool)
        for name, above, cut in rule:
            m &= (x[:, "abc".index(name)] > cut) == above
        said |= m
    assert (said & bad).sum() > 0.85 * bad.sum() and (said & ~bad).sum() < 0.03 * (~bad).sum()
    assert cover(x[:0], bad[:0], bad[:0], ["a", "b", "c"]) == [] and cover(x, np.zeros(3000, bool), bad, ["a", "b", "c"]) == []


def test_learned_list_on_labelled_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    kept = quality_rules(docs, labels)
    rows = kept.join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.02 * (n.get((1, False), 0) + n.get((1, True), 0))
    good = keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == kept.filter("kept").count()
    assert with_statistics(docs.limit(1)).select(*RATIOS).count() == 1
