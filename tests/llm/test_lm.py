import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from spanloom.llm.lm import BEGIN, BLOCK, CLASSES, CONTEXT, GROUPS, LENGTH, MEMBERS, NONE, ROWS, WIDTH, Attention, language_model_scores, text_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_base_equals_brute_force_and_model_beats_its_unigrams(spark):
    pick = random.Random(1)
    verse = "the cat sat on The mat and then it ran away from the dog".split()
    rows = [(k, " ".join((verse * 9)[pick.randrange(13) :][: pick.randint(0, 90)]) + pick.choice(["", " été", "\n\tX"])) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "zebra unknown words"), (1003, "a " * 30000), (1003, "twice"), (None, "x")]
    docs = spark.createDataFrame([(k, t, True) for k, t in rows], "doc_id long, text string, held_out boolean")
    got = language_model_scores(docs, MODEL, least_steps=300).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted(((k, held(k), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 3)) for k, t in rows), key=str)
    assert sorted(((*r[:5], round(r.base_score, 3)) for r in got), key=str) == want
    ids, counts = text_ids(MODEL, pa.array([t for k, t in rows if not held(k)]))
    share = np.log10((np.bincount(ids, minlength=32000) + 1) / (len(ids) + 32000))
    test = [(r.doc_id, r.score) for r in got if r.held_out and r.doc_id < 1000]
    texts = dict(rows)
    unigram = sum(share[text_ids(MODEL, pa.array([texts[k]]))[0]].sum() for k, _ in test)
    assert 0 > sum(s for _, s in test) > 0.8 * unigram
    assert language_model_scores(docs.limit(0), MODEL).count() == 0


def test_each_token_is_scored_once_and_chances_add_up():
    r = np.random.default_rng(1)
    layer = Attention.start(r.integers(0, 1000, 5000))
    for w in layer.w.values():
        w += r.normal(0, 0.2, w.shape).astype(np.float32) * (w > -1e8)
    counts = np.array([1, 5, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
    ids = r.integers(0, 5000, counts.sum())
    x, y, text = layer.blocks(ids, counts)
    assert (y >= 0).sum() == counts.sum() and x.shape[1] == LENGTH and (x[:, :CONTEXT][text == 0] == NONE).all()
    # a later token never changes what is said about an earlier one
    at = int((np.cumsum(counts) - counts)[4])
    other = ids.copy()
    other[at + 40] = (other[at + 40] + 250) % 5000
    one, two = (layer.chances(*layer.blocks(v, counts)[:2])[text == 4].ravel() for v in (ids, other))
    assert np.allclose(one[:40], two[:40]) and not np.allclose(one[41:], two[41:])
    # over all ids the next-token chances of one context add up to 1, rare ones and those without embeddings of their own too
    x = np.repeat(layer.blocks(np.array([7, 9]), np.array([2]))[0], 5000, 0)
    y = np.full((5000, BLOCK), -1)
    y[:, 1] = np.arange(5000)
    assert abs(np.exp(layer.chances(x, y)[:, 1].astype(float)).sum() - 1) < 1e-4
    assert np.isclose(layer.score(ids, counts).sum(), layer.chances(*layer.blocks(ids, counts)[:2]).sum() / np.log(10), rtol=1e-5)


def test_scores_equal_a_plain_model():
    """The layer written out token by token."""
    r = np.random.default_rng(3)
    layer = Attention.start(r.integers(0, 100, 300))
    w = {k: v.astype(float) for k, v in layer.w.items()}
    counts = np.array([3, BLOCK, 2 * BLOCK + 3])
    ids = r.integers(0, 300, counts.sum())
    pairs = np.bincount(layer.pairs(*layer.blocks(ids, counts)[:2]), minlength=ROWS * CLASSES + GROUPS * CLASSES * MEMBERS)
    layer.with_pairs(pairs)
    want, at = [], 0
    for n in counts:
        text, total = ids[at : at + n], 0.0
        rows = [BEGIN, *layer.row[text]]
        for i, t in enumerate(text):
            block = i // BLOCK * BLOCK
            keys = list(range(block - CONTEXT, i + 1))
            seen = [rows[j] if j >= 0 else NONE for j in keys]
            q = w["qo"][rows[i]][:WIDTH]
            a = np.array([np.exp(q @ w["kv"][x][:WIDTH] + w["far"][i - j]) for x, j in zip(seen, keys)])
            h = np.maximum((a @ w["kv"][seen][:, WIDTH:]) / a.sum() @ w["mix"] + w["qo"][rows[i]][WIDTH:], 0)
            z, c = h @ w["out"] + layer.after[rows[i]], layer.of[t]
            u = h @ w["unit"][c] + layer.within[layer.group[rows[i]] * CLASSES + c]
            total += z[c] - np.log(np.exp(z).sum()) + u[layer.place[t]] - np.log(np.exp(u).sum()) + layer.share[t]
        want.append(total / np.log(10))
        at += n
    assert np.allclose(layer.score(ids, counts), want, rtol=1e-4)
    # what stands after an id is counted: of the pairs there are, as often as they are
    row, of = [BEGIN, *layer.row[ids[:3]]], layer.of[ids[:3]]
    assert all(pairs[row[k] * CLASSES + of[k]] >= 1 for k in range(3)) and pairs[: ROWS * CLASSES].sum() == counts.sum() == pairs[ROWS * CLASSES :].sum()
    alone = layer.after[BEGIN].astype(float)
    share = layer.counted.sum(1) / layer.counted.sum()
    assert np.allclose(np.exp(alone), (pairs[BEGIN * CLASSES :][:CLASSES] + 20 * share) / (3 + 20), rtol=1e-3)


def test_gradients():
    r = np.random.default_rng(2)
    layer = Attention.start(r.integers(1, 1000, 400))
    x, y, _ = layer.blocks(r.integers(0, 400, 200), np.array([60, 140]))
    n = (y >= 0).sum()
    before = {k: v.copy() for k, v in layer.w.items()}
    layer.squares = {k: np.ones_like(v) for k, v in layer.w.items()}
    slopes = {}
    layer._move = lambda name, g, rate, at=None: slopes.setdefault(name, np.zeros(before[name].shape)).__setitem__(slice(None) if at is None else at, g)
    layer._step(x, y, 0.0)
    for name, g in slopes.items():
        flat = np.argsort(-np.abs(g).ravel())[:3]
        for place in flat:
            layer.w[name] = before[name].astype(np.float64)
            ends = []
            for e in (1e-3, -1e-3):
                layer.w[name].ravel()[place] = before[name].ravel()[place] + e
                ends.append(-layer.chances(x, y).astype(float).sum() / n)
            layer.w[name] = before[name]
            assert abs((ends[0] - ends[1]) / 2e-3 - g.ravel()[place]) < 0.03 * abs(g.ravel()[place]) + 2e-4, name


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    """On documents of four languages the model's chances of whole held-out texts exceed those of the add-one word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_model_scores(docs, MODEL).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_ids_are_those_of_each_word_in_order():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", " \n\t", "Ab ab AB x", "x\x0bİé \U0001F600 ab", "w " * 3000]
    want = [[i for w in "".join(c.lower() if c.isascii() else c for c in t or "").split() for i in sp.encode(w)] + [sp.eos_id()] for t in texts]
    ids, counts = text_ids(MODEL, pa.array(texts, pa.string()))
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    ids, counts = text_ids(MODEL, pa.array([], pa.string()))
    assert not len(ids) and not len(counts)


def test_scores_do_not_depend_on_partitions(spark):
    """Also where a unit is cut and units are many; repeated rows and ids, null keys and texts among them."""
    from pyspark.sql import functions as F

    from spanloom.llm import lm

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1, "one more text of this key"), (None, "a null key"), (7, None), (8, "x " * 9000)], "doc_id long, text string")
    docs = docs.unionByName(more).unionByName(docs.filter("doc_id < 9")).withColumn("score", F.lit("clash"))
    before, results = lm.UNIT, []
    lm.UNIT = 1 << 17
    try:
        for n in (1, 7):
            got = language_model_scores(docs.repartition(n, F.xxhash64("text", F.lit(n))), MODEL, least_steps=20)
            results.append(sorted(map(tuple, got.select("doc_id", "held_out", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)).collect()), key=str))
    finally:
        lm.UNIT = before
    assert results[0] == results[1] and len(results[0]) == docs.count() and len({r[5] for r in results[0]}) > 150


def test_held_out_texts_of_little_input_are_likelier_than_by_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model_scores(docs, MODEL).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_every_training_text_is_trained_on(spark):
    """Texts of one kind that lie in one unit of many: their words are learned."""
    pick = random.Random(4)
    verse = "the cat sat on the mat and then it ran away from the dog".split()
    rows = [(k, " ".join((verse * 9)[pick.randrange(13) :][:80])) for k in range(400)] + [(10_000 + k, "dog " * 80) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in language_model_scores(docs, MODEL, least_steps=400).collect()}
    held = [r for r in got.values() if r.held_out]
    ids, counts = text_ids(MODEL, pa.array([t for k, t in rows if not got[k].held_out]))
    share = np.log10((np.bincount(ids, minlength=32000) + 1) / (len(ids) + 32000))
    texts = dict(rows)
    for kind in (lambda r: r.doc_id < 10_000, lambda r: r.doc_id >= 10_000):
        some = [r for r in held if kind(r)]
        assert some and sum(r.score for r in some) > 0.5 * sum(share[text_ids(MODEL, pa.array([texts[r.doc_id]]))[0]].sum() for r in some)


def test_words_met_again_stay_known_when_the_store_is_full(monkeypatch):
    """Pieces that share some words and fill the store with words of their own: the shared ones are encoded once, and ids are right."""
    from spanloom.llm import lm

    monkeypatch.setattr(lm, "KEEP", 60)
    tokens = lm.Subwords(MODEL)
    monkeypatch.setitem(lm._made, MODEL, tokens)
    met, encode = Counter(), tokens.sp.encode
    monkeypatch.setattr(tokens.sp, "encode", lambda words, **more: met.update(words) or encode(words, **more))
    shared = "the cat sat on mats".split()
    for k in range(12):
        words = [*shared, *(f"fresh{k}x{i}" for i in range(40)), *shared]
        ids, counts = text_ids(MODEL, pa.array([" ".join(words)]))
        assert ids.tolist() == [i for w in words for i in encode(w)] + [tokens.end] and counts.tolist() == [len(ids)]
    assert all(met[w] == 1 for w in shared)


def test_hashes_are_put_in_order_as_by_a_stable_argsort():
    """Also those that differ in the last bits only, which hold the places meanwhile."""
    from spanloom.llm.lm import in_order, numbered

    r = np.random.default_rng(5)
    far = r.integers(0, 2**64, 400, np.uint64)[r.integers(0, 400, 3000)]
    for h in (far, far ^ r.integers(0, 4, 3000).astype(np.uint64), far[:1], far[:0]):
        assert in_order(h).tolist() == np.argsort(h, kind="stable").tolist()
        _, at, of = np.unique(h, return_index=True, return_inverse=True)
        got = numbered(h)
        assert got[0].tolist() == of.tolist() and got[1].tolist() == at.tolist()


def test_pairs_and_chances_do_not_depend_on_how_windows_are_made_and_cut(monkeypatch):
    from spanloom.llm import lm

    r = np.random.default_rng(6)
    layer = Attention.start(r.integers(0, 1000, 700))
    counts = np.array([1, BLOCK - 1, BLOCK, 2 * BLOCK, 5, 3 * BLOCK + 1, BLOCK])
    ids = r.integers(0, 700, counts.sum()).astype(np.uint16)
    x, y, _ = layer.blocks(ids, counts)
    pairs = layer.pairs_of(ids, counts)
    assert np.array_equal(pairs, layer.pairs(x, y))
    layer.with_pairs(np.bincount(pairs, minlength=ROWS * CLASSES + GROUPS * CLASSES * MEMBERS))
    rows, at = [], 0
    for n in counts:
        rows += [BEGIN, *layer.row[ids[at : at + n - 1]]]
        at += n
    assert x[:, CONTEXT:][y >= 0].tolist() == rows and y[y >= 0].tolist() == ids.tolist()
    whole = layer.chances(x, y)
    monkeypatch.setattr(lm, "FEW", 2)
    assert np.allclose(whole, layer.chances(x, y), rtol=1e-5) and (whole[y < 0] == 0).all() and (whole[y >= 0] < 0).all()


def test_only_ids_of_units_are_scored_in_python_and_rounds_read_their_units(spark, monkeypatch):
    """What is finished, and in a round the units of others, isn't sent to Python."""
    from spanloom.llm import lm

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "UNIT", 1 << 15)
    seen, added = [], lm._added
    monkeypatch.setattr(lm, "_added", lambda units, *more: seen.append({r.unit for r in units.select("unit").collect()}) or added(units, *more))
    got = language_model_scores(docs, MODEL, least_steps=20)
    plan = got._jdf.queryExecution().toString()
    assert "Union" in plan and got.count() == docs.count()
    counts, pairs, *rounds = seen
    assert counts == pairs == set().union(*rounds) and len(rounds) == 4 and sum(map(len, rounds)) == len(counts)
    assert all(max(a) < min(b) for a, b in zip(rounds, rounds[1:]))
