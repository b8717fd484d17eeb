import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import crf, pii, secrets
from spanloom.llm.spans import apart

PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", ".", "@", "-", "+", "(", ")", "AKIA", "0123456789abcdef", "AB12", "deadbeef", "x", "é", "7", "42", "255", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-0000", "a.b@c.d", "\n", "ſecret", "٣"]


def texts(seed, n=1500):
    pick = random.Random(seed)
    return ["".join(pick.choices(PIECES, k=pick.randint(0, 14))) for _ in range(n)]


def plain_secrets(t):
    names = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [("assign", *m.span()) for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@pytest.mark.parametrize("module, plain, op", [(secrets, plain_secrets, secrets.secret_scan), (pii, plain_pii, pii.personal_data)])
def test_base_spans_equal_plain_patterns(spark, module, plain, op):
    rows = [(i, t) for i, t in enumerate(texts(5))] + [(None, None), (-1, ""), (-2, "1" * 200_000 + "a" * 200_000 + "@"), (-3, "1" * 3_000), (-4, "f" * 50_000), (-5, "ABCDEFGHIJAKIA" + "Z" * 20)]
    rows += [rows[7]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, spans int")
    got = op(docs, spark.createDataFrame(module.labelled_rows(), "text string, start int, end int")).collect()
    want = sorted((k is None, k or 0, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in plain(t or "")).encode()).hexdigest(), *(sum(x[0] == kind for x in plain(t or "")) for kind in module.KINDS)) for k, t in rows if len(t or "") < 150_000)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, *(r[f"n_{k}"] for k in module.KINDS)) for r in got if r.doc_id != -2) == want
    for r in got:  # base spans stay among all spans, and what the model adds meets none of them
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = [x for x in spans if x[0] != "model"]
        assert hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() == r.base_sha256
        for m in (x for x in spans if x[0] == "model"):
            assert all(int(m[2]) <= int(x[1]) or int(m[1]) >= int(x[2]) for x in base)
    assert op(docs.limit(0), spark.createDataFrame(module.labelled_rows(20), "text string, start int, end int")).count() == 0


@pytest.fixture(scope="module", params=[secrets, pii])
def trained(request):
    return request.param, crf.train(request.param.labelled_rows())


def test_held_out_accuracy_of_the_model(trained):
    module, model = trained
    held = module.labelled_rows(400, seed=99)
    found = crf.model_spans(model, [t for t, _, _ in held])
    hits = sum(any(a < e and b > s for a, b in f) for f, (_, s, e) in zip(found, held) if e > s)
    wrong = sum(bool(f) for f, (_, s, e) in zip(found, held) if e <= s)
    assert hits >= 0.9 * sum(e > s for _, s, e in held) and wrong <= 0.02 * len(held)


def test_added_spans_on_documents(trained):
    """Recall and precision of what the model adds, on real documents into some of which spans that the patterns miss are planted."""
    import pyarrow.parquet as pq

    module, model = trained
    pick = random.Random(3)
    docs = [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if x]
    planted = [r for r in module.labelled_rows(3000, seed=41) if r[2] > r[1] and len(r[0]) < 150 and not module.base_spans(r[0])][:300]
    where = dict(zip(pick.sample(range(len(docs)), len(planted)), planted))
    texts, hit, true, false = [], 0, 0, 0
    for k, t in enumerate(docs):
        at = pick.choice([0, *(i + 1 for i, c in enumerate(t) if c == " ")]) if k in where else 0
        texts.append((t[:at] + where[k][0] + " " + t[at:], at) if k in where else (t, 0))
    for k, found in enumerate(crf.model_spans(model, [t for t, _ in texts])):
        t, at = texts[k]
        found = apart(found, module.base_spans(t))
        s, e = (at + where[k][1], at + where[k][2]) if k in where else (0, 0)
        mine = [a < e and b > s for a, b in found]
        hit, true, false = hit + any(mine), true + sum(mine), false + len(mine) - sum(mine)
    assert hit >= 0.9 * len(planted) and true >= 0.9 * (true + false), (hit, len(planted), true, false)


def test_viterbi_is_the_best_path():
    import itertools

    model = crf.Crf()
    r = np.random.default_rng(1)
    model.weights, model.moves = r.normal(size=model.weights.shape), r.normal(size=(3, 3))
    model._forbid()
    seqs = [r.integers(0, crf.PLACES, (n, 3)) for n in (1, 3, 5, 2)]
    for seq, got in zip(seqs, model.decode(seqs)):
        e = [model.weights[f].sum(0) for f in seq]
        value = lambda p: model.start[p[0]] + sum(e[i][x] for i, x in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))
        assert got == list(max(itertools.product(range(3), repeat=len(seq)), key=value))
    # a long run in stretches, against the whole in one
    for n in (2, 16, 17, 40, 1300):
        e, t, begin, end = r.normal(size=(n, 3)), model.moves, r.normal(size=3), r.normal(size=3)
        best, back = begin + e[0], []
        for x in e[1:]:
            back.append((best[:, None] + t).argmax(0))
            best = (best[:, None] + t).max(0) + x
        path = [int((best + end).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert crf.best_path(e, begin, end, t).tolist() == path[::-1]


def test_masked(spark):
    docs = spark.createDataFrame([(1, "é mail a.b@c.de, +1 (555) 010-0000 end", "en"), (2, None, None), (3, "plain", "en"), (3, "plain", "en")], "doc_id long, text string, spans string")
    labelled = spark.createDataFrame(pii.labelled_rows(200), "text string, start int, end int")
    got = pii.masked(docs, labelled).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "é mail [EMAIL], [PHONE] end", "en"), (2, None, None), (3, "plain", "en"), (3, "plain", "en")]))
    assert pii.masked(docs.limit(0), labelled).count() == 0


def test_file_features_are_trained(trained):
    module, model = trained
    files = np.array([crf.file_of(t) for t, _, _ in module.labelled_rows()])
    used = [x for x, n in zip(*np.unique(files, return_counts=True)) if n > 9]
    assert len(used) > 8 and all(np.abs(model.weights[x]).max() > 1e-3 for x in used)
    # the sign of a file alone tells the label when nothing else does
    same = [("a b = c; d_e = {}; <f> " * 3 + "word", 69, 73), ("a b c d e f " * 6 + "word", 0, 0)] * 30
    toy = crf.train(same)
    file = [toy.weights[crf.file_of(t)].sum(0) for t, _, _ in same[:2]]
    assert file[0][crf.B] - file[0][crf.O] > file[1][crf.B] - file[1][crf.O] + 0.1


def test_all_words_are_decoded_as_one_sequence(trained):
    module, model = trained
    asked = [t for t, _, _ in module.labelled_rows(200, seed=5)] + ["", " ", "é  x", "word " * 500, *texts(8, 60)]
    for margin in (0.0, 1.0):
        tag = crf.Tagger(model, margin)
        data, offsets = crf.buffers(pa.array(asked))
        _, _, at, e, place, left = tag.emissions(data, offsets)
        got = tag.labels(e, place, left)
        model.weights[crf.PLACES] = [margin, 0, 0]  # the empty place says what the margin does
        for x, i, j in zip(crf.feature_places(asked), at, at[1:]):
            assert model.decode([np.column_stack([x, np.full(len(x), crf.PLACES)])])[0] == got[i:j].tolist() if len(x) else i == j
    model.weights[crf.PLACES] = 0
    # a text in which no word is surely outside is one long run
    long = "4 $x 5-6 Ab1 " * 3000
    whole = crf.Tagger(model)
    whole.most = 1e9
    assert whole.spans(pa.array([long, "x " + long])) == crf.Tagger(model).spans(pa.array([long, "x " + long]))


def test_secrets_and_names_without_digits_are_found():
    for module, cases in ((secrets, ["Bearer hQzKpWvRtYbNmLsXcDfGjHk", 'auth_key = "qLmZxWcVbNtRyHgFdSpKjTuEoIaQwXzM"', "passphrase: gorka-melint-suvati-porden"]), (pii, ["my name is Maria Lopez", "Dr. Peter Schmidt", "address: 9 Walker Street"])):
        model = crf.train(module.labelled_rows())
        found = crf.model_spans(model, ["see " + t + " and then" for t in cases])
        assert all(any(("see " + t + " and then")[s:e].strip('"') in t and e - s > 4 for s, e in f) for t, f in zip(cases, found)), found
