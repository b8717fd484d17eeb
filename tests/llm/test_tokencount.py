import random

import numpy as np
import public_tokenizers
import sentencepiece

from spanloom.llm import tokencount
from spanloom.llm.tokencount import token_counts, transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library_on_odd_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(1)
    alphabet = " \n\t\x00abcdeéß▁the<s>安漢字😀0123  "
    texts = ["", " ", "   ", " " * 100 + "a" + " " * 37, "a" * 3000, "▁a ▁", "<s> </s>", "é"]
    texts += ["".join(pick.choices(alphabet, k=pick.randint(0, 60))) for _ in range(2000)]
    texts += [" ".join(pick.choices(["the", "  ", "hello", "World", "тест", "def f(x):\n    return x"], k=9)) for _ in range(500)]
    assert transducer(MODEL).texts(texts).tolist() == [len(x) for x in sp.encode(texts)]


def test_maps_of_pieces_cut_anywhere_compose():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(2)
    syllables = ["tion", "ing", "the", "a", "é", "漢", "字", "0", "12", "x", "qz", "—", "😀", "er", "an", "\n", "=="]
    texts = ["".join(pick.choices(syllables[: pick.randint(2, 17)], k=pick.randint(600, 6000))) for _ in range(30)]
    texts += ["a" * 5000, "ab" * 3001, "\n" * 4096, "aab" * 2500 + " " + "the" * 3000, " " * 5000 + "x", "漢字" * 2048, "a" * tokencount.LONG, "b" * (tokencount.PIECE * 9)]
    t = transducer(MODEL)
    assert t.texts(texts).tolist() == [len(x) for x in sp.encode(texts)]
    # each piece of a text, cut where the text is, at the state before it: states and counts compose to those of the whole
    text = tokencount.MARK + texts[0][:3000]
    for cut in (1, 500, 1777, 2999):
        codes = lambda x: np.array([[ord(c) for c in x]])
        read = lambda s, x: [int(v[0]) for v in t.side_by_side(np.array([s]), codes(x), np.array([len(x)]))]
        one, a = read(0, text[:cut])
        two, b = read(one, text[cut:])
        assert [two, a + b] == read(0, text) and a + b == t(text)


def test_maps_compose_as_they_follow_one_another():
    pick = random.Random(5)
    for n in (1, 2, 3, 7, 8, 33):
        domains = [[0]] + [pick.sample(range(9), pick.randint(1, 4)) for _ in range(n)]
        maps = [{s: (pick.choice(domains[k + 1]), pick.randint(-2, 9)) for s in domains[k]} for k in range(n)]
        state, total = 0, 0
        for m in maps:
            state, a = m[state]
            total += a
        assert tokencount.composed(maps) == total


def test_pieces_whose_first_state_is_not_that_of_the_characters_before(monkeypatch):
    """With nothing read before a piece, every map is first made at the wrong state."""
    monkeypatch.setattr(tokencount, "BEFORE", 0)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(6)
    texts = ["".join(pick.choices(["tion", "ing", "qzx", "é", "aab", "the"], k=1500)) for _ in range(5)]
    assert transducer(MODEL).texts(texts).tolist() == [len(x) for x in sp.encode(texts)]


def test_a_very_long_text_without_a_space(spark):
    text = "".join(random.Random(3).choices(["tion", "ing", "qzx", "é"], k=100_000))
    got = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).first()
    assert got.n_tokens == transducer(MODEL)("▁" + text) and got.over_limit


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "y"), (2, None, "x"), (None, "a " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, MODEL).collect()), key=str)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    two, many = len(sp.encode("hello world")), len(sp.encode("a " * 5000))
    assert got == sorted([(1, 11, two, False), (1, 11, two, False), (2, 0, 0, False), (None, 10000, many, True)], key=str)
    assert token_counts(docs.limit(0), MODEL).count() == 0
