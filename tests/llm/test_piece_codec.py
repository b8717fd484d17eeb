import random

import numpy as np
import public_tokenizers
import sentencepiece

from spanloom.llm.piece_codec import codec, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def same(texts):
    sp, c = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec(MODEL)
    for text in texts:
        want = sp.encode(text)
        got = np.frombuffer(c.encode(text), "<u4").tolist()
        assert got == want, text
        assert c.decode(np.array(got, "<u4").tobytes()) == sp.decode(want), text


def test_ids_and_texts_equal_the_library():
    pick = random.Random(1)
    alphabet = " \n\t\x00abcdeéß▁the<s>安漢字😀0123  ﻿​\U0001f9ff"
    same(["", " ", "   ", " " * 100 + "a" + " " * 37, "a" * 3000, "▁a ▁", "<s> </s>", "<unk><0x0A>", "é", "\r\n", "ﬁ", "x  ▁ y"])
    same(["".join(pick.choices(alphabet, k=pick.randint(0, 60))) for _ in range(3000)])
    same([" ".join(pick.choices(["the", "  ", "hello", "World", "тест", "def f(x):\n    return x", "internationalization", "aaaaab"], k=9)) for _ in range(500)])


def test_ids_of_stretches_without_a_space():
    pick = random.Random(2)
    syllables = ["tion", "ing", "the", "a", "é", "漢", "字", "0", "12", "x", "qz", "—", "😀", "er", "an", "\n", "=="]
    same(["".join(pick.choices(syllables[: pick.randint(2, 17)], k=pick.randint(600, 3000))) for _ in range(20)])
    same(["ab" * 3001, "\n" * 4096, "aab" * 2500 + " " + "the" * 3000, " " * 5000 + "x", "".join(pick.choices(syllables, k=60_000))])


def test_any_ids_decode_as_the_library_does():
    sp, c, pick = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec(MODEL), random.Random(3)
    for _ in range(500):
        ids = pick.choices(range(32_000), k=pick.randint(0, 12))
        assert c.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids), ids


def test_last_pieces_of_prefixes_are_those_of_their_encodings():
    c = codec(MODEL)
    text = "▁internationalizations"
    assert c.prefixes(text) == [c.merged(text[: k + 1])[-1] for k in range(len(text))]


def test_which_pieces_may_stand_side_by_side():
    """Undoing merges says the same as merging the two anew."""
    c, pick = codec(MODEL), random.Random(4)
    whole = [*c.parts, *(p for p in c.score if len(p) == 1)]
    short = [p for p in whole if len(p) <= 3 and p.isascii()]
    for _ in range(20_000):
        a, b = pick.choice(short), pick.choice(pick.choice((short, whole)))
        if not b.startswith("▁"):
            assert c.fit(a, b) == (c.merged(a + b) == [a, b]), (a, b)


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "y"), (2, None, "x"), (None, " a▁ ", "x"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in decode(encode(docs, MODEL), MODEL).collect()), key=str)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(k, ids := sp.encode(t or "", add_bos=True, add_eos=True), sp.decode(ids)) for k, t, _ in rows]
    assert got == sorted(want, key=str)
    assert np.frombuffer(encode(docs.filter("doc_id = 3"), MODEL, begin=False).first().ids, "<u4").tolist() == [sp.eos_id()]
    assert decode(encode(docs.limit(0), MODEL), MODEL).count() == 0
