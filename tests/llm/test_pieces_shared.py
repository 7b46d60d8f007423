"""Distinct pieces are few and meet the library in few calls."""

import random

import numpy as np
from auditlake.llm import op6_tokens


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **kw)

    def get_added_tokens_decoder(self):
        return self.library.get_added_tokens_decoder()


def test_signs_after_letters_begin_a_piece():
    cut = lambda b, fixed=b"": op6_tokens._pieces(np.frombuffer(b, np.uint8), np.array([0]), fixed).tolist()
    assert cut(b" abc, abc.) a1. x") == [0, 4, 5, 9, 11, 15]
    assert cut(" é, ×. ÷.".encode()) == [0, 3, 4, 8]
    assert cut(b"a.b a,b", b"<a.b>") == [0, 3, 5]  # a token that is found before texts are cut into pieces


def test_words_of_other_letters_are_encoded_together(monkeypatch):
    library, opens = op6_tokens.tokenizer(None)
    counted = Counted(library)
    monkeypatch.setattr(op6_tokens, "tokenizer", lambda path: (counted, opens))
    r = random.Random(4)
    words = ["".join(r.choice("aeiéèñüst") for _ in range(8)) for _ in range(1500)]
    texts = [" ".join(w + r.choice(["", ",", ".", "!", "'s", "...", ".)"]) for w in r.sample(words, 300)) for _ in range(40)]
    texts += ["x's don't I'LL é's ñ. ×, ÷. é,  a, a , a b. <|endoftext|>, a<|endoftext|>.   ß: 1, _a, a_, ٣. ﻿, a﻿.", "", "é", ",", " ,a", "a ,", "a,\n\n b.\t"]
    ids, counts = op6_tokens.encode_texts(texts, None, 2)
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert counted.texts < 200  # one for each distinct word and sign together before


def test_pieces_of_earlier_texts_are_not_encoded_again(monkeypatch):
    library, opens = op6_tokens.tokenizer(None)
    counted, store = Counted(library), {}
    monkeypatch.setattr(op6_tokens, "tokenizer", lambda path: (counted, opens))
    monkeypatch.setattr(op6_tokens, "worker_store", lambda: store)
    texts = ["kept words, kept signs. é", "", " another one"]
    want = [i for t in texts for i in library.encode(t, add_special_tokens=False).ids + [2]]
    assert op6_tokens.encode_texts(texts, None, 2)[0].tolist() == want
    counted.texts = 0
    assert op6_tokens.encode_texts(texts[::-1] + texts, None, 2)[0].tolist()[-len(want) :] == want
    assert counted.texts == 0
    monkeypatch.setattr(op6_tokens, "KEPT", 3)  # what is kept is bounded, results are not
    store.clear()
    for _ in range(2):
        assert op6_tokens.encode_texts(texts, None, 2)[0].tolist() == want
        assert len(store["pieces", None][0]) == len(store["pieces", None][1]) == 3
