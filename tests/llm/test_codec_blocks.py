import numpy as np
import pytest

from auditlake.llm import codec, op6_tokens


def test_blocks_are_read_alone():
    r = np.random.default_rng(5)
    ids = np.concatenate([r.zipf(1.3, 9000) % 50_000, np.tile([7, 8, 9, 50_000], 600)]).astype(np.uint32)
    data = codec.encode(ids, block=1024)
    assert (codec.decode(data) == ids).all()
    for i in range(-(-len(ids) // 1024)):
        assert (codec.decode(data, only=i) == ids[i * 1024 : (i + 1) * 1024]).all()
    bad = bytearray(data)
    bad[-5] ^= 1
    last = (len(ids) - 1) // 1024
    assert (codec.decode(bytes(bad), only=0) == ids[:1024]).all()
    with pytest.raises(codec.CorruptBlock):
        codec.decode(bytes(bad), only=last)


def test_pieces_have_the_ids_of_whole_texts():
    import random

    library, _ = op6_tokens.tokenizer(None)
    r = random.Random(1)
    parts = ["a", "b", "é", " ", "\n", "\t", "  ", " ", "　", "😀", "'s", "1", "!", "\x00", "\x1f", "\r\n", "<|endoftext|>", "\x85", "\x0b"]
    texts = ["", " "] + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(2000)] + ["w x " * 5000]
    ids, counts = op6_tokens.encode_texts(texts, None, 2)
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    none, zero = op6_tokens.encode_texts([], None, 2)
    assert len(none) == len(zero) == 0
