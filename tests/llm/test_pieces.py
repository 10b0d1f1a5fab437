"""Lookups in pieces give what one lookup gives."""

import numpy as np

from axisloom.llm import bpe, queries


def test_ranks_in_pieces(monkeypatch):
    v = bpe.vocabulary(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    pieces = [w.encode() for w in ("unbelievably", " zzzzzzz", "x", " Überraschung", "aaaaaaaaaaaaa", " 12345678901") * 3]
    whole = bpe.replay(v, pieces)
    for most in (1, 3, 7):
        monkeypatch.setattr(bpe, "RANK_PAIRS", most)
        cut = bpe.replay(v, pieces)
        assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert v.decode(whole[0]) == b"".join(pieces)
