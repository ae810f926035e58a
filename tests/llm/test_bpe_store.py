"""The store of encoded pre-tokens of op8: two generations, of which the older goes."""

import random

from voxelweave.llm import bpe


def test_generations_roll_over(monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefgé1") for _ in range(r.randrange(1, 30))) for _ in range(40)) for _ in range(30)]
    whole = bpe.Codec(bpe.public_file())
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "KEPT", 25)
    small = bpe.Codec(bpe.public_file())
    for _ in range(2):
        for t, ids in zip(texts, want):
            assert small.encode(t) == ids and small.decode(ids) == t
            assert len(small.new) <= 25 and len(small.old) <= 25
    assert small.old and all(len(w) <= bpe.KEPT_SIZE for w in small.new)
