import numpy as np
import pytest

from sigweave.llm import simple8b


@pytest.mark.parametrize("n", [0, 1, 3, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 20, 1 << 40])
def test_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype(np.uint64)
    words, first, escapes, first_escape = simple8b.encode(ids)
    assert (simple8b.decode(words, first, escapes, n) == ids).all()
    for k in range(len(first)):
        assert (simple8b.decode_block(k, words, first, escapes, first_escape, n) == ids[1024 * k : 1024 * (k + 1)]).all()


def test_small_ids_pack_densely():
    words, *_ = simple8b.encode(np.zeros(6000, np.uint64))
    assert len(words) <= 6000 // 60 + 6
