import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tintmill.llm import range_coder


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(0, 3000), st.integers(0, 9), st.floats(0, 1))
def test_round_trip(vocabulary, n, seed, repeats):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, vocabulary, n)
    again = np.flatnonzero(draw.random(n) < repeats)
    ids[again] = ids[again // 7]
    assert (range_coder.decode(io.BytesIO(range_coder.encode(ids, vocabulary)).read) == ids).all()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 513, 70_000])
def test_lanes_of_any_number(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 65_535).astype(np.int64)
    assert (range_coder.decode(io.BytesIO(range_coder.encode(ids, 1 << 16)).read) == ids).all()


def test_a_full_block_learns():
    """Ids that follow from the two before them cost a third at most of what equally likely ones cost, and those cost their bits."""
    draw = np.random.default_rng(3)
    follows = draw.integers(0, 500, (500, 500))
    ids = np.zeros(200_000, np.int64)
    for k in range(2, len(ids)):
        ids[k] = follows[ids[k - 2], ids[k - 1]] if k % 50 else draw.integers(500)
    free = draw.integers(0, 512, 200_000)
    told, plain = (8 * len(range_coder.encode(x, 512)) / len(x) for x in (ids, free))
    assert told < plain / 3 and 9 < plain < 9.6


def test_blocks_stand_alone():
    one, two = (np.random.default_rng(k).integers(0, 50, 900) for k in (1, 2))
    raw = range_coder.encode(one, 50) + range_coder.encode(two, 50)
    file = io.BytesIO(raw)
    assert (range_coder.decode(file.read) == one).all() and (range_coder.decode(file.read) == two).all() and range_coder.decode(file.read) is None
    assert (range_coder.decode(io.BytesIO(raw[len(range_coder.encode(one, 50)):]).read) == two).all()


def test_damage_is_found():
    raw = bytearray(range_coder.encode(np.arange(900) % 50, 50))
    for at in (0, 5, 9, 20, 30, len(raw) - 9):
        bad = raw.copy()
        bad[at] ^= 4
        with pytest.raises(ValueError):
            range_coder.decode(io.BytesIO(bytes(bad)).read)
    with pytest.raises(ValueError):
        range_coder.decode(io.BytesIO(bytes(raw[:-4])).read)
    with pytest.raises(ValueError):
        range_coder.encode(np.array([50]), 50)
