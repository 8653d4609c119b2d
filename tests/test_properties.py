"""Random datasets through the containers, random frequencies through the codes; no Spark needed."""

import numpy as np
from hypothesis import given, settings, strategies as st

from bitloom.operators import encode
from bitloom.operators.basetable import DEVIATION, ONE, VARIABLE, ZERO, Layout
from bitloom.operators.images import ImageInfo, field_names
from bitloom.schema import DatasetInfo, Feature
from bitloom.sources import containers


@st.composite
def datasets(draw):
    widths = draw(st.lists(st.sampled_from([8, 16, 32, 64]), min_size=1, max_size=4))
    features = [Feature(f"f{i}", "int64", w, "offset_signed", draw(st.integers(-(2**62), 2**62))) for i, w in enumerate(widths)]
    total = sum(widths)
    states = draw(st.lists(st.sampled_from([DEVIATION, VARIABLE, ZERO, ONE]), min_size=total, max_size=total))
    n, m = draw(st.integers(0, 60)), draw(st.integers(0, 3))
    rng = np.random.default_rng(draw(st.integers(0, 2**32)))
    v, d = states.count(VARIABLE), states.count(DEVIATION)
    bases = np.unique(rng.integers(0, 2, (draw(st.integers(1, 9)), v), dtype=np.uint8), axis=0)[::-1] if v else np.zeros((1, 0), dtype=np.uint8)
    ids = np.repeat(rng.integers(0, len(bases), n + m), 1)
    if draw(st.booleans()):
        ids = np.sort(ids)
    deviations = rng.integers(0, draw(st.integers(1, 2)), (n + m, d), dtype=np.uint8)
    weights = [int(w) for w in rng.integers(0, max(1, n), m)]
    info = DatasetInfo(features, n, weights)
    # the table is sorted by its columns as they are, so that deltas can be written
    return containers.Dataset(info, Layout(tuple(states), tuple(b for b, s in enumerate(states) if s)), bases, ids, deviations, draw(st.sampled_from([1024])), list(range(v)))


@settings(max_examples=120, deadline=None)
@given(datasets(), st.sampled_from(["flat", "rle", "huffman"]), st.sampled_from([None, "unary", "fixed"]))
def test_egd_round_trip(d, encoding, delta):
    if encoding == "huffman" and d.deviations.shape[1] > 255:
        return
    back = containers.read_egd(containers.egd_bytes(d, encoding, delta))
    assert back.info.n == d.info.n and back.info.weights == d.info.weights and back.layout.states == d.layout.states
    assert [(f.bits, f.transform, f.minimum) for f in back.info.features] == [(f.bits, f.transform, f.minimum) for f in d.info.features]
    assert np.array_equal(back.bases, d.bases) and np.array_equal(back.ids, d.ids) and np.array_equal(back.deviations, d.deviations)
    mine, other = d.values(), back.values()
    assert all(np.array_equal(mine[k], other[k]) for k in mine)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.integers(1, 10**9), min_size=2, max_size=80), st.integers(7, 24))
def test_limited_codes_are_prefix_codes(frequencies, longest):
    lengths = encode.limited_lengths(frequencies, longest)
    assert set(lengths) == set(frequencies) and max(lengths.values()) <= longest
    assert sum(2.0**-n for n in lengths.values()) == 1
    free = encode.code_lengths(frequencies, 10**6)
    if max(free.values()) <= longest:
        cost = lambda x: sum(frequencies[s] * n for s, n in x.items())
        assert cost(lengths) == cost(free)
    encode.canonical_codes(lengths)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=700))
def test_pairs_cover_the_rows(changed):
    changed[0] = True
    pairs = containers.pairs_of(np.array(changed))
    assert sum((r + 1 if r else 0) + m for r, m in pairs) == len(changed)
    assert all(r < encode.MAX_RUN and m <= encode.MAX_LITERALS and (r or m) for r, m in pairs)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from(["raw", "for_first", "for_min"]), st.integers(1, 4), st.integers(1, 4), st.integers(3, 4), st.integers(0, 2**32))
def test_igd_round_trip(width, height, grouping, gw, gh, channels, seed):
    image = ImageInfo(width, height, channels, "ycocg_r", grouping, gw, gh)
    rng = np.random.default_rng(seed)
    info = DatasetInfo([Feature(n, "uint16", w) for n, w in field_names(image)], image.grid[0] * image.grid[1])
    states = rng.integers(0, 2, info.chunk_size).tolist()
    v = states.count(VARIABLE)
    bases = np.unique(rng.integers(0, 2, (4, v), dtype=np.uint8), axis=0)
    ids = rng.integers(0, len(bases), info.n)
    d = containers.Dataset(info, Layout(tuple(states), tuple(b for b, s in enumerate(states) if s)), bases, ids, rng.integers(0, 2, (info.n, info.chunk_size - v), dtype=np.uint8), image.grid[0], None, image)
    back = containers.read_igd(containers.igd_bytes(d, "rle"))
    assert back.image == image and [f.bits for f in back.info.features] == [f.bits for f in info.features]
    mine, other = d.values(), back.values()
    assert all(np.array_equal(mine[k], other[k]) for k in mine)
