"""Properties of the parts that need no session."""

import numpy as np
import pyarrow as pa
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from tessella.llm import contamination, mixing, nearcopies, repeats, textkit  # noqa: E402

quick = settings(max_examples=150, deadline=None)


@quick
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60, unique=True))
def test_packed_places_come_back(places):
    at = np.array(sorted(places))
    assert repeats.opened(*repeats.close(at)).tolist() == at.tolist()


@quick
@given(st.lists(st.lists(st.booleans(), max_size=12), max_size=8))
def test_runs(masks):
    at = np.concatenate(([0], np.cumsum([len(m) for m in masks]))).astype(int)
    mask = np.array([x for m in masks for x in m], bool)
    start, end, offsets = textkit.runs(mask, at)
    for i, m in enumerate(masks):
        mine = [j for k in range(offsets[i], offsets[i + 1]) for j in range(start[k], end[k])]
        assert mine == [j for j, x in enumerate(m) if x]
        assert all(start[k] > end[k - 1] for k in range(offsets[i] + 1, offsets[i + 1]))


@quick
@given(st.lists(st.text(alphabet="ab é\n\t\x0b", max_size=30) | st.none(), max_size=8))
def test_words(texts):
    w = textkit.Texts(pa.array(texts, pa.string())).words()
    raw = w.buf.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.at[:-1], w.at[1:])]
    assert got == [(t or "").replace("\x0b", " ").split() for t in texts]


@quick
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=10), min_size=1, max_size=14), st.booleans())
def test_forest_spans_all_links(sets, two):
    token = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    side = np.arange(len(sets)) % 2 if two else np.zeros(len(sets), int)
    edges = nearcopies.forest(np.arange(len(sets)), side, at, token, 0.8)

    def classes(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(sets))]

    one_side = side.min() == side.max()
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (one_side or side[i] != side[j]) and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    assert classes(edges) == classes(links) and all((max(e), min(e)) in links for e in edges)


@quick
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), max_size=40), st.integers(0, 2**32 - 1))
def test_flight(units, seed):
    p = np.array([a for a, _ in units])
    size = np.array([b for _, b in units], int)
    u = np.random.default_rng(seed).random(len(p))
    flown = mixing.flight(p, size, u, False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and ((flown >= 0) & (flown <= 1)).all()
    assert abs(flown.sum() - p.sum()) < 1e-5 and abs((flown * size).sum() - (p * size).sum()) < 1e-3
    assert set(mixing.flight(p, size, u, True).tolist()) <= {0.0, 1.0}


@quick
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), min_size=1, max_size=25))
def test_contamination_of_small_alphabets(doc, item):
    found = contamination.Fingerprints(["x"], [" ".join(item)], 10, 5).match(pa.array([" ".join(doc)]))
    k = min(10, len(item))
    wanted = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
    hit = {j for i in range(len(doc) - k + 1) if tuple(doc[i : i + k]) in wanted for j in range(i, i + k)}
    got = {j for a, b in zip(found["hit_start"][0].as_py(), found["hit_end"][0].as_py()) for j in range(a, b)}
    assert got == hit and found["items"][0].as_py() == (["x"] if hit else [])
