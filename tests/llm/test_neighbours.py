"""The permutation index: recall, exact results where all is ranked anew, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from planimetra.llm import permutation_index as pi


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "r") for i, v in rows], "vec_id long, embedding array<float>, rank int, key string").repartition(3)


def searched(df, **kw) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in sorted(pi.nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def by_brute_force(rows, every=20, k=20) -> dict[int, list[tuple]]:
    """Over {id: vector}; shorter vectors end in zeros."""
    ids = sorted(rows)
    dims = max(map(len, rows.values()))
    x = np.array([np.pad(np.asarray(rows[i], np.float32).astype(float), (0, dims - len(rows[i]))) for i in ids])
    out = {}
    for i in ids:
        if i % every == 0:
            scores = x @ x[ids.index(i)]
            out[i] = sorted(((j, round(s, 9)) for j, s in zip(ids, scores) if j != i), key=lambda t: (-t[1], t[0]))[:k]
    return {i: hits for i, hits in out.items() if hits}


def share_found(got, want) -> float:
    return float(np.mean([len({j for j, _ in got[i]} & {j for j, _ in hits}) / len(hits) for i, hits in want.items()]))


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, lengths):
    """Clusters of different widths, a hot one with a third of all; with and without unit length."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 32))
    of = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 12, 6000))
    x = centre[of] + rng.normal(size=(6000, 32)) * (0.3 + 0.1 * of[:, None])
    if not lengths:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = dict(enumerate(x.tolist()))
    want = by_brute_force(rows, 60)
    assert share_found(searched(frame(spark, rows.items()), every=60, least=500), want) >= 0.9


def test_equal_vectors_and_ties(spark):
    """A third of all rows are equal; every score is exact and ties go by the id."""
    rng = np.random.default_rng(2)
    same = [1.0, 0.5, 0.0]
    rows = {i: same if i % 3 == 0 else rng.integers(-3, 4, 3).astype(float).tolist() for i in range(-10, 900)}
    rows = {i: v for i, v in rows.items() if any(v)}
    assert searched(frame(spark, rows.items())) == by_brute_force(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = {0: [1, 2, 3], 20: [1, 2], 3: [0, 0, 1], 40: [-1, 0, 0], 60: [0.125, 0, 0]}
    odd = [(80, None), (100, [0, 0, 0]), (120, [1, nan, 0]), (140, [inf, 0, 0]), (160, [1, None, 2]), (None, [1, 1, 1]), (180, []), (0, [1, 2, 3]), (0, [1, 2, 2])]
    assert searched(frame(spark, [*fine.items(), *odd])) == by_brute_force(fine)
    assert searched(frame(spark, odd[:7])) == {} and searched(frame(spark, [(20, [1, 2])])) == {}


def test_agreement_is_the_footrule():
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(50, 8)), rng.normal(size=(30, 9))
    files = pi.Files(x, pivots, float(np.linalg.norm(x, axis=1).max()), m=6)
    named = pi._nearest(pi._lengthened(x, float(np.linalg.norm(x, axis=1).max())), pivots, 6)
    order = files.orders(rng.normal(size=(1, 8)))[0]
    place = lambda o, p: list(o).index(p) if p in o else 6
    footrule = [sum(abs(place(order, p) - place(o, p)) for p in range(30)) for o in named]
    assert [6 * 7 - 2 * a for a in files.agreement(order)] == footrule
