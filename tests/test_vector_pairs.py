"""All pairs of one table of vectors above a cosine: each once, told in single precision and settled in double."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.plans import review


@pytest.mark.parametrize("least", [0.85, 0.3, -0.2])
def test_pairs_within(spark, monkeypatch, least):
    for name, value in (("PER_PIVOT", 40), ("BLOCK", 8), ("NEAR", 2), ("STRIP", 3), ("PAIRS", 5)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 6))
    vectors = [(i, (centres[i % 5] + 0.4 * rng.normal(size=6)).tolist()) for i in range(160)]
    # cosines that single precision can't tell from `least`
    edge = [(200 + i, [least + step, math.sqrt(1 - (least + step) ** 2), 0.0, 0.0, 0.0, 0.0]) for i, step in enumerate((-1e-9, 1e-9, -1e-12, 1e-12))]
    odd = [(300, [0.0] * 6), (301, None), (302, [1.0, 2.0]), (303, [2.0, 4.0]), (304, []), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (306, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame([*vectors, *edge, *odd], "vec_id long, embedding array<double>").repartition(3)
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in [*vectors, *edge, *odd] if v and None not in v and i is not None}
    want = {(i, j): float(u @ v) for i, u in unit.items() for j, v in unit.items() if i < j and len(u) == len(v) and u @ v >= least}
    got = retrieval.pairs_within(rows, least).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == set(want)
    assert all(math.isclose(r.score, want[r.a, r.b], abs_tol=1e-12) for r in got)
    both = {(r.a, r.b) for r in retrieval.pairs_above(rows, rows, least).where("a < b").collect()}
    assert both == set(want) and (201, 306) in both and (200, 306) not in both
    assert retrieval.pairs_within(rows.limit(0), least).count() == 0


def test_findings_meet_once(spark, monkeypatch):
    """dedup_findings compares a pair of blocks one way."""
    made = []
    kept = retrieval._met
    monkeypatch.setattr(retrieval, "_met", lambda *a: made.append(a[-1]) or kept(*a))
    assert review.QUERIES["dedup_findings"](spark, "/root/testdata/sf0.001").select(F.count(F.lit(1))).first()[0] and made == [True]


def test_copies_of_a_vector_make_no_pairs(spark, tmp_path, monkeypatch):
    """The rule item by item, on vectors that come many times, zero ones and null ones; edges are those of different vectors alone."""
    rng = np.random.default_rng(2)
    some = [rng.normal(size=3).round(1).tolist() for _ in range(25)]
    vectors = [(i, some[int(rng.integers(0, 25))]) for i in rng.permutation(200).tolist()] + [(300 + i, [0.0] * 3) for i in range(4)] + [(400, None), (401, None), (402, [1.0, None, 1.0]), (403, [1e-13, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    made = []
    kept = retrieval.pairs_within
    monkeypatch.setattr(retrieval, "pairs_within", lambda *a: made.append(kept(*a)) or made[-1])
    got = sorted(r.id for r in review.QUERIES["dedup_findings"](spark, f"file://{tmp_path}").collect())
    every = vectors + [(i + 1_000_000_000, [0.0, *v[1:]] if v else None) for i, v in vectors if i % 5 == 0]
    unit = {i: np.float32(v).astype(float) / max(np.linalg.norm(np.float32(v).astype(float)), 1e-12) for i, v in every if v and None not in v}
    want = []
    for i in sorted(i for i, _ in every):
        if i not in unit or not any(k in unit and unit[i] @ unit[k] >= review.SAME_FINDING for k in want):
            want.append(i)
    assert got == want and made[0].count() < 25 * 50
