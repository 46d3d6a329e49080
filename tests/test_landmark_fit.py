"""The fit of the landmarks holds counts of differing positions, and all else for a few rows at a time."""

import tracemalloc

import numpy as np

import kinfold.operators.embedding as em


def _sequences(n: int) -> list[str]:
    r = np.random.default_rng(5)
    kinds = ["".join(r.choice(list("ACDE"), 60)) for _ in range(12)]
    return ["".join(c if r.random() < 0.8 else r.choice(list("FGé漢")) for c in kinds[i % 12])[: 40 + i % 20] for i in range(n)]


def test_the_fit_is_not_held_in_whole_matrices(monkeypatch):
    for name, x in (("KRYLOV", 16), ("STEPS", 8), ("FIT_ROWS", 64)):
        monkeypatch.setattr(em, name, x, raising=False)
    marks = _sequences(1200)
    tracemalloc.start()
    P = em.mds_basis(marks, 5, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert P.shape == (5, 1200) and peak < 11e6  # one matrix of the landmarks squared is 11.5 MB


def test_large_fits_reach_the_stress_of_exact_vectors(monkeypatch):
    marks = _sequences(400)
    D = em._hamming_block(marks, marks)

    def stress() -> float:
        X = np.linalg.pinv(em.mds_basis(marks, 8))
        return ((np.linalg.norm(X[:, None] - X[None], axis=2) - D) ** 2).sum()

    exact = stress()
    monkeypatch.setattr(em, "KRYLOV", 16, raising=False)
    monkeypatch.setattr(em, "STEPS", 8, raising=False)
    assert stress() < 1.001 * exact
