"""Codes of vectors and their ranking, without Spark."""

import numpy as np

from sheafline.llm import similar_vectors as N


def test_least_numbers_of_rows():
    a = np.random.default_rng(1).random((50, 40)).astype(np.float32)
    assert np.array_equal(N._least(a.copy(), 3), np.argsort(a, axis=1)[:, :3])
    assert sorted(N._least(a[:1, :4].copy(), 4)[0].tolist()) == [0, 1, 2, 3]


def test_codes_over_the_bound_equal_a_search_of_all():
    r = np.random.default_rng(2)
    x = N._unit((np.repeat(r.normal(size=(150, 24)), 8, 0) + 0.1 * r.normal(size=(1200, 24))).astype(np.float32))
    m = N.fit(x, len(x), exact=True)
    cell, codes, norm = N.encode(x, m)
    order = np.argsort(cell, kind="stable")
    cells, begin = np.unique(cell[order], return_index=True)
    spans = list(zip(cells.tolist(), begin.tolist(), [*begin[1:].tolist(), len(x)]))
    q, place = N._over(x, x[order], m, spans, codes[order].astype(np.intp), norm[order], 0.85, 1200)
    cosine = x @ x.T
    sure = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.85 + 1e-4))}
    got = set(zip(q.tolist(), order[place].tolist()))
    assert sure <= got and all(cosine[i, j] >= 0.85 - 1e-4 for i, j in got) and len(sure) > 5000
