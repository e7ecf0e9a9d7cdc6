"""Memory and work of operators on inputs where nothing prunes."""

from __future__ import annotations

import tracemalloc

import numpy as np

from evalloom.llm import covertree


def test_cover_trees_hold_one_block_of_pairs_whatever_the_bounds_prune():
    """op12: nodes of random vectors are all within reach, so the open pairs must not wait all at once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x[2700:] = x[:300] + 0.3 * rng.normal(size=(300, 64))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= covertree.LEAST_COSINE
    np.fill_diagonal(near, False)
    vectors = covertree.Vectors(np.arange(len(x)), np.ones(len(x), np.int64), x)
    tracemalloc.start()
    found = covertree.traverse(vectors, None, covertree.LEAST_COSINE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.sum() > 100 and found.links[0].tolist() == near.sum(1).tolist()
    assert peak < 60 << 20


def test_cover_trees_by_small_blocks_find_all_links(monkeypatch):
    """op12: blocks of few pairs, dense and sparse neighbourhoods, members and visitors; against all pairs."""
    rng = np.random.default_rng(6)
    for block, spread in ((50, 0.05), (700, 0.3), (1 << 20, 0.2)):
        monkeypatch.setattr(covertree, "BLOCK", block)
        centres = rng.normal(size=(12, 16))
        x = np.concatenate([centres[rng.integers(0, 12, 500)] + spread * rng.normal(size=(500, 16)), rng.normal(size=(200, 16))])[rng.permutation(700)]
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        near = unit @ unit.T >= covertree.LEAST_COSINE
        np.fill_diagonal(near, False)
        make = lambda k: covertree.Vectors(k, np.ones(len(k), np.int64), x[k])
        a, b = np.arange(400), np.arange(400, 700)
        assert covertree.traverse(make(np.arange(700)), None, covertree.LEAST_COSINE).links[0].tolist() == near.sum(1).tolist()
        both = covertree.traverse(make(a), make(b), covertree.LEAST_COSINE)
        assert both.links[0].tolist() == near[:400, 400:].sum(1).tolist() and both.links[1].tolist() == near[:400, 400:].sum(0).tolist()
