"""Pairs of a tight cluster of fingerprints that trees part many times, against comparison of all pairs."""

import numpy as np

from kernelmill.llm import simhash


def clustered(seed, n=6000, flip=0.08):
    rng = np.random.default_rng(seed)
    bits = np.packbits(rng.random((n, 64)) < flip, axis=1).view(np.uint64).reshape(-1)
    return np.unique(bits ^ rng.integers(0, 2**63, 1, np.uint64))


def roots(forest, n):
    return [forest.root(k) for k in range(n)]


def test_links_of_a_tight_cluster():
    for seed in range(4):
        fps = clustered(seed)
        want, got = simhash._Forest(len(fps)), simhash._Forest(len(fps))
        for k in range(0, len(fps), 512):
            for i, j in np.argwhere(np.bitwise_count(fps[k : k + 512, None] ^ fps[None, :]) <= 2).tolist():
                want.join(k + i, j)
        simhash._link(fps, 2, got, leaf=64)
        assert roots(got, len(fps)) == roots(want, len(fps))
