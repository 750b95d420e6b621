import random
from collections import Counter

import numpy as np

from lakeloom.llm.similarity_join import Bands, bucket_keys


def test_linked_sets_share_a_bucket():
    """Any two sets at the threshold meet, at every size and split of the difference."""
    bands, rng = Bands(85, 100), random.Random(5)
    for _ in range(400):
        n = int(1.5 ** rng.uniform(0, 16)) + 1
        common = {rng.getrandbits(64) for _ in range(n)}
        spare = bands.most_apart(2 * n + 2 * n) // 2
        left, right = rng.randint(0, spare), rng.randint(0, spare)
        a = np.array(sorted(common | {rng.getrandbits(64) for _ in range(left)}), np.uint64)
        b = np.array(sorted(common | {rng.getrandbits(64) for _ in range(right)}), np.uint64)
        if 100 * n >= 85 * (len(a) + len(b) - n):
            assert np.intersect1d(bucket_keys(a, bands), bucket_keys(b, bands)).size


def test_linked_sparse_sets_share_a_bucket_without_empty_segments():
    """Small sets, in which segments are often empty; of two linked ones some differ in every segment that is not."""
    bands, rng, empty = Bands(85, 100), random.Random(6), 0
    for _ in range(6000):
        n = rng.randint(7, 60)
        common = {rng.getrandbits(64) for _ in range(n)}
        apart = next(d for d in range(n, -1, -1) if 100 * n >= 85 * (n + d))
        left = rng.randint(0, apart)
        a = np.array(sorted(common | {rng.getrandbits(64) for _ in range(left)}), np.uint64)
        b = np.array(sorted(common | {rng.getrandbits(64) for _ in range(apart - left)}), np.uint64)
        keys = bucket_keys(a, bands)
        assert np.intersect1d(keys, bucket_keys(b, bands)).size
    met = Counter(int(k) for _ in range(20_000) for k in bucket_keys(np.array(sorted(rng.getrandbits(64) for _ in range(30)), np.uint64), bands))
    assert max(met.values()) <= 2  # unrelated sets share no bucket


def test_bands_cover_all_sizes():
    bands = Bands(85, 100)
    for n in range(1, 5000):
        i = bands.of(n)
        assert bands.first(i) <= n < bands.first(i + 1)
        for larger in range(n, n * 100 // 85 + 1):
            assert bands.of(larger) in bands.joined(n)
