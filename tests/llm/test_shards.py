import numpy as np
import pytest

from craquelure.llm import simhash


def apart(points, bits, seed):
    """Each point with exactly ``bits`` of its bits changed."""
    r = np.random.default_rng(seed)
    chosen = r.permuted(np.tile(np.arange(64), (len(points), 1)), axis=1)[:, :bits].astype(np.uint64)
    return points ^ np.bitwise_or.reduce(np.uint64(1) << chosen, axis=1, initial=0)


@pytest.mark.parametrize("count", [0, 10, 10_000, 3_000_000, 10**8, 10**10, 10**13])
def test_linked_ones_meet_under_a_mask(count):
    masks = simhash.masks(count)
    points = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for bits in range(simhash.BITS + 1):
        differ = points ^ apart(points, bits, bits)
        assert (np.bitwise_count(differ) == bits).all()
        assert ((differ[:, None] & masks) == 0).any(1).all()


def test_shards_keep_their_size():
    """The fingerprints that one is compared with: bounded where bits are independent, before they grew without end."""
    for count in (10**5, 10**6, 10**7, 10**8, 10**9):
        masks = simhash.masks(count)
        shared = count / 2.0 ** np.bitwise_count(masks).min()
        assert len(masks) <= 70 and shared <= simhash.FULL * simhash.SHARD
    points = np.random.default_rng(2).integers(0, 2**64, 200_000, dtype=np.uint64)
    met = sum((np.unique(points & m, return_counts=True)[1] ** 2.0).sum() for m in simhash.masks(len(points)))
    # 149 038 each in the shards of a tree over all of them
    assert met / len(points) < 3000


def test_large_shards(monkeypatch):
    """Cut by a tree where that helps; a ball around one point stays whole."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    r = np.random.default_rng(3)
    points = r.integers(0, 2**64, 3000, dtype=np.uint64)
    points = np.unique(np.concatenate([points, apart(points[:900], 3, 4)]))
    parts = simhash.cut(points)
    assert len(parts) > 1 and len(np.unique(np.concatenate(parts))) == len(points)
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points) <= simhash.BITS, 1))
    assert len(i) >= 900
    held = [set(p.tolist()) for p in parts]
    for a, b in zip(points[i].tolist(), points[j].tolist()):
        assert any(a in p and b in p for p in held)
    ball = np.unique(apart(np.full(2000, points[0]), 2, 5))
    assert [len(p) for p in simhash.cut(ball)] == [len(ball)]
