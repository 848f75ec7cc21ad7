import random

import pytest

from tidepanel.llm import sharding


@pytest.mark.parametrize("shards, nodes", [(8, 64), (512, 64), (1000, 64), (2000, 64), (256, 1), (1, 1)])
def test_every_key_gets_a_shard(shards, nodes):
    bits, owners = sharding.ring(shards, nodes)
    assert set(owners) == set(range(shards)) and len(owners) == 1 << bits
    rng = random.Random(shards)
    counts = {rng.randrange(len(owners)): rng.randint(1, 40) for _ in range(900)}
    total = sum(counts.values())
    plan = sharding.plan_arcs(counts, owners, sharding.capacities(total, shards, 0.0))
    assert sum(hi - lo for _, lo, hi, _, _ in plan) == total
    held = [0] * shards
    for _, lo, hi, shard, _ in plan:
        held[shard] += hi - lo
    assert max(held) - min(held) <= 1


def test_eight_shards_keep_their_ring():
    assert sharding.ring(8) == (sharding.RING_BITS, sharding.ring_owners(8))


def test_waiting_keys_are_an_error():
    with pytest.raises(ValueError):
        sharding.plan_arcs({0: 5}, [0, 0], [2, 3])
