"""Shards that are left to evolution."""

import pandas as pd

from sparkloom.llm import packing


def test_least_number_of_containers_alone_does_not_end_a_shard():
    shards = {1: [6, 5, 3, 3], 2: [7, 4, 3, 2], 3: [10, 10, 5], 4: [6, 6, 6]}
    batch = pd.DataFrame([("p", 10, k, pd.Series(s).to_numpy()) for k, s in shards.items()], columns=["pack_name", "capacity", "shard", "sizes"])
    first = next(packing._first_fit(iter([batch])))
    done = dict(zip(first["shard"], first[packing.NAMES[-1]], strict=True))
    assert done == {1: False, 2: True, 3: True, 4: False}
