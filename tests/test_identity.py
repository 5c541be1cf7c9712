import random

import pytest

from photolake.operators import identity

PAIRS = "person_id long, cluster_id long, shared long, faces long"


def greedy(pairs):
    people, clusters, out = set(), set(), []
    for p, c, n, faces in sorted(pairs, key=lambda x: (-x[2], x[3], x[0], x[1])):
        if p not in people and c not in clusters:
            people.add(p)
            clusters.add(c)
            out.append((p, c, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_taken_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = [(p, c, rng.randint(1, 4), 5) for p in range(25) for c in range(25) if rng.random() < 0.3]
    found = identity.one_to_one(spark.createDataFrame(pairs, PAIRS))
    assert sorted((r.person_id, r.cluster_id, r.shared) for r in found.collect()) == greedy(pairs)


def test_a_chain_of_pairs_ends(spark):
    pairs = [(i // 2, (i + 1) // 2, 10 + i, 99) for i in range(40)]
    found = identity.one_to_one(spark.createDataFrame(pairs, PAIRS))
    assert sorted((r.person_id, r.cluster_id, r.shared) for r in found.collect()) == greedy(pairs)


def test_new_people_get_the_next_free_numbers(spark):
    members = spark.createDataFrame([("a", 7), ("b", 7), ("c", 3)], "key string, person_id long")
    grouped = spark.createDataFrame([("a", 2), ("b", 2), ("x", 0), ("y", 5), ("c", None), (None, 2)], "key string, cluster_id long")
    found = {r.cluster_id: (r.person_id, r.shared) for r in identity.lasting(members, grouped, "key").collect()}
    assert found == {2: (7, 2), 0: (8, None), 5: (9, None)}
    who = identity.lasting(members, grouped, "key")
    kept = {(r.key, r.person_id) for r in identity.remembered(members, grouped, who, "key").collect()}
    # the one that is in no cluster now is still remembered by its face
    assert kept == {("a", 7), ("b", 7), (None, 7), ("x", 8), ("y", 9), ("c", 3)}


def test_nobody_yet_and_nothing_grouped(spark):
    none = spark.createDataFrame([], "key string, person_id long")
    grouped = spark.createDataFrame([("a", 1), ("b", 0)], "key string, cluster_id long")
    assert {(r.cluster_id, r.person_id) for r in identity.lasting(none, grouped, "key").collect()} == {(0, 0), (1, 1)}
    assert identity.lasting(none, grouped.where("false"), "key").count() == 0
