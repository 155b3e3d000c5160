"""Invariants on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators import people


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.floats(0, 1)), max_size=25), st.integers(0, 2))
def test_a_plan_partitions_the_pending_faces(faces, known):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pending = [(i, base[g], q) for i, (g, q) in enumerate(faces)]
    plan = people.plan_clusters(pending, [], [(p, p == 0, base[p], 4) for p in range(known)], {}, set())
    seen = [f for f, _ in plan["assign"]] + [f for c in plan["create"] for f in c] + plan["dormant"]
    assert sorted(seen) == list(range(len(faces)))
    assert all(len(c) >= people.LEAST_FACES for c in plan["create"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.data())
def test_rejected_people_never_get_the_face(groups, data):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rejected = {i: data.draw(st.sets(st.integers(0, 5))) for i in range(len(groups))}
    plan = people.plan_clusters([(i, base[g], 0.9) for i, g in enumerate(groups)], [], [(p, True, base[p], 4) for p in range(6)], rejected, set())
    assert all(p not in rejected[f] for f, p in plan["assign"])
