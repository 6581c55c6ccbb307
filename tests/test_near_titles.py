import random

from cadenza.operators import titles


def test_sets_far_apart_are_not_compared_by_tokens(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    sets = [rng.sample(words, 60) for _ in range(200)]
    sets.append(sets[7][:58] + ["a", "b"])
    looked = []
    real = titles._similar
    monkeypatch.setattr(titles, "_similar", lambda pairs, *rest: looked.append(pairs.count()) or real(pairs, *rest))
    frame = spark.createDataFrame(list(enumerate(sets)), "pos bigint, tokens array<string>")
    got = {r.pos for r in titles.near_duplicates(frame, "pos", "tokens").collect() if r.duplicate}
    assert got == {200}
    assert sum(looked) < 20


def test_sets_on_both_sides_of_the_wide_sketch_match_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    sets = [rng.sample(words, n) for n in (880, 900, 901, 1000, 2500)]
    for base in list(sets):
        for share in (0.08, 0.075, 0.2):
            copy = [w for w in base if rng.random() > share] + [f"x{rng.random()}" for _ in range(int(share * len(base) / 3))]
            sets.insert(rng.randrange(len(sets) + 1), copy)
    frame = spark.createDataFrame(list(enumerate(sets)), "pos bigint, tokens array<string>")
    got = {r.pos: r.duplicate for r in titles.near_duplicates(frame, "pos", "tokens").collect()}
    whole = [set(s) for s in sets]
    want = {i: any(len(a & b) >= 0.85 * len(a | b) for b in whole[:i]) for i, a in enumerate(whole)}
    assert got == want and any(want.values()) and not all(want.values())
