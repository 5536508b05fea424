import random
import time

import numpy as np
import pytest

from ampliq.functions.align import _place_far, _place_near, _reaches, place
from ampliq.functions.iupac import all_equal, composition_bounds, distance, distances, equal_letters, gram_bounds, locate, nearest_of, one_to_many, profiles

RULES = ["exact", "base", "overlap"]


def same(x, y, equal):
    return x == y or x in equal.get(y, "")


def slow(a, b, equal, infix=False):
    row = [0] * (len(b) + 1) if infix else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same(x, y, equal))))
        row = new
    return min(row) if infix else row[-1]


def word(rnd, letters="ACGTNRY", most=30):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))


@pytest.mark.parametrize("rule", RULES)
def test_distance_equals_dynamic_programming(rule):
    rnd, equal = random.Random(1), equal_letters(rule)
    for _ in range(300):
        a, b = word(rnd), word(rnd)
        d = slow(a, b, equal)
        assert distance(a, b, equal) == d
        x, y = [a.encode()], [b.encode()]
        assert all_equal(x, y, equal)[0] == (d == 0)
        assert composition_bounds(x, y)[0] <= d
        assert gram_bounds(x, y)[0] <= d
        if len(a) <= len(b):
            assert distance(a, b, equal, infix=True) == slow(a, b, equal, infix=True)


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("infix", [False, True])
def test_many_pairs_at_once(rule, infix):
    """Short and long pairs, near and far, on both sides of word borders, against one pair at a time and the plain recurrence."""
    rnd, equal = random.Random(7), equal_letters(rule)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choices("ACGTNRY-", weights=[9, 9, 9, 9, 1, 1, 1, 1], k=rnd.choice([0, 1, 5, 20, 63, 64, 65, 127, 128, 130, 300])))
        b = list(a)
        for _ in range(rnd.choice([0, 1, 3, 40])):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["", "A", "CG", "N"])
        b = "".join(b) if rnd.random() < 0.8 else word(rnd, most=200)
        pairs.append((a, b) if not infix or len(a) <= len(b) else (b, a))
    x, y = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
    want = [distance(a, b, equal, infix) for a, b in pairs]
    assert want[:60] == [slow(a, b, equal, infix) for a, b in pairs[:60]]
    assert distances(x, y, equal, infix).tolist() == want
    limit = np.array([rnd.choice([0, 1, 2, 5, 30, 1000]) for _ in pairs])
    got = distances(x, y, equal, infix, limit)
    assert got.tolist() == [min(d, k + 1) for d, k in zip(want, limit.tolist())]
    long = [(w * 700).encode() for w in ("ACGT", "ACGA")]
    assert distances(long[:1], long[1:], {}).tolist() == [distance("ACGT" * 700, "ACGA" * 700, {})]
    assert distances([], [], equal).tolist() == []


def test_one_text_and_many():
    """Only cells near the diagonal are worked out and hopeless texts leave early; within the limit every distance is the true one."""
    rnd, equal = random.Random(10), equal_letters("base")
    for n in (0, 1, 63, 64, 65, 129, 300):
        pattern = "".join(rnd.choices("ACGTN", [9, 5, 5, 9, 1], k=n))
        texts = ["".join(rnd.choice(["", c, c, c, "AC", "N"]) if rnd.random() < share else c for c in pattern) for share in (0, 0.1, 0.5, 1) for _ in range(9)]
        texts += ["".join(rnd.choices("ACGT", k=rnd.randrange(400))) for _ in range(30)] + [""]
        x = [t.encode() for t in texts]
        want = distances([pattern.encode()] * len(x), x, equal)
        for limit in (0, 2, 20, 80, 1 << 30):
            assert one_to_many(pattern.encode(), x, limit, equal).tolist() == np.minimum(want, limit + 1).tolist()
        for near in (False, True):
            which, dist = nearest_of(pattern.encode(), x, profiles(x), 5, 500, near, equal)
            assert dist.tolist() == want[which].tolist() and sorted(dist.tolist())[:5] == np.sort(want)[:5].tolist()


def test_gram_bounds_of_many_pairs():
    rnd, equal = random.Random(9), equal_letters("base")
    roots = [word(rnd, "ACGT", 80) for _ in range(9)]
    pairs = [(rnd.choice(roots), "".join(rnd.choice(["", "A", "N", c, c, c, c, c, c]) for c in rnd.choice(roots))) for _ in range(200)]
    bound = gram_bounds([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs])
    want = [distance(a, b, equal) for a, b in pairs]
    assert all(low <= d for low, d in zip(bound.tolist(), want)) and sum(2 * low > d for low, d in zip(bound.tolist(), want)) > 20


def test_equality_rules():
    assert "R" in equal_letters("base")["A"] and "N" not in equal_letters("base").get("R", "")
    assert "N" in equal_letters("overlap")["R"] and "Y" not in equal_letters("overlap")["R"]


def test_locate_finds_the_first_best_end_and_the_longest_span():
    rnd, equal = random.Random(2), equal_letters("base")
    texts = [word(rnd, "ACGT", 40) for _ in range(200)] + ["GGACGTACGG"]
    width = 40
    grid = np.frombuffer(b"".join(t.encode().ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
    pattern = "ACRTAC"
    d, s, e = locate(pattern, grid, np.array([len(t) for t in texts]), equal)
    for i, text in enumerate(texts):
        best = slow(pattern, text, equal, infix=True)
        assert d[i] == min(best, len(pattern))
        if best < len(pattern):
            ends = [j for j in range(len(text)) if min(slow(pattern, text[k : j + 1], equal) for k in range(j + 2)) == best]
            assert e[i] == ends[0]
            starts = [k for k in range(ends[0] + 2) if slow(pattern, text[k : ends[0] + 1], equal) == best]
            assert s[i] == starts[0]
    assert (d[-1], s[-1], e[-1]) == (0, 2, 7)


def test_place_is_an_optimal_alignment():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = word(rnd, "ACGT"), word(rnd, "ACGT")
        bases, inserts = place(a, b)
        assert len(bases) == len(b)
        cost = sum(x != y for x, y in zip(bases, b)) + sum(map(len, inserts.values()))
        assert cost == slow(a, b, {})
        back = "".join(inserts.get(i, "") + (bases[i] if i < len(b) else "") for i in range(len(b) + 1)).replace("-", "")
        assert back == a


def test_place_of_texts_that_are_alike_takes_the_same_path():
    rnd, near = random.Random(4), 0
    for _ in range(3000):
        a = word(rnd, rnd.choice(["A", "AC", "ACGT"]), 60)
        b = "".join(rnd.choice(["", "A", "CG"]) if rnd.random() < 0.1 else c for c in a)
        reaches = _reaches(b, a, 30) if a else None
        if reaches is not None:
            near += 1
            assert _place_near(b, a, reaches) == _place_far(b, a)
    assert near > 2000


def test_long_texts_that_are_alike_are_placed_at_once():
    a = "".join(random.Random(5).choices("ACGT", k=200_000))
    b = a[:70_000] + "T" + a[70_001:150_000] + a[150_001:]
    start = time.perf_counter()
    bases, inserts = place(b, a)
    # All columns as bits would take gigabytes and minutes.
    assert time.perf_counter() - start < 5 and len(bases) == len(a) and not inserts and bases.count("-") == 1
