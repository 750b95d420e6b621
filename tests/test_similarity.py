import random

import pytest

from lakeloom.functions import similarity as S


def plain(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            rows[j], last = (last + 1 if x == y else max(rows[j], rows[j - 1])), rows[j]
    return rows[-1]


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcä ", k=rng.randint(0, 90))) for _ in range(2))
        assert S.common_length(a, b) == plain(a, b)


@pytest.mark.parametrize(("a", "b", "low", "high"), [("same song", "sane sang", 75, 80), ("alpha bravo charlie delta", "alpha bravo echo foxtrot", 65, 66.5), ("ангил", "воскресный ангел", 38, 38.2), ("a b", "b a c", 100, 100), ("", "x", 0, 0)])
def test_token_set(a, b, low, high):
    assert low <= S.token_set(a, b) <= high


def test_weighted_anchors():
    assert S.weighted("fuzzy", "fuzzy band plays a song of old times") == pytest.approx(90)
    assert S.weighted("band fuzzy", "fuzzy band") == pytest.approx(95)
    assert S.weighted("ангил", "воскресный ангел") >= 70


def test_token_sort():
    assert S.token_sort("b a", "a b") == 100 and S.token_sort("", "") == 0


def test_batches_equal_single_pairs():
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdéж", k=rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 3, 30])))
    a, b = [text() for _ in range(400)], [text() for _ in range(400)]
    a += ["x" * 64, "x" * 65, "ab" * 64, "", "same words", "b a"]
    b += ["x" * 64, "x" * 130, "ba" * 64, "", "words same too", "a b"]
    for many, one in ((S.common_lengths, S.common_length), (S.indels, S.indel), (S.token_sorts, S.token_sort), (S.token_sets, S.token_set)):
        want = [one(x, y) for x, y in zip(a, b)]
        assert list(many(a, b)) == pytest.approx(want), one
        if one is not S.common_length:
            least = S.np.array([rng.choice([0, 40, 60, 90]) for _ in a], float)
            for got, x, bound in zip(many(a, b, least), want, least):
                assert got == pytest.approx(x) if x >= bound else S.np.isnan(got) or got == pytest.approx(x)


def test_pairs_are_given_up_only_below_what_is_asked():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    a = [word(rng.randint(0, 500)) for _ in range(300)]
    b = [word(rng.randint(0, 500)) if i % 2 else "".join(c for c in t if rng.random() > 0.1) for i, t in enumerate(a)]
    want = [S.common_length(x, y) for x, y in zip(a, b)]
    for share in (0.7, 1, 1.2):
        least = S.np.array(want) * share
        one = [S.common_length(x, y, n) for x, y, n in zip(a, b, least)]
        for got in (one, list(S.common_lengths(a, b, least))):
            assert all(g == w or (g == -1 and w < n) for g, w, n in zip(got, want, least))
            assert share <= 1 or -1 in got
