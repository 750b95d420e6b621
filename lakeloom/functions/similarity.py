"""Similarity of words and texts, 0 to 100, as Arrow-batched functions over the longest common subsequence.

Texts are compared once per distinct pair of a batch, words are cut once per distinct text, and common subsequences are found for many
pairs at once: one step over the characters of the second texts moves the bit rows of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str, least: float = 0.0) -> int:
    """Length of the longest common subsequence, a machine word or more of positions at a time; -1 as soon as it cannot reach ``least``.

    After some letters of b, whatever front of a they went to, no more can follow than the shorter rest has.
    """
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    step, front = max(STEP, len(b) // 8), max(STEP, len(a) // 32)
    for t in range(0, len(b), step):
        for c in b[t : t + step]:
            hit = state & places.get(c, 0)
            state = (state + hit | state - hit) & full
        left = len(b) - t - step
        if least > 0 and left > 0 and t and not any(min(p + front, len(a)) - (state & ((1 << p + front) - 1)).bit_count() + min(len(a) - p, left) >= least for p in range(0, len(a), front)):
            return -1
    return len(a) - state.bit_count()


#: Pairs, and bytes of their bit tables, that are compared in one go.
PAIRS, TABLE_BYTES, LETTERS = 4096, 16 << 20, 64
#: Longer texts, in machine words of positions, and fewer pairs a word are compared one by one: their rows are wide enough by themselves.
WORDS, FEW = 16, 16
#: Letters after which it is seen whether the rest can still do.
STEP = 16


def common_lengths(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """common_length of every pair of two lists; -1 for some that cannot reach ``least``."""
    out = np.zeros(len(a), np.int64)
    both = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    lengths = np.array([[len(x), len(y)] for x, y in both]).reshape(-1, 2)
    words = (lengths[:, 0] + 63) // 64
    # Words beyond four are rounded up to an eighth of a power of two, so that more pairs go together.
    coarse = np.maximum(np.exp2(np.floor(np.log2(np.maximum(words, 1))) - 2).astype(np.int64), 1)
    words = (words + coarse - 1) // coarse * coarse
    asked = np.zeros(len(a)) if least is None else np.maximum(least - 1e-6, 0.0)
    # Pairs of as many words go together, by the length of the longer text, so that those that are through drop out in front.
    order = np.lexsort((lengths[:, 1], words))
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        upto = min(at + max(1, min(PAIRS, TABLE_BYTES // (8 * w * LETTERS))), int(np.searchsorted(words[order], w, side="right")))
        here = order[at:upto]
        if w > WORDS or len(here) < FEW * w:
            out[here] = [common_length(*both[i], asked[i]) for i in here]
        else:
            out[here] = _common([both[i][0] for i in here], [both[i][1] for i in here], lengths[here, 0], lengths[here, 1], w, asked[here])
        at = upto
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of codes in order, and for every code up to the largest its place among them; there is one more place for all others."""
    letters = np.flatnonzero(np.bincount(codes))
    place = np.full(int(letters[-1]) + 2 if len(letters) else 1, len(letters), np.int64)
    place[letters] = np.arange(len(letters))
    return letters, place


def _common(a: list[str], b: list[str], a_lengths: np.ndarray, b_lengths: np.ndarray, words: int, least: np.ndarray) -> np.ndarray:
    n, left = len(a), _codes(a)
    letters, place = _numbered(left)
    left, right = place[left], place[np.minimum(_codes(b), len(place) - 1)]
    # Bits of where each letter stands, by pair and letter; the last letter is every other one.
    row = np.repeat(np.arange(n), a_lengths)
    position = np.arange(len(left)) - np.repeat(np.cumsum(a_lengths) - a_lengths, a_lengths)
    where = np.zeros((words, n * (len(letters) + 1)), np.uint64)
    np.bitwise_or.at(where, (position // 64, row * (len(letters) + 1) + left), np.uint64(1) << (position % 64).astype(np.uint64))
    first = np.cumsum(b_lengths) - b_lengths
    base = np.arange(n) * (len(letters) + 1)
    state = np.full((words, n), ~np.uint64(0))
    out = np.zeros(n, np.int64)
    who, checked = np.arange(n), bool((least > 0).any())

    def used(some: slice | np.ndarray) -> np.ndarray:
        """Positions that are taken in every sixteenth part of a word, by pair."""
        quarters = np.bitwise_count(np.ascontiguousarray(state[:, some].T).view(np.uint16).reshape(-1, words * 4)).astype(np.int64)
        return np.where(np.arange(words * 4) * 16 < a_lengths[who[some], None], 16 - quarters, 0)

    i = 0
    while len(who):
        done = int(np.searchsorted(b_lengths[who], i, side="right"))
        if done:
            out[who[:done]] = used(slice(done)).sum(axis=1)
            who, state = who[done:], np.ascontiguousarray(state[:, done:])
        if checked and i and i % STEP == 0 and len(who):
            # Whatever front of a the letters went to, no more can follow than the shorter rest has.
            rest = np.minimum(np.maximum(a_lengths[who, None] - 16 * np.arange(words * 4), 0), (b_lengths[who] - i)[:, None])
            able = (np.cumsum(used(slice(None)), axis=1) + rest).max(axis=1) >= least[who]
            out[who[~able]] = -1
            who, state = who[able], np.ascontiguousarray(state[:, able])
            if len(who) < FEW:
                out[who] = [common_length(a[k], b[k], least[k]) for k in who.tolist()]
                break
        if not len(who):
            break
        upto = min(int(b_lengths[who[0]]), i // STEP * STEP + STEP) if checked else int(b_lengths[who[0]])
        rows, starts = base[who], first[who]
        for k in range(i, upto):
            at = rows + right[starts + k]
            carry = None
            for w in range(words):
                row_state = state[w]
                hit = row_state & where[w, at]
                grown = row_state + hit
                if words > 1:
                    over = grown < hit
                    if carry is not None:
                        grown += carry
                        over |= grown < carry
                    carry = over.astype(np.uint64)
                np.bitwise_or(grown, row_state ^ hit, out=row_state)
        i = upto
    return out


def indel(a: str, b: str) -> float:
    """Twice the common length over both lengths; two empty texts are equal."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def token_sort(a: str, b: str) -> float:
    """indel of the words in order; an empty side is 0."""
    if not a.split() or not b.split():
        return 0.0
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of comparing the words that differ, with and without those that both have; an empty side is 0."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not x or not y):
        return 100.0
    s = len(" ".join(sorted(shared)))
    away = len(x) + len(y) - 2 * common_length(x, y)
    with_x, with_y = s + (s > 0) + len(x), s + (s > 0) + len(y)
    best = 100.0 * (1 - away / (with_x + with_y))
    if s:
        best = max(best, 100.0 * (1 - (1 + len(x)) / (s + with_x)), 100.0 * (1 - (1 + len(y)) / (s + with_y)))
    return best


def partial(a: str, b: str) -> float:
    """Best indel of the shorter text with any stretch of the longer that is no longer than it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    n = len(short)
    starts = range(-n + 1, len(long))
    return max(indel(short, long[max(0, i) : i + n]) for i in starts)


def weighted(a: str, b: str) -> float:
    """The best of whole, sorted, set and, for texts of unlike length, partial comparison, each at its own scale."""
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    best = indel(a, b)
    if ratio < 1.5:
        return max(best, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if ratio <= 8 else 0.6
    words = 100.0 if set(a.split()) & set(b.split()) else partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(best, scale * partial(a, b), 0.95 * scale * words)


def letters_in_common(a: list[str], b: list[str]) -> np.ndarray:
    """How many letters two texts share in any order: no common subsequence is longer."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        codes = np.concatenate((_codes(x), _codes(y)))
        letters, place = _numbered(codes)
        codes = place[codes]
        row = np.repeat(np.arange(2 * len(x)), [len(t) for t in (*x, *y)])
        counts = np.bincount(row * max(len(letters), 1) + codes, minlength=2 * len(x) * max(len(letters), 1)).reshape(2 * len(x), -1)
        out[at : at + PAIRS] = np.minimum(counts[: len(x)], counts[len(x) :]).sum(axis=1)
    return out


def _common_from(a: list[str], b: list[str], least: np.ndarray | None) -> np.ndarray:
    """common_lengths, and -1 for pairs that cannot reach ``least``."""
    if least is None:
        return common_lengths(a, b)
    out = np.full(len(a), -1, np.int64)
    hopeful = np.flatnonzero(letters_in_common(a, b) >= least - 1e-6)
    out[hopeful] = common_lengths([a[i] for i in hopeful], [b[i] for i in hopeful], least[hopeful])
    return out


def indels(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """indel of every pair; not a number where it cannot reach ``least``."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    common = _common_from(a, b, None if least is None else least * total / 200)
    return np.where(total == 0, 100.0, np.where(common < 0, np.nan, 200.0 * common / np.maximum(total, 1)))


def token_sorts(a: list[str], b: list[str], least: np.ndarray | None = None, known: dict | None = None) -> np.ndarray:
    """token_sort of every pair; not a number where it cannot reach ``least``. ``known`` keeps texts whose words are in order from call to call."""
    words = {} if known is None else known
    words.update((t, " ".join(sorted(t.split()))) for t in {*a, *b} if t not in words)
    x, y = [words[t] for t in a], [words[t] for t in b]
    empty = np.array([not p or not q for p, q in zip(x, y, strict=True)], bool)
    return np.where(empty, 0.0, indels(x, y, least))


def token_sets(a: list[str], b: list[str], least: np.ndarray | None = None, known: dict | None = None) -> np.ndarray:
    """token_set of every pair; not a number where it cannot reach ``least``. ``known`` keeps texts that are cut into words from call to call."""
    words = {} if known is None else known
    for t in {*a, *b}:
        if t not in words:
            each = frozenset(t.split())
            words[t] = each, sum(map(len, each))
    out, at, found = np.zeros(len(a)), [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        (left, m), (right, n) = words[p], words[q]
        if not left or not right:
            continue
        shared = left & right
        k = len(shared)
        if k and (k == len(left) or k == len(right)):
            out[i] = 100.0
            continue
        # Lengths of the words that differ, and of the shared ones, with their blanks: no text is made of them yet.
        letters = sum(map(len, shared))
        at.append(i)
        found.append((m - letters + len(left) - k - 1, n - letters + len(right) - k - 1, letters + max(0, k - 1)))
    if at:
        x, y, s = np.array(found).T
        with_x, with_y = s + (s > 0) + x, s + (s > 0) + y
        need = None if least is None else (x + y - (1 - least[at] / 100) * (with_x + with_y)) / 2
        # No common subsequence is longer than the shorter text.
        hopeful = np.arange(len(at)) if need is None else np.flatnonzero(np.minimum(x, y) >= need - 1e-6)
        sides = [(words[a[at[h]]][0], words[b[at[h]]][0]) for h in hopeful]
        common = np.full(len(at), -1, np.int64)
        common[hopeful] = _common_from([" ".join(sorted(p - q)) for p, q in sides], [" ".join(sorted(q - p)) for p, q in sides], None if need is None else need[hopeful])
        apart = np.where(common < 0, np.nan, 100.0 * (1 - (x + y - 2 * common) / (with_x + with_y)))
        shared_first = np.where(s > 0, np.maximum(100.0 * (1 - (1 + x) / np.maximum(s + with_x, 1)), 100.0 * (1 - (1 + y) / np.maximum(s + with_y, 1))), np.nan)
        best = np.fmax(apart, shared_first)
        out[at] = best if least is None else np.where(best >= least[at] - 1e-6, best, np.nan)
    return out


def weighteds(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """weighted of every pair."""
    return np.array([weighted(x, y) for x, y in zip(a, b, strict=True)], float)


def _scored(score: Callable[..., np.ndarray], a: pd.Series, b: pd.Series, least: pd.Series | None = None) -> pd.Series:
    """Scores of pairs, each distinct one computed once; null for null texts and for pairs that cannot reach the least score asked."""
    pairs = list(zip(a, b, strict=True))
    asked: dict[tuple[str, str], float] = {}
    for p, x in zip(pairs, [0.0] * len(pairs) if least is None else least.fillna(0.0), strict=True):
        if p[0] is not None and p[1] is not None:
            asked[p] = min(asked.get(p, x), x)
    known = dict(zip(asked, score([x for x, _ in asked], [y for _, y in asked], None if least is None else np.array(list(asked.values()))).tolist(), strict=True)) if asked else {}
    # pandas reads not-a-number as null here, as it does None.
    return pd.Series([known.get(p) for p in pairs], dtype="float64")


def _batched(score: Callable[..., np.ndarray]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _scored(score, a, b)

    return F.pandas_udf(run, T.DoubleType())


def _batched_from(score: Callable[..., np.ndarray]) -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    def run(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
        return _scored(score, a, b, least)

    return F.pandas_udf(run, T.DoubleType())


indel_ratio = _batched(indels)
token_sort_ratio = _batched(token_sorts)
token_set_ratio = _batched(token_sets)
weighted_ratio = _batched(weighteds)

#: The text similarity of each matching mode.
SCORERS = {"set": token_set_ratio, "sort": token_sort_ratio}
#: The same, null where the third column, the least ratio that matters, cannot be reached.
SCORERS_FROM = {"set": _batched_from(token_sets), "sort": _batched_from(token_sorts)}
