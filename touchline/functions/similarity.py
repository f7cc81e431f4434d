"""String similarity in plain Python, for use inside Arrow-batched UDFs (Spark has Levenshtein only)."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyrö)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|); 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Indel ratio of the better of: shared tokens against either side, and the two sides as a whole.

    Shared tokens alone give 100 when one side's tokens are all within the other's. 0 if either side is empty.
    """
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both, only_a, only_b = sorted(sa & sb), sorted(sa - sb), sorted(sb - sa)
    if both and (not only_a or not only_b):
        return 100.0
    base, left, right = " ".join(both), " ".join(only_a), " ".join(only_b)
    with_a = f"{base} {left}".strip()
    with_b = f"{base} {right}".strip()
    best = indel_ratio(with_a, with_b)
    if base:
        best = max(best, indel_ratio(base, with_a), indel_ratio(base, with_b))
    return best


def edits(a: str, b: str, most: int = 99) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; ``most + 1`` once it is more.

    One row of the table is a pair of bit vectors (Hyyrö's scheme with transpositions): time is in proportion to b.
    Letters that both begin or end with cost nothing and are left out first.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    shorter = min(len(a), len(b))
    begin = 0
    while begin < shorter and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < shorter - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, diagonal, last, distance = full, 0, 0, 0, len(a)
    for ch in b:
        match = masks.get(ch, 0)
        swap = (((diagonal ^ full) & match) << 1) & last
        diagonal = ((((match & up) + up) ^ up) | match | down | swap) & full
        right_up, right_down = down | (full ^ (diagonal | up)), diagonal & up
        distance += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = ((right_up << 1) | 1) & full, (right_down << 1) & full
        up, down, last = right_down | (full ^ (diagonal | right_up)), right_up & diagonal, match
    return min(distance, most + 1)
