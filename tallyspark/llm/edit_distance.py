"""Bounded edit distance of byte strings, banded and bit-parallel."""

from __future__ import annotations


def trimmed(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Without their common start and end, which no optimal alignment edits."""
    n = min(len(a), len(b))
    lo, hi = 0, n  # longest common prefix by bisection
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            lo = mid
        else:
            hi = mid - 1
    return a[:len(a) - lo], b[:len(b) - lo]


def edits(a: bytes, b: bytes, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is greater than ``most``.

    One column of the matrix is two bit vectors of vertical differences. Only
    the 2 * most + 1 diagonals that a distance of ``most`` can reach are kept, so
    the vectors have that many bits and move down one row with each column.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    a, b = trimmed(a, b)
    m, n = len(a), len(b)
    if not m:
        return n if n <= most else most + 1
    width = 2 * most + 1
    full = (1 << width) - 1
    rows: dict[int, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    # bit t at column j stands for row j - most + t, rows from 1; column 0
    # grows by one a row
    plus, minus = full ^ ((1 << most) - 1), 0
    # the distance on the band's last diagonal, then in the last row
    score = min(m, most)
    diagonal = 1 << (width - 1)
    for j in range(1, n + 1):
        shift = j - most - 1  # row of bit 0, from 0
        match = rows.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right = minus | (full & ~(zero | plus))
        left = zero & plus
        if j + most <= m:
            score += not zero & diagonal
        else:
            bit = 1 << (m - j + most)  # the last row, within the band
            score += bool(right & bit) - bool(left & bit)
        if j + most <= m and score - 2 * most > most:
            return most + 1
        down = zero >> 1
        plus = (left | (full & ~(down | right))) & full
        minus = down & right
    return min(score, most + 1)
