"""difflib's matching runs of two sequences without junk, by substring search."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: a run of more than so many items is looked for by its last ones first
TAIL = 16


def runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """(i, j, n) in no order: the longest common run, the first in a and then in b, and the same on both sides of it.

    A run longer than the longest so far is looked for as a substring from each place of a.
    """
    left, out = [(0, len(a), 0, len(b))], []
    while left:
        alo, ahi, blo, bhi = left.pop()
        n, i, most = 0, alo, min(ahi - alo, bhi - blo)
        while n < most and i + n < ahi:
            if n >= TAIL and b.find(a[i + n + 1 - TAIL : i + n + 1], blo, bhi) < 0:
                i += n + 2 - TAIL  # no run with this tail in it
                continue
            at = b.find(a[i : i + n + 1], blo, bhi)
            if at < 0:
                i += 1
                continue
            n += 1
            while i + n < ahi and at + n < bhi and a[i + n] == b[at + n]:
                n += 1
            ai, bi = i, at
        if n:
            out.append((ai, bi, n))
            if ai > alo and bi > blo:
                left.append((alo, ai, blo, bi))
            if ai + n < ahi and bi + n < bhi:
                left.append((ai + n, ahi, bi + n, bhi))
    return out


def as_text(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[str, str]:
    """Both sequences with a character for each distinct item, of which there can be 1,114,112."""
    names: dict[Hashable, str] = {}
    return tuple("".join([names.get(x) or names.setdefault(x, chr(len(names))) for x in part]) for part in (a, b))


def blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(runs(*as_text(a, b))):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """SequenceMatcher(None, a, b, autojunk=False).get_opcodes()."""
    out, i, j = [], 0, 0
    for ai, bj, n in blocks(a, b):
        tag = "replace" if i < ai and j < bj else "delete" if i < ai else "insert" if j < bj else ""
        if tag:
            out.append((tag, i, ai, j, bj))
        i, j = ai + n, bj + n
        if n:
            out.append(("equal", ai, i, bj, j))
    return out


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """SequenceMatcher(None, a, b, autojunk=False).ratio()."""
    both = len(a) + len(b)
    x, y = (a, b) if isinstance(a, str) and isinstance(b, str) else as_text(a, b)
    return 2.0 * sum(n for _, _, n in runs(x, y)) / both if both else 1.0
