"""Recompression grammars of integer sequences, and longest common extensions on them.

A grammar is a list of levels.  Level 0 is the sequence; each further level replaces either every block of
equal neighbours by one symbol (block compression) or every pair of a left symbol followed by a right
symbol by one symbol, each symbol being left or right by a drawn bit (pair compression).  Levels alternate until all
symbols of the top differ.  Equal symbols of a level stand for equal stretches, so two places are compared
by climbing while whole symbols agree and coming down inside the first two that don't; each level costs at
most one step up and one down.  Bits only shape the grammar; answers are exact.

Everything works on arrays of queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class Level:
    symbols: np.ndarray          # of this level
    first: np.ndarray            # place of each symbol's first child in the level below (one more at the end)
    start: np.ndarray            # place in the sequence (one more at the end)
    blocks: bool                 # made by block compression
    parent: np.ndarray | None = None   # place of the parent in the level above


def _named(key: np.ndarray) -> tuple[np.ndarray, int]:
    codes, uniques = pd.factorize(key)
    return codes.astype(np.int64), len(uniques)


def grammar(sequence: np.ndarray, seed: int = 1) -> list[Level]:
    """Levels of a sequence of integers >= 0 (at least one)."""
    draw = np.random.default_rng(seed)
    symbols, names = _named(np.asarray(sequence, dtype=np.int64))
    places = np.arange(len(symbols) + 1)
    levels = [Level(symbols, places, places, False)]
    blocks = True
    while names < len(symbols):
        if blocks:
            heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            runs = np.diff(np.r_[heads, len(symbols)])
            key = symbols[heads] * (int(runs.max()) + 1) + runs
        else:
            left = draw.integers(0, 2, names, dtype=np.int8)[symbols].astype(bool)
            second = np.r_[False, left[:-1] & ~left[1:]]
            heads = np.flatnonzero(~second)
            tail = np.minimum(heads + 1, len(symbols) - 1)
            paired = second[tail] & (heads + 1 < len(symbols))
            key = symbols[heads] * (names + 1) + np.where(paired, symbols[tail] + 1, 0)
        if len(heads) < len(symbols):
            first = np.r_[heads, len(symbols)]
            below = levels[-1]
            below.parent = np.repeat(np.arange(len(heads)), np.diff(first))
            symbols, names = _named(key)
            levels.append(Level(symbols, first, below.start[first], blocks))
        blocks = not blocks
    return levels


def extend_right(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that starts at places i and j (i < j <= length)."""
    return _extend(levels, i, j, True)


def extend_left(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that ends before places i and j (0 <= i < j)."""
    return _extend(levels, i, j, False)


def _extend(levels: list[Level], i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
    """Places a < b are those of the next symbols to compare: to the right of i and j, or to their left."""
    n = len(levels[0].symbols)
    origin = np.asarray(j if right else i, dtype=np.int64)
    a, b = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    if not right:
        a, b = a - 1, b - 1
    ends = origin.copy()                         # the place of the mismatch on the side that meets the end first
    turned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero((b < n) if right else (a >= 0))
    a, b = a[live], b[live]
    for level, up in zip(levels, levels[1:] + [None]):
        s = level.symbols
        differ = s[a] != s[b]
        if up is None:
            turned.append((live, a, b))          # all symbols of the top differ
            break
        out_live, out_a, out_b = live[differ], a[differ], b[differ]
        live, a, b = live[~differ], a[~differ], b[~differ]
        pa, pb = level.parent[a], level.parent[b]
        if right:
            whole = (up.first[pa] == a) & (up.first[pb] == b)
            ra, rb = up.first[pa + 1] - a, up.first[pb + 1] - b
        else:
            whole = (up.first[pa + 1] - 1 == a) & (up.first[pb + 1] - 1 == b)
            ra, rb = a - up.first[pa] + 1, b - up.first[pb] + 1
        step = np.where(whole, 0, np.minimum(ra, rb))
        a, b = (a + step, b + step) if right else (a - step, b - step)
        over = (b >= len(s)) if right else (a < 0)
        # Unlike rests of a block: the next symbols differ on this level.
        here = ~whole & (ra != rb) & ~over
        turned.append((np.r_[out_live, live[here]], np.r_[out_a, a[here]], np.r_[out_b, b[here]]))
        ends[live[over]] = n if right else 0
        go = ~here & ~over
        live, a, b = live[go], level.parent[a[go]], level.parent[b[go]]
        if not len(live):
            break
    # Down again, from the highest level at which something differed.
    live, a, b = turned.pop()
    for depth in range(len(turned), 0, -1):
        level, below = levels[depth], levels[depth - 1]
        a, b = (level.first[a], level.first[b]) if right else (level.first[a + 1] - 1, level.first[b + 1] - 1)
        if level.blocks:
            pa, pb = below.parent[a], below.parent[b]
            step = np.minimum(level.first[pa + 1] - level.first[pa], level.first[pb + 1] - level.first[pb])
        else:
            step = 1
        step = np.where(below.symbols[a] == below.symbols[b], step, 0)
        a, b = (a + step, b + step) if right else (a - step, b - step)
        over = (b >= len(below.symbols)) if right else (a < 0)
        ends[live[over]] = n if right else 0
        more_live, more_a, more_b = turned[depth - 1]
        live = np.r_[live[~over], more_live]
        a, b = np.r_[a[~over], more_a], np.r_[b[~over], more_b]
    if right:
        ends[live] = levels[0].start[b]
        return ends - origin
    ends[live] = a + 1
    return origin - ends
