"""Phrases that repeat in a row and lines that stand often, in time that grows with a text's length.

A phrase without its white space is met again at one distance, as often as it repeats. So texts are laid out without white space, and for each distance only
places are looked at of which every long enough run holds one; what agrees there is compared whole, with the white space.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

#: A phrase's characters, and how often it stands in a row.
LEAST, MOST, TIMES = 4, 80, 6
#: Characters that are laid out together, cells that are compared together, and characters whose hash is looked at for a distance of LEAST or more.
CHARACTERS, CELLS, WIDTH = 1 << 19, 1 << 20, 8
_BLANK = " \t\n\v\f\r"
_LINE = re.compile("\r\n|[\n\v\f\r\x85  ]")
#: No character of a text: what stands between texts, all different.
_NONE, _EDGE = 0x110000, MOST * TIMES * 2


def many_equal_lines(text: str, least: int = 4) -> bool:
    """Whether a line of three characters or more stands so often, blanks at its ends aside."""
    lines = _LINE.split(text)
    if len(lines) < least:
        return False
    seen = Counter(line for x in lines if len(line := x.strip(_BLANK)) >= 3)
    return max(seen.values(), default=0) >= least


def repeats(texts: list[str]) -> np.ndarray:
    """Whether each text matches (?s)(.{4,80}?)(?:\\s*\\1){5}."""
    out, start, size = np.zeros(len(texts), bool), 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARACTERS or i + 1 == len(texts):
            out[start : i + 1] = _repeats(texts[start : i + 1])
            start, size = i + 1, 0
    return out


def _repeats(texts: list[str]) -> np.ndarray:
    ends = np.cumsum([len(x) + 1 for x in texts]) + _EDGE
    codes = np.concatenate([np.zeros(_EDGE, np.uint32), np.frombuffer("".join(x + "\0" for x in texts).encode("utf-32-le"), np.uint32), np.zeros(_EDGE, np.uint32)])
    between = np.concatenate([np.arange(_EDGE), ends - 1, np.arange(len(codes) - _EDGE, len(codes))])
    codes[between] = _NONE + np.arange(len(between), dtype=np.uint32)
    at = np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 13)))
    s, found = codes[at], np.zeros(len(texts), bool)
    white = np.diff(at) - 1
    text_of = lambda k: np.searchsorted(ends, at[k], "right")
    gap = lambda k: codes[at[k] + 1 : at[k + 1]].tobytes().decode("utf-32-le")

    # phrases of white space alone: the first four characters of one are a phrase as well
    for k in np.flatnonzero(white >= LEAST * TIMES).tolist():
        run = gap(k)
        if any(run.count(g) >= TIMES for g in {run[i : i + LEAST] for i in range(len(run) - LEAST + 1)}):
            found[np.searchsorted(ends, at[k] + 1, "right")] = True

    # white space behind each character, as a number
    h = np.zeros(len(s), np.uint32)
    one = np.flatnonzero(white == 1)
    h[one] = codes[at[one] + 1]
    numbers: dict[str, int] = {}
    for k in np.flatnonzero(white > 1).tolist():
        h[k] = _NONE + numbers.setdefault(gap(k), len(numbers))

    mixed = s
    for k in (1, 2, 4):
        mixed = mixed[:-k] * np.uint32(0x9E3779B1) + mixed[k:]
        mixed ^= mixed >> np.uint32(15)
    for d in range(1, MOST + 1):
        run = (TIMES - 1) * d  # places that equal the one d further on
        if d < LEAST:
            k = np.arange(_EDGE // 2, len(s) - _EDGE // 2, run)
            k = k[(s[k] == s[k + d]) & (at[k + d] - at[k] >= LEAST)]
        else:
            step = run - WIDTH + 1
            x = mixed[_EDGE // 2 : len(mixed) - _EDGE // 2]
            k = _EDGE // 2 + step * np.flatnonzero(x[: len(x) - d : step] == x[d::step][: -(-(len(x) - d) // step)])
        many = max(1, CELLS // (2 * run))
        while len(k):
            k = k[~found[np.minimum(text_of(k), len(texts) - 1)]]
            part, k = k[:many], k[many:]
            for j in _phrases(part, s, h, at, d):
                text = int(text_of(j))
                if not found[text] and (at[j + d - 1] - at[j] + 1 >= LEAST or _padded(j, d, at, gap)):
                    found[text] = True
    return found


def _phrases(k: np.ndarray, s: np.ndarray, h: np.ndarray, at: np.ndarray, d: int) -> list[int]:
    """Places whose next d characters stand TIMES times, with equal white space within; of runs that hold one of the places k."""
    run = (TIMES - 1) * d
    cells = k[:, None] + np.arange(1 - run, run)
    unlike = np.zeros((len(k), 2 * run), np.int32)
    np.cumsum(s[cells] != s[cells + d], axis=1, out=unlike[:, 1:])
    same = unlike[:, run:] == unlike[:, :-run]  # by place where the run begins
    some = same.any(axis=1)
    if not some.any():
        return []
    k, same, cells = k[some], same[some], cells[some]
    other = h[cells] != h[cells + d]
    unlike = np.zeros((len(k), 2 * run), np.int32)
    np.cumsum(other, axis=1, out=unlike[:, 1:])
    within = unlike[:, run - 1 : -1] - unlike[:, :-run]
    for c in range(TIMES - 2):  # white space between phrases may differ
        within = within - other[:, d - 1 + c * d :][:, :run]
    begin = cells[:, :run]
    return np.unique(begin[same & (within == 0) & (at[begin + d - 1] - at[begin] < MOST)]).tolist()


def _padded(j: int, d: int, at: np.ndarray, gap) -> bool:
    """Whether white space around a phrase of too few characters, the same each time, makes it long enough."""
    core = int(at[j + d - 1] - at[j] + 1)
    inner = [gap(j + c * d - 1) for c in range(1, TIMES)]
    before, after = [gap(j - 1), *inner], [*inner, gap(j + TIMES * d - 1)]
    lead = next(n for n in range(LEAST, -1, -1) if all(len(x) >= n and x[len(x) - n :] == before[0][len(before[0]) - n :] for x in before))
    trail = next(n for n in range(LEAST, -1, -1) if all(len(x) >= n and x[:n] == after[0][:n] for x in after))
    return core + min(lead + trail, min(map(len, inner))) >= LEAST
