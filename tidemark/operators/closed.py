"""Closed answers in free text: one letter, verdicts, pairs, parts. Each reader gives a canonical text, or null.

Arrow functions, for one reading is tried after another and later ones depend on what earlier ones found.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for verdicts.
TRUE, FALSE = ("p", "prawda", "prawdziwe", "true"), ("f", "fałsz", "fałszywe", "false")


def one_letter(text: str | None, letters: str) -> str | None:
    """The letter that an answer names: alone, after a word that announces it, or at the beginning of exactly one line."""
    t = (text or "").strip()
    m = re.fullmatch(rf"\W*([{letters}{letters.lower()}])\W*", t)
    if m:
        return m[1].upper()
    said = re.findall(rf"(?i:odpowied[źz]\w*|wybieram|answer)\s*(?:to|jest|is)?\s*[:\-–]?\s*\(?([{letters}])\b", t)
    if said:
        return said[-1] if len(set(said)) == 1 else None
    begun = set(re.findall(rf"(?m)^\s*\(?([{letters}])[).:]", t))
    return begun.pop() if len(begun) == 1 else None


def verdicts(text: str | None, n: int) -> str | None:
    """n verdicts: numbered ones, else a bare sequence of exactly n."""
    t = (text or "").casefold()
    words = "|".join(sorted((*TRUE, *FALSE), key=len, reverse=True))
    numbered = {int(k): v for k, v in re.findall(rf"(?m)(?:^|[\s,;(])(\d+)\s*[.):\-–]\s*({words})(?!\w)", t)}
    if set(numbered) == set(range(1, n + 1)):
        found = [numbered[k] for k in range(1, n + 1)]
    else:
        found = re.findall(rf"(?<!\w)({words})(?!\w)", t)
        if len(found) != n:
            return None
    return ",".join("P" if v in TRUE else "F" for v in found)


def pairs(text: str | None, rows: list[str], keys: str) -> str | None:
    """A key for each row, once each row has exactly one."""
    found: dict[str, set[str]] = {}
    for r, k in re.findall(rf"(?<!\w)({'|'.join(map(re.escape, rows))})\s*[.):\-–—→=]*\s*([{keys}])(?!\w)", text or "") if rows else ():
        found.setdefault(r, set()).add(k)
    if set(found) != set(rows) or any(len(v) != 1 for v in found.values()):
        return None
    return ",".join(f"{r}-{next(iter(found[r]))}" for r in rows)


@F.pandas_udf(T.StringType())
def extract_choice(text: pd.Series, letters: pd.Series) -> pd.Series:
    return pd.Series([one_letter(t, x) for t, x in zip(text, letters, strict=True)])


@F.pandas_udf(T.StringType())
def extract_verdicts(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([verdicts(t, int(k)) for t, k in zip(text, n, strict=True)])


@F.pandas_udf(T.StringType())
def extract_pairs(text: pd.Series, rows: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([pairs(t, list(r), k) for t, r, k in zip(text, rows, keys, strict=True)])
