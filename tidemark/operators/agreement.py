"""Whether a solver's payload agrees with a key: full points when it is read strictly, or when it is read leniently and names one answer only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import grading
from tidemark.operators.sheets import tokens

#: Words that put several answers side by side, or take one back.
HEDGES = set("lub albo bądź czy ewentualnie względnie lecz ale nie zamiast or".split())
#: Kinds of items that have one answer.
SINGLE = ("mc", "short", "numeric")


def bare_payload(text: Column) -> Column:
    """Without an announcement in front, marks of emphasis and signs at the end; compact verdicts and letters are put apart by `spread`."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iu)^\s*(?:\*\*|__|`)?\s*odpowied[źz]\s*:\s*", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\*\*|__|`+", ""), r"^\s+|\s+$", ""), r"[ .;]+$", "")


def spread(kind: Column, text: Column) -> Column:
    """PFP as P, F, P and AC as A, C, where the kind has such answers."""
    compact = kind.isin("tf", "multi") & text.rlike(r"^[A-HPF]{2,}$")
    return F.when(compact, F.array_join(F.split(F.regexp_replace(text, r"(?<=.)(?=.)", ","), ","), ", ")).otherwise(text)


def names_one(kind: str, text: str, letters: list[str], n: int, unit: str | None, key: str, accepted: list[str]) -> bool:
    """Whether a text names exactly one candidate for the kind: a lenient reading would pick one of several."""
    found = tokens(text)
    if kind == "mc":
        return {x for x in found if x in letters} <= {key}
    if kind == "numeric":
        return len(grading._FREE_NUMBER.findall(text.replace(unit, " ") if unit else text)) == 1
    if kind == "tf":
        return sum(x.casefold() in grading.VERDICTS for x in found) == n
    if kind == "match":
        rows = []
        for i, x in enumerate(found):
            j = i + 1
            while j < len(found) and found[j] in "-–—:→).":
                j += 1
            if x.isdigit() and j < len(found) and re.fullmatch("[A-H]", found[j]):
                rows.append(str(x))
        return len(rows) == len(set(rows)) == n
    if kind == "short":
        known = {w for a in accepted for w in grading.short_key(a).split()}
        if any(x.casefold() in HEDGES - known for x in found):
            return False
        return all(grading.short_matches(p, accepted, True) for p in re.split(r"[,;/|]", text) if p.strip())
    return True


@F.pandas_udf(T.BooleanType())
def loosely_agrees(kind: pd.Series, text: pd.Series, letters: pd.Series, n: pd.Series, unit: pd.Series, key: pd.Series, options: pd.Series, accepted: pd.Series) -> pd.Series:
    """Whether the lenient reading is right, and the only one."""

    def one(k, t, x, m, u, right, o, forms):
        t, x, forms = t or "", list(x) if x is not None else [], list(forms) if forms is not None else []
        value = grading.Free(x, int(m), dict(o) if o is not None else {}).read(k, t)
        if value is None or not names_one(k, t, x, int(m), u, right, forms):
            return False
        if k == "short":
            return grading.short_matches(value, forms, True)
        return abs(float(value) - float(right)) <= 1e-6 * max(1.0, abs(float(right))) + 1e-12 if k == "numeric" else value == right

    return pd.Series([one(*r) for r in zip(kind, text, letters, n, unit, key, options, accepted, strict=True)], dtype=bool)


def solver_agrees(rows: DataFrame) -> DataFrame:
    """Adds `agrees`. rows: item (`grading.item_struct`), payload (text), key (the canonical value), options (letter to text), accepted (forms
    of a short answer, else empty), and what else; the payload is read in projections of their own, as each is used many times."""
    read = rows.withColumn("_text", spread(F.col("item.type"), bare_payload(F.col("payload"))))
    read = read.withColumn("_strict", grading.parse_strict(F.col("item"), F.col("_text"), "payload_only"))
    return read.withColumn("agrees", _agrees(F.col("item"), F.col("_text"), F.col("_strict"), F.col("key"), F.col("options"), F.col("accepted"))).drop("_text", "_strict")


def _agrees(item: Column, text: Column, strict: Column, key: Column, options: Column, accepted: Column) -> Column:
    kind, none = item["type"], F.array().cast("array<struct<min_correct:int,points:int>>")
    full = grading.points(item, strict["value"], key, F.lit(1), none, F.lit(None).cast("double")) >= 1
    right = strict["ok"] & F.when(kind == "short", grading.short_match(strict["value"], accepted, F.lit(False))).otherwise(full)
    loose = loosely_agrees(kind, text, item["letters"], item["n"], item["unit"], key, options, accepted)
    return F.coalesce(right, F.lit(False)) | loose


def all_agree(each: Column) -> Column:
    """For several payloads of an item with one answer: whether all agree."""
    return (F.size(each) > 0) & F.forall(each, lambda x: x)
