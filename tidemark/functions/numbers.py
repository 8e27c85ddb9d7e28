"""Numbers, options and small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_close(pred: Column, gold: Column, tolerance: Column | None = None) -> Column:
    """|pred - gold| within the tolerance (default: a millionth of |gold|, or of 1), with a slack of 1e-12; never for NaN and infinities."""
    own = F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(gold))
    allowed = own if tolerance is None else F.coalesce(tolerance, own)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(finite(pred) & finite(gold) & (F.abs(pred - gold) <= allowed + F.lit(1e-12)), F.lit(False))


def to_number(text: Column) -> Column:
    """A number written with a decimal comma or point, blanks between digits and a Unicode minus; null if it is none."""
    bare = F.translate(F.regexp_replace(text, r"[\s\x{00A0}\x{202F}]", ""), "−–,", "--.")
    return bare.try_cast("double")


def format_number(x: Column) -> Column:
    """Integers without decimals, others with a decimal comma."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, x.cast("long").cast("string")).otherwise(F.replace(x.cast("string"), F.lit("."), F.lit(",")))


def signed(x: Column, digits: int = 2) -> Column:
    """With a sign and a fixed number of decimals."""
    return F.format_string(f"%+.{digits}f", x)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 where there is no whole."""
    return F.when(whole != 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def rotate(array: Column, shift: Column | int) -> Column:
    """The array turned left by `shift` places."""
    n, k = F.size(array), F.lit(shift) if isinstance(shift, int) else shift
    by = F.when(n > 0, F.pmod(k, F.greatest(n, F.lit(1)))).otherwise(F.lit(0))
    return F.when(n > 0, F.concat(F.slice(array, by + 1, n), F.slice(array, F.lit(1), by))).otherwise(array)


def rotated_index(index: Column, size: Column, shift: Column | int) -> Column:
    """Where the element at an index (from 0) lands when its array is turned left."""
    k = F.lit(shift) if isinstance(shift, int) else shift
    return F.pmod(index - k, size)


def letter(index: Column) -> Column:
    """A, B, C, ... for 0, 1, 2, ..."""
    return F.char(index + 65)


def correct_parts(given: Column, key: Column) -> Column:
    """How many places of two arrays agree; a missing place agrees with none."""
    return F.aggregate(F.zip_with(given, key, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)


def multi_correct(given: Column, key: Column) -> Column:
    """Right picks less wrong picks, 0 at least."""
    picked = F.array_distinct(given)
    right = F.size(F.array_intersect(picked, key))
    return F.greatest(F.lit(0), right - (F.size(picked) - right))


def partial_points(n_right: Column, n_parts: Column, full: Column, table: Column) -> Column:
    """Points of a partly right answer: full marks if all is right, else the best row (min_correct, points) that is reached, else 0."""
    reached = F.array_max(F.transform(F.filter(table, lambda r: n_right >= r["min_correct"]), lambda r: r["points"]))
    return F.when(n_right >= n_parts, full).otherwise(F.coalesce(reached, F.lit(0)))


def longest_run(values: Column) -> Column:
    """Length of the run 1, 2, 3, ... found in an integer array in order of appearance."""
    return F.aggregate(values, F.lit(0), lambda n, v: F.when(v == n + 1, n + 1).otherwise(n))
