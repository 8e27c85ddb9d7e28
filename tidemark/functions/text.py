"""Text expressions: normal forms, keys, character classes, n-grams, cuts.

Native expressions wherever Spark has an exact equivalent; Unicode normal forms and case folding, which it lacks, are
Arrow functions over whole columns.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"\s+"


@F.pandas_udf(T.StringType())
def canonical_key(s: pd.Series) -> pd.Series:
    """NFKC, white space run together, trimmed, case folded; null stays null."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


@F.pandas_udf(T.StringType())
def plain_key(s: pd.Series) -> pd.Series:
    """The same without the compatibility form."""
    return s.map(lambda x: None if x is None else " ".join(x.split()).casefold())


@F.pandas_udf(T.StringType())
def ascii_key(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, everything but a-z and 0-9 one blank, trimmed."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c in _ALNUM else " " for c in bare).split())

    return s.map(one)


_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@F.pandas_udf(T.StringType())
def normal_text(s: pd.Series) -> pd.Series:
    """NFC, white space run together, trimmed; null is empty."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFC", x or "").split()))


def native_key(text: Column) -> Column:
    """Lower case, white space run together, trimmed: equal to `canonical_key` for ASCII text."""
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def fingerprint(key: Column, first: int) -> Column:
    """16 hexadecimal digits of the SHA-1 of the key's first characters."""
    return F.substring(F.sha1(F.substring(key, 1, first).cast("binary")), 1, 16)


def short_hash(text: Column) -> Column:
    """16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def count_class(text: Column, char_class: str) -> Column:
    """How many characters a class such as `[a-z]` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Words of two characters or more that hold a letter."""
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}"))


def char_grams(text: Column, n: int = 4) -> Column:
    """Distinct n-character grams of the text without blanks; none if it is shorter."""
    bare = F.regexp_replace(text, " ", "")
    # one pass: a lambda over positions would strip the blanks anew at each of them
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def coverage(target: Column, context: Column) -> Column:
    """Share of the target's values that the context holds; 1 for an empty target."""
    return F.when(F.size(target) > 0, F.size(F.array_intersect(target, context)) / F.size(target)).otherwise(F.lit(1.0))


def stems(text: Column, n: int = 5) -> Column:
    """Distinct n-character beginnings of the words."""
    return F.array_distinct(F.transform(words(text), lambda w: F.substring(w, 1, n)))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def clip(text: Column, most: int) -> Column:
    """The text, or its beginning with an ellipsis, `most` characters in all."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def cut_at_word(text: Column, most: int, least_share: float = 0.6) -> Column:
    """The text cut to `most` characters, at the last blank if that lies beyond `least_share` of them."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), " ") + 1
    has = F.instr(head, " ") > 0
    return F.when(F.length(text) <= most, text).when(has & (last - 1 > F.lit(int(most * least_share))), F.rtrim(F.substring(head, F.lit(1), last - 1))).otherwise(head)


def cut_at_line(text: Column, most: int, least_share: float = 0.7) -> Column:
    """The text cut to `most` characters, at the last line's end if that lies beyond `least_share` of them."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    has = F.instr(head, "\n") > 0
    return F.when(F.length(text) <= most, text).when(has & (last - 1 > F.lit(int(most * least_share))), F.substring(head, F.lit(1), last - 1)).otherwise(head)


def natural_key(dotted: Column) -> Column:
    """Numbers of a dotted id, for sorting 1.2 before 1.10; parts that are no numbers sort first."""
    return F.transform(F.split(dotted, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def strip_markdown(text: Column) -> Column:
    """Without emphasis, code marks, heading marks and list bullets; white space at line ends dropped, blank lines run together."""
    t = F.regexp_replace(text, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", "")
    t = F.regexp_replace(t, r"[*_`]{1,3}", "")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks; a block that isn't opened or closed goes up to its one mark."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?s)^.*</think>", "")
    return F.trim(F.regexp_replace(t, r"(?s)<think>.*$", ""))


def visible_text(html: Column) -> Column:
    """A page's text: scripts, styles and comments dropped, tags to blanks, the five basic entities resolved, white space run together."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, SPACES, " "))
