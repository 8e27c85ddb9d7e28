"""Items rendered as tasks, instructions, targets and messages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import format_number
from tidemark.operators.grading import PREFIX

#: What each kind of item asks for.
HINTS = {
    "mc": "Wybierz jedną poprawną odpowiedź.",
    "multi": "Wybierz wszystkie poprawne odpowiedzi.",
    "tf": "Oceń, czy każde ze zdań jest prawdziwe (P), czy fałszywe (F).",
    "match": "Przyporządkuj każdemu elementowi oznaczonemu cyfrą właściwy element oznaczony literą.",
    "short": "Udziel krótkiej odpowiedzi (słowo, nazwa lub krótkie wyrażenie).",
    "numeric": "Podaj sam wynik liczbowy.",
}


def by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def placeholder(kind: Column, n: Column) -> Column:
    """What stands for the answer in an instruction."""
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return by_kind(
        kind,
        {
            "mc": F.lit("<litera>"),
            "multi": F.lit("<litery oddzielone przecinkami>"),
            "tf": F.array_join(F.transform(places, lambda _: F.lit("<P/F>")), ", "),
            "match": F.array_join(F.transform(places, lambda i: F.concat(i.cast("string"), F.lit("-<litera>"))), ", "),
            "short": F.lit("<odpowiedź>"),
            "numeric": F.lit("<liczba>"),
        },
    )


def letters_phrase(letters: Column) -> Column:
    """A, B albo C."""
    n = F.size(letters)
    return F.when(n > 1, F.concat(F.array_join(F.slice(letters, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" albo "), F.element_at(letters, -1))).otherwise(F.get(letters, F.lit(0)))


def instruction(kind: Column, n: Column, letters: Column, variant: str) -> Column:
    """What a prompt says about the answer's form."""
    hint, mark = by_kind(kind, {k: F.lit(v) for k, v in HINTS.items()}), placeholder(kind, n)
    bare = F.concat(hint, F.lit(" Podaj wyłącznie odpowiedź w postaci: "), mark, F.lit(" — bez żadnego dodatkowego tekstu."))
    if variant == "canonical":
        return F.concat(hint, F.lit(f" Odpowiedz wyłącznie w formacie:\n{PREFIX} "), mark)
    if variant == "bare":
        return F.lit("")
    if variant == "payload_only":
        return bare
    if variant == "reason_then_answer":
        return F.concat(hint, F.lit(f" Najpierw krótko uzasadnij odpowiedź (1–3 zdania), a w ostatniej linii napisz:\n{PREFIX} "), mark)
    if variant == "organizer_letter":
        ask = F.concat(F.lit("Rozwiąż pytanie egzaminacyjne. Wybierz jedną poprawną odpowiedź. Odpowiedz wyłącznie literą "), letters_phrase(letters), F.lit("."))
        return F.when(kind == "mc", ask).otherwise(bare)
    raise KeyError(variant)


def payload(kind: Column, letter: Column, listed: Column, mapped: Column, number: Column) -> Column:
    """The canonical payload of a key: a letter, sorted letters, verdicts, pairs by number, the first short answer, a number."""
    pairs = F.array_sort(F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))))
    return by_kind(
        kind,
        {
            "mc": letter,
            "multi": F.array_join(F.array_sort(listed), ", "),
            "tf": F.array_join(listed, ", "),
            "match": F.array_join(F.transform(pairs, lambda e: F.concat(e["k"].cast("string"), F.lit("-"), e["v"])), ", "),
            "short": F.get(listed, F.lit(0)),
            "numeric": format_number(number),
        },
    )


def target(answer: Column, rationale: Column, variant: str) -> Column:
    """The completion that a variant wants; null where a rationale is needed and missing."""
    line = F.concat(F.lit(f"{PREFIX} "), answer)
    if variant in ("canonical", "bare"):
        return line
    if variant in ("payload_only", "organizer_letter"):
        return answer
    if variant == "reason_then_answer":
        return F.when(F.coalesce(F.trim(rationale), F.lit("")) != "", F.concat(F.trim(rationale), F.lit("\n"), line))
    raise KeyError(variant)


def lettered(options: Column) -> Column:
    """Options (array of (key, text)) as lines `A. text`."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")


def numbered(lines: Column) -> Column:
    """Lines as `1. text`."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def task(context: Column, question: Column, *blocks: Column) -> Column:
    """Context, question and blocks that aren't empty, with blank lines between."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(c), F.lit("")) for c in (context, question, *blocks)])


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Messages as an array of (role, content); an empty system prompt is left out."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rest = [one("user", user)] + ([one("assistant", assistant)] if assistant is not None else [])
    return F.when(F.coalesce(system, F.lit("")) != "", F.array(one("system", system), *rest)).otherwise(F.array(*rest))


def item_text(*fields: Column) -> Column:
    """All fields in one line."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *fields), r"\s+", " "))
