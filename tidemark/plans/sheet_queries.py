"""Exam sheets over items that are made from the driver's parts: what is asked, read, shown and judged is known by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, exam, sheets, validate
from tidemark.plans.catalogue import query

_FORM = "CASE p_partkey % 7 WHEN 0 THEN 'B' WHEN 1 THEN '1: P' || chr(10) || ' 2 : F' WHEN 2 THEN 'A: 3' || chr(10) || 'B: 1' WHEN 3 THEN '1: C' || chr(10) || '2: A' WHEN 4 THEN 'Tekst wypracowania' WHEN 5 THEN '1: P' || chr(10) || 'B' ELSE p_name END"


def _form():
    k = F.col("p_partkey") % 7
    made = ["B", "1: P\n 2 : F", "A: 3\nB: 1", "1: C\n2: A", "Tekst wypracowania", "1: P\nB"]
    out = F.when(k == 0, made[0])
    for i, x in enumerate(made[1:], 1):
        out = out.when(k == i, x)
    return out.otherwise(F.col("p_name"))


@query(
    f"""SELECT p_partkey, CASE WHEN contains(lower(f), 'wypracowani') THEN 'essay' WHEN regexp_full_match(f, '[A-Z]') THEN 'closed_single' WHEN regexp_full_match(f, '(\\s*\\d+\\s*:\\s*[PF]\\s*)+') THEN 'closed_tf'
    WHEN regexp_full_match(f, '(\\s*[A-Z]\\s*:\\s*\\d+\\s*)+') THEN 'closed_match' WHEN regexp_full_match(f, '(\\s*\\d+\\s*:\\s*[A-Z]\\s*)+') THEN 'closed_multi_part' ELSE 'open' END AS kind FROM (SELECT p_partkey, {_FORM} AS f FROM part)"""
)
def sheet_kinds(t):
    """The kind of each item, by its answer format."""
    return t.part.select("p_partkey", sheets.item_kind(_form(), F.lit("Podaj")).alias("kind"))


_BITS = [f"CASE WHEN p_size % {k} < {k // 2} THEN 'P' ELSE 'F' END" for k in (2, 4, 6)]


def _bits():
    return [F.when(F.col("p_size") % k < k // 2, "P").otherwise("F") for k in (2, 4, 6)]


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE '1: ' || a || chr(10) || '2: ' || b || chr(10) || '3: ' || c END AS answer, p_partkey % 6 = 0 AS exact
    FROM (SELECT p_partkey, {_BITS[0]} AS a, {_BITS[1]} AS b, {_BITS[2]} AS c FROM part)"""
)
def sheet_verdicts(t):
    """Verdicts read from answers in five styles, and from one that lacks a row; and whether an answer is exact already."""
    k, bits = F.col("p_partkey") % 6, _bits()
    word = [F.when(b == "P", "prawda").otherwise("Fałsz") for b in bits]
    lines = lambda parts, sep, end="": F.concat(*[x for i, p in enumerate(parts) for x in (F.lit(f"{i + 1}{sep}"), p, F.lit(f"{end}\n"))])
    exact = F.regexp_replace(lines(bits, ": "), r"\n$", "")
    text = F.when(k == 0, exact).when(k == 1, F.concat_ws(", ", *bits)).when(k == 2, F.concat(F.lit("**Odpowiedź:**\n"), lines(word, " – "))).when(k == 3, F.concat(*[x for i, w in enumerate(word) for x in (F.lit(f"{i + 1}. Zdanie o mieście.\n   **"), w, F.lit("**\n"))])).when(k == 4, F.concat(F.lit("<think>1: P</think>"), lines(bits, ") ", ","))).otherwise(lines(bits[:2], ": "))
    question = F.concat(F.lit("Oceń zdania.\n1. "), F.col("p_name"), F.lit("\n2. "), F.col("p_type"), F.lit("\n3. "), F.col("p_brand"))
    closed, form = F.lit("closed_tf"), F.lit("1: P\n2: F")
    return t.part.select("p_partkey", sheets.normalise_closed(closed, question, form, text).alias("answer"), sheets.closed_syntax_ok(closed, question, form, text).alias("exact"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE chr(CAST(65 + p_size % 4 AS INTEGER)) END AS letter FROM part")
def sheet_choices(t):
    """One option's letter, said in four ways; two options listed anew say none."""
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 4
    letter = F.char(65 + n)
    texts = [F.concat(F.lit("własność "), F.lit(x)) for x in ("króla", "miasta", "zakonu", "kupca")]
    said = F.element_at(F.array(*texts), (n + 1).cast("int"))
    text = F.when(k == 0, F.concat(F.lit(" ("), letter, F.lit(").\n"))).when(k == 1, F.concat(F.lit("Odpowiedź A jest błędna. Poprawna odpowiedź: "), letter)).when(k == 2, F.concat(F.lit("Była to "), said, F.lit("."))).when(k == 3, F.concat(letter, F.lit(") bo tak"))).otherwise("A. własność króla\nB. własność miasta\nnie wiem")
    question = F.lit("Wskaż\nA. własność króla\nB. własność miasta\nC. własność zakonu\nD. własność kupca")
    return t.part.select("p_partkey", sheets.normalise_closed(F.lit("closed_single"), question, F.lit("A"), text).alias("letter"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'A: ' || (p_size % 9 + 1) || chr(10) || 'B: ' || (p_size % 7 + 1) END AS pairs, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE '1: ' || chr(CAST(65 + p_size % 3 AS INTEGER)) || chr(10) || '2: ' || chr(CAST(65 + p_size % 2 AS INTEGER)) END AS parts FROM part")
def sheet_pairs(t):
    """Numbers by row and letters by part, read from answers in several styles."""
    k, a, b = F.col("p_partkey") % 5, (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 7 + 1).cast("string")
    two = lambda x, y, z: F.concat(F.lit(x), a, F.lit(y), b, F.lit(z))
    text = F.when(k == 0, two("A: ", "\nB: ", "")).when(k == 1, two("A – fragment ", ", B – fragment ", ".")).when(k == 2, two("| Sala rady | **", "** |\n| Skład soli | **", "** |")).when(k == 3, two("A. źródło ", "\nB. źródło ", "")).otherwise(F.concat(F.lit("A: "), a))
    x, y, m = F.char(65 + F.col("p_size") % 3), F.char(65 + F.col("p_size") % 2), F.col("p_partkey") % 3
    said = F.when(m == 0, F.concat(F.lit("1"), x, F.lit(" 2"), y)).when(m == 1, F.concat(F.lit("1. List napisał\nA. kupiec\nB. mnich\nC. rycerz\n**Odpowiedź:** "), x, F.lit("\n2. List dotyczy\n**Odpowiedź:** "), y)).otherwise(F.concat(F.lit("1: "), x))
    rows, parts = F.lit("Dobierz\nA. Sala rady\nB. Skład soli"), F.lit("Dokończ\n1. List napisał\nA. kupiec\nB. mnich\nC. rycerz\n2. List dotyczy\nA. cła\nB. wojny")
    return t.part.select("p_partkey", sheets.normalise_closed(F.lit("closed_match"), rows, F.lit("A: 1\nB: 2"), text).alias("pairs"), sheets.normalise_closed(F.lit("closed_multi_part"), parts, F.lit("1: A\n2: B"), said).alias("parts"))


@query(
    """SELECT p_partkey, 'Zadanie ' || p_partkey || ' (' || p_size || ' pkt)' || chr(10) || chr(10) || 'Rysunek' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '[Opis źródła Z' || p_size || ']' || chr(10) || p_name ELSE '[Obraz: ./img/Z' || p_size || '.png]' END || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '[Opis źródła X]' || chr(10) || p_brand ELSE '' END
    || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'Odpowiedz wyłącznie w formacie (P – prawda, F – fałsz):' || chr(10) || '1: P albo F' || chr(10) || '2: P albo F' AS prompt, '1: P' || chr(10) || '2: P' AS dummy FROM part"""
)
def sheet_prompts(t):
    """Each item's prompt, with descriptions in place of the markers of images, and a dummy answer."""
    even, name = F.col("p_partkey") % 2 == 0, F.concat(F.lit("img/Z"), F.col("p_size").cast("string"), F.lit(".png"))
    described = F.when(even, F.create_map(name, F.concat(F.col("p_name"), F.lit(" \n")), F.lit("other/X.jpg"), F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))
    source = sheets.render_source(F.concat(F.lit("Rysunek\n[Obraz: ./"), name, F.lit("]")), F.array(name, F.lit("a/X.jpg")), described)
    kind = F.lit("closed_tf")
    # labels follow the path of the image that an item has
    spec = sheets.format_spec(kind, F.lit("Oceń."), F.lit("1: P\n2: F"))
    rows = t.part.withColumns({"spec": spec, "source": source})
    return rows.select("p_partkey", sheets.user_content(F.col("p_partkey"), F.col("p_size"), F.col("source"), F.col("p_type"), sheets.format_line(kind, F.col("spec"), F.lit("Oceń."))).alias("prompt"), sheets.placeholder_answer(kind, F.col("spec"), F.col("p_partkey")).alias("dummy"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 < 2 THEN 1 + p_size % 2 END AS INTEGER) AS topic, CASE p_partkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'restated' END AS source, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size ELSE p_size + 4 END AS INTEGER) AS words FROM part")
def sheet_essays(t):
    """Topic and number of words of each essay."""
    k, number, body = F.col("p_partkey") % 3, (F.col("p_size") % 2 + 1).cast("string"), F.expr("repeat('raz ', p_size)")
    first = F.when(number == "1", "Reformy szkolne").otherwise("Kolej żelazna")
    text = F.when(k == 0, F.concat(F.lit("Temat "), number, F.lit(".\n"), body)).when(k == 1, F.concat(number, F.lit(". "), first, F.lit(" dawniej\n"), body)).otherwise(F.concat(F.lit("a b c d "), body))
    found = sheets.detect_essay_topic(F.lit("Wybierz jeden temat.\n1. Reformy szkolne\n2. Kolej żelazna"), text)
    return t.part.select("p_partkey", found.alias("x")).select("p_partkey", "x.topic", "x.source", "x.words")


@query(
    """SELECT p_partkey, n >= 6 OR m >= 4 AS loops, CASE WHEN n >= 6 THEN 1 ELSE n END AS phrases FROM (SELECT p_partkey, p_size % 10 AS n, p_partkey % 6 AS m FROM part)"""
)
def loops_made(t):
    """Whether texts loop that repeat a phrase and a line so many times, and how often the phrase stands there once loops are collapsed."""
    phrase = F.concat(F.lit("<"), F.col("p_name"), F.lit(">"))
    text = F.concat(F.array_join(F.array_repeat(phrase, (F.col("p_size") % 10).cast("int")), "\t "), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i < F.col("p_partkey") % 6, "the same line").otherwise(F.concat(F.lit("line "), i.cast("string")))), "\n"))
    collapsed = cleaning.collapse_repetition(text)
    return t.part.select("p_partkey", validate.loops(text).alias("loops"), (F.size(F.split(collapsed, "<")) - 1).cast("long").alias("phrases"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MABC-R0-100-2' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 1 THEN 'MHI-R1-093' WHEN 2 THEN 'arkusz ' || p_size ELSE 'EHIP-P' || p_size END AS paper,
    CASE p_partkey % 4 WHEN 1 THEN '2015' WHEN 3 THEN '2015' ELSE CASE WHEN p_size >= 40 THEN '2023' WHEN p_size >= 20 THEN '2015' ELSE 'pre2015' END END AS formula FROM part"""
)
def paper_codes(t):
    """Codes and formulas of papers, by their files' names."""
    n = F.col("p_size").cast("string")
    names = [F.concat(F.lit("a/b/mabc-r0_1P-100-A-2"), F.lpad(n, 3, "0"), F.lit(".PDF")), F.lit("MHI-R1_2P-093 (2).pdf"), F.concat(F.lit("x/arkusz "), n, F.lit(" (1).pdf")), F.concat(F.lit("EHIP-P"), n)]
    name = F.element_at(F.array(*names), (F.col("p_partkey") % 4 + 1).cast("int"))
    year = F.when(F.col("p_size") >= 40, 2024).when(F.col("p_size") >= 20, 2019).otherwise(2010)
    pid = exam.paper_id(name)
    return t.part.select("p_partkey", pid.alias("paper"), exam.paper_formula(pid, year).alias("formula"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'Dokończ zdanie.' WHEN p_partkey % 4 = 3 THEN p_name || ' czy ' || p_type || ' s1 s2' ELSE p_name || ' czy ' || p_type END AS stem FROM part"""
)
def stems_made(t):
    """What is compared of questions: without instructions, without options in their line, with statements."""
    from tidemark.operators import dedup

    k, bare = F.col("p_partkey") % 4, F.concat(F.col("p_name"), F.lit("  czy\n"), F.col("p_type"))
    question = F.when(k == 0, F.concat(F.lit("Wybierz poprawną odpowiedź. "), bare)).when(k == 1, F.concat(bare, F.lit(": A. raz B. dwa"))).when(k == 2, "Dokończ zdanie.").otherwise(F.concat(bare, F.lit(" Oceń prawdziwość podanych zdań i zaznacz. Zaznacz P albo F.")))
    kind = F.when(k == 3, "tf").when(k == 1, F.lit(None)).otherwise("mc")
    return t.part.select("p_partkey", dedup.stem_text(kind, F.when(k != 1, "x"), question, F.when(k == 3, F.array(F.lit("s1"), F.lit("s2"))), F.lit(None).cast("array<string>")).alias("stem"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size % 4 = 1 WHEN 1 THEN false WHEN 2 THEN p_size % 3 = 0 WHEN 3 THEN p_size % 2 = 0 WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN p_size % 5 = 1 ELSE true END AS agrees FROM part")
def solver_agreement(t):
    """Whether payloads agree with keys: in the right form, in a loose one, with a second candidate, or wrong."""
    from tidemark.operators import agreement, grading

    k, size, arr = F.col("p_partkey") % 8, F.col("p_size"), F.array().cast("array<string>")
    kind = F.when(k <= 1, "mc").when(k == 2, "tf").when(k == 3, "numeric").when(k <= 5, "short").when(k == 6, "multi").otherwise("match")
    letter = F.char(65 + size % 4)
    payload = (
        F.when(k == 0, letter).when(k == 1, "B albo C").when(k == 2, F.concat(F.lit("**PF"), F.when(size % 3 == 0, "P").otherwise("F"), F.lit("**")))
        .when(k == 3, F.concat(F.lit("Odpowiedź: około "), (3 + size % 2).cast("string"))).when(k == 4, "książę Mieszko I").when(k == 5, "Mieszko I albo Bolesław")
        .when(k == 6, F.concat(F.lit("A"), F.char(66 + size % 5))).otherwise("1: B; 2 - A")
    )
    key = F.when(k <= 1, "B").when(k == 2, "P,F,P").when(k == 3, "3.0").when(k <= 5, "Mieszko I").when(k == 6, "A,C").otherwise("1-B,2-A")
    item = grading.item_struct(type=kind, letters=F.array(*[F.lit(x) for x in "ABCDEFG"]), n=F.when(k == 2, 3).when(k == 7, 2).otherwise(0))
    options = F.create_map(*[F.lit(x) for v in "ABCD" for x in (v, f"option {v.lower()}")])
    rows = t.part.select("p_partkey", item.alias("item"), payload.alias("payload"), key.alias("key"), options.alias("options"), F.when(kind == "short", F.array(F.lit("Mieszko I"))).otherwise(arr).alias("accepted"))
    return agreement.solver_agrees(rows).select("p_partkey", "agrees")
