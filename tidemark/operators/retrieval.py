"""BM25 retrieval over relational postings, with diversified top-k and passage chunking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the ranking: k1, b, weight of the title's words, length of stems, least idf, full title mass.
K1, B, TITLE_WEIGHT, STEM, MIN_IDF, TITLE_FULL = 1.2, 0.75, 2, 6, 0.2, 8.0
#: Fixed values of passages in words: least, most, where a passage may close, the hard limit.
PASSAGE_LEAST, PASSAGE_MOST, PASSAGE_CLOSE, PASSAGE_HARD = 180, 260, 220, 325


def tokens(text: Column, stop: list[str] = (), suffixes: list[str] = ()) -> Column:
    """Lower-case words that aren't stop words, without their longest listed suffix (three letters stay), cut to STEM letters; numbers whole."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(list(stop)))
    if suffixes:
        pattern = "^(.{3,}?)(?:" + "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)) + ")$"
        return F.transform(found, lambda w: F.when(w.rlike(r"^\p{N}"), w).otherwise(F.substring(F.regexp_replace(w, pattern, "$1"), 1, STEM)))
    return F.transform(found, lambda w: F.when(w.rlike(r"^\p{N}"), w).otherwise(F.substring(w, 1, STEM)))


class Index:
    """postings (term, pid, tf), passages (pid, title, dl), terms (term, df, idf) and the two totals."""

    def __init__(self, passages: DataFrame, stop: list[str] = (), suffixes: list[str] = ()) -> None:
        """passages: pid, title, section, text; the title's words count TITLE_WEIGHT times."""
        self.stop, self.suffixes = list(stop), list(suffixes)
        self._count(*self._tables(passages))

    def _tables(self, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
        stop, suffixes = self.stop, self.suffixes
        words = F.concat(*[tokens(F.col("title"), stop, suffixes)] * TITLE_WEIGHT, tokens(F.col("section"), stop, suffixes), tokens(F.col("text"), stop, suffixes))
        split = passages.select("pid", "title", words.alias("words"))
        postings = split.select("pid", F.explode("words").alias("term")).groupBy("term", "pid").agg(F.least(F.count("*"), F.lit(65_535)).alias("tf"))
        return split.select("pid", "title", F.size("words").alias("dl")), postings

    def _count(self, passages: DataFrame, postings: DataFrame) -> None:
        self.passages, self.postings = passages, postings
        totals = self.passages.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.terms = df.crossJoin(F.broadcast(totals)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # totals: one row
        norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("avgdl"))
        self.norms = self.passages.crossJoin(F.broadcast(totals)).select("pid", "title", norm.alias("norm"))

    def save(self, path: str) -> Index:
        """Write the index, postings by term, and return it as it is read from there; queries then count nothing anew."""
        spark = self.passages.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "pid").write.parquet(f"{path}/postings")
        self.passages.write.parquet(f"{path}/passages")
        spark.createDataFrame([(FORMAT, STEM, self.stop, self.suffixes)], "format int, stem int, stop array<string>, suffixes array<string>").write.parquet(f"{path}/meta")
        return load_index(spark, path)

    def retrieve(self, queries: DataFrame, texts: DataFrame, k: int = 5, max_per_title: int = 2, min_score: float = 0.0, title_boost: float = 0.0) -> DataFrame:
        """What `search` finds, with `kept`: hits below min_score are not used, but stay as rows for the log."""
        return self.search(queries, texts, k, max_per_title, title_boost).withColumn("kept", F.col("score") >= F.lit(min_score))

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """qid, term, weight = 1 + ln(count); queries: qid, query."""
        t = queries.select("qid", F.explode(tokens(F.col("query"), self.stop, self.suffixes)).alias("term"))
        return t.groupBy("qid", "term").agg((1 + F.log(F.count("*"))).alias("weight"))

    def scores(self, queries: DataFrame, min_idf: float = MIN_IDF, title_boost: float = 0.0) -> DataFrame:
        """qid, pid, title, score of all passages that share a term with the query whose idf is high enough.

        With a title boost a score counts 1 + boost * coverage times, by how much of its title's weight the query holds.
        """
        q = self.query_terms(queries).join(self.terms, "term").where(F.col("idf") >= min_idf)
        hit = q.join(self.postings, "term").join(self.norms, "pid")
        part = F.col("idf") * F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
        out = hit.groupBy("qid", "pid", "title").agg(F.sum(part).alias("score"))
        if not title_boost:
            return out
        covered = self.title_coverage(queries, self.passages.select("title").distinct())
        return out.join(covered, ["qid", "title"], "left").select("qid", "pid", "title", (F.col("score") * (1 + F.lit(title_boost) * F.coalesce("coverage", F.lit(0.0)))).alias("score"))

    def search(self, queries: DataFrame, texts: DataFrame, k: int = 5, max_per_title: int = 2, title_boost: float = 0.0) -> DataFrame:
        """qid, rank, pid, title, score: the best k within a pool of max(10 k, 50), no text twice, max_per_title of a title.

        texts: pid, text, fetched for the pool only.
        """
        s = self.scores(queries, title_boost=title_boost).withColumn("score", F.round("score", 6))
        order = [F.desc("score"), "pid"]
        rank = lambda *by: F.row_number().over(Window.partitionBy("qid", *by).orderBy(*order))
        pool = s.withColumn("_p", rank()).where(F.col("_p") <= max(10 * k, 50)).drop("_p").join(texts.select("pid", F.xxhash64("text").alias("_t")), "pid")
        once = pool.withColumn("_d", rank("_t")).where("_d = 1")
        capped = once.withColumn("_m", rank("title")).where(F.col("_m") <= max_per_title)
        return capped.withColumn("rank", rank()).where(F.col("rank") <= k).select("qid", "rank", "pid", "title", "score")

    def title_coverage(self, queries: DataFrame, titles: DataFrame) -> DataFrame:
        """qid, title, coverage: share of the title's idf that the query's words hold, scaled by min(1, held idf / TITLE_FULL).

        titles: title. Only titles that share a word with the query are returned.
        """
        t = titles.select("title").distinct().select("title", F.explode(F.array_distinct(tokens(F.col("title"), self.stop, self.suffixes))).alias("term")).join(self.terms.select("term", "idf"), "term")
        mass = t.groupBy("title").agg(F.sum("idf").alias("_all"))
        hit = self.query_terms(queries).select("qid", "term").join(t, "term").groupBy("qid", "title").agg(F.sum("idf").alias("_hit"))
        return hit.join(mass, "title").select("qid", "title", (F.col("_hit") / F.col("_all") * F.least(F.lit(1.0), F.col("_hit") / TITLE_FULL)).alias("coverage"))


#: The format of a saved index.
FORMAT = 1


def load_index(spark: SparkSession, path: str) -> Index:
    """An index that `Index.save` has written."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta["format"], meta["stem"]) != (FORMAT, STEM):
        raise ValueError(f"the index at {path} has another format; build it again")
    index = Index.__new__(Index)
    index.stop, index.suffixes = list(meta["stop"]), list(meta["suffixes"])
    index._count(spark.read.parquet(f"{path}/passages"), spark.read.parquet(f"{path}/postings"))
    return index


_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def chunk_text(text: str) -> list[tuple[str, str]]:
    """(section, passage) of an article whose sections begin with `## `.

    Sentences are packed until a passage has PASSAGE_CLOSE words and the next sentence would lead beyond PASSAGE_MOST;
    longer sentences are cut at PASSAGE_HARD words. A short tail joins the passage before it if both fit into
    PASSAGE_HARD words, also across sections.
    """
    out: list[list] = []
    section, body = "", []

    def close() -> None:
        now: list[str] = []
        for s in (s for line in body for s in _SENTENCE.split(line.strip()) if s.strip()):
            w = s.split()
            for at in range(0, len(w), PASSAGE_HARD):
                part = w[at : at + PASSAGE_HARD]
                if now and (len(now) >= PASSAGE_CLOSE and len(now) + len(part) > PASSAGE_MOST or len(now) + len(part) > PASSAGE_HARD):
                    out.append([section, now])
                    now = []
                now = now + part
        if now:
            if out and len(now) < PASSAGE_LEAST and len(out[-1][1]) + len(now) <= PASSAGE_HARD:
                out[-1][1] = out[-1][1] + now
            else:
                out.append([section, now])

    for line in (text or "").split("\n"):
        if line.startswith("## "):
            close()
            section, body = line[3:].strip(), []
        else:
            body.append(line)
    close()
    return [(s, " ".join(w)) for s, w in out]


def chunk_passages(articles: DataFrame) -> DataFrame:
    """title, n, section, text: the passages of each article (title, text), numbered from 1."""

    def run(batches):
        for pdf in batches:
            rows = [(t, k, s, p) for t, x in zip(pdf["title"], pdf["text"], strict=True) for k, (s, p) in enumerate(chunk_text(x), 1)]
            yield pd.DataFrame(rows, columns=["title", "n", "section", "text"])

    return articles.select(F.col("title").cast("string"), "text").mapInPandas(run, "title string, n int, section string, text string")


def build_query(question: Column, source: Column, most: int = 1600) -> Column:
    """Question, then source, without bracketed marks, white space run together, cut at a word."""
    from tidemark.functions.text import cut_at_word

    whole = F.concat_ws(" ", question, source)
    return cut_at_word(F.trim(F.regexp_replace(F.regexp_replace(whole, r"\[[^\]]*\]", " "), r"\s+", " ")), most)


@F.pandas_udf(T.StringType())
def format_passages(passages: pd.Series, budget: pd.Series) -> pd.Series:
    """Numbered blocks of an array of (title, text) under a number of characters; the last is cut at a word if 200 characters fit."""

    def one(rows, most: int) -> str:
        out, used = [], 0
        for k, r in enumerate(rows, 1):
            block = f"[{k}] {r['title']}\n{r['text']}"
            room = most - used - (2 if out else 0)
            if len(block) > room:
                if room >= 200:
                    out.append(block[: room - 1].rsplit(" ", 1)[0] + "…")
                break
            out.append(block)
            used += len(block) + (2 if len(out) > 1 else 0)
        return "\n\n".join(out)

    return pd.Series([one(r, int(m)) for r, m in zip(passages, budget, strict=True)])
