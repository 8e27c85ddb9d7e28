"""Language identification by Bayesian fusion of four kinds of evidence.

* the text: likelihoods of byte n-grams under a model for each language, tempered by the text's length because
  neighbouring n-grams are not independent;
* the host: a prior that is smoothed along the host's labels, from all pages to those of the address's suffix, then of the domain, then of the host;
* the suffix of the address, as the first of these levels;
* the language that the markup declares, by how often each language's pages declare it.

What the last three say is learned from all rows by grouped aggregation of what the texts alone say, so no label is
trusted by itself. Each row's own text is left out of what its host, suffix and declaration say about it, so it counts once.
Counts are pre-aggregated in each task, and a host with a third of all rows is one row for each task.

The languages are those that LEAST_ROWS rows of the whole table declare, counted exactly, the MOST_LANGS most frequent at most. The text model is
fitted on a bounded sample of rows of each (SAMPLE_ROWS together); rows of the sample that a first fit contradicts are left out of a second one.

A row is rejected (`accepted` false, lang null) if its text has no letters, or if no language reaches LEAST_POSTERIOR. If no language is
declared often enough to be modelled, every row with letters is accepted with the language that it declares and confidence 0.
Of languages with equal posteriors the first by name counts. Nulls: a null or empty text has no letters; a null declaration, host or suffix is
a value of its own that says what such rows say. Empty tables give empty results. Repeated rows give repeated results. Extra
columns, of any type and name, are ignored, or kept by `accepted_documents`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Texts, trimmed, written

#: Rows, about, on which the text model is fitted, dealt evenly to the languages.
SAMPLE_ROWS = 6000
#: Bins of hashed runs of three bytes, rows of a language from which it is modelled, and languages at most.
BINS, LEAST_ROWS, MOST_LANGS = 1 << 15, 8, 200
#: Text evidence counts as if every so many n-grams were independent; beyond MOST_EVIDENCE nats it says no more.
GRAMS_A_SAMPLE, MOST_EVIDENCE = 8.0, 30.0
#: Rows that a level of a host counts against its own; pseudo-counts of declarations and suffixes.
HOST_WEIGHT, COUNT_WEIGHT = 5.0, 1.0
LEAST_POSTERIOR = 0.5

#: Lower case of the letters A-Z; digits and signs become one blank, so that what is in front of a word's end is seen.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MARKUP_LANG = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def gram_bins(data: np.ndarray) -> np.ndarray:
    """Bin of the three folded bytes at each place; runs of blanks give bin 0, which no model counts."""
    x = _FOLD[data].astype(np.uint32)
    if len(x) < 3:
        x = np.concatenate([x, np.full(3 - len(x), 0x20, np.uint32)])
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    bins = (code * np.uint32(2654435761) >> np.uint32(32 - 15)).astype(np.int64)
    blank = (x[:-2] == 0x20) & (x[1:-1] == 0x20) | (x[1:-1] == 0x20) & (x[2:] == 0x20)
    bins[bins == 0] = 1
    bins[blank] = 0
    return bins


class TextModel:
    """log P(n-gram | language) for each language, bin 0 saying nothing."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + 0.1
        smooth[:, 0] = 0
        logs = np.log(np.maximum(smooth, 1e-300) / smooth.sum(axis=1, keepdims=True))
        logs[:, 0] = 0
        self.logs = np.ascontiguousarray((logs - logs.max(axis=0)).astype(np.float32).T)  # what is common to all languages cancels

    def evidence(self, data: np.ndarray) -> np.ndarray | None:
        """Tempered log-likelihood of each language, the best at 0; None without letters."""
        bins = gram_bins(data)
        bins = bins[bins > 0]
        if not len(bins):
            return None
        total = np.zeros(len(self.langs))
        for at in range(0, len(bins), 1 << 16):
            total += np.bincount(bins[at : at + (1 << 16)], minlength=BINS).astype(np.float32) @ self.logs if len(bins) - at > 4096 else self.logs[bins[at : at + (1 << 16)]].sum(axis=0)
        total = total / GRAMS_A_SAMPLE
        return np.maximum(total - total.max(), -MOST_EVIDENCE)


def fit_text_model(rows: DataFrame, seed_cols: list[str]) -> TextModel | None:
    """A model of the languages that LEAST_ROWS rows declare; rows: text, declared and the columns that seed the sample.

    Tasks count the n-grams of the sampled rows' whole texts; the driver gets what bins a text fills, and how often.
    """
    counted = rows.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    known = {r.declared: r.n for r in counted.orderBy(F.desc("n"), "declared").limit(MOST_LANGS).collect()}
    if not known:
        return None
    each = max(LEAST_ROWS, SAMPLE_ROWS // len(known))
    steps = F.create_map(*[F.lit(x) for k, n in sorted(known.items()) for x in (k, max(1, n // each))])
    picked = rows.where(F.pmod(F.xxhash64(*seed_cols), steps[F.col("declared")]) == 0)

    def run(batches):
        for b in batches:
            texts = Texts(b.column(1))
            for i in range(b.num_rows):
                bins, counts = np.unique(gram_bins(texts.row(i)), return_counts=True)
                yield pa.record_batch({"declared": b.column(0).slice(i, 1), "bins": pa.array([bins.astype("<u2").tobytes()], pa.binary()), "counts": pa.array([counts.astype("<u4").tobytes()], pa.binary())})

    sample = picked.select("declared", "text").mapInArrow(run, "declared string, bins binary, counts binary").limit(4 * SAMPLE_ROWS).collect()
    grams = []
    for r in sorted(sample, key=lambda r: (r.declared, r.bins, r.counts)):
        bins, counts = np.frombuffer(r.bins, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4")
        grams.append((r.declared, bins[bins > 0], counts[bins > 0].astype(np.float32)))
    langs = sorted({d for d, _, _ in grams})
    if not langs:
        return None
    model = None
    for _ in range(2):
        total = np.zeros((len(langs), BINS))
        for d, bins, counts in grams:
            if d in langs and len(bins):
                k = langs.index(d)
                if model is not None:
                    score = counts @ model.logs[bins] / GRAMS_A_SAMPLE
                    if score[k] < score.max() - 5:
                        continue
                total[k, bins] += counts / math.sqrt(counts.sum())  # a long text doesn't outweigh many
        model = TextModel(langs, total * 30)
    return model


def evidence(rows: DataFrame, text_model: TextModel) -> DataFrame:
    """The rows, the text replaced by `said`: the tempered log-likelihood of each language (null without letters)."""
    others = [c for c in rows.columns if c != "text"]
    ddl = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), "said array<double>"])
    at, n = rows.columns.index("text"), len(rows.columns)

    def run(batches):
        for b in batches:
            texts = Texts(b.column(at))
            said = [text_model.evidence(texts.row(i)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n) if i != at), pa.array(said, pa.list_(pa.float64()))], names=[*others, "said"])

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), ddl)


def host_parts(host):
    """(suffix, domain) of a host column: its last label, and its last two; a host of one label is its own domain."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n > 1, F.element_at(labels, -1)), F.when(n > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(host)


def host_of(url):
    """The host of an address column, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _normal(x):
    """Log-weights to probabilities, in one array column."""
    top = F.array_max(x)
    weights = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(weights, lambda v: v / F.aggregate(weights, F.lit(0.0), lambda a, w: a + w))


def _sums(df: DataFrame, keys: list[str], counts, n: int) -> DataFrame:
    """Sums of an array column of n numbers by key, as `sums`; pre-aggregated in each task."""
    sums = df.groupBy(*keys).agg(*[F.sum(counts[i]).alias(f"_{i}") for i in range(n)])
    return sums.select(*keys, F.array(*[f"_{i}" for i in range(n)]).alias("sums"))


class Priors:
    """What hosts and declarations say, as sums of what texts say; `said`: declared, host, said (null without letters)."""

    def __init__(self, said: DataFrame, langs: list[str]) -> None:
        n = len(langs)
        self.langs = langs
        suffix, domain = host_parts(F.col("host"))
        heard = said.where(F.col("said").isNotNull()).withColumns({"suffix": suffix, "domain": domain, "by_text": _normal(F.col("said"))})
        by_host = written(_sums(heard, ["host", "domain", "suffix"], F.col("by_text"), n), "hosts")  # coarser sums are sums of these
        self.overall = list(by_host.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)).alias(f"_{i}") for i in range(n)]).first())
        domains = _sums(by_host, ["domain"], F.col("sums"), n).select(F.col("domain").alias("of_domain"), F.col("sums").alias("in_domain"))
        suffixes = _sums(by_host, ["suffix"], F.col("sums"), n).select(F.col("suffix").alias("of_suffix"), F.col("sums").alias("in_suffix"))
        hosts = by_host.join(domains, F.col("domain").eqNullSafe(F.col("of_domain"))).join(suffixes, F.col("suffix").eqNullSafe(F.col("of_suffix")))
        # tables of known size: Spark broadcasts them while they are small, and whole texts then pass the joins without a shuffle
        self.hosts = written(hosts.select(F.col("host").alias("of_host"), F.col("sums").alias("in_host"), "in_domain", "in_suffix"), "hosts")
        self.declared = written(_sums(heard, ["declared"], F.col("by_text"), n).select(F.col("declared").alias("of_declared"), F.col("sums").alias("in_declared")), "declared")

    def applied(self, rows: DataFrame, model: TextModel | None = None) -> DataFrame:
        """Rows with `declared`, `host` and `said`, whatever else; adds lang, confidence, accepted, in the place of `said`.

        With a model, rows have `text` in the place of `said`, and it is heard and judged in one Python worker: another one for each task
        would hold another share of an executor's memory.

        What is learned is joined back by host and declaration: Spark broadcasts what it finds small, and its skew join splits
        hosts with very many rows.
        """
        langs, overall = self.langs, np.array(self.overall)
        joined = rows.join(self.hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").join(self.declared, F.col("declared").eqNullSafe(F.col("of_declared")), "left")
        first = "said" if model is None else "text"
        kept, sums = [c for c in rows.columns if c != first], [first, "in_host", "in_domain", "in_suffix", "in_declared"]
        schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

        def run(batches):
            for b in batches:
                said = b.column(len(kept))
                if model is not None:
                    texts = Texts(said)
                    said = pa.array([model.evidence(texts.row(i)) for i in range(b.num_rows)], pa.list_(pa.float64()))
                heard = np.asarray(said.is_valid())
                numbers = [np.asarray(c.filter(said.is_valid()).flatten(), float).reshape(-1, len(langs)) for c in (said, *b.columns[len(kept) + 1 :])]
                posterior = posteriors(*numbers, overall)
                best = posterior.argmax(axis=1) if len(posterior) else np.zeros(0, np.int64)
                confidence, lang = np.zeros(b.num_rows), np.full(b.num_rows, None, object)
                confidence[heard] = posterior[np.arange(len(best)), best]
                accepted = heard & (confidence >= LEAST_POSTERIOR)
                lang[heard] = np.array(langs, object)[best]
                lang[~accepted] = None
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(lang.tolist(), pa.string()), pa.array(confidence), pa.array(accepted)], names=[*kept, "lang", "confidence", "accepted"])

        return joined.select(*kept, *sums).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def posteriors(said: np.ndarray, host: np.ndarray, domain: np.ndarray, suffix: np.ndarray, declared: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """P(language | all evidence) of each row; the sums that it is in, and those of all rows, without what the row itself has added."""

    def normal(x):
        weights = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
        return weights / weights.sum(axis=1, keepdims=True)

    own = normal(said)
    others = np.maximum(overall - own, 0)
    prior = (others + 1) / (others.sum(axis=1, keepdims=True) + said.shape[1])
    for sums in (suffix, domain, host):
        rest = np.maximum(sums - own, 0)
        prior = (rest + HOST_WEIGHT * prior) / (rest.sum(axis=1, keepdims=True) + HOST_WEIGHT)
    declares = (np.maximum(declared - own, 0) + COUNT_WEIGHT) / (others + COUNT_WEIGHT)  # P(declaration | language), up to a common factor
    return normal(said + np.log(prior) + np.log(declares))


def fused(said: DataFrame, langs: list[str]) -> DataFrame:
    """Rows with `declared`, `host` and `said`; adds lang, confidence, accepted."""
    return Priors(said, langs).applied(said)


def identify(rows: DataFrame, model: TextModel | None) -> DataFrame:
    """rows: key columns, text, declared, host. Returns the keys, declared, host, lang, confidence, accepted."""
    if model is None:
        letters = F.col("text").rlike(r"\p{L}")
        kept = [c for c in rows.columns if c != "text"]
        return rows.select(*kept, F.when(letters, F.col("declared")).alias("lang"), F.lit(0.0).alias("confidence"), letters.alias("accepted"))
    return fused(written(evidence(rows, model), "said"), model.langs)


def document_rows(docs: DataFrame, keys: dict) -> DataFrame:
    """The general rows of `documents`: the declared language is `lang`, the host is `source`."""
    code = F.lower(F.substring(F.trim(F.col("lang")), 1, 2))
    return docs.select(*[c.alias(k) for k, c in keys.items()], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.nullif(code, F.lit("")).alias("declared"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The general rows of `pages`: what the markup declares, the address's host, and the text without markup."""
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>", " "), r"<[^>]*>", " ")
    return pages.select("page_id", text.alias("text"), F.lower(F.nullif(F.regexp_extract(page, _MARKUP_LANG, 1), F.lit(""))).alias("declared"), host_of(F.col("url")).alias("host"))


def documents_identified(docs: DataFrame) -> DataFrame:
    """doc_id, declared, host, lang, confidence, accepted of every document."""
    rows = document_rows(docs, {"doc_id": F.col("doc_id").cast("long")})
    return identify(rows, fit_text_model(rows, ["doc_id"]))


def pages_identified(pages: DataFrame) -> DataFrame:
    """page_id, declared, host, lang, confidence, accepted of every page."""
    rows = page_rows(pages)
    return identify(rows, fit_text_model(rows, ["page_id"]))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, all their columns as they were but `lang`, which is now what was identified.

    Rows carry their columns through the fusion, so none is found again by a key; a second pass over the texts takes less than it would
    take to send them through a shuffle. Nulls, empty and very long texts, repeated rows and empty tables are as the module says.
    """
    names = docs.columns
    inner = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = {c: F.col(f"_{names.index(c)}") for c in ("doc_id", "text", "lang", "source")}
    general = document_rows(inner.select(*[c.alias(k) for k, c in at.items()]), {"doc_id": F.col("doc_id").cast("long")})
    model = fit_text_model(general, ["doc_id"])
    plain = document_rows(inner.withColumns(at), {c: F.col(c) for c in inner.columns})
    if model is None:
        found = identify(plain, None)
    else:
        found = Priors(written(evidence(general.drop("doc_id"), model), "said"), model.langs).applied(plain, model)
    own = {c: F.col(f"_{i}") for i, c in enumerate(names)} | {"lang": F.col("lang")}
    return found.where("accepted").select(*[own[c].alias(c) for c in names])
