"""Readers and writers: JSON lines with file and line, first-wins and last-wins views, tolerant JSON, documents, Parquet."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS, _NAMED = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


#: Items of all six kinds in one row; answers are kept as text.
ITEM = fields(
    id=_TEXT, subject=_TEXT, type=_TEXT, question=_TEXT, context=_TEXT, options=_NAMED, statements=_TEXTS, left=_TEXTS, right=_NAMED, answer=_TEXT, tolerance=T.DoubleType(), unit=_TEXT,
    points=T.IntegerType(), partial_credit=T.ArrayType(T.ArrayType(T.IntegerType())), rationale=_TEXT, source=_TEXT, difficulty=_TEXT,
)
SOLVER = fields(id=_TEXT, payload=_TEXT, confidence=_TEXT, concern=_TEXT)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1), value of text files; blank lines are left out but counted.

    Files are read whole by one task each, so a line's number is known without a shuffle.
    """
    files = spark.read.format("binaryFile").load(path if isinstance(path, list) else [path])
    text = F.decode(F.col("content"), "UTF-8")
    lines = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(text, "\r?\n")).alias("_p", "value"))
    return lines.select("file", (F.col("_p") + 1).alias("line"), "value").where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON lines under a fixed schema, without validation; text that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tagged_jsonl(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """file, line, bad, and the fields of each line; `bad` tells lines that are no JSON object."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col("value"), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("file", "line", F.trim("value").startswith("{").alias("_object"), parsed.alias("r"))
    return rows.select("file", "line", (F.col("r._bad").isNotNull() | ~F.col("_object")).alias("bad"), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def first_wins(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key by file and line."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("file", "line"))).where("_k = 1").drop("_k")


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key by file and line."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("file"), F.desc("line")))).where("_k = 1").drop("_k")


def file_counts(tagged: DataFrame, key: str) -> DataFrame:
    """file, n, bad, repeated: how many lines a file has, how many are no rows, and how many repeat an earlier key."""
    k = F.row_number().over(Window.partitionBy(key).orderBy("file", "line"))
    return tagged.withColumn("_k", F.when(~F.col("bad"), k)).groupBy("file").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(F.col("_k") > 1).alias("repeated"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n, and the places of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(":", "file", "line"))).alias("places")).where("n > 1")


def load_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items with file and line; raises on lines that are no object, items that are invalid and ids that repeat."""
    from tidemark.operators.joins import must_be_empty
    from tidemark.operators.validate import item_error

    rows = tagged_jsonl(read_lines(spark, path), ITEM)
    must_be_empty(rows.where("bad").select("file", "line"), "lines that are no JSON object")
    must_be_empty(rows.select("file", "line", item_error().alias("error")).where("error is not null"), "invalid items")
    must_be_empty(duplicate_keys(rows, "id"), "repeated ids")
    return rows.drop("bad")


def load_raw(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid items, first by file and line; counts by file)."""
    from tidemark.operators.validate import item_error

    rows = tagged_jsonl(read_lines(spark, path), ITEM).withColumn("bad", F.col("bad") | item_error().isNotNull())
    return first_wins(rows.where("not bad"), "id").drop("bad"), file_counts(rows, "id")


def load_answers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Solver answers, the first of each id."""
    return first_wins(tagged_jsonl(read_lines(spark, path), SOLVER).where("not bad and id is not null").drop("bad"), "id")


def read_cache(spark: SparkSession, path: str | list[str], schema: T.StructType, key: str) -> DataFrame:
    """A cache of JSON lines: the last row of each key; torn lines don't count."""
    return last_wins(tagged_jsonl(read_lines(spark, path), schema).where(F.col(key).isNotNull() & ~F.col("bad")).drop("bad"), key)


def load_filled(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, answer: the last one that is filled; one row of counts: bad, empty, overridden by a different answer).

    lines: file, line, value with {"key": ..., "answer": ...}.
    """
    rows = tagged_jsonl(lines, fields(key=_TEXT, answer=_TEXT))
    empty = F.coalesce(F.trim("answer"), F.lit("")).isin("", "SKIP")
    good = rows.where(~F.col("bad") & F.col("key").isNotNull() & ~empty)
    w = Window.partitionBy("key").orderBy("file", "line")
    changed = good.withColumn("_before", F.lag("answer").over(w)).agg(F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col("answer"))).alias("overridden"))
    counts = rows.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & empty).alias("empty")).crossJoin(changed)  # one row each
    return last_wins(good.drop("bad"), "key").select("key", "answer"), counts


def write_jsonl(df: DataFrame, path: str, order: list | None = None) -> int:
    """Write JSON lines, in order within and across files if one is given; returns the number of rows."""
    out = df if order is None else df.orderBy(*order)
    out.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def write_one_file(rows: list[dict], path: str) -> int:
    """A small report as one file of JSON lines, put in place whole."""
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    tmp = to.with_name(f".{to.name}.tmp")
    tmp.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    tmp.replace(to)
    return len(rows)


def parse_loose_json(text: str | None) -> list[dict]:
    """Objects in what a model wrote: JSON lines or an array, between code fences and prose, with trailing commas."""
    text = re.sub(r"^\s*```\w*\s*$", "", text or "", flags=re.M).strip()
    try:
        whole = json.loads(text)
        return [x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict)]
    except ValueError:
        pass
    begin, end = text.find("["), text.rfind("]")
    if text.startswith("[") and end > begin:
        try:
            return [x for x in json.loads(re.sub(r",\s*([\]}])", r"\1", text[begin : end + 1])) if isinstance(x, dict)]
        except ValueError:
            pass
    found = []
    for line in text.split("\n"):
        line = line.strip().rstrip(",")
        if line.startswith("{"):
            try:
                x = json.loads(re.sub(r",\s*([\]}])", r"\1", line))
            except ValueError:
                continue
            if isinstance(x, dict):
                found.append(x)
    return found


def loose_objects(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """keep..., n (from 1), object (as JSON): the objects in each row's text."""
    ddl = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep), "n int, object string"])

    def run(batches):
        for pdf in batches:
            rows = [(*r[:-1], n, json.dumps(x, ensure_ascii=False, sort_keys=True)) for r in pdf[[*keep, column]].itertuples(index=False) for n, x in enumerate(parse_loose_json(r[-1]), 1)]
            yield pd.DataFrame(rows, columns=[*keep, "n", "object"])

    return df.select(*keep, column).mapInPandas(run, ddl)


def read_exam(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, group, max_points, question, source_text, answer_format, images of an exam document; missing values become empty."""
    schema = "exam_id string, items array<struct<id:string,group:int,max_points:int,question:string,source_text:string,answer_format:string,images:array<struct<path:string,sha256:string>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = doc.select("exam_id", F.posexplode("items").alias("pos", "i"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("exam_id", "pos", F.col("i.id").alias("id"), F.col("i.group").alias("group"), F.coalesce("i.max_points", F.lit(0)).alias("max_points"), empty("i.question").alias("question"), empty("i.source_text").alias("source_text"), empty("i.answer_format").alias("answer_format"), F.coalesce("i.images", F.array().cast("array<struct<path:string,sha256:string>>")).alias("images"))


def titles_of(tree: DataFrame) -> DataFrame:
    """epoch, title, once each, the first listing winning; tree: epoch, epoch_pos, titles (array)."""
    flat = tree.select("epoch", "epoch_pos", F.posexplode("titles").alias("pos", "title"))
    return flat.withColumn("_k", F.row_number().over(Window.partitionBy("title").orderBy("epoch_pos", "pos"))).where("_k = 1").select("epoch", "title")


def union_named(sets: list[tuple[str, DataFrame]]) -> DataFrame:
    """Protected sets as one table with set_name and set_rank; a set that is absent is an error of its reader."""
    out = None
    for rank, (name, df) in enumerate(sets):
        part = df.withColumns({"set_name": F.lit(name), "set_rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no protected set")
    return out


def image_kind(content: Column) -> Column:
    """The media type of image bytes by their first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def data_uri(content: Column) -> Column:
    return F.concat(F.lit("data:"), image_kind(content), F.lit(";base64,"), F.base64(content))


def settings_key(columns: list[str]) -> Column:
    """A hash of the settings that a logged result depends on."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
