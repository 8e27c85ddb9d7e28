import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) or (doc_id, text, lang, source), and columns whose names clash with inner ones."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(full, DOCS)
        for name in ("h", "ids", "n", "digest", "shard", "offset", "start", "at", "component_id", "score", "kind"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
