import pytest
from pyspark.sql import types as T

#: Columns of documents, and one whose name clashes with those that operators use inside.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("row", T.StringType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(k, t, "en", f"src{(k or 0) % 3}", len(t or ""), "x") for k, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS).repartition(3)

    return make


@pytest.fixture
def write_tables(spark, tmp_path):
    """A folder of tables, as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
