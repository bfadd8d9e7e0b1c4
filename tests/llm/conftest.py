import pytest
from odd_documents import CLASHES, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"clash{k}"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
