import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Rows written as Parquet and read again, as the operators get them."""

    def make(rows, ddl, name="t"):
        spark.createDataFrame(rows, ddl).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return make
