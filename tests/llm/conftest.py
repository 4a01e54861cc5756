import pytest

from llm_data import EDGES, SCHEMAS, doc_rows


@pytest.fixture
def write(spark, tmp_path):
    """write(documents=[(id, text)...], labels=[...]) -> folder with the tables."""
    def run(**tables):
        for name, rows in tables.items():
            rows = doc_rows(rows) if name == "documents" else rows
            spark.createDataFrame(rows, SCHEMAS[name]).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return run


@pytest.fixture
def edges():
    return list(EDGES)
