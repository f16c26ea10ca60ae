import pytest


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """Write a documents table (and others) to a folder; return the folder."""
    def make(rows, **tables):
        d = tmp_path_factory.mktemp("sf")
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        spark.createDataFrame(full, schema).repartition(2).write.parquet(f"{d}/documents.parquet")
        for name, (data, kinds) in tables.items():
            spark.createDataFrame(data, kinds).write.parquet(f"{d}/{name}.parquet")
        return str(d)
    return make


@pytest.fixture(scope="session")
def all_docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
