import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents of (doc_id, text) pairs, the other columns as the table has them."""

    def make(rows, extra: bool = False):
        schema = COLUMNS + (", key string, ids string, n_words string, component_id string" if extra else "")
        more = ("k", "i", "w", "c") if extra else ()
        return spark.createDataFrame([(d, t, "en", "src", len(t or ""), *more) for d, t in rows], schema)

    return make


@pytest.fixture
def sf_dir(tmp_path):
    """A folder of tables; write(docs) puts documents there."""

    class Folder:
        path = str(tmp_path)

        def write(self, df, name="documents"):
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
            return self.path

    return Folder()
