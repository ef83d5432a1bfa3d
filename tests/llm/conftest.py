import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, source]) as a documents table with a column whose name clashes with results."""

    def make(rows, *extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            df = df.selectExpr("*", f"'mine' as {name}")
        return df

    return make
