import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of ``(doc_id, text, source)`` rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        for name in ("size", "key", "node", "start", "target", "rank", "spans", "row", "label", "id"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


def texts(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
