import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source]), with columns whose names clash with the operators' own."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, TEXT_SCHEMA)
        for c in ("score", "key", "size", "parts", "node", "_id", "row"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return build
