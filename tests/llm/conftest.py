import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or from (id, text) or (id, text, source) tuples."""

    def make(rows, clashing=False):
        full = []
        for place, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (place, row)
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, len(text) if text else 0))
        docs = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
        if clashing:
            # Names that the operators use inside.
            for name in ("id", "key", "size", "row", "node", "copies", "verdict", "cleaned", "found", "place", "component", "u", "present"):
                docs = docs.selectExpr("*", f"'{name}' AS `{name}`")
        return docs

    return make
