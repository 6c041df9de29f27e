import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang]) rows, with columns that clash with what
    the operators add."""
    def make(rows, extra=True):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(rows, DOCUMENT)
        if extra:
            for name in ("score", "lang_pred", "spans", "fp", "node", "root", "label", "rate", "piece", "length", "id", "part", "chunk", "word"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


LONG = "onde thetion rea " * 60_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "!!! ... 12"), (None, "some words without an id here"), (5, "same words in both of these rows"),
       (5, "same words in both of these rows"), (6, "same words in both of these rows"), (7, "ÄÖ ß İ Σ ｗｉｄｅ \u200b"), (8, LONG)]
