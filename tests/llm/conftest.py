import random

import pytest

#: Columns that clash with what operators add.
CLASHING = ["score", "predicted", "n_words", "n_hit", "items", "spans", "kept", "n_lines", "n_removed", "class", "copy", "n_shingles", "slot", "bucket", "text_hash"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="session")
def edge_texts():
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(90)}" for _ in range(80))
    long = "\n".join(" ".join(f"v{r.randrange(4000)}" for _ in range(30)) for _ in range(700))
    return [(0, base), (1, None), (2, ""), (3, " \n\t  "), (4, long), (5, base), (5, base), (None, base + " more"), (7, "one"), (8, "é漢😀 ␂ ▁x"), (9, base.upper()), (10, "x" * 5000)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", len(t or ""), *CLASHING) for i, t in edge_texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
