import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import EXTRA, TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars) with repeats of a row, a hot source and null keys."""
    made = [(i, t, "en" if k % 3 else "de", "hot" if k % 2 else None if k % 5 == 0 else "cold", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    return made + [made[0], made[4]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def wide(spark, docs):
    """The same rows with further columns, named like what operators use inside."""
    out = docs
    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        out = out.selectExpr("*", f"CAST(NULL AS {kind}) AS `{name}`")
    return out


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

