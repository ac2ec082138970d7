import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, h string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdrst") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, 7, "x") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and white texts, repeated rows, ties, a null id, a very long text and one without any break; clashing extra columns."""
    a = prose(1, 120)
    return docs_of([
        (1, None), (2, ""), (3, " \n\t "), (4, a), (4, a), (5, a), (None, prose(2, 30)), (6, "\n".join(prose(3 + k, 60) for k in range(40))),
        (7, "x" * 5000), (8, "\n\n"), (9, "é ö ▁ 日本 " * 40),
    ])


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
