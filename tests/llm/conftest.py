import os
import random

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(id, text)`` or ``(id, text, lang, source)``."""

    def make(rows, extra=()):
        full = [(*row, *(None,) * (4 - len(row)), None if row[1] is None else len(row[1])) for row in rows]
        df = spark.createDataFrame(full, SCHEMA)
        # columns whose names operators use inside
        for name in extra:
            df = df.selectExpr("*", f"'own' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded pseudo-words, ``prose(seed, n)``."""

    def text(seed, n, stock=400):
        words = [random.Random(f"w{i}").choice("bcdfglmnprst") + random.Random(f"v{i}").choice(["ama", "erol", "ixit", "oduna", "uves"]) + str(i % 37) for i in range(stock)]
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return text
