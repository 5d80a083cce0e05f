import os
import random

import pytest

SF = "/root/testdata/sf0.001"

LONG_WORDS = 30_000


def table(folder, name):
    """A table's rows as dicts, through DuckDB-free reading."""
    import pyarrow.dataset as ds

    return ds.dataset(os.path.join(folder, f"{name}.parquet")).to_table().to_pylist()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", "b"),
        (4, None, "en", "a"), (5, "", None, None), (6, " \t\n ", "fr", "b"), (7, "word", "fr", "c"),
        (8, prose(LONG_WORDS), "de", "a"), (9, prose(200) + "\n" + base, None, None),
        (10, "Ünïcödé ßtraße наука 漢字 é \x1c x y İ", "de", "c"),
        (11, "!!! ### 123", "en", "c"), (11, "!!! ### 123", "en", "c"), (12, prose(60), "en", "a"),
        (12, prose(60), "en", "a"), (None, base, "en", "a"), (None, None, None, None),
        (13, "a " * 3000, "en", "b"), (14, "x" * 5000, "en", "b"), (15, "line one here\n" * 40, "en", "b"),
    ]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 7, "clash", 1.5, [1]) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, size int, h string, score double, sigs array<int>")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
