from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    for name in ("key", "h", "size", "fp", "row", "w", "cs", "at", "token", "sid", "target", "base_", "d1", "d2", "anchor", "_text", "_key", "n", "x", "member", "value", "tag"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def clash():
    return clashing


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, shared passages, odd white space, nulls, empty and long texts."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(150)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if i % 5 == 0:
            words[10:10] = passage[: 30 + i % 31]
        if i % 11 == 0:
            words = words + words
        text = "".join(w.title() + r.choice([" ", "  ", "\n", "\t", ". "]) for w in words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(100 + i, rows[7][1], "en", "s0", len(rows[7][1])) for i in range(4)]
    near = rows[20][1].split(" ")
    rows += [(200 + i, " ".join(near[:i] + ["Zz"] + near[i + 1 :]), "en", None, 1) for i in range(0, 12, 3)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t", "en", "s1", 3), (303, " ".join(r.choice(vocabulary) for _ in range(8000)), "en", "s2", 1), (304, "lo " * 400, "en", "s2", 1), (7, rows[7][1], "en", "s3", 1), (None, "alone here", "en", "s3", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus, clash):
    return clash(spark.createDataFrame(corpus, SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
