import random

import pytest

#: Columns of an input that have the names which operators use inside.
CLASHING = ["doc", "sig", "body", "keep", "k", "node", "size", "words", "rank", "n", "pos", "pos2", "copy", "offset", "kept", "votes", "quality", "formatted", "root", "key"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    base = words(rng, 120)
    rows = [
        (1, base, "en", "a"),
        (2, base + " z", "en", None),
        (2, base + " z", "en", None),
        (3, None, "de", "b"),
        (4, "", None, "b"),
        (5, " \n\t\n", "en", "a"),
        (6, words(rng, 40_000), "en", "c"),
        (None, "No id here\nshared line", "de", "c"),
        (None, None, None, None),
        (7, "é" * 50_000, "fr", "c"),
        (8, "123 456 \u0000 !!", "en", "a"),
    ]
    rows += [(100 + i, f"unique {words(rng, 30)}\nshared line\n  Shared LINE  ", "en", "d") for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Those rows as a table with clashing columns besides."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), "doc_id bigint, text string, lang string, source string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(5)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def rows():
    return edge_rows()
