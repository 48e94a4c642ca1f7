import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, source)`` as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    prose = " ".join(rng.choice(words) for _ in range(120))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "one two"),
        (6, long),
        (7, long + " end"),
        (8, prose),
        (9, prose, None),
        (9, prose, None),
        (10, prose.upper(), "t"),
        (None, prose, "t"),
        (None, None, None),
        (11, "é\x85b\xa0c\x1cd \U0001f600 ² ½ ſ İ Σ a​b <|endoftext|> <|ENDOFTEXT|> don't I'LL"),
        (12, "The quick brown fox. " * 40, "u"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return made(spark, edge_rows())


@pytest.fixture(scope="session")
def edges_clash(spark, edges):
    """The same with columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "rank size h _n _i _start block word c lp component n key id sig shard slot words lines windows kept length piece media".split()
    return edges.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def nothing(spark):
    return made(spark, [(1, "x")]).where("doc_id < 0")


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
