"""Documents with every awkward case: nulls, empty and very long texts, ties, repeats and clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h long, id long, rid long, bucket long, label int, score double, kept boolean"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]) for i in range(0, n, 9)).replace(". ", ".\n", 3)


def rows():
    base = prose(1, 200)
    near = base.replace(base.split()[50], "changed", 1)
    out = [(i, prose(100 + i, 40 + i % 30), "en", f"src{i % 3}", 1) for i in range(40)]
    out += [
        (100, base, "en", "src0", 1), (101, base, "en", "src0", 1), (102, near, "en", None, 1), (103, base.upper(), "de", "src1", 1),
        (104, "", "en", "src0", 0), (105, None, None, None, None), (106, "  \n\t ", "en", "src0", 3), (107, "one", "en", "src1", 3),
        (108, "two words", "en", "src1", 9), (109, "Ünï cödé 漢字 🙂 " * 20, "xx", "src2", 5), (110, prose(7, 40_000), "en", "src0", 9),
        (None, "no id at all here", "en", "src0", 1), (None, base, "en", "src0", 1), (111, "same row", "en", "src2", 1), (111, "same row", "en", "src2", 1),
        (112, "one id two texts", "en", "src2", 1), (112, base, "en", "src2", 1), (113, "ends with nul \x00 and line\n\n", "en", "src2", 1),
    ]
    return [(*r, 7, 7, 7, 7, 7, 7, 7, 7.0, True) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
