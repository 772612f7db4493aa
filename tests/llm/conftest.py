"""Small tables that show every awkward case: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves
    T.StructField("region", T.StringType()), T.StructField("keep", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("length", T.StringType()),
])
SYLLABLES = {"en": "the of and er on th an re he in ed nd ha at en es or nt ea ti to it st".split(), "de": "der die und ein sch ich ch te ung en au be ge ver zu ß ü".split(),
             "fr": "le la les et de que é è eau ou ai on ent eux tre ion".split(), "es": "el la los que de ción ñ mente ado ar es os ca ra".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    made = ("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))
    return " ".join(w.capitalize() + "." if i % 11 == 0 else w for i, w in enumerate(made))


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append((i, prose(rng, lang, rng.randint(20, 120)), lang, f"src{i % 3}"))
    base = rows[0][1].split()
    for k in range(6):  # near copies of document 0, more and less alike
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = f"edit{k}"
        rows.append((n + k, " ".join(own), "en", "src0"))
    rows += [(n + 10, rows[1][1], "de", "src1"), (n + 11, rows[1][1], "de", "src1"), (n + 11, rows[1][1], "de", "src1")]
    rows += [(n + 20, None, None, None), (n + 21, "", "en", "src0"), (n + 22, " \t\n ", "en", "src0"), (n + 23, "two words", "en", "src0"), (None, "a text without an id, kept apart from the others", "en", None)]
    rows.append((n + 30, " ".join(prose(rng, "en", 50) for _ in range(120)), "en", "src0"))
    return rows


def frame(spark, rows: list[tuple], partitions: int = 3):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "x", "x", "x") for r in rows], DOCUMENTS).repartition(partitions)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
