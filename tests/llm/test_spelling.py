"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalmart.llm import spelling
from tests.llm.conftest import DOCUMENTS, frame


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts: dict[str, int], factor: int = 2) -> list[tuple]:
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= factor * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


def words_of(rows: list[tuple], edited: int, least_letters: int, least_count: int) -> dict[str, int]:
    counts: Counter = Counter()
    lower = str.maketrans(spelling._UPPER, spelling._LOWER)
    for doc_id, text, *_ in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % edited == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def made(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(150)}
    words |= {"aaaaa", "aaaa", "aaa", "aaaaaa", "hello", "helo", "hell", "jello", "yello", "z" * 300, "z" * 299, "z" * 150 + "y" + "z" * 149}
    return {w: rng.choice([3, 3, 4, 6, 7, 14, 30, 61, 200]) for w in words}


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 7), (3, 16)])
def test_variants_equal_all_pairs(spark, seed, partitions):
    counts = made(seed)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # borders between partitions inside words
    try:
        got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == brute(counts)


def test_nodes_are_shared_exactly_by_prefixes(spark):
    counts = made(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        words = spark.createDataFrame([(i, w) for i, w in enumerate(counts)], "_wid long, word string")
        for backwards in (False, True):
            numbers: dict[str, set] = {}
            for r in words.join(spelling.trie_nodes(words, backwards), "_wid").collect():
                spelled = r.word[::-1] if backwards else r.word
                assert len(r.nodes) == len(spelled) + 1
                for i, node in enumerate(r.nodes):
                    numbers.setdefault(spelled[:i], set()).add(node)
            assert all(len(s) == 1 for s in numbers.values()) and len(set.union(*numbers.values())) == len(numbers)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_documents(spark, rows):
    rows = rows + [(None, "Straße STRASSE straße × ÷÷÷÷÷ naïve"), (500, "x" * 3000 + " " + "x" * 2999), (501, "x" * 3000), (502, "x" * 3000), (503, "x" * 2999), (504, "x" * 2999)]
    rows = [(*r[:2], *r[2:], *["en", "s"][len(r) - 2 :]) for r in rows]
    for edited, letters, least in ((97, 5, 3), (2, 2, 2)):
        counts = words_of(rows, edited, letters, least)
        found = spelling.vocabulary(frame(spark, rows), edited, letters, least)
        assert {r.word: r.n for r in found.collect()} == counts
        assert sorted(map(tuple, spelling.variants(found).collect()), key=repr) == brute(counts)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCUMENTS)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([], DOCUMENTS).union(spark.range(2).select(F.col("id"), *[F.lit(None)] * 8))).collect() == []
