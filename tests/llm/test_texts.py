"""Fingerprints, licences, near duplicates, decontamination, quality, language and pages against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from evalmart.llm import decontaminate, fingerprints, html_extract, language_id, licenses, ngram_join, quality
from evalmart.llm.common import BATCH_SETTING, hashed, kept, kept_in_light_batches, words
from tests.llm.conftest import frame, prose


# --- fingerprints ---

def test_edited_texts_and_likeness(spark, docs, rows, no_docs):
    for buckets in (1, 7):
        got = fingerprints.fingerprint_edits(docs, buckets).collect()
        by_id = defaultdict(list)
        for r in got:
            by_id[r.doc_id].append(r)
        order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        assert len(got) == len(order)
        for i, (doc_id, text) in enumerate(order):
            following, half = order[(i + 1) % len(order)][1], len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            assert hashlib.sha256(edited.encode()).hexdigest() in {r.edited_sha256 for r in by_id[doc_id]}
            assert all(r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in by_id[doc_id])
    prints = {t or "": by_id[d][0].fingerprint for d, t, *_ in rows}
    assert all(r.fingerprint == prints[t or ""] for d, t, *_ in rows for r in by_id[d])
    assert prints[""] == "" and prints["two words"] != ""
    assert fingerprints.fingerprint_edits(no_docs).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(3)
    long, other = prose(rng, "en", 4000), prose(rng, "de", 3000)
    part = " ".join(long.split()[500:1500])
    row = spark.createDataFrame([(long, part, other, f"{long} {other}")], "a string, b string, c string, d string")
    a, b, c, d = (fingerprints.sketch(row[x]) for x in "abcd")
    got = row.select(fingerprints.containment(a, b).alias("inside"), fingerprints.containment(a, c).alias("apart"), fingerprints.merge_sketches(a, c).alias("m"), d.alias("d"), a.alias("a")).first()
    assert got.inside > 0.95 and got.apart == 0
    assert set(got.m) <= set(got.d) and len(set(got.d) - set(got.m)) <= 4  # only shingles across the seam
    assert abs(len(got.a) / 4000 - 0.25) < 0.04


# --- licences ---

def test_license_scan(spark, no_docs):
    mit = licenses.LICENSES["MIT"]
    texts = [mit, f"MIT\n{mit}", "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(" ", "\n  ", 9), mit.replace("sublicense", "sub-license"), licenses.LICENSES["0BSD"].replace("AUTHOR", "OWNER"),
             "Prose.\nReleased under the MIT license\nMore prose.\n  * All rights reserved. *", "All rights reserved", "", None, "© 2001 x"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", None, "MIT", None, None, None, "all-rights-reserved"]
    assert got[5].notices == "MIT,all-rights-reserved" and got[0].notices == ""
    assert got[7].digest == got[8].digest == got[9].digest and got[7].license_id is None
    assert licenses.license_scan(no_docs).count() == 0


def test_whole_license_files(spark):
    body = licenses.LICENSES
    apache = licenses.STANDARD["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 A. Person")
    texts = [("MIT", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{body['MIT']}"), ("ISC", f"ISC License\n\nCopyright (c) 2020, A. Person\n\n{body['ISC']}"),
             ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n{body['BSD-3-Clause']}"), ("BSD-2-Clause", f"Copyright 2020 A. Person\nAll rights reserved.\n{body['BSD-2-Clause']}"),
             *((k, v.replace("\n", "\r\n")) for k, v in licenses.STANDARD.items()), ("Apache-2.0", apache), (None, f"MIT License\n{body['ISC']}")]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(frame(spark, [(i, t, "en", "s") for i, (_, t) in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == [k for k, _ in texts]
    assert {"Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0"} <= set(licenses.STANDARD)


def test_known_digests_equal_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sql = licenses.ORACLE_SQL.split("forms AS")[0].rstrip().rstrip(",") + " SELECT digest, license_id FROM digests"
    assert sorted(duckdb.sql(sql).fetchall()) == sorted(tuple(r) for r in licenses.known_digests(spark, licenses.KNOWN).collect())


# --- near duplicates ---

def brute_components(rows: list[tuple], size: int, percent: int) -> dict[int, tuple[int, int]]:
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), math.inf), math.inf if doc_id is None else doc_id)
    return {rows[i][0]: (len(sets[i]), None if least[root(i)] == math.inf else least[root(i)]) for i in range(len(rows))}


def near_copies(rng: random.Random, n: int, words_: int, edits: int) -> list[str]:
    base = prose(rng, "en", words_).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{k}x{rng.randrange(9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("leaf", "size", "percent"), [(16, 4, 85), (3, 4, 85), (3, 5, 80)])
def test_jaccard_components_equal_brute_force(spark, rows, no_docs, monkeypatch, leaf, size, percent):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rng = random.Random(leaf + size)
    more = [(500 + i, t, "en", "s") for i, t in enumerate(near_copies(rng, 60, 90, 5) + near_copies(rng, 25, 40, 2) + near_copies(rng, 12, 200, 20))]
    every = rows + more
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, every), size, percent).collect()}
    assert got == brute_components(every, size, percent)


def test_jaccard_keeps_one_of_each_group(spark, docs, rows, no_docs):
    kept = Counter(r.doc_id for r in ngram_join.keep_one(docs, 5, 80).collect())
    want = {d for d, (_, c) in brute_components(rows, 5, 80).items() if d == c}
    assert set(kept) == want and max(kept.values()) == 1
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.jaccard_components(no_docs).count() == 0


def test_links_grow_with_the_alike_texts_not_with_their_pairs(spark):
    texts = near_copies(random.Random(4), 300, 120, 2)
    join = ngram_join._Join(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 4, 85)
    links, sets = ngram_join.kept(join.links()), join.reps.count()
    assert sets - 1 <= links.count() < 3 * sets
    assert ngram_join.components(links).select("label").distinct().count() == 1


def test_pairs_of_a_group_of_near_copies_are_a_few_per_document(spark, monkeypatch):
    texts, counted, measured = near_copies(random.Random(9), 400, 120, 2), [], ngram_join._Join.measured
    monkeypatch.setattr(ngram_join._Join, "measured", lambda self, pairs: counted.append(pairs.select("a", "b").distinct().count()) or measured(self, pairs))
    join = ngram_join._Join(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 4, 85)
    assert ngram_join.components(join.links()).select("label").distinct().count() == 1
    assert 0 < sum(counted) < 16 * join.reps.count()


def test_candidates_wait_for_further_rounds_but_none_is_lost(spark, monkeypatch):
    for name, value in (("LEAF", 3), ("PIVOTS", 1), ("PROBES", 0), ("CANDIDATES", 1), ("WIDER", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    limits, across = [], ngram_join._Join.across
    monkeypatch.setattr(ngram_join._Join, "across", lambda self, cells, labels, limit: limits.append(limit) or across(self, cells, labels, limit))
    every = [(i, t, "en", "s") for i, t in enumerate(near_copies(random.Random(12), 80, 90, 9))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, every), 4, 85).collect()}
    assert got == brute_components(every, 4, 85)
    assert limits[:2] == [1, 64]


def test_shingles_of_a_batch_take_little_memory_at_once():
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(range(400), pa.int64()), pa.array([f"{i} {text}" for i in range(400)])], ["doc_id", "key", "text"])
    order = SimpleNamespace(value=np.zeros(1 << ngram_join.ORDER_BITS, np.int64))
    for run in (ngram_join._nodes(4), ngram_join._prefixes(4, 85, order)):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 << 20


def test_texts_are_sent_in_fewer_bytes_than_their_shingles(spark):
    text = prose(random.Random(6), "en", 1000)
    join = ngram_join._Join(frame(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (2, text + " more", "en", "s"), (3, "other", "en", "s")]), 4, 85)
    wanted = join.spark.sparkContext.broadcast(join.bitmap(join.reps.filter("n > 500"), "key"))
    sent = join.keyed.mapInArrow(ngram_join._packed_texts(wanted), "rep long, key long, packed binary").collect()
    assert sorted(r.rep for r in sent) == [1, 1, 2] and max(len(r.packed) for r in sent) < 4 * 997
    assert join.linked(join.overlaps(join.links().selectExpr("a", "b", "false AS exact", "1L AS region", "a AS own"))).count() == 1


def test_unrelated_texts_of_one_region_are_not_sent(spark, monkeypatch):
    rng, sent, overlaps = random.Random(31), [], ngram_join._Join.overlaps
    phrase = prose(rng, "en", 6)
    rows = [(i, f"{phrase} {prose(rng, 'en', 4000 if i % 4 == 0 else 60)}", "en", "s") for i in range(60)]
    rows += [(100 + i, t, "en", "s") for i, t in enumerate(near_copies(rng, 40, 90, 4))]
    monkeypatch.setattr(ngram_join._Join, "overlaps", lambda self, pairs: sent.extend((r.a, r.b) for r in pairs.select("a", "b").collect()) or overlaps(self, pairs))
    monkeypatch.setattr(ngram_join, "prefix_size", lambda n, percent: n)  # all shingles: the phrase is a region of all the first texts
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)
    ids = {r.sid: r.rep for r in ngram_join._Join(docs, 4, 85).reps.collect()}
    assert not [(a, b) for a, b in sent if ids[a] < 100 and ids[b] < 100]


def test_sketches_never_exceed_the_symmetric_difference():
    rng = np.random.default_rng(3)
    every = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    crowded = np.arange(6000, dtype=np.uint64) << np.uint64(13)  # all in one bucket
    sets = [every[:3], every[:900], every[600:1500], every[:4000], every[1000:5100], every[:9000], crowded, np.concatenate([crowded[:4000], every[:100]]), every[:0]]
    sketches = ngram_join.Sketches([ngram_join.sketch(s) for s in sets])
    assert sorted(set(sketches.sizes.tolist())) == [256, 1024, 2048, 4096]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = len(np.setxor1d(a, b))
            assert sketches.distances(np.array([i]), np.array([j]))[0] <= apart
    x, y = rng.integers(0, 1 << 63, (2, 8000)).astype(np.uint64)
    far = ngram_join.Sketches([ngram_join.sketch(x), ngram_join.sketch(y)]).distances(np.array([0]), np.array([1]))[0]
    most = (16000 - far) // 2
    assert 100 * most < ngram_join.near_percent(80) * (16000 - most)


def test_shuffle_files_and_tables_of_a_join_go_when_they_are_read(spark, monkeypatch):
    paths, kept = [], ngram_join.kept
    monkeypatch.setattr(ngram_join, "kept", lambda df: paths.append((out := kept(df)).kept_at) or out)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    ngram_join.jaccard_components(frame(spark, [(i, t, "en", "s") for i, t in enumerate(near_copies(random.Random(8), 80, 90, 4))]), 4, 85).count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    left = [p for p in paths if os.path.exists(p.removeprefix("file://").removeprefix("file:"))]
    assert len(paths) > 12 and len(left) <= 3  # sets, links and labels

    def shuffled() -> int:
        tracker = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
        return sum(1 for f in tracker.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f)

    files = shuffled()
    table = kept(spark.range(5000).repartition(7))
    for _ in range(50):
        if shuffled() <= files:
            break
        time.sleep(0.2)
    assert shuffled() <= files and table.count() == 5000


def test_null_and_repeated_ids_keep_their_own_texts(spark, no_docs):
    rng = random.Random(21)
    a, b, c, d, e, f = (prose(rng, "en", 40) for _ in range(6))
    texts = [(3, a), (7, a), (7, b), (8, c), (8, d), (None, a), (None, e), (None, e), (None, f), (9, f), (9, f), (11, ""), (11, " "), (None, None)]
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, [(i, t, "en", "s") for i, t in texts]), 5, 80).collect())
    assert got == Counter([(3, a), (7, b), (8, c), (8, d), (None, e), (9, f), (11, ""), (11, " "), (None, None)])
    assert ngram_join.keep_one(no_docs).count() == 0


def test_words_and_hashes():
    texts = ["A b\tC", "", None, "É ß x y", "w" * 200 + " " + "w" * 200]
    flat, offsets = words(pa.array(texts))
    assert flat.to_pylist() == ["a", "b", "c", "É", "ß", "x", "y", "w" * 200, "w" * 200] and offsets.tolist() == [0, 3, 3, 3, 7, 9]
    h = hashed(flat)
    assert h[7] == h[8] and len(set(h.tolist())) == 8
    assert hashed(flat.slice(3, 2)).tolist() == h[3:5].tolist()


# --- decontamination ---

def test_leaks_exact_and_reparameterised(spark, no_docs):
    rng = random.Random(8)
    item = "A train leaves the station with 120 passengers and Alice counts 120 seats while 35 kg of freight wait for Bob near the gate of the old yard"
    other = prose(rng, "en", 30)
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "Tiny item here")], "item_id long, text string")
    changed = item.replace("120", "77").replace("35", "8").replace("Alice", "Carol").replace("Bob", "Dave")
    broken = item.replace("with 120", "with 5").replace("Alice", "Bob", 1)
    filler = [prose(rng, "en", 60) for _ in range(8)]
    texts = [f"{filler[0]} {item} {filler[1]}", f"{filler[2]} {changed}", f"{other} {filler[3]}", filler[4], None, "", f"some words, tiny item here, {filler[5]}", " ".join(item.split()[:10]), f"{filler[6]} {item} {item}"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert {(0, 1), (1, 1), (2, 2), (6, 5), (8, 1)} == set(got)
    assert got[(0, 1)].changed_slots == 0 and got[(1, 1)].changed_slots >= 3 and got[(0, 1)].coverage == 1
    assert {r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), items).collect()} == {3, 4, 5, 7}
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(frame(spark, rows), items.limit(0)).count() == 0
    assert broken != item


def leaked(spark, texts: list[str], items: list[str]) -> dict[tuple[int, int], tuple]:
    """(document, item) -> (n_windows, coverage, changed_slots), by place in the lists."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.coverage, r.changed_slots) for r in decontaminate.leaks(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), bench).collect()}


def test_items_dense_in_numbers_are_sought_exactly(spark):
    rng = random.Random(9)
    items = ["Compute 17 * 23 .", "What is 12 + 7 ?", "Sort 5, 3, 9, 1, 7, 2, 8, 4, 6", "For the record the clerk of the town wrote down these values 4 8 15 16 23 42 108 7 9 11 13"]
    filler = [prose(rng, "en", 30) for _ in items]
    texts = [f"{f}. {item} {f}" for f, item in zip(filler, items, strict=True)]
    other = ["Compute 17 * 24 .", "What is 12 + 8 ?", "Sort 5, 3, 9, 2, 7, 1, 4, 8, 6", "For the record the clerk of the town wrote down these values 3 7 14 15 22 41 107 6 8 10 12"]
    got = leaked(spark, texts + other, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (7, 3)}
    assert all(got[(i, i)][1:] == (1, 0) for i in range(4)) and got[(3, 3)][0] == 16
    assert got[(7, 3)][1] < 1


def test_a_long_passage_of_a_longer_item_is_a_leak(spark):
    rng = random.Random(10)
    item = " ".join(f"{w}{i}x" for i, w in enumerate(prose(rng, "en", 300).lower().replace(".", "").split())).split()
    texts = [" ".join(item[100 : 100 + n]) for n in (100, 50, 49)]
    got = leaked(spark, texts, [" ".join(item)])
    assert {k: v[0] for k, v in got.items()} == {(0, 0): 93, (1, 0): 43}


def test_openers_are_read_as_words_and_as_names(spark):
    rng = random.Random(11)
    short, unit = "Explain why lakes freeze from above", "In which lakes do large eels live"
    said = "Alice buys 3 red apples. Alice eats 2 of them at once. Carol sells what remains to Bob for 5 coins."
    items = [short, unit, said, "Tiny boats drift. Rivers carry them to sea"]
    head = prose(rng, "en", 20).rstrip(".")
    texts = [f"{head} {short}", f"{head} 7 {unit}", said.replace("Alice", "Erin").replace("Carol", "Gus").replace("Bob", "Ida").replace("3", "4"), said.replace("Alice eats", "Gus eats").replace("Bob", "Alice").replace("2", "3"), "so tiny boats drift. Rivers carry them to sea"]
    got = leaked(spark, texts, items)
    assert {(0, 0), (1, 1), (2, 2), (4, 3)} <= set(got) <= {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)}
    assert got[(2, 2)][1] >= 0.4 and got[(2, 2)][2] >= 3


def test_a_text_is_read_the_same_whatever_stands_before_it():
    alone, after = (decontaminate.template(pa.array(t)) for t in (["km are long"], ["up to 5", "km are long"]))
    assert alone[2].tolist() == after[2][3:].tolist() == [0, 0, 0]


def test_windows_of_a_batch_take_little_memory_at_once():
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(range(400), pa.int64()), pa.array([f"{i} {text}" for i in range(400)])], ["doc_id", "_key", "text"])
    tracemalloc.start()
    for _ in decontaminate._windows([decontaminate.WINDOW], bytes(1 << (decontaminate.BITMAP_BITS - 3)))(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20


def test_texts_go_to_workers_in_light_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows, before = spark.range(4000).selectExpr("id", "repeat('x', 3000) AS text").coalesce(1), spark.conf.get(BATCH_SETTING)
    assert [max(r.n for r in how(rows.mapInArrow(sizes, "n long")).collect()) for how in (kept, kept_in_light_batches)] == [4000, 1393]
    assert spark.conf.get(BATCH_SETTING) == before


# --- quality ---

def brute_model(texts: list[str]):
    """Interpolated modified Kneser-Ney of order 4 with plain dictionaries."""
    top = Counter(g for t in texts for g in map(int, quality.grams(t)))
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = Counter(g & ((1 << 16 * k) - 1) for g in levels[k + 1])
    ds = {k: quality.discounts(Counter(levels[k].values())) for k in levels}

    def p(k: int, gram: int) -> float:
        if k == 0:
            return 1 / quality.UNITS
        own = gram & ((1 << 16 * k) - 1)
        same = [(g, n) for g, n in levels[k].items() if g >> 16 == own >> 16]
        lower = p(k - 1, gram)
        if not same:
            return lower
        total = sum(n for _, n in same)
        taken = {g: ds[k][min(n, 3) - 1] for g, n in same}
        n = levels[k].get(own, 0)
        return (n - taken[own] if n else 0) / total + sum(taken.values()) / total * lower

    return lambda text: -sum(math.log(p(4, int(g))) for g in quality.grams(text)) / len(quality.grams(text))


def test_perplexity_equals_brute_force(spark, docs, rows, no_docs):
    trusted = [d for d, *_ in rows if d is not None and d % 5 == 0]
    frame_ = spark.createDataFrame([(d,) for d in trusted], "doc_id long")
    train = {r.doc_id for r in docs.withColumn("_key", quality.row_key()).filter(~quality.held_out()).collect()} & set(trusted)
    model = brute_model([t or "" for d, t, *_ in rows if d in train])
    got = quality.quality(docs, frame_, least=4).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    for r in got[::4]:
        if texts[r.doc_id]:
            assert r.perplexity == pytest.approx(math.exp(model(texts[r.doc_id])), rel=1e-6)
    assert all((r.perplexity is None) == (r.n_units == 0) and (r.n_units > 0 or not r.keep) for r in got)
    assert all(r.keep == (r.perplexity <= r.threshold + 1e-6) for r in got if r.perplexity)
    assert quality.keep_quality(docs, frame_).columns == docs.columns
    assert quality.quality(no_docs, frame_).count() == 0
    assert {r.keep for r in quality.quality(docs, frame_.limit(0)).collect() if r.n_units} == {True}


def test_quality_finds_held_out_junk(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, "en", 80), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + rng.choice(["!!", "###", " |"]) for w in prose(rng, "en", 60).split()), "en", "s") for i in range(40)]
    trusted = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    got = {r.doc_id: r.keep for r in quality.quality(frame(spark, good + junk), trusted, quantile=0.98).collect()}
    assert sum(got[d] for d, *_ in junk) == 0
    assert sum(got[d] for d, *_ in good[300:]) >= 90


# --- language ---

def test_languages_of_documents_and_pages(spark, docs, rows, no_docs):
    found = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert all(found[d].lang == lang and found[d].keep for d, t, lang, _ in rows if lang and t and len(t) > 60)
    assert not found[rows[-3][0] if rows[-3][1] is None else 80].keep or found[80].text_lang is None
    rng = random.Random(6)
    pages = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        pages.append((i, f"http://{lang}.example.{'org' if lang == 'en' else 'de'}/{i}", f'<html lang="{lang}"><nav>le la les</nav><p>{prose(rng, lang, 30)}</p></html>'))
    pages += [(100, "http://de.example.de/x", "<html><p></p></html>"), (101, None, None), (102, "http://en.example.org/y", '<html lang="xx"><p>the of and</p>')]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages) and all(got[i].lang == ("en", "de")[i % 2] for i in range(80))
    assert got[100].text_lang is None and got[100].lang == "de"  # the host alone decides
    assert got[102].declared == "other" and got[102].lang == "en"
    assert language_id.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), no_docs).count() == 0
    assert language_id.keep_identified(docs).columns == docs.columns


def test_fusion_equals_bayes_by_hand(spark):
    rows = [(1, [-1.0, -2.0, -9.0, -9.0], "h", "d", "s", "de"), (2, [-2.0, -1.0, -9.0, -9.0], "h", "d", "s", ""), (3, [0.0, 0.0, 0.0, 0.0], "h", "d", "s", "xx")]
    frame_ = spark.createDataFrame(rows, "id long, likelihood array<double>, host string, domain string, suffix string, declared string")
    got = {r.id: r for r in language_id.fuse(frame_).collect()}
    corpus = np.array([2, 2, 1, 1]) / 6
    declared = {"de": np.array([2, 1, 1, 1]), "": np.array([1, 2, 1, 1]), "other": np.ones(4)}
    total = sum(declared.values()) + 3 * np.ones(4)
    for i, own in ((1, [1, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [0, 0, 0, 0])):
        votes = np.array([1.0, 1, 0, 0]) - own
        domain = (votes + 5 * corpus) / (votes.sum() + 5)
        host = (votes + 5 * domain) / (votes.sum() + 5)
        logs = np.array(rows[i - 1][1]) + np.log(declared[got[i].declared] / total) + np.log(host) + np.log(domain / corpus)
        want = np.exp(logs - logs.max())
        assert got[i].posterior == pytest.approx(list(want / want.sum()), abs=1e-5)


# --- pages ---

def lcs(a: list, b: list) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        for limit in (0, 20, 1 << 26):  # halved down to single lines, now and then, never
            places = html_extract.shared_lines(a, b, limit)
            rest = iter(b)
            assert len(places) == lcs(a, b) and places == sorted(set(places)) and all(any(a[i] == y for y in rest) for i in places)


def test_pages_lose_what_neighbours_share(spark):
    menu = "<div>Home</div><div>All stories of the day</div>"
    pages = [(i, f"http://h.example/news/{i}.html", f"<html><body>{menu}<p>Story {i} about &amp; &lt;things&gt;\n\n  number {i * 7}.</p><p>It goes on for long, part {i}.</p><div>Write to us</div></body>") for i in range(30)]
    pages += [(100 + k, f"http://copies.example/{k}", "<p>The same article on two addresses.</p><p>Every line.</p>") for k in (0, 1)]
    pages += [(200, "http://alone.example/", "<p>One</p>"), (201, None, None), (202, "http://h2.example/a", ""), (203, "http://m.example/1", "<nav>x<ul><li>y</nav><main><p>Kept line</p></main><p>Shared</p>"), (204, "http://m.example/2", "<main><p>Kept line</p></main><p>Shared</p><p>Own</p><p>Own words that make the page differ</p>")]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == len(pages)
    for i in range(30):
        assert got[i].text == f"Story {i} about & <things> number {i * 7}.\nIt goes on for long, part {i}." and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == "The same article on two addresses.\nEvery line."
    assert (got[200].text, got[201].text, got[202].text) == ("One", "", "")
    assert got[204].text == "Kept line\nOwn\nOwn words that make the page differ" and got[203].text.startswith("Kept line")
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_differenced_against_the_next_other_page(spark):
    menu = "<div>Home</div><div>All stories</div>"
    story = f"{menu}<p>The same long story on many addresses of one host.</p>"
    pages = [(i, f"http://h.example/story/{i}", story) for i in range(6)] + [(9, "http://h.example/story/9", f"{menu}<p>Another story altogether, also long enough.</p>")]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == {**dict.fromkeys(range(6), "The same long story on many addresses of one host."), 9: "Another story altogether, also long enough."}
    assert tuple(html_extract.deleted_lines(pages).first()) == (7, 14)


@pytest.mark.parametrize(("page", "text"), [
    ("<header>H</header><article><h1>T</h1><p>a<br>b</p><aside>s</aside><div class='comments'>c</div></article><footer>f</footer>", "T\na b"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- x --><p>one &eacute;&nbsp;two</p><form><p>in</p></form>", "one é two"),
    ("<nav><ul><li>never closed<article><p>text</p>", "text"),
    ("<div class='page has-sidebar'><p>text</p></div>", "text"), ("<p class=no-comments>text", "text"), ("<p class='social-science'>text", "text"), ("<p id=widget-development>text", "text"),
    ("<article><header class='entry-header'><h1>T</h1></header><p class='related-work'>text</p><figure><img><figcaption>c</figcaption></figure></article>", "T\ntext\nc"),
    ("<div class='site-header'>h</div><div id=mainNav>n</div><div class='ad-slot top'>a</div><p>text</p><ul class='comment-list'><li>c</ul>", "text"),
    ("<p>one <a href=\"x>two</a> three</p>", "one two three"), ("a <b", "a <b"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("plain", "plain"), ("<p hidden>no</p><p>yes</p>", "yes"), ("a < b and c > d", "a < b and c > d"),
])
def test_lines_of_markup(page, text):
    assert "\n".join(t for t, _ in html_extract.lines(page)) == text


@pytest.mark.parametrize("unit", ["<a ", '<a ">" ', "<a '>\"", "<b></i>", "<script ", "<!-- ", "</a ", "<", "<nav><article></article>"])
def test_broken_markup_takes_linear_time(unit):
    page = unit * (1_000_000 // len(unit)) + ">"
    start = time.monotonic()
    html_extract.lines(page)
    assert time.monotonic() - start < 10


def test_names_break_ties_of_differencing(spark):
    """Near copies and articles keep what they share, but for parts with a suspicious name."""
    page = "<main><p>Long and shared words of two near copies.</p><div class='read-more related'>Read on</div><p>Own {}</p></main><p class='mini-promo'>Buy</p>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(2)] + [(7, "http://other.example/", page.format(7))]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Long and shared words of two near copies.\nOwn 0" and got[1].endswith("\nOwn 1") and got[7].endswith("Own 7\nBuy")


def test_extraction_equals_a_plain_version(spark):
    """The whole query: one host at a time in memory, textbook alignment, no keys and no joins."""
    rng = random.Random(8)
    words = "menu home news about contact imprint".split()
    pages = []
    for i in range(60):
        body = "".join(f"<p{rng.choice(['', ' class=x-promo'])}>{rng.choice(words)} {rng.randrange(3)}</p>" for _ in range(rng.randrange(8)))
        inner = f"<article>{body}</article>" if rng.random() < 0.3 else body
        pages.append((i, rng.choice([None, f"http://h{rng.randrange(3)}.example/{rng.choice('ab')}/{i}"]), f"<p>Top</p>{inner}<p>End {i % 4}</p>"))
    pages.append(pages[3])
    hosts: dict[str, dict] = {}
    for place, (i, url, html) in enumerate(pages):
        host, _, path = (url or "")[7:].partition("/")
        found = html_extract.lines(html)
        hosts.setdefault(host, {}).setdefault(tuple(t for t, _ in found), []).append((("/" + path) if url else "", url or "", i, place))
    # pages of one address have no order of their own, so only hosts whose first addresses differ have one right answer
    frame_ = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, gone string").repartition(4)
    rows = html_extract.extract_pages(frame_).select("page_id", "text").collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages)
    checked = 0
    for signs in hosts.values():
        order = sorted((min(rows), sign) for sign, rows in signs.items())
        if len({first[:2] for first, _ in order}) < len(order):
            continue
        for k, (first, sign) in enumerate(order):
            def alike(m):
                a, b = first[0].split("/"), order[m][0][0].split("/")
                return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            near = [m for m in (k - 1, k + 1) if 0 <= m < len(order)]
            theirs = order[max(near, key=lambda m: (alike(m), -m))][1] if near else ()
            shared = html_extract.shared_lines(list(sign), list(theirs))
            assert len(shared) == lcs(sign, theirs)
            most = sum(len(sign[i]) for i in shared) > 0.6 * sum(map(len, sign))
            for *_, place in signs[sign]:
                found = html_extract.lines(pages[place][2])
                gone = {i for i in shared if found[i][1] == 2 or (found[i][1] == 0 and not most)}
                assert got[pages[place][0]] == "\n".join(t for i, (t, _) in enumerate(found) if i not in gone)
                checked += 1
    assert checked > 20
