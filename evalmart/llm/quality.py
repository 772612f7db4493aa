"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on all trusted text.

Grams are four UTF-16 units; texts start with three marks. Counts of trusted grams are summed over the corpus and dealt to
shards by the unit before the last one: every order of a gram, its histories and its continuation counts share that unit,
so a shard holds all it needs beside the discounts (counts of counts) and the unigram. The documents' grams meet the shards
in a count join: each slice of texts sends every shard one packed row of (gram, document, count), gets one vector of
log-probabilities back, and the vectors are summed per slice. Rows for one shard are salted, and texts are not shuffled.

A document is kept if its mean negative log-probability is at most the ``quantile`` of held-out trusted documents of its
language, or of all languages where fewer than ``least`` of those exist. One trusted document in five, by its key, is held
out of the counts: texts that the model has seen look better than new ones, most of all where trusted text is scarce.

Defined results: null and empty text has no perplexity and is not kept; without trusted text there is no threshold and all
other documents are kept; a null language is a language of its own; equal rows get equal decisions; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmart.llm.common import checked_broadcast, chunk_id, kept, kept_in_light_batches, pack, slices, text_of, unpack

ORDER = 4
START = 0xFFFF
UNITS = 1 << 16
SHARDS = 64
SALTS = 4
QUANTILE = 0.995
LEAST = 30
HELD_OUT = 5  # one trusted document in so many sets thresholds, the others train
STEPS = 1000  # thresholds are exact to a thousandth of a nat
_U = np.uint64


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)


def grams(text: str) -> np.ndarray:
    """One packed gram per unit: the unit and the three before it."""
    units = np.concatenate([np.full(ORDER - 1, START, np.uint64), _units(text)])
    n = len(units) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for i in range(ORDER):
        out = (out << _U(16)) | units[i : n + i]
    return out


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    unit = (gram >> _U(16)) & _U(0xFFFF)
    return ((unit * _U(2654435761) >> _U(7)) % _U(shards)).astype(np.int64)


def _trusted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        each = [np.unique(grams(t), return_counts=True) for t in batch.column("text").to_pylist()]
        found, place = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in each]), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(shard_of(found, SHARDS).astype(np.int32)), pa.array(total)], ["gram", "shard", "n"])


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney."""
    n1, n2, n3, n4 = (counts_of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def _level(keys: np.ndarray, n: np.ndarray, d: tuple, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each sorted gram, the histories and their backoff weights. ``lower``: the shorter gram's probability."""
    history, at = np.unique(keys >> _U(16), return_inverse=True)
    total = np.bincount(at, n)
    taken = np.array([0.0, *d])[np.minimum(n, 3)]
    back = np.bincount(at, taken) / total
    return (n - taken) / total[at] + back[at] * lower, history, back


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Unigram:
    """Interpolated with the uniform distribution over all units; ``seen``: continuation counts of units."""

    def __init__(self, seen: dict[int, int], d: tuple):
        units = sorted(seen)
        self.units = np.array(units, np.uint64)
        n = np.array([seen[u] for u in units], np.int64)
        taken = np.array([0.0, *d])[np.minimum(n, 3)] if len(n) else np.zeros(0)
        self.back = taken.sum() / n.sum() if len(n) else 1.0
        self.p = (n - taken) / n.sum() + self.back / UNITS if len(n) else np.zeros(0)

    def __call__(self, units: np.ndarray) -> np.ndarray:
        at, hit = _find(self.units, units)
        return np.where(hit, self.p[at] if len(self.p) else 0.0, self.back / UNITS)


def shard_model(gram: np.ndarray, n: np.ndarray, ds: list[tuple], unigram: Unigram) -> bytes:
    """Log-probabilities and log backoff weights of all orders of a shard's grams; ``gram`` sorted, ``n`` their counts."""
    third, n3 = np.unique(gram & _U((1 << 48) - 1), return_counts=True)
    second, n2 = np.unique(third & _U((1 << 32) - 1), return_counts=True)
    p2, h1, b1 = _level(second, n2, ds[1], unigram(second & _U(0xFFFF)))
    p3, h2, b2 = _level(third, n3, ds[2], p2[_find(second, third & _U((1 << 32) - 1))[0]])
    p4, h3, b3 = _level(gram, n, ds[3], p3[_find(third, gram & _U((1 << 48) - 1))[0]])
    return pack(gram, np.log(p4), h3, np.log(b3), third, np.log(p3), h2, np.log(b2), second, np.log(p2), h1, np.log(b1))


def log_probability(model: list[np.ndarray], gram: np.ndarray, unigram: Unigram) -> np.ndarray:
    out, left = np.zeros(len(gram)), np.arange(len(gram))
    for level, bits in enumerate((64, 48, 32)):
        keys, logp, history, back = model[4 * level : 4 * level + 4]
        own = gram[left] & _U((1 << bits) - 1)
        at, hit = _find(keys, own)
        if hit.any():
            out[left[hit]] += logp[at[hit]]
        left, own = left[~hit], own[~hit]
        at, hit = _find(history, own >> _U(16))
        if hit.any():
            out[left[hit]] += back[at[hit]]
    out[left] += np.log(unigram(gram[left] & _U(0xFFFF)))
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint8).reshape(len(values), -1).T


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partition = TaskContext.get().partitionId()
    for k, batch in enumerate(slices(batches)):
        chunk, n = chunk_id(partition, k), batch.num_rows
        texts = batch.column("text").to_pylist()
        each = [np.unique(grams(t), return_counts=True) for t in texts]
        gram = np.concatenate([g for g, _ in each])
        docs = np.repeat(np.arange(n, dtype=np.uint16), [len(g) for g, _ in each])
        counts = np.concatenate([c for _, c in each]).astype(np.uint32)
        shard = shard_of(gram, SHARDS)
        order = np.lexsort((gram, shard))
        gram, docs, counts, shard = gram[order], docs[order], counts[order], shard[order]
        bounds = np.searchsorted(shard, np.arange(SHARDS + 1))
        about = {c: batch.column(c).to_pylist() for c in ("doc_id", "lang", "_key", "_trusted")}
        sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
        rows = [(-1, pack(json.dumps(about).encode(), sizes))]
        for s in range(SHARDS):
            a, b = bounds[s], bounds[s + 1]
            if a == b:
                continue
            found, many = np.unique(gram[a:b], return_counts=True)
            steps = np.diff(docs[a:b], prepend=np.uint16(0))
            rows.append((s, pack(np.array([n], np.uint32), _planes(found), many.astype(np.uint32), _planes(steps), _planes(counts[a:b]))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk % SALTS] * len(rows), pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            ["shard", "salt", "chunk", "blob"],
        )


def _plain(planes: memoryview, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _answers(unigram: Unigram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = None, None
        for batch in batches:
            shards, blobs, models = (batch.column(c).to_pylist() for c in ("shard", "blob", "model"))
            out = []
            for shard, blob, packed in zip(shards, blobs, models, strict=True):
                if shard < 0:
                    out.append(blob)
                    continue
                if shard != known:
                    parts = unpack(packed) if packed else [b""] * 12
                    known, model = shard, [np.frombuffer(p, np.uint64 if i % 2 == 0 else np.float64) for i, p in enumerate(parts)]
                n, found, many, steps, counts = unpack(blob)
                logp = log_probability(model, _plain(found, np.uint64), unigram)
                docs = np.cumsum(_plain(steps, np.uint16), dtype=np.uint16)
                sums = np.bincount(docs, np.repeat(logp, np.frombuffer(many, np.uint32)) * _plain(counts, np.uint32), int(np.frombuffer(n, np.uint32)[0]))
                out.append(pack(sums))
            base = pa.array([s < 0 for s in shards])
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), base, pa.array(out, pa.binary())], ["chunk", "base", "blob"])

    return run


_SCORED = "doc_id long, lang string, _key long, _trusted boolean, n_units long, _nll double"


def _gather(chunk: pa.Table) -> pa.Table:
    total, about, sizes = 0.0, None, None
    answers = sorted((b for base, b in zip(chunk.column("base").to_pylist(), chunk.column("blob").to_pylist(), strict=True) if not base))
    for blob in answers:  # in one order, so that sums do not depend on arrival
        total = total + np.frombuffer(unpack(blob)[0], np.float64)
    for base, blob in zip(chunk.column("base").to_pylist(), chunk.column("blob").to_pylist(), strict=True):
        if base:
            about, sizes = unpack(blob)
            about, sizes = json.loads(bytes(about)), np.frombuffer(sizes, np.int64)
    nll = -(np.zeros(len(sizes)) + total) / np.maximum(sizes, 1)
    return pa.table({
        "doc_id": pa.array(about["doc_id"], pa.int64()), "lang": pa.array(about["lang"], pa.string()), "_key": pa.array(about["_key"], pa.int64()), "_trusted": pa.array(about["_trusted"], pa.bool_()),
        "n_units": sizes, "_nll": pa.array(np.round(nll, 9), mask=sizes == 0),
    })


def row_key() -> Column:
    """Names a row by content, so that equal rows share decisions and null or repeated ids do no harm."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def held_out() -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(HELD_OUT)) == 0


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_units, mean negative log-probability of every row; ``trusted``: doc_id of trusted documents."""
    spark = docs.sparkSession
    ids = checked_broadcast(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("_in", F.lit(True)), 16)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"), row_key().alias("_key"))
    rows = rows.join(ids, "doc_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False))).withColumn("_trusted", F.col("_in") & held_out())
    counts = kept_in_light_batches(rows.filter(F.col("_in") & ~held_out()).select("text").mapInArrow(_trusted_counts, "gram long, shard int, n long").groupBy("gram", "shard").agg(F.sum("n").alias("n")))
    third = counts.groupBy(F.col("gram").bitwiseAND((1 << 48) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    second = third.groupBy(F.col("gram").bitwiseAND((1 << 32) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    first = second.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    tallies = [{r["k"]: r["c"] for r in level.filter("n < 5").groupBy(F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()} for level in (first, second, third, counts)]
    ds = [discounts(t) for t in tallies]
    unigram = Unigram({r["gram"]: r["n"] for r in first.collect()}, ds[0])  # at most 65,536 units

    def build(key: tuple, shard: pa.Table) -> pa.Table:
        gram = shard.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(gram)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([shard_model(gram[order], shard.column("n").to_numpy()[order], ds, unigram)], pa.binary())})

    model = counts.groupBy("shard").applyInArrow(build, "shard int, model binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rows.drop("_in").mapInArrow(_requests, "shard int, salt int, chunk long, blob binary")
    answered = asked.join(model, ["shard", "salt"], "left").select("shard", "chunk", "blob", "model").mapInArrow(_answers(unigram), "chunk long, base boolean, blob binary")
    return answered.groupBy("chunk").applyInArrow(_gather, _SCORED)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """lang, threshold: the smallest step that at least ``quantile`` of the language's trusted documents do not pass."""
    trusted = scored.filter("_trusted AND _nll IS NOT NULL").withColumn("_step", F.floor(F.col("_nll") * STEPS).cast("long"))
    steps = trusted.groupBy("lang", "_step").agg(F.count(F.lit(1)).alias("n"))  # bounded by languages x steps
    every = steps.groupBy("_step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")).withColumn("_all", F.lit(True))
    steps = steps.withColumn("_all", F.lit(False)).unionByName(every)
    w = Window.partitionBy("_all", "lang")
    ranked = steps.withColumn("_sum", F.sum("n").over(w.orderBy("_step"))).withColumn("_total", F.sum("n").over(w))
    return ranked.filter(F.col("_sum") >= quantile * F.col("_total")).groupBy("_all", "lang").agg((F.min("_step") + 1).alias("_limit"), F.max("_total").alias("_docs")).filter(F.col("_all") | (F.col("_docs") >= least))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold, keep, _key of every row.

    Scores are kept as light rows: the thresholds need all of them before the first decision.
    """
    scored = kept_in_light_batches(scores(docs, trusted))
    limits = thresholds(scored, quantile, least)
    own = limits.filter(~F.col("_all")).select(F.col("lang").alias("_lang"), F.col("_limit").alias("_own"))
    overall = (limits.filter("_all").select("_limit").first() or [None])[0]
    out = scored.join(checked_broadcast(own, 64), scored["lang"].eqNullSafe(own["_lang"]), "left")
    limit = F.coalesce(F.col("_own"), F.lit(overall).cast("long")) / F.lit(float(STEPS))
    keep = F.col("_nll").isNotNull() & F.coalesce(F.col("_nll") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "n_units", F.round(F.exp("_nll"), 6).alias("perplexity"), F.round(F.exp(limit), 6).alias("threshold"), keep.alias("keep"), "_key")


def keep_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that quality() keeps, with all their columns."""
    gone = kept(quality(docs, trusted).filter(~F.col("keep")).select("_key").distinct())
    return docs.withColumn("_key", row_key()).join(checked_broadcast(gone, 16), "_key", "left_anti").drop("_key")
