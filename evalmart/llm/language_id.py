"""Language identification by Bayesian evidence fusion.

Text: naive Bayes over hashed character trigrams, trained on all documents by their declared language; the table has a
fixed size (languages x buckets) and is the only thing sent to all tasks. Its evidence is tempered: a text weighs as
``EVIDENCE`` grams at most, because neighbouring grams are not independent. Declared language and address suffix are
likelihoods counted over the corpus; the host prior shrinks from the host over its domain to the corpus. All counts are
grouped aggregations of the languages that text alone suggests, and a row's own vote is taken out of its host's counts.

Defined results: null and empty text has no text evidence and rests on the others; a null address has the host, domain and
suffix ''; an unknown declared language counts as 'other', a missing one as ''; ties go to the first language; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import checked_broadcast, kept, kept_in_light_batches, slices, text_of
from evalmart.llm.quality import row_key

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 15
EVIDENCE = 300
STRENGTH = 5.0  # a parent level weighs as many votes
SURE = 0.9
FOREIGN = 0.001
_U = np.uint64
HIDDEN = re.compile(r"(?is)<(script|style|nav|header|footer|aside|form|select|button|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")
DECLARED = r'(?is)<html\b[^>]*?\slang\s*=\s*["\']?\s*([a-z]{2,3})\b'


def _buckets(text: str) -> np.ndarray:
    units = np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    if len(units) < 3:
        return np.zeros(0, np.int64)
    gram = (units[:-2] << _U(32)) | (units[1:-1] << _U(16)) | units[2:]
    return ((gram * _U(0x9E3779B97F4A7C15)) >> _U(49)).astype(np.int64)


def page_text(html: str) -> str:
    return HIDDEN.sub(" ", html)


def _trained(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        place = {lang: i for i, lang in enumerate(languages)}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text.strip():
                    counts[place[lang]] += np.bincount(_buckets(text), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.reshape(-1)[at])], ["slot", "n"])

    return run


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities of shape (languages, buckets) from all documents whose declared language is listed."""
    rows = docs.select(text_of().alias("text"), F.lower(F.col("lang").cast("string")).alias("lang")).filter(F.col("lang").isin(*languages))
    slots = rows.mapInArrow(_trained(languages), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets
    counts = np.zeros(len(languages) * BUCKETS)
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _scored(table: np.ndarray, prepare: Callable[[str], str] | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = prepare(text) if prepare else text
                found = np.bincount(_buckets(text), minlength=BUCKETS) if text.strip() else np.zeros(BUCKETS)
                n = found.sum()
                out.append(np.round(table @ found * (min(n, EVIDENCE) / max(n, 1)), 6))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.float64()))], [*keep, "likelihood"])

    return run


def _argmax(values: Column, languages: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(values, F.array_max(values)).cast("int"))


def _votes(rows: DataFrame, key: str, languages: tuple[str, ...]) -> DataFrame:
    """key, array of votes per language."""
    return rows.groupBy(key).agg(F.array(*(F.sum((F.col("text_lang") == lang).cast("double")) for lang in languages)).alias(f"_{key}"))


def fuse(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds text_lang, lang, confidence and the posterior of each language to rows with likelihood, host, domain, suffix, declared."""
    rows = scored.withColumn("declared", F.when(F.col("declared").isin("", *languages), F.col("declared")).otherwise("other"))
    told = F.array_max("likelihood") > F.array_min("likelihood")
    rows = rows.withColumn("text_lang", F.when(told, _argmax(F.col("likelihood"), languages)))
    whole = rows.agg(*(F.sum((F.col("text_lang") == lang).cast("double")).alias(lang) for lang in languages)).first()
    corpus = np.array([whole[lang] or 0.0 for lang in languages]) + 1.0
    corpus = [float(x) for x in corpus / corpus.sum()]
    place = {lang: i for i, lang in enumerate(languages)}
    declared = {k: [1.0] * len(languages) for k in ("", "other", *languages)}
    for r in rows.filter("text_lang IS NOT NULL").groupBy("declared", "text_lang").agg(F.count(F.lit(1)).alias("n")).collect():  # a fixed number of groups
        declared[r["declared"]][place[r["text_lang"]]] += r["n"]
    totals = [sum(v[i] for v in declared.values()) for i in range(len(languages))]
    declared_log = F.create_map(*(x for k, v in declared.items() for x in (F.lit(k), F.array(*(F.lit(float(np.log(v[i] / totals[i]))) for i in range(len(languages)))))))
    for key in ("host", "domain", "suffix"):
        rows = rows.join(checked_broadcast(_votes(rows, key, languages), 128), key)
    own = [F.coalesce((F.col("text_lang") == lang).cast("double"), F.lit(0.0)) for lang in languages]

    def shrunk(counts: str, parent: list[Column]) -> list[Column]:
        votes = [F.coalesce(F.col(counts)[i], F.lit(0.0)) - own[i] for i in range(len(languages))]
        total = sum(votes[1:], votes[0])
        return [(v + STRENGTH * p) / (total + STRENGTH) for v, p in zip(votes, parent, strict=True)]

    domain = shrunk("_domain", [F.lit(x) for x in corpus])
    rows = rows.withColumn("_prior_domain", F.array(*domain))
    host = shrunk("_host", [F.col("_prior_domain")[i] for i in range(len(languages))])
    # Suffix as a likelihood: how much more often this suffix goes with the language than all languages do.
    suffix = shrunk("_suffix", [F.lit(x) for x in corpus])
    logs = F.array(*(
        F.col("likelihood")[i] + declared_log[F.col("declared")][i] + F.log(host[i]) + F.log(suffix[i] / corpus[i]) for i in range(len(languages))))
    rows = rows.withColumn("_logs", logs)
    weights = F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs")))
    rows = rows.withColumn("_w", weights)
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_sum", total).withColumn("posterior", F.transform("_w", lambda x: F.round(x / F.col("_sum"), 6)))
    return rows.withColumn("lang", _argmax(F.col("_logs"), languages)).withColumn("confidence", F.array_max("posterior")).drop("_logs", "_w", "_sum", "_prior_domain", "_host", "_domain", "_suffix")


def identify_pages(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """page_id, url, declared, text_lang, lang, confidence of every page."""
    table = train(docs, languages)
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("text"), host.alias("host"),
        F.lower(F.regexp_extract(text_of("html"), DECLARED, 1)).alias("declared"),
    )
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    keep = ["page_id", "url", "host", "declared", "domain", "suffix"]
    scored = rows.mapInArrow(_scored(table, page_text, keep), "page_id long, url string, host string, declared string, domain string, suffix string, likelihood array<double>")
    return fuse(kept(scored), languages).select("page_id", "url", "declared", "text_lang", "lang", "confidence")


def identify_documents(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, declared, text_lang, lang, confidence, keep, _key of every document; the source stands in for the host.

    A document goes if no language reaches ``SURE``, or if the fused evidence all but excludes the one it declares.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), row_key().alias("_key"), F.coalesce(F.lower(F.col("lang").cast("string")), F.lit("")).alias("declared"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
    ).withColumn("domain", F.lit("")).withColumn("suffix", F.lit(""))
    keep = ["doc_id", "_key", "declared", "host", "domain", "suffix"]
    scored = rows.mapInArrow(_scored(train(docs, languages), None, keep), "doc_id long, _key long, declared string, host string, domain string, suffix string, likelihood array<double>")
    fused = fuse(kept_in_light_batches(scored), languages)
    claimed = F.coalesce(F.array_position(F.array(*map(F.lit, languages)), F.col("declared")).cast("int"), F.lit(0))
    excluded = (claimed > 0) & (F.try_element_at("posterior", claimed) < FOREIGN)
    return fused.withColumn("keep", (F.col("confidence") >= SURE) & ~F.coalesce(excluded, F.lit(False))).select("doc_id", "declared", "text_lang", "lang", "confidence", "keep", "_key")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that identify_documents() keeps, with all their columns."""
    gone = kept(identify_documents(docs).filter(~F.col("keep")).select("_key").distinct())
    return docs.withColumn("_key", row_key()).join(checked_broadcast(gone, 16), "_key", "left_anti").drop("_key")
