"""Spelling variants by a pair dictionary over trie nodes.

The vocabulary is sorted forwards and backwards, and the nodes of both tries are numbered: in sorted order a word opens the
nodes beyond the prefix that it shares with the word before it. Range partitions number their own nodes; what the first words
of a partition share with the partition before is taken over from there. A word then has, at every position, the integer
pair (node of what is before, node of what is behind). Skipping the position gives the pair that all words share which differ
only there; the same pair without a skip is the word that lacks the position. So a join on pairs of integers finds exactly
the words at one replaced, deleted or inserted code point, and no word is compared with another. A pair has one member per
letter of the alphabet and one shorter word at most; neighbours are counted and ranked in windows over the pairs.

In a run of equal letters only the skip of the first one meets the shorter word, so that each neighbour counts once.

Defined results: null texts have no words; a null doc_id is an empty string in the hash; repeated rows count each; ties in
frequency go to the smaller word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmart.llm.common import kept, text_of
from evalmart.session import pin

RUN = "[A-Za-zÀ-ÿ]+"
EDITED = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
FACTOR = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT, _FIRST_SKIP, _SKIP = 0, 1, 2


def vocabulary(docs: DataFrame, edited: int = EDITED, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n over all documents; one run in ``edited``, by its hash, loses a letter first."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.translate(text_of(), _UPPER, _LOWER).alias("_text"))
    runs = texts.select("_id", F.explode(F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    found = runs.withColumn("_h", h).select(F.when(F.col("_h") % edited == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return found.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _base(part: int) -> int:
    return part << 40  # numbers of a partition's own nodes follow


def _paths(words: Iterator[str], base: int, taken: list[int]) -> Iterator[tuple[str, list[int]]]:
    """Each word with the numbers of the nodes on its way; the first one starts on the nodes ``taken`` over."""
    before, path, last = "", [], base
    for word in words:
        shared = len(commonprefix([before, word]))
        opened = len(word) - shared
        path = path[:shared] + list(range(last + 1, last + opened + 1))
        if last == base:
            path[: len(taken)] = taken
        before, last = word, last + opened
        yield word, path


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column("_spelled").to_pylist()


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First word, last word and the last one's path of a partition."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for word, path in _paths(_spelled(batches), _base(part), []):
        first, last = word if first is None else first, (word, path)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last[0]]), pa.array([last[1]], pa.list_(pa.int64()))], ["part", "first", "last", "path"])


def _taken(borders: list) -> dict[int, list[int]]:
    """Nodes that each partition's first word shares with the last word before it."""
    before, path, out = "", [], {}
    for r in sorted(borders, key=lambda r: r["part"]):
        own = out[r["part"]] = path[: len(commonprefix([before, r["first"]]))]
        base = _base(r["part"])
        path = [own[x - base - 1] if x - base <= len(own) else x for x in r["path"]]
        before = r["last"]
    return out


def _numbered(taken: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list = []

        def spelled() -> Iterator[str]:
            for batch in batches:
                names.append(batch.column("_wid"))
                yield from batch.column("_spelled").to_pylist()

        held = []
        for _, path in _paths(spelled(), _base(part), taken.get(part, [])):
            held.append([0, *path])
            if names and len(held) == len(names[0]):
                yield pa.RecordBatch.from_arrays([names.pop(0), pa.array(held, pa.list_(pa.int64()))], ["_wid", "nodes"])
                held = []

    return run


def trie_nodes(words: DataFrame, backwards: bool = False) -> DataFrame:
    """_wid and ``nodes``: the numbers of the trie nodes of all prefixes (suffixes, shortest first) of the word, root first.

    Two words have one number in common exactly where they share that prefix. One border row per partition reaches the driver.
    """
    spelled = F.reverse("word") if backwards else F.col("word")
    ordered = pin(words.select("_wid", spelled.alias("_spelled")).repartitionByRange("_spelled").sortWithinPartitions("_spelled"))
    borders = ordered.select("_spelled").mapInArrow(_border, "part int, first string, last string, path array<bigint>").collect()
    return ordered.mapInArrow(_numbered(_taken(borders)), "_wid long, nodes array<bigint>")


def pair_dictionary(words: DataFrame) -> DataFrame:
    """_before, _behind, _kind, _wid: the pairs of every word, cut between letters and with one letter skipped."""
    front, back = trie_nodes(words), trie_nodes(words, backwards=True).withColumnRenamed("nodes", "ends")
    size = F.size("nodes") - 1
    both = words.select("_wid", "word").join(front, "_wid").join(back, "_wid").select("_wid", "word", "nodes", "ends", F.explode(F.sequence(F.lit(0), size)).alias("_i"))
    i, rest = F.col("_i"), F.size("nodes") - 1 - F.col("_i")
    repeated = (i > 0) & (F.substring("word", i, F.lit(1)) == F.substring("word", i + 1, F.lit(1)))
    before = F.get("nodes", i)
    cut = F.struct(before.alias("_before"), F.get("ends", rest).alias("_behind"), F.lit(_CUT).alias("_kind"))
    skip = F.struct(before.alias("_before"), F.get("ends", rest - 1).alias("_behind"), F.when(repeated, F.lit(_SKIP)).otherwise(F.lit(_FIRST_SKIP)).alias("_kind"))
    return both.select("_wid", F.explode(F.when(rest > 0, F.array(cut, skip)).otherwise(F.array(cut))).alias("_p")).select("_p.*", "_wid")


def neighbours(words: DataFrame) -> DataFrame:
    """_wid, n_near and ``_best`` (smallest _wid among the near words) of every word that has near words."""
    pair = Window.partitionBy("_before", "_behind")
    skipped, first = F.col("_kind") != _CUT, F.col("_kind") == _FIRST_SKIP
    met = pair_dictionary(words).withColumn("_members", F.count(F.lit(1)).over(pair)).filter("_members > 1")
    met = met.select(
        "_before", "_behind", "_kind", "_wid", "_members", F.count(F.when(first, 1)).over(pair).alias("_firsts"), F.max(F.when(~skipped, F.col("_wid"))).over(pair).alias("_shorter"),
        F.min(F.when(skipped, F.col("_wid"))).over(pair).alias("_top"), F.min(F.when(first, F.col("_wid"))).over(pair).alias("_top_first"))
    met = met.withColumn("_second", F.min(F.when(skipped & (F.col("_wid") > F.col("_top")), F.col("_wid"))).over(pair))
    skips = F.col("_members") - F.when(F.col("_shorter").isNotNull(), 1).otherwise(0)
    shorter = F.when(first, F.col("_shorter"))
    other = F.when(F.col("_wid") == F.col("_top"), F.col("_second")).otherwise(F.col("_top"))
    near = F.when(skipped, skips - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("_firsts"))
    best = F.when(skipped, F.least(other, shorter)).otherwise(F.col("_top_first"))
    told = met.select("_wid", near.alias("near"), best.alias("best")).filter("near > 0")
    return told.groupBy("_wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("_best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """_wid and ``_root`` of (_wid, _form): forms followed to the last by pointer doubling; chains have ``longest`` steps at most."""
    at = forms.select("_wid", F.col("_form").alias("_root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        at = kept(at)
        beyond = at.select(F.col("_wid").alias("_root"), F.col("_root").alias("_beyond"))
        at = at.join(beyond, "_root", "left").select("_wid", F.coalesce("_beyond", "_root").alias("_root"))
    return at


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n); ``_wid`` numbers words by falling n, then code points."""
    order = [F.col("n").desc(), F.col("word")]
    ranked = kept(words.select("word", "n").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_wid", F.monotonically_increasing_id()))
    near = ranked.join(neighbours(ranked), "_wid", "left")
    named = ranked.select(F.col("_wid").alias("_best"), F.col("word").alias("_form_word"), F.col("n").alias("_n"))
    enough = F.col("_n") >= F.col("n") * factor
    joined = kept(near.join(named, "_best", "left").select(
        "_wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("_best")).alias("_form"), F.when(enough, F.col("_form_word")).alias("form"), F.when(enough, F.col("_n")).alias("form_n")))
    most = ranked.agg(F.max("n")).first()[0] or 1
    ends = roots(joined.filter(F.col("_form").isNotNull()), max(1, int(math.log(most, factor)) + 1))
    spelled = ranked.select(F.col("_wid").alias("_root"), F.col("word").alias("root"))
    followed = joined.join(ends.join(spelled, "_root").select("_wid", "root"), "_wid", "left")
    return followed.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents."""
    return variants(vocabulary(docs))
