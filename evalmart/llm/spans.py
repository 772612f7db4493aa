"""Pre-tokens of a byte-level tokenizer.

The vocabulary's pre-tokenizer never lets a piece cross a single space that stands between two other non-blank
characters, so a text falls apart there into spans (the space stays with what follows) that can be counted or encoded
once each. White space of any kind beside a space keeps the span whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k"
# White space of any Unicode version, as a superset: a wrong member only makes a span longer.
BLANKS = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
BESIDE_SPACE = f"[{BLANKS}] | [{BLANKS}]"
JOINABLE = re.compile(" [!-~\u00a1-\u024f]+\\Z")  # characters that every Unicode version knows alike, none of them white space
SPECIAL = "<|endoftext|>"
CUT = re.compile(f"(?<=[^{BLANKS}])(?= [^{BLANKS}])")
MEMO_SPANS = 500_000
BATCH_SPANS = 2048


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for: one character of its spelling is one byte."""
    known = tokenizer(path).get_vocab()
    sizes = np.zeros(max(known.values()) + 1, np.int64)
    for spelling, k in known.items():
        sizes[k] = len(spelling)
    return sizes


def spans(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct spans, the span of every place, and the places' offsets per text. Spans joined in order give the text."""
    texts = pc.fill_null(texts, "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, BESIDE_SPACE).to_numpy(zero_copy_only=False))
    parts = pc.split_pattern(texts, " ")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    distinct = [" " + w for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy().astype(np.int64)
    # Heads have no space before them; a piece cut by hand may equal one of the dictionary.
    index = {w: i for i, w in enumerate(distinct)} if len(odd) else {}

    def extra(span: str) -> int:
        if span not in index:
            index[span] = len(distinct)
            distinct.append(span)
        return index[span]

    first = offsets[:-1]
    heads = flat.take(pa.array(first)).to_pylist()
    codes[first] = [extra(w) for w in heads]
    if len(odd):
        pieces = np.split(codes, offsets[1:-1])
        for i in odd:
            pieces[i] = np.array([extra(w) for w in CUT.split(texts[int(i)].as_py())], np.int64)
        codes = np.concatenate(pieces)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    return distinct, codes, offsets


def batches(spans_: list[str]) -> Iterator[list[str]]:
    return (spans_[low : low + BATCH_SPANS] for low in range(0, len(spans_), BATCH_SPANS))


class Ids:
    """Token ids of spans. Known spans are looked up; the store starts anew when it is full, which only costs time."""

    def __init__(self, path: str, ranks_path: str):
        self.path, self.ranks_path, self.bytes_of = path, ranks_path, token_bytes(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def lookup(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each span in ``flat``."""
        if len(self.at) > MEMO_SPANS:
            self.clear()
        at = self.at
        self.encode(list(dict.fromkeys(s for s in distinct if s not in at)))
        where = np.fromiter(map(at.__getitem__, distinct), np.int64, len(distinct))
        return self.starts[where], self.sizes[where]

    def encode(self, fresh: list[str]) -> None:
        """Spans that may stand behind one another go through the ranks of the same vocabulary in one text, which is five
        times as fast; the bytes of the ids tell where each ends. All others go through the tokenizer."""
        joinable = [s for s in fresh if JOINABLE.match(s) and SPECIAL not in s]
        for own in batches(joinable):
            ids = np.array(ranked(self.ranks_path).encode_ordinary("".join(own)), np.uint32)
            reached, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(s.encode()) for s in own])
            stops = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[stops - 1], ends):
                raise ValueError("a token crosses two spans")
            self.add(own, ids, np.diff(stops, prepend=0))
        self.encode_each([s for s in fresh if s not in self.at])

    def encode_each(self, fresh: list[str]) -> None:
        for own in batches(fresh):
            found = [e.ids for e in tokenizer(self.path).encode_batch_fast(own, add_special_tokens=False)]
            sizes = np.array([len(ids) for ids in found], np.int64)
            self.add(own, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def add(self, own: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.at)
        self.at.update(zip(own, range(first, first + len(own)), strict=True))
        while len(self.at) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first : len(self.at)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : len(self.at)] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


@lru_cache(maxsize=1)
def shared_ids(path: str, ranks_path: str) -> Ids:
    return Ids(path, ranks_path)
