"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their paths; each one is paired with the neighbour whose path agrees longest. The
lines of both are aligned by longest common subsequence and shared lines are deleted: menus, notices and adverts repeat on
neighbouring pages, articles do not. Two guards keep articles whole: lines that the page itself marks as its article are
never deleted, and a pair that shares most of its text is a pair of near copies. Where a guard would keep a shared line,
a name in the markup around it breaks the tie: inside ``class="sidebar-promo"`` it goes all the same. Exact copies (the
same lines) count as one page of their host, so they are compared with the next page that has other lines.

What the markup states to be something else never becomes a line: elements (navigation, footer, form, script ...), hidden
parts, and whole names that say nothing more (``comments``, ``site-header``, ``ad-slot``). Names that hold such a word among
others (``has-sidebar``, ``social-science``, ``entry-header``) drop nothing by themselves. The header of an article and the
captions of its figures belong to it.

Only line hashes are ordered, paired and aligned; pages are not shuffled by host, so a hot host is no hot group. Markup is
read in one pass, however broken; the alignment halves the page until its bit rows fit ``ALIGN_BITS``.

Defined results: null or empty html gives an empty text; a null url has the host ''; a page alone on its host loses no
line; equal rows are copies of each other; a page whose host has only copies of it loses no line; the neighbour before wins
ties; a quote that leads to no end of its tag is an ordinary sign; a ``<`` without any ``>`` behind it is text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import checked_broadcast, kept, slices, text_of

COPY_SHARE = 0.6
ALIGN_BITS = 1 << 26
PLAIN, ARTICLE, SUSPECT = 0, 1, 2
# Element names of HTML by their part in a page, words that name such parts in class, id and role, and words
# that only say which one or where.
RAW = frozenset("script style noscript template textarea svg iframe object select title".split())
OTHER = frozenset("nav header footer aside form menu dialog button fieldset head".split())
MAIN = frozenset(("article", "main"))
BREAKING = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget alert contentinfo complementary search".split())
PLACE_WORDS = frozenset("area bar bottom box block buttons container group global icons inner left link links list item items main menu outer panel primary right secondary section site slot sticky sub top wrap wrapper".split())
NAME = re.compile(r"[A-Za-z][A-Za-z0-9-]*")
ENDING = re.compile(r"[>\"']")
CLOSING = {name: re.compile(rf"</{name}(?=[\s>/])", re.I) for name in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANK = re.compile(r"\s+")


def _named(attributes: str) -> int:
    """2 for a name that says the part is something else and nothing more, 1 for one that holds such a word among others."""
    most = 0
    for value in NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [w.lower() for w in WORD.findall(name)]
            if any(w in OTHER_WORDS for w in parts):
                most = max(most, 1 + all(w in OTHER_WORDS or w in PLACE_WORDS for w in parts))
    return most


def _part(name: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is something else than text of the page, and the mark that it gives to its lines."""
    if name in MAIN:
        return False, ARTICLE
    if name in ("html", "body"):
        return False, PLAIN
    if name in OTHER:
        return not (in_article and name == "header"), PLAIN
    if not attributes:
        return False, PLAIN
    named = _named(attributes)
    return bool(HIDDEN.search(attributes)) or named == 2, SUSPECT if named == 1 else PLAIN


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Place of the ``>`` that ends a tag. ``dead`` has quotes known to lead to no end, so that all calls take linear time."""
    passed, i = [], at
    while found := ENDING.search(html, i):
        i = found.start()
        if html[i] == ">":
            return i
        if i in dead:
            break
        passed.append(i)
        i = html.find(html[i], i + 1) + 1
        if i == 0:
            break
    dead.update(passed)
    return html.find(">", at)


def lines(html: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with its mark; parts that are something else are left out."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # name, mark
    others: list[int] = []  # places in the stack of parts that are something else
    names: Counter[str] = Counter()
    marks: list[int] = []
    articles = 0
    dead: set[int] = set()
    last = html.rfind(">")

    def flush() -> None:
        if buffer:
            text = BLANK.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, marks[-1] if marks else PLAIN))

    def close() -> str:
        nonlocal articles
        name, mark = stack.pop()
        is_other = bool(others) and others[-1] == len(stack)
        if is_other or mark:
            flush()
        names[name] -= 1
        if is_other:
            others.pop()
        if mark:
            marks.pop()
            articles -= mark == ARTICLE
        return name

    at = here = 0
    while 0 <= (here := html.find("<", here)) < last:
        head = html[here + 1]
        closing = head == "/"
        found = NAME.match(html, here + 1 + closing)
        if not found and head not in "!?/":
            here += 1
            continue
        if not others:
            buffer.append(html[at:here])
        if not found:
            comment = html.startswith("<!--", here)
            end = html.find("-->" if comment else ">", here + (2 if comment else 1))
            at = here = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        name, end = found.group().lower(), _tag_end(html, found.end(), dead)
        attributes = html[found.end() : end]
        at = here = end + 1
        if name in RAW and not closing:
            buffer.append(" ")
            if not (name == "svg" and attributes.endswith("/")):
                closed = CLOSING[name].search(html, here)
                end = html.find(">", closed.end()) if closed else -1
                at = here = len(html) if end < 0 else end + 1
            continue
        if name == "br":
            buffer.append(" ")
        if name in BREAKING:
            flush()
        if closing:
            if names[name]:
                while close() != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if (name in MAIN or name == "body") and not articles:
                others.clear()  # an article opens anew even if something before it was never closed
            is_other, mark = _part(name, attributes, articles > 0)
            if is_other or mark:
                flush()
            if name == "p" and stack and stack[-1][0] == "p":
                close()
            if is_other:
                others.append(len(stack))
            stack.append((name, mark))
            names[name] += 1
            if mark:
                marks.append(mark)
                articles += mark == ARTICLE
    if not others and at < len(html):
        buffer.append(html[at:])
    flush()
    return out


def _bit_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of ``a`` a row of bits: the zeros in its first j places are the common length with b[:j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    yield row
    for x in a:
        u = row & places.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common length of all ``a`` with each prefix of ``b``."""
    row = 0
    for row in _bit_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _traced(a: list[int], b: list[int]) -> list[int]:
    rows = list(_bit_rows(a, b))
    out, i, j = [], len(a), len(b)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            out.append(i)
    return out[::-1]


def shared_lines(a: list[int], b: list[int], limit: int = ALIGN_BITS) -> list[int]:
    """Places of ``a`` in a longest common subsequence with ``b``; ``limit`` bounds the bits held at once, not the result."""
    both = set(a) & set(b)
    own = [i for i, x in enumerate(a) if x in both]
    x, y = [a[i] for i in own], [v for v in b if v in both]
    start, stop = 0, len(x)
    while start < min(stop, len(y)) and x[start] == y[start]:
        start += 1
    tail = len(y)
    while stop > start and tail > start and x[stop - 1] == y[tail - 1]:
        stop, tail = stop - 1, tail - 1
    middle, rest = x[start:stop], y[start:tail]
    if len(middle) * len(rest) <= limit or len(middle) < 2:
        inner = _traced(middle, rest)
    else:
        half = len(middle) // 2
        cut = int(np.argmax(_common_lengths(middle[:half], rest) + _common_lengths(middle[half:][::-1], rest[::-1])[::-1]))
        inner = shared_lines(middle[:half], rest[:cut], limit) + [half + i for i in shared_lines(middle[half:], rest[cut:], limit)]
    return [own[i] for i in (*range(start), *(start + i for i in inner), *range(stop, len(x)))]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [lines(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_key", "host", "path", "url")), pa.array([[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in f] for f in found], pa.list_(pa.int64())),
             pa.array([[len(t) for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[m for _, m in f] for f in found], pa.list_(pa.int32()))],
            ["_key", "host", "path", "url", "hashes", "sizes", "marks"])


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the lines that a page shares with its neighbour, and whether they are most of its text."""
    for batch in batches:
        at, shared, alike = [], [], []
        for i, (mine, sizes, theirs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hashes", "sizes", "theirs")), strict=True)):
            if places := shared_lines(mine, theirs):
                at.append(i)
                shared.append(places)
                alike.append(sum(sizes[k] for k in places) > COPY_SHARE * sum(sizes))
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host").take(take), batch.column("_sign").take(take), pa.array(shared, pa.list_(pa.int32())), pa.array(alike, pa.bool_())], ["host", "_sign", "shared", "alike"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for h, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            gone = set(gone or ())
            texts.append("\n".join(t for i, (t, _) in enumerate(lines(h)) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two paths in parts."""
    parts = F.arrays_zip(F.split(a, "/").alias("x"), F.split(b, "/").alias("y"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(
        (s["n"] + F.when(s["on"] & (p["x"] == p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")), lambda s: s["n"])


def neighbours(pages: DataFrame) -> DataFrame:
    """Adds ``theirs``, the line hashes of the page with the nearest URL on the same host, to rows with host, path, url, _key."""
    spark = pages.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["host", "path", "url", "_key"]
    placed = kept(pages.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range partition
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    if not before:
        return placed.select("*", F.col("hashes").alias("theirs"))
    ranked = placed.withColumn("_rank", F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[part] + local)
    near = ranked.select("_rank", F.struct("host", "path", "hashes").alias("n"))
    rows = ranked.join(near.select((F.col("_rank") + 1).alias("_rank"), F.col("n").alias("prev")), "_rank", "left").join(near.select((F.col("_rank") - 1).alias("_rank"), F.col("n").alias("next")), "_rank", "left")
    score = {c: F.when(F.col(f"{c}.host") == F.col("host"), _common(F.col(f"{c}.path"), F.col("path"))) for c in ("prev", "next")}
    rows = rows.withColumn("_p", score["prev"]).withColumn("_n", score["next"])
    theirs = F.when(F.col("_p").isNotNull() & (F.coalesce("_n", F.lit(-1)) <= F.col("_p")), F.col("prev.hashes")).otherwise(F.when(F.col("_n").isNotNull(), F.col("next.hashes")))
    return rows.withColumn("theirs", theirs)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html")).withColumn("_key", F.xxhash64("page_id", "url", "html"))


def gone_lines(pages: DataFrame) -> DataFrame:
    """_key, gone: the places of lines that differencing deletes, of pages that lose any.

    Copies within a host (the same lines) count as one page at the first of their addresses, so the neighbour always has
    other lines, however many copies lie between.
    """
    address = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    hashed = kept(_rows(pages).select("_key", host.alias("host"), path.alias("path"), address.alias("url"), "html").mapInArrow(
        _hashed, "_key long, host string, path string, url string, hashes array<long>, sizes array<int>, marks array<int>").withColumn("_sign", F.xxhash64("hashes")))
    first = hashed.groupBy("host", "_sign").agg(F.min_by(F.struct("path", "url", "_key", "hashes", "sizes"), F.struct("path", "url", "_key")).alias("_r")).select("host", "_sign", "_r.*")
    pairs = neighbours(first).filter("theirs IS NOT NULL").select("host", "_sign", "hashes", "sizes", "theirs")
    shared = kept(pairs.mapInArrow(_deleted, "host string, _sign long, shared array<int>, alike boolean"))
    rows = hashed.select("_key", "host", "_sign", "marks").join(checked_broadcast(shared, 128), ["host", "_sign"])
    mark = F.col("marks")
    goes = F.filter("shared", lambda i: (mark[i] == SUSPECT) | ((mark[i] == PLAIN) & ~F.col("alike")))
    return rows.select("_key", goes.alias("gone")).filter(F.size("gone") > 0).dropDuplicates(["_key"])


def deleted_lines(pages: DataFrame) -> DataFrame:
    """One row: n_pages that lose lines to differencing, n_lines they lose."""
    return gone_lines(pages).agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).cast("long").alias("n_lines"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    gone = kept(gone_lines(pages))
    return _rows(pages).join(checked_broadcast(gone, 64), "_key", "left").select("page_id", "url", "html", "gone").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
