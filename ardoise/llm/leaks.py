"""Evaluation texts leaking into training text: winnowing.

Texts are reduced to their letters and figures (wrong charsets read again, entities resolved, case,
accents, punctuation and spacing dropped) and written as UTF-8 bytes, so that one k-gram spans about
the same information in every script.  Of every window of ``WINDOW`` consecutive k-gram hashes the
least is kept, in items and documents alike: whatever they share over ``K + WINDOW - 1`` bytes or
more has a fingerprint in common.  A third of a short item may be shorter than that, so of items
under three times that length every k-gram is kept, in documents too, and under ``3 * K`` bytes k is a
third of the item: a third of an item of ``K`` bytes or more always has a fingerprint in common.

The documents are read and hashed once, whatever the number of items: fingerprints that a bitmap of
fixed size rules out are dropped there, the others are joined with the table of the items' fingerprints.
Each hit is extended in both directions to the whole shared span, and spans of one item that follow
each other in both texts are chained across changed words (a small gap in the item) and across a line
of the page that interrupts (a larger gap in the page, or one whole line of any length).

Only documents with a hit are shuffled, as their letters.

Defined results: null, empty and letterless texts leak nothing; an item shorter than ``K`` bytes is
looked for as a whole; repeated documents each give their rows; equal items each give theirs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.mojibake import repair
from ardoise.session import materialise

K = 15
WINDOW = 8
# Bits of the filter of the items' fingerprints (16 MB); fingerprints, and letters of items in bytes, up to which the
# items' side of a join is broadcast.
FILTER_BITS, BROADCAST_PRINTS, BROADCAST_BYTES = 27, 500_000, 16_000_000
# A changed word of the item, and an interrupting line of the page, in bytes.
ITEM_GAP = 60
PAGE_GAP = 600
BASE = np.uint64(0x9E3779B97F4A7C15)
_DROP = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, part double, debut int, fin int"


def _plain(text: str | None) -> str:
    if not text:
        return ""
    text, _ = repair(text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.casefold()


def letters(text: str | None) -> bytes:
    """The letters and figures of a text, without case and accents, as UTF-8."""
    return _DROP.sub("", _plain(text)).encode("utf-8", "ignore")


def long_lines(text: str | None) -> list[tuple[int, int]]:
    """Start and end, in the letters of a text, of its lines that no gap of PAGE_GAP may span with a changed word on either side."""
    out, at = [], 0
    for line in _plain(text).splitlines():
        size = len(_DROP.sub("", line).encode("utf-8", "ignore"))
        if size > PAGE_GAP - 2 * ITEM_GAP:
            out.append((at, at + size))
        at += size
    return out


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of the bytes (k at most 31); those of different k have nothing in common."""
    level = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        hashes, done, size, power = None, 0, 1, BASE
        while True:
            if k & size:  # k as a sum of powers of two
                shift = level[done:] if done else level
                hashes = level if hashes is None else hashes[: len(shift)] * power + shift[: len(hashes)]
                done += size
            if size * 2 > k:
                break
            level = level[: len(level) - size] * power + level[size:]
            size, power = size * 2, power * power
        hashes = hashes[: max(0, len(b) - k + 1)] + np.uint64(k)
        hashes = hashes ^ (hashes >> np.uint64(29))
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> np.uint64(32))


def window_minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each window of hashes."""
    m, width = hashes, 1
    while width < WINDOW and len(m) > width:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return m


def gram_size(length: int) -> tuple[int, bool]:
    """(k, whether windows are winnowed) for an item of so many bytes."""
    if length < K:
        return length, False
    return min(K, -(-length // 3)), length >= 3 * (K + WINDOW - 1)


def item_prints(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of an item, and where they start."""
    k, winnowed = gram_size(len(item))
    h = gram_hashes(item, k)
    keep = np.nonzero(np.isin(h, window_minima(h)))[0] if winnowed else np.arange(len(h))
    return h[keep], keep


def page_prints(page: np.ndarray, passes, sizes: list[int], winnowed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a page that ``passes`` lets through, and where they start.

    sizes: the k of the items whose k-grams are all kept; winnowed: whether there are others.
    """
    hashes, places = [], []
    if winnowed and len(page) >= K:
        h = gram_hashes(page, K)
        m = window_minima(h)
        starts = np.nonzero(np.concatenate([[True], m[1:] != m[:-1]]))[0]
        starts = starts[passes(m[starts])]
        at = np.array(sorted({int(s + h[s : s + WINDOW].argmin()) for s in starts}), np.int64)
        hashes.append(h[at])
        places.append(at)
    for k in sizes:
        if len(page) >= k:
            h = gram_hashes(page, k)
            at = np.nonzero(passes(h))[0]
            hashes.append(h[at])
            places.append(at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def _same_run(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.nonzero(a[:n] != b[:n])[0]
    return int(other[0]) if len(other) else n


def _spans(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], k: int = K) -> list[tuple[int, int, int, int]]:
    """Maximal shared spans (start in item, end, start in doc, end) around the hits of k-grams."""
    spans, reached = [], {}
    for d, p in sorted(hits):
        if reached.get(d - p, -1) >= d:
            continue
        if not np.array_equal(doc[d : d + k], item[p : p + k]):
            continue  # equal hashes of different k-grams
        room = min(d, p, len(item))
        left = _same_run(doc[d - room : d][::-1], item[p - room : p][::-1])
        right = _same_run(doc[d + k : d + k + len(item)], item[p + k :])
        spans.append((p - left, p + k + right, d - left, d + k + right))
        reached[d - p] = d + k + right
    return spans


def _longest(spans: list[tuple[int, int, int, int]], lines: list[tuple[int, int]] | tuple = ()) -> tuple[int, int]:
    """Start and end in the item of the best chain of spans; every byte between two spans counts against it.

    lines: start and end of the long lines of the page, each of which may interrupt as a whole.
    """
    if not spans:
        return (0, 0)
    spans.sort()
    start, score = [s[0] for s in spans], [s[1] - s[0] for s in spans]
    best, most = (0, 0), 0
    # Every predecessor of a span starts before it in the item; the earlier ones by where they end in both texts.
    ends: dict[tuple[int, int], list[int]] = defaultdict(list)
    for j, (a, b, c, d) in enumerate(spans):
        # Where in the page a predecessor may end: shortly before, or about the start of a long line that ends here.
        ranges = [(c - PAGE_GAP, c + K)] + [(s - ITEM_GAP, min(s + K, c - PAGE_GAP - 1)) for s, e in lines[bisect_left(lines, c - ITEM_GAP, key=_end) : bisect_right(lines, c + K, key=_end)]]
        near = {i for low, high in ranges for i in _ended(ends, a, low, high) if low <= spans[i][3] <= high}
        for i in sorted(near, reverse=True):
            gap = a - spans[i][1]
            if -K <= gap <= ITEM_GAP and score[i] - abs(gap) > 0 and score[i] - abs(gap) + b - a > score[j]:
                score[j], start[j] = score[i] - abs(gap) + b - a, start[i]
        if score[j] > most:
            best, most = (start[j], b), score[j]
        ends[b // (ITEM_GAP + K + 1), d // (PAGE_GAP + K + 1)].append(j)
    return best


def _end(line: tuple[int, int]) -> int:
    return line[1]


def _ended(ends: dict[tuple[int, int], list[int]], a: int, low: int, high: int) -> list[int]:
    """The spans that may end within the gap before a in the item and from low to high in the page."""
    wide, long = ITEM_GAP + K + 1, PAGE_GAP + K + 1
    return [i for x in range((a - ITEM_GAP) // wide, (a + K) // wide + 1) for y in range(low // long, high // long + 1) for i in ends.get((x, y), ())]


def passage(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], lines: list[tuple[int, int]]) -> tuple[float, int, int]:
    """(share of the item, start, end) of its longest passage in the page, from the hits (place in page, place in item)."""
    a, b = _longest(_spans(doc, item, hits, gram_size(len(item))[0]), lines)
    return (b - a) / len(item), a, b


def _print_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, item_id, bytes_, hashes, places, ks, winnowed = [], [], [], [], [], [], []
        for n, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            item = letters(t)
            if item:
                h, p = item_prints(np.frombuffer(item, np.uint8))
                k, w = gram_size(len(item))
                number.append(n), item_id.append(i), bytes_.append(item), hashes.append(h.view(np.int64)), places.append(p.astype(np.int32)), ks.append(k), winnowed.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(item_id, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(ks, pa.int32()), pa.array(winnowed, pa.bool_())], names=["numero", "item_id", "lettres", "traces", "places", "k", "tamise"])


ITEMS = "numero long, item_id long, lettres binary, traces array<long>, places array<int>, k int, tamise boolean"
PAGES = "doc_id long, lettres binary, lignes array<int>, traces array<long>, places array<int>"


def bitmap_of(traces: DataFrame) -> np.ndarray:
    """One bit for each hash, by its leading FILTER_BITS: at most 2 ** FILTER_BITS / 64 words come to the driver."""
    bit = F.shiftrightunsigned("trace", 64 - FILTER_BITS)
    words = traces.select(F.shiftright(bit, 6).cast("int").alias("mot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(trace, {64 - FILTER_BITS}) & 63 as int))").alias("_bit")).groupBy("mot").agg(F.bit_or("_bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("mot").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _scanner(bitmap, sizes: list[int], winnowed: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value

        def passes(h: np.ndarray) -> np.ndarray:
            at = h >> np.uint64(64 - FILTER_BITS)
            return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [letters(t) for t in raw]
            # One pass of hashing over all texts of the batch; the byte between them occurs in no text.
            h, at = page_prints(np.frombuffer(b"\xff".join(texts), np.uint8), passes, sizes, winnowed)
            ends = np.cumsum([len(t) + 1 for t in texts])
            owner = np.searchsorted(ends, at, "right")
            rows = []
            for k in np.unique(owner):
                own = owner == k
                lines = [x for line in long_lines(raw[k]) for x in line]
                rows.append((ids[k], texts[k], lines, h[own].view(np.int64), (at[own] - (int(ends[k]) - len(texts[k]) - 1)).astype(np.int32)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "lettres", "lignes", "traces", "places"])

    return scan


def _extender(least: float):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, page, lines, items in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                doc, pairs = np.frombuffer(page, np.uint8), list(zip(lines[::2], lines[1::2], strict=True))
                for x in items:
                    part, a, b = passage(doc, np.frombuffer(x["item"], np.uint8), [(h["d"], h["p"]) for h in x["touches"]], pairs)
                    if part >= least and (part == 1 or len(x["item"]) >= K):
                        rows.append((doc_id, x["item_id"], part, a, b))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "part", "debut", "fin"])

    return extend


def leaks(documents: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc_id, item_id, part, debut, fin): documents that hold at least ``least`` of an item.

    part: share of the item's letters in the longest passage; debut, fin: that passage, in bytes of
    the item's letters.
    """
    spark = documents.sparkSession
    known = materialise(items.select(F.monotonically_increasing_id().alias("numero"), F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_print_items, ITEMS), "items")
    # Fifteen values of k at most.
    kinds = known.groupBy("k", "tamise").agg(F.sum(F.size("traces")).alias("traces"), F.sum(F.length("lettres")).alias("octets")).collect()
    if not kinds:
        return spark.createDataFrame([], SCHEMA)
    traces = known.select("numero", F.explode(F.arrays_zip("traces", "places")).alias("x")).select(F.col("x.traces").alias("trace"), "numero", F.col("x.places").alias("p"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(traces))
    sizes, winnowed = sorted({r.k for r in kinds if not r.tamise}), any(r.tamise for r in kinds)
    pages = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanner(bitmap, sizes, winnowed), PAGES)
    pages = materialise(pages.withColumn("page", F.monotonically_increasing_id()), "pages-touchees")
    if sum(r.traces for r in kinds) <= BROADCAST_PRINTS:
        traces = F.broadcast(traces)
    texts = known.select("numero", "item_id", F.col("lettres").alias("item"))
    if sum(r.octets for r in kinds) <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    hits = pages.select("page", F.explode(F.arrays_zip("traces", "places")).alias("x")).select("page", F.col("x.traces").alias("trace"), F.col("x.places").alias("d"))
    pairs = hits.join(traces, "trace").groupBy("page", "numero").agg(F.collect_list(F.struct("d", "p")).alias("touches")).join(texts, "numero")
    by_page = pairs.groupBy("page").agg(F.collect_list(F.struct("item_id", "item", "touches")).alias("items"))
    return pages.join(by_page, "page").select("doc_id", "lettres", "lignes", "items").mapInArrow(_extender(least), SCHEMA)
