"""Benchmark items in the documents: a positional inverted index and searches of it.

The index is a table. Each task inverts its documents in segments of bounded
size: a row for each term of a segment has the term's places in it, where a
document's words have consecutive places and one is free before the next
document; a row without a term has a document's place. So a document's phrases
are found in its segment alone, whatever terms are frequent.

A search takes the items' windows in blocks of bounded size. The postings of a
block's terms come together by segment; there the places of each window's
rarest term, less its offset, are intersected with those of its next rarest
term, and so on, for all windows at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, stored, table

#: Words of A-Z-lower-cased UTF-8: all but ASCII's other characters. The bytes of characters beyond ASCII are above 7F.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text in a segment and in a block of items, words in a row of items, and places looked up at once.
SEGMENT_BYTES, BLOCK_BYTES, ITEM_WORDS, AT_ONCE = 32_000_000, 4_000_000, 4096, 4_000_000

INDEX = "segment long, term string, n long, doc long, doc_id long, start long, postings binary"


class _Numbers(dict):
    """term -> number, the next one for a new term."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, the lowest first, bit 7 set in all but a number's last byte; and the bytes of each."""
    sizes = 1 + sum((gaps >> shift > 0).astype(np.int64) for shift in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[first[has] + k] = (gaps[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last + 1])[:-1].astype(np.int64)
    at = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * at, first) if len(first) else np.zeros(0, np.int64)


class _Segment:
    def __init__(self) -> None:
        self.terms, self.size, self.next = _Numbers(), 0, 0
        self.words: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, text: str) -> None:
        units = text.encode().lower()
        found = WORD.findall(units)
        self.words.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.docs.append((doc_id, self.next, len(found)))
        self.next += len(found) + 1
        self.size += len(units) + 100

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        n, k = len(self.docs), len(self.terms)
        ids, starts, sizes = (np.array(x, object if c == 0 else np.int64) for c, x in enumerate(zip(*self.docs, strict=True)))
        words = np.concatenate(self.words)
        places = np.arange(len(words)) + np.repeat(np.arange(n), sizes)
        places = places[np.argsort(words, kind="stable")]
        counts = np.bincount(words, minlength=k)
        first = np.cumsum(counts) - counts
        gaps = np.diff(places, prepend=0)
        gaps[first] = places[first]
        data, lengths = packed(gaps)
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.append(first, len(words))]
        names = [x.split()[0] for x in INDEX.split(", ")]
        none = lambda m, t: pa.nulls(m, t)
        doc = [pa.array(np.full(n, segment)), none(n, pa.string()), pa.array(sizes), pa.array(np.arange(n)), pa.array(list(ids), pa.int64()), pa.array(starts), none(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(doc, names=names)
        postings = pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)])
        term = [pa.array(np.full(k, segment)), pa.array(list(self.terms), pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64)), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()), postings]
        whole = pa.RecordBatch.from_arrays(term, names=names)
        for at in range(0, k, 20_000):
            yield whole.slice(at, 20_000)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of documents (doc_id, text), a table: for each segment and term n, postings; for each document (term null) doc, doc_id, start and n, its words.

    A null text has no words; repeated rows are documents each; an empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number = _Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    segment.add(doc_id, text)
                    if segment.size >= segment_bytes:
                        yield from segment.rows(number)
                        segment, number = _Segment(), number + 1
        if segment.docs:
            yield from segment.rows(number)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, INDEX), "positional-index")


def item_parts(items: DataFrame, size: int) -> DataFrame:
    """item_id (text), words, part: items (item_id, text) in rows of at most ITEM_WORDS words, each with the size - 1 words after it, so that no window is lost."""

    def work():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = [], []
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text")), strict=True):
                words = WORD.findall(text.encode().lower())
                for at in range(0, max(1, len(words) - size + 1), ITEM_WORDS):
                    part = words[at : at + ITEM_WORDS + size - 1]
                    if part:
                        ids.append(item)
                        out.append(b" ".join(part).decode())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["item_id", "words"])

        return each

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, work, "item_id string, words string").withColumn("part", F.monotonically_increasing_id())


class Windows:
    """The different windows of a block of items: term numbers (window x size, -1 beyond a shorter one), lengths, and the items of each window."""

    def __init__(self, parts: list[tuple[str, str]], size: int) -> None:
        self.terms, rows, owners = _Numbers(), [], []
        for item, words in parts:
            ids = np.fromiter(map(self.terms.__getitem__, words.split(" ")), np.int64)
            if len(ids) < size:
                ids = np.append(ids, np.full(size - len(ids), -1))
            found = np.lib.stride_tricks.sliding_window_view(ids, size)
            rows.append(found)
            owners += [item] * len(found)
        self.rows, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.rows >= 0).sum(axis=1)
        self.items: list[list[str]] = [[] for _ in self.rows]
        for window, item in zip(of.ravel().tolist(), owners, strict=True):
            self.items[window].append(item)
        self.items = [sorted(set(x)) for x in self.items]


class Postings:
    """The places of terms in a segment, looked up for many terms at once."""

    def __init__(self, terms: int, ids: np.ndarray, counts: np.ndarray, data: list[bytes], room: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, counts = ids[order], counts[order]
        gaps = unpacked(np.frombuffer(b"".join([data[k] for k in order.tolist()]), np.uint8))
        total = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        self.places = total - np.repeat(total[first] - gaps[first], counts)
        self.span = int(self.places.max(initial=0)) + room + 1
        self.keys = np.repeat(ids, counts) * self.span + self.places
        self.first, self.count = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        self.first[ids], self.count[ids] = first, counts

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * self.span + places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def next(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first place of the term after this one, or one beyond all."""
        at = np.searchsorted(self.keys, terms * self.span + places, "right")
        there = at < self.first[terms] + self.count[terms]
        return np.where(there, self.places[np.minimum(at, len(self.places) - 1)], np.iinfo(np.int64).max // 4)

    def last(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The last place of the term before this one, or one below all."""
        at = np.searchsorted(self.keys, terms * self.span + places) - 1
        return np.where(at >= self.first[terms], self.places[np.maximum(at, 0)], -(np.iinfo(np.int64).max // 4))


def _exact(post: Postings, rows: np.ndarray, length: np.ndarray, counts: np.ndarray, window: np.ndarray, anchor: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose words stand in a row, of places of each window's rarest term: one intersection for each further term, by rarity."""
    start = anchor - offset
    order = np.argsort(counts, axis=1, kind="stable")
    live = start >= 0
    window, start = window[live], start[live]
    for k in range(1, rows.shape[1]):
        at = order[window, k]
        beyond = k >= length[window]
        live = beyond | post.has(np.where(beyond, 0, rows[window, at]), start + at)
        window, start = window[live], start[live]
    return window, start, start + length[window] - 1


def _near(post: Postings, rows: np.ndarray, length: np.ndarray, slop: int, window: np.ndarray, anchor: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose words stand in order with at most `slop` others among them, of places of each window's rarest term: the nearest next word to the right, then to the left, and of the spans found only those with no other of the window inside."""
    low, high = anchor.copy(), anchor.copy()
    for step in range(1, rows.shape[1]):
        at = offset + step
        more = at < length[window]
        high = np.where(more, post.next(np.where(more, rows[window, np.minimum(at, rows.shape[1] - 1)], 0), high), high)
        live = high - anchor + offset + 1 <= length[window] + slop
        window, anchor, offset, low, high = (x[live] for x in (window, anchor, offset, low, high))
    for step in range(1, rows.shape[1]):
        at = offset - step
        more = at >= 0
        low = np.where(more, post.last(np.where(more, rows[window, np.maximum(at, 0)], 0), low), low)
        live = high - low + 1 <= length[window] + slop
        window, offset, low, high = (x[live] for x in (window, offset, low, high))
    order = np.lexsort((high, low, window))
    window, low, high = window[order], low[order], high[order]
    # Of spans with one start only the shortest, then those that end before all that start later.
    first = np.ones(len(low), bool)
    first[1:] = (window[1:] != window[:-1]) | (low[1:] != low[:-1])
    window, low, high = window[first], low[first], high[first]
    value = high + window * post.span
    later = np.append(np.minimum.accumulate(value[::-1])[::-1][1:], np.iinfo(np.int64).max)
    least = value < later
    return window[least], low[least], high[least]


def occurrences(post: Postings, windows: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """window, first and last place of every occurrence in a segment, in parts of at most about AT_ONCE places of rarest terms."""
    there = np.where(windows.rows >= 0, post.count[windows.rows], np.iinfo(np.int64).max)
    rarest = there.argmin(axis=1)
    cost = there[np.arange(len(rarest)), rarest]
    live = np.flatnonzero(cost > 0)
    upto = np.cumsum(cost[live])
    for part in np.split(live, np.flatnonzero(np.diff(upto // AT_ONCE)) + 1):
        if not len(part):
            continue
        size = cost[part]
        begin = post.first[windows.rows[part, rarest[part]]]
        local = np.repeat(np.arange(len(part)), size)
        anchor = post.places[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
        rows, length, offset = windows.rows[part], windows.length[part], rarest[part][local]
        window, low, high = _near(post, rows, length, slop, local, anchor, offset) if slop else _exact(post, rows, length, there[part], local, anchor, offset)
        yield part[window], low, high


def _blocks(items: DataFrame, size: int, block_bytes: int) -> Iterator[Windows]:
    """Windows of all items, block by block; a block's bytes are counted before the driver takes it: two blocks' at most, or a row's."""
    parts = stored(item_parts(items, size).withColumn("n", F.octet_length("words")), "item-parts")
    total, longest = (x or 0 for x in parts.agg(F.sum("n"), F.max("n")).first())
    blocks = max(1, -(-total // block_bytes))
    of = lambda: F.pmod(F.xxhash64("part"), F.lit(blocks))
    while (parts.groupBy(of().alias("block")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > max(2 * block_bytes, longest):
        blocks *= 2
    for block in range(blocks):
        rows = parts.where(of() == block).select("item_id", "words").collect()
        if rows:
            yield Windows([tuple(r) for r in rows], size)


def _finder(windows: Windows, size: int, slop: int, merged: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The search of one segment: its rows of documents and of the block's terms."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        is_doc = frame["term"].isna()
        docs, posts = frame[is_doc].sort_values("start"), frame[~is_doc]
        out = {"doc": [], "first": [], "last": [], "items": []}
        if len(posts):
            starts, numbers = docs["start"].to_numpy(np.int64), docs["doc"].to_numpy(np.int64)
            post = Postings(len(windows.terms), posts["term"].map(dict(windows.terms)).to_numpy(np.int64), posts["n"].to_numpy(np.int64), list(posts["postings"]), size + slop)
            for window, low, high in occurrences(post, windows, slop):
                at = np.searchsorted(starts, low, "right") - 1
                inside = at == np.searchsorted(starts, high, "right") - 1
                for key, x in (("doc", numbers[at]), ("first", low - starts[at]), ("last", high - starts[at]), ("items", window)):
                    out[key].append(x[inside])
        flat = pd.DataFrame({k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in out.items()})
        if merged:
            flat = _merged(flat, windows)
        else:
            flat["items"] = pd.Series([windows.items[w] for w in flat["items"]], dtype=object)
        flat.insert(0, "segment", int(frame["segment"].iloc[0]))
        return flat

    return find


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, block_bytes: int = BLOCK_BYTES, merged: bool = False) -> DataFrame:
    """Occurrences of the items' windows in the indexed documents.

    A window is `size` consecutive words of an item (item_id, text), or all
    words of a shorter one. With slop 0 it occurs as an exact phrase; with more,
    where its words stand in order with at most `slop` others among them (spans that
    hold a shorter one do not count). Rows: segment, doc, first, last (words of
    the document from 0), items; each different window's occurrence once for each
    block of items. merged=True gives a row for each document: segment, doc,
    spans (first and last, overlaps joined) and items.

    Items without words have no windows; null item_ids are empty ones.
    """
    shape = "spans array<struct<first:long,last:long>>" if merged else "first long, last long"
    schema, out = f"segment long, doc long, {shape}, items array<string>", None
    for windows in _blocks(items, size, block_bytes):
        vocabulary = items.sparkSession.createDataFrame([(t,) for t in [None, *windows.terms]], "wanted string")
        rows = index.join(F.broadcast(vocabulary), F.col("term").eqNullSafe(F.col("wanted")), "left_semi").select("segment", "term", "n", "doc", "start", "postings")
        found = rows.groupBy("segment").applyInPandas(_finder(windows, size, slop, merged), schema)
        out = found if out is None else out.unionByName(found)
    return items.sparkSession.createDataFrame([], schema) if out is None else out


def _merged(flat: pd.DataFrame, windows: Windows) -> pd.DataFrame:
    """One row for each document, overlapping spans joined."""
    flat = flat.sort_values(["doc", "first", "last"], kind="stable")
    doc, first, last, window = (flat[c].to_numpy() for c in ("doc", "first", "last", "items"))
    if not len(doc):
        return pd.DataFrame({"doc": doc, "spans": pd.Series([], dtype=object), "items": pd.Series([], dtype=object)})
    room = int(last.max()) + 2
    reach = np.maximum.accumulate(last + doc * room)
    new = np.append(True, first[1:] + doc[1:] * room > reach[:-1])
    begin = np.flatnonzero(new)
    span_doc, span_first, span_last = doc[begin], first[begin], reach[np.append(begin[1:], len(doc)) - 1] - doc[begin] * room
    heads = np.flatnonzero(np.append(True, span_doc[1:] != span_doc[:-1]))
    spans = [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(np.split(span_first, heads[1:]), np.split(span_last, heads[1:]), strict=True)]
    pairs = np.unique(np.stack([doc, window]), axis=1)
    cut = np.flatnonzero(np.diff(pairs[0])) + 1
    items = [sorted({i for w in part.tolist() for i in windows.items[w]}) for part in np.split(pairs[1], cut)]
    return pd.DataFrame({"doc": span_doc[heads], "spans": [[{"first": a, "last": b} for a, b in x] for x in spans], "items": items})


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as text) of each document (doc_id, text): its words, those of them in occurrences of the windows of items, and the items with such.

    Null and empty texts have no words; repeated rows give their row each, repeated
    item_ids count once; texts of any length are searched whole; an empty
    table of items hits nothing, one of documents gives no rows.
    """
    index = build_index(docs, segment_bytes)
    found = search(index, items, size, block_bytes=block_bytes, merged=True)
    # Spans of several blocks may overlap: in order, each adds what lies beyond those before it.
    by_doc = found.groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    added = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["next"]) + 1)).alias("n"), F.greatest(a["next"], s["last"] + 1).alias("next"))
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("next")), added, lambda a: a["n"])
    every = index.where("term IS NULL").select("segment", "doc", "doc_id", F.col("n").alias("n_words"))
    rows = every.join(by_doc.select("segment", "doc", hit.alias("n_hit"), "items"), ["segment", "doc"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_inverted_index_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
