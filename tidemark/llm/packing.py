"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed number of tokens.

Every source is a queue of tokens (its documents, in table order, each with an
end id). A source s has a target share w[s]. Each window adds size * w[s] to
the deficit counter of s, and visits go round the sources, each sending one
token at a time, the queue whose counter first reached half a token before the
others; what a counter holds after a window is carried to the next. In that
order token p of source s has its turn at the virtual time (p + 1/2) / w[s],
so the tokens that a source has sent before window n are a closed function of
n (`served_before`). A task can therefore start at any window with the right
deficits, without what other partitions do: it only needs the position of its
documents in their queues, a prefix sum over partitions. A queue that has run
dry drops out and the others share its part.

Documents are cut at window borders, so only the last window has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_slices, stored, table, text_column
from .tokens import encoder, id_type, ranges

SIZE = 4096
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, part, queue_start (tokens of the source before it in its part), n_tokens, ids (little-endian bytes).

    Null text counts as empty, a null source as the source ''.
    """
    kind = id_type(tokenizer)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, length = encoder(tokenizer).encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(length), end_id).astype(kind)
            length = length + 1
            width, ends = ids.itemsize, np.cumsum(length)
            raw = ids.tobytes()
            starts = []
            for s, n in zip(batch.column("source").to_pylist(), length.tolist(), strict=True):
                starts.append(sent.get(s, 0))
                sent[s] = starts[-1] + n
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array([part] * len(starts), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([raw[(e - n) * width : e * width] for e, n in zip(ends.tolist(), length.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "source", "part", "queue_start", "n_tokens", "ids"],
            )

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return map_slices(rows, work, "doc_id long, source string, part int, queue_start long, n_tokens long, ids binary")


def _sent(time: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens of each source whose turn is at `time` or before; one row for each time."""
    return np.minimum(np.floor(time[:, None] * weights + 0.5), totals).astype(np.int64)


def served_before(windows: np.ndarray, weights: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """Tokens of each source in the windows before each given one: rows add up to size * window, or to all tokens."""
    goal = np.minimum(windows.astype(np.int64) * size, int(totals.sum()))
    low = np.zeros(len(goal), np.int64)
    high = np.full(len(goal), np.float64((totals / weights).max() + 2).view(np.int64))
    while (low < high).any():  # bisects the bit patterns of doubles down to the first time at which `goal` tokens are sent
        mid = low + (high - low) // 2
        enough = _sent(mid.view(np.float64), weights, totals).sum(axis=1) >= goal
        high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
    before = _sent(np.maximum(high - 1, 0).view(np.float64), weights, totals)
    before[goal == 0] = 0
    turn = _sent(high.view(np.float64), weights, totals) - before
    left = goal[:, None] - before.sum(axis=1)[:, None] - (np.cumsum(turn, axis=1) - turn)
    return before + np.clip(left, 0, turn)  # equal times: in the order of the sources


def shares(total: dict[str, int], targets: dict[str, float] | None) -> np.ndarray:
    """The share of each source in a window: its target, or its part by tokens of what the targets leave over.

    Raises ValueError if a target is not above 0, if they add up to more than
    1, or if they leave nothing for sources that have none, as every document is packed.
    """
    own = {s: float(targets[s]) for s in total if s in (targets or {})}
    rest, left = sum(n for s, n in total.items() if s not in own), 1 - sum(own.values())
    if any(w <= 0 for w in own.values()) or left < -1e-9 or (rest and left <= 1e-9):
        raise ValueError("target shares must be above 0, at most 1 together, and leave some for sources without one")
    found = np.array([own[s] if s in own else left * n / rest for s, n in total.items()])
    return found if rest or not len(found) else found / found.sum()  # all sources have one: in proportion


def mixture(pieces: DataFrame) -> DataFrame:
    """source, n_tokens, last_sequence and, over the sequences up to the first in which a queue has run dry, its share; one row for each source.

    Where a share there is not the target, or last_sequence of a source comes
    early, the corpus has too little of that source for the targets asked.
    """
    ends = pieces.groupBy("source").agg(F.sum("length").alias("n_tokens"), F.max("sequence_id").alias("last_sequence"))
    whole = pieces.join(ends.agg(F.min("last_sequence").alias("dry")), F.col("sequence_id") < F.col("dry"))
    sums = whole.groupBy("source").agg(F.sum("length").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row a source
    return ends.join(sums.select("source", share.alias("share")), "source", "left")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, targets: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids.

    `targets` gives shares of tokens by source, which hold as they are while
    all queues last; sources without one divide what is left among them by
    their tokens. mixture() tells what came of it. Null text is an empty
    document (its end id alone), very long texts are cut over many windows;
    repeated rows are packed as often as they come; null doc_id is kept; an
    empty table gives no pieces. The driver holds one total for each source, no
    document; a window has a column for each source, so there should be thousands of sources at most.
    """
    tokens = stored(tokenize(docs, tokenizer, end_id), "packing-tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("source", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-parts")
    total = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    names = list(total)
    totals = np.array([total[s] for s in names], np.int64)
    weights = shares(total, targets)
    number = {s: k for k, s in enumerate(names)}
    kind = id_type(tokenizer)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def window(k: np.ndarray, p: np.ndarray) -> np.ndarray:
            """The window of token p of source k, or one before."""
            sent = _sent((p + 0.5) / weights[k], weights, totals).sum(axis=1)
            return np.maximum((sent - 1 - len(names)) // size, 0)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            source = np.array([number[s] for s in batch.column("source").to_pylist()], np.int64)
            count = batch.column("n_tokens").to_numpy()
            begin = batch.column("queue_start").to_numpy() + batch.column("base").to_numpy()
            first, last = window(source, begin), window(source, begin + count - 1) + 3 + len(names) // size
            around = np.unique(ranges(first, last - first + 1))
            served = served_before(around, weights, totals, size)
            sent = np.diff(served, axis=0)
            ahead = np.cumsum(sent, axis=1) - sent  # what earlier sources have in the window
            rows, starts, ends, at = [], [], [], []
            for k in np.unique(source):
                mine, own = served[:, k], np.flatnonzero(source == k)
                a = np.searchsorted(mine, begin[own], "right") - 1
                z = np.searchsorted(mine, begin[own] + count[own] - 1, "right") - 1
                w, doc = ranges(a, z - a + 1), np.repeat(own, z - a + 1)
                s, e = np.maximum(begin[doc], mine[w]), np.minimum(begin[doc] + count[doc], mine[w + 1])
                full = e > s
                rows.append(doc[full])
                starts.append((s - begin[doc])[full])
                ends.append((e - begin[doc])[full])
                at.append(np.stack([around[w], ahead[w, k] + s - mine[w]], axis=1)[full])
            rows, starts, ends, at = (np.concatenate(x) for x in (rows, starts, ends, at))
            ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            pieces = [memoryview(ids[r])[4 * s : 4 * e] for r, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True)]
            take = pa.array(rows)
            found = {
                "doc_id": batch.column("doc_id").take(take),
                "source": batch.column("source").take(take),
                "start": pa.array(starts),
                "length": pa.array(ends - starts),
                "ids_crc32": pa.array(map(zlib.crc32, pieces), pa.int64()),
                "doc_tokens": batch.column("n_tokens").take(take),
                "sequence_id": pa.array(at[:, 0]),
                "offset": pa.array(at[:, 1]),
            }
            return pa.RecordBatch.from_pydict(found | ({"ids": pa.array([bytes(x) for x in pieces], pa.binary())} if with_ids else {}))

        return each

    placed = tokens.join(parts.select("source", "part", "base"), ["source", "part"])
    # A slice holds a few numbers for each row and source.
    return map_slices(placed, work, PIECES + ", ids binary" * with_ids, rows=max(16, min(1024, 2_000_000 // max(1, len(names)))))


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (size token ids, the last sequence padded), n_tokens: one group is one window, never larger. No pieces, no rows."""
    pieces = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"), F.sum("length").alias("n_tokens"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for ids in batch.column("pieces").to_pylist():
                raw = np.frombuffer(b"".join(p["ids"] for p in ids), "<u4").astype(np.int32)
                rows.append(np.append(raw, np.full(size - len(raw), pad_id, np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("n_tokens")], ["sequence_id", "ids", "n_tokens"])

        return each

    return map_slices(pieces, work, "sequence_id long, ids array<int>, n_tokens long")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)
