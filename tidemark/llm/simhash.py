"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant, a number within
r bits of both. Every distinct fingerprint emits all its variants within r
bits (2,081 for 64 bits and r = 2); fingerprints that meet in a variant are
linked after a check of their distance.

Variants are shuffled by their leading bits: of the 2,081, those that share
the leading bits go together as one entry, the fingerprint itself, from which
the receiver makes the rest again. Leading bits that gather too many
fingerprints are lengthened, in steps, up to the whole variant if need be, so
a receiver holds a bounded number; one variant alone has at most 2,081.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_slices, stored, table, text_column

SHINGLE, SEED, REACH = 4, 42, 2
#: Leading bits at first and by how many they are lengthened; fingerprints with the same leading bits on average; variants that may gather at one receiver.
FIRST_BITS, MORE_BITS, USUAL, MOST = 8, 8, 1000, 8_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)
INDEX_BITS = np.uint64(24)


def fingerprint(text: str) -> int:
    """Bit k is 1 if it is set in over half the hashes of the word shingles; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first = (ends - size)[: max(1, len(words) - SHINGLE + 1)].tolist()
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (struct of the carried columns), uid (unique for each row), doc_id, fp (as a signed 64-bit number)."""
    rows = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal uid
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            uids = pa.array(np.arange(uid, uid + len(fps)))
            uid += len(fps)
            return pa.RecordBatch.from_arrays([batch.column("row"), uids, batch.column("doc_id"), pa.array(fps)], ["row", "uid", "doc_id", "fp"])

        return each

    schema = T.StructType([rows.schema["row"], T.StructField("uid", T.LongType()), rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return map_slices(rows, work, schema)


def flips(low: int, high: int, most: int) -> np.ndarray:
    """All masks of at most `most` of the bits low .. high - 1."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(low, high), k)], np.uint64)


def send(fps: np.ndarray, reach: int, bits: int, hot: dict[int, np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(bits, leading bits, fingerprints) for each value of the leading bits among the variants of fps; hot: by number of bits, those to lengthen."""
    out = []
    left = [(fps, fps, reach)]  # fingerprints, variants so far, flips left
    upto = 64
    while left:
        down = 64 - bits
        masks = {r: flips(down, upto, r) for _, _, r in left}
        found: dict[int, list] = {}
        for own, at, r in left:
            for n in range(r + 1):
                some = masks[r][np.bitwise_count(masks[r]) == n]
                found.setdefault(r - n, []).append((np.repeat(own, len(some)), (at[:, None] ^ some).ravel()))
        left = []
        keys, owners = [], []
        for r, several in found.items():
            own, at = (np.concatenate(x) for x in zip(*several, strict=True))
            key = at >> np.uint64(down) if down else at
            more = np.isin(key, hot.get(bits, np.zeros(0, np.uint64)))
            if more.any():
                left.append((own[more], at[more], r))
            keys.append(key[~more])
            owners.append(own[~more])
        key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        out += [(bits, int(key[s]), x) for s, x in zip(starts, np.split(own, starts[1:]), strict=True)] if len(key) else []
        upto, bits = down, min(64, bits + MORE_BITS)
    return out


def meet(fps: np.ndarray, reach: int, bits: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints among those sent to one value of the leading bits: each with the first one it is connected to."""
    fps = np.unique(fps)
    down = 64 - bits
    used = np.bitwise_count((fps >> np.uint64(down) if down else fps) ^ np.uint64(lead))
    low = np.uint64((1 << down) - 1)
    parts = []
    for n in range(reach + 1):
        at = np.flatnonzero(used == n)
        masks = flips(0, down, reach - n)
        variants = ((fps[at] & low)[:, None] ^ masks) * SPREAD >> INDEX_BITS << INDEX_BITS
        parts.append((variants | at.astype(np.uint64)[:, None]).ravel())
    keys = np.concatenate(parts)
    keys.sort()
    index = (keys & np.uint64((1 << 24) - 1)).astype(np.int64)
    keys >>= INDEX_BITS
    same = np.flatnonzero(keys[1:] == keys[:-1])
    a, b = index[same], index[same + 1]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * reach
    pairs = [a[near] * len(fps) + b[near]]
    for key in np.unique(keys[same[~near]]):  # two variants with one hash: every two of that run
        run = np.unique(index[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")])
        for k, i in enumerate(run[:-1]):
            others = run[k + 1 :]
            pairs.append(i * len(fps) + others[np.bitwise_count(fps[others] ^ fps[i]) <= 2 * reach])
    a, b = np.divmod(np.unique(np.concatenate(pairs)), len(fps))
    label = np.arange(len(fps))
    while len(a) and (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def gathered(fps: DataFrame, reach: int, bits: int, under: DataFrame | None = None) -> DataFrame:
    """lead, n: how many variants have these leading bits; under: only those whose first bits - MORE_BITS are in its column lead."""
    down = 64 - bits
    masks = flips(down, 64, reach)
    left = [len(flips(0, down, reach - k)) for k in range(reach + 1)]
    ways = F.explode(F.array(*(F.struct(F.lit(int(m)).alias("mask"), F.lit(left[k]).cast("long").alias("n")) for m, k in zip(masks.view(np.int64), np.bitwise_count(masks).tolist(), strict=True))))
    sent = fps.select("fp", ways.alias("way")).select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("way.mask")), down).alias("lead"), "way.n")
    if under is not None:
        sent = sent.withColumn("before", F.shiftrightunsigned("lead", MORE_BITS)).join(under.select(F.col("lead").alias("before")), "before", "left_semi")
    return sent.groupBy("lead").agg(F.sum("n").alias("n"))


def links(fps: DataFrame, reach: int = REACH) -> DataFrame:
    """a, b: for distinct fingerprints fp, pairs with the same connected groups as all pairs of at most 2 * reach differing bits."""
    n = fps.count()
    bits = first = min(64, max(FIRST_BITS, math.ceil(math.log2(max(1, n / USUAL)))))
    hot: dict[int, np.ndarray] = {}
    under = None
    while bits < 64:
        # A value is hot with more than MOST of the 2,081 variants of each fingerprint, so all of them are at most 8 bytes for each 3,844 fingerprints: 21 MB for 10 billion.
        under = stored(gathered(fps, reach, bits, under).where(F.col("n") > MOST).select("lead"), "simhash-hot")
        found = under.toPandas()["lead"].to_numpy(np.int64)
        if not len(found):
            break
        hot[bits] = found.view(np.uint64)
        bits = min(64, bits + MORE_BITS)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sent = send(batch.column("fp").to_numpy().view(np.uint64), reach, first, hot)
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in sent], pa.int32()), pa.array(np.array([k for _, k, _ in sent], np.uint64).view(np.int64)), pa.array([x.tobytes() for _, _, x in sent], pa.binary())], ["bits", "lead", "fps"]
            )

        return each

    def linked(group: pa.Table) -> pa.Table:
        fps = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("fps").to_pylist()])
        a, b = meet(fps, reach, group.column("bits")[0].as_py(), group.column("lead")[0].as_py() % (1 << 64))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = map_slices(fps.select("fp"), work, "bits int, lead long, fps binary", rows=8192)
    return sent.groupBy("bits", "lead").applyInArrow(linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b), by rounds of large and small stars."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    stars = stored(edges.select(most.alias("hi"), least.alias("lo")).where("hi <> lo").distinct(), "components")
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        root = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("root"))
        large = both.where("lo > hi").join(root, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(root, "hi")
        small = small.select("hi", F.col("root").alias("lo")).unionByName(small.select(F.col("lo").alias("hi"), F.col("root").alias("lo")))
        stars = stored(small.where("hi <> lo").distinct(), "components")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.crc32(F.concat_ws(",", "hi", "lo")))).first()
        if now == state:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now


def groups(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """fp, component_id, winner (uid of the row that stands for the component), from fingerprints().

    component_id is the least doc_id of the component, null if it has none but null.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("first")), "simhash-fingerprints")
    roots = components(links(fps, reach)).select(F.col("node").alias("fp"), "root")
    # Both sides of the join on root are read from tables, so that a root with very many fingerprints can be split.
    fps = stored(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    whole = stored(fps.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first")), "simhash-components")
    return stored(fps.select("fp", "root").join(whole, "root").select("fp", "component_id", F.col("first.uid").alias("winner")), "simhash-groups")


def near_duplicates(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    Null text counts as empty, very long texts are hashed whole; texts without
    words have fingerprint zero and link like any other; repeated rows and null
    doc_id are kept; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, ["doc_id"]).select("uid", "doc_id", "fp"), "simhash-rows")
    return rows.join(groups(rows, reach).select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of docs, all columns, of which one stands for each group of near copies: the one with the least doc_id.

    Null doc_id comes last; of rows with equal doc_id one stays. Texts without
    words, null ones too, are one group. An empty table stays empty.
    """
    rows = stored(fingerprints(docs, docs.columns), "simhash-rows")
    winners = groups(rows.select("uid", "doc_id", "fp"), reach).select(F.col("winner").alias("uid")).distinct()
    # Never a broadcast: winners grow with the documents. Sorting both sides by uid costs one shuffle of the texts, at every size.
    return rows.join(winners.hint("merge"), "uid", "left_semi").select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
