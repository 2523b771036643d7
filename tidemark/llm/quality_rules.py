"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch of one measure over one group is a histogram with log-linear buckets
(32 to each power of two): rows of (group, measure, bucket, count). Two
sketches merge by adding counts, so partial aggregation builds them before the
shuffle and the sketches of a language, or of everything, are sums of those of
its sources. A quantile read from one is off by at most 1/32 of its value.

Each measure is a count over a number of units (symbols over words, say), and
its sketch holds the documents' rates. Two quantiles of a group are read from
the sketch. A document passes a measure if its rate is at most the upper one
plus FENCE times its distance to the lower one, or if its count is no more than
chance makes of the upper rate: E + NOISE * sqrt(clump * (E + clump)), with
E counts expected, for counts that come in clumps. So where a group's documents
are all alike only chance is allowed, of which a short text has more than a
long one, and no cutoff is stated. One formula holds
for groups of every size: the quantiles of a group of n documents are
(n * own + PRIOR * those of its language) / (n + PRIOR), and those of a
language lean on the whole table's in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_slices, stored, table, text_column

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")
SYMBOLS = b"#*$%&|<>"
#: Capitals and exclamation marks.
SHOUTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
#: measure -> (count, units, lower and upper quantile in percent, least clump: a window of three words that repeats makes six words).
MEASURES = {
    "symbols": ("n_symbols", "n_words", 25, 75, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 25, 75, 1),
    "repeats": ("n_repeat_words", "n_words", 50, 95, 6),
    "shouts": ("n_shouts", "word_chars", 50, 95, 1),
    "word_length": ("word_chars", "n_words", 25, 75, 1),
}
MIN_WORDS, MAX_REPEAT_PERCENT, FENCE, NOISE = 50, 50, 3, 4
#: Documents that the wider group counts for in the quantiles of a group.
PRIOR = 10


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of anything but ASCII white space."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, upto)
                upto = at + 3
    return (
        len(words),
        len(text) - (len(raw) - sum(map(len, words))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, SHOUTS)),
    )


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (struct of the carried columns), lang, source and COUNTS; null text has no words, null lang or source count as ''."""
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.struct(*carry).alias("row"), text_column().alias("text"), *group)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(zip(*map(measure, batch.column("text").to_pylist()), strict=True))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "lang", "source")), *(pa.array(x, pa.int64()) for x in found)], ["row", "lang", "source", *COUNTS])

        return each

    schema = T.StructType([*rows.select("row", "lang", "source").schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return map_slices(rows, work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _value(name: str) -> Column:
    over, under, *_ = MEASURES[name]
    return F.expr(f"1000 * {over} div greatest({under}, 1)")


def within(name: str) -> str:
    """SQL of Spark and DuckDB: whether a document's count is within its group's limit max_<name> or chance at its rate high_<name>."""
    over, under, _, _, clump = MEASURES[name]
    units = f"greatest({under}, 1)"
    beyond = f"CAST(1000 * {over} - high_{name} * {units} AS DOUBLE)"
    return f"(1000 * {over} <= max_{name} * {units} OR {beyond} * {beyond} <= {1000 * NOISE * NOISE * clump} * CAST(high_{name} * {units} + {1000 * clump} AS DOUBLE))"


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, top (largest value of the bucket), n."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _value(m).alias("value")) for m in MEASURES)))
    rows = rows.where(~base_failed()).select("lang", "source", values.alias("v")).select("lang", "source", "v.*")
    power = F.expr("greatest(length(bin(value)) - 6, 0)")
    rows = rows.withColumn("power", power).withColumn("step", F.expr("shiftright(value, power)"))
    return rows.groupBy("lang", "source", "measure", "power", "step").agg(F.count("*").alias("n")).select("lang", "source", "measure", F.expr("shiftleft(step + 1, power) - 1").alias("top"), "n")


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the sketches by the keys and read the two quantiles of each measure: keys, measure, size, low, high."""
    merged = sketch.groupBy(*keys, "measure", "top").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("top"))
    merged = merged.select(*keys, "measure", "top", upto.alias("upto"), F.sum("n").over(group).alias("size"))
    level = lambda k: F.create_map(*(F.lit(x) for m, spec in MEASURES.items() for x in (m, spec[k])))[F.col("measure")]
    least = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("size") * level(k), F.col("top")))
    return merged.groupBy(*keys, "measure").agg(F.max("size").alias("size"), least(2).alias("low"), least(3).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and, for each measure, the limit and the upper rate (max_, high_), from quantiles that lean on the wider group's with the weight of PRIOR documents."""
    groups = sketch.select("lang", "source", "measure").distinct()
    for name, keys in (("own", ["lang", "source"]), ("wide", ["lang"]), ("whole", [])):
        groups = groups.join(quantiles(sketch, keys).select(*keys, "measure", *(F.col(c).alias(f"{name}_{c}") for c in ("size", "low", "high"))), [*keys, "measure"])
    for q in ("low", "high"):
        groups = groups.withColumn(f"lang_{q}", F.expr(f"(wide_size * wide_{q} + {PRIOR} * whole_{q}) div (wide_size + {PRIOR})"))
        groups = groups.withColumn(q, F.expr(f"(own_size * own_{q} + {PRIOR} * lang_{q}) div (own_size + {PRIOR})"))
    limit = F.col("high") + FENCE * (F.col("high") - F.col("low"))
    return groups.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, c)).alias(f"{n}_{m}") for m in MEASURES for n, c in (("max", limit), ("high", F.col("high")))))


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row, COUNTS, base_failed and kept, for every row of docs.

    Null or empty text fails the base rules (no words); very long texts are
    counted whole. Repeated rows are judged alike and all returned, a value at
    the limit passes; an empty table gives no rows.
    """
    rows = stored(measured(docs, carry), "quality-rules")
    limits = stored(thresholds(sketches(rows)), "quality-limits")
    rows = rows.join(limits, ["lang", "source"], "left")
    fits = ~base_failed()
    for m in MEASURES:
        fits = fits & F.expr(within(m))
    return rows.select("row", *COUNTS, base_failed().alias("base_failed"), F.coalesce(fits, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; null and empty texts go, an empty table stays empty."""
    return judged(docs, docs.columns).where("kept").select("row.*")


def op5_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("row.doc_id", *COUNTS[:5], "base_failed", "kept")
