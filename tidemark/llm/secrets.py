"""Secret scan: patterns, and character Markov models of random strings against ordinary identifiers.

All of it is row-local DataFrame functions: no shuffle of texts, no Python.

The models are first-order Markov chains over ALPHABET, one trained on random
strings and one on ordinary identifiers, both from a labelled sample that is
derived from words of the corpus: the words themselves, also in capitals, and identifiers
and paths made of them are ordinary, digests of them in hexadecimal, base 64 and capitals with
digits are random. A part of a run of characters is a secret if its log-likelihood ratio,
random against ordinary, is at least MIN_RATIO in all and MIN_PER_STEP for each step.
"""

from __future__ import annotations

import importlib
import json
import math
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, table, text_column

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
#: kind -> pattern, group whose length counts, least length; in the order in which spans of one start are listed.
BASE = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
#: Patterns that match wherever the above pass, to skip most texts and the many short runs of hexadecimal digits.
SIEVE = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: Runs that the models see: from the least length of an assigned secret, as the models take short names in capitals such as AKIA123 for random.
RUN = "[A-Za-z0-9+/_-]{8,}={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIDE = len(ALPHABET) + 1
MIN_RATIO, MIN_PER_STEP, STRONG = 10.5, 0.5, 2.0
SAMPLE_DOCS, SAMPLE_WORDS, PART_EVERY = 2000, 10_000, 4
#: Modules whose names are ordinary identifiers.
NAMED = ["argparse", "builtins", "collections", "datetime", "email.message", "http.client", "http.server", "io", "json", "logging", "os", "pyspark.sql", "pyspark.sql.functions", "pyspark.sql.types", "socket", "subprocess", "threading", "unittest", "urllib.request", "xml.dom.minidom"]
SPANS = "array<struct<s:int,kind:int,e:int>>"
MATCHES = "array<struct<s:int,kind:int,e:int,value:string>>"
#: Values that share one list while lists are built.
BLOCK = 256
MASK = "[SECRET]"


def name_words() -> list[str]:
    """English words of four to twelve characters that names in the standard library and in PySpark are made of, in order."""
    names = set(sys.stdlib_module_names)
    for module in NAMED:
        found = importlib.import_module(module)
        names.update(dir(found), *(dir(x) for x in vars(found).values() if isinstance(x, type)))
    return sorted({w.lower() for name in names for w in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name) if 4 <= len(w) <= 12})


def training_strings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """value, label (1 random, 0 ordinary) from name_words() and at most sample_words different words of sample_docs documents, chosen by a hash.

    Ordinary are words, names made of up to three words in the usual ways, paths,
    dates with hours, numbers and, for one word in PART_EVERY, a part number.
    """
    docs = hash_sample(docs.select("doc_id", text_column().alias("text")), ["doc_id"], sample_docs)
    # Each word with the two that follow it.
    after = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(ws, i + 1), w).alias("b"), F.coalesce(F.get(ws, i + 2), w).alias("c")))
    words = docs.select(F.explode(once(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), after)).alias("x")).select("x.*")
    words = words.groupBy("w").agg(F.min(F.struct("b", "c")).alias("x")).orderBy(F.xxhash64("w"), "w").limit(sample_words).select("w", "x.b", "x.c")
    number = lambda k, n: F.lpad(F.pmod(F.xxhash64("w", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    letters = lambda *ks: F.concat(*(F.char(65 + F.pmod(F.xxhash64("w", F.lit(k)), F.lit(26))) for k in ks))
    w, b, c = (F.lower(x) for x in "wbc")
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("w"), F.lit(20_000)).cast("int")).cast("string")
    part = F.concat(letters(1, 2), number(3, 3), F.lit("-"), letters(4), number(5, 2), letters(6, 7, 8))
    names = [F.col("w"), F.concat(w, F.initcap(b), F.initcap(c)), F.concat(F.lit("/"), w, F.lit("/"), b, F.lit("/"), F.initcap(c), F.lit("-"), number(9, 1))]
    ordinary = [
        *names, F.upper("w"), F.concat_ws("_", w, number(10, 3)), F.concat(w, F.initcap(w), F.lit("-"), w), F.concat_ws("/", w, w),
        F.concat(day, F.lit("T"), number(11, 2)), F.translate(day, "-", ""), number(12, 12), F.when(F.pmod(F.xxhash64("w", F.lit(13)), F.lit(PART_EVERY)) == 0, part),
    ]
    digest = F.sha2("w", 256)
    base64 = F.base64(F.unhex(digest))
    random = [F.substring(digest, 1, 40), base64, F.substring(F.upper(F.regexp_replace(base64, "[+/=]", "")), 1, 20)]
    english = F.split(F.lit(" ".join(name_words())), " ")
    some = lambda k: F.get(english, F.pmod(F.xxhash64("w", F.lit(k)), F.size(english).cast("long")).cast("int"))
    terms = docs.sparkSession.range(1).select(F.explode(english).alias("w")).select("w", some(1).alias("b"), some(2).alias("c"))
    plain = [*names, F.concat(w, F.initcap(b)), F.concat(F.initcap(w), F.initcap(b), F.initcap(c)), F.concat_ws("_", w, b), F.upper(F.concat_ws("_", w, b)), F.concat_ws("-", w, b, number(14, 2))]
    each = lambda rows, of: rows.select(F.explode(F.array(*(F.struct(v.alias("value"), F.lit(label).alias("label")) for label, values in of for v in values))).alias("x"))
    return each(words, ((0, ordinary), (1, random))).unionByName(each(terms, ((0, plain),))).select("x.value", "x.label").where("value IS NOT NULL")


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step from one character to the next: SIDE * SIDE numbers, counts smoothed by 1/2.

    Two decimals each, as the numbers are part of the plan, which the driver keeps as text.
    """
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2))))
    pairs = strings.where(F.length("value") > 1).select("label", pairs.alias("p"))
    pairs = pairs.select("label", at(F.substring("p", 1, 1)).alias("a"), at(F.substring("p", 2, 1)).alias("b")).where("a > 0 and b > 0")
    count = {(r["label"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}  # at most 2 * SIDE * SIDE rows
    total = {(label, a): sum(count.get((label, a, b), 0) + 0.5 for b in range(1, SIDE)) for label in (0, 1) for a in range(1, SIDE)}
    step = lambda label, a, b: math.log((count.get((label, a, b), 0) + 0.5) / total[label, a])
    return [round(step(1, a, b) - step(0, a, b), 2) if a and b else 0.0 for a in range(SIDE) for b in range(SIDE)]


def _ratios(value: Column, steps: list[float], start: dict[str, Column], then: Callable[[Column, Column, Column], dict[str, Column]]) -> Column:
    """Folds then(acc, index of the character, log-likelihood ratio of the step to it) over the characters; acc has `last` as well."""
    ratio = F.from_json(F.lit(json.dumps(steps)), "array<double>")  # a constant: folded once
    pack = lambda fields, last: F.struct(*(v.alias(k) for k, v in fields.items()), last.alias("last"))

    def step(acc: Column, char: Column) -> Column:
        c = F.instr(F.lit(ALPHABET), char)
        # Bound once, so that the constant is once in the fold and not wherever `then` names the ratio.
        return once(F.struct(F.get(ratio, acc["last"] * SIDE + c).alias("ratio"), c.alias("c")), lambda x: pack(then(acc, x["ratio"]), x["c"]))

    return F.aggregate(F.split(value, ""), pack(start, F.lit(0)), step)


def _promising(value: Column, steps: list[float]) -> Column:
    """Whether found_in() has anything in the run: the cheap part of it, for all runs."""
    zero = F.lit(0.0).cast("double")

    def then(acc: Column, x: Column) -> dict[str, Column]:
        more = acc["sum"] + x
        over = acc["over"] + (x - F.lit(MIN_PER_STEP))
        kept = F.when(over < 0, 0.0).otherwise(more)
        return {"sum": kept, "over": F.greatest(over, F.lit(0.0)), "best": F.greatest(acc["best"], kept), "all": acc["all"] + x}

    end = _ratios(value, steps, {"sum": zero, "over": zero, "best": zero, "all": zero}, then)
    return (end["best"] >= MIN_RATIO) | _whole(end["all"], F.length(value))


def _whole(ratio: Column, length: Column) -> Column:
    return (ratio >= MIN_RATIO) & (ratio >= MIN_PER_STEP * (length - 1))


def found_in(value: Column, steps: list[float]) -> Column:
    """Start and end of every random part of a run, each widened to the next "/" on both sides.

    A part begins where the ratio for each step since its beginning would fall
    below MIN_PER_STEP, and ends at its highest ratio; it is closed, and the next
    begins, once it is MIN_RATIO below that. So ordinary text beside a secret
    does not dilute it, and a run can have several. A run without such a part
    is one if it passes as a whole.
    """
    zero, none = F.lit(0.0).cast("double"), F.array().cast("array<struct<s:int,e:int>>")
    closed = lambda acc: F.when(acc["peak"] >= MIN_RATIO, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("s"), acc["end"].alias("e"))))).otherwise(acc["out"])

    def then(acc: Column, x: Column) -> dict[str, Column]:
        more = acc["sum"] + x
        new = (more < MIN_PER_STEP * (acc["i"] - acc["start"])) | (more <= acc["peak"] - MIN_RATIO)
        high = ~new & (more > acc["peak"])
        return {
            "i": acc["i"] + 1,
            "sum": F.when(new, 0.0).otherwise(more),
            "start": F.when(new, acc["i"]).otherwise(acc["start"]),
            "peak": F.when(new, 0.0).when(high, more).otherwise(acc["peak"]),
            "end": F.when(new | high, acc["i"] + 1).otherwise(acc["end"]),
            "out": F.when(new, closed(acc)).otherwise(acc["out"]),
            "all": acc["all"] + x,
        }

    end = _ratios(value, steps, {"i": F.lit(0), "sum": zero, "start": F.lit(0), "peak": zero, "end": F.lit(0), "out": none, "all": zero}, then)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(value).alias("e")))

    def widened(x: Column) -> Column:
        part = F.substring(value, x["s"] + 1, x["e"] - x["s"])
        start = x["s"] + F.length(part) - F.length(F.regexp_replace(part, "^/+", ""))
        end = x["s"] + F.length(F.regexp_replace(part, "/+$", ""))
        before, after = F.substring(value, F.lit(1), start), F.substring(value, end + 1, F.length(value))
        return F.struct(F.length(F.regexp_replace(before, "[^/]*$", "")).alias("s"), (end + F.length(F.regexp_extract(after, "^[^/]*", 0))).alias("e"))

    parts = F.aggregate(F.array(end), none, lambda _, x: F.when(F.size(closed(x)) > 0, closed(x)).when(_whole(x["all"], F.length(value)), whole).otherwise(none))
    return F.array_distinct(F.transform(parts, widened))


def _steps_above(steps: list[float], least: float) -> str:
    """Pattern of a character from which there is a step with a ratio above `least`."""
    after = {a: "".join(re.escape(b) for j, b in enumerate(ALPHABET, 1) if steps[i * SIDE + j] > least) for i, a in enumerate(ALPHABET, 1)}
    return "|".join(f"{re.escape(a)}(?=[{b}])" for a, b in after.items() if b) or "(?!)"


def _possible(value: Column, steps: list[float]) -> Column:
    """False only where the positive ratios of a run cannot add up to MIN_RATIO: it has no step above STRONG and too few above 0."""
    return value.rlike(_steps_above(steps, STRONG)) | (F.regexp_count(value, F.lit(_steps_above(steps, 0.0))) >= math.ceil(MIN_RATIO / STRONG))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) where value is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _block_of(k: Column) -> Column:
    return (k / BLOCK).cast("int")


def _in_blocks(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, then: Callable[[Column], Column] | None = None) -> Column:
    """Folds step(state, x) -> (state, array of what x adds) over an array and concatenates what is added; then(state) comes last.

    Appending to one long list copies it each time. Here each BLOCK of values
    has a list of its own, and the lists are joined once, so the cost follows
    the number of values.
    """
    none = F.array().cast(kind)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), _block_of(F.greatest(F.size(xs) - 1, F.lit(0)))), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
    pack = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return pack(state, F.concat(acc["out"], more))

    def block(acc: Column, xs: Column) -> Column:
        return F.aggregate(xs, pack(acc["state"], none), one, lambda end: pack(end["state"], F.concat(acc["out"], F.array(end["out"]))))

    end = lambda acc: F.flatten(F.concat(acc["out"], F.array(then(acc["state"]))) if then else acc["out"])
    return F.aggregate(once(values, cut), pack(start, F.array().cast(f"array<{kind}>")), block, end)


def _spans(text: Column, pattern: str, kind: int, matches: Column, passes: Column) -> Column:
    """Start, end and text of each match, in characters from 0, of those whose entry in `passes` is true."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), matches.alias("value"), passes.alias("ok"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s, e = at + x["gap"], at + x["gap"] + F.length(x["value"])
        found = F.array(F.struct(s.alias("s"), F.lit(kind).alias("kind"), e.alias("e"), x["value"].alias("value")))
        return e, F.when(x["ok"], found).otherwise(F.array().cast(MATCHES))

    return _in_blocks(parts, F.lit(0), step, MATCHES)


def _long_enough(values: Column, least: int) -> Column:
    return F.transform(values, lambda v: F.length(v) >= least)


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with by(number of characters) in place of each union of overlapping spans; spans are sorted.

    Unions come first. The text is then cut into one part for each BLOCK of
    them, so that finding a place counts characters of a part and not of the whole text.
    """
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    kind = "array<struct<s:int,e:int>>"

    def joined(acc: Column, x: Column) -> tuple[Column, Column]:
        apart = x["s"] >= acc["e"]
        return F.when(apart, pair(x["s"], x["e"])).otherwise(pair(acc["s"], F.greatest(acc["e"], x["e"]))), F.when(apart & (acc["e"] > 0), F.array(acc)).otherwise(F.array().cast(kind))

    last = lambda acc: F.when(acc["e"] > 0, F.array(acc)).otherwise(F.array().cast(kind))
    unions = _in_blocks(spans, pair(F.lit(0), F.lit(0)), joined, kind, last)

    def cut(text: Column, found: Column) -> Column:
        start = lambda b: F.when(b == 0, 0).otherwise(F.get(found, b * BLOCK - 1)["e"])

        def part(b: Column) -> Column:
            some, first = F.slice(found, b * BLOCK + 1, F.lit(BLOCK)), start(b)
            piece = F.substring(text, first + 1, F.get(some, F.size(some) - 1)["e"] - first)
            return once(F.struct(piece.alias("text"), some.alias("some"), first.alias("first")), lambda x: _pieces(x["text"], x["some"], x["first"], by))

        blocks = F.transform(F.sequence(F.lit(0), _block_of(F.size(found) - 1)), part)
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.get(found, F.size(found) - 1)["e"] + 1, F.length(text)))

    return once(F.struct(text.alias("text"), unions.alias("found")), lambda x: F.when(F.size(x["found"]) > 0, cut(x["text"], x["found"])).otherwise(x["text"]))


def _pieces(text: Column, some: Column, first: Column, by: Callable[[Column], Column]) -> Column:
    """A part of a text that begins at `first`, with each of its spans replaced."""

    def piece(x: Column, k: Column) -> Column:
        at = F.when(k == 0, first).otherwise(F.get(some, k - 1)["e"])
        return F.concat(F.substring(text, at - first + 1, x["s"] - at), by(x["e"] - x["s"]))

    return F.array_join(F.transform(some, piece), "")


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of each span, so that what is left of a run stands alone; all else stays where it is."""
    return _replaced(text, spans, lambda n: F.repeat(F.lit(" "), n))


def _random(text: Column, steps: list[float]) -> Column:
    """Spans of all random parts of the runs of a text."""

    good = lambda v: _possible(v, steps) & _promising(v, steps)
    none = F.array().cast(SPANS)

    def each(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
        # Most texts have no such run: their different runs are looked at once.
        return once(runs, lambda r: F.when(F.exists(F.array_distinct(r), good), once(F.struct(r.alias("runs"), F.transform(r, good).alias("good")), lambda x: found(text, x))).otherwise(none))

    def found(text: Column, x: Column) -> Column:
        return F.flatten(F.transform(_spans(text, RUN, len(BASE), x["runs"], x["good"]), parts))

    def parts(x: Column) -> Column:
        return F.transform(found_in(x["value"], steps), lambda y: F.struct((x["s"] + y["s"]).alias("s"), F.lit(len(BASE)).alias("kind"), (x["s"] + y["e"]).alias("e")))

    return once(text, each)


def scanned(docs: DataFrame, steps: list[float]) -> DataFrame:
    """docs with base (spans of the patterns) and spans (those and the models'), arrays of (s, kind, e), sorted; null text counts as empty.

    Both columns take the place of any of that name.
    """
    none = F.array().cast(SPANS)
    text = text_column()
    base = []
    for kind, (name, (pattern, group, least)) in enumerate(BASE.items()):
        # Runs of hexadecimal digits are maximal, and short ones are dropped anyway: match the long ones alone.
        pattern = "[0-9a-f]{32,}" if name == "hex" else pattern
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        passes = _long_enough(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), least)
        spans = F.transform(_spans(text, pattern, kind, matches, passes), lambda x: F.struct(x["s"], x["kind"], x["e"]))
        base.append(F.when(text.rlike(SIEVE[name]), spans).otherwise(none))
    docs = docs.withColumn("base", F.array_sort(F.concat(*base)))
    # Beside patterns' spans both are judged: what they leave of a run, and the run as it stands (a secret may have digits that a pattern takes out of its middle).
    both = F.array(text, F.when(F.size("base") > 0, _blanked(text, F.col("base"))).otherwise(""))
    found = F.flatten(F.transform(both, lambda t: _random(t, steps)))
    every = once(F.array_sort(F.concat(F.col("base"), found)), lambda xs: F.filter(xs, lambda x, k: (k == 0) | (x != F.get(xs, F.greatest(k - 1, F.lit(0))))))
    return docs.withColumn("spans", every)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, [*BASE, "random"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or each union of overlapping ones, replaced by MASK."""
    return _replaced(text, spans, lambda n: F.when(n > 0, MASK).otherwise(""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row.

    Null text counts as empty. Very long texts are read whole, and their cost
    follows their characters and matches. Repeated rows and null doc_id are
    kept, an empty table gives no rows. Spans of one start are listed by kind.
    """
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(training_strings(docs)))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span masked in text and n_chars, where there is one, brought up to date.

    No character of a span stays. Null and empty texts stay as they are, all
    rows and columns are kept, an empty table stays empty.
    """
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("row"), "text")
    inner = scanned(inner, train(training_strings(docs)))
    text = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    docs = inner.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else docs


def op6_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
