"""Mixing documents to target domain weights by soft membership.

A naive Bayes classifier, trained on a labelled table, gives each document the
posterior probability of each domain. Documents then get nonnegative rates such
that the expected tokens of each domain, sum of rate * tokens * posterior,
match the targets in least squares (each domain's error relative to its wanted
tokens or those at rate 1, whichever are more). The rates start at 1 and go by
projected gradient:

    rate <- clip(rate - step * sum_k posterior_k * error_k, 0, max_rate)

A rate so depends on the posteriors alone. Documents are therefore summed by
cell, posteriors rounded to a grid, in one aggregation: the sums of tokens *
posterior of each cell, mergeable and few whatever the number of documents, say
exactly what tokens any rates of the cells give. The steps (accelerated) run on
these sums until the targets are met or no rate that can move would lessen the
squared errors: then the targets cannot be met, and the rates are the
least-squares ones. Which of the two, and the tokens reached, are returned.

Tokens are counted in every whole text. The query and the pipeline count
pieces(), what the tokenizer's own pre-tokenizer cuts a text into, as no Python
may run on this path; a table may have a column of other exact counts (the
digest cache makes one of the tokenizer's ids). token_costs() estimates ids from
a sample's words, for callers that ask for it; neither the query nor the pipeline does.

DataFrame functions only.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, stored, table, text_column

#: Domains of `labels` as (quality, toxic) gives them, and the default shares of tokens that are wanted.
DOMAINS = {"good": 0.90, "toxic": 0.04, "junk": 0.06}
SAMPLE_DOCS, FEATURES, LEAST_DOCS = 4000, 4096, 3
#: Smaller weights count as none: common words would add up to noise in long texts.
LEAST_WEIGHT = 0.5
CALIBRATIONS = 12
SLACK = 1.05
#: Errors, relative to the wanted tokens, within which targets are met; gradient, relative to that at rate 1, at which steps end.
TOLERANCE, FLAT = 1e-3, 1e-8
#: Most cells of the grid of posteriors.
CELLS = 5000
#: What word_bpe_49k.json cuts normal text into: runs of letters, ends of contractions, single numbers, runs of other signs.
PIECE = r"\p{L}++|'(?:[stmd]|re|ve|ll)|\p{N}|[^\p{IsWhite_Space}\p{L}\p{N}]++"
#: Documents whose words the costs of words are taken from, the longest length that is told apart, and the kinds of words: no, one or more SIGNS, a character beyond ASCII or not.
COST_DOCS, LONGEST, KINDS = 500, 32, 6
SIGNS = "#*$%&|<>!?.,;:()[]{}\"'/_-=+@"
#: Posteriors of documents are tempered, as words of one document are not independent.
TEMPER = 0.25


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "junk").when(quality == 1, "good")


def words(text: Column) -> Column:
    """Words of a text: runs between spaces and line feeds."""
    return F.split(F.translate(text, "\n", " "), " ")


def pieces(text: Column) -> Column:
    """How many pieces the tokenizer's pre-tokenizer cuts a text into; characters count as they are written, without composing accents."""
    return F.regexp_count(F.lower(text), F.lit(PIECE)).cast("long")


def features(word: Column) -> dict[str, Column]:
    """The first four characters in lower case and the last two as they are."""
    return {"start": F.lower(F.substring(word, 1, 4)), "end": F.right(word, F.lit(2))}


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[str, float]]:
    """Weights (kind, feature, w0, w1, ...: a number for each domain) of the FEATURES that tell most, and the log prior of each domain.

    labelled has doc_id and domain. At most sample_docs documents train, chosen by a hash; both results are small.
    """
    # Of several labels of a document that of the domain listed last counts.
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place")).where("place > 0").groupBy("doc_id").agg(F.max("place").alias("place"))
    labelled = labelled.select("doc_id", F.get(F.array(*map(F.lit, domains)), (F.col("place") - 1).cast("int")).alias("domain"))
    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))  # bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(chosen, "doc_id").select("doc_id", "domain", F.explode(words(F.col("text"))).alias("word"))
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), f.alias("feature")) for kind, f in features(F.col("word")).items()))
    seen = texts.where("word <> ''").select("doc_id", "domain", F.explode(found).alias("f")).select("doc_id", "domain", "f.*").distinct()
    n = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = seen.groupBy("kind", "feature").agg(F.count("*").alias("all"), *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains))).where(F.col("all") >= LEAST_DOCS)
    # Log of the share of a domain's documents that have the feature, less that over all documents.
    total = sum(n.values())
    rate = [F.log((F.col(f"n{k}") + 0.1) / (n.get(d, 0) + 0.2)) - F.log((F.col("all") + 0.1) / (total + 0.2)) for k, d in enumerate(domains)]
    counts = counts.select("kind", "feature", *(F.when(F.abs(r) >= LEAST_WEIGHT, r).otherwise(F.lit(0.0)).alias(f"w{k}") for k, r in enumerate(rate)), F.greatest(*rate).alias("most"), "all")
    top = counts.orderBy((F.col("most") * F.sqrt("all")).desc(), "kind", "feature").limit(FEATURES).drop("most", "all")
    top = stored(top, "mixing-features")
    prior = {d: math.log((n.get(d, 0) + 1) / (total + len(domains))) for d in domains}
    # The words of a text are not independent: shift the priors until the sample's posteriors add up to its labels.
    # At most sample_docs rows, a number for each domain.
    sample = scores(docs.join(chosen, "doc_id").select("doc_id", "text"), ["doc_id"], top, len(domains)).select("s").collect() if total else []
    s, log = np.array([r["s"] for r in sample], float).reshape(len(sample), len(domains)), np.array(list(prior.values()))
    # A domain without labelled documents keeps its prior.
    known = np.array([bool(n.get(d)) for d in domains])
    share = np.array([n.get(d, 0) / max(total, 1) for d in domains])
    for _ in range(CALIBRATIONS if sample else 0):
        p = np.exp(s + log - (s + log).max(axis=1, keepdims=True))
        have = np.maximum((p / p.sum(axis=1, keepdims=True)).mean(axis=0), 1e-9)
        log = np.where(known, log + np.log(np.where(known, share, 1.0) / have), log)
    prior = {d: float(v) for d, v in zip(domains, log, strict=True)}
    return top, prior


def cost_index(word: Column) -> Column:
    """The place of a word in the costs: its length, up to LONGEST, and its kind."""
    signs = F.least(F.length(word) - F.length(F.translate(word, SIGNS, "")), F.lit(2))
    return F.least(F.length(word), F.lit(LONGEST)) * KINDS + 2 * signs + (F.octet_length(word) > F.length(word)).cast("int")


def token_costs(docs: DataFrame, tokenizer: str, sample_docs: int = COST_DOCS) -> list[float]:
    """Tokens for each cost_index of a word, by the words of sample_docs documents chosen by a hash, each as often as it comes.

    A place that the sample lacks costs what that many characters cost on average.
    """
    from tokenizers import Tokenizer

    texts = hash_sample(docs.select("doc_id", text_column().alias("text")), ["doc_id"], sample_docs)
    found = texts.select(F.explode(words(F.col("text"))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"), F.first(cost_index(F.col("w"))).alias("at")).collect()
    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    # One word after the other: a batch has threads, whose memory the driver keeps.
    size = np.array([len(library.encode(" " + r["w"], add_special_tokens=False).ids) for r in found], float)
    at, n = np.array([r["at"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    count, total = (np.bincount(at, weights=v, minlength=(LONGEST + 1) * KINDS) for v in (n, n * size))
    length = np.maximum(np.arange(len(count)) // KINDS, 1)
    each = total.sum() / max(1.0, (count * length).sum()) or 1.0
    return [float(v) for v in np.where(count > 0, total / np.maximum(count, 1), np.maximum(1.0, each * length))]


def _column(tokens: str | Column) -> Column:
    return F.col(tokens) if isinstance(tokens, str) else tokens


def scores(docs: DataFrame, keys: list[str], weights: DataFrame, n_domains: int, costs: list[float] | None = None, tokens: str | Column | None = None) -> DataFrame:
    """keys (which tell rows apart), n_tokens and s: array with the tempered sum of weights for each domain.

    n_tokens is `tokens` (a column or its name), or the rounded sum of the words' costs, or else the number of words.
    Weights of the words of a document add up where it lies; one partial sum for each document crosses the shuffle.
    """
    names = [f"w{k}" for k in range(n_domains)]
    own = [] if tokens is None else [_column(tokens).cast("long").alias("own_tokens")]
    # In a step of its own: beside the explode `tokens` would be counted anew for each word of a text.
    each = docs.select(*keys, *own, text_column().alias("text")).select(*keys, *(["own_tokens"] if own else []), F.explode_outer(words(F.col("text"))).alias("word"))
    each = each.select(*keys, *(["own_tokens"] if own else []), "word", *(f.alias(kind) for kind, f in features(F.col("word")).items()))
    kinds = list(features(F.lit("")))
    for kind in kinds:  # at most FEATURES rows
        each = each.join(F.broadcast(weights.where(F.col("kind") == kind).select(F.col("feature").alias(kind), *(F.col(w).alias(f"{kind}_{w}") for w in names))), kind, "left")
    total = lambda w: F.sum(sum((F.coalesce(F.col(f"{kind}_{w}"), F.lit(0.0)) for kind in kinds), F.lit(0.0))) * TEMPER
    there = F.col("word") != ""
    if own:
        n = F.coalesce(F.max("own_tokens"), F.lit(0))
    elif costs:
        n = F.round(F.coalesce(F.sum(F.when(there, F.get(F.from_json(F.lit(str(costs)), "array<double>"), cost_index(F.col("word"))))), F.lit(0.0)))
    else:
        n = F.count_if(there)
    return each.groupBy(*keys).agg(n.cast("long").alias("n_tokens"), F.array(*map(total, names)).alias("s"))


def posterior(s: Column, prior: dict[str, float]) -> Column:
    log = [s[k] + F.lit(float(v)) for k, v in enumerate(prior.values())]
    most = F.greatest(*log) if len(log) > 1 else log[0]
    weight = [F.exp(x - most) for x in log]
    return F.array(*(w / sum(weight[1:], weight[0]) for w in weight))


def grid(n_domains: int) -> int:
    """Steps between posteriors 0 and 1 so that cells, ways to divide the steps among the domains, are at most about CELLS."""
    steps = 1
    while math.comb(steps + n_domains, n_domains - 1) <= CELLS:
        steps += 1
    return steps


def cell(p: Column, n_domains: int) -> Column:
    """The posteriors in steps of the grid, as text."""
    return F.array_join(F.transform(p, lambda v: F.round(v * grid(n_domains)).cast("int").cast("string")), ",")


@dataclass
class Solution:
    """The rate of each cell; wanted and reached tokens of each domain; whether all are met within TOLERANCE."""

    rates: dict[str, float]
    tokens: dict[str, tuple[float, float]]
    met: bool


def project(sums: np.ndarray, tokens: np.ndarray, wanted: np.ndarray, scale: np.ndarray, most: float) -> np.ndarray:
    """Rates r within 0 and `most` with the least sum of ((sum_c r_c sums[c, k] - wanted_k) / scale_k) ** 2, by accelerated projected gradient from 1.

    The step of a cell is by its mean posteriors, as for each of its documents.
    """
    p = sums / np.maximum(tokens, 1e-300)[:, None]
    curve = (sums / scale).T @ (p / scale)
    step = 1 / max(float(np.linalg.eigvals(curve).real.max()), 1e-300)
    rate = ahead = np.minimum(np.ones(len(tokens)), most)
    slope = lambda r: p @ (((r @ sums - wanted) / scale) / scale)
    error = lambda r: float((((r @ sums - wanted) / scale) ** 2).sum())
    moves = lambda r: float((tokens * np.abs(np.clip(r - slope(r), 0, most) - r)).sum())
    start, now, t = max(moves(rate), 1e-300), error(rate), 1.0
    while np.abs((rate @ sums - wanted) / scale).max() > TOLERANCE / 10 and moves(rate) > FLAT * start:
        new = np.clip(ahead - step * slope(ahead), 0, most)
        if (then := error(new)) > now and t > 1:  # too far: once more from here, without the run-up
            ahead, t = rate, 1.0
            continue
        if then >= now * (1 - 1e-13):  # as low as the numbers can tell
            return new if then < now else rate
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, rate, now = new + (old - 1) / t * (new - rate), new, then
    return rate


def solve(members: DataFrame, targets: dict[str, float], max_rate: float | None = None, budget: float | None = None) -> Solution:
    """Least-squares rates for members (n_tokens, p).

    `budget` is the wanted sum of tokens: by default all tokens there are or,
    with max_rate, as many as keep the domain with the largest share whole, and
    a little more (SLACK), so that its rates stay at max_rate; scarcer domains get what they have.
    """
    k = range(len(targets))
    found = members.groupBy(cell(F.col("p"), len(targets)).alias("cell")).agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col("p")[j]).alias(f"s{j}") for j in k)).orderBy("cell").collect()
    tokens = np.array([r["n"] for r in found], float)
    sums = np.array([[r[f"s{j}"] for j in k] for r in found], float).reshape(-1, len(targets))
    base, total = sums.sum(axis=0), sum(targets.values())
    share = np.array([v / total for v in targets.values()])
    if budget is None:
        main = int(share.argmax())
        budget = base.sum() if max_rate is None else SLACK * max_rate * base[main] / share[main]
    wanted = share * budget
    scale = np.maximum(np.maximum(base, wanted), 1.0)
    rates = project(sums, tokens, wanted, scale, np.inf if max_rate is None else max_rate)
    reached = rates @ sums
    met = bool((np.abs(reached - wanted) <= TOLERANCE * scale).all())
    return Solution({r["cell"]: float(v) for r, v in zip(found, rates, strict=True)}, {d: (float(w), float(n)) for d, w, n in zip(targets, wanted, reached, strict=True)}, met)


def rated(docs: DataFrame, keys: list[str], labelled: DataFrame, targets: dict[str, float], max_rate: float | None = None, costs: list[float] | None = None, tokens: str | Column | None = None) -> tuple[DataFrame, Solution]:
    """keys, n_tokens, p and rate for each row of docs (the keys tell rows apart), and what became of the targets.

    Null text counts as empty: no tokens, the priors as posteriors; very long
    texts are read whole. Without labels the posteriors are the same for all.
    Documents of a cell have one rate. An empty table gives
    no rows. Targets that the rates cannot meet are logged as a warning as well.
    """
    weights, prior = fit(docs, labelled, list(targets))
    members = scores(docs, keys, weights, len(prior), costs, tokens).withColumn("p", posterior(F.col("s"), prior)).drop("s")
    members = stored(members, "mixing-members")
    found = solve(members.select("n_tokens", "p"), targets, max_rate)
    if not found.met:
        said = ", ".join(f"{d}: {n:.0f} of {w:.0f}" for d, (w, n) in found.tokens.items())
        logging.getLogger(__name__).warning("mixing: the rates nearest to the targets give these of the wanted tokens: %s", said)
    # At most CELLS rows.
    rates = F.broadcast(docs.sparkSession.createDataFrame(list(found.rates.items()), "cell string, rate double"))
    members = members.withColumn("cell", cell(F.col("p"), len(prior))).join(rates, "cell", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    return members.drop("cell"), found


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_rate: float | None = None, seed: int = 11, costs: list[float] | None = None, tokens: str | Column | None = None) -> DataFrame:
    """The rows of docs, all columns, each floor(rate) times and once more with the chance of what is left of its rate, by a hash.

    With max_rate 1 no row comes twice. Null and empty texts have the rate of
    their priors; rows that are alike in doc_id and text are drawn alike; an empty table stays empty.
    """
    # The draw hangs on what a row says, not on where it lies, so another partitioning draws the same.
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    own = [] if tokens is None else [_column(tokens).alias("own_count")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", *own, F.monotonically_increasing_id().alias("uid"), draw.alias("draw"))
    rows = stored(rows, "mixing-rows")
    copies = rated(rows, ["uid", "draw"], labelled, targets, max_rate, costs, "own_count" if own else None)[0].select("uid", F.floor(F.col("rate") + F.col("draw")).cast("int").alias("copies"))
    out = rows.select("uid", "row").join(copies.where("copies > 0").hint("merge"), "uid")
    if max_rate is None or max_rate > 1:
        out = out.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row"))
    return out.select("row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op2_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (pieces of the whole text), the posterior of each domain and the rate; met: whether the rates meet the targets; reached_*: the share of the wanted tokens that a domain gets."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    rows, found = rated(docs, ["uid", "doc_id"], label_domains(table(spark, sf_dir, "labels")), DOMAINS, tokens=pieces(text_column()))
    reached = [F.lit(n / w if w else 1.0).alias(f"reached_{d}") for d, (w, n) in found.tokens.items()]
    return rows.select("doc_id", "n_tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", F.lit(found.met).alias("met"), *reached)
