"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are the vector of its hashed form and the mean of the vectors
of all its character n-grams, hashed. The network reads windows of LENGTH words
that overlap; every window of a document is scored and the highest decides.

Labels are by document, so training first finds which windows of a toxic
document can bear its label: it weighs words and n-grams by their log odds over
the documents of either class (which also starts their vectors), and takes the
windows that weigh more than nearly all windows of clean documents. It sees
every window of its documents. A part of them (one in CALIBRATE) does not train
but sets the scale of scores, by the highest of all windows, as scoring does;
classes count there as often as they come among all labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_column
from .labelled import class_sizes, fold, labelled_sample
from .tokens import ranges

LENGTH, STRIDE = 32, 24
PER_CLASS, CALIBRATE = 1000, 4
BUCKETS, WIDTH, HIDDEN = 1 << 16, 6, 8
#: Lengths of character n-grams, and how much their mean log odds weigh beside those of the word.
GRAMS, GRAM_WEIGHT = (3, 4, 5), 5
#: n-grams that are held at once.
AT_ONCE = 500_000
EPOCHS, BATCH, RATE = 5, 256, 0.01
#: Distinct words a worker remembers; beyond this it starts anew.
MEMO_WORDS = 300_000
TRIM = ".,;:!?\"'()[]{}<>|*#$%&-_"
PAD = ""


def plain(word: str) -> str:
    return word.lower().strip(TRIM)


def grams(word: str) -> Iterator[int]:
    """Buckets of all n-grams of ^word$, each as often as it comes."""
    text = f"^{word}$".encode("utf-32-le")  # four bytes a character
    for n in GRAMS:
        for at in range(0, max(1, len(text) - 4 * n + 1), 4):
            yield zlib.crc32(text[at : at + 4 * n]) % BUCKETS


class Words:
    """Buckets of words: `word` of each, and their n-grams one after another from `start`, `count` of each."""

    def __init__(self, words: list[str]) -> None:
        words = list(map(plain, words))
        self.word = np.fromiter((zlib.crc32(f"w{w}".encode()) % BUCKETS for w in words), np.int64, len(words))
        self.count = np.array([sum(max(1, len(w) + 3 - n) for n in GRAMS) for w in words], np.int64)
        self.flat = np.fromiter((g for w in words for g in grams(w)), np.uint16, int(self.count.sum()))
        self.start = np.cumsum(self.count) - self.count


def parts(words: list[str]) -> Iterator[tuple[int, Words]]:
    """Words of runs of the list with about AT_ONCE n-grams or one word each, and where the run begins."""
    sizes = np.cumsum([3 * len(w) + 6 for w in words])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE)))
        yield at, Words(words[at:end])
        at = end


def starts(n_words: int) -> list[int]:
    """First words of the windows: every STRIDE words, the last window ends with the text."""
    return [*range(0, max(1, n_words - LENGTH), STRIDE), *([n_words - LENGTH] if n_words > LENGTH else [])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0] / 8)).astype(np.float32)
        d, h = 2 * WIDTH, HIDDEN
        self.p = {"word": make(BUCKETS, WIDTH) * 10, "piece": make(BUCKETS, WIDTH) * 10, "att": make(2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": make(h), "out": make(2 * h), "out_b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": make(d, 3 * h), f"b{way}": np.zeros(3 * h, np.float32), f"h{way}": make(h, 3 * h)}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, words: Words, some: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of words, or of some of them by number."""
        start, count = (words.start, words.count) if some is None else (words.start[some], words.count[some])
        flat = words.flat if some is None else words.flat[ranges(start, count)]
        word = words.word if some is None else words.word[some]
        if not len(word):
            return np.zeros((0, 2 * WIDTH), self.p["word"].dtype)
        mean = np.add.reduceat(self.p["piece"][flat], np.cumsum(count) - count) / count[:, None].astype(self.p["piece"].dtype)
        return np.concatenate([self.p["word"][word], mean], axis=-1)

    def gates(self, words: list[str]) -> np.ndarray:
        """What the gates of both ways get from each word."""
        found = [self.project(self.embed(w)) for _, w in parts(words)]
        return np.concatenate(found).astype(np.float32) if found else np.zeros((0, 6 * HIDDEN), np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both ways get from input vectors: (..., 6 * HIDDEN)."""
        return np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]], axis=-1)

    def _read(self, g: np.ndarray, way: str, keep: list | None) -> list[np.ndarray]:
        h, u, out = np.zeros((len(g), HIDDEN), g.dtype), self.p[f"h{way}"], [None] * LENGTH
        for t in range(LENGTH) if way == "f" else range(LENGTH - 1, -1, -1):
            x = g[:, t, : 3 * HIDDEN] if way == "f" else g[:, t, 3 * HIDDEN :]
            a = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r, c = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * c)
            if keep is not None:
                keep.append((t, h, z, r, n, c))
            h = n + z * (h - n)
            out[t] = h
        return out

    def forward(self, g: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (windows, LENGTH, 6 * HIDDEN)."""
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([np.stack(self._read(g, w, kept[w]), axis=1) for w in "fb"], axis=2)
        u = np.tanh(h @ self.p["att"] + self.p["att_b"])
        e = u @ self.p["att_v"]
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        s = np.einsum("bt,bth->bh", a, h)
        if keep is not None:
            keep |= {"h": h, "u": u, "a": a, "s": s, **kept}
        return s @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, words: Words, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows (numbers of words) with their labels."""
        used, inverse = np.unique(windows, return_inverse=True)
        inverse = inverse.ravel()
        x, k = self.embed(words, used)[inverse].reshape(*windows.shape, 2 * WIDTH), {}
        logit = self.forward(self.project(x), k)
        d = (_sigmoid(logit) - labels).astype(x.dtype) / len(labels)
        p, g = self.p, {"out": k["s"].T @ d, "out_b": d.sum(keepdims=True)}
        ds = d[:, None] * p["out"]
        da = np.einsum("bth,bh->bt", k["h"], ds)
        de = k["a"] * (da - (k["a"] * da).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("bth,bt->h", k["u"], de)
        du = de[:, :, None] * p["att_v"] * (1 - k["u"] ** 2)
        g["att"], g["att_b"] = np.einsum("bti,btj->ij", k["h"], du), du.sum(axis=(0, 1))
        dh_all = k["a"][:, :, None] * ds[:, None, :] + du @ p["att"].T
        dx = np.zeros_like(x)
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dh, gu, dg = p[f"h{way}"], 0.0, np.zeros_like(p[f"h{way}"]), np.zeros((*x.shape[:2], 3 * HIDDEN), x.dtype)
            for t, h, z, r, n, c in reversed(k[way]):
                dh = dh + dh_all[:, t, part]
                dn = dh * (1 - z) * (1 - n * n)
                da = np.concatenate([dh * (h - n) * z * (1 - z), dn * c * r * (1 - r), dn * r], axis=1)
                dg[:, t] = np.concatenate([da[:, : 2 * HIDDEN], dn], axis=1)
                gu += h.T @ da
                dh = dh * z + da @ u.T
            g[f"h{way}"], g[f"b{way}"], g[f"x{way}"] = gu, dg.sum(axis=(0, 1)), np.einsum("btd,btg->dg", x, dg)
            dx += dg @ p[f"x{way}"].T
        dx = dx.reshape(-1, 2 * WIDTH)
        each = np.stack([np.bincount(inverse, weights=dx[:, j], minlength=len(used)) for j in range(2 * WIDTH)], axis=1)
        count = words.count[used]
        flat = words.flat[ranges(words.start[used], count)]
        spread = np.repeat(each[:, WIDTH:] / count[:, None], count, axis=0)
        add = lambda at, v, to: np.stack([np.bincount(at, weights=v[:, j], minlength=BUCKETS) for j in range(WIDTH)], axis=1).astype(to.dtype)
        g["word"], g["piece"] = add(words.word[used], each[:, :WIDTH], p["word"]), add(flat, spread, p["piece"])
        return g

    def fit(self, words: Words, windows: np.ndarray, owners: np.ndarray, labels: np.ndarray, sizes: np.ndarray | None = None, seed: int = 7) -> Network:
        """windows: numbers of words (n, LENGTH); owners: the document of each, ascending; labels: of each document; sizes: how often each label comes in all."""
        aside = np.arange(len(labels)) % CALIBRATE == CALIBRATE - 1
        if set(labels[aside]) != {0, 1} or set(labels[~aside]) != {0, 1}:
            aside = np.zeros(len(labels), bool)  # too few documents to set some aside
        y = np.where(aside[owners], -1, labels[owners])
        score = self._odds(words, windows, owners, np.where(aside, -1, labels))
        weigh = np.concatenate([score[windows[at : at + 65536]].max(axis=1) for at in range(0, len(windows), 65536)])
        bar = np.quantile(weigh[y == 0], 0.995)
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, owners, weigh)
        bears = (y == 1) & ((weigh > bar) | (weigh == best[owners]))
        r = np.random.default_rng(seed)
        positive, negative = np.flatnonzero(bears), np.flatnonzero(y == 0)

        def logits(some: np.ndarray) -> np.ndarray:
            n = len(words.word)
            gates = np.concatenate([self.project(self.embed(words, np.arange(at, min(at + 16384, n)))) for at in range(0, n, 16384)])
            return np.concatenate([self.forward(gates[windows[some[at : at + 4096]]]) for at in range(0, len(some), 4096)])

        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            some = r.permutation(negative)[: 3 * len(positive)]
            if epoch:  # half of them the clean windows that look worst so far
                worst = negative[np.argsort(-logits(negative), kind="stable")[: len(some) // 2]]
                some = np.concatenate([worst, some[: len(some) - len(worst)]])
            use, target = np.concatenate([positive, some]), np.concatenate([np.ones(len(positive)), np.zeros(len(some))])
            order = r.permutation(len(use))
            for at in range(0, len(order), BATCH):
                some, step = order[at : at + BATCH], step + 1
                for k, g in self.gradients(words, windows[use[some]], target[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, owners, logits(np.arange(len(windows))))
        # Platt scaling of the highest logit of the documents set aside, weighted to the classes' shares of all labels.
        if aside.any():
            top, labels = top[aside], labels[aside]
        n = np.bincount(labels, minlength=2)
        weight = (n if sizes is None else sizes / sizes.sum() * n.sum())[labels] / n[labels]
        x, w = np.stack([top, np.ones(len(top))], axis=1), np.array([1.0, 0.0])
        loss = lambda w: (weight * (np.logaddexp(0, x @ w) - labels * (x @ w))).sum() + 0.5 * ((w - [1, 0]) ** 2).sum()
        for _ in range(50):
            q = _sigmoid(x @ w)
            step = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + np.eye(2), x.T @ (weight * (q - labels)) + (w - [1, 0]))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        self.scale, self.shift = map(float, w)
        return self

    def _odds(self, words: Words, windows: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Starts the first number of each vector with the log odds over documents; the weight of each word."""
        count = {name: np.zeros((2, BUCKETS)) for name in ("word", "piece")}
        edges = np.searchsorted(owners, np.arange(0, len(labels) + 200, 200))
        for a, z in zip(edges, edges[1:], strict=False):  # blocks of 200 documents
            n = len(words.word)
            pairs = np.unique(np.repeat(owners[a:z], LENGTH) * n + windows[a:z].ravel())
            doc, word = pairs // n, pairs % n
            for name, d, at in (("word", doc, words.word[word]), ("piece", np.repeat(doc, words.count[word]), words.flat[ranges(words.start[word], words.count[word])])):
                seen = np.unique(d * BUCKETS + at)
                for k in (0, 1):
                    count[name][k] += np.bincount(seen[labels[seen // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
        n_docs = [(labels == k).sum() for k in (0, 1)]
        for name, c in count.items():
            rate = [np.log((c[k] + 0.5) / (n_docs[k] + 1)) for k in (0, 1)]
            self.p[name][:, 0] = np.where(c.sum(axis=0) >= 3, np.clip(rate[1] - rate[0], -4, 4), 0)
        mean = np.add.reduceat(self.p["piece"][words.flat, 0], words.start) / words.count
        return self.p["word"][words.word, 0] + GRAM_WEIGHT * mean


class Scorer:
    """Scores whole texts; remembers what the gates get from each distinct word."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.reset()

    def reset(self) -> None:
        scorer = self

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                scorer.new.append(word)
                n = self[word] = len(self)
                return n

        self.memo, self.new, self.gates = Memo(), [], np.zeros((1024, 6 * HIDDEN), np.float32)
        self.pad = self.memo[PAD]

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.reset()
        rows, owners = [], []
        get = self.memo.__getitem__
        for k, text in enumerate(texts):
            words = text.split()
            ids = np.fromiter(map(get, words), np.int32, len(words))
            if len(ids) < LENGTH:
                ids = np.append(ids, np.full(LENGTH - len(ids), self.pad, np.int32))
            first = starts(len(words))
            rows.append(ids[np.array(first)[:, None] + np.arange(LENGTH)])
            owners += [k] * len(first)
        if self.new:
            known, self.new = self.new, []
            if len(self.memo) > len(self.gates):  # room for twice as many
                self.gates = np.concatenate([self.gates, np.zeros((2 * len(self.memo) - len(self.gates), 6 * HIDDEN), np.float32)])
            self.gates[len(self.memo) - len(known) : len(self.memo)] = self.network.gates(known)
        windows, top = np.concatenate(rows), np.full(len(texts), -np.inf)
        for at in range(0, len(windows), 4096):
            np.maximum.at(top, owners[at : at + 4096], self.network.forward(self.gates[windows[at : at + 4096]]))
        return _sigmoid(top * self.network.scale + self.network.shift)


def windows_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the numbers of the words of every window, and the text of each window."""
    number: dict[str, int] = {PAD: 0}
    rows, owners = [], []
    for k, text in enumerate(texts):
        words = text.split()
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        first = starts(len(words))
        ids = np.append(ids, np.zeros(max(0, LENGTH - len(ids)), np.int32))
        rows.append(ids[np.array(first)[:, None] + np.arange(LENGTH)])
        owners.append(np.full(len(first), k))
    return list(number), np.concatenate(rows), np.concatenate(owners)


def train(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Network | None:
    """Fits on the whole texts of at most per_class documents of each class, which the driver holds; None if a class has none."""
    rows = labelled_sample(docs, labels, label, per_class).toPandas().sort_values("doc_id", kind="stable")
    if set(rows.label) != {0, 1}:
        return None
    words, windows, owners = windows_of(rows.text.to_list())
    return Network().fit(Words(words), windows, owners, rows.label.to_numpy(), class_sizes(labels, label))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have a score as well; very long texts are scored
    whole. Rows with null doc_id are scored and not held out; repeated rows are
    all scored. Without labels of both classes every score is 0; an empty table
    gives no rows.
    """
    network = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(network.value) if network.value else None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(texts) if scorer else np.zeros(len(texts)), pa.float64())], ["doc_id", "score"])

        return each

    rows = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")), work, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
