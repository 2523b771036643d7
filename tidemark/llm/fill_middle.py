"""Fill-in-the-middle examples: whole texts, cut where tokens end.

A token is a run of other characters with the white space before it, or the
white space at a text's end. The characters of a slice of texts are put into
four classes (does one stand in a word or a gap, and is it the first there),
and a wavelet matrix over the classes answers for all texts of the slice at
once: ranks count the gaps that begin inside a text, so also its tokens, and
select gives the place of the k-th gap, where the k-th token ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Classes of characters: bit 1 is set in white space, bit 0 if white space or nothing comes before.
INNER, WORD_START, GAP_START, GAP_INNER = range(4)


class _Bits:
    """Packed bits with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.n, self.total = len(bits), int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def place(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Where the k-th (from 1) bit of this kind is, by bisection on ranks."""
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        while np.any(low < high):
            half = (low + high) >> 1
            ones = self.ones(half + 1)
            reached = (ones if bit else half + 1 - ones) >= k
            low, high = np.where(reached, low, np.minimum(half + 1, high)), np.where(reached, half, high)
        return low


class WaveletMatrix:
    """Ranks and places of the symbols in a sequence of small integers; arguments are arrays.

    Level by level, from the highest bit, the sequence is parted, in order,
    into symbols with a 0 and with a 1 there. A level keeps the bits.
    """

    def __init__(self, symbols: np.ndarray, bits: int = 2) -> None:
        self.n, self.levels = len(symbols), []
        for shift in reversed(range(bits)):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bit), self.n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first i."""
        low, high = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            if symbol >> shift & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 1) occurrence, which must exist."""
        at = np.zeros_like(k)
        for shift, bits, zeros in self.levels:
            at = zeros + bits.ones(at) if symbol >> shift & 1 else at - bits.ones(at)
        at = at + k - 1
        for shift, bits, zeros in reversed(self.levels):
            at = bits.place(1, at - zeros + 1) if symbol >> shift & 1 else bits.place(0, at + 1)
        return at


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character of all texts, and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    space = (points == 32) | ((points >= 9) & (points <= 13))
    before = np.concatenate([[True], space[:-1]]) if len(space) else space
    starts = np.concatenate([[0], ends[:-1]])
    before[starts[starts < len(space)]] = True
    return (2 * space + before).astype(np.uint8), ends


def cuts(texts: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and two places in it (characters): the ends of draw % (tokens + 1) tokens, for two draws, in order."""
    symbols, ends = classes(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    matrix = WaveletMatrix(symbols)
    first = matrix.rank(GAP_START, starts)
    gaps = matrix.rank(GAP_START, ends) - first
    tokens = np.where(ends > starts, gaps + 1, 0)
    k = np.sort(draws % (tokens + 1)[:, None], axis=1)
    places = np.where(k == 0, starts[:, None], ends[:, None])
    inside = (k > 0) & (k <= gaps[:, None])
    places[inside] = matrix.select(GAP_START, (first[:, None] + k)[inside])
    return tokens, places - starts[:, None]


def fill_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of each document (doc_id, text).

    Four numbers from a hash of seed and doc_id draw both cuts, whether a text
    is rearranged, and how: psm is prefix, suffix, middle, spm suffix, prefix,
    middle, each behind its mark. Plain texts stay as they are, and have no
    cuts: texts not drawn, empty ones, and those with a mark in them.

    A null text is empty, a null doc_id an empty number. Repeated rows each give
    their row; texts are cut whole; other columns are not used; an empty table gives no rows.
    """

    def work():  # noqa: ANN202
        p, s, m = marks

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
            draws = np.array([[int(h[at : at + 8], 16) for at in (0, 8, 16, 24)] for h in hashes], np.int64).reshape(-1, 4)
            tokens, places = cuts(texts, draws[:, :2])
            forms, sizes, out = [], [], []
            for text, (a, b), drawn, order in zip(texts, places.tolist(), (draws[:, 2] % 100).tolist(), (draws[:, 3] % 100).tolist(), strict=True):
                if drawn >= percent or not text or any(x in text for x in marks):
                    forms.append("plain")
                    sizes.append((None, None))
                    out.append(text)
                    continue
                spm = order < spm_percent
                forms.append("spm" if spm else "psm")
                sizes.append((a, b - a))
                head = f"{s}{text[b:]}{p}{text[:a]}" if spm else f"{p}{text[:a]}{s}{text[b:]}"
                out.append(f"{head}{m}{text[a:b]}")
            columns = [batch.column("doc_id"), tokens, forms, [x for x, _ in sizes], [x for _, x in sizes], out]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: its parts, found by the marks, in the order of the text."""
    part = F.split(output, "|".join(f"\\Q{x}\\E" for x in marks))
    of = lambda *at: F.concat(*(F.get(part, F.lit(k)) for k in at))
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def op13_wavelet_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
