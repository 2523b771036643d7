"""Importance resampling, contamination and fill-in-the-middle against plain forms, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import contamination, fill_middle, importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, n long, segment string, score double"
LONG = " ".join(f"w{k % 977} Ünï{k % 53}-x" for k in range(40_000))
ODD = [None, "", " ", "\n\t ", "a", " a ", "a  b\tc\n", "É日本 x y  z", "tab<P>mark here", "x" * 50_000, " " * 3000 + "end", LONG, "same text twice", "same text twice", "nul\x00byte A9z"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, 1, "x", 0.5) for k, t in enumerate(ODD)] + [(None, "no number here", 2, "y", 0.1), (3, "repeated number", 3, None, None), (3, "repeated number", 3, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


# Fill in the middle.
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(symbols, symbol):
    seq = np.array(symbols, np.uint8)
    matrix = fill_middle.WaveletMatrix(seq)
    i = np.arange(len(seq) + 1)
    assert matrix.rank(symbol, i).tolist() == [symbols[:k].count(symbol) for k in i]
    at = [k for k, s in enumerate(symbols) if s == symbol]
    assert matrix.select(symbol, np.arange(1, len(at) + 1)).tolist() == at


def slow_fim(doc_id, text, seed=42):
    text = text or ""
    parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    pre, mid, suf = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(parts), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(parts), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(parts), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_odd_rows(odd):
    rows, df = odd
    made = fill_middle.fill_middle(df)
    got = made.withColumn("back", fill_middle.restored(made["form"], made["output"])).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((slow_fim(r[0], r[1]) for r in rows), key=repr)
    assert sorted(r["back"] for r in got) == sorted(r[1] or "" for r in rows)


def test_fill_middle_all_forms(spark):
    """Over many seeds' worth of numbers every form occurs, with cuts at both ends of texts."""
    rows = [(k, " ".join("ab cd\n e".split(" ")[: k % 4]) + " " * (k % 3)) for k in range(400)]
    got = [tuple(r) for r in fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted((slow_fim(*r) for r in rows))
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_marks_are_plain_text_to_the_pattern(spark):
    marks = ("[.*", "(+", "\\d")
    df = spark.createDataFrame([(k, f"one two three {k}") for k in range(60)], "doc_id long, text string")
    made = fill_middle.fill_middle(df, percent=100, marks=marks)
    back = made.select("doc_id", fill_middle.restored(made["form"], made["output"], marks).alias("t"), "form").collect()
    assert {(r[0], r[1]) for r in back} == {(k, f"one two three {k}") for k in range(60)} and "plain" not in {r[2] for r in back}


# Importance resampling.
def slow_resample(rows, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    def features(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, most + 1) for k in range(len(w) - n + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return [(r[0], r[2], r[3], r[4], ranks[r].pop(0) if ranks.get(r) else None) for r in out]


@pytest.mark.parametrize(("most", "percent", "buckets"), [(1, 10, 10_000), (2, 60, 70_000), (3, 100, 97)])
def test_resample(spark, odd, most, percent, buckets):
    rows, _ = odd
    pick = random.Random(5)
    rows = [(r[0], r[1]) for r in rows] + [(100 + k, " ".join(pick.choices(["oil", "Gold", "fed", "été", "日本", "x9"], k=pick.randint(0, 60)))) for k in range(120)]
    target = ["oil gold. OIL", None, "", "日本 fed"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, most, buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(slow_resample(rows, target, percent, 20, most, buckets), key=repr)


def test_resample_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    rows, df = odd
    assert sorted(map(tuple, importance.resample(df, none).collect()), key=repr) == sorted(slow_resample([r[:2] for r in rows], []), key=repr)


def test_words_with_offsets_of_long_texts():
    cut = importance.WordWindows(2)
    for text in (LONG, "x" * 9000 + " y", "É" * 4000 + "- " * 3000, ""):
        units, first, last, n = cut.windows(text)
        w = words(text)
        assert n == len(w) and [units[a:b].decode() for a, b in zip(first[:n], last[:n], strict=True)] == w
        assert [units[a:b].decode() for a, b in zip(first[n:], last[n:], strict=True)] == [" ".join(x) for x in zip(w, w[1:], strict=False)]


# Contamination.
def slow_contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item) if item is not None else "")
    lengths, out = {len(w) for w in windows}, []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                of = windows.get(tuple(w[k : k + n]))
                if of:
                    found |= of
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def leaked():
    pick = random.Random(3)
    prose = lambda n: [pick.choice(["the", "of", "a", "river", "stone", "Éclat", "b2", "over", "under", "light", "never", "again"]) for _ in range(n)]
    items = [(k, " ".join(prose(pick.choice([1, 2, 3, 5, 12, 30])))) for k in range(30)] + [(100, "the the the the"), (101, None), (102, ""), (103, "- ."), (None, "stone over light"), (0, "a second row of item zero"), (104, LONG[:3000])]
    rows = []
    for k in range(150):
        w = prose(pick.randint(0, 40))
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = (items[pick.randrange(36)][1] or "").upper().split(" ")
        rows.append((k, ", ".join(w)))
    return rows + [(200, LONG), (None, "stone; over LIGHT"), (7, None), (8, ""), (9, "the the the the the the"), (9, "the the the the the the"), (201, LONG + " tail")], items


@pytest.mark.parametrize(("size", "segment", "block"), [(10, 32_000_000, 4_000_000), (3, 3000, 4000), (4, 1, 300)])
def test_contamination(spark, leaked, size, segment, block):
    rows, items = leaked
    if segment == 1:  # a segment for each document
        rows, items = rows[:30], items[:10]
    df = spark.createDataFrame([(*r, 1, "x", 0.1) for r in rows], SCHEMA).repartition(3)
    got = contamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), size, segment, block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(slow_contamination(rows, items, size), key=repr)


def test_contamination_of_empty_tables(spark, leaked):
    rows, items = leaked
    docs, bench = spark.createDataFrame(rows[:20], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none_docs, none_items = docs.limit(0), bench.limit(0)
    assert contamination.contamination(none_docs, bench).collect() == []
    assert {(r["n_hit"], tuple(r["items"])) for r in contamination.contamination(docs, none_items).collect()} == {(0, ())}


def slow_near(w, window, slop):
    """Spans that hold the window's words in order, at most slop others among them, and no shorter such span."""
    spans = set()
    for a in range(len(w)):
        if w[a] != window[0]:
            continue
        at = a
        for x in window[1:]:
            at = next((k for k in range(at + 1, len(w)) if w[k] == x), None)
            if at is None:
                break
        if at is not None and at - a + 1 <= len(window) + slop:
            spans.add((a, at))
    return {(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)}


@pytest.mark.parametrize("slop", [0, 1, 4])
def test_proximity(spark, slop):
    pick = random.Random(11)
    rows = [(k, " ".join(pick.choices("abcd", k=pick.randint(0, 25)))) for k in range(60)]
    items = [(k, " ".join(pick.choices("abcd", k=pick.randint(1, 6)))) for k in range(12)]
    index = contamination.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 400)
    found = contamination.search(index, spark.createDataFrame(items, "item_id long, text string"), 4, slop)
    ids = index.where("term is null").select("segment", "doc", "doc_id")
    got = {(r["doc_id"], r["first"], r["last"], i) for r in found.join(ids, ["segment", "doc"]).collect() for i in r["items"]}
    want = set()
    for item, text in items:
        w = text.split()
        for k in range(max(1, len(w) - 3)):
            want |= {(doc, a, b, str(item)) for doc, t in rows for a, b in slow_near(t.split(), w[k : k + 4], slop)}
    assert got == want


@given(st.lists(st.integers(0, 2**33), max_size=200))
@settings(max_examples=40, deadline=None)
def test_packed_numbers(numbers):
    data, sizes = contamination.packed(np.array(numbers, np.int64))
    assert contamination.unpacked(data).tolist() == numbers and sizes.sum() == len(data)
