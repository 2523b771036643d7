"""Cases worked out by hand."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import indicators as I
from tidemark.operators import news as N
from tidemark.operators import registry as R
from tidemark.operators import scores as S
from tidemark.sources.readers import extract_messages, read_observations, read_sessions

CASES = {
    "one": ([1], "rate", None),
    "two": ([1, 2], "rate", (100.0, None, None, None, 0.0, 0.3)),
    "two_neg": ([1, 2], "labor_neg", (100.0, None, None, None, 0.0, -0.3)),
    "prev_zero": ([0, 5], "rate", (0.0, None, None, None, 0.0, 0.0)),
    "neg_base": ([-2, -1], "rate", (50.0, None, None, None, 0.0, 0.3)),
    "three": ([100, 100.2, 100.1], "rate", (-0.1, None, None, None, 0.0, -0.059097)),
    "four": ([100, 100.2, 100.1, 100.3], "rate", (0.2, None, None, 0.1, 0.0, 0.13362)),
    "zeros5": ([0] * 5, "rate", (0.0, None, None, None, 0.0, 0.0)),
    "six": ([100, 100.2, 100.1, 100.3, 100.2, 100.5], "rate", (0.299, 0.233, None, 0.133, 1.8, 0.310588)),
    "const13": ([5] * 13, "rate", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    "ramp13": ([100 + 0.25 * i for i in range(13)], "growth", (0.243, 0.735, 3.0, 0.244, 1.59, 0.495016)),
    "ramp13_neg": ([100 + 0.25 * i for i in range(13)], "labor_neg", (0.243, 0.735, 3.0, 0.244, 1.59, -0.495016)),
    "fall14": ([50 - 0.125 * i for i in range(14)], "growth", (-0.258, -0.767, -3.008, -0.257, -1.59, -0.507633)),
    "zero_13_back": ([0, *(1 + 0.01 * i for i in range(12))], "growth", (0.909, 2.804, 0.0, 0.917, 1.59, 0.693131)),
}


def test_horizons(spark):
    rows = [(name, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(v), cat) for name, (values, cat, _) in CASES.items() for i, v in enumerate(values)]
    obs = spark.createDataFrame(rows, "series_id string, date date, value double, cat string")
    got = {r["series_id"]: r for r in I.latest(obs).withColumn("score", I.signed(F.col("score"), F.col("cat"))).collect()}
    for name, (_, _, want) in CASES.items():
        r = got[name]
        if want is None:
            assert r["score"] is None
            continue
        for column, digits, value in zip(("mom", "qoq", "yoy", "t3m", "z", "score"), (3, 3, 3, 3, 2, 6), want, strict=True):
            assert (r[column] is None) == (value is None), (name, column)
            assert value is None or r[column] == pytest.approx(value, abs=0.6 * 10**-digits), (name, column)
    last = I.history(obs).groupBy("series_id").agg(F.max_by("score", "date").alias("s"))
    assert {r["series_id"]: r["s"] for r in last.collect()} == {r["series_id"]: r["score"] for r in I.latest(obs).collect()}


def test_cleaning(spark):
    raw = spark.createDataFrame([("s", str(k), v) for k, v in enumerate((".", "", "NaN", "1e3", " 2 ", None))], "series_id string, date string, value string")
    assert [r["value"] for r in I.clean_observations(raw).collect()] == [1000.0, 2.0]


def labels(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(f(F.col("x"))).collect()]


def test_labels(spark):
    assert labels(spark, [0.35, 0.15, -0.15, -0.35, float("nan"), None], I.bias_label) == ["Strong Bullish", "Moderate Bullish", "Moderate Bearish", "Strong Bearish", "Neutral", "Neutral"]
    assert labels(spark, [0.10, -0.10, 0.11, -0.11], S.nowcast_label) == ["in line", "in line", "higher", "lower"]


@pytest.mark.parametrize(("up", "both", "down", "neutral", "want"), [(3, 1, 1, 0, (-0.03, 0.16, 0.08)), (20, 0, 0, 0, (-0.5, 0.5, 0.5)), (0, 0, 0, 1, (0.05, 0.08, 0.0)), (0, 0, 0, 0, (0.0, 0.0, 0.0))])
def test_news_points(spark, up, both, down, neutral, want):
    titles = ["a rally"] * up + ["a rally, a drop"] * both + ["a drop"] * down + ["calm"] * neutral
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate(titles)], "seq int, title string, description string")
    assets = spark.createDataFrame([(a,) for a in dims.NEWS_ASSETS], "asset string")
    got = {r["asset"]: r["points"] for r in S.asset_points(N.sentiment(rows), assets).collect()}
    assert (got["Gold"], got["Oil"], got["USD"]) == pytest.approx(want)
    assert got["CHF"] == got["Gold"]


def test_weighted_means(spark):
    rows = spark.createDataFrame([("c", 0.4, 0.6), ("c", None, 0.4)], "currency string, score double, weight double")
    assert I.macro_score(rows).first()["macro"] == pytest.approx(0.4)
    metrics = spark.createDataFrame([("a", 0.4), ("b", None)], "series_id string, score double")
    dim = spark.createDataFrame([("e", "a", None, "rate", 0.6), ("e", "b", None, "rate", 0.4), ("none", "x", "y", "rate", 1.0)], "code string, series_id string, fallback_id string, cat string, weight double")
    assert {r["code"]: round(r["precursor"], 9) for r in S.precursor_scores(metrics, dim).collect()} == {"e": 0.24, "none": 0.0}


def test_blends(spark):
    one = lambda cols, *v: spark.createDataFrame([v], cols)
    gold = S.gold_composite(one("score double, has_data boolean", 0.3, True), one("macro double", 0.1), one("points double", -0.03)).first()["composite"]
    assert gold == pytest.approx(-0.14)
    none = spark.createDataFrame([], "score double, has_data boolean")
    assert S.gold_composite(none, one("macro double", 0.1), one("points double", -0.03)).first()["composite"] is None
    assert S.oil_composite(one("score double, has_data boolean", 0.2, True), one("points double", 0.16)).first()["composite"] == pytest.approx(0.26)
    assert S.oil_composite(none, one("points double", 0.08)).first()["composite"] == pytest.approx(0.12)
    events = spark.createDataFrame([("a", "USD"), ("b", "USD")], "code string, currency string")
    pre = spark.createDataFrame([("a", 0.25), ("b", 1.0)], "code string, precursor double")
    sent = spark.createDataFrame([("a", 3, 0.08), ("b", 9, 0.5)], "code string, n int, delta double")
    got = {r["code"]: r for r in S.event_nowcast(pre, sent, events).collect()}
    assert (got["a"]["composite"], got["a"]["confidence"], got["a"]["label"]) == (pytest.approx(0.214), 72, "higher")
    assert got["b"]["confidence"] == 94
    left = S.report_rows(spark.createDataFrame([("USD", 0.2)], "asset string, score double"), spark.createDataFrame([("USD", 0), ("AUD", 1)], "asset string, ord int"))
    assert {r["asset"]: (r["strength"], r["score_text"]) for r in left.collect()} == {"USD": ("Moderate Bullish", "+0.20"), "AUD": ("Neutral", "0.00")}


def test_score_texts_are_those_of_the_sql(spark):
    """Scores that round to zero keep their sign, in the query and in the SQL's `rep`."""
    import re

    import duckdb

    from tidemark.plans import series

    scores = [("USD", -0.000270101976), ("EUR", 0.000269), ("GBP", -0.004999), ("JPY", -0.005), ("CAD", 0.145), ("CHF", 0.35), ("Gold", 0.0), ("Oil", -1.0)]
    left = spark.createDataFrame(scores, "asset string, score double")
    have = {r["asset"]: tuple(r)[2:] for r in S.report_rows(left, series._assets(spark)).collect()}
    assert (have["USD"][1], have["EUR"][1], have["GBP"][1], have["JPY"][1], have["AUD"][1]) == ("-0.00", "+0.00", "-0.00", "-0.01", "0.00")
    rep = re.search(r"rep AS \((.*?)\), drv AS", series.SCORES, re.DOTALL)[1]
    rows = duckdb.execute(f"WITH {series.M.values('wa', 'asset, ord, keywords', series.WIRE_ROWS)}, {series.M.values('sc', 'asset, score', scores)} {rep}").fetchall()
    assert {r[0]: r[2:] for r in rows} == have


DEDUP = [
    (["Fed raises rates sharply amid inflation", "BREAKING: Fed raises rates amid inflation"], [0]),
    (["alpha beta gamma delta", "beta gamma delta epsilon", "gamma delta epsilon zeta"], [0, 2]),
    (["12:30 -- 2024-08-24", "12:30 -- 2024-08-24"], [0, 1]),
    (["Gold up 2%"], []),
]


@pytest.mark.parametrize(("titles", "kept"), DEDUP)
def test_dedup(spark, titles, kept):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "seq int, title string")
    assert sorted(r["seq"] for r in N.dedup_articles(rows).collect()) == kept


@pytest.mark.parametrize("small", [0, 40, 500_000])
def test_dedup_is_the_greedy_choice(spark, small):
    """By rounds alone, by rounds and a last task, and by one task."""
    import random

    r = random.Random(5)
    words = [w * 3 for w in "abcdefgh"]
    titles = [" ".join(r.sample(words, r.randint(3, 6))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(titles)), "seq int, title string")
    kept = []
    for k, t in enumerate(titles):
        a = set(t.split())
        if len(t) >= 14 and not any(len(a & set(titles[j].split())) / len(a | set(titles[j].split())) >= 0.55 for j in kept):
            kept.append(k)
    assert sorted(x["seq"] for x in N.dedup_articles(rows.repartition(3), small).collect()) == [k for k in kept if len(titles[k]) >= 14]


def test_like_titles_make_no_square_of_pairs(spark, monkeypatch):
    """A group of n like titles: pairs that the choice writes down grow with n, in blocks of any size; links and kept articles are those of brute force."""
    import random

    from tidemark.operators import graph

    r, common = random.Random(7), ["onharent", *(c * 4 for c in "abcdefghij")]
    titles = [" ".join(r.sample(common, 9)) for _ in range(120)] + [" ".join(r.sample([c * 5 for c in "klmnopqrst"], 4)) for _ in range(40)]
    r.shuffle(titles)
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    like = lambda x, y: 20 * len(x & y) >= 11 * len(x | y)
    words = [set(t.split()) for t in titles]
    firsts = [k for k, w in enumerate(words) if w not in words[:k]]
    links = {(i, j) for i in firsts for j in firsts if i < j and like(words[i], words[j])}
    members = {(words.index(w), k) for k, w in enumerate(words) if words.index(w) != k}
    found = [(x["a"], x["b"]) for x in N.near_duplicate_pairs(rows).collect()]
    assert sorted(found) == sorted(links | members)
    kept, seen = [], []
    for k in range(len(titles)):
        if not any(like(words[k], words[j]) for j in kept):
            kept.append(k)
    monkeypatch.setattr(N, "greedy_drops", lambda edges, most: (seen.append(edges.count()), graph.greedy_drops(edges, most))[1])
    for first, pairs in ((8, 16), (160, 4)):
        seen.clear()
        monkeypatch.setattr(N, "PAIRS", pairs)
        assert sorted(x["seq"] for x in N.dedup_articles(rows, first=first).collect()) == kept
        assert pairs == 16 or len(seen) > 1
        if first == 8:
            assert sum(seen) < len(links) / 4


@pytest.mark.parametrize("together", [1, 3, N.TOGETHER])
def test_every_pair_of_like_articles(spark, together):
    """No pair at or above the threshold is left out: of copies, of texts with one keyword set, across sets, of short titles; by brute force."""
    import random
    from collections import Counter

    r = random.Random(11)
    sets = [r.sample([c * 4 for c in "abcdefgh"], r.randint(1, 7)) for _ in range(25)]
    titles = [" ".join(r.sample(w, len(w))) for w in (r.choice(sets) for _ in range(90))]
    titles += ["Gold rises", "rises, gold", "Gold up 2%", "12:30 -- 2024-08-24", "12:30 -- 2024-08-24", "the news", "the news", "", None] + [titles[0]] * 8
    titles += [" ".join(c * 5 for c in "abcdefghijklmno"), " ".join(c * 5 for c in "efghijklmnopqrst")]  # 15 and 16 words, 11 shared: 11/20
    r.shuffle(titles)
    words = [{w for w in re.findall(r"[a-z]{3,}", (t or "").lower()) if w not in dims.STOP_WORDS} for t in titles]
    alike = lambda x, y: x and y and 20 * len(x & y) >= 11 * len(x | y)
    want = {(i, j): len(words[i] & words[j]) / len(words[i] | words[j]) for j in range(len(titles)) for i in range(j) if alike(words[i], words[j])}
    assert 0.55 in want.values() and any(len(titles[i]) < 14 for i, _ in want)
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string").repartition(3)
    found = N.all_near_duplicate_pairs(rows, together).collect()
    assert Counter((x["a"], x["b"]) for x in found) == Counter(want.keys())
    assert all(x["jaccard"] == want[x["a"], x["b"]] for x in found)
    assert together < N.TOGETHER or N.all_near_duplicate_pairs(rows.where("seq < 0")).count() == 0


def test_near_duplicate_pairs_of_the_tables_are_whole(spark):
    """The query has every pair at the threshold of sf0.001's articles, compared one by one."""
    from tidemark.plans import feeds

    sf = "/root/testdata/sf0.001"
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    title = lambda t: t[:110] + "..." if len(t) > 110 else t
    words = {k: {w for w in re.split(r"[\W]+", title(t or "").lower()) if re.fullmatch("[a-z]{3,}", w) and w not in dims.STOP_WORDS} for k, t in docs}
    want = [(a, b) for a in words for b in words if a < b and words[a] and words[b] and 20 * len(words[a] & words[b]) >= 11 * len(words[a] | words[b])]
    assert sorted((x["a"], x["b"]) for x in feeds.near_duplicate_pairs(spark, sf).collect()) == sorted(want)


def test_shared_folder(spark):
    """A cluster without a shared folder is an error; scratch tables go when their block ends."""
    from types import SimpleNamespace

    from tidemark import shared

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=conf.get)))
    conf["spark.master"] = "local[4]"
    assert len({shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=conf.get))) for _ in range(2)}) == 1
    with shared.scratch(spark):
        rows = shared.stored(spark.range(5), "gone")
        assert rows.count() == 5
        path = rows.inputFiles()[0]
    assert not shared.fs.FileSystem.from_uri(path)[0].get_file_info(shared.file_store(path)[1]).is_file


def test_report_ends_with_the_yield(spark):
    rows = spark.createDataFrame([("USD", 0, "Neutral", "+0.02", "waits")], "asset string, ord int, strength string, score_text string, driver string")
    wires = spark.createDataFrame([], "asset string, wire string")
    yields = spark.createDataFrame([(1, 1.5), (2, 1.237)], "date int, value double")
    text = lambda y: S.report_text(S.report(rows, wires, y)).first()[0].split("\n")
    assert text(yields) == ["USD | Neutral | +0.02 | waits", "US 10Y Real Yield: 1.24%"]
    assert text(yields.limit(0))[-1] == "US 10Y Real Yield: N/A"


def test_keywords_and_wires(spark):
    rows = spark.createDataFrame([(0, "éclair cpi2024 rise naïve"), (1, "Forward guidance")], "seq int, title string")
    assert rows.where("seq = 0").select(N.title_keywords(F.col("title"))).first()[0] == ["rise"]
    assets = spark.createDataFrame([("Gold", ["war"])], "asset string, keywords array<string>")
    assert N.first_wires(rows, assets).first()["seq"] == 1


@pytest.mark.parametrize(("now", "want"), [((2026, 8, 21), {3: ("2026-08-24", 3), 5: ("2026-08-26", 5)}), ((2026, 8, 19), {3: ("2026-08-24", 5), 5: ("2026-08-24", 5)}), ((2026, 8, 20), {3: ("2026-08-24", 4), 5: ("2026-08-25", 5)})])
def test_calendar(spark, now, want):
    got = S.upcoming(dims.event_dim(spark), datetime.datetime(*now)).collect()
    days = {c: d for c, _, _, d, _, _ in dims.EVENTS}
    assert all((str(r["event_date"]), r["days_away"]) == want[days[r["code"]]] for r in got)
    assert [r["template_ord"] for r in got if r["days_away"] == got[0]["days_away"]] == sorted(r["template_ord"] for r in got if r["days_away"] == got[0]["days_away"])


def test_registry(spark):
    rows = spark.createDataFrame([("2026-08-21", "Active"), ("2026-08-20", "Active"), ("Lifetime", "Active"), ("Lifetime", "Revoked")], "expires_at string, status string")
    assert [r[0] for r in rows.select(R.license_status(F.col("status"), F.col("expires_at"), "2026-08-21")).collect()] == ["Active", "Expired", "Active", "Revoked"]
    assert tuple(R.kpis(rows, "2026-08-21").first()) == (4, 2, 2)
    logins = spark.createDataFrame([(k, k, "k", kind, d) for k, (kind, d) in enumerate([("Mobile", ""), ("Mobile", "d1"), ("Mobile", "d1"), ("Mobile", "d2"), ("PC", "d9"), ("Mobile", "")])], "login_ts int, login_id int, key string, dev_type string, device_id string")
    assert {r["login_id"] for r in R.first_binding(logins).where("violation").collect()} == {3, 5}
    ts = spark.createDataFrame([("d", t) for t in ("2024-01-01 00:00:00", "2024-01-06 00:00:00", "2024-01-11 00:00:01")], "device_id string, t string").select("device_id", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in R.sessions(ts).collect()) == [1, 2]


def test_pages(spark):
    html = "".join(f'<div class="message_text x">message number {k} <b>with words</b></div>' for k in range(12)) + '<div class="message_text">short</div>' + "".join(f'<time class="time" datetime="2024-01-{k + 1:02d}T10:00:00"></time>' for k in range(13))
    rows = extract_messages(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("item_rank").collect()
    assert len(rows) == 9
    assert (rows[0]["text"].split()[2], rows[0]["time"]) == ("11", "2024-01-12 10:00")


def test_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"series_id":"s","observations":[{"date":"2024-01-01","value":"."},{"date":"2024-02-01","value":"2"}]}')
    assert read_observations(spark, str(tmp_path / "o.json")).count() == 2
    (tmp_path / "s.json").write_text('{"d1":{"key":"k","dev_type":"PC","is_admin":false},"d2":{"key":"l"}}')
    assert {r["device_id"]: r["key"] for r in read_sessions(spark, str(tmp_path / "s.json")).collect()} == {"d1": "k", "d2": "l"}
