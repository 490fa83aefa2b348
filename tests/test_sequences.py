"""Small hand-checked cases and invariants of the sequence operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import masking, metrics, prosody, sampling, sequence, stats
from seqloom.storage import chunked, positioned, running_sum


def rows(spark, labels, key="a"):
    return spark.createDataFrame([(key, i, x) for i, x in enumerate(labels)], "utt string, t int, phone int")


def test_segments(spark):
    found = sequence.segments(rows(spark, [5, 5, 7, 7, 7, 5]), "utt", ["t"], "phone").orderBy("start").collect()
    assert [(r["start"], r["end"], r["phone"]) for r in found] == [(0, 2, 5), (2, 5, 7), (5, 6, 5)]
    assert sequence.segments(rows(spark, []), "utt", ["t"], "phone").count() == 0


def test_segments_take_a_null_as_a_label(spark):
    found = sequence.segments(rows(spark, [None, None, 1, None]), "utt", ["t"], "phone").orderBy("start").collect()
    assert [(r["start"], r["end"], r["phone"]) for r in found] == [(0, 2, None), (2, 3, 1), (3, 4, None)]


def test_chunks_do_not_change_results(spark, monkeypatch):
    labels = [int(x) for x in np.random.default_rng(1).integers(0, 3, 300)]
    df = rows(spark, labels).unionByName(rows(spark, labels[:7], "b"))
    whole = [sequence.segments(df, "utt", ["t"], "phone").collect(), sequence.moving_average(df, "utt", ["t"], "phone", 5).collect(), sequence.bigrams(df, "utt", ["t"], "phone").collect()]
    monkeypatch.setattr("seqloom.storage.chunked.__defaults__", (0, 0, 16, 1))
    cut = [sequence.segments(df, "utt", ["t"], "phone").collect(), sequence.moving_average(df, "utt", ["t"], "phone", 5).collect(), sequence.bigrams(df, "utt", ["t"], "phone").collect()]
    for a, b in zip(whole, cut):
        assert sorted(a) == sorted(b)
    assert sum(r["end"] - r["start"] for r in cut[0]) == 307


def test_positions_count_within_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    found = positioned(df, "k", ["id"]).orderBy("k", "id").collect()
    assert [r["pos"] for r in found] == [r["id"] // 3 for r in found]
    assert chunked(df, "k", ["id"], before=1, chunk=10).filter("not halo").count() == 1000


def test_transitions(spark):
    counts = sequence.bigrams(rows(spark, [0, 1, 1]), "utt", ["t"], "phone")
    states = spark.range(2).select(F.col("id").cast("int").alias("state"))
    m = {(r["prev"], r["next"]): r["p"] for r in sequence.transition_matrix(counts, states).collect()}
    assert m[0, 0] == pytest.approx(0.1 / 1.2) and m[0, 1] == pytest.approx(1.1 / 1.2)
    assert {r["state"]: r["p"] for r in sequence.marginal(counts, states).collect()} == {0: 0.0, 1: 1.0}


def test_windows(spark):
    found = sequence.sliding_windows(rows(spark, [0] * 45), "utt", ["t"], [F.count("*").alias("n")]).orderBy("start").collect()
    assert [r["start"] for r in found] == [0, 10, 20]


def test_durations_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (90.0,), (0.0,)], "d double")
    assert [r[0] for r in df.select(prosody.mixed_duration(F.col("d"), F.col("d"), 0.5)).collect()] == [2, 4, 50, 1]


def test_ema(spark):
    xs = [float(x) for x in np.random.default_rng(2).normal(size=400)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "utt string, t int, v double")
    y, want = None, []
    for x in xs:
        y = x if y is None else 0.2 * x + 0.8 * y
        want.append(y)
    assert [r["ema"] for r in sequence.ema(df, "utt", ["t"], "v", 0.2).orderBy("pos").collect()] == pytest.approx(want)


def test_resampling_keeps_ends(spark):
    df = spark.createDataFrame([("a", i, [float(i)], 9) for i in range(5)], "utt string, t int, v array<double>, m int")
    assert [r["v"][0] for r in sequence.resample_linear(df, "utt", ["t"], "v", "m").orderBy("i").collect()] == pytest.approx([i / 2 for i in range(9)])


def test_word_errors(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("", "x"), ("a b", None), ("a b c d", "b c d e")], "r string, h string")
    found = metrics.word_errors(df, "r", "h").collect()
    assert [r["wer"] for r in found] == pytest.approx([1 / 3, 0, 1, 1, 0.5])
    assert metrics.word_errors(df, "r", "h", "inf").collect()[2]["wer"] == float("inf")
    assert [r[0] for r in df.select(metrics.jaccard(F.col("r"), F.col("h"))).collect()][:3] == pytest.approx([0.5, 1, 0])


def test_word_errors_against_the_plain_table(spark):
    rng = np.random.default_rng(3)
    pairs, want = [], []
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
        pairs.append((len(pairs), " ".join(a), " ".join(b)))
        want.append(int(d[-1, -1]))
    many = " ".join(f"w{i}" for i in range(60_000))  # code points go on behind the surrogates
    df = spark.createDataFrame([*pairs, (60, many, "w0 " + " ".join(f"w{i}" for i in range(59_990, 60_000)))], "i int, r string, h string")
    got = [r["distance"] for r in metrics.word_errors(df, "r", "h").orderBy("i").collect()]
    assert got[:60] == want and got[60] == 60_000 - 11


def test_agreement_of_a_labelling_with_itself(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("a"), (F.col("id") % 4).alias("b"))
    assert metrics.agreement(df, "a", "b").first() == pytest.approx((1.0, 1.0))


def test_samples(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    assert sampling.share_of_group(df, "g", 0.1, "id").groupBy("g").count().agg(F.max("count")).first()[0] == 3
    assert sorted(r["pos"] for r in sampling.every(df, ["id"], 10).collect()) == list(range(0, 100, 10))
    with pytest.raises(ValueError):
        sampling.disjoint_pools(df.select(F.col("id").alias("speaker"), F.lit("m").alias("gender")), None, 4, 50)
    budget = sampling.prototype_budget(spark.createDataFrame([(0, 90), (1, 9), (2, 1)], "phone int, n bigint"), "phone", 12)
    assert budget.agg(F.sum("keep")).first()[0] == 12


def drawn(seed, *parts):
    return hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()


def plain_mask(key, n, tokens, spans, low, high, count, seed=4):
    """The rule, draw by draw."""
    number = lambda *x: int(drawn(*x)[:8], 16)
    quota, more = int(n * tokens), int(n * spans)
    out = set(sorted(range(n), key=lambda i: (drawn(seed, key, i), i))[:quota])
    done, i = 0, 0
    while done < more and len(out) < n:
        size = low + number(seed + 2, key, i) % (high - low + 1)
        room = n if count == "masked" else max(1, n - size)
        start = number(seed + 1, key, i) % room
        out |= set(range(start, min(start + size, n)))
        done = len(out) - quota if count == "masked" else done + min(start + size, n) - start
        i += 1
    return sorted(out)


@pytest.mark.parametrize("count", ["masked", "summed"])
def test_masks_against_the_plain_rule(spark, count):
    df = rows(spark, [i % 5 for i in range(200)]).unionByName(rows(spark, [1, 2, 3], "b")).unionByName(rows(spark, [4] * 37, "c"))
    found = masking.masked(df, "utt", ["t"], "phone", 0.1, 0.3, (2, 5), count=count)
    got = {k: sorted(r["pos"] for r in found.collect() if r["utt"] == k and r["masked"]) for k in "abc"}
    assert got == {k: plain_mask(k, n, 0.1, 0.3, 2, 5, count) for k, n in (("a", 200), ("b", 3), ("c", 37))}
    assert sorted(found.collect()) == sorted(masking.masked(df.repartition(3), "utt", ["t"], "phone", 0.1, 0.3, (2, 5), count=count).collect())
    all_of_it = masking.masked(df, "utt", ["t"], "phone", 0.5, 0.9)
    assert all_of_it.filter("masked").count() >= 200


def test_masks_are_joined_without_a_broadcast_of_rows(spark, monkeypatch):
    """A table of symbols packs so well that its file looks small enough to broadcast."""
    plain, plans = masking.least_by_draw, []

    def watched(*args, **how):
        out = plain(*args, **how)
        plans.append(next(line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line))
        return out

    monkeypatch.setattr(masking, "least_by_draw", watched)
    found = masking.masked(rows(spark, [i % 5 for i in range(300)]), "utt", ["t"], "phone")
    plans.append(next(line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line))
    assert len(plans) == 2 and all("SortMergeJoin" in p for p in plans)


def test_fill_and_smooth(spark):
    m = np.array([[0.1, 0.9], [0.8, 0.2]])
    df = rows(spark, [0, 1, 0, 1]).withColumn("hide", F.col("t") == 2)
    assert [r["filled"] for r in masking.filled(df, "utt", ["t"], "phone", "hide", m).orderBy("pos").collect()] == [0, 1, 0, 1]
    smooth = masking.smoothed(rows(spark, [-1, 0, -1, -1]), "utt", ["t"], "phone", m, np.array([0.4, 0.6]))
    assert [r["smooth"] for r in smooth.orderBy("pos").collect()] == [1, 0, 1, 0]


def test_smoothing_keeps_its_partitions(spark):
    """However small its rows are when packed."""
    df = spark.createDataFrame([(f"u{i % 40}", i, i % 3 - 1) for i in range(400)], "utt string, t int, phone int")
    smooth = masking.smoothed(df, "utt", ["t"], "phone", np.array([[0.1, 0.9], [0.8, 0.2]]), np.array([0.4, 0.6]))
    assert smooth.rdd.getNumPartitions() == 4 and smooth.count() == 400


def test_fill_and_smooth_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(14)
    m = rng.dirichlet(np.ones(4), 4)
    symbols = rng.integers(0, 4, 64)
    hide = rng.random(64) < 0.5
    hide[20:45] = True  # chunks that are masked from end to end
    hide[0] = True
    want = symbols.copy()
    for i in np.flatnonzero(hide):
        p = (m[want[i - 1]] if i else 1.0) * (m[:, symbols[i + 1]] if i + 1 < 64 else 1.0)
        want[i] = int(np.argmax(p))
    df = spark.createDataFrame([("a", i, int(x), bool(h)) for i, (x, h) in enumerate(zip(symbols, hide))], "utt string, t int, phone int, hide boolean")
    for chunk in (8, 1000):
        got = masking.filled(df, "utt", ["t"], "phone", "hide", m, chunk=chunk).orderBy("pos").collect()
        assert [r["filled"] for r in got] == want.tolist() and [r["symbol"] for r in got] == symbols.tolist() and [r["masked"] for r in got] == hide.tolist()
    for known in (~hide, np.arange(64) > 60, np.arange(64) < 0):
        masked = np.where(known, symbols, -1)
        want = masked.copy()
        for i in range(1, 64):
            if want[i] < 0 <= want[i - 1]:
                want[i] = m.argmax(1)[want[i - 1]]
        for i in range(62, -1, -1):
            if want[i] < 0 <= want[i + 1]:
                want[i] = m.argmax(0)[want[i + 1]]
        want[want < 0] = 2
        some = spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(masked)], "utt string, t int, phone int")
        for chunk in (8, 1000):
            got = masking.smoothed(some, "utt", ["t"], "phone", m, np.array([0.1, 0.2, 0.4, 0.3]), chunk=chunk).orderBy("pos").collect()
            assert [r["smooth"] for r in got] == want.tolist()


def test_bins_keep_their_labels(spark):
    labels = [int(x) for x in np.random.default_rng(15).integers(0, 9, 53)]
    got = sequence.shuffled_in_bins(rows(spark, labels), "utt", ["t"], "phone", share=1.0).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(53)) and [r["phone"] for r in got][50:] == labels[50:]
    assert [sorted(r["phone"] for r in got[i : i + 5]) for i in range(0, 50, 5)] == [sorted(labels[i : i + 5]) for i in range(0, 50, 5)]
    assert [r["phone"] for r in got] != labels


def test_running_sums(spark):
    xs = [int(x) for x in np.random.default_rng(16).integers(0, 9, 400)]
    df = spark.createDataFrame([("ab"[i % 2], i, x) for i, x in enumerate(xs)], "k string, i int, x int").repartition(5)
    got = {r["i"]: r["sum"] for r in running_sum(df, "k", ["i"], "x").collect()}
    assert got == {i: sum(xs[i % 2 : i + 1 : 2]) for i in range(400)}


def test_draws_by_slices(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    keep = spark.createDataFrame([(0, 5), (1, 400)], "g bigint, __keep bigint")
    got = sorted(r["id"] for r in sampling.least_by_draw(df, ["g"], keep, "id").collect())
    first = sorted((drawn(42, i), i) for i in range(0, 500, 3))[:5]
    assert got == sorted([i for _, i in first] + list(range(1, 500, 3)))
    assert sorted(r["id"] for r in sampling.share(df, 0.1, "id").collect()) == sorted(i for _, i in sorted((drawn(42, i), i) for i in range(500))[:50])


def test_interpolated_percentiles(spark):
    xs = np.round(np.random.default_rng(17).normal(size=3000), 2)  # many ties
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(xs)] + [(0, None), (1, float("nan"))], "g int, v double")
    for share in (0.0, 0.37, 0.5, 0.9, 1.0):
        for accuracy in (200, 10_000):
            got = {r["g"]: r["edge"] for r in stats.interpolated(df, ["g"], "v", share, accuracy).collect()}
            assert got == {g: np.percentile(xs[g::2], 100 * share) for g in (0, 1)}
    assert stats.interpolated(df, [], "v", 0.25).first()["edge"] == np.percentile(xs, 25)


def test_pools_need_both_genders(spark):
    df = spark.range(400).select(F.col("id").alias("speaker"), F.lit("m").alias("gender"))
    with pytest.raises(ValueError, match="'f': 0"):
        sampling.disjoint_pools(df, None, 4, 50)


def test_errors_are_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 0)], "a int, b int")
    got = stats.attempted(df, lambda a, b: float(a // b), "double", ["a", "b"]).orderBy("b").collect()
    assert got[0]["error"].startswith("ZeroDivisionError") and got[1]["result"] == 0.0 and got[1]["error"] is None


def test_patterns(spark):
    patterns = spark.createDataFrame([(0, [0.0, 0.0], [0.0]), (1, [1.0, 0.0], [9.0]), (2, [5.0, 5.0], [1.0])], "pattern int, centroid array<double>, attributes array<double>")
    source = spark.createDataFrame([(0,), (2,)], "pattern int")
    aim = lambda how, **k: [r["target"] for r in masking.target_pattern(source, patterns, how, **k).orderBy("pattern").collect()]
    assert aim("farthest") == [2, 0] and aim("attributes") == [1, 1] and aim("fixed", fixed=7) == [7, 7]
    assert all(a != b for a, b in zip(aim("random"), (0, 2)))
    df = spark.createDataFrame([("a", [0.9, 0.1]), ("a", [1.3, 0.1]), ("b", [4.0, 4.0])], "utt string, feature array<double>")
    found = masking.predicted_pattern(df, ["utt"], np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]]), 2)
    assert {r["utt"]: r["pattern"] for r in found.collect()} == {"a": 1, "b": 2}


def test_target_gender(spark):
    df = spark.createDataFrame([("m",), ("f",), (None,)], "g string")
    pick = lambda mode: [r[0] for r in df.select(prosody.target_gender(F.col("g"), mode)).collect()]
    assert pick("same") == ["m", "f", None] and pick("cross") == ["f", "m", None] and pick("F") == ["f"] * 3


def test_percentile_filter_leaves_out_what_is_not_a_number(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, float("nan")), (0, None)], "phone int, e double")
    assert sorted(r["e"] for r in stats.over_percentile(df, ["phone"], "e", 0.5).collect()) == [2.0, 3.0]

def test_ema_by_chunks_is_the_recursion(spark):
    """Chunks of any size, a smoothing that reaches far back, and one row."""
    rng = np.random.default_rng(3)
    rows = [(k, t, float(rng.normal())) for k, n in (("a", 500), ("b", 1), (None, 130)) for t in range(n)]
    df = spark.createDataFrame(rows, "key string, t int, value double").repartition(5)
    for alpha, chunk in ((0.3, 7), (0.001, 64), (1e-6, 33), (1.0, 10), (0.3, 65_536)):
        got = {(r["key"], r["pos"]): r["ema"] for r in sequence.ema(df, "key", ["t"], "value", alpha, chunk).collect()}
        for key in ("a", "b", None):
            y = None
            for t, v in sorted((t, v) for k, t, v in rows if k == key):
                y = v if y is None else alpha * v + (1 - alpha) * y
                assert got[key, t] == pytest.approx(y, abs=1e-12)
    x = rng.normal(size=10_000)
    assert sequence.scanned(x, 0.9)[-1] == pytest.approx((x * 0.9 ** np.arange(9_999, -1, -1)).sum())
