"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and brute-force versions on small fixtures."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import components, exact_dedup, jaccard_join, mixing, piece_sampling, quality_model, quality_rules, secrets, sharding, url_filter, warc
from seqloom.llm.common import utf8
from seqloom.llm.queries import PIECE_MODEL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, norm string, hit string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Stone,", "river", "cloud", "É", "naïve"]


def texts():
    rng = np.random.default_rng(5)
    said = [" ".join(rng.choice(WORDS, rng.integers(1, 90))) for _ in range(40)]
    base = [" ".join(f"w{i}-{j}" for j in range(60)) for i in range(3)]
    near = [" ".join("x" if k == j else w for k, w in enumerate(b.split())) for b in base for j in (0, 7, 30, 59)]
    chain = [" ".join(f"c{j}" for j in range(i, i + 70)) for i in range(0, 40, 4)]
    odd = [None, "", " ", "\n\n", "a", "A b", "a B", "two words", "two  words\t", "y " * 3000 + "end", "w" * 5000]
    return said + base + near + chain + odd + base[:1] * 3 + [base[0].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "s", "n", "h") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "alone here", "de", "src1", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


@pytest.mark.parametrize(("bits", "fan"), [(64, 2), (3, 32)])
def test_exact_dedup(docs, bits, fan):
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    got = exact_dedup.verdicts(docs, digest_bits=bits, memtable_rows=7, fan=fan).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_answers_from_its_index(docs):
    """What the index holds is what comes out: other identifiers or numbers in it make other results, where bytes agree."""

    class Spoilt(exact_dedup.LsmIndex):
        def compact(self, runs):
            return super().compact(runs).withColumns({"keep_id": F.lit(-7).cast("bigint"), "n": F.when(F.col("n") > 1, F.col("n") + 100).otherwise(1)})

    right, wrong = ({(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.verdicts(docs, index=x).collect()} for x in (None, Spoilt()))
    for k, r in right.items():
        want = (-7, r["group_size"] + 100) if r["group_size"] > 1 else (r["keep_id"], 1)
        assert (wrong[k]["keep_id"], wrong[k]["group_size"]) == want


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_keeps_the_indexs_rows(docs, bits):
    want = collections.defaultdict(list)
    for r in docs.collect():
        want[lower(r["text"])].append(r["doc_id"])
    got = [(lower(r["text"]), r["doc_id"]) for r in exact_dedup.deduplicate(docs, digest_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(((t, max((i for i in ids if i is not None), default=None)) for t, ids in want.items()), key=str)


def test_exact_dedup_hashes_a_row_in_one_worker(docs):
    """Rows are judged by one Python step a task: two on top of each other hold two workers for each core."""
    plan = exact_dedup.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_exact_dedup_keeps_rows(docs, empty):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({lower(r["text"]) for r in docs.collect()})
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    smallest = exact_dedup.verdicts(docs, keep="smallest").filter("group_size = 5 AND kept").collect()
    assert [r["doc_id"] for r in smallest] == [40]


def brute_links(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (words(lower(t)) for _, t in rows)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    top = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        top[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in top[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard_join(docs, block):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.join(docs, block_rows=block).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_links(rows)


def test_jaccard_join_without_ids(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(60)) for x in "ab")
    rows = [(1, a), (None, a + " z"), (2, b), (None, b + " z"), (3, b), (3, "one text of a repeated number"), (3, a), (None, "alone with no number at all"), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, node int").repartition(3)
    got = jaccard_join.join(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_links(rows)
    left = sorted(jaccard_join.one_of_each(df).collect(), key=lambda r: r["node"])
    assert [r["node"] for r in left] == [0, 2, 5, 7, 8, 9]


def test_jaccard_join_of_nothing(empty, docs):
    assert jaccard_join.join(empty).count() == 0
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(30)]
        sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
        tree = jaccard_join.PrefixTree.of(sets, sizes)
        for s, n in zip(sets, sizes):
            want = {j for j, t in enumerate(sets) if 100 * (k := len(np.intersect1d(s, t))) >= 60 * (n + sizes[j] - k)}
            assert set(tree.search(s, n, 60)) == want
    tokens = rng.integers(0, 2**48, 9).astype(np.uint64)
    assert (jaccard_join.unpacked_tokens(jaccard_join.packed_tokens(tokens)) == tokens).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 50), (60, 60), (41, 50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 50: 40}


def test_components_take_few_jobs(spark):
    """Chains whose numbers jump about, a large star and random edges. Jobs are what the driver keeps in memory."""
    rng = np.random.default_rng(9)
    chains = [rng.permutation(np.arange(k * 1000, k * 1000 + 300)) for k in range(4)]
    edges = [(int(x), int(y)) for c in chains for x, y in zip(c[:-1], c[1:])] + [(9000, i) for i in range(9001, 9400)] + [(int(x), int(y)) for x, y in rng.integers(20_000, 20_400, (260, 2))]
    union = {}

    def top(x):
        while union.setdefault(x, x) != x:
            x = union[x]
        return x

    for x, y in edges:
        if x != y:
            x, y = top(x), top(y)
            union[max(x, y)] = min(x, y)
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in union)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 36


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for r in docs.filter("doc_id is not null").collect():
        t, w, g = r["text"] or "", words(r["text"]), got[r["doc_id"]]
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (g["kept"] and g["base_failed"])
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(docs).columns == docs.columns


def test_divergence_speaks_against_odd_texts(spark):
    rng = np.random.default_rng(6)
    common = "the of and to in is that it for on".split()
    plain = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(list("aeiorstln"), 6)) for _ in range(200)) + "." for _ in range(60)]
    odd = [t.upper().replace(" ", "!! ") for t in plain[:1]] + [" | ".join(t.split()) for t in plain[1:2]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(plain + odd)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert all(kept[i] for i in range(60)) and not kept[60] and not kept[61]


def test_marks_speak_against_separator_lists(spark):
    rng = np.random.default_rng(7)
    common, names = "the of and to in is that it for on".split(), ["".join(rng.choice(list("aeiorstln"), 12)) for _ in range(400)]
    plain = [" ".join(rng.choice(common) if rng.random() < 0.15 else rng.choice(names) for _ in range(80)) + " - end." for _ in range(300)]
    lists = [" | ".join(rng.choice(common) if rng.random() < 0.15 else rng.choice(names) for _ in range(40)) + "." for _ in range(6)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(plain + lists)], "doc_id bigint, text string, lang string")
    rows = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert all(rows[i]["kept"] for i in range(300)) and not any(rows[i]["kept"] for i in range(300, 306))
    without = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, max_marks_distance=(1.0, 0.0)).collect()}
    assert all(without.values()) and not any(rows[i]["base_failed"] for i in rows)
    # a language of its own with too few documents is judged by the reference of all
    few = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df.withColumn("lang", F.when(F.col("doc_id") >= 298, "xx").otherwise("en"))).collect()}
    assert few[298] and few[299] and not any(few[i] for i in range(300, 306))


@pytest.mark.parametrize("good", [2, 5, 25])
def test_verdicts_dont_turn_with_the_tables_size(spark, good):
    """A list of separators is rejected beside a few good texts as beside many, and good texts stay, also alone in their language."""
    rng = np.random.default_rng(7)
    common = "the of and to in is that it for on".split()
    plain = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(list("aeiorstln"), 6)) for _ in range(200)) + "." for _ in range(good + 1)]
    rows = [(i, t, "en") for i, t in enumerate(plain[:-1])] + [(100, plain[-1], "de"), (101, " | ".join(plain[0].split()), "en"), (102, " | ".join(plain[1].split()), "fr")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert kept == {**dict.fromkeys(range(good), True), 100: True, 101: False, 102: False}


def test_rows_without_ids_are_kept_by_themselves(spark):
    rng = np.random.default_rng(10)
    plain = [" ".join("".join(rng.choice(list("aeiorstln"), 6)) for _ in range(80)) for _ in range(30)]
    rows = [(None, t) for t in plain] + [(None, "short"), (7, "short"), (7, plain[0]), (8, None)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    left = quality_rules.keep(df).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in left) == sorted([(True, t) for t in plain] + [(False, plain[0])])


def test_common_words_come_from_the_corpus(spark):
    rows = [("xx", "Ba ba ba, ÉÉ du du | 9"), ("xx", "du du ab"), (None, "zz")]
    got = {r["lang"]: [bytes(w).decode() for w in r["list"]] for r in quality_rules.common_words(spark.createDataFrame(rows, "lang string, text string"), frequent=3, held=2).collect()}
    assert got == {"xx": ["du", "ba", "ab"], None: ["zz"]}


def test_secrets(spark, empty):
    live, known = "k3Jq9zTt7Lw2Xv8Bn4Rd", "A1b2C3d4E5f6G7h8I9j0"
    said = ["x password = ab, TOKEN: '" + live + "' 😀 secret=" + known, "api_key=" + known, "apikey :" + known + " AKIA" + "Q7" * 9, "AKIA" + "Z" * 15 + " " + "0a" * 11 + " " + "0a" * 13, None, "", "token=token=abcdef", "password = secret = longenough1"]
    df = spark.createDataFrame([(i, t, f"o{i}", "r") for i, t in enumerate(said)], "doc_id bigint, text string, source string, lang string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    for i, t in enumerate(said):
        spans = []
        for k, (kind, (_, pattern, group, least)) in enumerate(secrets.KINDS.items()):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "", re.ASCII) if len(m[group]) >= least]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
    at = said[0].index(live)
    assert f"live:{at}:{at + len(live)}" in got[0]["spans"] and got[1]["spans"] == f"assign:0:{len(said[1])}"
    assert secrets.scan(empty).count() == 0
    # one owner's repositories alone show that a value is copied; null ones count as one; names that clash with the operator's are left alone
    rows = [(i, "token = " + live, "o", f"r{i % 4}" if n == 4 else None, i) for n in (4, 1) for i in range(6)]
    many = spark.createDataFrame(rows[:6], "doc_id bigint, text string, source string, lang string, row int")
    one = spark.createDataFrame(rows[6:], "doc_id bigint, text string, source string, lang string, row int")
    spans = lambda df, **how: [r["spans"].count("live") for r in secrets.digest(secrets.scan(df, **how)).collect()]
    assert spans(many) == [0] * 6 and spans(many, min_repositories=5) == [1] * 6 and spans(one) == [1] * 6
    assert spans(many, few=0, salts=3) == [0] * 6 and spans(many, repository=None) == [1] * 6
    assert spans(many.limit(2).unionAll(many.limit(2))) == [1] * 4


def test_sharding(docs, empty, spark):
    out = sharding.hilbert_shards(sharding.document_rows(docs), ["size", "source", "lang", "doc_id"], ["doc_id", "text_crc32", "size"], 7, partitions=5).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    first = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None}
    assert all(r["text_crc32"] == zlib.crc32((first[r["doc_id"]]["text"] or "").encode()) for r in out if r["doc_id"] is not None)
    assert sharding.hilbert_shards(sharding.document_rows(empty), ["size"], ["doc_id"]).count() == 0
    grid = spark.range(512).select(F.array(F.col("id") % 8, F.floor(F.col("id") / 8) % 8, F.floor(F.col("id") / 64)).alias("x"))
    walk = grid.withColumn("h", sharding.hilbert_index(F.col("x"), 3, 3)).orderBy("h").collect()
    assert [r["h"] for r in walk] == list(range(512)) and all(sum(abs(a - b) for a, b in zip(p["x"], q["x"])) == 1 for p, q in zip(walk, walk[1:]))


def test_sharding_by_whole_values(spark, tmp_path):
    import datetime

    rng = np.random.default_rng(11)
    names = [f"common-crawl-{chr(97 + i)}" for i in range(8)]
    rows = [(i, names[int(rng.integers(8))] if i % 9 else None, float(rng.normal()) * 100, datetime.date(2020, 1, 1) + datetime.timedelta(int(rng.integers(900))), bool(i % 2)) for i in range(600)]
    rows += [(None, names[0], None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, score double, day date, flag boolean").repartition(4)
    edges = sharding.string_edges(df, F.col("source"), 4)
    known = sorted(r[1] for r in rows if r[1])
    assert edges == sorted({known[-(-i * len(known) // 4) - 1] for i in range(1, 4)})
    out = sharding.hilbert_shards(df, ["source", "score", "day", "flag"], ["doc_id", "source"], 7, bits=4, partitions=5).cache()
    got = sorted(out.collect(), key=lambda r: (r["shard"], r["slot"]))
    order = [(r["hilbert"], r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)  # a plain sort: nulls first
    ends = np.cumsum([0] + [len(got) // 7 + (i < len(got) % 7) for i in range(7)])
    assert [(r["shard"], r["slot"]) for r in got] == [(k, j) for k in range(7) for j in range(ends[k + 1] - ends[k])]
    bins = df.select("source", "score", "day", sharding.bins(df, ["source", "score", "day"], 3).alias("b")).collect()
    for k, c in enumerate(("source", "score", "day")):
        by = sorted((r[c] is not None, r[c] if r[c] is not None else 0, r["b"][k]) for r in bins if r[c] is not None)
        assert [x[2] for x in by] == sorted(x[2] for x in by) and len({x[2] for x in by}) > 4
    sharding.write_shards(out, path := str(tmp_path / "shards"))
    spans = spark.read.parquet(path).groupBy("shard").agg(F.min("score"), F.max("score"), F.min("day"), F.max("day")).collect()
    # filters on either dimension skip shards by their least and greatest values
    assert sum(r[1] <= -150 for r in spans) < 7 or sum(r[3] <= datetime.date(2020, 1, 20) for r in spans) < 7
    assert spark.read.parquet(path).count() == 603
    with pytest.raises(ValueError):
        sharding.hilbert_shards(out, ["score"], ["doc_id"])


def test_url_filter(spark):
    urls = [f"http://spam{i % 2}.example.org/buy/{i}?ref=x" for i in range(40)] + [f"https://good.example.org/read/{i}" for i in range(40)]
    odd = [None, "", "no scheme", "http://WWW.Example.com/en/a?b#c", "https://x.net/es/1", "https://a.com", "https://x.com/en?q", "ftp://b.example.com/en/z"]
    pages = spark.createDataFrame(list(enumerate(urls + odd)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 40) for i in range(0, 80, 2)] + [(i, i < 40) for i in range(1, 80, 4)], "page_id bigint, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels, min_count=5).collect()}
    assert all(got[i]["verdict"] == ("block" if i < 40 else "allow") for i in range(80))
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(80, 88)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"), ("a.com", "", None, "allow"), ("x.com", "/en", "com/", "allow"), ("b.example.com", "/en/z", "example.com/en/", "block"),
    ]
    assert url_filter.judge(pages.limit(0), labels).count() == 0 and url_filter.judge(pages, labels.limit(0)).count() == 88


def test_url_tokens_that_come_together_are_mined_as_one(spark):
    long = "/".join(f"part{chr(97 + i)}" for i in range(26))
    urls = [f"http://x.net/es/{long}/{i}" for i in range(40)] + [f"http://x.com/ok/{i}" for i in range(40)] + [f"http://y.org/{long}/1", None] + [f"http://y.org/es/{long}/1"] * 20
    pages = spark.createDataFrame([(i if i != 2 else 1, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    out = url_filter.judge(pages).collect()
    got = collections.Counter((r["host"], r["verdict"], r["mined_rule"] is not None) for r in out)
    assert got == {("x.net", "block", True): 40, ("x.com", "allow", False): 40, ("y.org", "allow", False): 21, ("", "allow", False): 1}
    items = [F.array(*(F.lit(x) for x in row)) for row in (["h:net", "p:es", "p:a"], ["h:net", "p:es"], ["h:com"], ["p:es"])]
    rows = spark.range(30).select(items[0].alias("items"), F.lit(True).alias("bad")).unionByName(spark.range(30).select(items[2].alias("items"), F.lit(False).alias("bad"))).unionByName(spark.range(1).select(items[1].alias("items"), F.lit(True).alias("bad")))
    rules = {r["rule"]: (r["confidence"], r["uses"]) for r in url_filter.mine(rows).collect()}
    assert rules == {"h:net p:es": (1.0, 31), "p:a": (1.0, 30), "h:net p:a p:es": (1.0, 30)}
    assert {(r["bad"], r["fired"]) for r in url_filter.held_out_counts(pages, min_count=10).collect()} == {(True, True), (False, False)}


def test_quality_model(spark, empty):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(WORDS, 30)) for _ in range(60)]
    bad = [" ".join(w + "***" for w in t.split()) for t in good[:30]]
    df = spark.createDataFrame([*enumerate(good + bad + ["", None])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id bigint, quality int").filter(~quality_model.held_out(F.col("doc_id")))
    vectors, net = quality_model.train(df, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(df, vectors, net).collect()}
    assert all((scores[i] >= 0.5) == (i < 60) for i in range(90)) and scores[90] == scores[91]
    vectors, net = quality_model.train(df, labels.filter("quality = 1"))
    assert net.layers is None and quality_model.score(empty, vectors, net).count() == 0


def test_word_vectors_by_plain_loops(spark):
    """Counts, contexts, pooled vectors and scores, token by token."""
    import xxhash

    q = quality_model
    said = ["Alpha beta beta!! GAMMA", "", None, "beta alpha ALPHA alpha 12 12", "É é NO"]
    df = spark.createDataFrame([*enumerate(said)], "doc_id bigint, text string").repartition(2)
    size, index = q.SLOTS + 2, q.index_vectors()
    counts, contexts = np.zeros(size, np.int64), np.zeros((size, q.DIMS), np.int64)

    def put(to, of):
        for place in index[of]:
            contexts[to, place >> 1] += 1 - 2 * (place & 1)

    def tokens(t):
        slots, before = [], None
        for w in q.TOKEN.findall((t or "").encode()):
            slot = xxhash.xxh64_intdigest(w.lower()) % q.SLOTS
            slots.append((slot, slot == before, len(w) > 1 and w.isupper()))
            before = slot
        return slots

    for t in said:
        found = tokens(t)
        for i, (slot, same, capitals) in enumerate(found):
            for to, of in [(slot, None)] + [(q.SAME, slot)] * same + [(q.CAPITALS, slot)] * capitals:
                counts[to] += 1
                if of is not None:
                    put(to, of)
            if i:
                put(found[i - 1][0], slot)
                put(slot, found[i - 1][0])
    got = q.corpus_vectors(df.select("doc_id", utf8("text").alias("text")))
    assert (got[0] == counts).all() and (got[1] == contexts).all()
    vectors = q.weighted_vectors(counts, contexts)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    own = np.zeros(q.DIMS)
    for place in index[tokens("beta")[0][0]]:
        own[place >> 1] += 1 - 2 * (place & 1)
    beta = tokens("beta")[0][0]
    assert vectors[beta] == pytest.approx(unit(unit(contexts[beta].astype(float)) + unit(own)) * 1e-3 / (1e-3 + counts[beta] / counts[: q.SLOTS].sum()), rel=1e-4)
    rng = np.random.default_rng(3)
    net = q.Network(rng.normal(size=q.DIMS) / 9, np.ones(q.DIMS), (rng.normal(size=(q.DIMS, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.1)), 0.5, 1.7)
    for r in q.score(df, vectors, net).collect():
        found, x = tokens(said[r["doc_id"]]), np.zeros(q.DIMS)
        for slot, same, capitals in found:
            x += vectors[slot] + same * vectors[q.SAME] + capitals * vectors[q.CAPITALS]
        x /= max(1, len(found))
        h = [np.tanh(sum((x[d] - net.mean[d]) * net.layers[0][d, j] for d in range(q.DIMS)) + net.layers[1][j]) for j in range(4)]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(sum(a * b for a, b in zip(h, net.layers[2])) + 0.1) / 1.7)), abs=1e-6)


def test_warc(spark, tmp_path):
    long = "".join(f"<p>é{i} 😀</p>\r\nWARC/1.1\r\n" for i in range(3000))
    rows = [(1, "http://a\r\nb", long), (2, None, long), (2, "u", "x"), (3, "u", None), (4, "u", ""), (5, "u", "y" * 999), (6, "u", "y" * 999), (None, "u", "z"), (7, "u", "0\r\n\r\n" * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write(df, str(tmp_path / "w"), chunk=100, segment=1000)
    got = sorted((tuple(r) for r in warc.digests(warc.read(spark, str(tmp_path / "w"))).collect()), key=str)
    want = [(i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_reports_what_is_missing(spark, tmp_path):
    parts = [*warc.records(1, "0.1", "u", "00" * 20, ("abcdefgh" * 200).encode(), None, 50, 300)]
    for name, cut in (("part-0", parts[:-1]), ("part-1", [x.replace(b"Total-Length: ", b"Total-Length: 9") for x in warc.records(2, "0.2", "u", "00" * 20, b"q" * 2000, None, 50, 300)])):
        (tmp_path / name).write_bytes(b"".join(x + b"\r\n\r\n" for x in cut))
    errors = [r["error"] for r in warc.read(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert errors[0] == "no last segment" and " of 9" in errors[1]


def test_mixing(spark, empty):
    rows = [(i, ("good words here " if i % 4 else "bad stuff there ") * 10) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cell", F.lit("x"))
    labels = spark.createDataFrame([(i, "good" if i % 4 else "bad") for i in range(0, 200, 3)], "doc_id bigint, domain string")
    out = mixing.weigh(df, labels, {"good": 0.5, "bad": 0.5}).collect()
    p, n, r = (np.array([x[c] for x in out], dtype=float) for c in ("posterior", "tokens", "rate"))
    assert (p * (n * r)[:, None]).sum(0) / n.sum() == pytest.approx([0.5, 0.5], abs=0.01) and (r >= 0).all()
    taken = mixing.mix(df, labels, {"good": 0.5, "bad": 0.5})
    assert taken.columns == df.columns and taken.count() == sum(x["copies"] for x in out)
    assert {x["rate"] for x in mixing.weigh(df, labels.limit(0), {"good": 1.0}).collect()} == {1.0}
    assert mixing.weigh(empty, labels, {"good": 1.0}).count() == 0


def test_posteriors_are_calibrated(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(1500):  # a third of the texts bear a word that half of them share with the other domain
        toxic = i % 3 == 0
        said = list(rng.choice(WORDS, 20)) + ["odd"] * int(toxic or rng.random() < 0.2)
        rows.append((i, " ".join(said), "toxic" if toxic else "good"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, domain string").repartition(3)
    held = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(3)) == 0
    domains = mixing.learn(df, df.filter(~held).select("doc_id", "domain"))
    said = domains.posterior(df.filter(held)).collect()
    p = np.array([r["__cell"][domains.names.index("toxic")] / 64 for r in said])
    y = np.array([r["domain"] == "toxic" for r in said])
    for part in (p > 0.3, p <= 0.3):
        assert abs(p[part].mean() - y[part].mean()) < 0.08
    z = [[2.0, -1.0], [0.5, 0.0], [0.0, 3.0], [1.0, 1.0]]
    from pyspark.ml.linalg import Vectors

    t = mixing.best_temperature(spark.createDataFrame([(Vectors.dense(v), y) for v, y in zip(z, (0, 1, 1, 0))], ["__z", "__y"]))
    loss = lambda t: np.mean([np.log(np.exp((np.array(v) - v[y]) / t).sum()) for v, y in zip(z, (0, 1, 1, 0))])
    assert t == pytest.approx(min(np.geomspace(0.1, 10, 61), key=loss))


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(4)
    p, n, target = rng.dirichlet([0.4] * 3, 50), rng.integers(1, 100, 50).astype(float), np.array([0.7, 0.2, 0.1])
    cells = spark.createDataFrame([([i], float(n[i]), [float(x) for x in p[i]]) for i in range(50)], "cell array<int>, tokens double, p array<double>")
    got = np.array([r["rate"] for r in mixing.fit_rates(cells, list(target), steps=60).orderBy("cell").collect()])
    now = (n[:, None] * p).sum(0)
    loss = lambda r: 0.5 * (((r * n) @ p - target * n.sum()) ** 2 / (n.sum() * now)).sum() + 0.5e-3 * (n * (r - 1) ** 2).sum() / n.sum()
    r = np.ones(50)
    for _ in range(20_000):
        e = ((r * n) @ p - target * n.sum()) / now
        r = np.maximum(0, r - 0.3 * (p @ e + 1e-3 * (r - 1)))
    assert loss(got) == pytest.approx(loss(r), abs=1e-4)


def test_segmentations(spark, docs, empty):
    out = piece_sampling.sampled(docs, PIECE_MODEL, k=3).cache()
    assert out.filter("not round_trip").count() == 0
    plain = piece_sampling.decoded(out, PIECE_MODEL).join(docs.select("doc_id", "text").distinct(), "doc_id").filter("decoded <> coalesce(text, '')")
    assert plain.count() == 0
    again = piece_sampling.sampled(docs.repartition(1), PIECE_MODEL, k=3)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert piece_sampling.sampled(empty, PIECE_MODEL).count() == 0


def test_registered_segmentations_can_be_decoded(spark):
    from seqloom.llm.queries import op4_sentencepiece

    sf = "/root/testdata/sf0.001"
    out = op4_sentencepiece(spark, sf)
    plain = piece_sampling.decoded(out, PIECE_MODEL).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert plain.count() >= 200 and plain.filter("decoded <> coalesce(text, '')").count() == 0


def test_segmentations_against_enumeration():
    """All segmentations of short texts by plain recursion: probabilities, none missing, none twice."""
    import sentencepiece

    lat, m = piece_sampling.Lattices(piece_sampling.Pieces(PIECE_MODEL)), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    usual = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    weight = {i: 1 / (rank + 2.7) for rank, i in enumerate(sorted(usual, key=lambda i: (-m.get_score(i), i)))}
    total = sum(weight.values())
    weight = {i: w / total for i, w in weight.items()}  # a piece's share of the vocabulary
    ids = {m.id_to_piece(i): i for i in usual}
    assert lat.pieces.longest == max(map(len, ids))

    def ways(chunk):
        if not chunk:
            return [()]
        return [(ids[chunk[:n]], *rest) for n in range(1, len(chunk) + 1) if chunk[:n] in ids for rest in ways(chunk[n:])]

    for text in ("ab a", "the", "  x", "in-it"):
        chunks = re.findall(" *[^ ]+| +", " " + text)
        want = {sum(p, ()): np.prod([weight[i] for i in sum(p, ())]) for p in itertools.product(*(ways(c.replace(" ", "\u2581")) for c in chunks))}
        total = sum(want.values())
        found = piece_sampling.sample_batch(lat, [text], piece_sampling.mixed(np.arange(1, dtype=np.uint64)), len(want) + 5)[0]
        got = {tuple(lat.expand(s[0]).tolist()): np.exp(s[1]) for s in found}
        assert len(found) == len(got) == len(want) and got == pytest.approx({i: w / total for i, w in want.items()}, rel=1e-4)
        assert all(s[3] == 1.0 for s in found) and [s[2] for s in found] == sorted((s[2] for s in found), reverse=True)


def test_pieces_of_a_batch_are_those_of_each_text():
    """Agendas, pieces and bytes are made for all texts of a batch at once: an empty text, bytes of one to four, a text of one piece."""
    texts = ["", "plain words here", "\x01é\u0378 \U000e0041x", "a", "two  spaces\nand lines"]
    keys, pieces = piece_sampling.mixed(np.arange(5, dtype=np.uint64)), piece_sampling.Pieces(PIECE_MODEL)
    lat = piece_sampling.Lattices(pieces)
    found = piece_sampling.sample_batch(lat, texts, keys, 2)
    for i, t in enumerate(texts):
        alone = piece_sampling.Lattices(pieces)
        want = piece_sampling.sample_batch(alone, [t], keys[i : i + 1], 2)[0]
        assert [(lat.expand(a).tolist(), *rest) for a, *rest in found[i]] == [(alone.expand(a).tolist(), *rest) for a, *rest in want]
    arcs = np.concatenate([a for of in found for a, *_ in of])
    ids, many = lat.expanded(arcs)
    assert many.max() == 4 and many.sum() == len(ids) and ids.min() >= 0
    said, ends = pieces.spelt(ids)
    assert len(ends) == len(ids) and said.decode() == "".join(" " + t for t, of in zip(texts, found) for _ in of if t)


def test_segmentations_are_distinct_and_fair():
    lat = piece_sampling.Lattices(piece_sampling.Pieces(PIECE_MODEL))
    n, text = 4000, "the\nab é\x01"
    found = piece_sampling.sample_batch(lat, [text] * n, piece_sampling.mixed(np.arange(n, dtype=np.uint64)), 3)
    first, weight = collections.Counter(), collections.Counter()
    for segs in found:
        ids = [tuple(lat.expand(s[0]).tolist()) for s in segs]
        assert len(set(ids)) == 3 and segs[0][2] > segs[1][2] > segs[2][2]
        first[ids[0]] += 1
        for i, s in zip(ids, segs):
            weight[i] += 1 / s[3] / n
    p = {tuple(lat.expand(s[0]).tolist()): np.exp(s[1]) for segs in found for s in segs}
    for i, _ in first.most_common(2):
        assert first[i] / n == pytest.approx(p[i], abs=0.02) and weight[i] == pytest.approx(1, abs=0.02)


def test_pipeline(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
        if name == "quality rules":
            bad = {r["doc_id"] for r in quality_rules.judge(docs).filter("not kept").collect()}
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
        if name == "exact dedup":
            assert len({lower(r["text"]) for r in kept.collect()}) == kept.count()
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
            assert all(i == c for i, _, c in brute_links(rows))
    assert kept.count() > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).cache()
    assert pieces.filter("not round_trip").count() == 0
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_texts_of_megabytes(spark):
    rng = np.random.default_rng(20)
    names = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(500)]
    long = " ".join(rng.choice(names, 300_000)) + " token = k3Jq9zTt7Lw2Xv8Bn4Rd"
    assert len(long) > 2_000_000
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, long.upper()), (4, "w" * 1_500_000), (5, "short")], "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    kept = {r["doc_id"]: r for r in exact_dedup.verdicts(df).collect()}
    assert kept[1]["keep_id"] == 3 and kept[3]["text_sha256"] == kept[1]["text_sha256"] and kept[2]["group_size"] == 1
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()}
    words_of = lower(long).split()
    assert near[1] == (len({tuple(words_of[i : i + 5]) for i in range(len(words_of) - 4)}), 1) and near[2][1] == near[3][1] == 1 and near[4] == (1, 4)
    rules = {r["doc_id"]: r["n_words"] for r in quality_rules.judge(df).collect()}
    assert rules == {1: 300_003, 2: 300_004, 3: 300_003, 4: 1, 5: 1}
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df)).collect()}
    at = long.index("token")
    assert spans[1].startswith(f"assign:{at}:{len(long)}") and spans[5] == ""
    vectors, net = quality_model.train(df, spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, quality int"))
    assert quality_model.score(df, vectors, net).count() == 5
    pieces = piece_sampling.sampled(df.filter("doc_id in (2, 4, 5)"), PIECE_MODEL, k=1).cache()
    assert pieces.filter("round_trip").count() == 3
    assert mixing.weigh(df, spark.createDataFrame([(1, "a"), (5, "b")], "doc_id bigint, domain string"), {"a": 0.5, "b": 0.5}).count() == 5
    assert sharding.hilbert_shards(sharding.document_rows(df), ["size"], ["doc_id"], 2).filter("size > 2000000").count() == 3


def test_repeats_labels_and_names(spark):
    """Repeated rows, several labels of a row, null owners, and columns named as the operators' own."""
    rows = [(i % 7, ["good words here", "bad stuff there *** token=k3Jq9zTt7Lw2Xv8Bn4Rd"][i % 2] + " more" * i, None if i % 3 else "s", None) for i in range(14)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    for c in ("id", "x", "y", "row", "found", "value", "kind", "start", "end", "value_hash", "cell", "rate", "tokens", "n", "owner", "repository", "t", "sha1", "keep", "payload", "digest", "node", "component", "list", "score"):
        df = df.withColumn(c, F.lit("own"))
    labels = spark.createDataFrame([(0, 1, "a"), (0, 0, "b"), (1, 0, "b"), (2, 1, None), (3, None, "a"), (None, 1, "a"), (5, 1, "a"), (5, 1, "a")], "doc_id bigint, quality int, domain string")
    vectors, net = quality_model.train(df, labels)
    scores = quality_model.score(df, vectors, net).collect()
    assert len(scores) == 28 and all(0 <= r["score"] <= 1 for r in scores)
    by_row = collections.Counter((r["doc_id"], r["score"]) for r in scores)
    assert set(by_row.values()) == {2}
    out = mixing.weigh(df, labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(out) == 28 and mixing.mix(df, labels, {"a": 0.5, "b": 0.5}).columns == df.columns
    spans = secrets.digest(secrets.scan(df)).collect()
    assert len(spans) == 28 and sum(r["n_assign"] for r in spans) == 14
    assert sum("live" in r["spans"] for r in spans) == 14  # owners: s and null, each one repository
    assert quality_rules.keep(df).columns == jaccard_join.one_of_each(df).columns == exact_dedup.deduplicate(df).columns == df.columns
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.net/es/"), "text").alias("url"), F.col("text").alias("html"), "id", "sha1", "keep", "payload", "digest").withColumns({"host": F.lit("h"), "items": F.lit("i"), "says": F.lit("s"), "rule": F.lit("r")})
    judged = url_filter.judge(pages, spark.createDataFrame([(1, True), (1, False), (2, None), (None, True)], "page_id bigint, bad boolean"), min_count=1)
    assert judged.count() == 28 and judged.filter("verdict = 'block' and rule = 'net/es/'").count() == 28


def test_warc_takes_any_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x", "own", "own"), (1, "u", "x", "own", "own")], "page_id bigint, url string, html string, sha1 string, keep string")
    warc.write(pages, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in warc.digests(warc.read(spark, str(tmp_path / "w"))).collect()) == [(1, 1, hashlib.sha1(b"x").hexdigest(), "response", None)] * 2
