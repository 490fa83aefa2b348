"""Quality rules by distribution divergence.

A document's histograms of character classes, of its language's common words and of marks (words without a letter or
digit, such as the separators of a link list, against all others) are compared with the references of its language by
the Jensen-Shannon distance (square root of the divergence with logarithms to base 2; 0 to 1). A language's common words
are the `frequent` most frequent ones of all its documents, made of a-z and non-ASCII characters after lower-casing
A-Z; ties go to the first by bytes. Guards: a histogram is only judged if the document has at least min_chars letters, signs and digits or
min_words words. A language's reference is the mean of the histograms of its documents that are long enough, drawn to that of all languages
by the weight of `prior_docs` documents, and that in turn to a prior of prose. So the reference of a small language, or of a small
table, goes over to what prose is like, and no number of documents turns a rule on or off.

Word rules stand in front: fewer than base_words words, or 100 * repeated words > base_repeats * words.

Defined results: a null or empty text has no words and is rejected for that; a null language is a language of its
own; repeated rows are judged each; an empty table gives an empty result. Words are runs of bytes other than
space and 0x09 to 0x0D.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import freed, list_array, row_key, stored, utf8

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
#: Character classes: a name and the bytes in it. What is left of each multi-byte character is its lead byte, in "wide".
CLASSES = ("lower", "upper", "digit", "white", "stop", "symbol", "other", "wide")
#: The bytes of a mark: those of ASCII but for letters and digits.
MARKS = bytes(c for c in range(0x80) if not chr(c).isalnum())


#: References of so many languages are broadcast; more are joined by a shuffle.
MOST_LANGUAGES = 10_000


#: Distances of the verdict: the least, and the slack that is divided by the root of what the histogram counts.
CHARS_LIMIT, COMMON_LIMIT, MARKS_LIMIT = (0.22, 2.0), (0.30, 1.2), (0.20, 0.6)


#: What prose is like: its shares of the character classes, of marks and other words, and of the k-th common word, which falls as
#: 1 / (k + 2.7), with COMMON_PRIOR of all words together.
CHARS_PRIOR, MARKS_PRIOR, COMMON_PRIOR = (0.76, 0.04, 0.01, 0.16, 0.025, 0.0, 0.0, 0.005), (0.01, 0.99), 0.45


def priors(frequent: int) -> dict[str, list[float]]:
    falling = [1 / (k + 2.7) for k in range(1, frequent + 1)]
    return {"chars": list(CHARS_PRIOR), "common": [COMMON_PRIOR * x / sum(falling) for x in falling] + [1 - COMMON_PRIOR], "marks": list(MARKS_PRIOR)}


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), dtype=np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[[ord(c) for c in WHITE]] = CLASSES.index("white")
    t[[ord(c) for c in ".,;:!?'\"()-"]] = CLASSES.index("stop")
    t[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
    t[0x80:0xC0] = len(CLASSES)  # continuation bytes
    t[0xC0:] = CLASSES.index("wide")
    return t


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words that lie in a window of width words that the text has twice or more."""
    if len(ids) <= width:
        return 0
    keys = ids[: len(ids) - width + 1].astype(np.int64)
    for k in range(1, width):
        if distinct < 2_000_000 and width == 3:
            keys = keys * distinct + ids[k : len(ids) - width + 1 + k]
        else:  # keeps the keys small whatever the vocabulary
            keys = np.unique(keys, return_inverse=True)[1] * np.int64(distinct) + ids[k : len(ids) - width + 1 + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", frequent: int = 32, held: int = 100_000) -> DataFrame:
    """(lang, list): the most frequent words of each language over all its documents. Tasks count up to `held` words before they send them."""
    word = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[str | None, Counter] = {}

        def out() -> pa.RecordBatch:
            found = [(k, w, n) for k, c in times.items() for w, n in c.items() if word.fullmatch(w)]
            times.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                times.setdefault(k, Counter()).update(t.as_py().lower().split())
                if sum(map(len, times.values())) > held:
                    yield out()
        yield out()

    counted = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), utf8(text).alias("text")).mapInArrow(freed(count), "lang string, word binary, n bigint")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # a limit of so many rows a group is taken before the shuffle too
    top = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= frequent)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("list"))


def measures(docs: DataFrame, lists: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", frequent: int = 32) -> DataFrame:
    """Counts and histograms of each document. lists: (lang, list) of common words, `frequent` at most; the last bin has the other words."""
    classes, symbols = _class_table(), [s.encode() for s in SYMBOLS]

    def one(t: bytes, at: dict[bytes, int]) -> tuple:
        raw = np.bincount(classes[np.frombuffer(t, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
        words = t.split()
        places: dict[bytes, int] = {}
        ids = np.array([places.setdefault(w, len(places)) for w in words], dtype=np.int64)
        times = np.bincount(ids, minlength=len(places) + 1) if len(ids) else np.zeros(1, np.int64)
        n, marks, common = len(words), 0, [0] * frequent + [len(words)]
        for w, i in places.items():
            if (k := at.get(w.lower())) is not None:
                common[k] += int(times[i])
                common[-1] -= int(times[i])
            elif not w.strip(MARKS):
                marks += int(times[i])
        seen, dup = set(), 0
        for line in t.split(b"\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        return n, int(raw.sum() - raw[CLASSES.index("white")]), sum(map(t.count, symbols)), dup, repeated_words(ids, max(1, len(places))), raw, common, [marks, n - marks]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict[bytes, int]] = {}
        for b in batches:
            if not len(b):
                continue
            langs = b.column(1).to_pylist()
            for i, k in enumerate(langs):
                if k not in known:
                    known[k] = {w: j for j, w in enumerate(b.column(3)[i].as_py() or [])}
            *counts, raw, common, marks = zip(*(one(t.as_py(), known[k]) for t, k in zip(b.column(2), langs)))
            lists = [list_array(np.concatenate(x).astype(np.int64), list(map(len, x)), pa.int64()) for x in (raw, common, marks)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), *lists], ["doc_id", "lang", *NUMBERS, "chars", "common", "marks"])

    found = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), utf8(text).alias("text"))
    found = found.join(_few(lists.withColumnRenamed("lang", "__lang")), F.col("lang").eqNullSafe(F.col("__lang")), "left").select("doc_id", "lang", "text", "list")
    return found.mapInArrow(freed(rows), f"doc_id bigint, lang string, {', '.join(f'{c} bigint' for c in NUMBERS)}, chars array<bigint>, common array<bigint>, marks array<bigint>")


def _few(by_language: DataFrame) -> DataFrame:
    """A stored table of a row a language, marked to be broadcast if it is small."""
    by_language = stored(by_language, "by-language")
    return F.broadcast(by_language) if by_language.count() <= MOST_LANGUAGES else by_language


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two distributions over the same bins."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(measured: DataFrame, name: str, least: Column, key: str | None = "lang") -> DataFrame:
    """(<name>_lang, <name>_ref, <name>_docs): the mean histogram of each language, or with key None of all, over its documents for which least holds."""
    of = F.col(key) if key else F.lit(None).cast("string")
    long = measured.filter(least).select(of.alias("lang"), F.posexplode(_share(F.col(name))).alias("i", "v"))
    bins = long.groupBy("lang", "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    ref = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return bins.groupBy("lang").agg(ref.alias(f"{name}_ref"), F.max("n").alias(f"{name}_docs")).withColumnRenamed("lang", f"{name}_lang")


def _drawn(mean: Column, docs: Column, base: Column, weight: int) -> Column:
    """The mean over so many documents, drawn to a base by the weight of some more."""
    return F.zip_with(mean, base, lambda a, b: (docs * a + weight * b) / (docs + weight))


def judge(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    base_words: int = 50,
    base_repeats: int = 50,
    max_chars_distance: tuple[float, float] = CHARS_LIMIT,
    max_common_distance: tuple[float, float] = COMMON_LIMIT,
    max_marks_distance: tuple[float, float] = MARKS_LIMIT,
    min_chars: int = 200,
    min_words: int = 50,
    prior_docs: int = 20,
    frequent: int = 32,
) -> DataFrame:
    """One row per document: the counts, base_failed, the three distances (null where a guard holds) and kept.

    A distance speaks against a document above least + slack / sqrt(n), n its characters in words or its words: a
    histogram of few of them is far from any reference by chance.
    """
    measured = stored(measures(docs, common_words(docs, text, lang, frequent), text, doc_id, lang, frequent), "measures")
    guards = {"chars": F.col("word_chars") >= min_chars, "common": F.col("n_words") >= min_words, "marks": F.col("n_words") >= min_words}
    out = measured
    for name, least in guards.items():
        out = out.join(_few(references(measured, name, least)), F.col("lang").eqNullSafe(F.col(f"{name}_lang")), "left")
        of_all = references(measured, name, least, None).first()  # one row of a few numbers
        prior, n = priors(frequent)[name], of_all[f"{name}_docs"] if of_all else 0
        base = [(n * m + prior_docs * p) / (n + prior_docs) for m, p in zip(of_all[f"{name}_ref"] if of_all else prior, prior)]
        base = F.array(*map(F.lit, base))
        drawn = F.coalesce(_drawn(F.col(f"{name}_ref"), F.col(f"{name}_docs"), base, prior_docs), base)
        out = out.withColumn(f"{name}_distance", F.when(least, js_distance(_share(F.col(name)), drawn)))
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_repeats * F.col("n_words"))
    limits = [("chars_distance", "word_chars", max_chars_distance), ("common_distance", "n_words", max_common_distance), ("marks_distance", "n_words", max_marks_distance)]
    far = [F.coalesce(F.col(d) > F.lit(least) + F.lit(slack) / F.sqrt(n), F.lit(False)) for d, n, (least, slack) in limits]
    out = out.withColumn("base_failed", failed).withColumn("kept", ~reduce(lambda a, b: a | b, far, failed))
    return out.select("doc_id", *NUMBERS, "base_failed", "kept", "chars_distance", "common_distance", "marks_distance")


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", **rules) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each row is judged by itself, also where identifiers are null or repeat."""
    rows, key = row_key(docs, doc_id)
    bad = judge(rows, text, key, lang, **rules).filter("not kept").select(F.col("doc_id").alias("__bad"))
    return rows.join(bad, F.col(f"`{key}`") == F.col("__bad"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
