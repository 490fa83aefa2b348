"""Masking and smoothing of symbol sequences.

Masks are drawn for whole sequences by table operations. Filling walks a sequence from left to right, so a sequence is cut
into chunks of bounded size, and what a chunk hands on to the next is worked out first: results don't depend on chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.sampling import draw, least_by_draw
from seqloom.storage import CHUNK, by_chunk, chunked, positioned, running_sum, stored


def _spans(sizes: DataFrame, key: str, span: tuple[int, int], seed: int, count: str, factor: float) -> DataFrame:
    """(key, i, a, z): spans [a, z) in the order of their draws; more than the quota should need, by a factor that grows while it doesn't."""
    low, high = span
    if count == "masked":
        share = F.least(F.lit(0.99), (F.col("n_token") + F.col("n_span")) / F.col("T"))
        n = F.ceil(F.lit(-factor) * F.col("T") / F.lit((low + high) / 2) * F.log(1 - share)) + 20
    else:
        n = F.ceil(F.col("n_span") / F.least(F.lit(low), F.col("T")))
    rows = sizes.filter("n_span > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    length = F.lit(low) + draw(seed + 2, key, "i") % F.lit(high - low + 1)
    rows = rows.withColumn("len", length)
    room = F.col("T") if count == "masked" else F.greatest(F.lit(1), F.col("T") - F.col("len"))
    rows = rows.withColumn("a", draw(seed + 1, key, "i") % room)
    return rows.select(key, "i", "a", F.least(F.col("a") + F.col("len"), F.col("T")).alias("z"))


def masked(
    df: DataFrame,
    key: str,
    order: list[str],
    symbol: str,
    token_ratio: float = 0.075,
    span_ratio: float = 0.075,
    span: tuple[int, int] = (2, 5),
    seed: int = 4,
    count: str = "masked",
) -> DataFrame:
    """(key, pos, symbol, masked): in each sequence of T rows, int(T * token_ratio) rows of the least draws, then spans of `span` rows, in the order of
    their draws, until int(T * span_ratio) more are reached; the last span may go beyond. count: by rows 'masked' besides the tokens, or by
    the 'summed' lengths of spans, which counts overlaps twice. A sequence is masked whole where the quotas ask for more than it has.
    """
    rows = positioned(df.select(key, *order, F.col(symbol).cast("int").alias("symbol")), key, order).select(key, "pos", "symbol")
    rows = stored(rows, "sequence")
    sizes = rows.groupBy(key).agg(F.count("*").alias("T")).filter(F.col(key).isNotNull())
    sizes = sizes.withColumn("n_token", F.least("T", F.floor(F.col("T") * F.lit(token_ratio))))
    sizes = stored(sizes.withColumn("n_span", F.least(F.col("T") - F.col("n_token"), F.floor(F.col("T") * F.lit(span_ratio)))), "sizes")
    # tables of a row a symbol or a mark: packed on disk they look small enough to broadcast, unpacked they aren't, so their joins are told to sort
    tokens = stored(least_by_draw(rows.select(key, "pos").hint("merge"), [key], sizes.select(key, F.col("n_token").alias("__keep")), "pos", seed, [key, "pos"]), "tokens")
    factor = 1.5
    while True:
        spans = stored(_spans(sizes, key, span, seed, count, factor), "spans")
        covered = spans.select(key, "i", F.explode(F.sequence("a", F.col("z") - 1)).alias("pos")).groupBy(key, "pos").agg(F.min("i").alias("i"))
        covered = stored(covered.join(tokens.hint("merge"), [key, "pos"], "left_anti"), "covered")
        if count != "masked":
            break
        short = covered.groupBy(key).agg(F.count("*").alias("n")).join(sizes.filter("n_span > 0"), key, "right").filter(F.coalesce("n", F.lit(0)) < F.col("n_span"))
        if short.isEmpty():
            break
        factor *= 2
    if count == "masked":  # the span that covers the last row that the quota needs is the last one
        placed = positioned(covered.withColumnRenamed("pos", "at"), key, ["i", "at"], "reached").withColumnRenamed("pos", "reached")
        last = placed.join(sizes.select(key, "n_span"), key).filter("reached = n_span - 1").select(key, F.col("i").alias("last"))
    else:
        reached = running_sum(spans.withColumn("len", F.col("z") - F.col("a")), key, ["i"], "len").join(sizes.select(key, "n_span"), key)
        last = reached.filter("sum >= n_span").groupBy(key).agg(F.min("i").alias("last"))
    marks = tokens.unionByName(covered.join(last, key).filter("i <= last").select(key, "pos")).withColumn("masked", F.lit(True))
    return rows.join(marks.hint("merge"), [key, "pos"], "left").select(key, "pos", "symbol", F.coalesce("masked", F.lit(False)).alias("masked"))


def filled(df: DataFrame, key: str, order: list[str], symbol: str, mask: str, matrix: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(key, pos, symbol, masked, filled): each masked symbol becomes the one of greatest P(z | previous) P(next | z). The previous one is as filled,
    the next one as it was; at an end its factor is left out.

    A row depends on the run of masked rows that it is in and on the row before that run. A chunk hands on the symbol that its last row
    gets; a chunk that is masked from end to end hands on what it would be after each symbol before, and those are put together.
    """
    coded = F.when(F.col(mask), -1 - F.col(symbol).cast("int")).otherwise(F.col(symbol).cast("int")).alias("coded")
    rows = chunked(df.select(key, *order, coded), key, order, before=1, after=1, chunk=chunk)
    rows = stored(rows.select(key, "chunk", "pos", "halo", "coded"), "coded")
    kind, states, best = dict(df.dtypes)[key], len(matrix), {}

    def choice(before: int | None, after: int | None) -> int:
        if (before, after) not in best:
            p = np.ones(states)
            if before is not None:
                p = p * matrix[before]
            if after is not None:
                p = p * matrix[:, after]
            best[before, after] = int(p.argmax())
        return best[before, after]

    def walk(hidden: np.ndarray, plain: np.ndarray, first: int, last: int, before: int | None) -> list[int]:
        """What rows first to last, all masked, become."""
        out = []
        for i in range(first, last):
            before = choice(before, int(plain[i + 1]) if i + 1 < len(plain) else None)
            out.append(before)
        return out

    def parts(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values("pos")
        coded, halo = pdf["coded"].to_numpy(), pdf["halo"].to_numpy()
        hidden = coded < 0
        return pdf, hidden, np.where(hidden, -1 - coded, coded), int(halo[0]), len(halo) - int(len(halo) > 1 and halo[-1])

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, hidden, plain, a, z = parts(pdf)
        if z <= a:  # a copy of the last row of a sequence that ends with its chunk
            return pd.DataFrame({key: pdf[key].iloc[:0], "chunk": pdf["chunk"].iloc[:0], "state": pd.Series([], dtype=object)})
        if not hidden[z - 1]:
            state = [int(plain[z - 1])]
        else:
            shown = np.flatnonzero(~hidden[:z])
            if len(shown):
                state = walk(hidden, plain, shown[-1] + 1, z, int(plain[shown[-1]]))[-1:]
            elif a:  # masked from end to end, behind a masked row
                state = [walk(hidden, plain, a, z, s)[-1] for s in range(states)]
            else:
                state = walk(hidden, plain, 0, z, None)[-1:]
        return pd.DataFrame({key: pdf[key].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "state": [state]})

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, carry = pdf.sort_values("chunk"), 0, []
        for state in pdf["state"]:
            now = int(state[0] if len(state) == 1 else state[now])
            carry.append(now)
        return pd.DataFrame({key: pdf[key], "chunk": pdf["chunk"] + 1, "carry": carry})

    several = rows.filter("chunk > 0").select(key).distinct()
    states_of = by_chunk(rows.join(several, key, "left_semi"), key).groupBy(key, "chunk").applyInPandas(handed, f"`{key}` {kind}, chunk bigint, state array<int>")
    carry = states_of.groupBy(key).applyInPandas(put_together, f"`{key}` {kind}, chunk bigint, carry int")  # a row a chunk

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, hidden, plain, a, _ = parts(pdf)
        out = plain.copy()
        if a and hidden[0]:
            out[0] = int(pdf["carry"].iloc[0])
        for i in np.flatnonzero(hidden):
            if i >= a:
                out[i] = choice(int(out[i - 1]) if i else None, int(plain[i + 1]) if i + 1 < len(plain) else None)
        return pd.DataFrame({key: pdf[key], "pos": pdf["pos"], "halo": pdf["halo"], "symbol": plain.astype("int32"), "masked": hidden, "filled": out.astype("int32")})

    done = by_chunk(rows.join(carry, [key, "chunk"], "left"), key).groupBy(key, "chunk").applyInPandas(fill, f"`{key}` {kind}, pos bigint, halo boolean, symbol int, masked boolean, filled int")
    return done.filter("not halo").drop("halo")


def _times(f: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """f applied n times to x, by squares of f."""
    n, x = n.copy(), x.copy()
    while (n > 0).any():
        odd = (n & 1) == 1
        x[odd] = f[x[odd]]
        f, n = f[f], n >> 1
    return x


def smoothed(df: DataFrame, key: str, order: list[str], symbol: str, matrix: np.ndarray, marginal: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(key, pos, symbol, smooth): negative (masked) symbols are filled forwards from the one before, then backwards from the one behind, then by the
    marginal's best.

    So a row is the most likely follower, as many times as it is away, of the last known symbol, or else the most likely
    forerunner of the sequence's first; the last known symbol in front of a chunk is joined to it.
    """
    best, back, common = matrix.argmax(1), matrix.argmax(0), int(marginal.argmax())
    rows = chunked(df.select(key, *order, F.col(symbol).cast("int").alias("symbol")), key, order, chunk=chunk).select(key, "chunk", "pos", "symbol")
    rows = stored(rows, "symbols")
    known = F.when(F.col("symbol") >= 0, F.struct("pos", "symbol"))
    chunks = rows.groupBy(key, "chunk").agg(F.max(known).alias("last"), F.min(known).alias("first"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    hints = chunks.select(key, "chunk", F.last("last", ignorenulls=True).over(before).alias("last"), F.min("first").over(every).alias("first"))
    hints = hints.select(key, "chunk", *(F.coalesce(F.col(f"{w}.{c}").cast("bigint"), F.lit(-1)).alias(f"{w}_{c}") for w in ("last", "first") for c in ("pos", "symbol")))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, out = pdf["pos"].to_numpy(), pdf["symbol"].to_numpy().astype(np.int64)
        last_pos, last_symbol, first_pos, first_symbol = (int(pdf[c].iloc[0]) for c in ("last_pos", "last_symbol", "first_pos", "first_symbol"))
        at = np.maximum.accumulate(np.where(out >= 0, np.arange(len(out)), -1))
        from_pos = np.where(at >= 0, pos[at], last_pos)
        from_symbol = np.where(at >= 0, out[at], last_symbol)
        todo = (out < 0) & (from_symbol >= 0)
        lead = (out < 0) & (from_symbol < 0)
        out[todo] = _times(best, pos[todo] - from_pos[todo], from_symbol[todo])
        out[lead] = _times(back, first_pos - pos[lead], np.full(int(lead.sum()), first_symbol)) if first_symbol >= 0 else common
        return pd.DataFrame({key: pdf[key], "pos": pos, "symbol": pdf["symbol"], "smooth": out.astype("int32")})

    # each row has its hints; a left join, for rows look small enough to broadcast when packed, but aren't
    dealt = by_chunk(rows.filter(F.col(key).isNotNull()), key).join(hints, [key, "chunk"], "left")
    return dealt.groupBy(key, "chunk").applyInPandas(smooth, f"`{key}` {dict(df.dtypes)[key]}, pos bigint, symbol int, smooth int")


def predicted_pattern(df: DataFrame, keys: list[str], centroids: np.ndarray, dims: int, vector: str = "feature") -> DataFrame:
    """(keys, pattern): the centroid nearest to each key's mean vector."""
    from seqloom.operators.cluster import encode
    from seqloom.operators.stats import centroids as means

    return encode(means(df, keys, dims, vector), centroids, "centroid", "pattern").select(*keys, "pattern")


def target_pattern(source: DataFrame, patterns: DataFrame, how: str = "farthest", seed: int = 2, fixed: int | None = None) -> DataFrame:
    """source (pattern, ...) with target out of patterns (pattern, centroid, attributes): the farthest other one, a random one, a fixed one, or that
    of the largest summed difference of attributes. Patterns are few."""
    from seqloom.functions import vec

    if how == "fixed":
        return source.withColumn("target", F.lit(fixed))
    mine = patterns.select(F.col("pattern"), F.col("centroid").alias("__c"), F.col("attributes").alias("__a"))
    other = patterns.select(F.col("pattern").alias("target"), F.col("centroid").alias("__oc"), F.col("attributes").alias("__oa"))
    pairs = mine.join(F.broadcast(other), F.col("pattern") != F.col("target"))
    score = {"farthest": vec.l2(F.col("__c"), F.col("__oc")), "attributes": vec.total(F.transform(vec.minus(F.col("__a"), F.col("__oa")), F.abs)), "random": draw(seed, "pattern", "target").cast("double")}[how]
    best = pairs.groupBy("pattern").agg(F.max_by("target", F.struct(F.round(score, 9), -F.col("target"))).alias("target"))
    return source.join(F.broadcast(best), "pattern", "left")
