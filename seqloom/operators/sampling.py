"""Seeded, deterministic filters and samples. Draws are hashes of identifiers, so they depend on neither partitions nor order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.storage import positioned


def drawn(seed: int, *columns: str) -> Column:
    """A hash that orders rows at random: the MD5 of seed and identifiers, which other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Rows that have the wanted value in each column that is asked for; a null counts as 'unknown', None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.coalesce(F.col(column).cast("string"), F.lit("unknown")) == str(value))
    return df


def without_silence(df: DataFrame, label: str, silence: list) -> DataFrame:
    return df.filter(~F.col(label).isin(silence))


def valid_labels(df: DataFrame, key: str, label: str, least: int, most: int, long: int = 10) -> DataFrame:
    """Rows of keys whose labels are within [least, most] and, in keys of more than `long` rows, not all the same."""
    facts = df.groupBy(key).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    good = facts.filter((F.col("lo") >= least) & (F.col("hi") <= most) & ((F.col("n") <= long) | (F.col("lo") < F.col("hi"))))
    return df.join(good.select(key), key, "left_semi")


def least_rows(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least so many."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key), key, "left_semi")


def every(df: DataFrame, order: list[str], target: int) -> DataFrame:
    """About target rows, evenly spaced in order: those at int(i * step), step = n / target."""
    rows = positioned(df.withColumn("__all", F.lit(0)), "__all", order).drop("__all")
    n = rows.count()
    if target >= n:
        return rows
    step = n / target
    i = F.ceil(F.col("pos") / F.lit(step))
    return rows.filter((i < target) & (F.floor(i * F.lit(step)) == F.col("pos")))


def top_of_group(df: DataFrame, group: str | list[str], order: list[Column], keep: Column | int) -> DataFrame:
    """The first `keep` rows of each group in an order; Spark cuts groups before the shuffle where keep is a number."""
    group = [group] if isinstance(group, str) else group
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= keep).drop("__rank")


def least_by_draw(df: DataFrame, group: list[str], keep: DataFrame, id: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """The rows of each group that a draw by (seed, id) puts first, as many as keep (group, __keep) says; groups that keep lacks are left out. by:
    columns of the draw instead of id.

    Rows are counted by group and the first 12 bits of their draw. Of the slice in which a group's number is reached, the
    first rows are taken; slices are 1/4096 of a group, so a group of any size is spread over tasks.
    """
    rows = df.withColumn("__draw", drawn(seed, *(by or [id]))).withColumn("__slice", F.substring("__draw", 1, 3))
    counts = rows.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before)
    wanted = (counts.join(keep, group) if group else counts.crossJoin(F.broadcast(keep))).filter("__before < __keep").select(*group, "__slice", (F.col("__keep") - F.col("__before")).alias("__left"))
    place = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy("__draw", id))
    return rows.join(wanted, [*group, "__slice"]).withColumn("__place", place).filter("__place <= __left").select(*df.columns)


def balanced(df: DataFrame, group: str, target: int, id: str, seed: int = 42) -> DataFrame:
    """max(1, target // groups) rows of each group, then target rows at most, in the order of ids."""
    groups = df.select(group).distinct().count()
    some = top_of_group(df, group, [drawn(seed, id), F.col(id)], max(1, target // max(groups, 1)))
    if groups <= target:
        return some
    return positioned(some.withColumn("__all", F.lit(0)), "__all", [id]).filter(F.col("pos") < target).drop("__all", "pos")


def share(df: DataFrame, ratio: float, id: str, seed: int = 42) -> DataFrame:
    """int(n * ratio) rows."""
    return least_by_draw(df, [], df.agg(F.floor(F.count("*") * F.lit(ratio)).alias("__keep")), id, seed)


def share_of_group(df: DataFrame, group: str, ratio: float, id: str, seed: int = 42) -> DataFrame:
    """max(1, int(n * ratio)) rows of each group."""
    return least_by_draw(df, [group], df.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("__keep")), id, seed)


def quota(df: DataFrame, group: str, quotas: dict, id: str, seed: int = 42) -> DataFrame:
    """As many rows of each group as its quota says, all where there are fewer; groups without a quota are left out."""
    keep = df.sparkSession.createDataFrame(list(quotas.items()), f"`{group}` {dict(df.dtypes)[group]}, __keep bigint")
    return least_by_draw(df, [group], F.broadcast(keep), id, seed)


def disjoint_pools(
    speakers: DataFrame,
    present: DataFrame | None,
    n_pools: int = 4,
    per_gender: int = 50,
    id: str = "speaker",
    gender: str = "gender",
    seed: int = 42,
    genders=("m", "f"),
) -> DataFrame:
    """(id, gender, pool): speakers dealt to pools of per_gender of each of the genders. Raises ValueError if there are too few of one, or none.
    present: ids that have data."""
    some = speakers if present is None else speakers.join(present.select(id).distinct(), id, "left_semi")
    some = some.filter(F.col(gender).isin(list(genders)))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(gender).orderBy(drawn(seed, id), id)))
    out = ranked.filter(F.col("rank") <= n_pools * per_gender)
    found = dict(map(tuple, out.groupBy(gender).agg(F.count("*").alias("n")).collect()))
    if short := {g: found.get(g, 0) for g in genders if found.get(g, 0) < n_pools * per_gender}:
        raise ValueError(f"too few speakers: {short} of {n_pools * per_gender}")
    return out.select(id, gender, F.floor((F.col("rank") - 1) / per_gender).cast("int").alias("pool"))


def draw(seed: int, *columns) -> Column:
    """A whole number below 2**32, drawn by MD5 of seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("bigint")


def spaced_segments(utterances: DataFrame, n_segments: int, width: int, at_random: bool = True, seed: int = 42) -> DataFrame:
    """(segment, start, end) of contiguous frames out of [0, total): drawn or evenly spaced."""
    total = utterances.agg(F.sum("num_frames")).first()[0] or 0
    ids = utterances.sparkSession.range(n_segments).withColumnRenamed("id", "segment")
    room = max(1, total - width + 1)
    start = draw(seed, "segment") % F.lit(room) if at_random else F.floor(F.col("segment") * F.lit(max(0, total - width)) / F.lit(max(1, n_segments - 1)))
    return ids.withColumn("start", start.cast("bigint")).withColumn("end", F.least(F.col("start") + width, F.lit(total).cast("bigint")))


def strided(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every step-th row so that at most `most` are left."""
    rows = positioned(df.withColumn("__all", F.lit(0)), "__all", order).drop("__all")
    step = max(1, rows.count() // most)
    return rows.filter((F.col("pos") % step == 0) & (F.col("pos") < most * step))


def interleaved(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with turn, their place within the group; ordered by (turn, group) they go round the groups."""
    return positioned(df, group, order).withColumnRenamed("pos", "turn")


def proportional(df: DataFrame, key: str, group: str, most: int, id: str, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, from each key in proportion to its share of the group."""
    sizes = df.groupBy(group, key).agg(F.count("*").alias("n"))
    totals = sizes.groupBy(group).agg(F.sum("n").alias("total"))
    keep = sizes.join(totals, group).withColumn("__keep", F.greatest(F.lit(1), F.floor(F.col("n") * F.least(F.lit(1.0), most / F.col("total")))))
    before = F.sum("__keep").over(Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    keep = keep.withColumn("__keep", F.greatest(F.lit(0), F.least("__keep", most - F.coalesce(before, F.lit(0))))).select(group, key, "__keep")
    return least_by_draw(df, [group, key], keep, id, seed)


def train_test(df: DataFrame, id: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """df with is_train, drawn by hash."""
    return df.withColumn("is_train", F.conv(F.substring(drawn(seed, id), 1, 8), 16, 10).cast("bigint") < F.lit(int(train * 2**32)))


def majority(df: DataFrame, key: str, column: str, wanted) -> DataFrame:
    """Rows of keys more than half of whose rows have the wanted value; all rows if there is no such key."""
    good = df.groupBy(key).agg(F.avg((F.col(column) == F.lit(wanted)).cast("double")).alias("s")).filter("s > 0.5").select(key)
    return df.join(good, key, "left_semi") if good.limit(1).count() else df


def prototype_budget(counts: DataFrame, label: str, budget: int, by: str | None = None) -> DataFrame:
    """(by, label, keep): max(1, int(budget * n / total)) each while the budget lasts, by label; what is left goes to the most frequent, one each.
    With `by`, each of its values has a budget of its own."""
    own = [by] if by else []
    all_of = Window.partitionBy(*own)
    counts = counts.withColumn("total", F.sum("n").over(all_of))
    want = F.greatest(F.lit(1), F.floor(F.lit(budget) * F.col("n") / F.col("total")))
    before = Window.partitionBy(*own).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    got = counts.withColumn("want", want).withColumn("keep", F.greatest(F.lit(0), F.least("want", budget - F.coalesce(F.sum("want").over(before), F.lit(0)))))
    rest = F.greatest(F.lit(0), F.lit(budget) - F.sum("keep").over(all_of))
    turn = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("n"), label))
    return got.withColumns({"rest": rest, "turn": turn}).select(*own, label, (F.col("keep") + (F.col("turn") <= F.col("rest")).cast("int")).cast("bigint").alias("keep"))


def first_utterances(utterances: DataFrame, n: int, id: str = "utt_id") -> DataFrame:
    """The first n by id. Spark keeps n rows a task and merges them."""
    return utterances.orderBy(id).limit(n)


def batches_by_duration(utterances: DataFrame, batch: int, duration: str = "duration_sec", id: str = "utt_id") -> DataFrame:
    """utterances with batch and place in it, in the order of duration, so that a batch needs little padding."""
    rows = positioned(utterances.withColumn("__all", F.lit(0)), "__all", [duration, id]).drop("__all")
    return rows.withColumns({"batch": F.floor(F.col("pos") / batch), "place": F.col("pos") % batch}).drop("pos")
