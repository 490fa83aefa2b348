"""Secret scan with corpus-wide ownership frequency.

Three kinds of candidates are searched in every whole text, leftmost and without overlap within a kind:
assignments, access keys and long hexadecimal runs. Every candidate's value is hashed. The hashes are counted over the
whole corpus by distinct owners and distinct repositories: a value that min_owners owners or min_repositories
repositories or more have is a widely copied example, whichever is met first; a value of fewer of both that looks alive
(long enough, letters and digits, many distinct characters, no placeholder word) is a credential of its owner, and a
`live` span over the value is added for it. A repository is a pair of the columns `owner` and `repository`, as on hosts
where two owners' repositories may have one name; without a repository column each owner is one repository. The query of
the documents table takes source as owner and lang as the part of it that stands for a repository.

Positions are code points. Regular expressions give no positions in SQL, so each match is taken with the gap in front
of it, and the running sum of their lengths is the position.

Only DataFrame operations run here. Equal values are counted by (value, owner, repository) before the shuffle. The copied
values are taken off the others by a broadcast while there are `few` at most, else by value and salt, so the most copied
value is never one task's.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one owner; rows that
repeat an identifier are scanned and returned each; an empty table gives an empty result; the value of a candidate is
compared as it stands, case included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import spread_join, stored

#: Kind -> (cheap test, pattern, group of the value, least length of the value).
KINDS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24}", "[0-9a-f]{24,}", 0, 24),
}
ADDED = "live"
PLACEHOLDERS = "(?i)(example|sample|changeme|placeholder|dummy|xxxx|your)"


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str | None = "lang") -> DataFrame:
    """A stored row per row of docs: row, doc_id, owner, repository and found, an array of every match with its kind, place in the kind, gap in front
    and value."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for k, (kind, (test, pattern, group, _)) in enumerate(KINDS.items()):
        whole = F.lit(r"\G(?s)(.*?)(" + pattern + ")")  # \G: no search begins anew behind the last match
        get = lambda g: F.regexp_extract_all(F.col("t"), whole, F.lit(g))  # noqa: E731, B023
        value = get(2 + group) if group else get(2)
        zipped = F.arrays_zip(F.transform(get(1), F.length).alias("gap"), F.transform(get(2), F.length).alias("len"), value.alias("value"))
        spans = F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")))  # noqa: B023
        parts.append(F.when(F.col("t").rlike(test), spans).otherwise(F.array().cast(SPANS)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{owner}`").cast("string").alias("owner"), (F.col(f"`{repository}`") if repository else F.lit(None)).cast("string").alias("repository"), t.alias("t"))
    out = rows.select("doc_id", "owner", "repository", F.concat(*parts).alias("found"))
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "secrets")


SPANS = "array<struct<k:int,kind:string,i:int,gap:int,len:int,value:string>>"


def positions(found: DataFrame) -> DataFrame:
    """A row per base span: row, owner, repository, k, kind, start, end, value."""
    each = found.select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    enough = reduce(lambda a, b: a | b, ((F.col("kind") == kind) & (F.length("value") >= least) for kind, (_, _, _, least) in KINDS.items()))
    return ends.filter(enough).select("row", "owner", "repository", "k", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, uses) over the whole corpus."""
    places = spans.groupBy(value_hash().alias("value_hash"), "owner", "repository").agg(F.count("*").alias("uses"))
    owners = places.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))


def value_hash() -> Column:
    return F.sha2("value", 256)


def looks_live(least: int = 16, distinct: int = 8) -> Column:
    v = F.col("value")
    return (F.length(v) >= least) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= distinct) & ~v.rlike(PLACEHOLDERS)


def copied_values(spans: DataFrame, min_owners: int, min_repositories: int) -> DataFrame:
    """The hashes of the values that so many owners or repositories have."""
    return ownership(spans).filter((F.col("owners") >= min_owners) | (F.col("repositories") >= min_repositories)).select("value_hash")


def scan(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    owner: str = "source",
    repository: str | None = "lang",
    min_owners: int = 3,
    min_repositories: int = 4,
    few: int = 100_000,
    salts: int = 32,
) -> DataFrame:
    """One row per row of docs: doc_id, base and added spans as arrays sorted by (start, kind), and counts."""
    found = candidates(docs, text, doc_id, owner, repository)
    base = stored(positions(found), "spans")
    copied = copied_values(base, min_owners, min_repositories)
    alive = spread_join(base.filter(looks_live()).withColumn("value_hash", value_hash()), copied, "value_hash", F.xxhash64("row", "start"), "left_anti", few, salts)
    alive = alive.select("row", F.lit(len(KINDS)).alias("k"), F.lit(ADDED).alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end").distinct()
    spans = base.select("row", "k", "kind", "start", "end").unionByName(alive)
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string>>")
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans of each document, as one row of scalars."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return scanned.select("doc_id", *(of(kind).alias(f"n_{kind}") for kind in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
