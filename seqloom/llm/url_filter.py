"""URL filter by association rules.

Urls become sets of tokens (labels of the host, segments of the path with digits folded, keys of the query). Spark's
FP-growth mines the sets of the labelled urls together with their label; rules `tokens -> block` that keep the least
support, the least confidence and the least lift over the share of bad urls are matched through an inverted index from
token to rule: a rule fires where as many of its tokens meet as it has. A list of host and path rules stands in front; the longest that fits decides.

Labels are given as (page_id, bad), or else are the verdicts of the listed rules: urls that the list blocks are bad, all
others, also those that it doesn't know, are not. So a rule blocks unknown urls only where most urls with its tokens
are blocked already.

Tokens that lie in the same labelled urls, no more and no less, are mined as one and a rule asks for all of them, so tokens that
always come together don't multiply the frequent sets. Mining costs what the remaining frequent sets cost, which the least support bounds.

Only DataFrame operations and Spark ML run here. Equal token sets are matched once, and the answers are joined back by a
broadcast while they are few, else by set and salt, so urls of one set are spread over tasks.

Defined results: a null url or one without `://` has an empty host and path and no tokens, no rule fires, verdict
allow; repeated rows are judged each; of several labels of a page a bad one holds, labels with a null are left out;
without labelled urls, or with an empty table, no rule is mined.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import spread_join, stored

#: Verdict, host and path of each rule of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"
BAD = "=block"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a url: h:label, p:segment, q:key."""
    said = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3), "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    return F.array_sort(F.array_distinct(F.concat(said("h:", F.split(host(url), "\\.")), said("p:", segments), said("q:", keys))))


def listed_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict, both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


RULES_SCHEMA = "rule string, antecedent array<string>, confidence double, uses bigint"


def mine(labelled: DataFrame, min_support: float = 0.005, min_count: int = 20, min_confidence: float = 0.8, min_lift: float = 1.2) -> DataFrame:
    """(rule, antecedent, confidence, uses) from rows (items, bad): items a token set, bad a boolean."""
    labelled = stored(labelled.select("items", "bad").withColumn("row", F.monotonically_increasing_id()), "labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if n < min_count or not bad:
        return labelled.sparkSession.createDataFrame([], RULES_SCHEMA)
    least = max(min_count, min_support * n)
    each = labelled.select("row", F.explode("items").alias("token"))
    # which rows a token lies in, as their number and 128 bits
    places = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b"))
    groups = places.filter(F.col("n") >= least).groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    groups = stored(groups.select(F.col("tokens")[0].alias("item"), "tokens"), "token-groups")
    known = each.join(groups.select("item", F.explode("tokens").alias("token")), "token").groupBy("row").agg(F.collect_set("item").alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    baskets = labelled.join(known, "row", "left").select(F.when(F.col("bad"), F.array_append(found, BAD)).otherwise(found).alias("items"))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = stored(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, numPartitions=parts).fit(baskets).freqItemsets, "itemsets")
    with_bad = sets.filter(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("of"), F.col("freq").alias("uses")).filter(F.size("of") > 0)
    alone = sets.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("of"), F.col("freq").alias("all"))
    rules = with_bad.join(alone, "of").withColumn("confidence", F.col("uses") / F.col("all"))
    rules = rules.filter(F.col("confidence") >= max(min_confidence, min_lift * bad / n))
    whole = rules.withColumn("item", F.explode("of")).join(groups, "item").groupBy("of", "confidence", "uses").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"))
    return whole.select(F.array_join("antecedent", " ").alias("rule"), "antecedent", "confidence", "uses")


def fired(sets: DataFrame, rules: DataFrame, few: int = 100_000) -> DataFrame:
    """(items, mined_rule) for the token sets in which a rule fires: the rule of the highest confidence, then the first by name. Up to `few` rows of
    the index are broadcast."""
    index = stored(rules.select("rule", "confidence", F.size("antecedent").alias("needs"), F.explode("antecedent").alias("token")), "rule-index")
    index = F.broadcast(index) if index.count() <= few else index
    hits = sets.select("items", F.explode("items").alias("token")).join(index, "token")
    whole = hits.groupBy("items", "rule", "confidence", "needs").agg(F.count("*").alias("met")).filter("met = needs")
    return whole.groupBy("items").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("rule").alias("rule")))["rule"].alias("mined_rule"))


def parsed(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, says (the verdict of the rule) and items of each row."""
    rule, says = listed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"), tokens(F.col(f"`{url}`")).alias("items"))
    return rows.withColumns({"rule": rule, "says": says})


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    url: str = "url",
    page_id: str = "page_id",
    rules=RULES,
    few: int = 100_000,
    salts: int = 32,
    **mining,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined_rule. labels: (page_id, bad); None: the verdicts of the listed rules."""
    rows = stored(parsed(pages, url, page_id, rules), "urls")
    if labels is None:
        labelled = rows.select("items", F.col("says").eqNullSafe("block").alias("bad"))
    else:
        labelled = rows.join(labels.filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").select("items", "bad")
    hits = fired(rows.select("items").distinct(), stored(mine(labelled, **mining), "rules"))
    out = spread_join(rows, hits, "items", F.xxhash64("page_id", "path"), salts=salts, most=few)
    verdict = F.coalesce("says", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule")


def held_out_counts(pages: DataFrame, url: str = "url", rules=RULES, **mining) -> DataFrame:
    """How well mined rules foretell which urls the list blocks, of those that they weren't mined from: (bad, fired, n) over the third of urls by
    CRC-32 that is held out."""
    rows = stored(parsed(pages.withColumn("__held", F.crc32(F.coalesce(F.col(f"`{url}`"), F.lit("")).cast("binary")) % 3 == 1), url, "__held", rules), "listed")
    rows = rows.select("items", F.col("says").eqNullSafe("block").alias("bad"), F.col("page_id").alias("held"))
    test = rows.filter("held")
    hits = fired(test.select("items").distinct(), stored(mine(rows.filter("not held"), **mining), "rules"))
    return test.join(hits, "items", "left").groupBy("bad", F.col("mined_rule").isNotNull().alias("fired")).agg(F.count("*").alias("n"))
