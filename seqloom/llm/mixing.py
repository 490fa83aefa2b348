"""Mixing to target weights with soft membership.

A labelled table (doc_id, domain) trains a multinomial logistic regression on hashed words of at most `fit_rows`
labelled documents (those of the smallest hashes); a temperature, fitted on all of them by scores of regressions that haven't seen them
(FOLDS parts, each scored by a fit on the others), calibrates it, because the rates are only as right as the posteriors. Every document gets
a posterior over the domains. Documents whose posteriors agree when rounded to 1/grid make one cell and get one rate; a cell counts with its documents'
own posteriors, not the rounded ones. So the fit runs over a table of cells whose size the grid bounds, whatever the number of documents, and its
sums are those of the documents. Accelerated projected gradient steps minimise

    1/2 sum_c (sum_d rate_d tokens_d posterior_dc - target_c)^2 / (N tokens_c) + ridge/2 sum_d tokens_d (rate_d - 1)^2 / N,  rate >= 0,

N the number of tokens, tokens_c the expected tokens of domain c as they are, and target the weights times N; so a small
domain's error weighs as much as a large one's, and few steps do. Each step is one aggregation over the cells. A document is taken
floor(rate) times, and once more if its hash falls below the rest.

Rates only reweigh: where the posteriors leave a target out of reach, the nearest shares are reached, which `weigh` returns as `reached`.

Only DataFrame operations and Spark ML run here.

Defined results: a null or empty text has no tokens and the posterior of no words; labels with a null are left out; of
several labels of a document the first by name holds; with fewer than two labelled domains every rate is 1; domains
without a weight get none; repeated rows get equal rates; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored

#: Parts of the labelled documents, each scored by a fit on the others.
FOLDS = 3

WORDS = "[\\x20\\x09-\\x0D]+"


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORDS), lambda w: w != "")


@dataclass
class Domains:
    """The classifier. model None: one domain or none was labelled, and all documents belong to it."""

    names: list[str]
    model: PipelineModel | None
    grid: int
    temperature: float = 1.0

    def posterior(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with __tokens, __posterior, and __cell, the posterior as whole parts of grid."""
        if self.model is None:
            return rows.withColumns({"__tokens": F.size(words(text)).cast("bigint"), "__posterior": F.array(F.lit(1.0)), "__cell": F.array(F.lit(self.grid))})
        out = self.model.transform(rows.withColumn("__words", words(text)))
        out = out.withColumns({"__tokens": F.size("__words").cast("bigint"), "__posterior": softened(F.col("__z"), self.temperature)})
        cell = F.transform("__posterior", lambda p: F.round(p * self.grid).cast("int"))
        return out.withColumn("__cell", cell).drop("__words", "__tf", "__x", "__p", "__z", "__said")


def softened(scores: Column, temperature: float) -> Column:
    """The softmax of a vector of scores over a temperature."""
    powers = _let(vector_to_array(scores), lambda z: F.transform(z, lambda x: F.exp((x - F.array_max(z)) / F.lit(temperature))))
    return _let(powers, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def best_temperature(scored: DataFrame, lowest: float = 0.1, highest: float = 10.0, steps: int = 61) -> float:
    """The temperature of the least mean log loss over rows (__z, __y), of a geometric grid. One aggregation."""
    grid = [lowest * (highest / lowest) ** (i / (steps - 1)) for i in range(steps)]
    rows = stored(scored.select(vector_to_array("__z").alias("z"), F.col("__y").cast("int").alias("y")).withColumn("z", F.expr("transform(z, x -> x - z[y])")), "calibration")
    loss = lambda t: F.avg(F.log(F.aggregate(F.transform("z", lambda x: F.exp(F.least(x / F.lit(t), F.lit(700.0)))), F.lit(0.0), lambda a, y: a + y)))
    found = rows.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(grid))).first()
    return 1.0 if found[0] is None else min(zip(found, grid))[1]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    features: int = 1 << 14,
    grid: int = 64,
    text: str = "text",
    doc_id: str = "doc_id",
    most_domains: int = 64,
) -> Domains:
    """labels: (doc_id, domain)."""
    of = labels.filter("doc_id is not null and domain is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("domain").alias("__domain"))
    chosen = stored(of.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows), "fit-labels")  # fit_rows rows of a few bytes: small enough to broadcast
    rows = stored(docs.select(F.col(doc_id).alias("__id"), words(text).alias("__words")).join(F.broadcast(chosen), "__id"), "fit-rows")
    names = sorted(r[0] for r in rows.select("__domain").distinct().limit(most_domains + 1).collect())
    if len(names) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    if len(names) < 2:
        return Domains(names or ["all"], None, grid)
    stages = [HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features, binary=False), Normalizer(inputCol="__tf", outputCol="__x", p=2.0)]
    coded = rows.withColumn("__y", (F.array_position(F.array(*map(F.lit, names)), F.col("__domain")) - 1).cast("double"))
    for stage in stages:
        coded = stage.transform(coded)
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__z", predictionCol="__said", family="multinomial", maxIter=40, regParam=1e-4)
    coded = stored(coded.select("__id", "__x", "__y"), "fit-vectors")
    part, unseen = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(FOLDS)), None
    for k in range(FOLDS):
        others = coded.filter(part != k)
        if others.select("__y").distinct().count() == len(names):  # else a domain would have no score
            own = lr.fit(others).transform(coded.filter(part == k)).select("__z", "__y")
            unseen = own if unseen is None else unseen.unionByName(own)
    temperature = 1.0 if unseen is None else best_temperature(unseen)
    return Domains(names, PipelineModel([*stages, lr.fit(coded)]), grid, temperature)


def cells_of(scored: DataFrame, k: int) -> DataFrame:
    """(cell, tokens, p): the tokens of each cell and their mean posterior over k domains (of a cell without tokens, that of its documents). There are at
    most as many cells as the grid has points."""
    some = F.sum("__tokens").cast("double")
    p = [F.when(some > 0, F.sum(F.col("__tokens") * F.col("__posterior")[i]) / some).otherwise(F.avg(F.col("__posterior")[i])) for i in range(k)]
    return scored.groupBy(F.col("__cell").alias("cell")).agg(some.alias("tokens"), F.array(*p).alias("p"))


def shares(cells: DataFrame, rate: DataFrame, k: int) -> list[float]:
    """The expected shares of the domains' tokens under the rates of the cells."""
    both = cells.join(_few(rate), "cell")
    sums = both.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]) for i in range(k))).first()
    total = sum(x or 0.0 for x in sums)
    return [(x or 0.0) / total if total else 0.0 for x in sums]


def fit_rates(cells: DataFrame, target: list[float], ridge: float = 1e-3, steps: int = 40, unrolled: int = 10) -> DataFrame:
    """(cell, rate) that brings the expected tokens of each domain near its target share."""
    k = len(target)
    rows = stored(cells.select("cell", "tokens", *(F.col("p")[i].alias(f"p{i}") for i in range(k))).withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)}), "cells")
    n, *now = rows.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(k))).first()
    if not n:
        return rows.select("cell", F.lit(1.0).alias("rate"))
    weight = [n / x if x else 0.0 for x in now]
    bounds = rows.agg(*(F.sum(F.col("tokens") * F.col(f"p{i}") * sum(F.col(f"p{j}") * (weight[i] * weight[j]) ** 0.5 for j in range(k))) for i in range(k))).first()
    step = 1 / (max(bounds) / n + ridge)  # the largest sum of a row bounds the largest eigenvalue
    t, state, last = 1.0, F.struct("rate", "before"), None
    for turn in range(steps):
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        push = (t - 1) / later
        t = later
        ahead = _ahead(push)
        at = rows.select("tokens", *(f"p{i}" for i in range(k)), _let(state, ahead).alias("y"))
        sums = at.agg(*(F.sum(F.col("y") * F.col("tokens") * F.col(f"p{i}")) for i in range(k))).first()
        error = [(sums[i] / n - target[i]) * weight[i] for i in range(k)]

        state = _let(state, _moved(ahead, error, step, ridge))
        settled = last is not None and max(abs(a - b) for a, b in zip(error, last)) < 1e-5
        last = error
        if settled or turn % unrolled == unrolled - 1:
            rows = stored(rows.withColumn("s", state).select("cell", "tokens", *(f"p{i}" for i in range(k)), F.col("s.rate").alias("rate"), F.col("s.before").alias("before")), f"cells{turn}")
            state = F.struct("rate", "before")
        if settled:
            break
    return rows.withColumn("s", state).select("cell", F.col("s.rate").alias("rate"))


def _ahead(push: float):
    return lambda s: s["rate"] + F.lit(push) * (s["rate"] - s["before"])


def _moved(ahead, error: list[float], step: float, ridge: float):
    def moved(s: Column) -> Column:
        pull = sum((F.col(f"p{i}") * F.lit(e) for i, e in enumerate(error)), F.lit(0.0))
        return _let(ahead(s), lambda y: F.struct(F.greatest(F.lit(0.0), y - F.lit(step) * (pull + F.lit(ridge) * (y - 1))).alias("rate"), s["rate"].alias("before")))

    return moved


def _let(value: Column, of) -> Column:
    return F.transform(F.array(value), of)[0]


def copies(rate: Column, doc_id: Column, seed: int = 11) -> Column:
    """A whole number whose mean over documents is the rate."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / F.lit(1 << 30)
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")


def rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    text: str = "text",
    doc_id: str = "doc_id",
    grid: int = 64,
    **learning,
) -> tuple[DataFrame, DataFrame, Domains, list[float]]:
    """(doc_id, __tokens, __posterior, __cell) of each row, (cell, rate), the classifier, and the shares that are reached. weights: domain -> share; they are
    scaled to sum to 1."""
    domains = learn(docs, labels, grid=grid, text=text, doc_id=doc_id, **learning)
    scored = stored(domains.posterior(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "posteriors")
    wanted, k = [weights.get(d, 0.0) for d in domains.names], len(domains.names)
    cells = stored(cells_of(scored, k), "cells-of-documents")
    plain = domains.model is None or not sum(wanted)
    rate = stored(cells.select("cell", F.lit(1.0).alias("rate")) if plain else fit_rates(cells, [w / sum(wanted) for w in wanted]), "rates")
    return scored, rate, domains, shares(cells, rate, k)


#: So many cells, of some hundred bytes each, are broadcast; more are joined by a shuffle.
MOST_CELLS = 200_000


def _few(rate: DataFrame) -> DataFrame:
    return F.broadcast(rate) if rate.count() <= MOST_CELLS else rate


def weigh(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **how) -> DataFrame:
    """One row per row of docs: doc_id, tokens, posterior, rate, copies, reached. posterior and reached, the same in each row, go by the domains' names."""
    scored, rate, domains, reached = rates(docs, labels, weights, **how)
    out = scored.join(_few(rate), scored["__cell"] == rate["cell"])
    shown = F.array(*(F.lit(float(x)) for x in reached))
    taken = copies(F.col("rate"), F.col("doc_id"))
    return out.select("doc_id", F.col("__tokens").alias("tokens"), F.col("__posterior").alias("posterior"), "rate", taken.alias("copies"), shown.alias("reached"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, each as often as its copies say, with all their columns; without a shuffle of texts while the rates are few."""
    _, rate, domains, _ = rates(docs, labels, weights, text=text, doc_id=doc_id, **how)
    rate = rate.select(F.col("cell").alias("__cell"), F.col("rate").alias("__rate"))
    taken = domains.posterior(docs, text).join(_few(rate), "__cell").withColumn("__copies", copies(F.col("__rate"), F.col(f"`{doc_id}`"))).drop("__posterior").filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
