"""Mixing towards target weights: soft domain membership and document rates by projected gradients."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class DomainModel:
    """Multinomial naive Bayes over hashed words: log prior and, per domain, log probabilities of the buckets."""

    domains: list[str]
    prior: list[float]
    tables: list[list[float]]
    share: list[float]


def words(text: Column) -> Column:
    """Lower-cased words between white space; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def fit_domains(labelled: DataFrame, *, domain_col: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096, max_train: int = 20_000, smoothing: float = 0.5) -> DomainModel:
    """Learn from the labelled rows: at most ``max_train`` of them, those whose id hashes lowest.

    The driver gets one row a domain and one a bucket, never documents. Rows without a domain or an id are not labelled.
    """
    rows = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull())
    share = rows.groupBy(domain_col).count().orderBy(domain_col).collect()
    domains = [r[0] for r in share]
    total = sum(r[1] for r in share)
    chosen = rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    sample = rows.join(F.broadcast(chosen), id_col, "left_semi")
    counted = (
        sample.select(F.col(domain_col).alias("d"), F.explode(words(F.col(text_col))).alias("w"))
        .groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("b"))
        .pivot("d", domains).count().collect()
        if domains else []
    )
    tables = []
    for d in domains:
        counts = [smoothing] * buckets
        for r in counted:
            counts[r["b"]] += r[str(d)] or 0
        whole = sum(counts)
        tables.append([math.log(c / whole) for c in counts])
    return DomainModel(domains, [math.log(r[1] / total) for r in share], tables, [r[1] / total for r in share])


def constant(values: list[float]) -> Column:
    """array<double> that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def posterior(text: Column, model: DomainModel, *, softness: int = 8) -> Column:
    """array<double> of P(domain | text), inside one projection.

    The evidence of a text counts as that of at most ``softness`` words (its mean log likelihood times that
    number), so membership stays soft; a text without words gets the prior.
    """
    k = len(model.domains)
    if not k:
        return F.array().cast("array<double>")
    n_buckets = len(model.tables[0])
    hashed = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(n_buckets)).cast("int"))

    def logits(b: Column) -> Column:
        n = F.size(b)
        weight = F.least(n, F.lit(softness)) / F.greatest(n, F.lit(1))

        def evidence(t: list[float]) -> Column:
            return F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(constant(t), i))

        return F.array(*[F.lit(p) + weight * evidence(t) for p, t in zip(model.prior, model.tables, strict=True)])

    def normal(x: Column) -> Column:
        top = F.array_max(x)
        e = F.transform(x, lambda v: F.exp(v - top))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, z: a + z))

    # transform over a one-element array names a value inside an expression: each step is computed once.
    step = F.transform(F.array(hashed), logits)
    return F.get(F.transform(step, normal), F.lit(0))


def rate(p: Column, steps: list[list[float]], least: float) -> Column:
    """The document's rate after the projected steps: r <- max(least, r - p . g) from r = 1."""
    if not steps:
        return F.lit(float(max(1.0, least)))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return F.aggregate(
        table, F.lit(float(max(1.0, least))),
        lambda r, g: F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)),
    )


def fit_rates(members: DataFrame, targets: list[float], *, budget: float = 1.0, least: float = 0.0, rounds: int = 20, tolerance: float = 1e-3) -> list[list[float]]:
    """Projected-gradient least squares on the residuals sum_i r_i t_i p_id / T - budget * target_d, r_i >= least.

    ``members`` has tokens and p (posteriors). Residuals are weighed by the inverse of the token-weighted second
    moment of p; in that metric the gradient's Lipschitz constant is at most 1, so full steps r <- max(least,
    r - p . M^-1 residual) descend, and few are needed. A round aggregates one number a domain. Returns the steps
    that ``rate`` replays, so rates are never stored or collected.
    """
    k = len(targets)
    if not k:
        return []
    weigh = members.agg(
        F.sum("tokens").alias("t"),
        *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}") for i in range(k) for j in range(k)],
    ).first()
    total = float(weigh["t"] or 0)
    if total <= 0:
        return []
    moment = np.array([[weigh[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / total
    metric = np.linalg.inv(moment + 1e-9 * np.eye(k))
    steps: list[list[float]] = []
    for _ in range(rounds):
        r = rate(F.col("p"), steps, least)
        got = members.select("tokens", "p", r.alias("r")).agg(*[F.sum(F.col("tokens") * F.col("r") * F.get("p", F.lit(i))) for i in range(k)]).first()
        residual = np.array([(got[i] or 0.0) / total - budget * targets[i] for i in range(k)])
        if np.abs(residual).max() < tolerance:
            break
        steps.append((metric @ residual).tolist())
    return steps


def tempered(share: list[float], power: float) -> list[float]:
    raised = [s**power for s in share]
    return [x / sum(raised) for x in raised]


def copies(id_col: str, r: Column) -> Column:
    """Whole copies of a document: the floor of its rate, and one more with the rest as probability, by hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("long")


def fit_mix(docs: DataFrame, *, domain_col: str = "lang", targets: dict[str, float] | None = None, power: float = 0.5, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text"):
    """(model, steps, targets): what ``mix_rates`` and ``mixed_docs`` apply. ``targets`` default to shares ** power.

    With ``least`` = 1 documents are only repeated, never left out; the budget then grows to what the most
    frequent domain needs at that rate.
    """
    model = fit_domains(docs, domain_col=domain_col, id_col=id_col, text_col=text_col)
    goal = [targets[d] for d in model.domains] if targets else tempered(model.share, power) if model.domains else []
    members = written(docs.select(F.size(words(F.col(text_col))).cast("long").alias("tokens"), posterior(F.col(text_col), model).alias("p")))
    budget = 1.0
    if least > 0 and goal:
        sums = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(goal))]).first()
        total = float(sums[0] or 0)
        budget = max(1.0, *(least * (sums[i + 1] or 0.0) / total / g for i, g in enumerate(goal) if g > 0)) if total else 1.0
    return model, fit_rates(members, goal, budget=budget, least=least), goal


def mix_rates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, **params) -> DataFrame:
    """id, tokens, posterior, domain (likeliest), rate, copies for every row of ``docs``.

    Null and empty texts have no tokens and the prior as posterior. An empty table gives an empty result; with no
    labelled row there are no domains and every rate is 1. Rows are independent once the rates are fitted: rows that
    repeat id and text get equal results and weigh in each, rows of one id with other texts their own; texts of any
    length are read whole. Of equal posteriors the first domain by name is the likeliest. Other columns than id,
    text and domain are not read.
    """
    model, steps, _ = fit_mix(docs, least=least, id_col=id_col, text_col=text_col, **params)
    p = docs.select(F.col(id_col), F.size(words(F.col(text_col))).cast("long").alias("tokens"), posterior(F.col(text_col), model).alias("posterior"))
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    best = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    r = p.withColumns({"domain": best, "rate": rate(F.col("posterior"), steps, least)})
    return r.withColumn("copies", copies(id_col, F.col("rate")))


def mixed_docs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 1.0, **params) -> DataFrame:
    """``docs`` with every row repeated as often as its rate says; all columns stay, whatever their names, no text is shuffled.

    A row travels as one struct. Rows that repeat an id are repeated alike; null ids draw the same number.
    """
    model, steps, _ = fit_mix(docs, least=least, id_col=id_col, text_col=text_col, **params)
    r = rate(posterior(F.col(text_col), model), steps, least)
    n = copies(id_col, r).cast("int")
    return docs.select(F.explode(F.array_repeat(F.struct("*"), n)).alias("_row")).select("_row.*")
