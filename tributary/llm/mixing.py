"""Mixing to target weights with soft memberships.

A naive Bayes classifier learned from a labelled table gives every document a posterior over the
domains. Non-negative document rates are then fitted by projected gradient steps so that the
expected tokens of each domain, summed over documents, have the target shares of the corpus.

The squared error is weighted with the inverse of the domains' token matrix over the documents whose
rate isn't clipped at zero, under which a step of length one is exact as long as no other rate gets
clipped. A step is one sum over the documents; a rate follows from the steps so far, so that nothing
but the posteriors is stored. Steps end when the targets are met, or when they come no closer.

Everything runs inside the JVM.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.native import let, words
from tributary.llm.scratch import written

#: Hashed token indicators of the classifier.
BUCKETS = 4096
#: A token is a run of letters and digits or a run of anything else that isn't white space.
TOKEN = r"[\p{L}\p{N}]++|[^\p{L}\p{N}\s]++"
#: Evidence of longer texts is scaled down to that of so many indicators, to keep memberships soft.
EVIDENCE = 25.0
#: Steps at most, and how far a share may be from its target; what is left is logged and returned.
STEPS, TOLERANCE = 60, 1e-7
LOG = logging.getLogger(__name__)


def indicators(text: Column) -> Column:
    """The distinct token buckets of a text; none for null."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))


class Memberships:
    """Log priors and log likelihoods by domain and bucket; of a fixed size."""

    def __init__(self, domains: list[str], prior: np.ndarray, likelihood: np.ndarray):
        self.domains, self.prior, self.likelihood = domains, prior, likelihood

    def posteriors(self, found: Column) -> Column:
        """The domains' probabilities, in order, from a text's indicators; the prior where there are none."""
        tables = [F.split(F.lit(",".join(f"{x:.9g}" for x in row)), ",").cast("array<double>") for row in self.likelihood]
        start = F.struct(*[F.lit(0.0).alias(f"d{k}") for k in range(len(self.domains))])

        def score(b: Column) -> Column:
            sums = F.aggregate(b, start, lambda s, x: F.struct(*[(s[f"d{k}"] + F.get(t, x)).alias(f"d{k}") for k, t in enumerate(tables)]))
            scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(b), F.lit(1)))
            return let(sums, lambda s: F.array(*[F.lit(float(p)) + s[f"d{k}"] * scale for k, p in enumerate(self.prior)]))

        def normal(x: Column) -> Column:
            return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda n: F.transform(e, lambda v: v / n)))

        return let(let(found, score), normal)


def learn(labelled: DataFrame, text_col: str = "text", domain_col: str = "domain") -> Memberships:
    """Count the indicators of each domain over all labelled rows; rows with a null domain don't count."""
    rows = labelled.filter(F.col(domain_col).isNotNull()).select(F.col(domain_col).cast("string").alias("domain"), indicators(F.col(text_col)).alias("found"))
    counted = rows.select("domain", F.explode_outer(F.concat(F.array(F.lit(-1)), "found")).alias("bucket")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most domains * (BUCKETS + 1) rows
    domains = sorted({r["domain"] for r in counted})
    size, held = np.zeros(len(domains)), np.zeros((len(domains), BUCKETS))
    for r in counted:
        if r["bucket"] < 0:
            size[domains.index(r["domain"])] = r["n"]
        else:
            held[domains.index(r["domain"]), r["bucket"]] = r["n"]
    share = (held + 0.5) / (held.sum(1, keepdims=True) + 0.5 * BUCKETS)
    return Memberships(domains, np.log((size + 1) / (size.sum() + len(domains))) if domains else size, np.log(share))


def mixed(docs: DataFrame, model: Memberships, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id, n_tokens, posterior per domain (p_<domain>), rate and copies, and the columns ``keep``.

    A column of ``keep`` that has the name of one of these is left out.

    ``targets`` are weights by domain, scaled to sum to one; a domain that isn't named gets none,
    and a named one of which no label was seen is left out. Rates start at one and stay at zero or
    above; copies are the rate rounded up or down by the hash of id and text, so that their expectation is
    the rate; only rows that are equal in both are rounded alike. ``missed`` is how far the domains' shares stay from the
    targets at most, the same for all rows; null where nothing was fitted. Rows of one id are rows like others. A null or empty text has no tokens, the prior as its posterior, and a rate like any
    other. With no labels or an empty table rates are one. Targets that no rates can meet are met as
    closely as the weighted squared error allows.
    """
    k = len(model.domains)
    text = F.col(text_col)
    found = indicators(text)
    own = {id_col, "n_tokens", *(f"p_{d}" for d in model.domains), "rate", "copies", "missed"}
    rest = F.struct(*[c for c in keep if c not in own]) if any(c not in own for c in keep) else F.lit(None)
    rows = docs.select(rest.alias("rest"), F.col(id_col).alias("id"), F.xxhash64(F.lit("copies"), F.col(id_col), text).alias("drawn"), F.size(words(text)).cast("long").alias("n"), (model.posteriors(found) if k else F.array().cast("array<double>")).alias("p"))
    kept = [F.col(f"rest.`{c}`") for c in keep if c not in own]
    base = written(rows.select(*(["rest"] if kept else []), "id", "drawn", "n", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k)]), "memberships")
    p = [F.col(f"p{i}") for i in range(k)]
    total = base.agg(F.sum("n")).first()[0] or 0
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    history: list[np.ndarray] = []
    missed = None

    def rate() -> Column:
        r = F.lit(1.0)
        if not history:
            return r
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in history])
        return F.aggregate(steps, r, lambda s, v: F.greatest(F.lit(0.0), s - reduce(lambda a, b: a + b, (F.get(v, F.lit(i)) * p[i] for i in range(k)))))

    if total and k and weights.sum() > 0:
        weights = weights / weights.sum()
        tokens = F.when(F.col("r") > 0, F.col("n") / total).otherwise(0.0)
        best, since, reached = float("inf"), 0, []
        for _ in range(STEPS):
            sums = base.withColumn("r", rate()).agg(
                *[F.sum(F.col("r") * F.col("n") * p[i] / total).alias(f"s{i}") for i in range(k)],
                *[F.sum(tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
            ).first()
            miss = np.array([sums[f"s{i}"] for i in range(k)]) - weights
            reached.append(float(np.abs(miss).max()))
            since = 0 if reached[-1] < 0.9 * best else since + 1
            best = min(best, reached[-1])
            if reached[-1] <= TOLERANCE or since > 5:
                break
            matrix = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            history.append(np.linalg.pinv(matrix, rcond=1e-10) @ miss)
        missed = min(reached)
        if reached[-1] > TOLERANCE:
            del history[int(np.argmin(reached)) :]
            LOG.warning("targets are missed by up to %.3g of the tokens after %d steps", best, len(reached))
    u = F.pmod("drawn", F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = base.withColumn("rate", rate())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", F.floor(F.col("rate") + u).cast("long").alias("copies"), F.lit(missed).cast("double").alias("missed"), *kept)
