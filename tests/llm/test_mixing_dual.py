import math
import random

import numpy as np
import pytest
from corpusloom.llm import mixing
from pyspark.sql import functions as F

TARGETS = "mix_id string, source string, target_share double, max_repeats int, total_factor double"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    langs = {"web": ["en"] * 6 + ["de", "fr"], "books": ["en", "de", "de", None], "notes": ["fr"]}
    data = [(i, s, rng.choice(langs[s]), int(rng.lognormvariate(m, 1)) + 1) for i, (s, m) in enumerate([("web", 4)] * 400 + [("books", 6)] * 60 + [("notes", 3)] * 90)]
    return spark.createDataFrame(data, "doc_id bigint, source string, lang string, n_tokens bigint")


def solved(documents, spark, targets):
    docs = mixing.with_moments(documents)
    lengths = docs.groupBy("source", "language", "n_tokens", "z").agg(F.count("*").alias("n"))
    plan = mixing.budgets(spark.createDataFrame(targets, TARGETS), lengths).collect()
    rows, duals = mixing.solve(plan, lengths)
    return docs.collect(), plan, rows, duals


MIX = [("m", "web", 0.4, 2, 1.0), ("m", "books", 0.4, 3, 1.0), ("m", "notes", 0.2, 40, 1.0)]


def test_the_tilt_is_real_and_optimal(spark, documents):
    docs, plan, rows, duals = solved(documents, spark, MIX)
    d = duals["m"]
    assert d.passes > 2 and abs(d.at[-1]) > 0.01 and np.abs(d.at[len(d.sources) : -1]).max() > 0.01 and d.residual <= mixing.TOLERANCE
    tilt = {(r[1], r[2]): r for r in rows}
    t = np.array([r.n_tokens for r in docs], float)
    z = np.array([r.z for r in docs])
    mult = [tilt[r.source, r.language] for r in docs]
    most, base = np.array([m[6] for m in mult]), mult[0][5]
    w = np.minimum(most, base * np.exp(np.array([m[3] for m in mult]) + d.at[-1] * z))
    source = np.array([r.source for r in docs])
    budget = {r.source: r.tokens_budget for r in plan}
    for s, b in budget.items():
        assert w[source == s] @ t[source == s] == pytest.approx(b, rel=1e-6)
    # brute force: the primal objective, and feasible changes of the rates
    features = np.stack([[float(r.language == v) for r in docs] for v in d.languages] + [z], 1)
    size = sum(budget.values())
    natural = np.concatenate([(features[:, :-1] * t[:, None]).sum(0) / t.sum(), [0.0]])

    def objective(x):
        moments = natural - (features * (x * t)[:, None]).sum(0) / size
        entropy = np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / base), 0) - x + base
        return (t @ entropy) / size + (moments @ moments) / (2 * mixing.SOFT)

    at, rng = objective(w), np.random.default_rng(0)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            change = rng.normal(size=len(t)) * w * scale
            for s in budget:  # budgets stay met
                here = source == s
                change[here] -= (change[here] @ t[here]) / (w[here] @ t[here]) * w[here]
            other = w + change
            if (other >= 0).all() and (other <= most).all():
                assert objective(other) >= at - 1e-9
    for s in budget:  # moving tokens between any two documents of a source gains nothing
        here = np.flatnonzero(source == s)
        for i, j in rng.choice(here, (60, 2)):
            if i != j:
                other = w.copy()
                e = 1e-4 * min(w[i] * t[i], w[j] * t[j])
                other[i] += e / t[i]
                other[j] -= e / t[j]
                if other[i] <= most[i] and other[j] >= 0:
                    assert objective(other) >= at - 1e-9
    assert (w >= most - 1e-9).any() and (w < most).any()  # bounds are met by some


def test_moments_come_nearer_than_at_uniform_rates(spark, documents):
    docs, plan, rows, duals = solved(documents, spark, MIX)
    report = mixing.mix(documents, spark.createDataFrame(MIX, TARGETS))
    got = report[0].join(documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), "doc_id").groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    total = sum(r.t for r in got)
    everything = sum(r.n_tokens for r in docs)
    far = uniform = 0.0
    for r in got:
        natural = sum(x.n_tokens for x in docs if (x.lang or "") == r.lang) / everything
        plain = sum(p.tokens_budget / p.tokens * sum(x.n_tokens for x in docs if x.source == p.source and (x.lang or "") == r.lang) for p in plan) / sum(p.tokens_budget for p in plan)
        far += abs(r.t / total - natural)
        uniform += abs(plain - natural)
    assert far < 0.8 * uniform
    rows_ = report[1].collect()
    assert all(r.passes == duals["m"].passes and r.residual <= mixing.TOLERANCE and abs(r.tokens_used - r.tokens_budget) <= max(5, 0.01 * r.tokens_budget) for r in rows_)


def test_an_unconverged_solve_is_an_error(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PASSES", 1)
    with pytest.raises(RuntimeError, match="did not converge"):
        mixing.mix(documents, spark.createDataFrame(MIX, TARGETS))


def test_sources_that_give_all_they_can(spark, documents):
    targets = [("m", "web", 0.1, 1, 1.0), ("m", "books", 0.1, 1, 1.0), ("m", "notes", 0.8, 2, 1.0)]
    selection, report = mixing.mix(documents, spark.createDataFrame(targets, TARGETS))
    rows = {r.source: r for r in report.collect()}
    assert rows["notes"].tokens_used == 2 * rows["notes"].tokens and not math.isnan(rows["web"].share_reached)
    shortest = {s: min(x.n_tokens for x in documents.where(f"source = '{s}'").collect()) for s in rows}
    assert all(0 <= r.tokens_budget - r.tokens_used <= max(0.01 * r.tokens_budget, 20 * shortest[s]) for s, r in rows.items())
