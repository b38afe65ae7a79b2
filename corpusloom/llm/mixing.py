"""Mixing sources to target token shares by entropy balancing.

For one mix, document i with t_i tokens gets a rate w_i, the number of times it is used on average. The rates minimise
the relative entropy, counted by token, to the natural mix (every document at the rate ``total_factor``), with
0 <= w_i <= max_repeats, subject to

* the token budget of each source, sum w_i t_i = B_s, exactly;
* the language shares and the mean logarithmic document length of the whole mix being those of all documents. These
  moments go across the sources and may contradict the budgets, so they are soft: a quadratic penalty (``SOFT``).

The dual of that is concave and its solution is an exponential tilt, w_i = min(max_repeats, base * exp(a_s + c_l + b z_i))
with a multiplier for each source s, language l and for the standardised length z. Newton's method with a line search
finds the multipliers of all mixes at once; each step is one distributed aggregation (dual value, gradient and Hessian)
over the table of token lengths, of which one row a (mix, source, language) comes to the driver. A mix that does not
converge is an error.

Rates become whole copies by calibrated rounding: floor(w_i) copies, and one more where the document's uniform
hash lies below the fractional part plus a source-wide shift. The shift that meets the token budget is found by two
passes over a histogram of the hashes, so no source is ever sorted or gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpoint

#: Passes over the lengths at most (an error follows), and the error of a budget, relative to it, that counts as none.
MAX_PASSES, TOLERANCE = 200, 1e-8
#: Penalty of the soft moments: a multiplier of 1 is worth this share of the mix. Longest Newton step in a multiplier.
SOFT, STEP = 0.05, 3.0
#: A language with less than this share of all tokens is counted among the others.
LANGUAGE = 0.01
#: Buckets of one pass over the rounding hashes.
BUCKETS = 4096


def budgets(targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """The targets with each source's documents, tokens and token budget.

    ``tokens_wanted`` is target_share * total_factor * all tokens; ``tokens_budget`` is that or, where a source
    cannot give so much, max_repeats times its tokens. A source without tokens has a budget of 0. A shortfall is not
    filled up from other sources: their own shares stay as near to the target as they can be. Repeated rows of the
    targets count once; rows with a null mix, source or share, or nothing to repeat, are left out.
    """
    good = targets.select("mix_id", "source", "target_share", "max_repeats", "total_factor").distinct().where(
        "mix_id IS NOT NULL AND source IS NOT NULL AND target_share >= 0 AND max_repeats >= 0 AND total_factor >= 0"
    )
    all_tokens = lengths.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n")), F.lit(0)).alias("n")).first()["n"]  # one number
    of = lengths.groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n_tokens") * F.col("n")).alias("tokens")
    )
    wanted = F.col("target_share") * F.col("total_factor") * F.lit(float(all_tokens))
    return (
        good.join(of, "source", "left")
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("tokens_wanted", wanted)
        .withColumn("tokens_budget", F.least(wanted, F.col("max_repeats") * F.col("tokens").cast("double")))
    )


def rate(base: Column, most: Column, tilt: Column) -> Column:
    """The tilted rate of a document, cut off at ``most``."""
    return F.when(tilt >= F.ln(most / base), most).otherwise(base * F.exp(tilt))


SOLVED = "mix_id string, source string, language string, tilt double, slope double, base double, most double"


class Dual:
    """The dual of one mix: multipliers of its sources, of the languages, and of the length; the last two are soft.

    A source that has to give all that it can (its budget is max_repeats times its tokens) is fixed there.
    """

    def __init__(self, rows: list, tokens: dict, z_sums: dict, languages: list[str], shares: list[float]) -> None:
        self.mix, self.base = rows[0].mix_id, float(max(r.total_factor for r in rows))
        self.most = {r.source: float(r.max_repeats) for r in rows}
        self.full = [r.source for r in rows if r.tokens_budget >= r.max_repeats * r.tokens * (1 - 1e-12)]
        free = [r for r in rows if r.source not in self.full]
        self.sources, self.languages = [r.source for r in free], languages
        self.size = float(sum(r.tokens_budget for r in rows))
        fixed = np.array([sum(self.most[s] * tokens.get((s, v), 0) for s in self.full) for v in languages])
        fixed_z = sum(self.most[s] * z_sums.get((s, v), 0.0) for s in self.full for v in languages)
        self.want = np.concatenate([[r.tokens_budget for r in free], np.array(shares) * self.size - fixed, [-fixed_z]]) / self.size
        self.soft = np.concatenate([np.zeros(len(free)), np.full(len(languages) + 1, SOFT)])
        start = [math.log(r.tokens_budget / (self.base * r.tokens)) for r in free]
        self.at = self.trial = np.concatenate([start, np.zeros(len(languages) + 1)])
        self.step = self.direction = np.zeros(len(self.at))
        self.value, self.slope, self.length, self.passes, self.residual = -math.inf, 0.0, 1.0, 0, 0.0
        self.done = not free

    def rows(self, theta: np.ndarray) -> list[tuple]:
        """The multipliers by source and language."""
        k = len(self.sources)
        out = [(self.mix, s, v, float(theta[i] + theta[k + j]), float(theta[-1]), self.base, self.most[s]) for i, s in enumerate(self.sources) for j, v in enumerate(self.languages)]
        return out + [(self.mix, s, v, 1e300, 0.0, self.base, self.most[s]) for s in self.full for v in self.languages]

    def move(self, sums: dict[tuple, tuple]) -> None:
        """One pass: ``sums`` by (source, language) are those of the trial point."""
        self.passes += 1
        k, n = len(self.sources), len(self.trial)
        value = float(self.trial @ self.want - 0.5 * (self.soft * self.trial) @ self.trial)
        gradient, hessian = self.want - self.soft * self.trial, np.diag(self.soft)
        for i, s in enumerate(self.sources):
            for j, v in enumerate(self.languages):
                psi, g, gz, h, hz, hzz = (x / self.size for x in sums.get((s, v), (0.0,) * 6))
                value -= psi
                c = k + j
                gradient[i] -= g
                gradient[c] -= g
                gradient[-1] -= gz
                for x, y, add in ((i, i, h), (c, c, h), (i, c, h), (c, i, h), (i, n - 1, hz), (n - 1, i, hz), (c, n - 1, hz), (n - 1, c, hz), (n - 1, n - 1, hzz)):
                    hessian[x, y] += add
        if value < self.value + 1e-4 * self.length * self.slope - 1e-13 * abs(value):  # too long a step
            self.length /= 2
            self.trial = self.at + self.length * self.direction
            return
        self.at, self.value = self.trial, value
        budget = np.abs(gradient[:k]) / self.want[:k]
        self.residual = float(budget.max())
        if self.residual <= TOLERANCE and np.abs(gradient[k:]).max() <= math.sqrt(TOLERANCE):
            self.done = True
            return
        direction = np.linalg.solve(hessian + 1e-12 * np.eye(n), gradient)
        self.direction = direction * min(1.0, STEP / max(np.abs(direction).max(), 1e-300))
        self.slope, self.length = float(gradient @ self.direction), 1.0
        self.trial = self.at + self.direction


def solve(plan: list, lengths: DataFrame) -> tuple[list[tuple], dict[str, Dual]]:
    """Multipliers of every (mix, source, language), and the duals by mix, by distributed Newton steps."""
    spark = lengths.sparkSession
    of, z_of = {}, {}
    for r in lengths.groupBy("source", "language").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum(F.col("n") * F.col("n_tokens") * F.col("z")).alias("z")).collect():
        of[r.source, r.language], z_of[r.source, r.language] = r.t, r.z  # one row a source and language
    languages = sorted({v for _, v in of})
    total = sum(of.values())
    shares = [sum(t for (_, v), t in of.items() if v == x) / total for x in languages] if total else []
    by_mix: dict[str, list] = {}
    for r in plan:
        if r.tokens_budget > 0:
            by_mix.setdefault(r.mix_id, []).append(r)
    duals = {m: Dual(rows, of, z_of, languages, shares) for m, rows in by_mix.items()}
    for _ in range(MAX_PASSES):
        live = [d for d in duals.values() if not d.done]
        if not live:
            break
        # one row a wanted (mix, source) and language: bounded by the table of targets, not by the data
        multipliers = F.broadcast(spark.createDataFrame([x for d in live for x in d.rows(d.trial)], SOLVED))
        u = F.col("tilt") + F.col("slope") * F.col("z")
        weight, top = F.col("n") * F.col("n_tokens"), F.ln(F.col("most") / F.col("base"))
        cut = F.col("u") >= top
        psi = F.when(cut, F.col("most") * (F.col("u") - top) + F.col("most") - F.col("base")).otherwise(F.col("base") * (F.exp(F.least(F.col("u"), top)) - 1))
        g, h = F.col("g"), F.when(cut, 0.0).otherwise(F.col("g"))
        sums: dict[str, dict] = {}
        rows = (
            lengths.join(multipliers, ["source", "language"]).where("tilt < 1e299").withColumn("u", u).withColumn("g", weight * rate(F.col("base"), F.col("most"), F.col("u")))
            .groupBy("mix_id", "source", "language").agg(
                F.sum(weight * psi).alias("psi"), F.sum(g).alias("g"), F.sum(g * F.col("z")).alias("gz"),
                F.sum(h).alias("h"), F.sum(h * F.col("z")).alias("hz"), F.sum(h * F.col("z") * F.col("z")).alias("hzz"),
            )
        )
        for r in rows.collect():
            sums.setdefault(r.mix_id, {})[r.source, r.language] = (r.psi, r.g, r.gz, r.h, r.hz, r.hzz)
        for d in live:
            d.move(sums.get(d.mix, {}))
    late = [d.mix for d in duals.values() if not d.done]
    if late:
        raise RuntimeError(f"entropy balancing did not converge within {MAX_PASSES} passes for the mixes {late}")
    return [x for d in duals.values() for x in d.rows(d.at)], duals


def with_moments(documents: DataFrame, lang: str = "lang") -> DataFrame:
    """``documents`` with their language class and standardised logarithmic length, both over all tokens."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in documents.columns else F.lit("")
    documents = documents.withColumn("language", name)
    size = F.log2("n_tokens")
    one = documents.agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * size).alias("m"), F.sum(F.col("n_tokens") * size * size).alias("q")).first()
    mean = one.m / one.t if one.t else 0.0
    spread = math.sqrt(max(one.q / one.t - mean * mean, 0.0)) if one.t else 0.0
    # at most 1 / LANGUAGE rows
    main = [r.language for r in documents.groupBy("language").agg(F.sum("n_tokens").alias("t")).where(F.col("t") >= LANGUAGE * (one.t or 0)).collect()]
    return documents.withColumn("language", F.when(F.col("language").isin(main), F.col("language")).otherwise("(other)")).withColumn("z", (size - mean) / (spread or 1.0))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(selection, report)`` of every mix of ``targets``.

    ``documents`` has ``key``, ``source``, ``n_tokens`` and, if there are languages, ``lang``. The selection has mix_id,
    source, ``key``, n_tokens, rate and copies >= 1, never more copies than max_repeats. The report has one row a wanted
    (mix_id, source): budget, tokens and share reached, documents used, highest and mean repeats, passes of the solver,
    and the largest error of a budget of the mix before rounding. Documents with a null key, a null source or without
    tokens are never chosen; a source without documents is reported with 0. Repeated documents are separate documents.
    Null languages are a language. Empty tables give an empty selection.
    """
    spark = documents.sparkSession
    documents = documents.where(f"n_tokens > 0 AND source IS NOT NULL AND `{key}` IS NOT NULL")
    documents = with_moments(documents)
    lengths = checkpoint(documents.groupBy("source", "language", "n_tokens", "z").agg(F.count("*").alias("n")))
    plan = budgets(targets, lengths).collect()  # as many rows as wanted mixes have sources
    solved, duals = solve(plan, lengths)
    multipliers = spark.createDataFrame(solved, SOLVED)
    unit = (F.pmod(F.xxhash64(F.col("mix_id"), F.col(key).cast("string"), F.lit("copies")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rated = (
        documents.select("source", key, "n_tokens", "language", "z").join(F.broadcast(multipliers), ["source", "language"])
        .withColumn("rate", rate(F.col("base"), F.col("most"), F.col("tilt") + F.col("slope") * F.col("z")))
        .withColumn("whole", F.floor(F.col("rate") + 1e-9))
        .withColumn("over", unit - (F.col("rate") - F.col("whole")))  # one more copy where this lies below the shift
        .where(F.col("rate") > 0)
    )
    room = F.col("whole") < F.col("most")
    # first pass: histogram of "over" in [-1, 1); second: the bucket in which the budget is met, split again
    low, width = {(s[0], s[1]): -1.0 for s in solved}, 2.0 / BUCKETS
    have: dict[tuple, float] = {}
    budget = {(r.mix_id, r.source): r.tokens_budget for r in plan}
    for step in range(2):
        edges = spark.createDataFrame([(m, s, x) for (m, s), x in low.items()] or [], "mix_id string, source string, low double")
        at = F.floor((F.col("over") - F.col("low")) / width)
        seen = rated.join(F.broadcast(edges), ["mix_id", "source"]).withColumn("at", at)
        if step:
            seen = seen.where((F.col("at") >= 0) & (F.col("at") < BUCKETS) & room)
        else:
            first = seen.groupBy("mix_id", "source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("t")).collect()
            have = {(r.mix_id, r.source): float(r.t) for r in first}
            seen = seen.where(room)
        bins: dict[tuple, list] = {}
        # at most BUCKETS rows a wanted (mix, source)
        for r in seen.groupBy("mix_id", "source", "at").agg(F.sum("n_tokens").alias("t")).collect():
            bins.setdefault((r.mix_id, r.source), []).append((r.at, r.t))
        for k in low:
            total = have.get(k, 0.0)
            place = BUCKETS
            for at_, t in sorted(bins.get(k, [])):
                if total + t > budget[k] + 1e-6:
                    place = at_
                    break
                total += t
            have[k], low[k] = total, low[k] + place * width
        width /= BUCKETS
    shift = spark.createDataFrame(
        [(m, s, x, budget[m, s] - have[m, s]) for (m, s), x in low.items()], "mix_id string, source string, shift double, rest double"
    )
    rated = rated.join(F.broadcast(shift), ["mix_id", "source"])
    # one more document a source, the longest that the rest of its budget has room for
    last = (
        rated.where(room & (F.col("over") >= F.col("shift")) & (F.col("n_tokens") <= F.col("rest")))
        .groupBy("mix_id", "source").agg(F.max(F.struct("n_tokens", key)).alias("last"))
        .select("mix_id", "source", F.col(f"last.{key}").alias(key), F.lit(1).alias("extra"))
    )
    selection = (
        rated.join(F.broadcast(last), ["mix_id", "source", key], "left")
        .withColumn("up", room & ((F.col("over") < F.col("shift")) | F.col("extra").isNotNull()))
        .withColumn("copies", (F.col("whole") + F.when(F.col("up"), 1).otherwise(0)).cast("int"))
        .where("copies > 0")
        .select("mix_id", "source", key, "n_tokens", "rate", "copies")
    )
    wanted = spark.createDataFrame(
        [
            (r.mix_id, r.source, r.target_share, r.max_repeats, float(r.tokens_wanted), float(r.tokens_budget), r.docs, r.tokens)
            + ((duals[r.mix_id].passes, duals[r.mix_id].residual) if r.mix_id in duals else (0, 0.0))
            for r in plan
        ],
        "mix_id string, source string, target_share double, max_repeats int, tokens_wanted double, tokens_budget double, docs bigint, tokens bigint, passes int, residual double",
    )
    got = selection.groupBy("mix_id", "source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"), F.count("*").alias("docs_used"),
        F.max("copies").alias("most_copies"), F.avg("copies").alias("mean_copies"),
    )
    rows = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens_used", "docs_used", "most_copies"])
    size = rows.groupBy("mix_id").agg(F.sum("tokens_used").alias("mix_tokens"), F.sum("tokens_wanted").alias("mix_wanted"))
    report = rows.join(F.broadcast(size), "mix_id").select(
        "mix_id", "source", "target_share", "max_repeats", "docs", "tokens", "tokens_wanted", "tokens_budget", "tokens_used",
        "docs_used", "most_copies", "mean_copies", "mix_tokens", "passes", "residual",
        F.coalesce(F.try_divide("tokens_used", "mix_wanted"), F.lit(0.0)).alias("share_of_wanted_size"),
        F.coalesce(F.try_divide("tokens_used", "mix_tokens"), F.lit(0.0)).alias("share_reached"),
    )
    return selection, report
