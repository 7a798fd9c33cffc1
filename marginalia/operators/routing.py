"""Routing between a cheap and a strong path: features, policies, thresholds, oracles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, router_tokens, word_count
from .order import running_sums

# The words whose mention in a question is a feature.
TABLE_WORDS = ("table", "tabular", "row", "column")
VISUAL_WORDS = ("figure", "graph", "chart", "plot", "image", "diagram")

EARLY = ("candidate_log", "question_tokens", "mentions_table", "mentions_visual", "caption_top", "caption_margin", "caption_entropy")
STRONG = ("strong_top", "strong_margin", "strong_entropy", "top_difference", "margin_difference", "entropy_difference")
INVARIANT = ("question_log_tokens", "question_token_diversity", "mentions_table", "mentions_visual", "caption_top", "caption_margin", "caption_entropy")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _mentions(question: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(question, F.lit(w))
    return _flag(found)


def _signal(signal: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_top": signal["top_score"],
        f"{prefix}_margin": signal["top_margin"],
        f"{prefix}_entropy": signal["normalized_entropy"],
    }


def early_features(question: Column, candidates: Column, caption: Column) -> dict[str, Column]:
    """Features known before the strong path runs; word flags look for substrings."""
    q = fold(question)
    return {
        "candidate_log": F.log1p(candidates),
        "question_tokens": word_count(q).cast("double"),
        "mentions_table": _mentions(q, TABLE_WORDS),
        "mentions_visual": _mentions(q, VISUAL_WORDS),
        **_signal(caption, "caption"),
    }


def inference_features(question: Column, candidates: Column, caption: Column, strong: Column) -> dict[str, Column]:
    """The early features and those that read the strong path's scores (so it saves nothing)."""
    parts = {"top": "top_score", "margin": "top_margin", "entropy": "normalized_entropy"}
    return {
        **early_features(question, candidates, caption),
        **_signal(strong, "strong"),
        **{f"{k}_difference": strong[v] - caption[v] for k, v in parts.items()},
    }


def invariant_features(question: Column, caption: Column) -> dict[str, Column]:
    """Features that do not depend on the number of candidates; word flags look for whole words."""
    t = router_tokens(question)
    n = F.size(t)
    return {
        "question_log_tokens": F.log1p(n),
        "question_token_diversity": F.size(F.array_distinct(t)) / F.greatest(n, F.lit(1)),
        "mentions_table": _flag(F.arrays_overlap(t, F.array(*map(F.lit, TABLE_WORDS)))),
        "mentions_visual": _flag(F.arrays_overlap(t, F.array(*map(F.lit, VISUAL_WORDS)))),
        **_signal(caption, "caption"),
    }


@dataclass(frozen=True)
class Policy:
    """A locked policy. causal: it reads nothing that only the strong path gives."""

    feature_names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    threshold: float
    causal: bool = True

    def probability(self, features: dict[str, Column], clip: float | None = None) -> Column:
        """Probability that the strong path is better; ValueError unless the features are the policy's."""
        if tuple(features) != self.feature_names:
            raise ValueError(f"the policy reads {self.feature_names}, not {tuple(features)}")
        z = F.lit(self.intercept)
        for c, m, s, w in zip(features.values(), self.mean, self.scale, self.coefficients):
            z = z + (c - F.lit(m)) / F.lit(s) * F.lit(w)
        if clip is not None:
            z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
        return 1.0 / (1.0 + F.exp(-z))

    def saving(self, strong_rate: Column) -> Column:
        """Share of strong calls saved; none if the policy needs the strong path to decide."""
        return (1.0 - strong_rate) if self.causal else F.lit(0.0)


# The published coefficients of the candidate policy on invariant features.
INVARIANT_POLICY = Policy(
    feature_names=INVARIANT,
    mean=(2.6735743780522543, 0.8966377008975929, 0.007984031936127744, 0.25149700598802394, 0.6801739487046016, 0.03728413971479305, 0.999795123789276),
    scale=(0.3374933703257007, 0.09224803993122473, 0.08899599524793632, 0.4338735552751306, 0.06466406233409024, 0.04549634294831621, 4.006280680294201e-05),
    coefficients=(-0.1374345717172717, -0.27139802364314103, -0.037948333986124204, -0.029235049960369526, -0.6243957349278036, -1.160206150681986, 0.10938917716738357),
    intercept=0.059150396732853945,
    threshold=0.2817383583665185,
)


def routed(p: Column, threshold: float, cheap: Column, strong: Column) -> Column:
    """The strong value where p reaches the threshold, else the cheap one."""
    return F.when(p >= F.lit(threshold), strong).otherwise(cheap)


def threshold_sweep(rows: DataFrame, metrics: dict[str, tuple[str, str]], p: str = "p") -> DataFrame:
    """For each distinct probability, and infinity (routing nothing): what routing from it on gives.

    metrics: name -> (cheap column, strong column). Ties are one threshold. Sums are collapsed
    to distinct probabilities, to nine places, and accumulated once over range partitions, which
    replaces scoring all rows anew for every candidate. No row gives no threshold.
    """
    names = [f"{m}_{side}" for m in metrics for side in ("c", "s")]
    sums = [F.sum(c).alias(n) for n, c in zip(names, (c for pair in metrics.values() for c in pair))]
    per = rows.withColumn("threshold", F.round(p, 9)).groupBy("threshold").agg(F.count("*").cast("double").alias("c"), *sums)
    totals = per.agg(*[F.sum(n).alias(f"all_{n}") for n in ("c", *names)])  # one row
    none = totals.where("all_c > 0").select(F.lit(float("inf")).alias("threshold"), *[F.lit(0.0).alias(n) for n in ("c", *names)])
    above = running_sums(per.unionByName(none), [-F.col("threshold")], {f"up_{n}": F.col(n) for n in ("c", *names)})
    routed_ = {n: F.col(f"up_{n}") + F.col(n) for n in ("c", *names)}
    n = F.col("all_c")
    return above.crossJoin(F.broadcast(totals)).select(
        "threshold",
        (routed_["c"] / n).alias("route_rate"),
        *[((routed_[f"{m}_s"] + F.col(f"all_{m}_c") - routed_[f"{m}_c"]) / n).alias(m) for m in metrics],
        *[(F.col(f"all_{m}_s") / n).alias(f"{m}_always_strong") for m in metrics],
    )


def best_threshold(
    sweep: DataFrame, max_route_rate: float, min_r1_retention: float = 0.0, min_mrr_retention: float = 0.0
) -> DataFrame:
    """The feasible threshold with the best mrr, then recall_at_1, then least routing; no row if none is."""
    ok = sweep.where(
        (F.col("route_rate") <= max_route_rate)
        & (F.col("recall_at_1") >= min_r1_retention * F.col("recall_at_1_always_strong"))
        & (F.col("mrr") >= min_mrr_retention * F.col("mrr_always_strong"))
    )
    order = [F.round("mrr", 9).desc(), F.round("recall_at_1", 9).desc(), F.round("route_rate", 9), F.col("threshold").desc()]
    return ok.orderBy(*order).limit(1)


def select_threshold(sweep: DataFrame, max_route_rate: float, min_r1_retention: float = 0.0, min_mrr_retention: float = 0.0):
    """best_threshold's only row; ValueError where no threshold meets the gates, as a policy cannot be locked then."""
    found = best_threshold(sweep, max_route_rate, min_r1_retention, min_mrr_retention).collect()
    if not found:
        raise ValueError(f"no threshold routes at most {max_route_rate} and keeps {min_r1_retention} and {min_mrr_retention}")
    return found[0]


def auc(rows: DataFrame, p: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where one class is missing."""
    keys = keys or []
    per = rows.groupBy(*keys, F.round(p, 9).alias("v")).agg(F.sum(y).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    ranked = running_sums(per, [*map(F.col, keys), F.col("v")], {"below": F.col("n") - F.col("pos")})
    # the running count goes on over the groups; what stood before a group is taken off
    won = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)) - F.sum("pos") * F.min("below")
    out = F.sum("pos") * (F.sum("n") - F.sum("pos"))
    return ranked.groupBy(*keys).agg(F.round(F.when(out > 0, won / out), 9).alias("auc"), F.sum("n").cast("long").alias("rows"))


def router_grid(
    train: DataFrame, calibration: DataFrame, names: list[str], cs: list[float], weights: list[float], gate: tuple[float, float, float]
) -> list[dict]:
    """Every combination of penalty and class weight: policy, threshold and what it gives, or infeasible.

    Both tables hold the features, y and the columns mrr_c, mrr_s, recall_at_1_c, recall_at_1_s.
    The loop runs over the handful of combinations; each fit and sweep is distributed.
    """
    found = []
    for c in cs:
        for w in weights:
            policy = fit_router(train, names, "y", c, w)
            p = policy.probability({n: F.col(n) for n in names})
            sweep = threshold_sweep(calibration.withColumn("p", p), {m: (f"{m}_c", f"{m}_s") for m in ("mrr", "recall_at_1")})
            best = best_threshold(sweep, *gate).collect()
            entry = {"c": c, "positive_weight": w, "policy": policy, "feasible": bool(best)}
            found.append(entry | ({k: best[0][k] for k in ("threshold", "mrr", "recall_at_1", "route_rate")} if best else {}))
    return found


def best_candidate(grid: list[dict], near: float = 1e-4) -> dict | None:
    """Among feasible candidates within `near` of the best mrr: most saving, least weight, least c."""
    feasible = [g for g in grid if g["feasible"]]
    if not feasible:
        return None
    top = max(g["mrr"] for g in feasible)
    return min((g for g in feasible if g["mrr"] >= top - near), key=lambda g: (g["route_rate"], g["positive_weight"], g["c"]))


def capability(cheap: Column, strong: Column) -> Column:
    """Which path suffices, in the words of the labels."""
    return (
        F.when(cheap & strong, "cheap_sufficient").when(cheap, "strong_regression").when(strong, "strong_needed").otherwise("both_fail")
    )


def sufficient(exact_count: Column, top: Column, loc: Column, min_top: float = 0.8, min_loc: float = 0.5) -> Column:
    """Exact count and both scores on or above their bounds; null fails."""
    return F.coalesce(exact_count & (top >= min_top) & (loc >= min_loc), F.lit(False))


def oracle_summary(rows: DataFrame, cheap: str, strong: str, cheap_cost: float, strong_cost: float, min_saving: float, max_ratio: float) -> DataFrame:
    """Counts and rates of capabilities, cost of a zero-cost oracle, and its gates, in one row.

    cheap_sufficient counts rows where both suffice; cheap_sufficient_rate is that of all cheap
    passes, as published.
    """
    c, s = F.col(cheap), F.col(strong)
    n = F.count("*")
    cheap_n, strong_n, any_n = F.count_if(c), F.count_if(s), F.count_if(c | s)
    label = capability(c, s)
    cost = (cheap_n * cheap_cost + (n - cheap_n) * strong_cost) / (n * strong_cost)
    one = rows.agg(
        n.alias("pages"),
        *[F.count_if(label == x).alias(x) for x in ("cheap_sufficient", "strong_needed", "both_fail", "strong_regression")],
        F.round(cheap_n / n, 9).alias("cheap_sufficient_rate"),
        F.round(strong_n / n, 9).alias("strong_sufficient_rate"),
        F.round(any_n / n, 9).alias("oracle_sufficient_rate"),
        F.round(F.lit(cheap_cost / strong_cost), 9).alias("cost_ratio"),
        F.round(cost, 9).alias("oracle_normalized_cost"),
        F.round(1 - cost, 9).alias("oracle_saving"),
        (strong_n > cheap_n).alias("gate_coverage"),
    )
    return one.withColumns(
        {"gate_saving": F.col("oracle_saving") >= min_saving, "gate_cost_ratio": F.col("cost_ratio") < max_ratio}
    ).withColumn("gate_passed", F.col("gate_saving") & F.col("gate_cost_ratio") & F.col("gate_coverage"))


def scaled(rows: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each feature; a constant one is scaled by 1."""
    r = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    return [r[f"m_{n}"] for n in names], [r[f"s_{n}"] or 1.0 for n in names]


def fit_router(rows: DataFrame, names: list[str], label: str = "y", c: float = 1.0, positive_weight: float = 1.0) -> Policy:
    """A logistic policy on standardised features, penalised by 1/(2 c) against summed losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    mean, scale = scaled(rows, names)
    w = F.when(F.col(label) > 0, F.lit(positive_weight)).otherwise(1.0)
    z = rows.select(
        *[((F.col(n) - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (n, m, s) in enumerate(zip(names, mean, scale))],
        F.col(label).cast("double").alias("label"),
        w.alias("weight"),
    )
    total = z.agg(F.sum("weight")).first()[0] or 1.0
    data = VectorAssembler(inputCols=[f"z{i}" for i in range(len(names))], outputCol="features").transform(z)
    model = LogisticRegression(
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=500, tol=1e-10
    ).fit(data.select("features", "label", "weight"))
    return Policy(tuple(names), tuple(mean), tuple(scale), tuple(float(x) for x in model.coefficients), float(model.intercept), 0.5)
