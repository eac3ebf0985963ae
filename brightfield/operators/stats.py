"""Comparison statistics: intervals, rank statistics, fits, bootstrap, kernel distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from .ordered import running


def quality_report(df: DataFrame, correct: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """``total, correct, accuracy, average_score``, overall (zeros for no rows) or for each group."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(score).alias("average_score")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("accuracy", "average_score")})


def rate_with_interval(df: DataFrame, by: list[str], hit: Column, z: float = 1.959963984540054) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"))
    low, high = N.wilson(F.col("correct"), F.col("n"), z)
    return out.select(*by, "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), low.alias("wilson_low"), high.alias("wilson_high"))


def auroc(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """``n_pos, n_neg, auroc, rank_biserial``: share of positive-negative pairs in the right order, ties half.

    Scores are counted first, so what is ordered has one row for each distinct score. Null where a side is empty.
    """
    by = by or []
    counted = df.select(*by, score.cast("double").alias("s"), positive.alias("p")).filter("s IS NOT NULL AND p IS NOT NULL").groupBy(*by, "s").agg(
        F.count_if("p").cast("long").alias("pos"), F.count_if(~F.col("p")).cast("long").alias("neg")
    )
    if by:
        w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        ordered = counted.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    else:
        ordered = running(counted, [F.col("s")], {"below": "neg"}, "auroc")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    sums = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")]
    out = ordered.groupBy(*by).agg(*sums) if by else ordered.agg(*sums)
    pairs = F.col("n_pos") * F.col("n_neg")
    area = F.when(pairs > 0, F.col("wins") / pairs)
    return out.select(*by, "n_pos", "n_neg", area.alias("auroc"), (2 * area - 1).alias("rank_biserial"))


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Ranks from 1 in each group, ties sharing the mean of their places."""
    part = Window.partitionBy(*by, value)
    return df.withColumn("avg_rank", F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(part) - 1) / 2)


def ngram_l2(df: DataFrame, text: str, side: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``n, l2``: distance of the word n-gram distributions of two sides (``side`` true or false)."""
    most = max(sizes)
    words = df.select(side.alias("side"), X.split_words(X.normalise(F.col(text))).alias("w")).filter("side IS NOT NULL")
    # a row for each place with the words from there on; n-grams are then joined in generated code, not inside array functions
    ahead = F.arrays_zip(*(F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{k}") for k in range(most)))
    places = words.select("side", ahead.alias("z")).select("side", F.inline("z").alias(*(f"w{k}" for k in range(most))))
    gram = lambda n: F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", *(f"w{k}" for k in range(n))))
    grams = places.select("side", F.inline(F.array(*(F.struct(F.lit(n).alias("n"), gram(n).alias("g")) for n in sizes)))).filter("g IS NOT NULL")
    counts = grams.groupBy("n", "g").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b"))
    # the sum of squares of a / ta - b / tb from sums of products: no second pass for the totals
    total = lambda x: F.sum(x.cast("double"))
    sums = counts.groupBy("n").agg(*(total(F.col(x) * F.col(y)).alias(f"{x}{y}") for x, y in ("aa", "ab", "bb")), total(F.col("a")).alias("ta"), total(F.col("b")).alias("tb"))
    part = lambda x, y, z: F.coalesce(F.col(x) / F.nullif(F.col(y) * F.col(z), F.lit(0.0)), F.lit(0.0))
    return sums.select("n", F.sqrt(F.greatest(F.lit(0.0), part("aa", "ta", "ta") - 2 * part("ab", "ta", "tb") + part("bb", "tb", "tb"))).alias("l2"))


def _blocks(df: DataFrame, id_: str, vector: str, rows: int) -> tuple[DataFrame, int]:
    """Vectors gathered in blocks by hash of the id (``blk, m``), and the number of blocks."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn("blk", F.pmod(F.xxhash64(id_), F.lit(n))).groupBy("blk").agg(F.collect_list(F.struct(F.col(id_).alias("i"), F.col(vector).alias("v"))).alias("m")), n


def kernel_sums(left: DataFrame, right: DataFrame, id_: str, vector: str, bandwidth: float, kernel: str = "rbf", alpha: float = 1.0, rows: int = 2000) -> DataFrame:
    """``i, s, m``: for each left row, the sum of its kernel with all right rows of another id, and their number.

    Blocks of rows meet blocks of rows as matrices; a pair of blocks gives one row for each left row, not one a pair.
    """
    (a, _), (b, n) = _blocks(left, id_, vector, rows), _blocks(right, id_, vector, rows)
    # block numbers are dealt to each other explicitly: each left block goes once to every right block
    pairs = a.withColumnRenamed("m", "ma").withColumn("right_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    joined = pairs.join(b.select(F.col("blk").alias("right_blk"), F.col("m").alias("mb")), "right_blk")

    def run(batches):
        for pdf in batches:
            for ma, mb in zip(pdf["ma"], pdf["mb"], strict=True):
                x, y = (np.array([np.asarray(r["v"], np.float64) for r in m]) for m in (ma, mb))
                i, j = (np.array([r["i"] for r in m], np.int64) for m in (ma, mb))
                d2 = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)
                k = np.exp(-d2 / (2 * bandwidth**2)) if kernel == "rbf" else (1 + d2 / (2 * alpha * bandwidth**2)) ** -alpha
                other = i[:, None] != j
                yield pd.DataFrame({"i": i, "s": (k * other).sum(1), "m": other.sum(1)})

    return joined.select("ma", "mb").mapInPandas(run, "i long, s double, m long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))


def mmd2(left: DataFrame, right: DataFrame, id_: str, vector: str, bandwidth: float, kernel: str = "rbf", alpha: float = 1.0) -> DataFrame:
    """Unbiased squared kernel distance of two sets of vectors, one row; null if a side has fewer than two rows."""

    def mean(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        total = kernel_sums(a, b, id_, vector, bandwidth, kernel, alpha).agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
        return total.select(F.lit(1).alias("k"), (F.col("s") / F.nullif(F.col("m"), F.lit(0))).alias(name))

    out = mean(left, left, "xx").join(mean(right, right, "yy"), "k").join(mean(left, right, "xy"), "k")
    return out.select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd2"))


def mmd_witness(rows: DataFrame, references: DataFrame, id_: str, vector: str, bandwidth: float, kernel: str = "rq", alpha: float = 1.0) -> DataFrame:
    """``i, witness``: mean kernel with the references less that with the other rows, centred over all rows."""
    to_refs = kernel_sums(rows, references, id_, vector, bandwidth, kernel, alpha).select("i", (F.col("s") / F.col("m")).alias("r"))
    to_rows = kernel_sums(rows, rows, id_, vector, bandwidth, kernel, alpha).select("i", (F.col("s") / F.nullif(F.col("m"), F.lit(0))).alias("o"))
    raw = to_refs.join(to_rows, "i").select("i", (F.col("r") - F.coalesce("o", F.lit(0.0))).alias("w"), F.lit(1).alias("k"))
    centre = raw.groupBy("k").agg(F.avg("w").alias("c"))
    return raw.join(centre, "k").select("i", (F.col("w") - F.col("c")).alias("witness"))


def mean_direction(df: DataFrame, vector: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Difference of the mean vectors of both sides, as an array (for each group)."""
    by = by or []
    parts = df.select(*by, positive.alias("p"), F.posexplode(vector).alias("d", "x"))
    dims = parts.groupBy(*by, "d").agg((F.avg(F.when(F.col("p"), F.col("x"))) - F.avg(F.when(~F.col("p"), F.col("x")))).alias("x"))
    arr = F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("direction")
    return dims.groupBy(*by).agg(arr) if by else dims.agg(arr)


def leave_one_out_scores(df: DataFrame, group: str, id_: str, vector: str, positive: Column) -> DataFrame:
    """``id, group, positive, score``: each row along the direction learned without its own group.

    Sums over all groups less those of the own group give that direction, so the data are summed once.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(group).alias("grp"), positive.alias("p"), F.col(vector).alias("v"))
    dims = rows.select("id", "grp", "p", F.posexplode("v").alias("d", "x"))
    sums = dims.groupBy("grp", "d").agg(
        F.sum(F.when(F.col("p"), F.col("x"))).alias("sp"), F.count_if("p").alias("np"), F.sum(F.when(~F.col("p"), F.col("x"))).alias("sn"), F.count_if(~F.col("p")).alias("nn")
    )
    total = sums.groupBy("d").agg(*(F.sum(c).alias(f"t_{c}") for c in ("sp", "np", "sn", "nn")))
    left = lambda c: F.col(f"t_{c}") - F.coalesce(c, F.lit(0))
    direction = sums.join(total, "d").select("grp", "d", (left("sp") / F.nullif(left("np"), F.lit(0)) - left("sn") / F.nullif(left("nn"), F.lit(0))).alias("w"))
    by_group = direction.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "w"))), lambda s: s["w"]).alias("w"))
    return rows.join(by_group, "grp").select("id", "grp", "p", N.dot(F.col("v"), F.col("w")).alias("score"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, rounds: int = 100) -> np.ndarray:
    """Ridge logistic coefficients (first column: the intercept, not penalised) by Newton's method on weighted rows."""
    weight = np.ones(len(y)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-7))[:, None]).T @ x + np.diag(shrink)
        slope = x.T @ (weight * (y - p)) - shrink * beta
        move = np.linalg.lstsq(curvature, slope, rcond=None)[0]
        beta = beta + move
        if np.abs(move).max() < 1e-7:
            break
    return beta


def frontier(depth: np.ndarray, correct: np.ndarray, total: np.ndarray, ridge: float = 1e-4) -> dict:
    """Logistic curve over depth from counts, and the depths of 80, 50 and 20 per cent (null unless it falls)."""
    x = np.column_stack([np.ones(2 * len(depth)), np.concatenate([depth, depth])])
    b0, b1 = fit_logistic(x, np.repeat([1.0, 0.0], len(depth)), np.concatenate([correct, total - correct]).astype(float), ridge)
    out = {"beta0": b0, "beta1": b1, "n": int(total.sum())} | dict.fromkeys(("d80", "d50", "d20", "falloff_width"))
    if b1 < -1e-8:
        for p in (80, 50, 20):
            out[f"d{p}"] = (math.log(p / (100 - p)) - b0) / b1
        out["falloff_width"] = out["d20"] - out["d80"]
    return out


_FRONTIER = "beta0 double, beta1 double, n long, d80 double, d50 double, d20 double, falloff_width double"


def depth_logistic(df: DataFrame, by: str, depth: Column, hit: Column) -> DataFrame:
    """One fitted curve for each group; the counts by depth reach the fit, not the rows."""
    counts = df.groupBy(F.col(by).alias("grp"), depth.cast("double").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0]} | frontier(*(pdf[c].to_numpy(float) for c in ("depth", "c", "n")))])

    return counts.groupBy("grp").applyInPandas(run, f"grp string, {_FRONTIER}")


def bootstrap(df: DataFrame, depth: Column, hit: Column, replicates: int = 200, seed: int = 20260811) -> DataFrame:
    """``replicate`` and its curve: rows are drawn again inside each depth, which is a binomial draw of its hits."""
    counts = df.groupBy(depth.cast("double").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("c"))
    copies = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth")
        number = int(pdf["replicate"].iloc[0])
        d, n, c = (pdf[k].to_numpy(float) for k in ("depth", "n", "c"))
        drawn = np.random.default_rng([seed, number]).binomial(n.astype(np.int64), c / n)
        return pd.DataFrame([{"replicate": number} | frontier(d, drawn, n)])

    return copies.groupBy("replicate").applyInPandas(run, f"replicate int, {_FRONTIER}")


def bootstrap_summary(samples: DataFrame) -> DataFrame:
    """``measure, median, low, high, valid_fraction`` of the replicates that have the measure."""
    keys = ("d80", "d50", "d20", "falloff_width")
    long = samples.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in keys))).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.groupBy("measure").agg(q.alias("q"), (F.count("v") / F.count(F.lit(1))).alias("valid_fraction")).select(
        "measure", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(2)).alias("high"), "valid_fraction"
    )


def isotonic_decreasing(df: DataFrame, by: str, x: Column, hit: Column) -> DataFrame:
    """``grp, x, n, rate, fitted``: rates by x and their decreasing weighted fit, a row for each distinct x.

    Neighbours that rise are pooled, in time linear in the distinct x of a group (counted first).
    """
    counts = df.groupBy(F.col(by).alias("grp"), x.cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        hits, n = pdf["c"].to_numpy(float), pdf["n"].to_numpy(float)
        pools: list[list[float]] = []  # hits, weight and points of each run of equal fits; their rates fall
        for h, w in zip(hits.tolist(), n.tolist(), strict=True):
            pools.append([h, w, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] < pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        fitted = np.repeat([h / w for h, w, _ in pools], [int(k) for _, _, k in pools])
        return pd.DataFrame({"grp": pdf["grp"], "x": pdf["x"], "n": pdf["n"], "rate": hits / n, "fitted": fitted})

    return counts.groupBy("grp").applyInPandas(run, "grp string, x double, n long, rate double, fitted double")


def softmax_model(df: DataFrame, text: str, label: str, min_frequency: int = 2, l2: float = 0.01, rounds: int = 50):
    """Multinomial bag-of-words classifier: a fitted ``pyspark.ml`` pipeline over L1-normalised term frequencies."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="bag", pattern=r"[\p{L}\p{N}']+", gaps=False),
        CountVectorizer(inputCol="bag", outputCol="tf", minDF=min_frequency, vocabSize=1 << 16),
        Normalizer(inputCol="tf", outputCol="features", p=1.0),
        LogisticRegression(featuresCol="features", labelCol="label_no", family="multinomial", regParam=l2, maxIter=rounds),
    ]
    return Pipeline(stages=stages).fit(df)


def group_advantages(df: DataFrame, by: list[str], reward: str, eps: float = 1e-4) -> DataFrame:
    """``advantage``: reward less its group's mean, over the group's standard deviation plus ``eps``."""
    sums = df.groupBy(*by).agg(F.avg(reward).alias("group_mean"), F.stddev_pop(reward).alias("group_std"))
    return df.join(sums, by).withColumn("advantage", (F.col(reward) - F.col("group_mean")) / (F.col("group_std") + eps))


def coordinate_summary(df: DataFrame, column: str) -> DataFrame:
    """``n, mean, upper_median`` of a column: the median is the element at place n // 2 of the sorted values, never a mean of two.

    Values are counted first, so the walk is over distinct values.
    """
    counted = running(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("m")), [F.col("v")], {"below": "m"}, "summary")
    total = counted.agg(F.sum("m").alias("n"), (F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("mean")).withColumn("k", F.lit(1))
    place = F.floor(F.col("n") / 2)
    return counted.withColumn("k", F.lit(1)).join(total, "k").filter((F.col("below") <= place) & (place < F.col("below") + F.col("m"))).select("n", "mean", F.col("v").alias("upper_median"))


def surface_features(df: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """``features``: the columns and the products of pairs of them, as one vector column."""
    from pyspark.ml.feature import VectorAssembler

    made = df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})
    inputs = [*names, *(f"{a}_x_{b}" for a, b in pairs)]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(made.withColumns({c: F.col(c).cast("double") for c in inputs}))


def fit_surface(df: DataFrame, names: list[str], pairs: list[tuple[str, str]], label: str, ridge: float = 0.1):
    """Ridge logistic surface: ``ridge`` counts against the sum of losses, so it is divided by the rows for a mean of losses."""
    from pyspark.ml.classification import LogisticRegression

    rows = surface_features(df.withColumn("label_d", F.col(label).cast("double")), names, pairs)
    n = max(1, rows.count())
    return LogisticRegression(featuresCol="features", labelCol="label_d", regParam=ridge / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)


def boundary_score(probability: Column) -> Column:
    return 4 * probability * (1 - probability)


def paired_bootstrap(left: DataFrame, right: DataFrame, key: str, depth: str, hit: str, replicates: int = 200, seed: int = 20260811) -> DataFrame:
    """``replicate, left_d50, right_d50, delta``: both arms drawn again together, on the ids they share.

    A drawn id brings both arms' outcomes, so what is drawn inside a depth is a multinomial over the four outcomes.
    """
    both = left.select(key, F.col(depth).cast("double").alias("depth"), F.col(hit).alias("a")).join(right.select(key, F.col(hit).alias("b")), key)
    counts = both.groupBy("depth").agg(*(F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(f"c{int(x)}{int(y)}") for x in (True, False) for y in (True, False)))
    copies = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth")
        number = int(pdf["replicate"].iloc[0])
        rng = np.random.default_rng([seed, number])
        cells = pdf[["c11", "c10", "c01", "c00"]].to_numpy(np.int64)
        drawn = np.array([rng.multinomial(c.sum(), c / c.sum()) for c in cells])
        d, n = pdf["depth"].to_numpy(float), drawn.sum(1).astype(float)
        a, b = (frontier(d, k.astype(float), n)["d50"] for k in (drawn[:, 0] + drawn[:, 1], drawn[:, 0] + drawn[:, 2]))
        return pd.DataFrame({"replicate": [number], "left_d50": [a], "right_d50": [b], "delta": [None if a is None or b is None else b - a]}).astype({c: "float64" for c in ("left_d50", "right_d50", "delta")})

    return copies.groupBy("replicate").applyInPandas(run, "replicate int, left_d50 double, right_d50 double, delta double")


def transfer(df: DataFrame, fitted: Column, tested: Column, id_: str, vector: str, positive: Column) -> DataFrame:
    """AUROC on the tested rows along the class direction of the fitted rows."""
    direction = mean_direction(df.filter(fitted), vector, positive).withColumn("k", F.lit(1))
    scored = df.filter(tested).withColumn("k", F.lit(1)).join(direction, "k").withColumn("score", F.round(N.dot(F.col(vector), F.col("direction")), 12))
    return auroc(scored, F.col("score"), positive)
