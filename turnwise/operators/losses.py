"""Token-wise policy algebra as Column expressions, and its aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.tensors import entropy


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def kl(new: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of the divergence of log-probabilities: k1, abs, k2, k3 (its argument held to ±20 and its value to ±10)."""
    d = new - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        r = clamp(-d, -20.0, 20.0)
        return clamp(F.exp(r) - r - 1, -10.0, 10.0)
    raise ValueError(f"no estimator {kind}")


def clipped_policy_loss(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The pessimistic one of plain and clipped ratio times advantage; for negative advantages at most `dual` times the advantage."""
    ratio = F.exp(clamp(new - old, -20.0, 20.0))
    loss = F.greatest(-advantage * ratio, -advantage * clamp(ratio, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(-advantage * dual, loss)).otherwise(loss)


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> Column:
    held = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - target) * (value - target), (held - target) * (held - target))


def masked_mean(x: Column, mask: Column) -> Column:
    """An aggregate: the sum over the mask, divided by the mask's sum and a little."""
    return F.sum(x * mask) / (F.sum(mask) + F.lit(1e-8))


def masked_stats(df: DataFrame, value: str, mask: str, *by: str) -> DataFrame:
    """by, masked_sum, masked_mean, masked_var (with Bessel's correction; null for fewer than two)."""
    m, x = F.col(mask).cast("double"), F.col(value)
    sums = df.groupBy(*by).agg(F.sum(m).alias("n"), F.sum(x * m).alias("masked_sum"), F.sum(x * x * m).alias("_sq"))
    mean = F.col("masked_sum") / (F.col("n") + 1e-8)
    var = F.try_divide(F.col("_sq") - F.col("masked_sum") * F.col("masked_sum") / F.nullif("n", F.lit(0.0)), F.col("n") - 1)
    return sums.select(*by, "n", "masked_sum", mean.alias("masked_mean"), F.when(F.col("n") > 1, var).alias("masked_var"))


def aggregate_loss(df: DataFrame, loss: str, mask: str, row: str, mode: str = "token-mean", longest: int | None = None) -> DataFrame:
    """loss: over tokens (row, loss, mask), by token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm.

    The last divides the sum over all rows by the length of a row, `longest`; without it by that of the longest row."""
    m, x = F.col(mask).cast("double"), F.col(loss)
    if mode == "token-mean":
        return df.agg((F.sum(x * m) / F.sum(m)).alias("loss"))
    per = df.groupBy(row).agg(F.sum(x * m).alias("s"), F.sum(m).alias("n"), F.count("*").alias("length"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.try_divide("s", "n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / (F.lit(longest) if longest else F.max("length"))).alias("loss"))
    raise ValueError(f"no mode {mode}")


def importance_weights(
    df: DataFrame, new: str, old: str, row: str, level: str = "sequence", upper: float = 2.0, lower: float | None = None, mode: str = "truncate", mask: str | None = None, veto: float | None = None
) -> DataFrame:
    """The tokens' rows (or the tokens, at level token) with raw, weight, kept, vetoed: the ratio between two sets of token log-probabilities.

    Levels: token; sequence (product over a row), geometric (mean over a row). Log ratios are held to ±20. Weights
    above `upper` are cut to it (truncate), or those outside the bounds are 0 and not kept (mask); `lower` is 1 / upper
    by default. A row with a token whose ratio is below `veto` has the weight 0. Masked tokens count for nothing."""
    low = 1 / upper if lower is None else lower
    on = F.col(mask) > 0 if mask else F.lit(True)
    d = F.when(on, F.col(new) - F.col(old))
    bad = F.coalesce(d < F.log(F.lit(veto)), F.lit(False)) if veto else F.lit(False)
    if level == "token":
        w = df.withColumn("raw", F.exp(clamp(F.col(new) - F.col(old), -20.0, 20.0))).withColumn("vetoed", F.max(bad).over(W.partitionBy(row)) if veto else F.lit(False))
        keep = [*df.columns]
    elif level in ("sequence", "geometric"):
        log = F.sum(d) if level == "sequence" else F.sum(d) / (F.count(d) + 1e-8)
        w = df.groupBy(row).agg(F.exp(clamp(F.coalesce(log, F.lit(0.0)), -20.0, 20.0)).alias("raw"), F.max(bad).alias("vetoed"))
        keep = [row]
    else:
        raise ValueError(f"no level {level}")
    inside = (F.col("raw") <= upper) & (F.col("raw") >= low)
    held = F.least("raw", F.lit(upper)) if mode == "truncate" else F.when(inside, F.col("raw")).otherwise(0.0)
    kept = F.lit(True) if mode == "truncate" else inside
    own = on if level == "token" else F.lit(True)
    return w.select(*keep, "raw", F.when(F.col("vetoed") | ~own, 0.0).otherwise(held).alias("weight"), (kept & ~F.col("vetoed")).alias("kept"), "vetoed")


def weight_metrics(df: DataFrame, new: str, old: str, row: str, mask: str, upper: float = 2.0, lower: float | None = None, veto: float | None = 1e-4) -> DataFrame:
    """One row of metrics of token weights: mean, low, high, std and effective share of the held weights, shares above and below the bounds, of vetoed rows and tokens, and of rows' mean weights."""
    low = 1 / upper if lower is None else lower
    m = F.col(mask).cast("double")
    d = F.col(new) - F.col(old)
    raw = F.exp(clamp(d, -20.0, 20.0))
    held = clamp(raw, low, upper)
    bad = ((d < F.log(F.lit(veto if veto else 0.0))) & (m > 0)) if veto else F.lit(False)
    per = df.groupBy(row).agg(
        F.sum(m).alias("n"), F.sum(raw * m).alias("w"), F.max(F.when(m > 0, raw)).alias("hi"), F.min(F.when(m > 0, raw)).alias("lo"), F.sum(held * m).alias("h"), F.sum(held * held * m).alias("hh"),
        F.sum((raw > upper).cast("double") * m).alias("above"), F.sum((raw < low).cast("double") * m).alias("below"), F.max(bad).alias("veto"), F.sum(bad.cast("double")).alias("bad"),
    ).withColumn("mean", F.col("w") / (F.col("n") + 1e-8))
    total = F.sum("n")
    mean = F.sum("h") / total
    return per.agg(
        (F.sum("w") / total).alias("weight_mean"), F.max("hi").alias("weight_max"), F.min("lo").alias("weight_min"), F.sqrt(F.greatest(F.sum("hh") / total - mean * mean, F.lit(0.0))).alias("weight_std"),
        (mean * mean * total / F.sum("hh")).alias("effective_share"), (F.sum("above") / total).alias("share_high"), (F.sum("below") / total).alias("share_low"),
        F.avg(F.col("veto").cast("double")).alias("vetoed_rows"), (F.sum("bad") / total).alias("vetoed_tokens"),
        F.avg("mean").alias("row_mean"), F.stddev_samp("mean").alias("row_std"), F.max("mean").alias("row_max"), F.min("mean").alias("row_min"), F.max(F.abs(F.col("mean") - 1)).alias("row_deviation"),
        F.avg((F.col("mean") > upper).cast("double")).alias("row_share_high"), F.avg((F.col("mean") < low).cast("double")).alias("row_share_low"),
    )


def mismatch(df: DataFrame, new: str, old: str, row: str, mask: str | None = None) -> DataFrame:
    """One row of two sets of token log-probabilities: kl and k3 over tokens; perplexities, their logarithms, differences and ratio as means over rows; ess of the rows' geometric weights."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    d = F.col(new) - F.col(old)
    per = df.groupBy(row).agg(F.sum(m).alias("n"), F.sum(F.col(new) * m).alias("sn"), F.sum(F.col(old) * m).alias("so"), F.sum((F.exp(d) - d - 1) * m).alias("k3"))
    per = per.select("n", "k3", "sn", "so", (F.col("sn") / (F.col("n") + 1e-8)).alias("mn"), (F.col("so") / (F.col("n") + 1e-8)).alias("mo"))
    per = per.withColumn("gap", F.col("mo") - F.col("mn")).withColumn("w", F.exp(clamp(-F.col("gap"), -20.0, 20.0)))
    return per.agg(
        (F.sum(F.col("so") - F.col("sn")) / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3"), F.avg(F.exp(-F.col("mn"))).alias("ppl_new"), F.avg(F.exp(-F.col("mo"))).alias("ppl_old"),
        F.avg(-F.col("mn")).alias("log_ppl_new"), F.avg(-F.col("mo")).alias("log_ppl_old"), F.avg("gap").alias("log_ppl_diff"), F.avg(F.abs("gap")).alias("log_ppl_abs_diff"), F.max("gap").alias("log_ppl_diff_max"), F.min("gap").alias("log_ppl_diff_min"),
        F.avg(F.exp("gap")).alias("ppl_ratio"), (F.sum("w") * F.sum("w") / (F.count("*") * F.sum(F.col("w") * F.col("w")))).alias("ess"),
    )


# ---- policy losses by name ---------------------------------------------------------------------------------------

POLICY_LOSSES: dict[str, Callable[..., DataFrame]] = {}


def policy_loss(name: str) -> Callable:
    """Register a loss under a name; names are unique."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if POLICY_LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"{name} is taken")
        return f

    return add


def loss_named(name: str) -> Callable[..., DataFrame]:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no loss {name}; there are {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name]


def _mean(x: Column, m: Column) -> Column:
    return F.sum(x * m) / (F.sum(m) + 1e-8)


@policy_loss("vanilla")
def vanilla_loss(df: DataFrame, row: str = "uid", new: str = "new", old: str = "old", advantage: str = "advantage", mask: str = "mask", low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean") -> DataFrame:
    """loss, clip_share, kl, lower_share of the clipped ratio with its bound for negative advantages."""
    a, m = F.col(advantage), F.col(mask).cast("double")
    ratio = F.exp(clamp(F.col(new) - F.col(old), -20.0, 20.0))
    held = F.greatest(-a * ratio, -a * clamp(ratio, 1 - low, 1 + high))
    rows = df.withColumn("_loss", clipped_policy_loss(F.col(new), F.col(old), a, low, high, dual))
    shares = rows.agg(_mean((-a * clamp(ratio, 1 - low, 1 + high) > -a * ratio).cast("double"), m).alias("clip_share"), _mean(clamp(F.col(old) - F.col(new), -20.0, 20.0), m).alias("kl"), _mean(((held > -a * dual) & (a < 0)).cast("double"), m).alias("lower_share"))
    return aggregate_loss(rows, "_loss", mask, row, mode).crossJoin(F.broadcast(shares))  # one row each


@policy_loss("gspo")
def sequence_loss(df: DataFrame, row: str = "uid", new: str = "new", old: str = "old", advantage: str = "advantage", mask: str = "mask", low: float = 0.2, high: float = 0.2) -> DataFrame:
    """loss, clip_share, kl: the ratio is the geometric mean over a row (its logarithm at most 10), the loss the mean of the rows' means."""
    a, m = F.col(advantage), F.col(mask).cast("double")
    w = W.partitionBy(row)
    ratio = F.exp(F.least(F.sum((F.col(new) - F.col(old)) * m).over(w) / F.greatest(F.sum(m).over(w), F.lit(1.0)), F.lit(10.0)))
    rows = df.withColumn("_r", ratio).withColumn("_plain", -a * F.col("_r")).withColumn("_held", -a * clamp(F.col("_r"), 1 - low, 1 + high)).withColumn("_loss", F.greatest("_plain", "_held"))
    shares = rows.agg(_mean((F.col("_held") > F.col("_plain")).cast("double"), m).alias("clip_share"), _mean(F.col(old) - F.col(new), m).alias("kl"))
    return aggregate_loss(rows, "_loss", mask, row, "seq-mean-token-mean").crossJoin(F.broadcast(shares))


@policy_loss("gpg")
def plain_gradient_loss(df: DataFrame, row: str = "uid", new: str = "new", advantage: str = "advantage", mask: str = "mask", mode: str = "token-mean") -> DataFrame:
    """loss: minus log-probability times advantage."""
    return aggregate_loss(df.withColumn("_loss", -F.col(new) * F.col(advantage)), "_loss", mask, row, mode)


def covariances(df: DataFrame, new: str, advantage: str, mask: str) -> DataFrame:
    """`df` with cov: the product of each token's distances from the masked means; null for masked tokens. The means are one row."""
    m = F.col(mask).cast("double")
    means = df.agg(_mean(F.col(new), m).alias("_mn"), _mean(F.col(advantage), m).alias("_ma"))
    rows = df.crossJoin(F.broadcast(means))
    return rows.withColumn("cov", F.when(m > 0, (F.col(new) - F.col("_mn")) * (F.col(advantage) - F.col("_ma")))).drop("_mn", "_ma")


def _edge(df: DataFrame, order: Column, k: int) -> float | None:
    """The k-th value in ascending order: a top-k of bounded share whose last row alone reaches the driver."""
    last = df.select(order.alias("o")).where("o IS NOT NULL").orderBy("o").limit(k).agg(F.max("o")).first()
    return last[0]


@policy_loss("clip_cov")
def clip_cov_loss(
    df: DataFrame, row: str = "uid", new: str = "new", old: str = "old", advantage: str = "advantage", mask: str = "mask", key: str = "event_id", share: float = 0.0002, bounds: tuple[float, float] = (1.0, 5.0), low: float = 0.2, high: float = 0.2, mode: str = "token-mean", seed: int = 0
) -> DataFrame:
    """loss, clip_share, kl: a share of all tokens, drawn by hash among those whose covariance lies between the bounds and that the clip leaves alone, counts nothing."""
    a, m = F.col(advantage), F.col(mask).cast("double")
    ratio = F.exp(F.col(new) - F.col(old))
    rows = covariances(df, new, advantage, mask).withColumn("_plain", -a * ratio).withColumn("_held", -a * clamp(ratio, 1 - low, 1 + high))
    open_ = (m > 0) & ~(F.col("_held") > F.col("_plain")) & (F.col("cov") > bounds[0]) & (F.col("cov") < bounds[1])
    draw = F.when(open_, F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))))
    k = max(1, int(share * (df.agg(F.sum(m)).first()[0] or 0)))
    edge = _edge(rows, draw, k)
    out = rows.withColumn("_off", F.coalesce(draw <= F.lit(edge), F.lit(False))).withColumn("_loss", F.when(F.col("_off"), 0.0).otherwise(F.greatest("_plain", "_held")))
    shares = out.agg(_mean(F.col("_off").cast("double"), m).alias("clip_share"), _mean(F.col(old) - F.col(new), m).alias("kl"))
    return aggregate_loss(out, "_loss", mask, row, mode).crossJoin(F.broadcast(shares))


@policy_loss("kl_cov")
def kl_cov_loss(df: DataFrame, row: str = "uid", new: str = "new", old: str = "old", advantage: str = "advantage", mask: str = "mask", share: float = 0.0002, weight: float = 1.0, mode: str = "token-mean") -> DataFrame:
    """loss, kl: the tokens with the largest covariance (a share of all, one at least) also pay their absolute log ratio."""
    m = F.col(mask).cast("double")
    gap = F.col(new) - F.col(old)
    rows = covariances(df, new, advantage, mask)
    k = max(1, int(share * rows.where("cov IS NOT NULL").count()))
    edge = _edge(rows, -F.col("cov"), k)
    out = rows.withColumn("_loss", -F.col(advantage) * F.exp(gap) + F.when(-F.col("cov") <= F.lit(edge), weight * F.abs(gap)).otherwise(0.0))
    return aggregate_loss(out, "_loss", mask, row, mode).crossJoin(F.broadcast(out.agg(_mean(F.abs(gap), m).alias("kl"))))


@policy_loss("geo_mean")
def geometric_loss(df: DataFrame, row: str = "uid", new: str = "new", old: str = "old", advantage: str = "advantage", mask: str = "mask", low: float = 0.2, high: float = 0.2) -> DataFrame:
    """loss, clip_share, lower_share, kl: each row's mean advantage times the geometric mean of its pessimistically held ratios."""
    a, m = F.col(advantage), F.col(mask).cast("double")
    gap = F.col(new) - F.col(old)
    held = F.greatest(F.least(gap, F.lit(high)), F.lit(-low))
    worse = F.signum(a) * F.least(F.signum(a) * gap, F.signum(a) * held)
    per = df.groupBy(row).agg(_mean(worse, m).alias("g"), _mean(a, m).alias("a"))
    shares = df.agg(_mean(((gap != held) & (a > 0)).cast("double"), m).alias("clip_share"), _mean(((gap != held) & (a < 0)).cast("double"), m).alias("lower_share"), _mean(-gap, m).alias("kl"))
    return per.agg(F.avg(-F.col("a") * F.exp("g")).alias("loss")).crossJoin(F.broadcast(shares))


def entropy_loss(df: DataFrame, logits: str, row: str = "uid", mask: str = "mask", mode: str = "token-mean") -> DataFrame:
    """loss: the entropy of each token's array of logits."""
    return aggregate_loss(df.withColumn("_loss", entropy(F.col(logits))), "_loss", mask, row, mode)


def value_loss_of(df: DataFrame, value: str, old: str, target: str, row: str, mask: str, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """loss, clip_share of the held value loss."""
    v, o, t, m = F.col(value), F.col(old), F.col(target), F.col(mask).cast("double")
    held = F.greatest(F.least(v, o + clip), o - clip)
    rows = df.withColumn("_loss", value_loss(v, o, t, clip))
    return aggregate_loss(rows, "_loss", mask, row, mode).crossJoin(F.broadcast(rows.agg(_mean(((held - t) * (held - t) > (v - t) * (v - t)).cast("double"), m).alias("clip_share"))))


# ---- rewards and their divergence --------------------------------------------------------------------------------


def penalized(score: Column, new: Column, ref: Column, beta: float, kind: str = "k1", mask: Column | None = None) -> Column:
    """A token's score minus its divergence from the reference, weighed by beta."""
    d = kl(new, ref, kind)
    return score - beta * (d * mask if mask is not None else d)


def with_kl_penalty(df: DataFrame, control: KLControl, score: str = "score", new: str = "new", ref: str = "old", row: str = "uid", mask: str = "mask", kind: str = "k1") -> tuple[DataFrame, dict[str, float]]:
    """`df` with reward, and the metrics of the step: the mean over rows of their mean divergence, and the coefficient that was used. The control follows."""
    m = F.col(mask).cast("double")
    beta = control.value
    out = df.withColumn("reward", penalized(F.col(score), F.col(new), F.col(ref), beta, kind, m))
    now, rows = df.groupBy(row).agg(_mean(kl(F.col(new), F.col(ref), kind) * m, m).alias("d")).agg(F.avg("d"), F.count("*")).first()
    control.update(now or 0.0, rows)
    return out, {"reward_kl_penalty": now or 0.0, "reward_kl_penalty_coeff": beta}


def adaptive_kl(value: float, kl_now: float, target: float, horizon: float, rows: int) -> float:
    """The coefficient after a step: it follows the relative error, held to ±0.2."""
    return value * (1 + max(-0.2, min(0.2, kl_now / target - 1)) * rows / horizon)


class KLControl:
    """The coefficient of the divergence: fixed, or following a target."""

    def __init__(self, value: float, target: float | None = None, horizon: float = 10000.0) -> None:
        if target is not None and horizon <= 0:
            raise ValueError("the horizon must be positive")
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, kl_now: float, rows: int) -> None:
        if self.target is not None:
            self.value = adaptive_kl(self.value, kl_now, self.target, self.horizon, rows)


def kl_control(kind: str, value: float, target: float | None = None, horizon: float = 10000.0) -> KLControl:
    if kind == "fixed":
        return KLControl(value)
    if kind == "adaptive":
        return KLControl(value, target, horizon)
    raise ValueError(f"no control {kind}")
