"""Column functions on aligned token arrays (``array<double>``): one row a sequence, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def times(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def masked_mean(x: Column, mask: Column) -> Column:
    """sum(x * mask) / max(sum(mask), 1)."""
    return total(times(x, mask)) / F.greatest(total(mask), F.lit(1.0))


def discounted(x: Column, decay: float) -> Column:
    """y[t] = x[t] + decay * y[t + 1], as a scan from the end."""
    scan = F.aggregate(
        F.reverse(x), F.array().cast("array<double>"),
        lambda acc, v: F.array_append(acc, v + F.lit(decay) * F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0))),
    )
    return F.reverse(scan)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages: delta[t] = r[t] + gamma V[t+1] - V[t], then a scan by gamma lam."""
    after = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + F.lit(gamma) * v), values, lambda a, v: a - v)
    return discounted(delta, gamma * lam)


def reinforce_returns(reward: Column, kl: Column, mask: Column, beta: float, gamma: float) -> Column:
    """-beta kl on masked tokens, the reward at the last masked one, discounted from the end; no masked token raises."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1.0).cast("int")
    checked = F.when(F.array_contains(mask, 1.0), last).otherwise(F.raise_error(F.lit("no trainable token")).cast("int"))
    cost = F.zip_with(kl, mask, lambda k, m: F.lit(-beta) * k * m)
    return discounted(F.transform(cost, lambda c, i: c + F.when(i == checked, reward).otherwise(0.0)), gamma)


def approx_kl(logp: Column, base: Column, kind: str = "k3", ratio: Column | None = None) -> Column:
    """k1: d; k2: d^2 / 2; k3: exp(-d) - 1 + d; low_var: k3 clamped to +-10; times an importance ratio if given."""
    d = minus(logp, base)
    one = {
        "k1": lambda x: x,
        "k2": lambda x: x * x / 2,
        "k3": lambda x: F.exp(-x) - 1 + x,
        "low_var": lambda x: F.greatest(F.least(F.exp(-x) - 1 + x, F.lit(10.0)), F.lit(-10.0)),
    }[kind]
    out = F.transform(d, one)
    return out if ratio is None else times(out, ratio)


def policy_loss(kl: Column, adv: Column, low: float, high: float, dual: float | None = None) -> Column:
    """Clipped surrogate max(-r a, -clip(r) a), r = exp(-kl); with ``dual``, at most -dual a where a < 0."""

    def one(k: Column, a: Column) -> Column:
        r = F.exp(-k)
        loss = F.greatest(-r * a, -F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)) * a)
        return loss if dual is None else F.when(a < 0, F.least(loss, F.lit(-dual) * a)).otherwise(loss)

    return F.zip_with(kl, adv, one)


def clip_fraction(kl: Column, adv: Column, low: float, high: float) -> Column:
    """Share of tokens where the clipped term is the larger."""

    def one(k: Column, a: Column) -> Column:
        r = F.exp(-k)
        return (-F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)) * a > -r * a).cast("double")

    return total(F.zip_with(kl, adv, one)) / F.greatest(F.size(kl), F.lit(1))


def cispo_loss(kl: Column, logp: Column, adv: Column, low: float, high: float) -> Column:
    r = F.transform(kl, lambda k: F.greatest(F.least(F.exp(-k), F.lit(1 + high)), F.lit(1 - low)))
    return F.transform(times(times(r, adv), logp), lambda v: -v)


def binary_divergence(behaviour: Column, policy: Column, kind: str = "tv") -> Column:
    """Bernoulli divergence on the sampled token; log-probabilities clamped to -30..0, probabilities off 0 and 1 by 1e-9."""
    p = lambda x: F.greatest(F.least(F.exp(F.greatest(F.least(x, F.lit(0.0)), F.lit(-30.0))), F.lit(1 - 1e-9)), F.lit(1e-9))
    if kind == "tv":
        return F.zip_with(behaviour, policy, lambda a, b: F.abs(p(a) - p(b)))
    return F.zip_with(
        behaviour, policy, lambda a, b: p(a) * F.ln(p(a) / p(b)) + (1 - p(a)) * F.ln((1 - p(a)) / (1 - p(b)))
    )


def trust_region(behaviour: Column, policy: Column, adv: Column, threshold: float, kind: str = "tv") -> Column:
    """1, or 0 where the divergence is beyond the threshold and the update would widen it."""
    away = F.zip_with(minus(policy, behaviour), adv, lambda d, a: d * a > 0)
    return F.zip_with(binary_divergence(behaviour, policy, kind), away, lambda v, w: F.when((v > threshold) & w, 0.0).otherwise(1.0))


def off_policy_mask(logp: Column, old: Column, adv: Column, mask: Column, delta: float) -> Column:
    """0 for tokens of negative advantage in a sequence whose masked mean of old - new is above delta."""
    return let(
        masked_mean(minus(old, logp), mask),
        lambda m: F.transform(adv, lambda a: F.when((a < 0) & (m > delta), 0.0).otherwise(1.0)),
    )


def sequence_kl(logp: Column, old: Column, mask: Column) -> Column:
    """The sequence's masked mean of old - new, on each token."""
    return let(masked_mean(minus(old, logp), mask), lambda m: F.transform(logp, lambda _: m))


def importance_weights(train: Column, rollout: Column, mask: Column, level: str = "token", bound: float = 20.0) -> Column:
    """exp of the log ratio, clamped to +-bound: a token's, the masked sum of the sequence, or its masked mean."""
    limit = lambda x: F.exp(F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))
    d = minus(train, rollout)
    if level == "token":
        return F.transform(d, limit)
    one = total(times(d, mask)) if level == "sequence" else masked_mean(d, mask)
    return let(one, lambda s: F.transform(d, lambda _: limit(s)))


def truncate(weights: Column, mask: Column, upper: float) -> Column:
    return F.zip_with(weights, mask, lambda w, m: F.greatest(F.least(w, F.lit(upper)), F.lit(0.0)) * m)


def clip(weights: Column, mask: Column, lower: float, upper: float) -> Column:
    return F.zip_with(weights, mask, lambda w, m: F.greatest(F.least(w, F.lit(upper)), F.lit(lower)) * m)


def reject(weights: Column, mask: Column, lower: float, upper: float) -> Column:
    """The mask without tokens whose weight is out of range; weights stay."""
    return F.zip_with(weights, mask, lambda w, m: F.when(w.between(lower, upper), m).otherwise(0.0))


def icepop(weights: Column, lower: float, upper: float) -> Column:
    return F.transform(weights, lambda w: F.when(w.between(lower, upper), w).otherwise(0.0))


def vetoed(log_ratio: Column, mask: Column, threshold: float) -> Column:
    """Whether a masked token's log ratio is below ln(threshold)."""
    return F.exists(F.zip_with(log_ratio, mask, lambda d, m: (m > 0) & (d < F.ln(F.lit(threshold)))), lambda b: b)


def value_loss(values: Column, old: Column, returns: Column, clip_by: float) -> Column:
    near = F.zip_with(values, old, lambda v, o: o + F.greatest(F.least(v - o, F.lit(clip_by)), F.lit(-clip_by)))
    sq = lambda x: F.zip_with(x, returns, lambda a, r: (a - r) * (a - r))
    return F.zip_with(sq(values), sq(near), lambda a, b: F.greatest(a, b))


def response_length(mask: Column) -> Column:
    """From the first 1 to the end; 0 without one."""
    at = F.array_position(mask, 1.0)
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(0).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("long")


def positions_of(haystack: Column, needle: Column) -> Column:
    """All start positions (from 0) of a run of values."""
    last = F.size(haystack) - F.size(needle)
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle)


def gaps(positions: Column) -> Column:
    """Gap coding of sorted positions: p[i] - p[i-1] - 1, with -1 before the first."""
    return F.transform(positions, lambda p, i: p - F.coalesce(F.get(positions, i - 1), F.lit(-1)) - 1)


def merge_offsets(base: Column, more: Column) -> Column:
    """Ragged offsets appended: the second's, without its 0, shifted by the first's last."""
    return F.concat(base, F.transform(F.slice(more, 2, F.greatest(F.size(more) - 1, F.lit(0))), lambda o: o + F.element_at(base, -1)))


def pad_offsets(offsets: Column, n: int) -> Column:
    return F.concat(offsets, F.array_repeat(F.element_at(offsets, -1), n))


def masked_spans(tokens: Column, mask: Column) -> Column:
    """The runs of tokens whose mask is 1, in order; an empty or all-zero mask has none."""
    off = lambda i: ~F.coalesce(F.get(mask, i) == 1, F.lit(False))
    ends = lambda step: F.filter(
        F.transform(mask, lambda v, i: F.when((v == 1) & off(i + step), i)), lambda i: i.isNotNull()
    )
    return F.zip_with(ends(-1), ends(1), lambda a, b: F.slice(tokens, a + 1, b - a + 1))


def distilled(adv: Column, student: Column, teacher: Column, weight: float) -> Column:
    """Advantages less ``weight`` times how much likelier the student found each token than the teacher."""
    return F.zip_with(adv, minus(student, teacher), lambda a, d: a - F.lit(weight) * d)


def perplexities(train: Column, rollout: Column, mask: Column, bound: float = 20.0) -> Column:
    """struct of perplexities, their log difference and ratio, KL, k3 and both chi-squared divergences of one sequence.

    Means are over masked tokens; kl and k3 are means over them of each token's value.
    """
    limit = lambda x: F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))
    ratio = minus(train, rollout)

    def told(m: Column) -> Column:
        apart = m["rollout"] - m["train"]
        return F.struct(
            (-m["train"]).alias("training_log_ppl"), F.exp(-m["train"]).alias("training_ppl"), (-m["rollout"]).alias("rollout_log_ppl"), F.exp(-m["rollout"]).alias("rollout_ppl"),
            masked_mean(minus(rollout, train), mask).alias("kl"), masked_mean(F.transform(ratio, lambda x: F.exp(x) - x - 1), mask).alias("k3_kl"),
            apart.alias("log_ppl_diff"), F.abs(apart).alias("log_ppl_abs_diff"), F.exp(apart).alias("ppl_ratio"),
            (masked_mean(F.transform(ratio, lambda x: F.exp(2.0 * limit(x))), mask) - 1).alias("chi2_token"),
            (F.exp(2.0 * limit(total(times(ratio, mask)))) - 1).alias("chi2_seq"),
        )

    return let(F.struct(masked_mean(train, mask).alias("train"), masked_mean(rollout, mask).alias("rollout")), told)


def advantages(kind: str, reward: Column, values: Column, kl: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0, beta: float = 0.0) -> Column:
    """Token advantages by an estimator: grpo, gspo and cispo spread the reward, ppo is generalised, reinforce ones discount."""
    if kind in ("grpo", "gspo", "cispo"):
        return F.transform(mask, lambda _: reward)
    if kind == "ppo":
        last = F.size(mask) - 1
        rewards = F.zip_with(kl, F.transform(mask, lambda _, i: F.when(i == last, reward).otherwise(0.0)), lambda k, r: F.lit(-beta) * k + r)
        return gae(rewards, values, gamma, lam)
    if kind == "reinforce_plus_plus":
        return reinforce_returns(reward, kl, mask, beta, gamma)
    if kind == "reinforce_plus_plus_baseline":
        return F.transform(kl, lambda k: reward - F.lit(beta) * k)
    raise ValueError(f"unknown estimator {kind!r}")


def policy_objective(logp: Column, old: Column, adv: Column, mask: Column, low: float, high: float, weights: Column | None = None, kl_weight: float = 0.0, base: Column | None = None) -> Column:
    """struct(pg_loss, clip_fraction, kl, kl_loss, loss) of one sequence: masked sums over the original mask's size.

    ``weights`` scale each token's loss (importance weights, 0 rejects it)
    without changing the denominator; ``base`` are a reference's log-probabilities.
    """
    ratio = minus(old, logp)
    losses = policy_loss(ratio, adv, low, high)
    losses = losses if weights is None else times(losses, weights)
    size = F.greatest(total(mask), F.lit(1.0))
    mean = lambda x: total(times(x, mask)) / size
    clipped = F.zip_with(ratio, adv, lambda k, a: (-F.greatest(F.least(F.exp(-k), F.lit(1 + high)), F.lit(1 - low)) * a > -F.exp(-k) * a).cast("double"))
    reference = mean(approx_kl(logp, base, "low_var")) if base is not None else F.lit(0.0)
    parts = F.struct(mean(losses).alias("pg_loss"), mean(clipped).alias("clip_fraction"), mean(ratio).alias("kl"), reference.alias("kl_loss"))
    return let(parts, lambda p: F.struct(p["pg_loss"].alias("pg_loss"), p["clip_fraction"].alias("clip_fraction"), p["kl"].alias("kl"), p["kl_loss"].alias("kl_loss"), (p["pg_loss"] + kl_weight * p["kl_loss"]).alias("loss")))


def pooled(vectors: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of a sequence of vectors: their mean under the mask, or the first."""
    if how == "cls":
        return F.get(vectors, 0)
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zero = F.transform(F.get(vectors, 0), lambda _: F.lit(0.0))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    return let(F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda s: F.transform(s, lambda x: F.try_divide(x, n)))


def tail(values: Column, n: Column) -> Column:
    """The last ``n`` values: what belongs to a response of that length."""
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), F.greatest(F.lit(0), n))


def flops(length: Column, hidden: int, heads: int, groups: int, vocab: int, ffn: int, layers: int) -> Column:
    """Forward operations of one dense sequence: projections, attention, feed-forward and the head."""
    n = length.cast("double")
    head = hidden / heads
    projections = 2.0 * n * hidden * (hidden + 2 * groups * head) + 2.0 * n * hidden * hidden
    attention = 4.0 * n * n * hidden / 2
    return layers * (projections + attention + 6.0 * n * hidden * ffn) + 2.0 * n * hidden * vocab


def weight_fractions(weights: Column, mask: Column, lower: float, upper: float) -> Column:
    """struct(high, low): shares of masked tokens whose weight is above ``upper`` and below ``lower``."""
    share = lambda hit: masked_mean(F.transform(weights, lambda w: hit(w).cast("double")), mask)
    return F.struct(share(lambda w: w > upper).alias("high"), share(lambda w: w < lower).alias("low"))


def truncated_importance(loss: Column, train: Column, rollout: Column, low: float, high: float) -> Column:
    """struct(loss, weights, clipped, distance): each token's loss times its importance weight clamped to low..high."""
    ratio = F.transform(minus(train, rollout), lambda d: F.exp(d))
    weights = F.transform(ratio, lambda r: F.greatest(F.least(r, F.lit(high)), F.lit(low)))
    return F.struct(
        times(loss, weights).alias("loss"), weights.alias("weights"), F.zip_with(weights, ratio, lambda w, r: (w != r).cast("double")).alias("clipped"),
        F.transform(ratio, lambda r: F.abs(r - 1)).alias("distance"),
    )


def value_clip_fraction(values: Column, old: Column, mask: Column, clip_by: float) -> Column:
    """Share of masked tokens whose value moved by more than ``clip_by``."""
    return masked_mean(F.zip_with(values, old, lambda v, o: (F.abs(v - o) > clip_by).cast("double")), mask)


def positions(gap_codes: Column) -> Column:
    """Absolute positions of a gap coding."""
    return F.transform(gap_codes, lambda _, i: F.aggregate(F.slice(gap_codes, 1, i + 1), F.lit(-1), lambda s, g: s + g + 1))
