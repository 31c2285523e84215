"""Per-source numeric kernels in numpy, for what windows and aggregates can't say: Gaussian-process baselines, the mixture
posterior, and fits of run shapes. Each gets the points of one source (or source and camera) in time, and takes time and
memory in proportion to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import processes
from .clean import SOURCE, Keys, indexed
from .groups import Columns, group_rows, spans, with_kernel

# The default kernels, given as (S0, w0, Q) and as (sigma, rho, Q); error of points that have none.
S0, W0, Q, JITTER = 5e-4, 2 * math.pi / 2000, 0.7, 0.006
SIGMA, RHO = 0.05, 200.0
MAD_FACTOR = 1.4826
#: Points that a fit needs, of all and of unmasked ones; points that a noise floor is measured from.
LEAST_FIT, LEAST_UNMASKED, LEAST_FLOOR = 5, 10, 30
#: Least error of a point that a process is fitted to; least sigma of a point in the mixture.
LEAST_GP_ERROR, LEAST_SIGMA = 1e-6, 1e-12
#: Points of a block of the mixture; numbers of a working array.
BLOCK, WORKING = 512, 2**15
#: A share of a sum that changes no double, and that of so many cells neither.
NEXT_TO_NOTHING = 1e-21


def mad_sigma(x: np.ndarray) -> float:
    return MAD_FACTOR * float(np.median(np.abs(x - np.median(x))))


def clipped_scale(x: np.ndarray, clip: float, rounds: int, least: int) -> np.ndarray:
    """Members of x that stay within so many robust deviations of the median of those that stayed before. A round that
    starts with fewer than `least` changes nothing; a result of fewer is replaced by all of x."""
    own = np.sort(x)
    low, high = 0, len(own)  # what stays is a stretch of the sorted values
    for _ in range(rounds):
        if high - low < least:
            break
        middle, reach = np.median(own[low:high]), clip * max(mad_sigma(own[low:high]), 1e-12)
        low, high = np.searchsorted(own, middle - reach), np.searchsorted(own, middle + reach, side="right")
    few = high - low < least
    bounds = (-np.inf, np.inf) if few else (own[low], own[high - 1])
    return (x >= bounds[0]) & (x <= bounds[1])


def noise_floor(resid: np.ndarray, error: np.ndarray, variance: np.ndarray, clip: float = 3.0, rounds: int = 3, least: int = LEAST_FLOOR) -> float:
    """Scatter of quiet residuals that neither errors nor the model's variance explain: the robust variance of clipped
    residuals less the median of both. 0 for too few points, or if nothing is left."""
    table = np.stack([resid, error * error, variance])
    table = table[:, np.isfinite(table).all(axis=0)]
    if table.shape[1] < least:
        return 0.0
    r, squared, modelled = table[:, clipped_scale(table[0], clip, rounds, least)]
    return math.sqrt(max(mad_sigma(r) ** 2 - float(np.median(squared)) - float(np.median(modelled)), 0.0))


def whole_errors(error: np.ndarray, jitter: float) -> np.ndarray:
    """Errors with missing ones filled by the median, or jitter where there is none."""
    good = np.isfinite(error)
    return np.maximum(np.where(good, error, np.median(error[good]) if good.any() else jitter), 0.0)


def per_camera_gp(
    points: DataFrame, keys: Keys = SOURCE, sigma: float | None = None, rho: float | None = None, q: float = Q, s0: float | None = None, w0: float | None = None,
    jitter: float = JITTER, sigma_floor: float | None = None, terms: tuple[tuple[float, float], ...] = (), masked: bool = False,
) -> DataFrame:
    """points with baseline, resid, sigma_resid, sigma_eff and baseline_source (`gp_sho`, or `median_fallback` for few
    points), by source and camera. With masked, points whose column `masked` is true are left out of the fit, the kernel
    is the long one by default, and sigma_eff has no noise floor. Time and memory grow with a camera's points."""
    if terms:
        process = processes.exponentials(*terms)
    elif masked or (s0 is not None and w0 is not None):
        process = processes.oscillator(S0 if s0 is None else s0, W0 if w0 is None else w0, q)
    else:
        process = processes.oscillator_of_sigma(SIGMA if sigma is None else sigma, RHO if rho is None else rho, q)

    def fit(columns: Columns, starts: np.ndarray) -> Columns:
        t, y, raw = columns["jd"], columns["mag"], columns["error"]
        good = np.isfinite(t) & np.isfinite(y)
        used = good & ~(columns["_out"] > 0) if masked else good
        when, centred, noise = np.where(np.isfinite(t), t, 0.0), np.zeros(len(y)), np.full(len(y), np.inf)
        error, baseline, fitted = np.empty(len(y)), np.full(len(y), np.nan), []
        for s in spans(starts):
            error[s] = whole_errors(raw[s], jitter)
            own, fits = good[s], used[s]
            baseline[s] = np.median(y[s][own]) if own.any() else np.nan
            if fits.sum() >= (LEAST_UNMASKED if masked else LEAST_FIT):
                mean = y[s][fits].mean()
                errors = whole_errors(raw[s][fits], jitter)
                when[s] = np.where(np.isfinite(t[s]), t[s], t[s][fits][0])
                centred[s], noise[s] = np.where(fits, y[s] - mean, 0.0), np.where(fits, 1.0, np.inf)
                noise[np.flatnonzero(fits) + s.start] = np.maximum(errors, LEAST_GP_ERROR) ** 2
                fitted.append((s, mean, max(float(np.median(errors)), LEAST_GP_ERROR)))
        order = np.lexsort((when, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        mu, variance = np.empty(len(y)), np.empty(len(y))
        mu[order], variance[order] = processes.smoothed(process, when[order], centred[order], noise[order], starts)
        spread, source = np.sqrt(error**2 + jitter**2), np.full(len(y), "median_fallback", object)
        for s, mean, typical in fitted:
            baseline[s], source[s] = mu[s] + mean, "gp_sho"
            if masked:
                spread[s] = np.sqrt(variance[s] + typical**2)
            else:
                floor = noise_floor(y[s] - baseline[s], error[s], variance[s]) if sigma_floor is None else max(sigma_floor, 0.0)
                spread[s] = np.sqrt(np.maximum(error[s] ** 2 + floor**2 + variance[s], 1e-12))
        for s in spans(starts):
            if masked and source[s.start] != "gp_sho" and good[s].any():
                r = (y[s] - baseline[s])[good[s]]
                spread[s] = max(math.hypot(mad_sigma(r), float(np.median(error[s][good[s]]))), 1e-6)
        resid = y - baseline
        return {"baseline": baseline, "resid": resid, "sigma_resid": resid / spread, "sigma_eff": spread, "baseline_source": source}

    kept = points.drop("baseline", "resid", "sigma_resid", "sigma_eff", "baseline_source")
    if masked:
        kept = kept.withColumn("_out", F.coalesce(F.col("masked"), F.lit(False)).cast("int"))
    out = with_kernel(kept, (*keys, "camera"), ("jd", "mag", "error", *["_out"] * masked), fit, "baseline double, resid double, sigma_resid double, sigma_eff double, baseline_source string")
    return out.drop("_out")


def event_posterior(mag: np.ndarray, sigma: np.ndarray, base: np.ndarray, mags: np.ndarray, shares: np.ndarray, kind: str) -> tuple[np.ndarray, float, float, float]:
    """Of one source: each point's probability of the event, the mixture's log evidence less the baseline's, and the
    magnitude and share at the posterior's peak.

    A point's likelihood is share times baseline and rest times event (for jumps the other way round); both are taken
    relative to the greater one, so they lie between 0 and 1, and logarithms are taken of products of some dozen points.
    A point whose lesser part is below what a double adds to the greater is counted, not multiplied (its factor is one of the
    two shares), and cells of the posterior whose weight no double adds to a probability are left out of its sum. Points go
    by in blocks, twice: once for the posterior of magnitudes and shares, once for the points' probabilities. Memory is
    magnitudes by shares and magnitudes by a block, whatever the number of points."""
    of_event, of_quiet = (1 - shares, shares) if kind == "dip" else (shares, 1 - shares)
    odds = of_event / of_quiet
    most = float(max((1 / odds).max(), 1 + odds.max()))
    product, reach = max(1, int(250 / math.log10(most))), -math.log(NEXT_TO_NOTHING) + math.log(most)
    s = np.maximum(sigma, LEAST_SIGMA)
    log_likelihood = np.repeat((len(mag) * np.log(of_quiet))[:, None], len(mags), axis=1)

    def blocks(of: np.ndarray):
        for at in range(0, len(mag), BLOCK):
            r = slice(at, at + BLOCK)
            yield r, 0.5 * (((mag[r] - base[r]) / s[r]) ** 2 - ((mag[r] - of[:, None]) / s[r]) ** 2)

    for _, ratio in blocks(mags):
        log_likelihood += np.maximum(ratio, 0).sum(1) + np.log(odds)[:, None] * (ratio > reach).sum(1)
        open_ = np.abs(ratio) <= reach
        counts, left = open_.sum(1), ratio[open_]
        quiet, event = np.exp(-np.maximum(left, 0)), np.exp(np.minimum(left, 0))
        parts = -(-counts // product)  # products of each magnitude
        own = np.flatnonzero(parts)
        if not len(own):
            continue
        begins = np.repeat(np.cumsum(counts) - counts, parts) + product * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        sums, step = (np.cumsum(parts) - parts)[own], max(1, WORKING // len(left))
        for k in range(0, len(odds), step):
            mixed = odds[k : k + step, None] * event
            mixed += quiet
            log_likelihood[k : k + step, own] += np.add.reduceat(np.log(np.multiply.reduceat(mixed, begins, axis=1)), sums, axis=1)
    top = log_likelihood.max() if log_likelihood.size else 0.0
    weight = np.exp(log_likelihood - top)
    total, probability = weight.sum(), np.zeros(len(mag))
    heavy = weight > NEXT_TO_NOTHING * total
    own = np.flatnonzero(heavy.any(0))
    for r, ratio in blocks(mags[own]):
        quiet, event = np.exp(-np.maximum(ratio, 0)), np.exp(np.minimum(ratio, 0))
        for n, m in enumerate(own.tolist()):
            k = np.flatnonzero(heavy[:, m])
            part = odds[k, None] * event[n]
            probability[r] += weight[k, m] @ (part / (part + quiet[n]))
    k, m = np.unravel_index(log_likelihood.argmax(), log_likelihood.shape)
    return np.clip(probability / total, 0, 1), float(top + math.log(total) - math.log(weight.size)), float(mags[m]), float(shares[k])


def shares_of(kind: str, n: int = 80) -> np.ndarray:
    """The mixture's grid of shares, evenly spaced in their log odds."""
    low, high = (0.5, 1 - 1e-4) if kind == "dip" else (1e-4, 0.5)
    return 1 / (1 + np.exp(-np.linspace(math.log(low / (1 - low)), math.log(high / (1 - high)), n)))


POSTERIOR = ("event_probability", "bayes_factor", "best_mag_event", "best_p")


def posteriors(mag: np.ndarray, sigma: np.ndarray, base: np.ndarray, starts: np.ndarray, kind: str, n_mags: int = 60, n_shares: int = 80) -> Columns:
    """The columns of mixture_posterior for whole sources."""
    from .bayes import ends

    out, shares = {c: np.empty(starts[-1]) for c in POSTERIOR}, shares_of(kind, n_shares)
    low, high = ends(mag, base, starts, kind)
    for s in spans(starts):
        for c, found in zip(out, event_posterior(mag[s], sigma[s], base[s], np.linspace(low[s.start], high[s.start], n_mags), shares, kind), strict=True):
            out[c][s] = found
    return out


def mixture_posterior(points: DataFrame, kind: str, keys: Keys = SOURCE, n_mags: int = 60, n_shares: int = 80) -> DataFrame:
    """A row per point (keys, seq): the probability that it belongs to the event component of a two-part mixture, meant
    over the posterior of event magnitude and mixing share; and, alike for a source's points, the mixture's log evidence
    less the baseline's (bayes_factor), and best_mag_event and best_p at the posterior's peak. points have baseline.

    The share p is that of the brighter component: the baseline for dips, the event for jumps."""
    from .bayes import effective_sigma

    def weigh(columns: Columns, starts: np.ndarray) -> Columns:
        return posteriors(columns["mag"], columns["_sigma"], columns["baseline"], starts, kind, n_mags, n_shares)

    kept = points.where(F.col("baseline").isNotNull()).select(*keys, "seq", "jd", "mag", effective_sigma(points).alias("_sigma"), "baseline")
    out = with_kernel(kept, keys, ("mag", "_sigma", "baseline"), weigh, ", ".join(f"{c} double" for c in POSTERIOR))
    return out.select(*keys, "seq", *POSTERIOR)


Shape = Callable[..., tuple[np.ndarray, np.ndarray]]


def gaussian_shape(t: np.ndarray, amp: np.ndarray, t0: np.ndarray, width: np.ndarray, base: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Bells' values, and their derivatives by amplitude, time, width and base, next to last axis. t has a row for each
    bell, parameters a column."""
    width = np.where(width == 0, 1e-9, width)
    u = (t - t0) / width
    e = np.exp(-0.5 * u * u)
    return base + amp * e, np.stack([e, amp * e * u / width, amp * e * u * u / width, np.ones_like(t)], axis=-2)


def paczynski_shape(t: np.ndarray, amp: np.ndarray, t0: np.ndarray, width: np.ndarray, base: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """The same of microlensing-like curves."""
    width = np.where(width == 0, 1e-9, width)
    u = (t - t0) / width
    e = 1 / np.sqrt(1 + u * u)
    return base + amp * e, np.stack([e, amp * e**3 * u / width, amp * e**3 * u * u / width, np.ones_like(t)], axis=-2)


def least_squares(shape: Shape, t: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, most: int = 400, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Parameters of the weighted least squares of many curves, a row each, by damped Gauss-Newton steps that all curves take
    together, each put back within its bounds. A curve is done once a step gains next to nothing, or no damping lets it gain.
    Points of weight 0 fill up rows."""
    p, damping, left = np.array(start, float), np.full(len(start), 1e-3), np.arange(len(start))

    def at(rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            value, slope = shape(t[rows], *(q[:, k : k + 1] for k in range(q.shape[1])))
            off = np.where(weight[rows] > 0, (y[rows] - value) * weight[rows], 0.0)
            return off, slope[:, : q.shape[1]] * weight[rows][:, None, :], (off * off).sum(1)

    off, slope, cost = at(left, p)
    for _ in range(most):
        if not len(left):
            break
        with np.errstate(all="ignore"):
            square = slope @ slope.transpose(0, 2, 1)
            diagonal = np.einsum("bii->bi", square) + 1e-12
            square += (damping[left, None] * diagonal)[:, :, None] * np.eye(p.shape[1])
            toward = (slope @ off[:, :, None])[..., 0]
        sound = np.isfinite(square).all((1, 2)) & np.isfinite(toward).all(1)
        square[~sound], toward[~sound] = np.eye(p.shape[1]), 0.0
        try:
            step = np.linalg.solve(square, toward[..., None])[..., 0]
        except np.linalg.LinAlgError:
            step = (np.linalg.pinv(square) @ toward[..., None])[..., 0]
        moved = p[left] + step if bounds is None else np.clip(p[left] + step, bounds[0][left], bounds[1][left])
        next_off, next_slope, next_cost = at(left, moved)
        better = np.isfinite(next_cost) & (next_cost <= cost)
        done = better & (cost - next_cost <= 1e-12 * np.maximum(cost, 1e-12))
        p[left[better]] = moved[better]
        off, slope, cost = (np.where(better.reshape(-1, *[1] * (old.ndim - 1)), new, old) for new, old in ((next_off, off), (next_slope, slope), (next_cost, cost)))
        damping[left] = np.where(better, np.maximum(damping[left] / 10, 1e-12), damping[left] * 10)
        on = ~done & (damping[left] <= 1e12) & sound
        left, off, slope, cost = left[on], off[on], slope[on], cost[on]
    return p


#: Numbers of a working array of fits.
FIT_WORKING = 2**18
#: Times, values, weights, first parameters, and their lower and upper bounds, of a curve to fit.
Fit = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]


def fitted(shape: Shape, curves: list[Fit]) -> list[tuple[np.ndarray, float]]:
    """Parameters and weighted sum of squares of each curve. Curves of like length are fitted together."""
    out: list = [None] * len(curves)
    order = sorted(range(len(curves)), key=lambda k: len(curves[k][0]))
    while order:
        n, take = len(curves[order[0]][0]), 1
        while take < len(order) and (m := len(curves[order[take]][0])) <= max(2 * n, 16) and (take + 1) * m <= FIT_WORKING:
            take += 1
        own, order = order[:take], order[take:]
        n = max(len(curves[k][0]) for k in own)
        start = np.array([curves[k][3] for k in own])
        t, y, weight = np.zeros((take, n)), np.zeros((take, n)), np.zeros((take, n))
        low, high = np.full_like(start, -np.inf), np.full_like(start, np.inf)
        for row, k in enumerate(own):
            m = len(curves[k][0])
            t[row, m:] = curves[k][0][0]
            t[row, :m], y[row, :m], weight[row, :m] = curves[k][:3]
            if curves[k][4] is not None:
                low[row], high[row] = curves[k][4:]
        p = least_squares(shape, t, y, weight, start, bounds=(low, high) if np.isfinite(low).any() or np.isfinite(high).any() else None)
        left = (((y - shape(t, *(p[:, i : i + 1] for i in range(p.shape[1])))[0]) * weight) ** 2).sum(1)
        for row, k in enumerate(own):
            out[k] = p[row], float(left[row])
    return out


# Points that a shape needs, the gain in BIC that it must exceed, the share of the window that a first
# width is and its least, and the least error of a point.
LEAST_SHAPE, GAIN, FIRST_WIDTH, LEAST_WIDTH, LEAST_ERROR = 4, 10.0, 0.25, 0.01, 1e-9
#: Shapes that are tried for each kind of run, in order, and the sign of a first amplitude (0: that of the extreme point).
SHAPES: dict[str, list[tuple[str, Shape, int]]] = {"dip": [("gaussian", gaussian_shape, 0)], "jump": [("gaussian", gaussian_shape, 0), ("paczynski", paczynski_shape, -1)]}


Surroundings = tuple[np.ndarray, np.ndarray, np.ndarray]


def shapes_of(runs: list[Surroundings], kind: str) -> list[tuple[str, float, float, float, float, float, float]]:
    """For the surroundings (times, magnitudes, errors) of each run, the shape that explains them best, its BIC and gain over
    none, and its parameters. A shape must point the right way and gain more than GAIN over the best before it. `none` for
    too few points, `noise` if nothing gains."""
    out: list = [("none", math.nan, 0.0, *(math.nan,) * 4)] * len(runs)
    enough = [k for k, (t, _, _) in enumerate(runs) if len(t) >= LEAST_SHAPE]
    firsts, flat = {}, {}
    for k in enough:
        t, y, error = runs[k]
        e, level = np.maximum(error, LEAST_ERROR), float(np.median(y))
        extreme = int(np.abs(y - level).argmax())
        flat[k] = float((((y - level) / e) ** 2).sum()) + math.log(len(t))
        firsts[k] = e, float(y[extreme]) - level, t[extreme], level
        out[k] = ("noise", flat[k], 0.0, *(math.nan,) * 4)
    for name, shape, sign in SHAPES[kind]:
        curves: list[Fit] = []
        for k in enough:
            t, y, _ = runs[k]
            e, away, when, level = firsts[k]
            curves.append((t, y, 1 / e, np.array([sign * abs(away) if sign else away, when, max(FIRST_WIDTH * (t[-1] - t[0]), LEAST_WIDTH), level]), None, None))
        for k, (p, left) in zip(enough, fitted(shape, curves), strict=True):
            cost = left + 4 * math.log(len(runs[k][0]))
            if p[0] and (p[0] > 0) == (kind == "dip") and out[k][1] - cost > GAIN:
                out[k] = (name, cost, flat[k] - cost, *map(float, p))
    return out


def run_shapes(points: DataFrame, runs: DataFrame, kind: str, keys: Keys = SOURCE, pad: int = 5) -> DataFrame:
    """runs (keys, run, start_idx, end_idx) with morphology, bic, delta_bic_null, amp, t0, width and base, from a source's
    points up to `pad` places around each run. A run asks for its places one by one, so runs and points meet in a join by
    source and place, which no source heats, and runs of many sources are fitted together."""
    placed = indexed(points, keys).select(*keys, "idx", "jd", "mag", "error")
    runs = runs.select(*(F.col(c).alias(c) for c in runs.columns))  # columns of their own, where both come from one table
    asked = runs.select(*keys, "run", F.explode(F.sequence(F.col("start_idx") - pad, F.col("end_idx") + pad)).alias("idx"))
    around = placed.join(asked.withColumn("idx", F.col("idx").cast(dict(placed.dtypes)["idx"])), [*keys, "idx"])

    def shapes(columns: Columns, starts: np.ndarray) -> dict[str, list]:
        found = shapes_of([(columns["jd"][s], columns["mag"][s], columns["error"][s]) for s in spans(starts)], kind)
        return dict(zip(("morphology", *NUMBERS), map(list, zip(*found, strict=True)), strict=True))

    fits = group_rows(around, (*keys, "run"), ("jd", "mag", "error"), shapes, "morphology string, " + ", ".join(f"{n} double" for n in NUMBERS), ("idx",))
    return runs.join(fits, [*keys, "run"])


NUMBERS = ("bic", "delta_bic_null", "amp", "t0", "width", "base")
