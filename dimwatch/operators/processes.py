"""Gaussian processes with a state: an oscillator, or a sum of exponentials, solved in time proportional to the points.

The value of such a process is part of a short state vector that the next time takes over by a matrix, so the posterior at all
points comes from one pass forward (a Kalman filter) and one backward (the Bryson-Frazier form of the smoother, which inverts nothing).
Many series are run in step: at each step all series that are long enough are moved on together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Lag = np.ndarray


@dataclass(frozen=True)
class Process:
    """seen: how the value comes from the state; stationary: the state's covariance; step: the matrices that carry it over some lags."""

    seen: np.ndarray
    stationary: np.ndarray
    step: Callable[[Lag], np.ndarray]

    def covariance(self, lag: np.ndarray) -> np.ndarray:
        """Covariance of two values by their lag in time."""
        return np.einsum("i,...ij,jk,k->...", self.seen, self.step(np.abs(lag)), self.stationary, self.seen)


def oscillator(s0: float, w0: float, q: float) -> Process:
    """A stochastically driven, damped harmonic oscillator; the state is its value and speed."""
    power = s0 * w0 * q
    eta, damp = math.sqrt(abs(1 - 1 / (4 * q * q))), w0 / (2 * q)
    turn = w0 * eta

    def step(lag: Lag) -> np.ndarray:
        t = np.asarray(lag, float)
        if eta < 1e-9:
            even, odd = np.exp(-damp * t), t * np.exp(-damp * t)
        elif q > 0.5:
            even, odd = np.exp(-damp * t) * np.cos(turn * t), np.exp(-damp * t) * np.sin(turn * t) / turn
        else:
            slow, fast = np.exp((turn - damp) * t), np.exp(-(turn + damp) * t)
            even, odd = (slow + fast) / 2, (slow - fast) / (2 * turn)
        out = np.empty((*t.shape, 2, 2))
        out[..., 0, 0], out[..., 0, 1] = even + damp * odd, odd
        out[..., 1, 0], out[..., 1, 1] = -w0 * w0 * odd, even - damp * odd
        return out

    return Process(np.array([1.0, 0.0]), np.diag([power, power * w0 * w0]), step)


def oscillator_of_sigma(sigma: float, rho: float, q: float) -> Process:
    """The same from a standard deviation and an undamped period."""
    w0 = 2 * math.pi / rho
    return oscillator(sigma * sigma / (w0 * q), w0, q)


def exponentials(*terms: tuple[float, float]) -> Process:
    """Sum of (amplitude, time scale): amplitudes times exponentials of the lag over the time scale."""
    amplitudes, scales = np.array(terms, float).T

    def step(lag: Lag) -> np.ndarray:
        return np.exp(-np.asarray(lag, float)[..., None] / scales)[..., None] * np.eye(len(scales))

    return Process(np.ones(len(terms)), np.diag(amplitudes), step)


def smoothed(process: Process, t: np.ndarray, y: np.ndarray, noise: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and variance at every time of every series, from centred values with independent error variances.

    Series lie one after another, each in order of time; starts says where, and how many rows there are at last. Values
    with infinite noise aren't fitted."""
    n, d = len(t), len(process.seen)
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[:-1][order], lengths[order]
    active = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left").tolist()  # series longer than the step
    # rows in order of steps, so that a step's rows lie together
    at = np.concatenate([[0], np.cumsum(active)]).astype(int)
    rows = np.concatenate([begin[:k] + i for i, k in enumerate(active)]) if active else np.zeros(0, int)
    h, p0 = process.seen, process.stationary
    moves = process.step(np.diff(t, prepend=t[:1]).clip(0) if n else t)[rows]
    noise = noise[rows]
    y = np.where(np.isfinite(noise), y[rows], 0.0)
    ahead_x, ahead_p, gains, drift, curb = np.empty((n, d)), np.empty((n, d, d)), np.empty((n, d)), np.empty((n, d)), np.empty(n)
    x, p = np.zeros((len(begin), d)), np.broadcast_to(p0, (len(begin), d, d)).copy()
    for i, k in enumerate(active):
        own = slice(at[i], at[i] + k)
        x, p = x[:k], p[:k]
        if i:
            a = moves[own]
            x, p = (a @ x[..., None])[..., 0], a @ (p - p0) @ a.transpose(0, 2, 1) + p0
        ahead_x[own], ahead_p[own] = x, p
        ph = p @ h
        fits = 1 / (ph @ h + noise[own])  # 0 where the noise is infinite
        off = (y[own] - x @ h)[:, None]
        gain = ph * fits[:, None]
        x, p = x + gain * off, p - gain[:, :, None] * ph[:, None, :]
        gains[own], drift[own], curb[own] = gain, h * (off * fits[:, None]), fits
    keeps = np.eye(d) - gains[:, :, None] * h
    turns, bend = keeps.transpose(0, 2, 1), np.outer(h, h) * curb[:, None, None]
    backs, curves = np.empty((n, d)), np.empty((n, d, d))
    back, curve = np.zeros((len(begin), d)), np.zeros((len(begin), d, d))
    for i in range(len(active) - 1, -1, -1):
        k = active[i]
        own = slice(at[i], at[i] + k)
        turned = turns[own]
        b, c = (turned @ back[:k, :, None])[..., 0] - drift[own], turned @ curve[:k] @ keeps[own] + bend[own]
        backs[own], curves[own] = b, c
        if i:
            a = moves[own]
            up = a.transpose(0, 2, 1)
            back[:k], curve[:k] = (up @ b[..., None])[..., 0], up @ c @ a
    ph = ahead_p @ h
    mean, variance = np.empty(n), np.empty(n)
    mean[rows] = ahead_x @ h - (ph * backs).sum(1)
    variance[rows] = ph @ h - (ph[:, None, :] @ curves @ ph[:, :, None])[:, 0, 0]
    return mean, np.maximum(variance, 0.0)
