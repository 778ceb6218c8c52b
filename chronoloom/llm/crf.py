"""Linear-chain conditional random fields in numpy: training, marginals, Viterbi.

Training runs on the driver over a bounded list of short labelled sequences; what it
gives is a few small arrays that go to the tasks with the function that uses them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Crf:
    """weights: features x states; moves: from x to; starts: states."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def viterbi(self, emissions: np.ndarray) -> list[int]:
        """The likeliest states of one sequence of emission scores (steps x states)."""
        if not len(emissions):
            return []
        best, back = self.starts + emissions[0], []
        for e in emissions[1:]:
            reach = best[:, None] + self.moves
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def forward_backward(emissions: np.ndarray, mask: np.ndarray, moves: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None):
    """Node and move marginals, times the sequences' weights, and log partition of padded sequences (batch x steps x states)."""
    steps = emissions.shape[1]
    weights = np.ones(len(emissions)) if weights is None else weights
    alpha, beta = np.empty_like(emissions), np.zeros_like(emissions)
    alpha[:, 0] = starts + emissions[:, 0]
    for t in range(1, steps):
        step = _logsumexp(alpha[:, t - 1, :, None] + moves, 1) + emissions[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        step = _logsumexp(moves + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
    total = _logsumexp(alpha[:, -1], 1)
    nodes = np.exp(alpha + beta - total[:, None, None]) * (mask * weights[:, None])[:, :, None]
    pair = alpha[:, :-1, :, None] + moves + (emissions[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pairs = (np.exp(pair) * (mask[:, 1:] * weights[:, None])[:, :, None, None]).sum(axis=(0, 1))
    return nodes, pairs, total


def _batches(sequences: list, weights: np.ndarray, states: int):
    """Sequences of like length, padded together: (mask, labels, feature ids, their places, weights)."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
    start = 0
    while start < len(order):
        shortest = len(sequences[order[start]][1])
        stop = start
        while stop < len(order) and len(sequences[order[stop]][1]) <= max(4, 1.25 * shortest):
            stop += 1
        rows, start = order[start:stop], stop
        steps = len(sequences[rows[-1]][1])
        mask, labels = np.zeros((len(rows), steps), bool), np.zeros((len(rows), steps), np.int64)
        ids, at = [], []
        for b, i in enumerate(rows):
            xs, ys = sequences[i]
            mask[b, : len(ys)], labels[b, : len(ys)] = True, ys
            for t, fs in enumerate(xs):
                ids += fs
                at += [b * steps + t] * len(fs)
        yield mask, labels, np.array(ids, np.int64), np.array(at, np.int64), weights[rows]


def train(
    sequences: list[tuple[list[list[int]], list[int]]], features: int, states: int = 2,
    rounds: int = 150, rate: float = 0.15, l2: float = 1e-3, weights: list[float] | None = None, settled: float = 1e-6,
) -> Crf:
    """Maximise the conditional likelihood of ``(feature ids of each step, labels)`` sequences by Adam.

    Sequences that are the same are run once, with their weights summed. Training ends after
    ``rounds`` or once a round changes the mean log likelihood by less than ``settled``.
    """
    crf = Crf(np.zeros((features, states)), np.zeros((states, states)), np.zeros(states))
    total: dict[tuple, float] = {}
    for k, (xs, ys) in enumerate(sequences):
        if ys:
            key = (tuple(map(tuple, xs)), tuple(ys))
            total[key] = total.get(key, 0.0) + (weights[k] if weights else 1.0)
    if not total:
        return crf
    mass = sum(total.values())
    batches, seen_pairs, seen_starts = [], np.zeros((states, states)), np.zeros(states)
    for mask, labels, ids, at, w in _batches(list(total), np.array(list(total.values())), states):
        seen = np.eye(states)[labels] * (mask * w[:, None])[:, :, None]
        both = mask[:, 1:]
        np.add.at(seen_pairs, (labels[:, :-1][both], labels[:, 1:][both]), np.broadcast_to(w[:, None], both.shape)[both])
        seen_starts += seen[:, 0].sum(axis=0)
        batches.append((mask, seen, ids, at, w))
    params = [crf.weights, crf.moves, crf.starts]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    before = -np.inf
    for k in range(1, rounds + 1):
        slopes = [np.zeros_like(crf.weights), seen_pairs.copy(), seen_starts.copy()]
        likelihood = (seen_pairs * crf.moves).sum() + (seen_starts * crf.starts).sum()
        for mask, seen, ids, at, w in batches:
            flat = np.stack([np.bincount(at, crf.weights[ids, s], mask.size) for s in range(states)], axis=1)
            emissions = flat.reshape(*mask.shape, states)
            nodes, pairs, z = forward_backward(emissions, mask, crf.moves, crf.starts, w)
            gap = (seen - nodes).reshape(-1, states)
            slopes[0] += np.stack([np.bincount(ids, gap[at, s], features) for s in range(states)], axis=1)
            slopes[1] -= pairs
            slopes[2] -= nodes[:, 0].sum(axis=0)
            likelihood += (seen * emissions).sum() - (w * z).sum()
        if abs(likelihood - before) < settled * mass:
            break
        before = likelihood
        for p, g, m, v in zip(params, slopes, first, second):
            g = g / mass - l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return crf
