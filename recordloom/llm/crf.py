"""Linear-chain conditional random fields over many chains at once.

Chains are cut into segments of at most ``SEGMENT`` positions. The transfer
matrices of all segments are built in step, boundary messages are carried along
each chain, and the messages inside all segments are again passed in step. The
marginals are those of plain forward-backward over each whole chain.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 32


def _norm(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label marginals of all positions and, on demand, the expected transitions.

    ``emit`` (positions x labels) and ``trans`` (from x to) are log potentials;
    the positions of the chains follow each other, ``lengths`` are their sizes.
    """
    lengths = np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    total, labels = emit.shape
    if not total:
        return emit.copy(), np.zeros((labels, labels)) if pairs else None
    e = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -200))
    a = np.exp(np.maximum(trans - trans.max(), -200))
    counts = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (np.cumsum(lengths) - lengths)[chain] + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[chain] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")  # the segments that still run are always a leading part
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    size, first, opening = size[order], first[order], nth[order] == 0
    running = [int(np.searchsorted(-size, -t, "left")) for t in range(SEGMENT)]

    move = np.empty((len(order), labels, labels))
    for t in range(int(size[0])):
        n = running[t]
        own = e[first[:n] + t][:, None, :]
        if t == 0:
            step = np.where(opening[:, None, None], np.eye(labels), a) * own
        else:
            step = (move[:n].reshape(-1, labels) @ a).reshape(n, labels, labels) * own
        move[:n] = _norm(step, (1, 2))
    in_chain = move[back]
    incoming, outgoing = np.ones((len(order), labels)), np.ones((len(order), labels))
    starts = np.cumsum(counts) - counts
    for j in range(1, int(counts.max())):
        at = starts[counts > j] + j
        incoming[at] = _norm(np.einsum("si,sij->sj", incoming[at - 1], in_chain[at - 1]))
    for j in range(int(counts.max()) - 1, 0, -1):
        at = starts[counts > j] + j
        outgoing[at - 1] = _norm(np.einsum("sij,sj->si", in_chain[at], outgoing[at]))
    forward, backward = np.empty_like(e), np.empty_like(e)
    message = incoming[order]
    for t in range(int(size[0])):
        n = running[t]
        moved = message[:n] @ a
        if t == 0:
            moved = np.where(opening[:, None], message, moved)
        message[:n] = _norm(moved * e[first[:n] + t])
        forward[first[:n] + t] = message[:n]
    message = outgoing[order]
    for t in range(int(size[0]) - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        backward[at] = message[:n]
        message[:n] = _norm((message[:n] * e[at]) @ a.T)
    out = _norm(forward * backward)
    if not pairs:
        return out, None
    inner = np.ones(total, bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((labels, labels))
    for lo in range(0, len(at), 1 << 16):
        own = at[lo : lo + (1 << 16)]
        expected += _norm(forward[own - 1][:, :, None] * a * (e[own] * backward[own])[:, None, :], (1, 2)).sum(axis=0)
    return out, expected


class Adam:
    """Steps for a list of weight arrays."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
