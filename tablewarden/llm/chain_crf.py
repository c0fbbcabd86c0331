"""A linear-chain conditional random field over the words of texts, on arrays.

A word's features are its whole form (the lexicon), and all its character n-grams of two to four bytes with
marks at both ends, so that those at the ends are its affixes. Features are hashed into a table of weights per
state. Forward and backward passes run over all texts of a batch at once, word position by word position, so
each word's marginal is conditioned on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tablewarden.llm.words import LETTERED, Words, column, raw, words_of

#: Hash buckets of the features.
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
_STEP = np.uint32(0x9E3779B1)


def feature_lists(words: Words, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: word numbers (ascending) and buckets."""
    n = len(words)
    size = words.end - words.begin
    lexicon = (np.arange(n), (words.hashes() % np.uint64(buckets)).astype(np.int64))
    # the words one after another, each between two marks
    wide = size + 2
    stop = np.cumsum(wide)
    start = stop - wide
    owner = np.repeat(np.arange(n), wide)
    place = np.arange(len(owner)) - start[owner]
    letters = np.ones(len(owner), np.uint8)
    inside = (place > 0) & (place <= size[owner])
    letters[inside] = words.data[(words.begin[owner] + place - 1)[inside]]
    value = letters.astype(np.uint32) + np.uint32(1)
    out, h = [lexicon], value
    left = wide[owner] - place  # letters from here to the end of the word
    for order in range(2, max(ORDERS) + 1):
        h = h[:-1] * _STEP + value[order - 1 :]
        if order in ORDERS:
            whole = np.flatnonzero(left[: len(h)] >= order)
            x = h[whole] * np.uint32(order * 2 + 1)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append((owner[whole], ((x ^ (x >> np.uint32(16))) % np.uint32(buckets)).astype(np.int64)))
    return out


@dataclass
class Chain:
    """Weights of a fitted chain: features by state, transitions, and first states."""

    weights: np.ndarray  # (buckets, states)
    moves: np.ndarray  # (states, states)
    start: np.ndarray  # (states,)

    def emissions(self, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total = np.zeros((n, self.weights.shape[1]))
        for owner, bucket in lists:
            if len(owner):
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[heads]] += np.add.reduceat(self.weights[bucket], heads, axis=0)
        return total

    def marginals(self, words: Words) -> np.ndarray:
        """P(state | whole text) of each word."""
        emissions = self.emissions(feature_lists(words, len(self.weights)), len(words))
        return forward_backward(self, emissions, words.first, moves=False)[0]


def forward_backward(
    chain: Chain, emissions: np.ndarray, first: np.ndarray, moves: bool = True
) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of words, and (unless told not to) the expected number of each move, for texts that start at ``first``."""
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move = np.exp(chain.moves - chain.moves.max())
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    alive = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")  # texts with more than t words
    ahead, behind = np.empty((n, k)), np.empty((n, k))
    state = np.exp(chain.start - chain.start.max())
    for t, m in enumerate(alive):
        at = begin[:m] + t
        state = (state[:m] @ move if t else np.broadcast_to(state, (m, k))) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    state = np.ones((0, k))
    for t in range(len(alive) - 1, -1, -1):
        at = begin[: alive[t]] + t
        grown = np.ones((alive[t], k))
        grown[: len(state)] = state
        behind[at] = grown
        state = (grown * local[at]) @ move.T
        state /= state.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    if not moves:
        return both, None
    later = np.ones(n, bool)
    later[begin[counts > 0]] = False
    later = np.flatnonzero(later)
    joint = ahead[later - 1][:, :, None] * move * (local[later] * behind[later])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both, joint.sum(axis=0)


def fit(
    words: Words, labels: np.ndarray, states: int, epochs: int = 6, batch: int = 32, rate: float = 0.5,
    decay: float = 1e-6, buckets: int = BUCKETS, seed: int = 3,
) -> Chain:
    """Maximum likelihood of the labels of whole texts, by AdaGrad over batches of texts."""
    chain = Chain(np.zeros((buckets, states)), np.zeros((states, states)), np.zeros(states))
    lists = feature_lists(words, buckets)
    bounds = [np.searchsorted(owner, words.first) for owner, _ in lists]
    texts = np.flatnonzero(words.counts)
    scale = np.full(buckets, 1e-2), np.full((states, states), 1e-2), np.full(states, 1e-2)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        shuffled = rng.permutation(texts)
        for at in range(0, len(shuffled), batch):
            chosen = shuffled[at : at + batch]
            size = words.counts[chosen]
            first = np.concatenate([[0], np.cumsum(size)])
            pick = np.concatenate([np.arange(words.first[d], words.first[d + 1]) for d in chosen])
            parts = []
            for (owner, bucket), bound in zip(lists, bounds, strict=True):
                here = np.concatenate([np.arange(bound[d], bound[d + 1]) for d in chosen])
                move = np.repeat(first[:-1] - words.first[chosen], bound[chosen + 1] - bound[chosen])
                parts.append((owner[here] + move, bucket[here]))
            y = labels[pick]
            p, expected = forward_backward(chain, chain.emissions(parts, len(pick)), first)
            gap = -p
            gap[np.arange(len(y)), y] += 1
            gap /= len(y)
            owners, used = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            distinct, back = np.unique(used, return_inverse=True)
            slope = np.stack([np.bincount(back, gap[owners, s], len(distinct)) for s in range(states)], axis=1)
            slope -= decay * chain.weights[distinct]
            scale[0][distinct] += (slope**2).sum(axis=1) * 1e4
            chain.weights[distinct] += rate * 100 * slope / np.sqrt(scale[0][distinct])[:, None]
            seen = np.zeros((states, states))
            later = np.ones(len(y), bool)
            later[first[:-1]] = False
            later = np.flatnonzero(later)
            np.add.at(seen, (y[later - 1], y[later]), 1)
            slope = (seen - expected) / len(y)
            scale[1][:] += slope**2 * 1e4
            chain.moves += rate * 100 * slope / np.sqrt(scale[1])
            slope = (np.bincount(y[first[:-1]], minlength=states) - p[first[:-1]].sum(axis=0)) / len(chosen)
            scale[2][:] += slope**2
            chain.start += rate * slope / np.sqrt(scale[2])
    return chain


def by_length(batch: pa.RecordBatch, name: str, limit: int = 800_000) -> Iterator[tuple[np.ndarray, pa.Array, Words]]:
    """Stretches of a batch in order of length, so that long texts run side by side: row numbers, texts, words."""
    texts = column(batch, name)
    _, rows = raw(texts)
    order = np.argsort(-np.diff(rows), kind="stable")
    size = np.cumsum(np.diff(rows)[order])
    begin = 0
    while begin < len(order):
        before = size[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(size, before + limit, side="right")), begin + 1)
        part = order[begin:stop]
        some = texts.take(pa.array(part))
        yield part, some, words_of(some, LETTERED, fold=True)
        begin = stop
