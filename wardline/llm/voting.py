"""What weak votes are worth, estimated from their agreement alone."""

from __future__ import annotations

import numpy as np


def posteriors(patterns: np.ndarray, counts: np.ndarray, trust: float = 0.9, strength: float = 10.0,
               rounds: int = 100) -> np.ndarray:
    """P(first class) of each vote pattern, by expectation-maximisation over ``counts`` rows of each.

    ``patterns`` has a row of votes (0 none, 1 first class, 2 second class) per pattern. A voter has an accuracy for
    each of its two votes: the share of rows it casts that vote on which are of that class. The expectation weighs each vote by
    its accuracy's odds against the class's own odds and takes an abstention for no evidence; the maximisation sets
    accuracies and class share to the rows' expected classes, with ``strength`` rows' worth of prior
    ``trust`` in every vote. The prior also settles which class is which.
    """
    cast = np.stack([patterns == 1, patterns == 2], axis=2).astype(float)  # pattern, rule, vote
    votes = np.einsum("p,prv->rv", counts, cast)
    accuracy, share, belief = np.full(votes.shape, trust), trust, None
    logit = lambda x: np.log(x) - np.log1p(-x)
    for _ in range(rounds):
        weight = np.stack([logit(accuracy[:, 0]) - logit(share), -(logit(accuracy[:, 1]) + logit(share))], axis=1)
        odds = logit(share) + np.einsum("prv,rv->p", cast, weight)
        now = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
        if belief is not None and np.abs(now - belief).max() < 1e-9:
            break
        belief = now
        right = np.einsum("p,prv->rv", counts * belief, cast) * [1, 0]
        right += np.einsum("p,prv->rv", counts * (1 - belief), cast) * [0, 1]
        accuracy = (right + strength * trust) / (votes + strength)
        share = (np.dot(counts, belief) + strength * trust) / (counts.sum() + strength)
    return belief
