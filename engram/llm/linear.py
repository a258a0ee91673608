"""Small linear models, fitted with numpy on a bounded sample."""

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on the ridge-penalised log-likelihood.

    Without rows the weights are zero; with one class only the intercept leans to it.
    """
    one = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(one.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0.1
    for _ in range(rounds if len(x) else 0):
        p = sigmoid(one @ w)
        gradient = one.T @ (p - y) + penalty * w
        curvature = (one * (p * (1 - p))[:, None]).T @ one + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, n_folds: int, ridge: float = 1.0) -> list[np.ndarray]:
    """One model per category; each also sees the probabilities of the categories before it.

    In training these come from models fitted without the row's fold, so that a
    later model meets them as uncertain as they will be on new texts.
    """
    models: list[np.ndarray] = []
    seen = x
    for c in range(labels.shape[1]):
        y = labels[:, c]
        outside = np.zeros(len(x))
        for f in range(n_folds):
            held = folds == f
            if held.any():
                outside[held] = predict(seen[held], fit_logistic(seen[~held], y[~held], ridge))
        models.append(fit_logistic(seen, y, ridge))
        seen = np.hstack([seen, outside[:, None]])
    return models


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """The probability of each category for each row."""
    seen = x
    for w in models:
        seen = np.hstack([seen, predict(seen, w)[:, None]])
    return seen[:, x.shape[1] :]


def fit_nonnegative_pu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, ridge: float = 1e-3
) -> np.ndarray:
    """A linear model from positives and unlabelled rows: weights and, last, the intercept.

    Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
    with the logistic loss. Where the second part, the risk on negatives, falls
    below zero it can only be overfitting: the step then goes the other way for
    it, which is the non-negative estimator.
    """
    p1 = np.hstack([positive, np.ones((len(positive), 1))])
    u1 = np.hstack([unlabelled, np.ones((len(unlabelled), 1))])
    w = np.zeros(p1.shape[1])
    if not len(p1) or not len(u1):
        return w
    w[-1] = np.log(prior) - np.log1p(-prior)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        zp, zu = p1 @ w, u1 @ w
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = prior * (p1 * (sp - 1)[:, None]).mean(0)
        g_negative = (u1 * su[:, None]).mean(0) - prior * (p1 * sp[:, None]).mean(0)
        gradient = g_positive + g_negative if negative >= 0 else -g_negative
        gradient[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w
