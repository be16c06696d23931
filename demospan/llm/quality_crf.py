"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and its neighbours; the field adds how labels
follow each other. A document's quality is the length-weighted mean of its lines' forward-backward
marginals, put on the scale of the labels by a logistic curve.

Only documents are labelled. A line starts with its document's label; after a first fit the lines of bad
documents take the field's own view of them, and the field is fitted again (a bad document may hold good
lines, a good one holds no bad ones). The fit uses a bounded sample of labelled documents; scoring runs
over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import texts

#: labelled documents of either class that a fit reads at most, and lines of a document at most; a longer
#: document is left out of the fit, never cut
SAMPLE = 1500
SAMPLE_LINES = 2000
STEPS = 150
RATE = 0.2
DECAY = 1e-3
KEEP_FROM = 0.3

UPPER, LOWER, DIGIT, SPACE, MARK, PIPE, NEWLINE, HIGH = range(8)
_KIND = np.full(256, MARK, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, HIGH
_KIND[[9, 11, 12, 13, 32]] = SPACE
_KIND[124], _KIND[10] = PIPE, NEWLINE
FEATURES = 11


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths in bytes plus one."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data + b"\n", dtype=np.uint8)
    kinds = _KIND[raw]
    ends = np.nonzero(kinds == NEWLINE)[0]
    starts = np.r_[0, ends[:-1] + 1]
    count = [np.add.reduceat((kinds == k).astype(np.int32), starts).astype(np.float64) for k in (UPPER, LOWER, DIGIT, SPACE, MARK, PIPE)]
    length = (ends - starts).astype(np.float64)
    upper, lower, digit, space, mark, pipe = count
    lines = data.split(b"\n")
    words = np.empty(len(lines))
    kinds_of_words = np.empty(len(lines))
    repeats = np.empty(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w)
        kinds_of_words[i] = len(set(w))
        repeats[i] = sum(map(bytes.__eq__, w, w[1:])) if len(w) > 1 else 0
    some, per_word = np.maximum(length, 1), np.maximum(words, 1)
    rows = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            mark / some,
            np.minimum(mark / per_word, 4) / 4,
            pipe / per_word,
            digit / some,
            1 - kinds_of_words / per_word,
            repeats / per_word,
            np.log1p(length) / 10,
            (words > 0) * np.minimum(length / per_word, 20) / 20,
            (words == 0).astype(np.float64),
            np.ones(len(lines)),
        ],
        axis=1,
    )
    return rows, length + 1


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """The features of the line, of the line before and of the one after, nothing beyond the ends."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    return np.concatenate([rows, before, after], axis=1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x 2
    moves: np.ndarray  # from label, to label
    slope: float
    offset: float


def marginals(state: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward in log space over ``state`` (lines x labels): node and summed pair marginals, log Z."""
    n = len(state)
    forward, backward = np.empty_like(state), np.zeros_like(state)
    forward[0] = state[0]
    for i in range(1, n):
        forward[i] = state[i] + np.logaddexp(forward[i - 1, 0] + moves[0], forward[i - 1, 1] + moves[1])
    for i in range(n - 2, -1, -1):
        x = state[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
    z = np.logaddexp(forward[-1, 0], forward[-1, 1])
    nodes = np.exp(forward + backward - z)
    pairs = np.exp(forward[:-1, :, None] + moves[None] + (state[1:] + backward[1:])[:, None, :] - z).sum(axis=0)
    return nodes, pairs, float(z)


def good_marginals(state: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals of label 1 for many documents at once; ``state`` holds their lines one after another.

    Documents are put in order of length, so that each step of the chains is one array operation.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)[:-1]][order]
    lengths = sizes[order]
    still = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # documents longer than i
    forward, backward = np.empty_like(state), np.zeros_like(state)
    for i, k in enumerate(still):
        at = starts[:k] + i
        if i == 0:
            forward[at] = state[at]
        else:
            was = forward[at - 1]
            forward[at] = state[at] + np.logaddexp(was[:, :1] + moves[0], was[:, 1:] + moves[1])
    for i in range(len(still) - 2, -1, -1):
        at = starts[: still[i + 1]] + i
        x = state[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(moves[:, 0] + x[:, :1], moves[:, 1] + x[:, 1:])
    total = forward + backward
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))


class _Chains:
    """Sample documents padded to blocks of like length, for the fit."""

    def __init__(self, docs: list[np.ndarray]):
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        self.blocks = []
        at = 0
        while at < len(order):
            longest = max(4, int(len(docs[order[at]]) * 1.5))
            part = [i for i in order[at:] if len(docs[i]) <= longest]
            width = len(docs[part[-1]])
            x = np.zeros((len(part), width, docs[0].shape[1]))
            here = np.zeros((len(part), width), dtype=bool)
            for j, i in enumerate(part):
                x[j, : len(docs[i])] = docs[i]
                here[j, : len(docs[i])] = True
            self.blocks.append((np.array(part), x, here))
            at += len(part)

    def marginals(self, weights: np.ndarray, moves: np.ndarray):
        """Node and pair marginals of every block."""
        for part, x, here in self.blocks:
            state = x @ weights
            n = x.shape[1]
            forward, backward = np.empty_like(state), np.zeros_like(state)
            forward[:, 0] = state[:, 0]
            for i in range(1, n):
                was = forward[:, i - 1]
                forward[:, i] = state[:, i] + np.logaddexp(was[:, :1] + moves[0], was[:, 1:] + moves[1])
            for i in range(n - 2, -1, -1):
                y = state[:, i + 1] + backward[:, i + 1]
                new = np.logaddexp(moves[:, 0] + y[:, :1], moves[:, 1] + y[:, 1:])
                backward[:, i] = np.where(here[:, i + 1, None], new, 0)
            total = forward + backward
            z = np.logaddexp(total[..., 0], total[..., 1])
            nodes = np.exp(total - z[..., None]) * here[..., None]
            joint = np.exp(forward[:, :-1, :, None] + moves + (state[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, 1:, None, None])
            pairs = (joint * here[:, 1:, None, None]).sum(axis=(0, 1))
            yield part, x, here, nodes, pairs


def _fit_field(chains: _Chains, lines: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam on the log likelihood of soft line labels (the share of label 1 in each)."""
    padded = []
    for part, x, here in chains.blocks:
        y = np.zeros((*here.shape, 2))
        for j, i in enumerate(part):
            y[j, : len(lines[i]), 1] = lines[i]
            y[j, : len(lines[i]), 0] = 1 - lines[i]
        # as many observed moves as the soft labels of neighbours imply
        moved = np.einsum("dia,dib->ab", y[:, :-1] * here[:, 1:, None], y[:, 1:])
        padded.append((y, moved))
    n = sum(len(x) for x in lines)
    theta = np.zeros(width * 2 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, moves = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
        g_w, g_m = np.zeros_like(weights), np.zeros_like(moves)
        for (part, x, here, nodes, pairs), (y, moved) in zip(chains.marginals(weights, moves), padded):
            g_w += np.einsum("dif,dik->fk", x, nodes - y)
            g_m += pairs - moved
        grad = np.r_[g_w.ravel(), g_m.ravel()] / n + DECAY * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)


def _means(chains: _Chains, weights, moves, sizes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    means, lines = np.zeros(len(sizes)), [np.zeros(0)] * len(sizes)
    for part, _, here, nodes, _ in chains.marginals(weights, moves):
        for j, i in enumerate(part):
            lines[i] = nodes[j, : len(sizes[i]), 1]
            means[i] = np.average(lines[i], weights=sizes[i])
    return means, lines


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a small ridge."""
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        beta = np.clip(beta - np.linalg.solve(hess, grad), -30, 30)
    return float(beta[0]), float(beta[1])


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share_good: float) -> Model:
    """``docs``: features and lengths of the lines; ``labels``: 0 or 1; classes are weighted to ``share_good``."""
    rows = [with_neighbours(f) for f, _ in docs]
    sizes = [s for _, s in docs]
    width = FEATURES * 3
    if not rows or len(set(labels.tolist())) < 2:
        only = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros((width, 2)), np.zeros((2, 2)), 0.0, float(np.log((only + 1e-3) / (1 - only + 1e-3))))
    chains = _Chains(rows)
    lines = [np.full(len(r), float(y)) for r, y in zip(rows, labels)]
    weights, moves = _fit_field(chains, lines, width)
    for _ in range(2):
        _, seen = _means(chains, weights, moves, sizes)
        for i, y in enumerate(labels):
            if y == 0:  # the lines that look worst stay bad, whatever the field says of the others
                lines[i] = np.where(seen[i] <= seen[i].min() + 1e-9, 0.0, np.minimum(seen[i], 0.98))
        weights, moves = _fit_field(chains, lines, width)
    means, _ = _means(chains, weights, moves, sizes)
    good = labels == 1
    weight = np.where(good, share_good / max(good.sum(), 1), (1 - share_good) / max((~good).sum(), 1)) * len(labels)
    return Model(weights, moves, *_logistic(means, labels.astype(float), weight))


def scores(model: Model, batch: list[str]) -> np.ndarray:
    """Quality of whole texts, 0 to 1. An empty text is one empty line."""
    if not batch:
        return np.zeros(0)
    parts = [own_features(t) for t in batch]
    sizes = np.array([len(s) for _, s in parts])
    state = np.concatenate([with_neighbours(f) for f, _ in parts]) @ model.weights
    good = good_marginals(state, model.moves, sizes)
    length = np.concatenate([s for _, s in parts])
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    means = np.add.reduceat(good * length, at) / np.add.reduceat(length, at)
    return 1 / (1 + np.exp(-np.clip(model.slope * means + model.offset, -30, 30)))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for quality, text in zip(batch.column("quality").to_pylist(), batch.column("text")):
            text = text.as_py()
            if text.count("\n") >= SAMPLE_LINES:
                continue
            f, s = own_features(text)
            out.append((quality, f.astype("<f8").tobytes(), s.astype("<f8").tobytes()))
        if out:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "features", "sizes"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents of either class, those with the smallest hash of their id.

    Held-out ids, null ids and labels other than 0 and 1 are never read. A document with labels of both
    kinds counts with each.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    counts = dict(usable.groupBy("quality").count().collect())  # two rows
    parts = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    # one text of an id, however many rows repeat it: at most 2 x sample rows come to the driver
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = rows.select("quality", "text").mapInArrow(_sample_features, "quality int, features binary, sizes binary").collect()
    found.sort(key=lambda r: (r["quality"], bytes(r["features"])))  # the fit must not depend on the order of tasks
    data = [
        (np.frombuffer(r["features"], dtype="<f8").reshape(-1, FEATURES), np.frombuffer(r["sizes"], dtype="<f8")) for r in found
    ]
    total = sum(counts.values())
    return fit(data, np.array([r["quality"] for r in found]), counts.get(1, 0) / total if total else 0.5)


def scorer(model: Model):
    """A column function: the quality of a text column."""

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in text:
            values = part.fillna("").tolist()
            out = [scores(model, values[i : i + 256]) for i in range(0, len(values), 256)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def quality(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id, held_out, score, predicted``: a row per row of ``docs``.

    The text alone is scored. Null and empty texts get the score of one empty line. A null doc_id is not
    held out. Repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = texts(docs)
    scored = rows.select("doc_id", scorer(model)("text").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= keep_from).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_from``, all columns as they are."""
    return docs.where(scorer(model)(docs["text"].cast("string")) >= keep_from)
