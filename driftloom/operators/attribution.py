"""Model backends for token sequences: forward states, activation gradients and parameter influence of a small causal model.

The model is an embedding and a linear read-out without bias, with weights from a seed, so its gradients have a closed form. A backend is any object
with ``forward(ids)`` and ``gradient(ids)``; the operators only stream Arrow batches through it, one row in, one row out, so results do
not depend on how rows fall into batches. Real models plug in at the same place.

Defined cases: sequences with fewer than two ids, null ids or null elements have null results; ids are taken modulo the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TinyCausalModel:
    """hidden = E[id]; logits = hidden W'; the loss is the mean cross-entropy of the next ids."""

    vocabulary: int = 47
    width: int = 8
    seed: int = 1729

    @cached_property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(0, 0.5, (self.vocabulary, self.width)), rng.normal(0, 0.5, (self.vocabulary, self.width))

    def forward(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[0][ids % self.vocabulary]

    def _soft(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hidden, targets = self.forward(ids[:-1]), ids[1:] % self.vocabulary
        logits = hidden @ self.weights[1].T
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return hidden, targets, p / p.sum(axis=1, keepdims=True)

    def gradient(self, ids: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss, and its gradient at each token's hidden state."""
        _, targets, p = self._soft(ids)
        at = np.arange(len(targets))
        loss = float(-np.log(p[at, targets]).mean())
        p[at, targets] -= 1
        return loss, p @ self.weights[1] / len(targets)

    def parameter_gradients(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the read-out and the embedding."""
        hidden, targets, p = self._soft(ids)
        at = np.arange(len(targets))
        p[at, targets] -= 1
        read = p.T @ hidden / len(targets)
        embed = np.zeros_like(self.weights[0])
        np.add.at(embed, ids[:-1] % self.vocabulary, p @ self.weights[1] / len(targets))
        return {"read": read, "embed": embed}


def _usable(ids) -> np.ndarray | None:
    if ids is None or len(ids) < 2 or any(i is None or i != i for i in ids):
        return None
    return np.asarray(ids, dtype=np.int64)


def _mapped(df: DataFrame, ident: str, ids: str, row, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(",")]
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, x in zip(pdf["ident"].tolist(), pdf["ids"]):
                own = _usable(x)
                out.append((i, *(row(own) if own is not None else [None] * len(names))))
            yield pd.DataFrame(out, columns=[ident, *names])

    return df.select(F.col(ident).alias("ident"), F.col(ids).alias("ids")).mapInPandas(run, f"{ident} {kind}, {columns}")


def project(df: DataFrame, ident: str, ids: str, model: TinyCausalModel, axes: dict[str, Sequence[float]], k: int = 4) -> DataFrame:
    """Forward only: per axis the mean, greatest, top-k mean and positive share of the tokens' projections (the last id is dropped)."""
    names, matrix = list(axes), np.asarray(list(axes.values()), dtype=float)

    def row(own: np.ndarray):
        scores = model.forward(own[:-1]) @ matrix.T
        top = np.sort(scores, axis=0)[::-1][: min(k, len(scores))]
        return list(zip(names, scores.mean(0), scores.max(0), top.mean(0), (scores > 0).mean(0)))

    return _project(df, ident, ids, row)


def _project(df: DataFrame, ident: str, ids: str, row) -> DataFrame:
    kind = df.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, x in zip(pdf["ident"].tolist(), pdf["ids"]):
                own = _usable(x)
                out += [(i, *map(lambda v: v if isinstance(v, str) else float(v), s)) for s in (row(own) if own is not None else [])]
            yield pd.DataFrame(out, columns=[ident, "axis_name", "mean", "max", "top_mean", "positive_share"])

    return df.select(F.col(ident).alias("ident"), F.col(ids).alias("ids")).mapInPandas(run, f"{ident} {kind}, axis_name string, mean double, max double, top_mean double, positive_share double")


def pressure(df: DataFrame, ident: str, ids: str, model: TinyCausalModel, axis: Sequence[float]) -> DataFrame:
    """Activation gradients: loss, norm of the update pressure u = -mean gradient, its dot and cosine with the axis."""
    a = np.asarray(axis, dtype=float)

    def row(own: np.ndarray):
        loss, g = model.gradient(own)
        u = -g.mean(axis=0)
        n = float(np.linalg.norm(u))
        return loss, n, float(u @ a), float(u @ a / (n * np.linalg.norm(a))) if n > 0 else None

    return _mapped(df, ident, ids, row, "loss double, norm double, dot double, cosine double")


def influence(df: DataFrame, ident: str, ids: str, model: TinyCausalModel, query: Sequence[int]) -> DataFrame:
    """First-order influence on a query sequence: minus the dot of both parameter gradients, added up block by block, and the cosine."""
    q = model.parameter_gradients(np.asarray(query, dtype=np.int64))
    qn = float(np.sqrt(sum((b * b).sum() for b in q.values())))

    def row(own: np.ndarray):
        g = model.parameter_gradients(own)
        dot = -sum(float((g[b] * q[b]).sum()) for b in q)
        n = float(np.sqrt(sum((b * b).sum() for b in g.values())))
        return n, dot, dot / (n * qn) if n * qn > 0 else None

    return _mapped(df, ident, ids, row, "gradient_norm double, negative_dot double, cosine double")


def generated(df: DataFrame, ident: str, prompt: str) -> DataFrame:
    """The template provider of responses: fixed text around the prompt's last line, for runs without a model."""
    question = F.element_at(F.split(F.col(prompt), "\n"), -1)
    return df.select(ident, F.concat(F.lit("Template answer to: "), F.coalesce(question, F.lit("(no prompt)"))).alias("generated_response"))


def decoded(df: DataFrame, ident: str, ids: str, end: int = 0) -> DataFrame:
    """The default codec: a letter for each id, a line end for the end id; a vocabulary's codec plugs in here."""
    chars = F.transform(F.filter(F.col(ids), lambda x: x.isNotNull()), lambda x: F.when(x == end, F.lit("\n")).otherwise(F.char(x % 26 + 97)))
    return df.select(ident, F.array_join(chars, "").alias("decoded_text"))
