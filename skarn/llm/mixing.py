"""Mixing sources to target weights with soft memberships.

A classifier, fitted on a bounded sample of labelled documents, gives each document posteriors over
domains.  Rates r >= 0 of documents are fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets: projected-gradient least squares on the
domains' relative errors, with a small pull of rates toward 1.  A step needs only the domains'
sums and how they move together, one small aggregate; its gradient is scaled by the latter, so
that few steps are needed.  A document's rate follows from its posteriors and the steps so far, so
no state is kept per document between steps.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import Classifier
from .common import bounded_sample, column, lean, plainly, sample_texts, with_fields, written
from .textkit import Words, byte_values, not_space, runs

#: Shares of tokens that the mixture aims at, by domain.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15, "junk": 0.0}


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = 3000) -> Classifier | None:
    """Fits on at most ``sample`` labelled documents, as ``sample_texts`` bounds them: domain junk if low
    or toxic, else the language.  Of labels that repeat a doc_id the worst counts; None without any."""
    labels = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("junk"))
    docs = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    first = bounded_sample(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("junk").alias("junk")), sample, "doc_id")
    rows = sample_texts(docs.join(F.broadcast(first), "doc_id").withColumn("domain", F.when(F.col("junk"), "junk").otherwise(F.col("lang"))).where(F.col("domain").isin(domains)), sample)
    known = [d for d in domains if any(r["domain"] == d for r in rows)]
    if not known:
        return None
    return Classifier(known).fit([r["text"] for r in rows], np.array([known.index(r["domain"]) for r in rows]))


def _posteriors(model: Classifier | None, domains: list[str], tokens: str, posterior: str, keep_text: bool):
    columns = [domains.index(d) for d in model.labels] if model is not None else []

    def run(batches):
        is_word, values = not_space(), byte_values(False)
        for batch in batches:
            texts = batch.column("text")
            p, n = np.full((batch.num_rows, len(domains)), 0.0 if columns else 1 / len(domains)), np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in runs(texts):
                n[i:j] = np.diff(Words(data, offsets, is_word, values).first)
                if columns:
                    p[i:j, columns] = model.predict(texts.slice(i, j - i))
            kept = [c for c in batch.schema.names if c != "text" or keep_text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=[*kept, tokens, posterior])

    return run


def rates(p: np.ndarray, steps: list[np.ndarray], pull: float) -> np.ndarray:
    """Rates after the steps so far, from 1."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - (p @ g + pull * (r - 1)) / (1 + pull))
    return r


def _matrix(posterior: pa.Array, k: int) -> np.ndarray:
    return posterior.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(steps: list[np.ndarray], pull: float, k: int):
    """One row per task: the domains' tokens at the rates so far, and how they move with a step."""

    def run(batches):
        total, moves = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p, n = _matrix(batch.column("posterior"), k), batch.column("n_tokens").to_numpy()
            r = rates(p, steps, pull)
            total += (r * n) @ p
            moves += p.T @ (p * (n * (r > 0))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*total, *moves.ravel())], names=[f"d{c}" for c in range(k + k * k)])

    return run


def _apply(steps: list[np.ndarray], pull: float, k: int, posterior: str, rate: str):
    def run(batches):
        for batch in batches:
            p = _matrix(batch.column(batch.schema.get_field_index(posterior)), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, steps, pull))], names=[*batch.schema.names, rate])

    return run


@dataclass
class Mixture:
    """What was fitted: the steps, the shares of tokens reached and wanted, and whether the fit settled.

    ``residual`` is the largest difference between a share reached and wanted.  It need not
    vanish: every document has some posterior in every domain, so a domain wanted at 0 keeps what
    the others' documents carry of it."""

    reached: dict[str, float]
    wanted: dict[str, float]
    converged: bool = False
    steps: list[np.ndarray] = field(default_factory=list)

    @property
    def residual(self) -> float:
        return max((abs(self.reached[d] - self.wanted[d]) for d in self.wanted), default=0.0)


def fit(base: DataFrame, targets: dict[str, float], steps: int = 60, pull: float = 1e-3, tolerance: float = 1e-5) -> Mixture:
    """Fits rates to base(n_tokens, posterior); settled once no domain's share moves by ``tolerance``.

    A fit that ``steps`` steps do not settle says so by a warning and in ``converged``."""
    domains, k = list(targets), len(targets)

    def sums(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        width = k + k * k
        rows = base.select("n_tokens", "posterior").mapInArrow(lean(_sums(history, pull, k)), ", ".join(f"d{c} double" for c in range(width)))
        row = rows.agg(*(F.sum(f"d{c}").alias(f"d{c}") for c in range(width))).first()
        x = np.array([row[c] or 0.0 for c in range(width)])
        return x[:k], x[k:].reshape(k, k)

    weights = np.array([max(0.0, targets[d]) for d in domains])
    now, moves = sums([])
    start = now
    total = max(start.sum(), 1e-12)
    aim = weights / max(weights.sum(), 1e-12) * start.sum()
    out, best = Mixture({}, dict(zip(domains, (aim / total).tolist(), strict=True))), None
    history: list[np.ndarray] = []
    for _ in range(steps):
        error = np.where(start > 0, now - aim, 0.0)
        if best is None or (error**2).sum() < best[0]:
            best = ((error**2).sum(), len(history), now)
        # The step that would end the error if no rate met its bound; a little is added where domains hardly move.
        scaled = np.linalg.solve(moves + np.eye(k) * (1e-3 * np.trace(moves) / k + 1e-9), error)
        history.append(scaled)
        before, (now, moves) = now, sums(history)
        if np.abs(now - before).max(initial=0.0) <= tolerance * total:
            out.converged = True
            break
    error = np.where(start > 0, now - aim, 0.0)
    if best is None or (error**2).sum() <= best[0]:
        best = (0.0, len(history), now)
    out.steps, out.reached = history[: best[1]], dict(zip(domains, (best[2] / total).tolist(), strict=True))
    if not out.converged:
        warnings.warn(f"mixing did not settle in {steps} steps; largest difference of a share {out.residual:.4f}", stacklevel=2)
    return out


def mix_to_targets(docs: DataFrame, model: Classifier | None, targets: dict[str, float], steps: int = 60, pull: float = 1e-3, tolerance: float = 1e-5, keep_text: bool = False) -> tuple[DataFrame, Mixture]:
    """(documents, what was fitted): a row per row of ``docs``, its columns and n_tokens, posterior, rate.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``.  ``targets`` are shares by domain; they are scaled to sum
    to 1 of all tokens.  Null and empty texts have no tokens and so no weight, but a rate.  A
    domain in which no document has a share can't be matched and is left out.  Without a model
    posteriors are even.  Where ``docs`` has a column of an output's name, in any case, the output
    stands in its place.  Texts are left out but for ``keep_text``.  The sums that steps need are
    as many numbers as domains have pairs.
    """
    domains, k = list(targets), len(targets)
    outputs = ("n_tokens", "posterior", "rate")
    named = [c for c in docs.columns if c.lower() not in outputs]
    docs = plainly(docs.select(*map(column, named)))
    kept = docs if keep_text else docs.drop("text")
    base = written(docs.mapInArrow(lean(_posteriors(model, domains, "n_tokens", "posterior", keep_text)), with_fields(kept.schema, "n_tokens long", "posterior array<double>")))
    fitted = fit(base, targets, steps, pull, tolerance)
    out = base.mapInArrow(lean(_apply(fitted.steps, pull, k, "posterior", "rate")), with_fields(base.schema, "rate double"))
    return out.toDF(*(c for c in named if c != "text" or keep_text), *outputs), fitted
