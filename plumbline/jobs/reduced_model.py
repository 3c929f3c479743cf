"""A reduced-order model as Spark jobs: assembly by aggregation, then batched online queries.

The model is affine in q: K(q) = sum_k q_k K_k with K_k of size r x r, and right-hand sides B(q) likewise. An
answer is the output tensor D(q) - B(q)^T K(q)^-1 B(q). Operators come from field tables, see ``jobs.fields``. They
have 7 (r^2 + 6 r + 36) numbers, which is what tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import statistics
from plumbline.operators.ordered import spread

TERMS = 7
LOADS = 6


def _summed(q: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """(n, i, j): sums of the terms (7, i, j) weighted by each row of q (n, 7), as one product."""
    return (q @ terms.reshape(len(terms), -1)).reshape(len(q), *terms.shape[1:])


@dataclass(frozen=True)
class ReducedModel:
    """stiffness (7, r, r), loads (7, r, 6), constants (7, 6, 6)."""

    stiffness: np.ndarray
    loads: np.ndarray
    constants: np.ndarray

    def solve(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs (n, 6, 6) and relative residuals (n) for coefficients (n, 7)."""
        k, b = _summed(q, self.stiffness), _summed(q, self.loads)
        x = np.linalg.solve(k, b)
        left = np.linalg.norm(k @ x - b, axis=(1, 2)) / np.maximum(np.linalg.norm(b, axis=(1, 2)), 1e-300)
        out = _summed(q, self.constants) - b.swapaxes(1, 2) @ x
        return (out + out.swapaxes(1, 2)) / 2, left


def answer(materials: DataFrame, key: str, coefficients: list[str], model: ReducedModel) -> DataFrame:
    """key, 36 output columns c11..c66, residual and least eigenvalue for each material, in batches."""
    names = [f"c{i + 1}{j + 1}" for i in range(LOADS) for j in range(LOADS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            out, left = model.solve(frame[coefficients].to_numpy(dtype=float))
            table = pd.DataFrame(out.reshape(-1, LOADS * LOADS), columns=names)
            table.insert(0, key, frame[key].to_numpy())
            yield table.assign(residual=left, least_eigenvalue=np.linalg.eigvalsh(out)[:, 0])

    kind = materials.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{n} double" for n in (*names, "residual", "least_eigenvalue"))
    return spread(materials.select(key, *coefficients)).mapInPandas(run, schema)


def uncertainty(answers: DataFrame, outputs: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Summary of each output over the answers that pass the gate: small residual, positive definite."""
    return statistics.summaries(answers.filter((F.col("residual") <= tolerance) & (F.col("least_eigenvalue") > 0)), outputs)


def rank_curve(materials: DataFrame, key: str, coefficients: list[str], model: ReducedModel, ranks: list[int]) -> DataFrame:
    """Per rank: mean, 95th percentile and largest relative error against the full model's answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q = frame[coefficients].to_numpy(dtype=float)
            truth, _ = model.solve(q)
            size = np.linalg.norm(truth, axis=(1, 2))
            for r in ranks:
                small = ReducedModel(model.stiffness[:, :r, :r], model.loads[:, :r], model.constants)
                gap = np.linalg.norm(small.solve(q)[0] - truth, axis=(1, 2)) / np.maximum(size, 1e-300)
                yield pd.DataFrame({"rank": r, key: frame[key], "error": gap})

    kind = materials.schema[key].dataType.simpleString()
    errors = spread(materials.select(key, *coefficients)).mapInPandas(run, f"rank int, {key} {kind}, error double")
    return statistics.error_statistics(errors, ["rank"], "error", key)


def adaptive_selection(candidates: DataFrame, key: str, vector: str, batch: int, rounds: int, tolerance: float) -> DataFrame:
    """position, key and score of candidates chosen in batches, each the worst represented by those before.

    A round projects all candidates on the span of the chosen ones (an array of chosen x d numbers), takes the
    ``batch`` with the largest part outside of it and stops when that is within the tolerance.
    """
    spark = candidates.sparkSession
    basis: np.ndarray | None = None
    chosen: list[tuple[int, int, float]] = []
    for _ in range(rounds):
        frame = np.zeros((0, 0)) if basis is None else basis

        def run(frames: Iterator[pd.DataFrame], frame: np.ndarray = frame) -> Iterator[pd.DataFrame]:
            for part in frames:
                if len(part):
                    x = np.array(part[vector].tolist(), dtype=float)
                    left = x if not len(frame) else x - (x @ frame.T) @ frame
                    yield pd.DataFrame({key: part[key], "score": np.linalg.norm(left, axis=1)})

        scores = candidates.select(key, vector).mapInPandas(run, f"{key} long, score double")
        top = scores.orderBy(F.col("score").desc(), key).limit(batch).collect()
        new = [r for r in top if r["score"] > tolerance]
        if not new:
            break
        chosen += [(len(chosen) + i, r[key], r["score"]) for i, r in enumerate(new)]
        wanted = candidates.filter(F.col(key).isin([r[key] for r in new])).select(key, vector).collect()
        stack = np.array([r[vector] for r in sorted(wanted, key=lambda r: r[key])], dtype=float)
        #: Twice, so that rounding leaves the basis orthonormal.
        for _ in range(2):
            if basis is not None:
                stack = stack - (stack @ basis.T) @ basis
        u, s, vt = np.linalg.svd(stack, full_matrices=False)
        fresh = vt[s > max(s[0], 1.0) * 1e-12]
        basis = fresh if basis is None else np.vstack([basis, fresh])
    return spark.createDataFrame(chosen, f"position int, {key} long, score double")


def _by_batch(rows: DataFrame, key: str, columns: list[str], schema: str, make) -> DataFrame:
    """make(keys, array of columns) for each batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield make(frame[key].to_numpy(), frame[columns].to_numpy(dtype=float))

    #: Rows are few bytes and much work.
    return spread(rows.select(key, *columns)).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def certified(materials: DataFrame, key: str, coefficients: list[str], model: ReducedModel, rank: int) -> DataFrame:
    """key, error and bound (both relative) of the model cut to ``rank``, effectivity, and whether the bound fails.

    The output's error is the residual's energy in K^-1; with each term's smallest eigenvalue known, sum q_k
    min_k is below K's, and the residual's squared norm over it is a bound that needs no full solve. Needs
    q >= 0.
    """
    lowest = np.array([np.linalg.eigvalsh(k)[0] for k in model.stiffness])

    def make(keys: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        small = ReducedModel(model.stiffness[:, :rank, :rank], model.loads[:, :rank], model.constants)
        truth, coarse = model.solve(q)[0], small.solve(q)[0]
        k, b = np.einsum("nq,qij->nij", q, model.stiffness), np.einsum("nq,qij->nij", q, model.loads)
        x = np.zeros_like(b)
        x[:, :rank] = np.linalg.solve(k[:, :rank, :rank], b[:, :rank])
        left = b - k @ x
        bound = np.einsum("nij,nij->n", left, left) / np.maximum(q @ lowest, 1e-300)
        size = np.maximum(np.linalg.norm(coarse, axis=(1, 2)), 1e-300)
        error = np.linalg.norm(coarse - truth, axis=(1, 2)) / size
        bound = bound / size
        return pd.DataFrame({key: keys, "error": error, "bound": bound, "effectivity": bound / np.maximum(error, 1e-15), "violated": error > bound * (1 + 1e-9) + 1e-12})

    return _by_batch(materials, key, coefficients, "error double, bound double, effectivity double, violated boolean", make)


def sensitivities(materials: DataFrame, key: str, coefficients: list[str], model: ReducedModel) -> DataFrame:
    """key, term and 36 columns s11..s66: the output's derivative by each coefficient, and its norm."""
    names = [f"s{i + 1}{j + 1}" for i in range(LOADS) for j in range(LOADS)]

    def make(keys: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        slopes = _slopes(model, q)
        table = pd.DataFrame(slopes.reshape(-1, LOADS * LOADS), columns=names)
        table.insert(0, "term", np.tile(np.arange(TERMS, dtype=np.int32), len(keys)))
        table.insert(0, key, np.repeat(keys, TERMS))
        return table.assign(norm=np.linalg.norm(slopes, axis=(2, 3)).ravel())

    return _by_batch(materials, key, coefficients, "term int, " + ", ".join(f"{n} double" for n in (*names, "norm")), make)


def _slopes(model: ReducedModel, q: np.ndarray) -> np.ndarray:
    """(n, 7, 6, 6): D_k - B_k^T X - X^T B_k + X^T K_k X with X = K^-1 B."""
    x = np.linalg.solve(_summed(q, model.stiffness), _summed(q, model.loads))
    n, r = x.shape[:2]
    flat = np.ascontiguousarray(x.swapaxes(1, 2)).reshape(n * LOADS, r)
    #: Row (n, j) of flat is column j of X: products with all terms at once.
    cross = (flat @ model.loads.transpose(1, 0, 2).reshape(r, TERMS * LOADS)).reshape(n, LOADS, TERMS, LOADS).transpose(0, 2, 3, 1)
    pushed = (flat @ model.stiffness.transpose(2, 0, 1).reshape(r, TERMS * r)).reshape(n, LOADS, TERMS, r).transpose(0, 2, 3, 1)
    inner = flat.reshape(n, 1, LOADS, r) @ pushed
    return model.constants[None] - cross - cross.swapaxes(2, 3) + inner


def identify(targets: DataFrame, key: str, outputs: list[str], model: ReducedModel, low: list[float], high: list[float], rounds: int = 60) -> DataFrame:
    """key, q0..q6, misfit (relative) and steps: coefficients in a box whose answers fit 36 target columns.

    Damped Gauss-Newton from the box's centre with steps cut to the box, all rows of a batch at once; a row's
    damping falls when a step helps and grows when it does not.
    """
    lower, upper = np.array(low, dtype=float), np.array(high, dtype=float)
    names = [f"q{k}" for k in range(TERMS)]

    def make(keys: np.ndarray, flat: np.ndarray) -> pd.DataFrame:
        goal = flat.reshape(-1, LOADS, LOADS)
        size = np.maximum(np.linalg.norm(flat, axis=1), 1e-300)
        q = np.tile((lower + upper) / 2, (len(keys), 1))
        gap = (model.solve(q)[0] - goal).reshape(len(q), -1) / size[:, None]
        damping, steps = np.full(len(q), 1e-3), np.zeros(len(q), dtype=np.int32)
        for _ in range(rounds):
            active = np.flatnonzero((np.linalg.norm(gap, axis=1) > 1e-12) & (damping < 1e12))
            if not len(active):
                break
            #: Only the rows that are not done take part.
            own, scale_, left = q[active], size[active], gap[active]
            slope = _slopes(model, own).reshape(len(own), TERMS, -1) / scale_[:, None, None] * (upper - lower)[None, :, None]
            normal = slope @ slope.swapaxes(1, 2)
            scale = np.einsum("nii->ni", normal) + 1e-12
            move = np.linalg.solve(normal + damping[active, None, None] * np.einsum("ni,ij->nij", scale, np.eye(TERMS)), -(slope @ left[:, :, None]))[:, :, 0]
            tried = np.clip(own + move * (upper - lower), lower, upper)
            new = (model.solve(tried)[0] - goal[active]).reshape(len(own), -1) / scale_[:, None]
            better = np.linalg.norm(new, axis=1) < np.linalg.norm(left, axis=1)
            q[active[better]], gap[active[better]] = tried[better], new[better]
            damping[active] = np.where(better, np.maximum(damping[active] / 5, 1e-14), damping[active] * 4)
            steps[active] += 1
        return pd.DataFrame({key: keys} | {n: q[:, k] for k, n in enumerate(names)} | {"misfit": np.linalg.norm(gap, axis=1), "steps": steps})

    return _by_batch(targets, key, outputs, ", ".join(f"{n} double" for n in names) + ", misfit double, steps int", make)
