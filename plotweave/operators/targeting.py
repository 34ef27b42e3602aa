"""Positional uncertainty as a Gaussian process, and where a surveyor should go next."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..common import cut, finished, global_rank, uncut
from .blocking import nearest

MAX_TRAIN, MAX_CANDIDATES, JITTER = 600, 2_500, 1e-8
POINT_COST, RESURVEY_KM2 = 5_750.0, 56_725.0
#: Rows of a sample that a single task may hold; a larger one is ranked range by range.
TASK_SAMPLE = 20_000


@finished
def sampled(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n rows by a seeded hash of all columns: the same ones wherever the rows lie.

    Order with a limit makes room for 2n rows in each task before it reads one
    and ends in a single task, so it serves small samples only.
    """
    by = F.xxhash64(F.lit(seed), *df.columns)
    if n <= TASK_SAMPLE:
        return df.orderBy(by).limit(n)
    return df if df.count() <= n else global_rank(df, [by], "__rank").filter(F.col("__rank") <= n).drop("__rank")


def nelder_mead(f, x0: np.ndarray, rounds: int = 400, step: float = 0.5) -> np.ndarray:
    """Minimum by the simplex method with standard coefficients."""
    s = [np.array(x0, float)] + [np.array(x0, float) + step * np.eye(len(x0))[i] for i in range(len(x0))]
    v = [f(p) for p in s]
    for _ in range(rounds):
        o = np.argsort(v, kind="stable")
        s, v = [s[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) < 1e-8 and np.abs(s[-1] - s[0]).max() < 1e-8:
            break
        c = np.mean(s[:-1], axis=0)
        r = 2 * c - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * c - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = (c + (r if fr < v[-1] else s[-1])) / 2
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s = [s[0]] + [(p + s[0]) / 2 for p in s[1:]]
                v = [v[0]] + [f(p) for p in s[1:]]
    return s[int(np.argmin(v))]


@dataclass
class Uncertainty:
    """RBF process shared by both residual axes: length, signal and noise variance, and a prediction scale."""

    length: float = 100.0
    signal: float = 1.0
    noise: float = 0.05
    scale: float = 1.0

    def k(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        return self.signal * np.exp(-d2 / (2 * self.length**2))

    @classmethod
    def fit(cls, residuals: DataFrame, seed: int = 0) -> Uncertainty:
        """Fit (x, y, rx, ry) rows by marginal likelihood on a bounded sample; the driver solves one small system.

        Bounds: length 5 m to twice the span, noise 1e-6 to the signal.
        """
        rows = np.array(sampled(residuals.select("x", "y", "rx", "ry").na.drop(), MAX_TRAIN, seed).collect(), float).reshape(-1, 4)
        if len(rows) < 3:
            return cls()
        xy, r = rows[:, :2] - rows[:, :2].mean(axis=0), rows[:, 2:] - rows[:, 2:].mean(axis=0)
        span, var = float(np.ptp(xy, axis=0).max()) or 1.0, float(r.var()) or 1.0
        d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)

        def nll(t: np.ndarray) -> float:
            ell, sf, sn = np.exp(np.clip(t, -20, 20))
            try:
                c = np.linalg.cholesky(sf * np.exp(-d2 / (2 * ell**2)) + (sn + JITTER) * np.eye(len(xy)))
            except np.linalg.LinAlgError:
                return 1e12
            a = np.linalg.solve(c, r)
            return float((a**2).sum() / 2 + 2 * np.log(np.diag(c)).sum())

        ell, sf, sn = np.exp(nelder_mead(nll, np.log([span / 6, var, 0.05 * var])))
        return cls(float(np.clip(ell, 5, 2 * span)), float(sf), float(np.clip(sn, 1e-6, sf)))

    def posterior(self, query: DataFrame, observed: np.ndarray, values: np.ndarray | None = None) -> DataFrame:
        """Query rows (x, y, ...) with ``variance`` and, given values, ``mx`` and ``my``; one Arrow pass.

        The observed points are few (a plan's), so their solved system travels along.
        """
        model, n = self, len(observed)
        c = np.linalg.cholesky(self.k(observed, observed) + (self.noise + JITTER) * np.eye(n)) if n else None
        w = np.linalg.solve(c.T, np.linalg.solve(c, values)) if n and values is not None else None

        @F.arrow_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in ("variance", "mx", "my")]))
        def post(x: pa.Array, y: pa.Array) -> pa.Array:
            q = np.column_stack([np.asarray(x, dtype=float), np.asarray(y, dtype=float)])
            var, mean = np.full(len(q), model.signal), np.zeros((len(q), 2))
            if n and len(q):
                k = model.k(q, observed)
                var = np.maximum(model.signal - (np.linalg.solve(c, k.T) ** 2).sum(axis=0), 0)
                mean = k @ w if w is not None else mean
            return pa.StructArray.from_arrays([pa.array(var), pa.array(mean[:, 0].copy()), pa.array(mean[:, 1].copy())], ["variance", "mx", "my"])

        return query.withColumn("__p", post("x", "y")).select(*query.columns, "__p.*")

    def rmse(self, query: DataFrame, observed: np.ndarray, with_noise: bool = True) -> DataFrame:
        """``rmse`` over the query points, both axes, scaled."""
        extra = self.noise if with_noise else 0.0
        return self.posterior(query.select("x", "y"), observed).agg((F.sqrt(2 * F.avg(F.col("variance") + extra)) * self.scale).alias("rmse"))

    def irreducible(self) -> float:
        return float(np.sqrt(2 * self.noise) * self.scale)

    def calibrate(self, pairs: DataFrame) -> Uncertainty:
        """Prediction scale as the median of achieved over predicted."""
        m = pairs.filter("predicted > 0").agg(F.median(F.col("achieved") / F.col("predicted"))).head()[0]
        return Uncertainty(self.length, self.signal, self.noise, self.scale * (m or 1.0))


def candidate_corners(parcels: DataFrame, most: int = MAX_CANDIDATES, seed: int = 0) -> DataFrame:
    """``x, y`` of outer-ring corners, a bounded seeded sample; a corner that parcels share may appear more than once."""
    r = F.element_at(F.element_at("geom.parts", 1), 1)
    pts = parcels.filter("geom is not null").select("fid", F.posexplode(F.when(F.size(r) > 1, F.slice(r, 1, F.size(r) - 1))).alias("k", "v")).select("fid", "k", "v.x", "v.y")
    return sampled(pts, most, seed).select("x", "y")


def plan_survey(parcels: DataFrame, candidates: DataFrame, model: Uncertainty, k: int = 40, existing: np.ndarray | None = None, least_ratio: float = 0.002, separation: float = 25.0) -> tuple[list[dict], str]:
    """Greedy plan: each step takes the candidate that lowers the summed variance at all parcel centres most.

    gain(c) = sum over x of cov(x, c)^2 / (var(c) + noise). Parcel centres stay
    distributed: each task keeps its rows' covariance to the few candidates,
    conditioned on the points so far, and only candidate sums come back.
    """
    cand = np.array(candidates.select("x", "y").orderBy("x", "y").collect(), float).reshape(-1, 2)
    pts = cut(parcels.select("x", "y").na.drop())
    n = pts.count()
    s = np.array(existing if existing is not None else np.empty((0, 2)), float).reshape(-1, 2)
    plan, first, why = [], None, "all points placed"
    open_ = np.ones(len(cand), bool)
    while len(plan) < k and open_.any() and n:
        c = np.linalg.cholesky(model.k(s, s) + (model.noise + JITTER) * np.eye(len(s))) if len(s) else None
        kc = np.linalg.solve(c, model.k(s, cand)) if len(s) else None

        def part(batches, s=s, c=c, kc=kc):
            gain, var = np.zeros(len(cand)), 0.0
            for b in batches:
                x = np.column_stack([np.asarray(b.column(i), dtype=float) for i in (0, 1)])
                cov = model.k(x, cand)
                v = np.full(len(x), model.signal)
                if len(s):
                    kx = np.linalg.solve(c, model.k(s, x))
                    cov, v = cov - kx.T @ kc, np.maximum(v - (kx**2).sum(axis=0), 0)
                gain, var = gain + (cov**2).sum(axis=0), var + v.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cand) + 1)), pa.array(np.append(gain, var))], names=["c", "g"])

        sums = dict(pts.mapInArrow(part, "c long, g double").groupBy("c").agg(F.sum("g").alias("g")).collect())
        own = model.signal - ((kc**2).sum(axis=0) if len(s) else 0.0)
        gain = np.array([sums.get(i, 0.0) for i in range(len(cand))]) / (own + model.noise)
        before = float(np.sqrt(2 * (sums[len(cand)] / n + model.noise)) * model.scale)
        gain = np.where(open_, gain, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] <= 0:
            why = "no candidate lowers the uncertainty"
            break
        first = first or float(gain[i])
        if gain[i] < least_ratio * first:
            why = "gain below the floor"
            break
        s = np.vstack([s, cand[i]])
        share = gain[i] / first
        plan.append({"rank": len(plan) + 1, "x": float(cand[i, 0]), "y": float(cand[i, 1]), "marginal_gain": float(gain[i]), "rmse_before": before, "reason": "largest gain" if not plan else "high gain" if share > 0.5 else "steady gain" if share > 0.15 else "fills a gap"})
        open_ &= np.hypot(*(cand - cand[i]).T) >= separation
    for p, q in zip(plan, plan[1:], strict=False):
        p["rmse_after"], p["rmse_delta"] = q["rmse_before"], p["rmse_before"] - q["rmse_before"]
    if plan:
        last = model.rmse(pts, s).head()[0]
        plan[-1]["rmse_after"], plan[-1]["rmse_delta"] = last, plan[-1]["rmse_before"] - last
    uncut(pts)
    return plan, why


def plan_costs(n_points: int, area_km2: float) -> dict[str, float]:
    return {"plan_cost": n_points * POINT_COST, "resurvey_cost": area_km2 * RESURVEY_KM2}


def uncertainty_grid(parcels: DataFrame, model: Uncertainty, observed: np.ndarray, cells: int = 60) -> DataFrame:
    """``i, j, x, y, before, after``: standard deviation on a grid over the extent."""
    e = parcels.agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))])
    axis = parcels.sparkSession.range(cells * cells).select((F.col("id") % cells).alias("i"), F.floor(F.col("id") / cells).alias("j")).crossJoin(F.broadcast(e))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * F.col(i) / (cells - 1)
    d = axis.select("i", "j", at("x0", "x1", "i").alias("x"), at("y0", "y1", "j").alias("y"))
    return model.posterior(d, observed).select("i", "j", "x", "y", F.lit(float(np.sqrt(model.signal))).alias("before"), F.sqrt("variance").alias("after"))


def achieved_rmse(model: Uncertainty, control: np.ndarray, pairs: DataFrame) -> float:
    """What remains of known displacements (x, y, rx, ry) once the posterior mean of those at the control points is taken off.

    Each control point takes the displacement of the pair nearest to it. NaN
    under three points or without pairs.
    """
    if len(control) < 3:
        return float("nan")
    spark = pairs.sparkSession
    at = spark.createDataFrame([(f"{i:06d}", float(x), float(y)) for i, (x, y) in enumerate(control)], "fid string, x double, y double")
    p = cut(pairs.select("x", "y", "rx", "ry").na.drop().withColumn("fid", F.concat_ws(",", "x", "y")))
    near = nearest(at, p, 1, 50.0).select("src", F.col("tgt").alias("fid")).join(p.groupBy("fid").agg(F.min(F.struct("x", "y", "rx", "ry")).alias("r")), "fid")
    own = np.array([tuple(r["r"]) for r in near.select("r").distinct().orderBy("r").collect()], float).reshape(-1, 4)
    if len(own) < 3:
        return float("nan")
    d = model.posterior(p, own[:, :2], own[:, 2:])
    got = d.agg(F.sqrt(F.avg(F.pow(F.col("rx") - F.col("mx"), 2) + F.pow(F.col("ry") - F.col("my"), 2)))).head()[0]
    uncut(p)
    return float("nan") if got is None else float(got)


def validate_plan(model: Uncertainty, plan: np.ndarray, candidates: DataFrame, pairs: DataFrame, seed: int = 0) -> dict[str, float]:
    """Root mean square displacement before, after the plan's points, and after as many random candidates."""
    before = pairs.agg(F.sqrt(F.avg(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")))).head()[0]
    random = np.array(sampled(candidates.select("x", "y"), len(plan), seed).collect(), float).reshape(-1, 2)
    return {"before": before, "achieved": achieved_rmse(model, plan, pairs), "random": achieved_rmse(model, random, pairs)}
