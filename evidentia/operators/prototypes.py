"""Cooling prototypes with state, stepped by Euler's rule: as one fold per row, or as whole time series.

A prototype is a passive conductance, the electrical power of its device, what that device rejects, and the heat a
phase change may still take up. Each rule is written once over ``ops`` (``SQL`` or ``ARRAYS``), so that the fold in
``simulate`` and the series in ``series`` share it. ``rows`` holds one run a row, with its own constants: a sweep of any
number of runs is spread over the cluster by its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = SimpleNamespace(least=F.least, greatest=F.greatest, where=lambda c, a, b: F.when(c, a).otherwise(b), pmod=F.pmod, num=F.lit)
ARRAYS = SimpleNamespace(least=lambda *x: np.minimum.reduce(np.broadcast_arrays(*x)), greatest=lambda *x: np.maximum.reduce(np.broadcast_arrays(*x)), where=np.where, pmod=np.mod, num=float)

#: Watts per kelvin from skin to the mattress.
CONTACT = 1.8
#: Steps of a series that leave a worker as one batch.
CHUNK = 2048


@dataclass(frozen=True)
class Prototype:
    """power(ops, seconds, temperature) and rejected(ops, temperature, power, net, store, capacity, step) in watts."""

    passive: float
    power: Callable[..., Any] = lambda ops, t, c: ops.num(0.0)
    rejected: Callable[..., Any] = lambda ops, c, w, net, store, capacity, dt: ops.num(0.0)
    store: float = 0.0


def _latent(melts: float, most: float):
    """A phase change takes up at most ``most`` watts, what is left of it, and nothing that would cool below ``melts``."""

    def rejected(ops, c, w, net, store, capacity, dt):
        return ops.greatest(ops.num(0.0), ops.least(ops.num(most), store / dt, net + capacity * (c - melts) / dt))

    return rejected


def _chiller(target: float, most: float, cop: float, gain: float, passive: float, skin: float = 37.0, ambient: float = 25.0):
    hold = max(0.0, CONTACT * (skin - target) - passive * (target - ambient))
    return lambda ops, t, c: ops.least(ops.num(most), ops.greatest(ops.num(0.0), hold + gain * (c - target)) / cop)


def _device(conductance: float, cold: float, share: float):
    """The lesser of what the path to the cold side conducts and what the device moves for its power."""
    return lambda ops, c, w, net, store, capacity, dt: ops.least(ops.greatest(ops.num(0.0), conductance * (c - cold)), share * w)


def _pulsed(boost_s: float, boost: float, pulse: float, period: float, on: float):
    return lambda ops, t, c: ops.where(t < boost_s, ops.num(boost), ops.where(ops.pmod(t - boost_s, ops.num(period)) < on, ops.num(pulse), ops.num(0.0)))


def _ramped(low: float, high: float, inner):
    def rejected(ops, c, w, *rest):
        return ops.least(ops.num(1.0), ops.greatest(ops.num(0.0), (c - low) / (high - low))) * inner(ops, c, w, *rest)

    return rejected


PROTOTYPES: dict[str, Prototype] = {
    "P1": Prototype(0.35, rejected=_latent(28.5, 15.0), store=73_500.0),
    "P2": Prototype(2.8, power=lambda ops, t, c: ops.num(5.0)),
    "P3": Prototype(0.6, power=_chiller(29.5, 60.0, 0.65, 8.0, 0.6), rejected=_device(11.25, 18.0, 0.65)),
    "P4": Prototype(2.25),
    "P5": Prototype(1.4, power=_pulsed(3600.0, 40.0, 10.0, 60.0, 30.0), rejected=_ramped(27.8, 30.0, _device(2.48, 20.0, 0.35))),
}


def runs(spark: SparkSession) -> DataFrame:
    """The one default run: id, ambient_c, skin_c, capacity (J/K)."""
    return spark.createDataFrame([(1, 25.0, 37.0, 960.0)], "id long, ambient_c double, skin_c double, capacity double")


def check(steps: int, step: float) -> None:
    if steps <= 0 or step <= 0:
        raise ValueError("steps and step must be above zero")


def simulate(rows: DataFrame, name: str, steps: int = 21_600, step: float = 1.0, window: float = 900.0, prototypes: dict[str, Prototype] = PROTOTYPES) -> DataFrame:
    """id, prototype, stabilised_c (mean of the last ``window`` seconds), energy_wh, peak_w, in_band (samples of 28 to 32 C), max_c, left_j.

    A row with a null constant gives nulls. Runs that leave -50 to 100 C raise an error.
    """
    check(steps, step)
    p, tail = prototypes[name], int(window / step)
    num = lambda x: F.lit(float(x))
    band = lambda c: F.when(c.between(28.0, 32.0), 1).otherwise(0)
    first = F.struct(
        F.col("ambient_c").alias("c"), num(p.store).alias("store"), num(0).alias("wh"), num(0).alias("peak"), band(F.col("ambient_c")).alias("inside"), F.col("ambient_c").alias("top"),
        F.when(F.lit(steps <= tail), F.col("ambient_c")).otherwise(num(0)).alias("sum"),
    )

    def one(s: Column, k: Column) -> Column:
        c, t = s["c"], k.cast("double") * step
        net = CONTACT * (F.col("skin_c") - c) - p.passive * (c - F.col("ambient_c"))
        w = p.power(SQL, t, c)
        out = p.rejected(SQL, c, w, net, s["store"], F.col("capacity"), step)
        bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 - names a value within an expression

        def after(v: Column) -> Column:
            n = c + (net - v["q"]) * step / F.col("capacity")
            return bound(
                n,
                lambda n: F.when(n.between(-50.0, 100.0) | n.isNull(), F.struct(
                    n.alias("c"), F.greatest(num(0), s["store"] - v["q"] * step).alias("store"), (s["wh"] + v["w"] * step / 3600.0).alias("wh"), F.greatest(s["peak"], v["w"]).alias("peak"),
                    (s["inside"] + band(n)).alias("inside"), F.greatest(s["top"], n).alias("top"), F.when(k + 1 >= steps - tail, s["sum"] + n).otherwise(s["sum"]).alias("sum"),
                )).otherwise(F.raise_error(F.lit(f"{name} became unstable")).cast("struct<c:double,store:double,wh:double,peak:double,inside:int,top:double,sum:double>")),
            )

        return bound(F.struct(w.alias("w"), out.alias("q")), after)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), first, one)
    done = rows.select("id", F.lit(name).alias("prototype"), end.alias("s"))
    return done.select(
        "id", "prototype", (F.col("s.sum") / float(min(tail, steps) + 1)).alias("stabilised_c"), F.col("s.wh").alias("energy_wh"), F.col("s.peak").alias("peak_w"),
        F.col("s.inside").cast("long").alias("in_band"), F.col("s.top").alias("max_c"), F.col("s.store").alias("left_j"),
    )


def simulate_all(rows: DataFrame, **how: Any) -> DataFrame:
    out = None
    for name in how.get("prototypes", PROTOTYPES):
        one = simulate(rows, name, **how)
        out = one if out is None else out.unionByName(one)
    return out


def series(rows: DataFrame, steps: int = 21_600, step: float = 1.0, prototypes: dict[str, Prototype] = PROTOTYPES) -> DataFrame:
    """id, prototype, n, temperature_c, power_w, energy_wh of every sample. All runs of a batch take each step together; CHUNK steps are held at once."""
    check(steps, step)
    names = list(prototypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                ids, ambient, skin, capacity = (part[c].to_numpy() for c in ("id", "ambient_c", "skin_c", "capacity"))
                for name in names:
                    p = prototypes[name]
                    c, store, wh, held = ambient.astype(float), np.full(len(part), p.store), np.zeros(len(part)), []
                    for n in range(steps + 1):
                        t = n * step
                        w = np.broadcast_to(np.asarray(p.power(ARRAYS, np.float64(t), c), float), c.shape)
                        held.append((n, c, w, wh))
                        if len(held) == CHUNK or n == steps:
                            yield pd.DataFrame({
                                "id": np.tile(ids, len(held)), "prototype": name, "n": np.repeat([h[0] for h in held], len(ids)),
                                "temperature_c": np.concatenate([h[1] for h in held]), "power_w": np.concatenate([h[2] for h in held]), "energy_wh": np.concatenate([h[3] for h in held]),
                            })
                            held = []
                        net = CONTACT * (skin - c) - p.passive * (c - ambient)
                        q = p.rejected(ARRAYS, c, w, net, store, capacity, step)
                        c, store, wh = c + (net - q) * step / capacity, np.maximum(0.0, store - np.asarray(q) * step), wh + w * step / 3600.0
                        if ((c < -50) | (c > 100)).any():
                            raise ValueError(f"{name} became unstable at {t} s")

    return rows.select("id", "ambient_c", "skin_c", "capacity").mapInPandas(run, "id long, prototype string, n long, temperature_c double, power_w double, energy_wh double")


def wide(samples: DataFrame, names: list[str], step: float = 1.0) -> DataFrame:
    """One row a sample: seconds, minutes and three columns a prototype."""
    cells = [F.max(F.when(F.col("prototype") == p, F.col(c))).alias(f"{p}_{c}") for p in names for c in ("temperature_c", "power_w", "energy_wh")]
    return samples.groupBy("id", "n").agg(*cells).select("id", (F.col("n") * step).alias("seconds"), (F.col("n") * step / 60.0).alias("minutes"), *(f"{p}_{c}" for p in names for c in ("temperature_c", "power_w", "energy_wh")))
