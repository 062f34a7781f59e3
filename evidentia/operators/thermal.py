"""Lumped thermal screening and prototypes with constant paths: linear recurrences in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMBIENT, SKIN, AREA, CONTACT = 25.0, 37.0, 0.18, 1.8


def screen(candidates: DataFrame, seconds: int = 21_600, step: float = 5.0) -> DataFrame:
    """product_id, place, resistance, heat_capacity, final_c (mean of the last 900 s), comfort_minutes (28 to 32 C), peak_c.

    T[n+1] = T[n] + (in - out) * step / C is linear, so T[n] = T* + (T0 - T*) a^n; window sums of a geometric series
    and the samples of a rising path between two bounds need no loop.
    """
    zipped = F.arrays_zip("stack", "taken", "picked")
    total = lambda f: F.aggregate(zipped, F.lit(0.0), lambda a, x: a + f(x))
    return screened(candidates.select("product_id", "place", total(lambda x: x["taken"] / 1000.0 / x["stack"]["conductivity"]).alias("resistance"), total(lambda x: x["taken"] / 1000.0 * x["picked"] * x["stack"]["heat"]).alias("heat_capacity")), seconds, step)


def screened(rows: DataFrame, seconds: int = 21_600, step: float = 5.0) -> DataFrame:
    """``screen`` of rows product_id, place, resistance, heat_capacity."""
    c = F.greatest(F.lit(100.0), F.col("heat_capacity") * AREA)
    room = F.lit(AREA) / F.greatest(F.col("resistance"), F.lit(1e-9))
    n, window = round(seconds / step), round(900 / step) + 1
    rows = rows.withColumns({"end": (CONTACT * SKIN + room * AMBIENT) / (CONTACT + room), "a": 1.0 - (CONTACT + room) * step / c})
    gap = F.lit(AMBIENT) - F.col("end")
    first = n - window + 1
    mean = F.col("end") + gap * F.pow("a", F.lit(first)) * (1.0 - F.pow("a", F.lit(window))) / (1.0 - F.col("a")) / window
    at = lambda k: F.col("end") + gap * F.pow("a", k)

    def below(x: float, also_equal: bool) -> Column:
        """Samples under x (or at it) of a rising path: by logarithm, and exact as its neighbours are looked at."""
        holds = (lambda k: at(k) <= x) if also_equal else (lambda k: at(k) < x)
        guess = F.ceil(F.log((x - F.col("end")) / gap) / F.log("a")).cast("long")
        k = F.greatest(F.lit(0), F.least(F.lit(n + 1), guess))
        k = k + F.when((k <= n) & holds(k), 1).when((k > 0) & ~holds(k - 1), -1).otherwise(0)
        return F.when(F.col("end") < x, n + 1).otherwise(k)

    stepped = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0), lambda s, k: s + F.when(at(k).between(28.0, 32.0), 1).otherwise(0))
    # a factor below 0 (next to no resistance) swings: only then samples are counted one by one
    inside = F.when((F.col("a") > 0) & (F.col("end") > AMBIENT), below(32.0, True) - below(28.0, False)).otherwise(stepped)
    return rows.select("product_id", "place", "resistance", "heat_capacity", mean.alias("final_c"), (inside * step / 60.0).alias("comfort_minutes"), F.greatest(F.lit(AMBIENT), at(F.lit(n))).alias("peak_c"))


def constant_path(conductance: Column, ambient: float = AMBIENT, body: float = CONTACT, skin: float = SKIN, capacity: float = 960.0, steps: int = 21_600) -> Column:
    """Mean temperature of the last 901 samples of a prototype that rejects heat by one conductance alone, from ambient on."""
    end = (F.lit(body * skin) + conductance * ambient) / (F.lit(body) + conductance)
    a = 1.0 - (F.lit(body) + conductance) / capacity
    return end + (F.lit(ambient) - end) * F.pow(a, F.lit(steps - 900)) * (1.0 - F.pow(a, F.lit(901))) / (1.0 - a) / 901.0
