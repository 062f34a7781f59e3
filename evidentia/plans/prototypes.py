"""The five cooling prototypes over the default run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prototypes
from ..registry import query

_STEPS = """
WITH RECURSIVE p(prototype, k, store) AS (VALUES ('P1', 0.35::DOUBLE, 73500::DOUBLE), ('P2', 2.8::DOUBLE, 0::DOUBLE), ('P3', 0.6::DOUBLE, 0::DOUBLE), ('P4', 2.25::DOUBLE, 0::DOUBLE), ('P5', 1.4::DOUBLE, 0::DOUBLE)),
r(prototype, k, n, c, store, wh) AS (
  SELECT prototype, k, 0, 25::DOUBLE, store, 0::DOUBLE FROM p
  UNION ALL SELECT prototype, k, n + 1, c + (net - q) / 960, greatest(0::DOUBLE, store - q), wh + w / 3600 FROM (
    SELECT *, CASE prototype WHEN 'P1' THEN greatest(0, least(15::DOUBLE, store, net + 960 * (c - 28.5::DOUBLE))) WHEN 'P3' THEN least(greatest(0, 11.25::DOUBLE * (c - 18)), 0.65::DOUBLE * w)
      WHEN 'P5' THEN least(1, greatest(0, (c - 27.8::DOUBLE) / (30::DOUBLE - 27.8::DOUBLE))) * least(greatest(0, 2.48::DOUBLE * (c - 20)), 0.35::DOUBLE * w) ELSE 0 END AS q FROM (
      SELECT *, 1.8::DOUBLE * (37 - c) - k * (c - 25) AS net, POWER AS w FROM r WHERE n < 21600) a) b)""".replace(
    "POWER",
    "(CASE prototype WHEN 'P2' THEN 5 WHEN 'P3' THEN least(60::DOUBLE, greatest(0::DOUBLE, 10.8::DOUBLE + 8 * (c - 29.5::DOUBLE)) / 0.65::DOUBLE) WHEN 'P5' THEN CASE WHEN n < 3600 THEN 40 WHEN (n - 3600) % 60 < 30 THEN 10 ELSE 0 END ELSE 0 END)::DOUBLE",
)
_POWER = _STEPS[_STEPS.index("(CASE prototype WHEN 'P2'") : _STEPS.index(" AS w FROM r")]


@query(
    "thermal_all",
    f"""{_STEPS}
SELECT prototype, round(avg(c) FILTER (n >= 20700), 6) AS stabilised_c, round(max(wh), 6) AS energy_wh, round(max({_POWER}) FILTER (n < 21600), 6) AS peak_w, count_if(c BETWEEN 28 AND 32)::BIGINT AS in_band, round(max(c), 6) AS max_c
FROM r GROUP BY prototype""",
)
def thermal_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prototypes.simulate_all(prototypes.runs(spark))
    return out.select("prototype", "in_band", *(F.round(c, 6).alias(c) for c in ("stabilised_c", "energy_wh", "peak_w", "max_c")))


_CELLS = [(p, c) for p in prototypes.PROTOTYPES for c in ("temperature_c", "power_w", "energy_wh")]
_OF = {"temperature_c": "c", "power_w": _POWER, "energy_wh": "wh"}


@query(
    "thermal_series",
    f"{_STEPS} SELECT n::DOUBLE AS seconds, round(n / 60::DOUBLE, 6) AS minutes, "
    + ", ".join(f"round(max({_OF[c]}) FILTER (prototype = '{p}'), 6) AS {p}_{c}" for p, c in _CELLS)
    + " FROM r GROUP BY n",
)
def thermal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the reference writes as CSV: every sample of every prototype, one row a second."""
    out = prototypes.wide(prototypes.series(prototypes.runs(spark)), list(prototypes.PROTOTYPES))
    return out.select("seconds", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("id", "seconds")))
