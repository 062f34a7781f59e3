"""Materials, their aliases and the thickness grid: small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "conventional_pu_foam"
#: Shares of the low, middle and high density of any material.
PRIOR = (0.2, 0.6, 0.2)
GRID = tuple(range(5, 301, 5))
#: Densities kg/m3, conductivity W/mK, heat J/kgK, firmness, aliases.
MATERIALS = {
    "quilt_foam": ((16, 22, 30), 0.038, 1400.0, 0.20, ("quilt foam", "quiltec foam", "comfort foam", "soft pu foam", "plush foam", "euro top foam", "quilting")),
    "conventional_pu_foam": ((20, 28, 40), 0.040, 1400.0, 0.50, ("pu foam", "polyurethane foam", "support foam", "comfort foam", "flexible foam")),
    "hr_foam": ((28, 40, 60), 0.041, 1400.0, 0.72, ("hr foam", "high resilience foam", "resitec foam", "responsive foam", "reactive foam", "support pu foam")),
    "memory_foam": ((35, 55, 85), 0.040, 1450.0, 0.32, ("memory foam", "visco foam", "viscoelastic foam", "impression foam", "slow recovery foam")),
    "gel_memory_foam": ((38, 58, 90), 0.045, 1450.0, 0.34, ("gel memory foam", "cool gel foam", "gel infused foam", "thermo gel memory foam", "cooling memory foam")),
    "natural_latex": ((55, 75, 100), 0.120, 1800.0, 0.60, ("latex", "natural latex", "dunlop latex", "talalay latex", "latex foam", "rubber foam")),
    "rebonded_foam": ((65, 90, 130), 0.060, 1300.0, 0.90, ("rebonded foam", "bonded foam", "rebound foam", "recycled foam", "hard foam core")),
    "rubberised_coir": ((55, 85, 125), 0.080, 1400.0, 0.88, ("coir", "rubberised coir", "rubberized coir", "coconut coir", "coir pad", "coir sheet", "koya")),
    "polyester_fibre": ((8, 20, 45), 0.040, 1200.0, 0.15, ("polyfill", "polyester fibre", "fiber fill", "fibre fill", "comfort fibre", "hollow fibre", "batting")),
    "felt_insulator": ((70, 140, 260), 0.060, 1300.0, 0.82, ("felt", "insulator pad", "spring felt", "cotton felt", "hard felt", "needle felt")),
    "pocket_spring_unit": ((30, 55, 90), 0.055, 500.0, 0.64, ("pocket spring", "pocketed coil", "independent spring", "individual pocket spring", "zoned pocket spring")),
    "bonnell_spring_unit": ((35, 65, 105), 0.060, 500.0, 0.74, ("bonnell spring", "open coil", "interconnected spring", "innerspring", "bonnel spring")),
    "polymer_grid": ((45, 80, 140), 0.200, 1800.0, 0.56, ("polymer grid", "smart grid", "smartgrid", "hyper elastic polymer", "comfort grid", "micro grid")),
    "cover_fabric": ((80, 160, 320), 0.050, 1300.0, 0.10, ("cover fabric", "knitted fabric", "woven fabric", "ticking", "mattress cover", "quilted cover")),
}


def aliases() -> list[tuple[str, str]]:
    """(alias, material), the longest alias first, then as listed; the identifier in words is the first alias."""
    found = [(a.lower(), m) for m, spec in MATERIALS.items() for a in (m.replace("_", " "), *spec[4])]
    return sorted(found, key=lambda x: -len(x[0]))


def plain(text: str) -> str:
    return " ".join(text.lower().replace("-", " ").split())


def normalize(text: str) -> str:
    """The material of the longest alias contained, else the fallback; underscores are not blanks."""
    t = plain(text)
    return next((m for a, m in aliases() if plain(a) in t), FALLBACK)


def materials(spark: SparkSession) -> DataFrame:
    """One row per material; ``as_named`` is what its identifier normalises to."""
    rows = [(m, list(d), k, cp, f, normalize(m)) for m, (d, k, cp, f, _) in MATERIALS.items()]
    return spark.createDataFrame(rows, "material string, densities array<int>, conductivity double, heat double, firmness double, as_named string")


def material_values() -> str:
    """The same rows as SQL VALUES."""
    return ", ".join(f"('{m}', [{', '.join(map(str, d))}], CAST({k} AS DOUBLE), CAST({cp} AS DOUBLE), CAST({f} AS DOUBLE), '{normalize(m)}')" for m, (d, k, cp, f, _) in MATERIALS.items())
