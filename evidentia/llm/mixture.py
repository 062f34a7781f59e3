"""Mixing sources to target weights by entropy balancing.

For every source s the mix wants T_s words. Among all document rates r in [0, CAP] with sum(r * size) = T_s
the method takes those closest to 1 in relative entropy, which are exponentially tilted and cut off at CAP:
r = min(CAP, exp(lambda_s * size / mean size of s)). lambda_s solves the convex dual, a monotone equation,
by Newton steps kept inside a shrinking bracket; one step for all sources is one aggregation of the histogram
(source, size, documents), so an iteration never reads a document, and a source with a third of all rows is
a third of the histogram at most. Sums are exact decimals, so they do not depend on how rows are dealt and
reruns agree.

Rates become copies by systematic rounding: in the order (source, class of size, salt, hash of identifier)
copies are the steps of the rounded-down running sum of rates, the largest documents first. A bucket of that order holds one class of
sizes and one salt of a source; running sums start from the sums of the buckets before it, so no task has
a whole source. As neighbours are alike in size, the words taken differ from T_s by little more than a
document's size; what is left is repaired: of each class of sizes one document that was rounded down may take one copy
more and one that was rounded up one less, and in the order of falling size those are moved that bring the source nearer
to T_s (and once more with each of the ``STARTS`` largest moved whatever it does alone; the nearest outcome counts). A source has some 500 classes at most, so the repair of a source is a short fold, however many documents it has.

Targets: weights share the total of all sizes; no source gets more than CAP times its size, the excess being
shared by weight among the others until none is above.

Defined results: null text has size 0 and is taken 0 times over; the null source comes last and has a weight
like any other; empty tables give no rows; repeated rows count each time and share a rounding; sources
without words have target 0; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import BROADCAST_ROWS, only, stored

CAP = 3
WEIGHTS = (5.0, 2.0, 1.0)
SALTS = 32
#: Rates are multiples of 2^-20, sums of words of 10^-6.
UNIT = 1 << 20
STEPS = 60
NEAR = 1e-7
#: Repairs that are tried as the first of a fold.
STARTS = 16


def size_of(text: F.Column) -> F.Column:
    """Number of runs of characters other than the six ASCII spaces."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    blank = lambda at: F.when(F.element_at(parts, at) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, docs, source_size, target from rows of (source, size, docs). One row per source: ordered as a whole."""
    per = sizes.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w)
    # by how soon a rising level of words per weight reaches the cap; before a source reaches it, all before it have
    full = (F.lit(cap) * F.col("source_size")).cast("double")
    by = Window.orderBy(F.col("reach"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("reach", full / F.col("weight")).withColumns(
        {
            "capped": F.coalesce(F.sum(full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(everything),
        }
    )
    level = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "source", "level"))).over(everything)
    return level.withColumn("water", first["level"]).select(
        "source", "docs", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(full, F.col("weight") * F.coalesce("water", F.col("level")))).alias("target")
    )


def _near(big: DataFrame, small: DataFrame, rows: int, on: str = "source") -> DataFrame:
    """``small`` (one row per source) joined to ``big``: sent whole if it has few rows, else dealt with SALTS copies, so that no source is one task's."""
    if rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
        return big.join(small.withColumnRenamed(on, "__on"), F.col(on).eqNullSafe(F.col("__on"))).drop("__on")
    spread = small.withColumnRenamed(on, "__on").withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(on).eqNullSafe(F.col("__on")) & (salted["__salt"] == spread["__salt"])).drop("__on", "__salt")


def tilts(hist: DataFrame, targets: DataFrame, sources: int, cap: int = CAP) -> DataFrame:
    """source, source_size, target and tilt: the multiplier of size in each source's exponent."""
    size, mean = F.col("size").cast("double"), F.col("source_size") / F.col("docs")
    log_cap = math.log(cap)
    state = targets.withColumns(
        {
            "mean": F.greatest(mean, F.lit(1e-9)),
            "tilt": F.lit(0.0),
        }
    )
    # at the upper end every document is at the cap, at the lower end none is above target / source_size
    state = state.withColumns(
        {
            "high": F.col("mean") * log_cap,
            "low": -F.col("mean") * F.greatest(F.lit(0.0), F.log(F.col("source_size") / F.col("target"))),
            "at_cap": F.col("target") >= F.col("source_size") * cap,
        }
    )
    state = state.select("source", "source_size", "target", "mean", "low", "high", F.when(F.col("at_cap"), F.col("high")).otherwise(F.col("tilt")).alias("tilt"), (F.col("at_cap") | (F.col("source_size") == 0)).alias("done"))
    state = stored(state.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("low", "high", "tilt")}))
    for _ in range(STEPS):
        rows = _near(hist, state.where("not done"), sources)
        x = size / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(log_cap)))
        words, slope = rate * size * F.col("n"), F.when(F.col("tilt") * x < log_cap, rate * size * x * F.col("n")).otherwise(0.0)
        exact = lambda c: F.sum(F.round(c * 1e6).cast("decimal(30,0)")).cast("double") / 1e6
        sums = rows.groupBy("source").agg(exact(words).alias("words"), exact(slope).alias("slope"))
        step = _near(sums, state, sources)
        over = F.col("words") - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over / F.when(F.col("slope") > 0, F.col("slope"))
        done = F.abs(over) <= F.greatest(F.lit(0.01), F.col("target") * NEAR)
        moved = step.select(
            "source", "source_size", "target", "mean", low.alias("low"), high.alias("high"),
            F.when(done, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2).alias("tilt"), done.alias("done"),
        )
        state = stored(moved.unionByName(state.where("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", (F.col("tilt") / F.col("mean")).alias("tilt"))


def repairs(placed: DataFrame, cap: int = CAP) -> DataFrame:
    """m_source, m_upto and move (1 or -1) of the documents whose rounding is reversed so that their source comes nearer to its target.

    placed: source, size, target, kind, units, copies, upto; (source, upto) is one document among those with units.
    """
    left = placed.groupBy(F.col("source").alias("r_source")).agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    short = F.col("copies") * UNIT - F.col("units")
    move = F.when((short < 0) & (F.col("copies") < cap), 1).when((short > 0) & (F.col("copies") > 0), -1)
    able = placed.where("size > 0 and units > 0").withColumn("move", move).where("move is not null")
    each = able.groupBy("source", "kind", "move").agg(F.max(F.struct("size", "upto")).alias("at"))
    lists = each.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("at.size").alias("size"), F.col("at.upto").alias("upto"), "move")), asc=False).alias("moves"))
    begin = F.struct("left", F.slice("moves", 1, 0).alias("done"))

    def next_of(state: F.Column, x: F.Column) -> F.Column:
        then = state["left"] - x["size"] * x["move"]
        nearer = F.abs(then) < F.abs(state["left"])
        return F.struct(F.when(nearer, then).otherwise(state["left"]).alias("left"), F.when(nearer, F.concat(state["done"], F.array(x))).otherwise(state["done"]).alias("done"))

    # one of the first moves may also be made whether it helps by itself or not: the best of these outcomes is taken
    def forced(k: F.Column) -> F.Column:
        m = F.element_at("moves", k)
        rest = F.filter("moves", lambda x, i: i + 1 != k)
        return F.aggregate(rest, F.struct((F.col("left") - m["size"] * m["move"]).alias("left"), F.slice("moves", k, 1).alias("done")), next_of)

    tries = F.concat(F.array(F.aggregate("moves", begin, next_of)), F.transform(F.sequence(F.lit(1), F.least(F.lit(STARTS), F.size("moves"))), forced))
    best = F.array_min(F.transform(tries, lambda t: F.struct(F.abs(t["left"]).alias("off"), t["done"].alias("done"))))
    folded = lists.join(left, F.col("source").eqNullSafe(F.col("r_source"))).select("source", best["done"].alias("done"))
    return folded.select(F.col("source").alias("m_source"), F.explode("done").alias("m")).select("m_source", F.col("m.upto").alias("m_upto"), F.col("m.move").alias("move"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row."""
    rows = stored(only(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", size_of(F.col("text")).alias("size")))
    hist = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = stored(source_targets(hist.withColumnRenamed("n", "docs"), weights, cap))
    sources = targets.count()
    tilt = tilts(hist, targets, sources, cap)
    # a rate below the cap is below it in whole units too
    exponent = F.col("tilt") * F.col("size")
    unit = F.floor(F.when(exponent >= math.log(cap) * (1 - 1e-12), F.lit(float(cap))).otherwise(F.exp(exponent)) * UNIT).cast("long")
    rated = _near(rows, tilt, sources).withColumns({"units": F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(unit), "kind": (-F.floor(F.log2(F.col("size") + 1.0) * 8)).cast("int"), "hash": F.xxhash64("doc_id", "size")})
    rated = rated.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    buckets = rated.groupBy("source", "kind", "salt").agg(F.sum("units").alias("sum"))
    order = Window.partitionBy("source").orderBy("kind", "salt").rowsBetween(Window.unboundedPreceding, -1)
    # a source has at most 8 * 64 classes of size and SALTS salts
    starts = buckets.withColumn("start", F.coalesce(F.sum("sum").over(order), F.lit(0))).drop("sum")
    renamed = starts.select(F.col("source").alias("s_source"), F.col("kind").alias("s_kind"), F.col("salt").alias("s_salt"), "start")
    placed = rated.join(renamed, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("kind") == F.col("s_kind")) & (F.col("salt") == F.col("s_salt")))
    within = Window.partitionBy("source", "kind", "salt").orderBy(F.desc("size"), "hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("start") + F.sum("units").over(within)
    # half a unit of rounding: the first copy falls where the sum passes one half
    half = UNIT // 2
    copies = F.floor((F.col("upto") + half) / UNIT) - F.floor((F.col("upto") - F.col("units") + half) / UNIT)
    placed = placed.withColumn("upto", upto).withColumn("copies", copies.cast("long"))
    placed = stored(placed.select("doc_id", "source", "size", "source_size", "target", "kind", "units", "copies", "upto"))
    moves = stored(repairs(placed, cap))
    moves = F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves
    mended = placed.join(moves, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("upto") == F.col("m_upto")) & (F.col("units") > 0), "left")
    done = mended.withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0)))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("units") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
