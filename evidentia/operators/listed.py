"""The candidates of ``configure.wide`` as narrow rows: a product's combinations are weighed at once, as whole numbers, in tasks that Spark deals by product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import parts
from .configure import in_rows

#: Candidates of a batch that a task hands on, at least.
_BATCH = 8192
_STACKS = {"taken": "array<int>", "picked": "array<int>"}
_THERMAL = {"resistance": "double", "heat_capacity": "double"}


def _sums(weights: list[np.ndarray], n: int) -> np.ndarray:
    """The sums of the first ``n`` choices of one weight a layer, the last layer's changing fastest."""
    found = np.zeros(1, dtype=np.int64)
    for w in reversed(weights):
        if len(found) >= n:
            found = found + w[0]
        else:
            found = (w[:, None] + found[None, :]).ravel()[:n]
    return found[:n]


def _found(wanted: int, most_enumerated: int, thermal: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_solution(r: dict, options: list[np.ndarray], kinds: int, s: dict, room: int) -> tuple | None:
        """The solution's first ``room`` survivors: their numbers, masses, and either the densities or the heat capacities."""
        before = (s["solution"] - 1) * kinds
        n, taken, area, weight = min(kinds, most_enumerated - before), s["taken"], r["area"], r["weight_kg"]
        if n <= 0:
            return None
        at = np.arange(min(n, room)) if area is None or weight is None else None
        kg = None if area is None else area * (_sums([t * d for t, d in zip(taken, options, strict=True)], n if at is None else len(at)) / 1000.0)
        if at is None:
            at = np.flatnonzero(np.abs(kg - weight) <= max(2.0, weight * 0.25))[:room]
            kg = kg[at]
        picked, radix = np.empty((len(at), len(options)), dtype=np.int32), 1
        for i in range(len(options) - 1, -1, -1):
            size = len(options[i])
            picked[:, i] = options[i][0] if size == 1 or radix >= n else options[i][at // radix % size]
            radix *= size
        return before + at + 1, kg, picked

    def rows(r: dict) -> Iterator[tuple]:
        """Of each solution with survivors: what its rows hold, as arrays."""
        ends = np.cumsum([0, *r["sizes"]])
        options = [np.array(r["density"][a:b], dtype=np.int64) for a, b in zip(ends, ends[1:], strict=False)]
        kinds, done = 1, 0
        for o in options:
            kinds *= len(o)
        for s in r["solved"] if kinds else []:
            got = of_solution(r, options, kinds, s, wanted - done)
            if got is None or done >= wanted:
                return
            numbers, kg, picked = got
            n = len(numbers)
            if n:
                kg = np.full(n, np.nan) if kg is None else kg
                shared = (np.full(n, s["solution"], np.int32), numbers.astype(np.int32), np.arange(done + 1, done + n + 1, dtype=np.int32), kg, r["area"] is None)
                taken = np.array(s["taken"], dtype=np.int32)
                if thermal:
                    # in the order of layers
                    resistance, heat = 0.0, np.zeros(n)
                    for i, (t, c, h) in enumerate(zip(s["taken"], r["conductivity"], r["heat"], strict=True)):
                        resistance += t / 1000.0 / c
                        heat += t / 1000.0 * picked[:, i] * h
                    yield *shared, np.full(n, resistance), heat
                else:
                    yield *shared, np.broadcast_to(taken, picked.shape), picked
            done += n

    def lists(blocks: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(x for b in blocks for x in np.full(len(b), b.shape[1]))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([b.ravel() for b in blocks])))

    def batch_of(ids: list, found: list[tuple]) -> pa.RecordBatch:
        own = pa.array(ids, schema.field(0).type).take(pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found])))
        solution, numbers, place, kg = (np.concatenate([x[i] for x in found]) for i in range(4))
        weighed = pa.array(kg, mask=np.repeat([x[4] for x in found], [len(x[0]) for x in found]))
        last = (lambda i: pa.array(np.concatenate([x[i] for x in found]))) if thermal else (lambda i: lists([x[i] for x in found]))
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([own, pa.array(solution), pa.array(numbers), pa.array(place), weighed, last(5), last(6)], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, n = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for x in rows(r):
                    ids.append(r["product_id"])
                    found.append(x)
                    n += len(x[0])
                if n >= _BATCH:
                    yield batch_of(ids, found)
                    ids, found, n = [], [], 0
        if found:
            yield batch_of(ids, found)

    return run


def listed(plan: DataFrame, most: int = 50, most_enumerated: int = 50_000, thermal: bool = False) -> DataFrame:
    """The candidates of ``configure.explored``: product_id, solution, enumerated, place, estimated_kg, and taken and picked, or what ``thermal.screened`` needs of them: resistance, heat_capacity."""
    wanted = 20 * most
    of_stack = [F.col(f"stack.{c}").alias(c) for c in ("conductivity", "heat")] if thermal else []
    density = F.flatten(F.transform("options", lambda o: F.transform(o, lambda x: x["density"])))
    rows = in_rows(plan, max(500, wanted)).select("product_id", "area", "weight_kg", F.transform("options", F.size).alias("sizes"), density.alias("density"), "solved", *of_stack)
    # few bytes become many candidates: dealt by number
    rows = rows.repartition(parts(plan.sparkSession), "product_id")
    fields = {"solution": "int", "enumerated": "int", "place": "int", "estimated_kg": "double", **(_THERMAL if thermal else _STACKS)}
    made = f"product_id {plan.schema['product_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in fields.items())
    schema = plan.sparkSession.createDataFrame([], made).toArrow().schema
    return rows.mapInArrow(_found(wanted, most_enumerated, thermal, schema), made)
