"""Percentiles per group by deterministic buffer collapsing.

A sketch holds buffers of K sorted values; each value of a buffer stands for `weight` values. Two buffers of weight w
collapse into one of weight 2w: their values are merged and every second one is kept, beginning with the first or the
second in turn. A collapse moves the rank of any value by at most w, so the sum of the w of all collapses, kept in the
sketch, bounds the rank error of whatever it answers. Only buffers of equal weight are collapsed, as in a binary
counter, which keeps the error of N values at most N * log2(N / K) / (2 K).

Sketches of partitions, files or days combine to a sketch of the whole by the same rule.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from varilake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 4096
"""Values in a buffer: 10^12 values of a group are answered within 0.35 % of their ranks."""
FAN_IN = 64
"""Partial sketches that one task merges at a time."""
OUT_ROWS = 4096
CHUNK = 1 << 20
"""Rows of a task that are sorted at a time."""
HELD = 8 << 20
"""Values in the sketches of a task; beyond, they are given out as partial sketches and the task begins new ones."""
BROADCAST_GROUPS = 200_000
"""Most groups whose bounds are broadcast for the exact pass; with more, they are joined by salted shuffle."""
SALTS = 16
SLICES = 1024
"""Slices of the values between a percentile's bounds, of which one is searched value by value."""
SKETCH = "part INT, weight BIGINT, error DOUBLE, vals ARRAY<DOUBLE>"


class Sketch:
    """Buffers of one group: full ones by weight, and fewer than K single values."""

    def __init__(self, k: int = K) -> None:
        self.k, self.full, self.loose, self.error = k, defaultdict(list), [], 0.0
        self.n_loose, self.turn = 0, 0

    def held(self) -> int:
        return self.n_loose + self.k * sum(map(len, self.full.values()))

    def add(self, values: np.ndarray, weight: int = 1, error: float = 0.0) -> None:
        """Single values, or one full buffer of another sketch."""
        self.error += error
        if weight > 1 or len(values) == self.k:
            self.full[weight].append(np.sort(values))
            self._collapse(weight)
            return
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            every = np.concatenate(self.loose)
            cut = len(every) - len(every) % self.k
            self.loose, self.n_loose = [every[cut:]], len(every) - cut
            for i in range(0, cut, self.k):
                self.full[1].append(np.sort(every[i : i + self.k]))
                self._collapse(1)

    def _collapse(self, weight: int) -> None:
        while len(self.full[weight]) >= 2:
            a, b = self.full[weight].pop(), self.full[weight].pop()
            both = np.sort(np.concatenate([a, b]), kind="stable")
            self.full[2 * weight].append(both[self.turn :: 2])
            self.turn = 1 - self.turn
            self.error += weight
            weight *= 2

    def buffers(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """(weight, error, values); the error is given with the first."""
        out = [(w, b) for w, bs in self.full.items() for b in bs]
        if self.n_loose:
            out.append((1, np.concatenate(self.loose)))
        for i, (w, b) in enumerate(out):
            yield w, self.error if i == 0 else 0.0, b


def build(df: DataFrame, group: str, value: Column, k: int = K) -> DataFrame:
    """Partial sketches (group, SKETCH) of each task's rows. Null and NaN values are no values; null is a group."""
    kind, schema_type = df.schema[group].dataType.simpleString(), to_arrow_type(df.schema[group].dataType)
    rows = df.select(df[group].alias("g"), value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict = defaultdict(lambda: Sketch(k))
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> None:
            nonlocal size
            table = pa.Table.from_batches(held).combine_chunks()
            names = table["g"].combine_chunks().dictionary_encode(null_encoding="encode")
            if isinstance(names, pa.ChunkedArray):
                names = names.combine_chunks()
            codes = names.indices.to_numpy(zero_copy_only=False)
            values = table["v"].to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            keys = names.dictionary.take(pa.array(codes[starts])).to_pylist()
            for key, a, b in zip(keys, starts, [*starts[1:], len(codes)], strict=True):
                size -= (sketch := of[key]).held()
                sketch.add(values[a:b])
                size += sketch.held()
            held.clear()

        def given() -> Iterator[pa.RecordBatch]:
            rows_out = [(g, w, e, b) for g, s in of.items() for w, e, b in s.buffers()]
            for i in range(0, len(rows_out), OUT_ROWS):
                part = rows_out[i : i + OUT_ROWS]
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([r[0] for r in part], schema_type), "part": pa.array([0] * len(part), pa.int32()), "weight": pa.array([r[1] for r in part], pa.int64()), "error": pa.array([r[2] for r in part], pa.float64()), "vals": pa.array([r[3] for r in part], pa.list_(pa.float64()))}
                )
            of.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                flush()
                if size > HELD:
                    yield from given()
                    size = 0
        if held:
            flush()
        yield from given()

    out = rows.mapInArrow(sketches, f"g {kind}, {SKETCH}")
    return out.withColumn("part", F.spark_partition_id()).withColumnRenamed("g", group)


def _per_key(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """work on the rows of each key in order; its rows. Keys stream through a task one after the other, thousands a second."""
    df = df.select(*keys, *(c for c in df.columns if c not in keys))
    cols, types = df.columns, [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, {c: [] for c in cols}, []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            lists = [c.to_pylist() if c.type != pa.list_(pa.float64()) else _lists(c) for c in batch.columns]
            for i, key in enumerate(zip(*lists[:n], strict=True)):
                if key != current:
                    if rows[cols[0]]:
                        out += work(current, rows)
                    current, rows = key, {c: [] for c in cols}
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out = []
                for c, values in zip(cols, lists, strict=True):
                    rows[c].append(values[i])
        if rows[cols[0]]:
            out += work(current, rows)
        yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy())
    return np.split(flat, ends[:-1])


def merge(sketches: DataFrame, group: str, parts: int, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per group, merged in a tree: no task sees more than fan_in tasks' sketches of a group at a time."""
    kind = sketches.schema[group].dataType.simpleString()

    def merged(key: tuple, rows: dict[str, list]) -> list[tuple]:
        if len(rows["vals"]) == 1 and rows["weight"][0] == 1:
            return [(key[0], key[1], 1, rows["error"][0], rows["vals"][0])]
        s = Sketch(k)
        for w, e, v in zip(rows["weight"], rows["error"], rows["vals"], strict=True):
            s.add(v, w, e)
        return [(key[0], key[1], w, e, b) for w, e, b in s.buffers()]

    while True:
        sketches = sketches.withColumn("_to", F.floor(F.col("part") / fan_in).cast("int"))
        sketches = _per_key(sketches, [group, "_to"], ["part", "weight"], merged, f"{group} {kind}, {SKETCH}")
        parts = math.ceil(parts / fan_in)
        if parts <= 1:
            return sketches


def query(sketches: DataFrame, group: str, percents: tuple[int, ...]) -> DataFrame:
    """(group, n, error, pct, val, low, high) from merged sketches: val is within error ranks, the true value in [low, high].

    The percentile pct is the smallest value with at least pct percent of the values not above it.
    """
    kind = sketches.schema[group].dataType.simpleString()

    def answer(key: tuple, rows: dict[str, list]) -> list[tuple]:
        values = np.concatenate(rows["vals"])
        weights = np.repeat(np.asarray(rows["weight"], np.int64), [len(v) for v in rows["vals"]])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        n, error = int(upto[-1]), float(sum(rows["error"]))
        out = []
        for pct in percents:
            rank = -(-pct * n // 100)
            at = lambda r: float(values[min(np.searchsorted(upto, r, side="left"), len(values) - 1)])
            low = at(rank - error) if rank - error >= 1 else -math.inf
            high = at(rank + error) if rank + error <= n else math.inf
            out.append((key[0], n, error, pct, at(max(rank, 1)), low, high))
        return out

    return _per_key(sketches, [group], [], answer, f"{group} {kind}, n BIGINT, error DOUBLE, pct INT, val DOUBLE, low DOUBLE, high DOUBLE")


def percentiles(df: DataFrame, group: str, value: Column, percents: tuple[int, ...], k: int = K) -> DataFrame:
    """(group, n, error, pct, val, low, high) for every group of df.

    Ties and repeated rows count as often as they occur. A group without values, and an empty table, give no row.
    """
    built = build(df, group, value, k)
    return materialize(query(merge(built, group, df.rdd.getNumPartitions(), k), group, percents))


def exact(df: DataFrame, group: str, value: Column, answers: DataFrame) -> DataFrame:
    """The exact percentiles (group, pct, val), given answers of percentiles(): one more pass over df.

    Only the values between low and high are told apart, the ones below are counted, the ones above are left out, so
    that what is shuffled of a group are counts, combined on the map side, of the few values within the error bound.
    Those are counted by slices first, and only the slice that holds the percentile is searched value by value, so no
    task sees all values of a group. The bounds of up to BROADCAST_GROUPS groups are broadcast; with more, they are
    copied SALTS times and joined to rows spread over as many tasks, so that a large group is never in one.
    """
    asked = answers.groupBy(group).agg(F.array_agg(F.struct("pct", "n", "low", "high")).alias("ask")).withColumnRenamed(group, "g_")
    rows = df.select(df[group].alias("g"), value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    same = F.col("g").eqNullSafe(F.col("g_"))
    if asked.count() <= BROADCAST_GROUPS:
        both = rows.join(F.broadcast(asked), same)
    else:
        salted = asked.withColumn("s_", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
        both = rows.withColumn("s", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, same & (F.col("s") == F.col("s_")))
    each = both.select("g", "v", F.explode("ask").alias("a")).where("v <= a.high")
    within = F.when(F.col("v") >= F.col("a.low"), F.col("v"))
    width = F.col("a.high") - F.col("a.low")
    even = F.floor((F.col("v") - F.col("a.low")) / width * SLICES)
    part = F.when(within.isNull(), -1).when((width > 0) & (width < float("inf")), F.least(even, F.lit(SLICES - 1))).otherwise(0).cast("int")
    counted = materialize(each.groupBy("g", "a.pct", "a.n", part.alias("part"), within.alias("v")).agg(F.count(F.lit(1)).alias("m")))
    slices = counted.groupBy("g", "pct", "n", "part").agg(F.sum("m").alias("m"))
    # at most SLICES + 1 rows per group and percentile
    upto = F.sum("m").over(Window.partitionBy("g", "pct").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    enough = F.col("upto") * 100 >= F.col("pct") * F.col("n")
    first = slices.withColumn("upto", upto).where("part >= 0").where(enough).groupBy(F.col("g").alias("g_"), F.col("pct").alias("p_")).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("m")).alias("before")), "part").alias("x"))
    inside = counted.join(first, same & (F.col("pct") == F.col("p_")) & (F.col("part") == F.col("x.part")))
    run = F.col("x.before") + F.sum("m").over(Window.partitionBy("g", "pct").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("upto", run).where(enough)
    return reached.groupBy("g", "pct").agg(F.min("v").alias("val")).withColumnRenamed("g", group)
