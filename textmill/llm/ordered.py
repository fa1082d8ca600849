"""Numbers and running sums over rows in order, for keys of any size.

Rows are dealt out by ranges of (key, order), so a key with many rows lies in several tasks, in a row. Each task scans what it
has; then what each key has in the tasks before is added, from a line for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import powers
from .shared import saved

MOD = 1 << 64


def _scan(batches, key: str, sums: list[str], polys: dict[str, int]):
    from pyspark import TaskContext

    part, first, last, n0, index = TaskContext.get().partitionId(), None, None, 0, 0
    before = {c: 0 for c in [*sums, *polys]}
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        k, at = b.column(key).to_numpy(), np.arange(m)
        first = k[0] if first is None else first
        starts = np.ones(m, bool)
        starts[1:] = k[1:] != k[:-1]
        begin = np.maximum.accumulate(np.where(starts, at, 0))
        n = at - begin + 1
        goes_on = begin == 0 if last is not None and k[0] == last else np.zeros(m, bool)
        out = {}
        for c in before:
            v = b.column(c).to_numpy().astype(np.int64).view(np.uint64)
            if c in polys:
                v = v * powers(polys[c], m + 1)[n]
            total = np.cumsum(v)
            run = total - (total[begin] - v[begin])
            shift = np.uint64(pow(polys[c], n0, MOD)) if c in polys else np.uint64(1)
            out[c] = np.where(goes_on, np.uint64(before[c]) + shift * run, run)
        n = n + np.where(goes_on, n0, 0)
        columns = [pa.array(np.full(m, part)), pa.array(index + at), pa.array(k == first), pa.array(n), *(pa.array(x.view(np.int64)) for x in out.values())]
        yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "part", "index", "of_first", "n", *(f"{c}_to" for c in out)])
        last, n0, index, before = k[-1], int(n[-1]), index + m, {c: int(x[-1]) for c, x in out.items()}


def running(rows: DataFrame, key: str, dealt: list[Column], order: list[Column], sums: tuple[str, ...] = (), polys: dict[str, int] | None = None, name: str = "running") -> DataFrame:
    """rows with n, the place among those of their key, from 1, and for each c of sums and polys c_to, over the rows of the key up to it: the sum,
    or the sum of c * base^n modulo 2^64. part and of_first (of the part's first key) come with them.

    key: a column of longs that aren't null; sums, polys: columns of longs. dealt: the columns by which rows are dealt out, a prefix of order or coarser.
    """
    polys = polys or {}
    values = [*sums, *polys]
    names = ["n", *(f"{c}_to" for c in values)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "part long, index long, of_first boolean", *(f"`{c}` long" for c in names)])
    scanned = saved(rows.repartitionByRange(*dealt).sortWithinPartitions(*order).mapInArrow(lambda b: _scan(b, key, list(sums), polys), schema), name)
    ends = scanned.groupBy("part").agg(F.max_by(F.struct(F.col(key).alias("key"), "of_first", *names), "index").alias("z"), F.min_by(key, "index").alias("first"))
    carried, total, last = {}, None, None
    for r in sorted(ends.collect(), key=lambda r: r.part):  # a row for each task
        here = [r.z[c] for c in names]
        if total is not None and r.first == last:
            carried[r.part] = total
            if r.z.of_first:
                scale = [1, *(1 for _ in sums), *(pow(b, total[0], MOD) for b in polys.values())]
                here = [t + s * x for t, s, x in zip(total, scale, here, strict=True)]
        total, last = [here[0], *((x + MOD // 2) % MOD - MOD // 2 for x in here[1:])], r.z.key
    if not carried:
        return scanned.drop("index")

    def add(batches):
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            part, mine = b.column("part").to_numpy(), b.column("of_first").to_numpy(zero_copy_only=False)
            for p in np.unique(part[mine]).tolist():
                if p not in carried:
                    continue
                at, (n0, *before) = mine & (part == p), carried[p]
                for c, t, base in zip(values, before, [1] * len(sums) + list(polys.values()), strict=True):
                    x = columns[f"{c}_to"].to_numpy().view(np.uint64)
                    columns[f"{c}_to"] = pa.array(np.where(at, np.uint64(t % MOD) + np.uint64(pow(base, n0, MOD)) * x, x).view(np.int64))
                columns["n"] = pa.array(columns["n"].to_numpy() + np.where(at, n0, 0))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scanned.mapInArrow(add, scanned.schema).drop("index")
