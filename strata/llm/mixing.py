"""Mixing sources to target weights by Pfair scheduling (operator 6).

A source's rows, in key order, form blocks of ``block_rows``.  With integer
weights a_s of sum A, the j-th block of source s is released at slot
floor(j A / a_s) and due by slot ceil((j + 1) A / a_s); one block runs per
slot, earliest deadline first among the released ones.  Every block meets its
window, so at any slot a source is less than one block from its share.  The
schedule repeats every A slots, hence only one period is worked out (on the
driver, A is a parameter's size) and each block's slot is arithmetic.  When a
source runs out, a new phase starts with the weights of the others.  Nothing
is dropped or repeated: the result is an order of all rows.

Defined results: a NULL source is a source of its own; equal keys share
neighbouring places in no defined order; NULL keys come first in their source;
an empty table gives no rows; extra columns are kept (``mix``).  A source
without a given weight has ``default_weight``; weights are rounded to
multiples of 1 / ``period``, one at least.  One row per source reaches the
driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import fresh, numbered

BLOCK_ROWS = 32
PERIOD = 4096
#: Rows in a bucket of whole texts, at least, and such buckets at most.
WIDE_ROWS, WIDE_BUCKETS = 5_000, 4_096


def edf(shares: dict) -> dict:
    """{source: slot of each of its blocks} in one period of sum(shares) slots, earliest deadline first."""
    total = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    coming = [((0, -(-total // shares[s]), k), 0) for k, s in enumerate(names)]  # (release, deadline, source), block
    heapq.heapify(coming)
    ready: list = []
    out = {s: [] for s in names}
    for slot in range(total):
        while coming and coming[0][0][0] <= slot:
            (_, due, k), j = heapq.heappop(coming)
            heapq.heappush(ready, (due, k, j))
        due, k, j = heapq.heappop(ready)
        if slot >= due:
            raise ValueError("a block missed its deadline")
        s = names[k]
        out[s].append(slot)
        j += 1
        if j < shares[s]:
            heapq.heappush(coming, ((j * total // shares[s], -(-(j + 1) * total // shares[s]), k), j))
    return out


def shares_of(weights: dict, period: int) -> dict:
    """Weights as integers, in units of 1 / ``period`` of their sum."""
    total = sum(weights.values())
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    return {s: max(1, round(w / total * period)) for s, w in weights.items()}


@dataclass
class Phase:
    """Blocks first..first+used-1 of a source: slot = base + period * (j div share) + slots[j mod share]."""

    first: int
    used: int
    share: int
    period: int
    base: int
    slots: list


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> dict:
    """{source: [Phase]} until every source's blocks are placed."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out: dict = {s: [] for s in left}
    base = 0
    while left:
        share = shares_of({s: weights[s] for s in left}, period)
        total = sum(share.values())
        slots = edf(share)
        # the phase ends with the first source that runs out
        end = min(total * ((n - 1) // share[s]) + slots[s][(n - 1) % share[s]] + 1 for s, n in left.items())
        for s in list(left):
            used = share[s] * (end // total) + sum(x < end % total for x in slots[s])
            if used:
                out[s].append(Phase(done[s], used, share[s], total, base, slots[s]))
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        base += end
    return out


_PHASES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("first", "used", "share", "period", "base")]
                                   + [T.StructField("slots", T.ArrayType(T.LongType()))]))


def places(df: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id",
           block_rows: int = BLOCK_ROWS, period: int = PERIOD, default_weight: float = 1.0, wide: bool = False,
           names: tuple[str, str, str] = ("block", "slot", "position")) -> DataFrame:
    """``df`` with each row's block (within its source), slot and position in the mixture.

    ``wide`` rows (whole texts) are numbered in smaller buckets.
    """
    block, slot, position = names
    num, src, table, late, ph = fresh(df, "num", "src", "table", "late", "ph")
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    w = {s: float((weights or {}).get(s, default_weight)) for s in counts}
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, w, period)

    def slot_of(s, j):
        p = next(p for p in plan[s] if p.first <= j < p.first + p.used)
        return p.base + p.period * ((j - p.first) // p.share) + p.slots[(j - p.first) % p.share]

    # the last block of a source may be short: later positions move up by what it lacks
    short = sorted((slot_of(s, n // block_rows), block_rows - n % block_rows) for s, n in counts.items() if n % block_rows)
    rows = [(s, [(p.first, p.used, p.share, p.period, p.base, p.slots) for p in ps],
             [(a, b) for a, b in short]) for s, ps in plan.items()]
    lacks = T.ArrayType(T.StructType([T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())]))
    sched = df.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField(src, df.schema[source].dataType), T.StructField(table, _PHASES), T.StructField(late, lacks)]))
    n = sum(counts.values())
    out = numbered(df, [key], num, by=source, hint=n, bucket_rows=max(WIDE_ROWS, n // WIDE_BUCKETS) if wide else None)
    # one row per source and at most ``period`` slots a phase: a bound that rows do not move
    out = out.join(F.broadcast(sched), F.col(source).eqNullSafe(F.col(src)))
    out = out.withColumn(block, F.floor(F.col(num) / block_rows).cast("long"))
    out = out.withColumn(ph, F.element_at(F.filter(table, lambda p: (p["first"] <= F.col(block)) & (F.col(block) < p["first"] + p["used"])), 1))
    j = F.col(block) - F.col(f"{ph}.first")
    out = out.withColumn(slot, F.col(f"{ph}.base") + F.col(f"{ph}.period") * F.floor(j / F.col(f"{ph}.share"))
                         + F.element_at(F.col(f"{ph}.slots"), (j % F.col(f"{ph}.share") + 1).cast("int")))
    missing = F.aggregate(F.filter(late, lambda x: x["slot"] < F.col(slot)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = out.withColumn(position, (F.col(slot) * block_rows + F.col(num) % block_rows - missing).cast("long"))
    return out.select(*df.columns, block, slot, position)


def mix(docs: DataFrame, weights: dict | None = None, **options) -> DataFrame:
    """All rows and columns of ``docs`` in mixture order: range-partitioned and sorted by position."""
    names = tuple(fresh(docs, "block", "slot", "position"))
    out = places(docs, weights, names=names, wide=True, **options)
    return out.repartitionByRange(names[2]).sortWithinPartitions(names[2]).select(*docs.columns)
