"""Merging overlapping integer ranges into periods, and listing the gaps, through dyadic blocks.

The row axis is cut into aligned segments of ``2**bits`` rows and each range at the segment borders, so
that a hot key is spread over its segments. Inside a segment a range is decomposed into canonical dyadic
blocks; blocks inside a larger block are removed, sibling pairs are merged upwards, and adjacent blocks
are joined to runs. Runs that don't lie at the border of their segment are final. Of the others there
are at most two per segment, and a window over these joins them across segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A segment has at least 2**MIN_BITS rows; an axis is cut into at most 2**PIECE_BITS segments.
MIN_BITS, PIECE_BITS = 20, 12


def dyadic_runs(key: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray,
                bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (key, start, end, count) of ranges with ascending dense keys and 0 <= start < end <= 2**bits."""
    lo, hi, left = start.copy(), end.copy(), count.copy()
    parts, row, level = [], np.arange(len(key)), 0
    while len(row):  # canonical decomposition: at most two blocks of each size
        for odd_end in (False, True):
            m = (lo < hi) & ((hi if odd_end else lo) & 1 == 1)
            at = (hi - 1 if odd_end else lo)[m]
            parts.append((key[row[m]], at << level, np.full(at.shape, level), left[row[m]]))
            left[row[m]] = 0
            if odd_end:
                hi = hi - m
            else:
                lo = lo + m
        lo, hi = lo >> 1, hi >> 1
        more = lo < hi
        lo, hi, row, level = lo[more], hi[more], row[more], level + 1
    k, s, lev, c = (np.concatenate(x) for x in zip(*parts))
    # Blocks are nested or disjoint: after sorting by start, larger first, one is covered iff an earlier one ends later.
    pos = (k << bits) | s
    order = np.lexsort((-lev, pos))
    k, pos, lev, c = k[order], pos[order], lev[order], c[order]
    stop = pos + (np.int64(1) << lev)
    kept = np.ones(len(pos), bool)
    kept[1:] = np.maximum.accumulate(stop)[:-1] <= pos[1:]
    c = np.add.reduceat(c, np.flatnonzero(kept))
    k, pos, lev = k[kept], pos[kept], lev[kept]
    for at in range(bits):  # siblings merge upwards
        pair = np.zeros(len(pos), bool)
        pair[:-1] = (lev[:-1] == at) & (lev[1:] == at) & ((pos[:-1] >> at) & 1 == 0) & (pos[1:] - pos[:-1] == 1 << at)
        if pair.any():
            lev = lev + pair
            c[:-1] += np.where(pair[:-1], c[1:], 0)
            keep = np.ones(len(pos), bool)
            keep[1:] = ~pair[:-1]
            k, pos, lev, c = k[keep], pos[keep], lev[keep], c[keep]
    stop = pos + (np.int64(1) << lev)
    first = np.ones(len(pos), bool)
    first[1:] = (stop[:-1] != pos[1:]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(pos)) - 1
    base = k[at] << bits
    return k[at], pos[at] - base, stop[ends] - base, np.add.reduceat(c, at)


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before it."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for n in names:
        a = batch.column(n)
        a = a.dictionary_encode().indices if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else a
        v = a.to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out


def _runs_of_sorted(keys: list[str], bits: int):
    """mapInArrow over rows sorted by keys and segment. What a batch leaves of its last key goes to the
    next batch as runs, so a key of any number of rows takes bounded memory."""
    names = [*keys, "seg"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> pa.RecordBatch | None:
            if not t.num_rows:
                return None
            f = np.ones(t.num_rows, bool)
            k, e = (t.column(x).to_numpy() for x in ("_k", "row1"))
            f[1:] = k[1:] != k[:-1]
            prev = pa.array(np.append(0, e[:-1]), pa.int64(), mask=f)
            # First and last runs may go on in the next segment; all between them are final.
            edge = f | np.append(f[1:], True)
            out = t.drop_columns(["_k"]).append_column("prev_end", prev).append_column("edge", pa.array(edge))
            return out.combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held.select(t.column_names), t], promote_options="permissive")
            b = t.combine_chunks().to_batches()[0]
            k = np.cumsum(_changes(b, names)) - 1
            base = b.column("seg").to_numpy() << bits
            rk, s, e, n = dyadic_runs(k, b.column("row0").to_numpy() - base, b.column("row1").to_numpy() - base,
                                      b.column("n").to_numpy(), bits)
            at = np.searchsorted(k, rk)
            whole = pa.Table.from_batches([b]).select(names).take(pa.array(at))
            whole = (whole.append_column("row0", pa.array(s + base[at])).append_column("row1", pa.array(e + base[at]))
                     .append_column("n", pa.array(n)).append_column("_k", pa.array(rk)))
            done = int(np.searchsorted(rk, k[-1]))
            held = whole.slice(done)
            if (out := emit(whole.slice(0, done))) is not None:
                yield out
        if held is not None and (out := emit(held)) is not None:
            yield out

    return runs


def segment_bits(ranges: DataFrame, start: str, end: str) -> int:
    """Size of a segment: large enough that the widest range is cut into at most 2**PIECE_BITS pieces."""
    lo, hi = ranges.agg(F.min(start), F.max(end)).first()
    return max(MIN_BITS, int((hi or 0) - (lo or 0)).bit_length() - PIECE_BITS)


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "row0", end: str = "row1") -> DataFrame:
    """Periods (maximal unions of overlapping or touching half-open ranges) and the gaps between them.

    Columns: keys, ``kind`` ('period' or 'gap'), ``row0``, ``row1``, ``n`` (ranges in the period, 0 for a
    gap). Ranges that are null, empty or reversed, and rows with a null key, are left out; repeated
    ranges count each time. An empty table gives no rows. Axis and range lengths must be below 2**50.
    """
    r = df.select(*keys, F.col(start).cast("long").alias("row0"), F.col(end).cast("long").alias("row1")).where(
        F.col("row1") > F.col("row0"))
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    bits = segment_bits(r, "row0", "row1")
    size = 1 << bits
    pieces = (
        r.withColumn("seg", F.explode(F.sequence(F.shiftright("row0", bits), F.shiftright(F.col("row1") - 1, bits))))
        .select(*keys, "seg", F.greatest("row0", F.col("seg") * size).alias("p0"),
                F.least("row1", (F.col("seg") + 1) * size).alias("p1"),
                (F.shiftright("row0", bits) == F.col("seg")).cast("long").alias("n"))
        .withColumnsRenamed({"p0": "row0", "p1": "row1"})
        .repartition(*keys, "seg").sortWithinPartitions(*keys, "seg")
    )
    fields = ", ".join(f"`{k}` {t}" for k, t in r.dtypes if k in keys)
    runs = pieces.mapInArrow(_runs_of_sorted(keys, bits),
                             f"{fields}, seg long, row0 long, row1 long, n long, prev_end long, edge boolean")
    # Inner runs stay with their segment, edge runs (two per segment at most) meet by key.
    part = [*keys, "edge", "at"]
    w = Window.partitionBy(*part).orderBy("row0")
    before = F.when(F.col("edge"), F.lag("row1").over(w))
    joined = (
        runs.withColumn("at", F.when(F.col("edge"), F.lit(None).cast("long")).otherwise(F.col("seg")))
        .withColumn("before", before)
        .withColumn("opens", F.col("prev_end").isNotNull() | F.col("before").isNull() | (F.col("before") < F.col("row0")))
        .withColumn("gap_from", F.when(F.col("opens"), F.coalesce("prev_end", "before")))
        .withColumn("island", F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*part, "island")
        .agg(F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.sum("n").alias("n"), F.max("gap_from").alias("gap_from"))
    )
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("row0"), F.col("row1"), F.col("n")),
        F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("row0"), F.col("row0").alias("row1"), F.lit(0).cast("long").alias("n")),
    )
    return joined.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").where(F.col("row0").isNotNull())
