"""One surviving record per duplicate group, and what the sources say together by iterative truth discovery.

1. Blocks. Rows of one observation and channel whose frequencies lie in one quarter of the tolerance, whose lengths are of one power of
   two and whose starts are within an eighth of the length are one detection by definition. They are folded to one row,
   a block, with the bounds of its rows, in one aggregate with map-side combining; a hot line is a few blocks.
2. Links. Blocks meet in buckets of frequency and time. Their bounds decide nearly all pairs; where they don't, and the two aren't linked by
   another way, their distinct rows are compared. A component of linked blocks is a detection.
3. The survivor is the row that ranks first by the stated order (greatest or least of each field in turn, then the
   identifier). Such an order leaves sources no say: the extreme value wins, whoever claims it.
4. Truth discovery (``supported_values``). Each row is a claim of its source (the run) about every field. In turn, each
   field's best supported value is determined from the votes weighted by the reliability of their sources, and each
   source's reliability from the share of its claims that hold, until the reliabilities stay the same. A claim votes
   for its own value and those next to it; null and NaN are no claim.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.llm.components import components
from skydrift.tables import discard, materialize

#: Truth discovery ends when no reliability moves by more; a run that needs more rounds warns.
TOLERANCE, MANY_ROUNDS = 1e-4, 200
BLOCK = ("fc", "lc", "tb")
#: Length classes to a level of time buckets, and quarters of the tolerance to a frequency bucket.
LEVEL, WIDE = 3, 32


def _shift(v: Column, bits: Column) -> Column:
    return F.call_function("shiftright", v, bits)


def with_block(rows: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Adds the block of each row (fc, lc, tb) to rows that can be part of a detection, and leaves the others out: null keys, bounds,
    frequency or hit_id, NaN, and ranges that are empty or reversed."""
    ok = reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, "row0", "row1", "f", "hit_id"], F.col("row1") > F.col("row0"))
    # A hair less than a quarter, so that rounding doesn't bring together what is farther apart.
    cell = tol / 4 * (1 - 2**-20)
    length = F.col("row1") - F.col("row0")
    lc = (F.length(F.bin(length)) - 1).cast("int")
    return (rows.where(ok & ~F.isnan("f") & (F.abs("f") < 1e300)).withColumn("fc", F.floor(F.col("f") / F.lit(cell))).withColumn("lc", lc)
            .withColumn("tb", _shift(F.col("row0"), F.greatest(F.lit(0), F.col("lc") - 2))))


def block_links(blocks: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """(a, b, sure): pairs of blocks of which some rows are linked for sure, or may be.

    The middle of the shorter range lies in the longer one. So a block is looked up, at its middles, in time buckets of each
    level (three length classes) that occurs from its own on, and holds the buckets of its own level that its rows touch. What is joined on
    is a hash of keys, level and buckets, beside another of the keys.
    """
    level = F.floor(F.col("lc") / LEVEL).cast("int")
    known = sorted(r[0] for r in blocks.select(level).distinct().collect())  # at most 21
    bits = (F.col("level") + 1) * LEVEL
    wide, edge = F.floor(F.col("fc") / WIDE), F.pmod(F.col("fc"), F.lit(WIDE))
    bounds = ("node", "lc", "f0", "f1", "r00", "r01", "r10", "r11")
    touch = lambda lo, hi: F.explode(F.sequence(_shift(lo, bits), _shift(hi, bits)))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(F.xxhash64(*keys, "level", "fb", "t").alias("at"), F.hash(*keys).alias("line"), *[F.col(c).alias(f"{x}_{c}") for c in bounds])

    levels = F.array(*[F.lit(c) for c in known]) if known else F.array().cast("array<int>")
    a = blocks.withColumn("level", F.explode(F.filter(levels, lambda c: c >= level))).withColumn("fb", wide)
    # Rows of a block are of one length class, so their middles are these or between them.
    a = side(a.withColumn("t", touch(_shift(F.col("r00") + F.col("r10"), F.lit(1)), _shift(F.col("r01") + F.col("r11"), F.lit(1)))), "a")
    b = blocks.withColumn("level", level).withColumn(
        "fb", F.explode(F.when(edge < 5, F.array(wide, wide - 1)).when(edge > WIDE - 6, F.array(wide, wide + 1)).otherwise(F.array(wide))))
    b = side(b.withColumn("t", touch(F.col("r00"), F.col("r11") - 1)), "b")
    p = a.join(b, ["at", "line"]).where((F.col("a_lc") < F.col("b_lc")) | ((F.col("a_lc") == F.col("b_lc")) & (F.col("a_node") != F.col("b_node"))))
    # In one class either may be the shorter, so such pairs are sought from both. The bounds of what two rows share, of the shorter length, and of the difference in frequency.
    most, least = F.least("a_r11", "b_r11") - F.greatest("a_r00", "b_r00"), F.least("a_r10", "b_r10") - F.greatest("a_r01", "b_r01")
    one = F.lit(1).cast("long")
    longest = lambda x: F.least(F.col(f"{x}_r11") - F.col(f"{x}_r00"), F.call_function("shiftleft", one, F.col(f"{x}_lc") + 1) - 1)
    shortest = lambda x: F.greatest(F.col(f"{x}_r10") - F.col(f"{x}_r01"), F.call_function("shiftleft", one, F.col(f"{x}_lc")))
    near = F.greatest(F.col("a_f0") - F.col("b_f1"), F.col("b_f0") - F.col("a_f1")) <= tol
    all_near = F.greatest(F.col("a_f1") - F.col("b_f0"), F.col("b_f1") - F.col("a_f0")) <= tol
    may = near & (most * 2 > F.least(shortest("a"), shortest("b")))
    sure = all_near & (least * 2 > F.least(longest("a"), longest("b")))
    return p.where(may).groupBy(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).agg(F.max(sure).alias("sure"))


def _exact_links(undecided: DataFrame, blocks: DataFrame, rows: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Pairs (a, b) of the undecided of which two rows are linked. rows: with their blocks."""
    asked = undecided.select(F.col("a").alias("node")).union(undecided.select("b")).distinct()
    members = materialize(rows.join(blocks.join(asked, "node").select("node", *keys, *BLOCK), [*keys, *BLOCK]).select("node", "row0", "row1", "f").distinct())
    side = lambda x: members.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("row0", "row1", "f")])
    shared = F.least("a_row1", "b_row1") - F.greatest("a_row0", "b_row0")
    shorter = F.least(F.col("a_row1") - F.col("a_row0"), F.col("b_row1") - F.col("b_row0"))
    return undecided.join(side("a"), "a").join(side("b"), "b").where((shared * 2 > shorter) & (F.abs(F.col("a_f") - F.col("b_f")) <= tol)).select("a", "b").distinct()


def detection_blocks(rows: DataFrame, keys: list[str], tol: float = 20.0, **carried: Column) -> DataFrame:
    """Blocks of rows that belong to a detection of two or more rows: keys, fc, lc, tb, ``g`` (identifier of the detection), n, and the
    aggregates ``carried``, by block.

    rows: ``hit_id`` (unique), keys, ``row0``, ``row1``, ``f``, and what the aggregates need. Rows that ``with_block`` leaves out belong to
    no detection.
    """
    rows = with_block(rows, keys, tol)
    blocks = materialize(rows.groupBy(*keys, *BLOCK).agg(
        F.min("hit_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1"), F.min("row0").alias("r00"), F.max("row0").alias("r01"),
        F.min("row1").alias("r10"), F.max("row1").alias("r11"), *[v.alias(k) for k, v in carried.items()]))
    links = materialize(block_links(blocks, keys, tol))
    roots = materialize(components(links.where("sure").select("a", "b")))
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    open_ = links.where("not sure").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    open_ = materialize(open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    if not open_.isEmpty():
        more = _exact_links(open_, blocks, rows, keys, tol)
        old = roots
        roots = materialize(components(links.where("sure").select("a", "b").union(more)))
        discard(old)
    out = materialize(blocks.join(roots, "node", "left").where("n > 1 or root is not null").withColumn("g", F.coalesce("root", "node"))
                      .select(*keys, *BLOCK, "g", "n", *carried))
    for t in (blocks, links, roots, open_):
        discard(t)
    return out


def detection_groups(rows: DataFrame, keys: list[str], carry: list[str], tol: float = 20.0) -> DataFrame:
    """Rows that belong to a detection of two or more rows, with its identifier ``g``, the keys, hit_id, row0, row1, f and the columns to ``carry``."""
    rows = rows.select("hit_id", *keys, "row0", "row1", "f", *carry)
    blocks = detection_blocks(rows, keys, tol)
    return with_block(rows, keys, tol).join(blocks.select(*keys, *BLOCK, "g"), [*keys, *BLOCK]).drop(*BLOCK)


# Survivors


def _known(field: str) -> Column:
    return F.nanvl(F.col(field).cast("double"), F.lit(None).cast("double"))


def _rank(order: dict[str, str]) -> Column:
    keys = [(-_known(k) if how == "at_most" else _known(k)).alias(k) for k, how in order.items()]
    return F.max(F.struct(*keys, (-F.col("hit_id")).alias("i")))


def _extremes(order: dict[str, str]) -> dict[str, Column]:
    return {f"best_{k}": F.min(_known(k)) if how == "at_most" else F.max(_known(k)) for k, how in order.items()}


def best_representatives(rows: DataFrame, keys: list[str], order: dict[str, str], tol: float = 20.0, extremes: bool = True) -> DataFrame:
    """The surviving row of each detection: ``g``, ``hit_id``, the greatest or least value of each field if asked for, and ``n_rows``.

    rows: as in ``detection_blocks``. order: fields in the order of their importance; 'at_least' prefers the greatest
    value, 'at_most' the least. Null and NaN come last. Ties end at the lowest hit_id. Sources have no say in it. Rows are folded to
    blocks before anything is shuffled, and blocks to detections.
    """
    order_ = order if extremes else {}
    blocks = detection_blocks(rows, keys, tol, b=_rank(order), **_extremes(order_))
    best = [(F.min if how == "at_most" else F.max)(f"best_{k}").alias(f"best_{k}") for k, how in order_.items()]
    out = blocks.groupBy("g").agg(F.max("b").alias("b"), *best, F.sum("n").alias("n_rows"))
    return out.select("g", (-F.col("b.i")).alias("hit_id"), *[f"best_{k}" for k in order_], "n_rows")


# Truth discovery


def votes_of(claims: DataFrame, group: list[str], steps: dict[str, float]) -> DataFrame:
    """(group, field, source, v, n): claims (group, ``source`` and the fields) counted by value, in whole steps of the field. A null source is a source of
    its own; null, NaN and infinite values are no claim."""
    value = [F.struct(F.lit(k).alias("field"), F.round(_known(k) / F.lit(s)).alias("v")) for k, s in steps.items()]
    long_ = claims.select(*group, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.explode(F.array(*value)).alias("x"))
    long_ = long_.select(*group, "source", "x.*").where("v is not null and abs(v) < 9e18").withColumn("v", F.col("v").cast("long"))
    return long_.groupBy(*group, "field", "source", "v").agg(F.count(F.lit(1)).alias("n"))


def discover(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over votes (g, field, source, v, n).

    Returns the truths (g, field, v, support as a share of all votes on the field) and the sources (source, reliability). A value has the votes
    for it and for those one step beside it; of equally supported values that with more votes of its own is taken, then the
    greater. A field that nobody claims has no truth. All is counted in aggregates that combine before they shuffle, so that a group
    may hold any share of the claims.
    """
    sources, truths = materialize(votes.select("source").distinct().withColumn("reliability", F.lit(0.5))), None
    for n in range(1, MANY_ROUNDS + 2):
        own = votes.join(sources, "source").groupBy("g", "field", "v").agg(F.sum(F.col("n") * F.col("reliability")).alias("w"))
        near = own.select("g", "field", F.explode(F.array(*[F.struct((F.col("v") + d).alias("v"), F.col("w"), F.lit(d == 0).alias("own")) for d in (-1, 0, 1)])).alias("x")).select("g", "field", "x.*")
        sums = near.groupBy("g", "field", "v").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("own"), F.col("w"))).alias("own"))
        rank = F.struct(F.round("w", 9).alias("s"), F.round("own", 9).alias("o"), F.col("v").alias("v"))
        found = sums.where("own is not null").groupBy("g", "field").agg(F.max(F.struct(rank.alias("k"), F.col("w"))).alias("t"), F.sum("own").alias("all"))
        if truths is not None:
            discard(truths)
        truths = materialize(found.select("g", "field", F.col("t.k.v").alias("v"), (F.col("t.w") / F.col("all")).alias("support")))
        held = votes.join(truths.select("g", "field", F.col("v").alias("truth")), ["g", "field"]).withColumn(
            "ok", F.when(F.abs(F.col("v") - F.col("truth")) <= 1, F.col("n")).otherwise(0))
        after = materialize(held.groupBy("source").agg(((F.sum("ok") + 1) / (F.sum("n") + 2)).alias("reliability")))
        moved = after.join(sources.withColumnRenamed("reliability", "was"), "source").agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
        discard(sources)
        sources = after
        if not moved or moved < TOLERANCE:
            break
        if n > MANY_ROUNDS:
            warnings.warn(f"truth discovery stopped after {n} rounds; a reliability still moves by {moved:.2g}", stacklevel=2)
    return truths, sources


def supported_values(rows: DataFrame, keys: list[str], steps: dict[str, float], tol: float = 20.0) -> DataFrame:
    """What the sources say together about each detection: ``hit_id`` (the lowest of its rows), the best supported value of each
    field, its share of the weighed votes as ``support_*``, and ``n_rows``.

    rows: as in ``detection_blocks``, with a ``source``. steps: fields with the step to which their claims are rounded; values within one step
    support each other. Fields that no row claims are null.
    """
    blocks = detection_blocks(rows, keys, tol, first=F.min("hit_id"))
    counted = votes_of(with_block(rows, keys, tol), [*keys, *BLOCK], steps)
    votes = materialize(counted.join(blocks.select(*keys, *BLOCK, "g"), [*keys, *BLOCK]).groupBy("g", "field", "source", "v").agg(F.sum("n").alias("n")))
    truths, sources = discover(votes)
    of = lambda k, c: F.max(F.when(F.col("field") == k, F.col(c)))
    # Divided, not multiplied: a step such as 0.1 is no exact number, one over it is.
    wide = truths.groupBy("g").agg(*[(of(k, "v") / F.lit(round(1 / s, 6))).alias(k) for k, s in steps.items()], *[of(k, "support").alias(f"support_{k}") for k in steps])
    size = blocks.groupBy("g").agg(F.min("first").alias("hit_id"), F.sum("n").alias("n_rows"))
    discard(votes)
    discard(sources)
    return size.join(wide, "g", "left").select("g", "hit_id", *steps, *[f"support_{k}" for k in steps], "n_rows")
