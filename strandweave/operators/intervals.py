"""Interval operators: two-level scans, islands, binned joins and run-length coverage.

Coordinates are long, so no operator here puts a whole contig into one task:
running values are computed within coarse bins, and a table with one row per
bin carries them across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.columns import BIN, bin_of, overlaps
from strandweave.operators.skew import join_unique
from strandweave.session import settled

#: Positions whose running values one task computes.
COARSE = 1 << 20


def islands(df: DataFrame, keys: list[str], begin: str, end: str, tol: int, out: str, coarse: int = COARSE) -> DataFrame:
    """``df`` with ``out``: the smallest begin of the island that each row's interval is in.

    Intervals of the same keys are in one island if a chain of gaps of at most
    ``tol`` joins them. Rows with a null begin or end get a null island. Equal
    intervals are put in order once, and each row then looks up its own; ``df``
    is read twice.
    """
    place = [*keys, *dict.fromkeys((begin, end))]
    rows = df.select(*place).distinct().withColumn("__bin", F.floor(F.col(begin) / coarse))
    per_bin = rows.groupBy(*keys, "__bin").agg(F.max(end).alias("__top"))
    before = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = per_bin.select(*keys, "__bin", F.max("__top").over(before).alias("__carry"))
    rows = _attached(rows, carried, [*keys, "__bin"])

    local = W.partitionBy(*keys, "__bin").orderBy(begin, end)
    top = F.greatest(F.max(end).over(local.rowsBetween(W.unboundedPreceding, -1)), F.col("__carry"))
    starts = F.when(top.isNull() | (F.col(begin) > top + tol), F.col(begin))
    rows = rows.withColumn("__start", starts).withColumn("__local", F.max("__start").over(local.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = rows.groupBy(*keys, "__bin").agg(F.max("__start").alias("__last"))
    last = last.select(*keys, "__bin", F.max("__last").over(before).alias("__prior"))
    named = _attached(rows, last, [*keys, "__bin"]).select(*place, F.coalesce("__local", "__prior").alias(out))
    return _attached(df, named, place)


def _attached(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the one row of ``values`` that has the same keys, nulls among them."""
    other = values.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return rows.join(other, on, "left").drop(*[f"__key{i}" for i in range(len(keys))])


#: So many rows are put in order by one task.
FEW = 200_000


def in_order(df: DataFrame, order: list[str | Column], out: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``out``, its place from 1 in the order given, which should leave no ties.

    Rows are dealt by ranges of the order and numbered within each; a table
    with one row per range carries the numbers across, so no task holds all.
    Only if ``rows``, a count, is under FEW, one task numbers them.
    """
    cols = [F.col(x) if isinstance(x, str) else x for x in order]
    if rows is not None and rows < FEW:
        return df.withColumn(out, F.row_number().over(W.orderBy(*cols)).cast("long"))
    names = [f"__o{i}" for i in range(len(cols))]
    dealt = df.withColumns(dict(zip(names, cols, strict=True)))
    dealt = settled(dealt.repartitionByRange(*names).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))
    local = F.row_number().over(W.partitionBy("__part").orderBy(*names))
    return dealt.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + local).drop("__part", "__before", *names)


def bin_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], residual: Column | None = None, size: int = BIN, wide: int = 100, number: int | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys and overlapping closed intervals.

    Both sides are dealt to the bins they touch and joined on the bin; a pair
    is made in the first bin that both touch, so no distinct is needed. An
    interval over ``wide`` bins is dealt to coarser bins instead, as are its
    partners, so its fan-out is bounded. Column names of the sides must differ
    but for the keys. With ``number``, bins are dealt to so many tasks, however
    few bytes they have.
    """
    coarse = size * wide

    def is_wide(span: tuple[str, str]) -> Column:
        return (F.col(span[1]) - F.col(span[0])) >= coarse

    def dealt(df: DataFrame, span: tuple[str, str], width: int, b: str, first: str) -> DataFrame:
        lo, hi = bin_of(span[0], width), bin_of(span[1], width)
        return df.where(F.col(span[0]) <= F.col(span[1])).withColumn(first, lo).withColumn(b, F.explode(F.sequence(lo, hi)))

    def joined(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
        x, y = dealt(a, l_span, width, "__bin", "__f1"), dealt(b, r_span, width, "__bin", "__f2")
        if number:
            x, y = (d.repartition(number, *keys, "__bin") for d in (x, y))
        both = x.join(y, [*keys, "__bin"])
        both = both.where((F.col("__bin") == F.greatest("__f1", "__f2")) & overlaps(F.col(l_span[0]), F.col(l_span[1]), F.col(r_span[0]), F.col(r_span[1])))
        return (both if residual is None else both.where(residual)).drop("__bin", "__f1", "__f2")

    # a side of points is never wide, so it needs no arm of its own
    left_points, right_points = l_span[0] == l_span[1], r_span[0] == r_span[1]
    short_left = left if left_points else left.where(~is_wide(l_span))
    short_right = right if right_points else right.where(~is_wide(r_span))
    out = joined(short_left, short_right, size)
    if not left_points:
        out = out.unionByName(joined(left.where(is_wide(l_span)), right, coarse))
    if not right_points:
        out = out.unionByName(joined(short_left, right.where(is_wide(r_span)), coarse))
    return out


def near_points(left: DataFrame, right: DataFrame, keys: list[str], l_pos: tuple[str, str], r_pos: tuple[str, str], tol: int) -> DataFrame:
    """The distinct (keys, positions) of ``left`` that have a point of ``right`` within ``tol`` along both axes.

    Points are met once, however many rows stand there. They fall into cells
    whose points are all near each other, so a cell that both sides hold needs
    no comparison; what is left is compared with the cells around it, and of
    those partners the first one is enough: no pair becomes a row.
    """
    width = tol + 1

    def celled(df: DataFrame, pos: tuple[str, str], names: tuple[str, str]) -> DataFrame:
        cells = [F.floor(F.col(p) / width).alias(c) for p, c in zip(pos, ("__c1", "__c2"), strict=True)]
        return df.select(*keys, *[F.col(p).alias(n) for p, n in zip(pos, names, strict=True)], *cells).distinct()

    cell = [*keys, "__c1", "__c2"]
    a, b = settled(celled(left, l_pos, l_pos)), settled(celled(right, r_pos, ("__r1", "__r2")))
    held = b.select(*cell).distinct()
    rest = a.join(held, cell, "left_anti")
    around = [F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c) for c in ("__c1", "__c2")]
    asked = rest.select(*keys, *l_pos, around[0], F.col("__c2")).select(*keys, *l_pos, "__c1", around[1])
    met = [asked[c] == b[c] for c in cell] + [F.abs(asked[p] - b[r]) <= tol for p, r in zip(l_pos, ("__r1", "__r2"), strict=True)]
    near = asked.join(b, met, "left_semi").select(*keys, *l_pos).distinct()
    return a.join(held, cell, "left_semi").select(*keys, *l_pos).unionByName(near)


def adjacent_counts(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], tol: int, out: str, coarse: int = COARSE) -> DataFrame:
    """Rows of ``left`` that have any, with ``out``: how many intervals of ``right`` with the same keys are disjoint from theirs and at most ``tol`` away.

    No pair is made: the intervals that meet a stretch are those that begin up
    to its end without those that end before its begin, and numbers up to a
    position are running sums, within coarse bins and across them. Equal
    intervals of ``left`` are one place, which asks for four numbers. Intervals
    of whole numbers that end before they begin are left out.
    """
    place = [*keys, *l_span]
    rows = left.where(F.col(l_span[0]) <= F.col(l_span[1]))
    spots = settled(rows.groupBy(*place).agg(F.count("*").alias("__rows")))
    lo, hi = F.col(l_span[0]), F.col(l_span[1])
    # begins up to the end of the widened stretch and of the own one, ends before the begin of either
    wanted = [(hi + tol, 0, 1), (lo - tol - 1, 1, -1), (hi, 0, -1), (lo - 1, 1, 1)]
    asked = F.explode(F.array(*[F.struct(p.cast("long").alias("at"), F.lit(e).alias("end"), F.lit(s).alias("sign")) for p, e, s in wanted])).alias("__w")
    asked = spots.select(*place, asked).select(*place, F.col("__w.at").alias("__at"), F.col("__w.end").alias("__end"), F.col("__w.sign").alias("__sign"))

    valid = right.where(F.col(r_span[0]) <= F.col(r_span[1]))
    ends = F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(e).alias("end")) for e, c in enumerate(r_span)])).alias("__w")
    known = valid.select(*keys, ends).groupBy(*keys, F.col("__w.at").alias("__at"), F.col("__w.end").alias("__end")).agg(F.count("*").alias("__n"))
    side = [*keys, "__end"]
    each = known.unionByName(asked.select(*side, "__at").distinct().withColumn("__n", F.lit(0).cast("long")))
    each = settled(each.groupBy(*side, "__at").agg(F.sum("__n").alias("__n")).withColumn("__bin", F.floor(F.col("__at") / coarse)))
    per_bin = each.groupBy(*side, "__bin").agg(F.sum("__n").alias("__all"))
    carried = per_bin.select(*side, "__bin", (F.sum("__all").over(W.partitionBy(*side).orderBy("__bin")) - F.col("__all")).alias("__carry"))
    total = F.col("__carry") + F.sum("__n").over(W.partitionBy(*side, "__bin").orderBy("__at"))
    upto = each.join(carried, [*side, "__bin"]).select(*side, "__at", total.alias("__upto"))

    found = asked.join(upto, [*side, "__at"]).groupBy(*place).agg(F.sum(F.col("__upto") * F.col("__sign")).alias(out))
    found = settled(found.where(F.col(out) > 0).join(spots, place))
    rows_all = spots.agg(F.sum("__rows")).first()[0] or 0
    return join_unique(rows, found, place, "__rows", rows_all).drop("__rows")


#: Pairs that one task of a dense join may look at, cells that a crowded bin is cut into, and how many bins are cut at most.
CROWD, CELLS, CUT_BINS = 20_000_000, 64, 20_000


def dense_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], residual: Column | None = None, size: int = BIN, wide: int = 100, crowd: int = CROWD) -> DataFrame:
    """What :func:`bin_join` gives, for places where many intervals pile up.

    The rows that touch each bin are counted first. A bin where more than
    ``crowd`` pairs would meet is crowded: it is cut into cells, unless its
    intervals are so long that this saves nothing, and a cell still crowded is
    dealt to several tasks by a grid of parts of both sides, as square as their
    sizes allow, so a row is copied by the root of the number of tasks. A pair
    is made where the later of its begins lies. Both sides should be settled.
    """

    def is_wide(span: tuple[str, str]) -> Column:
        return (F.col(span[1]) - F.col(span[0])) >= size * wide

    wide_left, wide_right = left.where(is_wide(l_span)), right.where(is_wide(r_span))
    a, b = left.where(~is_wide(l_span) & (F.col(l_span[0]) <= F.col(l_span[1]))), right.where(~is_wide(r_span) & (F.col(r_span[0]) <= F.col(r_span[1])))
    a, b = (x.withColumn("__bin", F.explode(F.sequence(bin_of(s[0], size), bin_of(s[1], size)))) for x, s in ((a, l_span), (b, r_span)))
    place = [*keys, "__bin"]

    def counted(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        n = x.groupBy(*on).agg(F.count("*").alias("__l")).join(y.groupBy(*on).agg(F.count("*").alias("__r")), on)
        return n.withColumn("__pairs", F.col("__l") * F.col("__r"))

    crowded = settled(counted(a, b, place).where(F.col("__pairs") > crowd))
    # by number: few bytes may make many pairs, so adaptive execution must not put these partitions together
    number = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = crowd
    while crowded.where(F.col("__pairs") > limit).count() > CUT_BINS:
        limit *= 4
    crowded = crowded.where(F.col("__pairs") > limit)
    if not crowded.take(1):
        return bin_join(left, right, keys, l_span, r_span, residual, size, wide, number)

    step = max(1, size // CELLS)

    def celled(x: DataFrame, span: tuple[str, str]) -> DataFrame:
        lo = F.greatest(F.col(span[0]), F.col("__bin") * size)
        hi = F.least(F.col(span[1]), (F.col("__bin") + 1) * size - 1)
        return x.withColumn("__cell", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))

    hot = F.broadcast(crowded.select(*place))
    cells = settled(counted(celled(a.join(hot, place), l_span), celled(b.join(hot, place), r_span), [*place, "__cell"]))
    saved = cells.groupBy(*place).agg(F.sum(F.col("__pairs") + F.col("__l") + F.col("__r")).alias("__work"), F.max("__pairs").alias("__most"))
    cut = crowded.join(saved, place, "left").withColumn("__cut", F.coalesce(F.col("__work") < F.col("__pairs") / 2, F.lit(True)))
    cut = F.broadcast(settled(cut.select(*place, "__cut", "__l", "__r", "__pairs")))
    # what is still crowded: whole bins that aren't cut, and cells
    still = cells.join(cut.where("__cut").select(*place), place).unionByName(cut.where("not __cut").select(*place, F.lit(-1).cast("long").alias("__cell"), "__l", "__r", "__pairs"))
    # parts of the left side, as many as make the copies of both sides alike, and of the right side
    number_of = F.ceil(F.col("__pairs") / limit)
    still = still.where(F.col("__pairs") > limit).withColumn("__p1", F.greatest(F.lit(1), F.least(number_of, F.round(F.sqrt(number_of * F.col("__l") / F.col("__r"))))).cast("int"))
    still = F.broadcast(settled(still.select(*place, "__cell", "__p1", F.ceil(number_of / F.col("__p1")).cast("int").alias("__p2"))))

    def dealt(x: DataFrame, span: tuple[str, str], is_left: bool) -> DataFrame:
        x = x.join(cut.select(*place, "__cut"), place, "left")
        whole = x.where("not coalesce(__cut, false)").withColumn("__cell", F.lit(-1).cast("long"))
        x = whole.unionByName(celled(x.where("__cut"), span)).drop("__cut").join(still, [*place, "__cell"], "left")
        p1, p2 = F.coalesce("__p1", F.lit(1)), F.coalesce("__p2", F.lit(1))
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in x.columns if not c.startswith("__")]), p1 if is_left else p2).cast("int")
        # a row of the grid for the left side, a column for the right one
        parts = F.sequence(own * p2, own * p2 + p2 - 1) if is_left else F.sequence(own, (p1 - 1) * p2 + own, p2)
        return x.withColumn("__part", F.explode(parts)).drop("__p1", "__p2")

    on = [*place, "__cell", "__part"]
    both = dealt(a, l_span, True).repartition(number, *on).join(dealt(b, r_span, False).repartition(number, *on), on)
    later = F.greatest(F.col(l_span[0]), F.col(r_span[0]))
    here = (bin_of(later, size) == F.col("__bin")) & ((F.col("__cell") < 0) | (F.floor(later / step) == F.col("__cell")))
    both = both.where(here & overlaps(F.col(l_span[0]), F.col(l_span[1]), F.col(r_span[0]), F.col(r_span[1])))
    out = (both if residual is None else both.where(residual)).drop("__bin", "__cell", "__part")
    out = out.unionByName(bin_join(wide_left, right, keys, l_span, r_span, residual, size, wide))
    return out.unionByName(bin_join(left.where(~is_wide(l_span)), wide_right, keys, l_span, r_span, residual, size, wide))


def coverage(reads: DataFrame, key: str, begin: str, end: str, weight: Column | int = 1, coarse: int = COARSE) -> DataFrame:
    """(key, start, stop, depth): run-length depth of half-open intervals, stretches without reads left out."""
    w = F.lit(weight) if isinstance(weight, int) else weight
    ends = F.explode(F.array(F.struct(F.col(begin).cast("long").alias("pos"), w.cast("long").alias("d")), F.struct(F.col(end).cast("long").alias("pos"), (-w).cast("long").alias("d")))).alias("e")
    deltas = reads.where(F.col(begin) < F.col(end)).select(key, ends).groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    deltas = deltas.withColumn("b", F.floor(F.col("pos") / coarse))
    per_bin = deltas.groupBy(key, "b").agg(F.sum("d").alias("bd"), F.min("pos").alias("head"))
    across = W.partitionBy(key).orderBy("b")
    carried = per_bin.select(key, "b", (F.sum("bd").over(across) - F.col("bd")).alias("carry"), F.lead("head").over(across).alias("next_head"))
    rows = deltas.join(carried, [key, "b"])
    local = W.partitionBy(key, "b").orderBy("pos")
    rows = rows.withColumn("depth", F.col("carry") + F.sum("d").over(local)).withColumn("stop", F.coalesce(F.lead("pos").over(local), F.col("next_head")))
    return rows.where((F.col("depth") > 0) & F.col("stop").isNotNull()).select(key, F.col("pos").alias("start"), "stop", "depth")


def as_of(known: DataFrame, asked: DataFrame, key: str, pos: str, value: str, order: str | None = None, coarse: int = COARSE) -> DataFrame:
    """``asked`` with ``value`` of the last row of ``known`` with the same key at or before its position, null if there is none.

    Of known rows at one position the one with the greatest ``order`` (by
    default ``value``) counts. Values are found within coarse bins, and a table
    with one row per bin carries the last one across, so no key sits in one task.
    """
    order = order or value
    place = F.struct(F.col(pos).alias("p"), F.col(order).alias("o"), F.col(value).alias("v"))
    # one row for each position, known or asked, so that a bin has no more rows than positions
    seen = known.where(F.col(pos).isNotNull()).groupBy(key, F.col(pos).alias("__at")).agg(F.max(place).alias("__seen")).withColumn("__bin", F.floor(F.col("__at") / coarse))
    places = asked.select(key, F.col(pos).alias("__at")).distinct().withColumn("__bin", F.floor(F.col("__at") / coarse))
    last = seen.groupBy(key, "__bin").agg(F.max("__seen").alias("__last"))
    bins = last.unionByName(places.select(key, "__bin", F.lit(None).cast(last.schema["__last"].dataType).alias("__last"))).groupBy(key, "__bin").agg(F.max("__last").alias("__last"))
    before = W.partitionBy(key).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = bins.select(key, "__bin", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    both = seen.select(key, "__bin", "__at", F.lit(0).alias("__src"), "__seen").unionByName(places.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    local = W.partitionBy(key, "__bin").orderBy("__at", "__src").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("__near", F.last("__seen", ignorenulls=True).over(local)).where("__src = 1")
    found = _attached(both.select(key, "__bin", "__at", "__near"), carried, [key, "__bin"]).select(key, "__at", F.coalesce("__near", "__carry")["v"].alias("__value"))
    rows = asked.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in asked.columns])).select(key, F.col(pos).alias("__at"), "__row")
    return _attached(rows, found, [key, "__at"]).select("__row.*", F.col("__value").alias(value))
