"""Interval toolkit: clipping, islands, subtraction, sweeps and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .ordering import followed, prefixes, ranges

#: Levels of bins above the finest, and how many bins of a level make one of the next.
LEVELS = 8
FAN = 4


def clip(df: DataFrame, start: float, end: float, lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """Rows cut to [start, end); rows outside go."""
    df = df.where((F.col(lft) < end) & (F.col(rgt) > start))
    return df.withColumns({lft: F.greatest(F.col(lft), F.lit(float(start))), rgt: F.least(F.col(rgt), F.lit(float(end)))})


def overlap(a_lft, a_rgt, b_lft, b_rgt) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(a_lft) < c(b_rgt)) & (c(b_lft) < c(a_rgt))


def sweep(df: DataFrame, keys: list[str], sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """Elementary intervals of each key with the sums (and exclusive ors) over the rows
    that cover them: one sorted pass over end points, no interval join. ``n_rows`` counts
    the rows."""
    sums, xors = {"n_rows": F.lit(1)} | sums, xors or {}
    ends = df.select(*keys, F.explode(F.array(
        F.struct(F.col("lft").alias("x"), *[v.alias(k) for k, v in (sums | xors).items()]),
        F.struct(F.col("rgt").alias("x"), *[(-v).alias(k) for k, v in sums.items()], *[v.alias(k) for k, v in xors.items()]),
    )).alias("p")).select(*keys, "p.*")
    ends = ends.groupBy(*keys, "x").agg(*[F.sum(k).alias(k) for k in sums], *[F.bit_xor(k).alias(k) for k in xors])
    w = Window.partitionBy(*keys).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ends.select(*keys, F.col("x").alias("lft"), F.lead("x").over(w).alias("rgt"), *[F.sum(k).over(run).alias(k) for k in sums], *[F.bit_xor(k).over(run).alias(k) for k in xors])
    return out.where("n_rows > 0")


def islands(df: DataFrame, keys: list[str], lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """Touching and overlapping intervals of a key made one."""
    w = Window.partitionBy(*keys).orderBy(lft, rgt)
    reach = F.max(rgt).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(lft) > reach), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "_run").agg(F.min(lft).alias(lft), F.max(rgt).alias(rgt)).drop("_run")


def subtract(whole: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of ``whole`` (keys, lft, rgt) that no hole of the same key covers."""
    both = whole.select(*keys, "lft", "rgt", F.lit(1).alias("_w"), F.lit(0).alias("_o"))
    both = both.union(holes.select(*keys, "lft", "rgt", F.lit(0).alias("_w"), F.lit(1).alias("_o")))
    parts = sweep(both, keys, {"_w": F.col("_w"), "_o": F.col("_o")}).where("_w > 0 and _o = 0")
    return islands(parts.select(*keys, "lft", "rgt"), keys)


def _level(size: Column, span: float) -> Column:
    """The finest level whose bins are as long as the interval. Bins of level 0 are
    ``span / FAN^LEVELS`` long, each next level's ``FAN`` times longer."""
    level = F.ceil(F.log(float(FAN), size / (span / FAN**LEVELS)))
    return F.greatest(F.least(level, F.lit(LEVELS)), F.lit(0)).cast("int")


def _width(level: Column, span: float) -> Column:
    return F.lit(span / FAN**LEVELS) * F.pow(F.lit(float(FAN)), level)


def _bins(lft: Column, rgt: Column, width: Column) -> Column:
    """Numbers of the bins that [lft, rgt) meets; the end's bin counts, so that no rounding
    of a division loses a point just below it."""
    return F.sequence(F.floor(lft / width), F.floor(rgt / width))


def _homes(intervals: DataFrame, span: float, lft: str, rgt: str) -> DataFrame:
    """Each interval at its own level, in the one or two bins that it meets there."""
    d = intervals.where(F.col(lft) < F.col(rgt)).withColumn("_level", _level(F.col(rgt) - F.col(lft), span))
    return d.withColumn("_bin", F.explode(_bins(F.col(lft), F.col(rgt), _width(F.col("_level"), span))))


def stab_join(points: DataFrame, intervals: DataFrame, x: str, span: float, keys: list[str] = (), lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """Points with the intervals that hold them (lft <= x < rgt).

    Bins in levels: an interval lies at the one level whose bins are about as long as it
    is, in at most two bins; a point asks one bin of each level. An interval covers a good
    part of its bins, so what a bin compares is in proportion to what it returns, however
    long or short the intervals are, and the join has an equality key. ``span`` is about
    the length that all intervals lie in (it sets the finest bins, not the result)."""
    span = max(float(span), 1e-9)
    levels = F.array(*[F.struct(F.lit(k).alias("l"), F.floor(F.col(x) / _width(F.lit(k), span)).alias("b")) for k in range(LEVELS + 1)])
    p = points.withColumn("_at", F.explode(levels)).withColumns({"_level": F.col("_at.l"), "_bin": F.col("_at.b")}).drop("_at")
    met = p.join(_homes(intervals, span, lft, rgt), ["_level", "_bin", *keys])
    return met.where((F.col(lft) <= F.col(x)) & (F.col(x) < F.col(rgt))).drop("_level", "_bin")


def overlap_join(a: DataFrame, b: DataFrame, span: float, a_ends: tuple[str, str] = ("a", "b"), b_ends: tuple[str, str] = ("lft", "rgt"), keys: list[str] = ()) -> DataFrame:
    """Rows of both sides whose intervals overlap, by bins in levels as in ``stab_join``: the
    finer of two intervals asks the bins of the coarser one's level. A pair is told in the
    first bin that both meet. Empty intervals overlap nothing."""
    span = max(float(span), 1e-9)

    def asking(df: DataFrame, lft: str, rgt: str, also: int) -> DataFrame:
        """The interval in the one or two bins that it meets at each coarser level (with
        ``also`` 0 at its own too)."""
        d = df.where(F.col(lft) < F.col(rgt)).withColumn("_level", _level(F.col(rgt) - F.col(lft), span) + also)
        d = d.where(F.col("_level") <= LEVELS).withColumn("_level", F.explode(F.sequence(F.col("_level"), F.lit(LEVELS))))
        return d.withColumn("_bin", F.explode(_bins(F.col(lft), F.col(rgt), _width(F.col("_level"), span))))

    def met(asks: DataFrame, ask_ends: tuple[str, str], home: DataFrame, home_ends: tuple[str, str]) -> DataFrame:
        d = asks.join(home, ["_level", "_bin", *keys])
        first = F.floor(F.greatest(F.col(ask_ends[0]), F.col(home_ends[0])) / _width(F.col("_level"), span))
        return d.where((F.col("_bin") == first) & overlap(*ask_ends, *home_ends)).drop("_level", "_bin")

    fine = met(asking(a, *a_ends, 0), a_ends, _homes(b, span, *b_ends), b_ends)
    coarse = met(asking(b, *b_ends, 1), b_ends, _homes(a, span, *a_ends), a_ends)
    return fine.unionByName(coarse)


def running(intervals: DataFrame, sums: dict[str, Column], lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """``x, y`` and, for each of ``sums``, its total over the intervals that hold the points
    of [x, y), from each end of an interval to the next (null after the last). Ends are
    added up first, then ranges of them: no task holds them all."""
    d = intervals.where(F.col(lft) < F.col(rgt))
    ends = d.select(F.explode(F.array(
        F.struct(F.col(lft).alias("x"), *[v.alias(k) for k, v in sums.items()]),
        F.struct(F.col(rgt).alias("x"), *[(-v).alias(k) for k, v in sums.items()]),
    )).alias("p")).select("p.*").groupBy("x").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    run = prefixes(ends, ["x"], {k: F.col(f"_{k}") for k in sums})
    return followed(run.select("x", *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums]), "x", "y")


def held_totals(points: DataFrame, intervals: DataFrame, x: str, sums: dict[str, Column]) -> DataFrame:
    """Points with the totals of ``sums`` over the intervals that hold them (null where none
    ever began before): ``stab_join`` and a sum, without a row for each point and interval."""
    return _looked_up(points, running(intervals, sums), x, list(sums))


def _looked_up(points: DataFrame, steps: DataFrame, x: str, names: list[str]) -> DataFrame:
    """Points with the columns of the last step at or before them. Points and steps are dealt
    by ranges; each range gets the last step of those before."""
    own = points.columns
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    s = steps.select(F.col("x").alias("_x"), F.lit(0).alias("_point"), F.struct("x", *names).alias("_step"), *[none(points, c) for c in own])
    p = points.select(F.col(x).alias("_x"), F.lit(1).alias("_point"), F.lit(None).cast(s.schema["_step"].dataType).alias("_step"), *own)
    d = ranges(s.union(p), ["_x"])
    lasts = d.groupBy("_part").agg(F.max("_step").alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    lasts = lasts.select(F.col("_part").alias("_tp"), F.max("_last").over(earlier).alias("_prev"))
    w = Window.partitionBy("_part").orderBy("_x", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = d.withColumn("_held", F.last("_step", ignorenulls=True).over(w)).where("_point = 1").join(F.broadcast(lasts), F.col("_part") == F.col("_tp"))
    step = F.coalesce("_held", "_prev")
    return found.select(*own, *[step[c].alias(c) for c in names], step["x"].alias("_from"))


def overlap_totals(spans: DataFrame, intervals: DataFrame, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Spans with ``n``, how many intervals overlap each, and ``shared``, the sum of the lengths
    that they share; spans that meet none go. ``overlap_join`` and a sum, without a row for
    each pair: n is what begins before the span's end less what ended by its start, and
    shared the coverage integrated up to both ends."""
    d = intervals.where(F.col("lft") < F.col("rgt"))
    ticks = d.select(F.col("lft").alias("x"), F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("c")).union(d.select("rgt", F.lit(0).cast("long"), F.lit(1).cast("long")))
    ticks = materialize(ticks.groupBy("x").agg(F.sum("o").alias("_o"), F.sum("c").alias("_c")), "ticks")
    run = prefixes(ticks, ["x"], {"opened": F.col("_o"), "closed": F.col("_c")})
    # before x, and with what begins or ends at x
    run = followed(run.select("x", (F.col("opened") + F.col("_o")).alias("opened"), (F.col("closed") + F.col("_c")).alias("closed"), "_o"), "x", "_y")
    cover = (F.col("opened") - F.col("closed")) * (F.coalesce("_y", F.col("x")) - F.col("x"))
    run = prefixes(run, ["x"], {"area": cover})
    run = materialize(run.select("x", "opened", "closed", "_o", "area"), "coverage")
    names = ["opened", "closed", "_o", "area"]
    s = spans.where(F.col(ends[0]) < F.col(ends[1]))
    key = spans.columns
    low = _looked_up(s, run, ends[0], names)
    level = lambda x: F.coalesce(F.col("area") + (F.col("opened") - F.col("closed")) * (F.col(x) - F.col("_from")), F.lit(0.0))
    low = low.select(*key, F.coalesce("closed", F.lit(0)).alias("_gone"), level(ends[0]).alias("_low"))
    high = _looked_up(low, run, ends[1], names)
    begun = F.when(F.col("_from") == F.col(ends[1]), F.col("opened") - F.col("_o")).otherwise(F.coalesce("opened", F.lit(0)))
    return high.select(*key, (begun - F.col("_gone")).alias("n"), (level(ends[1]) - F.col("_low")).alias("shared")).where("n > 0")


def as_of(points: DataFrame, steps: DataFrame, key: str, x: str, lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """Points with the columns of the step of their key that holds them; a key's steps do
    not overlap. One sorted pass over points and steps together, no join, so neither many
    steps nor many points of a key multiply."""
    values = [c for c in steps.columns if c not in (key, lft, rgt)]
    own = [c for c in points.columns if c != key]
    held = F.struct(F.col(rgt).alias("_end"), *values)
    s = steps.select(key, F.col(lft).alias("_x"), F.lit(0).alias("_point"), held.alias("_step"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own])
    p = points.select(key, F.col(x).alias("_x"), F.lit(1).alias("_point"), F.lit(None).cast(s.schema["_step"].dataType).alias("_step"), *own)
    w = Window.partitionBy(key).orderBy("_x", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = s.union(p).withColumn("_step", F.last("_step", ignorenulls=True).over(w)).where((F.col("_point") == 1) & (F.col("_x") < F.col("_step._end")))
    return found.select(key, *own, *[F.col("_step")[c].alias(c) for c in values])


def contained(df: DataFrame, a: float, b: float, lft: str = "lft", rgt: str = "rgt") -> DataFrame:
    """Rows that lie within [a, b]."""
    return df.where((F.col(lft) >= a) & (F.col(rgt) <= b))
