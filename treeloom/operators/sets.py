"""Sets of ids as bitmaps: a row ``set, block, bits`` for each 64 ids of a set that hold one.

``block`` is the id divided by 64 and bit k of ``bits`` the id ``64 block + k``; blocks without a
member have no row, so sparse sets stay small and dense ones cost an eighth of a byte an id.
Every operation is an aggregate or an equality join on (set, block): a large set is spread over
its blocks and no task holds one whole. ``set`` may be any column type; sets of two
families are matched by it. A set without members has no rows; operations that tell of
each set take the family of names where empty ones matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _has(bits: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, place.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _place(member: Column) -> tuple[Column, Column]:
    member = member.cast("long")
    return F.shiftright(member, 6), F.pmod(member, F.lit(WORD))


def of_members(rows: DataFrame, name: str, member: str) -> DataFrame:
    """Bitmaps of (set, id) rows; repeated ids count once, null ids not at all."""
    block, place = _place(F.col(member))
    return rows.where(F.col(member).isNotNull()).groupBy(F.col(name).alias("set"), block.alias("block")).agg(F.bit_or(_bit(place)).alias("bits"))


def members(sets: DataFrame) -> DataFrame:
    """``set, id``."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: _has(F.col("bits"), k))
    return sets.select("set", "block", F.explode(places).alias("_k")).select("set", (F.col("block") * WORD + F.col("_k")).alias("id"))


def get(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """``set, id`` asked for with ``held``: whether the set has the id."""
    block, place = _place(F.col("id"))
    q = asked.select("set", "id", block.alias("block"), place.alias("_k"))
    return q.join(sets, ["set", "block"], "left").select("set", "id", F.coalesce(_has(F.col("bits"), F.col("_k")), F.lit(False)).alias("held"))


def put(sets: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets after single ids (``set, id, held``) are put in or taken out."""
    on, off = (of_members(changes.where(c), "set", "id") for c in ("held", "not held"))
    return union(difference(sets, off), on)


def _merged(one: DataFrame, two: DataFrame, how) -> DataFrame:
    both = one.select("set", "block", "bits").union(two.select("set", "block", "bits"))
    return both.groupBy("set", "block").agg(how("bits").alias("bits")).where("bits != 0")


def union(one: DataFrame, two: DataFrame) -> DataFrame:
    return _merged(one, two, F.bit_or)


def symmetric_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return _merged(one, two, F.bit_xor)


def intersection(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.select("set", "block", "bits").join(two.select("set", "block", F.col("bits").alias("_b")), ["set", "block"])
    return both.select("set", "block", F.col("bits").bitwiseAND(F.col("_b")).alias("bits")).where("bits != 0")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.select("set", "block", "bits").join(two.select("set", "block", F.col("bits").alias("_b")), ["set", "block"], "left")
    return both.select("set", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("long")))).alias("bits")).where("bits != 0")


def complement(sets: DataFrame, names: DataFrame, universe: DataFrame, member: str) -> DataFrame:
    """What the universe (a column of ids) has beside each set; ``names`` (``set``) tells the
    sets, empty ones included. The result has a row per set and block of the universe."""
    whole = of_members(universe.select(F.lit(0).alias("_u"), F.col(member).alias("_m")), "_u", "_m").select("block", "bits")
    every = names.select("set").distinct().crossJoin(whole)  # the size of the result
    return difference(every, sets)


def includes(one: DataFrame, two: DataFrame, names: DataFrame) -> DataFrame:
    """``set, includes``: whether the set of ``one`` holds all of that of ``two``."""
    lacking = difference(two, one).select("set").distinct().withColumn("_no", F.lit(True))
    return names.select("set").distinct().join(lacking, "set", "left").select("set", F.col("_no").isNull().alias("includes"))


def sizes(sets: DataFrame) -> DataFrame:
    """``set, n``."""
    return sets.groupBy("set").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def first(sets: DataFrame) -> DataFrame:
    """``set, id``: the smallest member."""
    low = F.min(F.struct("block", F.call_function("array_min", F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: _has(F.col("bits"), k))).alias("k"))).alias("m")
    return sets.groupBy("set").agg(low).select("set", (F.col("m.block") * WORD + F.col("m.k")).alias("id"))


def prints(sets: DataFrame) -> DataFrame:
    """``set, h1, h2``: 128 bits that name the members, whatever the order of the rows."""
    return sets.groupBy("set").agg(F.bit_xor(F.xxhash64("block", "bits")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "bits", "block")).alias("h2"))


def equal(one: DataFrame, two: DataFrame, names: DataFrame) -> DataFrame:
    """``set, equal``."""
    apart = symmetric_difference(one, two).select("set").distinct().withColumn("_no", F.lit(True))
    return names.select("set").distinct().join(apart, "set", "left").select("set", F.col("_no").isNull().alias("equal"))


def union_all(sets: DataFrame, group: str) -> DataFrame:
    """The union of the sets of each group, named by the group."""
    return sets.groupBy(F.col(group).alias("set"), "block").agg(F.bit_or("bits").alias("bits"))


def intersect_all(sets: DataFrame, group: str) -> DataFrame:
    """What all sets of a group have in common: a block counts where every one has a row."""
    n = sets.groupBy(F.col(group).alias("_g")).agg(F.count_distinct("set").alias("_n"))
    d = sets.groupBy(F.col(group).alias("set"), "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_have"))
    return d.join(n, F.col("set").eqNullSafe(F.col("_g"))).where("_have = _n and bits != 0").select("set", "block", "bits")


def listed(sets: DataFrame) -> DataFrame:
    """``set, members``: sorted ids joined by commas, for display."""
    return members(sets).groupBy("set").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("members"))


def _filled(sets: DataFrame, n: Column | int, cells: Column, zeros) -> tuple[DataFrame, Column]:
    """Sets with ``_b``, their blocks of ids 0 to n - 1 in order with the cells of each, and the
    cells of the whole set in pieces: those missing before each block, its own, and those missing
    after the last. Each block is made and met once."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    got = sets.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("block", cells.alias("cells")))).alias("_all"))
    got = got.select("set", F.filter("_all", lambda b: (b["block"] >= 0) & (b["block"] * WORD < n)).alias("_b"))
    ids, none = F.col("_b")["block"], F.lit(-1).cast("long")
    gaps = F.zip_with(F.concat(F.array(none), ids), F.concat(ids, F.array(F.shiftright(n + WORD - 1, 6))), lambda a, b: zeros(((b - a - 1) * WORD).cast("int")))
    return got, F.flatten(F.zip_with(gaps, F.col("_b")["cells"], lambda gap, own: F.array(gap, F.coalesce(own, zeros(F.lit(0))))))


def dense(sets: DataFrame, n: Column | int) -> DataFrame:
    """``set, cells``: an array of ``n`` zeros and ones for ids 0 to n - 1, put together from the
    blocks (a row of a matrix)."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: _has(F.col("bits"), k).cast("tinyint"))
    got, pieces = _filled(sets, n, cells, lambda k: F.array_repeat(F.lit(0).cast("tinyint"), k))
    return got.select("set", F.slice(F.flatten(pieces), 1, (F.lit(n) if isinstance(n, int) else n).cast("int")).alias("cells"))


def bit_strings(sets: DataFrame, n: Column | int) -> DataFrame:
    """``set, bits``: ``dense`` as text of 0 and 1."""
    got, pieces = _filled(sets, n, F.reverse(F.lpad(F.bin("bits"), WORD, "0")), lambda k: F.repeat(F.lit("0"), k))
    return got.select("set", F.substring(F.array_join(pieces, ""), F.lit(1), (F.lit(n) if isinstance(n, int) else n).cast("int")).alias("bits"))
