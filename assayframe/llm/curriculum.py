"""Mixing sources to target weights along a time-varying curriculum.

Token targets come from weights by water-filling: sources share the budget by
weight, none gets more than ``cap`` times its size, and what a source can't take
is shared again by weight.  The bulk of what is taken follows from prefix sums
of sizes in a pseudo-random order that depends on the ids alone: all documents
as often as the target holds the whole source, then a prefix once more, at whose
end documents that would overrun are skipped.  What is then left is settled exactly over at most ``SETTLED`` documents of
each source, in turn from every size class (powers of two): each of them may be
taken any number of times up to ``cap``, and of all these choices the one nearest
to the target wins.  All choices are met in the middle: the sums of the first
half, sorted with those of the second, give the best partner of each.

A source's weight over training time is a schedule of (time, weight) knots,
linear in between.  Its integral, scaled to what the source brings, is the
source's cumulative token demand; a document's place in its source's stream of
words is inverted through it to a training position in [0, 1], and documents are
range-sorted by position.  The stream is passed once for each copy: a document
taken twice is in the first and the second pass, each in the order of the ids.

Prefix sums never bring a source into one task: rows are dealt into buckets by
hash, buckets are summed with map-side combining, the running sums over buckets
(one row for each source and bucket) are added to those within each bucket.
Everything is DataFrame expressions.  A source costs ``(cap + 1) ** (SETTLED /
2)`` rows twice while it is settled, whatever its size; targets and ordinals are
windows over one row a source.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are never taken; rows that repeat an id are
documents of their own, in the order of their sizes and marks.  A source may end
above its target if that is nearer; of equally near choices the lower, then the
first in the order of the choices, wins.  Empty table, empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, row_mark, stored, with_row_key

#: Rows that a bucket of the hottest source may have to sort, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256
#: Documents of a source that are free to settle what its prefix leaves of the target.
SETTLED = 14
#: Documents behind a source's part that are looked at for some that still fit, and how many may be skipped.
FOLLOWING, SKIPS = 64, 16
#: Sources whose few columns may be sent to every executor.
BROADCAST_SOURCES = 10_000
#: The curriculum of the registered query: schedules that sources follow in turn.
STEADY, EARLY, LATE = [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.6), (0.5, 1.0), (1.0, 0.4)], [(0.0, 0.4), (0.5, 1.0), (1.0, 1.6)]


def token_targets(sources: DataFrame, weights: list[float], budget_ratio: float, cap: float) -> DataFrame:
    """Adds ``ordinal``, ``weight`` and ``target`` to sources (source, source_size), one row a source.

    In order of cap against weight, a source is capped exactly if its cap is at
    most its share of what the capped ones before it leave.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("ordinal") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "ordinal")
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio)))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("most") * F.col("weights_left") <= F.col("weight") * (F.col("budget") - F.col("before")))
    )
    open_ = ~F.col("capped")
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))) / F.sum(F.when(open_, F.col("weight"))).over(everything)
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * level)).select("source", "source_size", "ordinal", "weight", "target")


def segments(schedule: list[tuple[float, float]]) -> Column:
    """A schedule's linear pieces with the share of its integral up to each end."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas):
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("w0", w0), ("t1", t1), ("w1", w1), ("c0", done / total), ("c1", (done + area) / total), ("area", total))]))
        done += area
    return F.array(*out)


def positions(shares: Column, pieces: Column) -> Column:
    """The training times by which a schedule's integral has reached each of ``shares`` of its whole."""

    def piece(share: Column) -> Column:
        own = F.coalesce(F.get(F.filter(pieces, lambda p: share <= p["c1"]), F.lit(0)), F.element_at(pieces, -1))
        return F.struct(share.alias("share"), own.alias("s"))

    def terms(at: Column) -> Column:
        s = at["s"]
        x = F.greatest((at["share"] - s["c0"]) * s["area"], F.lit(0.0))
        slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
        return F.struct(x.alias("x"), slope.alias("slope"), s["w0"].alias("w0"), s["t0"].alias("t0"), s["t1"].alias("t1"))

    def time(k: Column) -> Column:
        # x = w0 * dt + slope * dt^2 / 2, solved without cancellation and without division by a slope of 0
        root = F.sqrt(F.greatest(k["w0"] * k["w0"] + 2 * k["slope"] * k["x"], F.lit(0.0)))
        return F.least(k["t0"] + F.when(k["x"] > 0, 2 * k["x"] / (k["w0"] + root)).otherwise(F.lit(0.0)), k["t1"])

    return F.transform(F.transform(F.transform(shares, piece), terms), time)


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    right = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix(
    docs: DataFrame,
    weights: list[float],
    budget_ratio: float = 1.5,
    cap: float = 2.0,
    schedules: list[list[tuple[float, float]]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, copies (0 to ``cap``), taken, positions (one a copy) and, of a ``row_col``, ``key``.

    ``row_col`` is a column of strings that tells rows apart.
    """
    schedules, also = schedules or [STEADY], ["key"] if row_col else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_mark(F.col(text_col), F.col(id_col).cast("long"), F.col(source_col).cast("string")).alias("mark"),
        *[F.col(row_col).alias(x) for x in also],
    )
    rows = stored(rows.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = stored(sources, "mix-sources")
    facts = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("hottest")).first()
    few = facts["sources"] <= BROADCAST_SOURCES
    buckets = max(LEAST_BUCKETS, (facts["hottest"] or 0) // BUCKET_ROWS)
    pieces = F.array(*[segments(x) for x in schedules])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = (
        token_targets(sources.drop("n"), weights, budget_ratio, cap)
        .withColumn("rounds", F.floor(ratio + 1e-12).cast("int"))
        .withColumn("part", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumn("pieces", F.element_at(pieces, ((F.col("ordinal") - 1) % len(schedules) + 1).cast("int")))
    )
    goals = stored(goals, "mix-goals")

    # Prefix sums: buckets by the leading digits of "turn", in its order.
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets).cast("int")
    rows = rows.withColumn("bucket", bucket)
    through = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("start", F.coalesce(F.sum("in_bucket").over(through), F.lit(0)))
    starts = stored(starts.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "start"), "mix-starts")
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "mark", *also).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("through", F.sum("size").over(within))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket"))).drop("__source", "__bucket")
    placed = placed.withColumn("through", F.col("through") + F.col("start")).drop("start", "bucket", "turn")
    placed = _with_sources(placed, goals.select("source", "source_size", "target", "rounds", "part"), few)
    placed = stored(placed.select("doc_id", "source", "size", "source_size", "target", "rounds", "part", "through", *also), "mix-placed")

    # Where the prefix ends, what it then leaves of each target, and the documents that change for it.
    ends = stored(cuts(placed), "mix-cuts")
    most = max(1, math.ceil(cap))
    based = _with_sources(placed.drop("part"), goals.select("source", "part", "pieces").join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), few)
    cut, skipped = F.coalesce("cut", "part"), F.coalesce("skipped", F.array().cast(SKIPPED))
    based = based.withColumns({"cut": cut, "skipped": skipped})
    extra = (F.col("size") > 0) & (F.col("through") <= F.col("cut")) & ~F.exists("skipped", lambda d: d["through"] == F.col("through"))
    based = based.withColumn("base", F.when(F.col("size") > 0, F.col("rounds") + extra.cast("int")).otherwise(F.lit(0)))
    prefix = F.coalesce(F.sum(F.when(F.col("base") > F.col("rounds"), F.col("size"))), F.lit(0))
    left = stored(based.groupBy("source").agg(prefix.alias("prefix"), (F.max("part") - prefix).alias("rest"), F.max("source_size").alias("source_size"), F.max("rounds").alias("rounds")), "mix-left")
    changed = stored(settled(based, left, most, few), "mix-changed")
    facts = left.select("source", "prefix", "source_size", "rounds").join(changed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    facts = _passes(facts.withColumn("changes", F.coalesce("changes", F.array().cast(CHANGES))))
    facts = stored(facts.select("source", "prefix", "changes", "starts"), "mix-facts")
    return _positions(_with_sources(based, facts, few)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", *also)


SKIPPED = "array<struct<through: bigint, size: bigint>>"
CHANGES = "array<struct<through: bigint, size: bigint, base: int, copies: int>>"


def cuts(placed: DataFrame) -> DataFrame:
    """source, cut and skipped: where a source's prefix ends once documents that would overrun its part are left out.

    The ``FOLLOWING`` documents at the end of the part are met in order.  One that
    doesn't fit is skipped, and those behind it move up.
    """
    docs = placed.where((F.col("size") > 0) & (F.col("through") > F.col("part"))).select("source", "through", "size", "part")
    docs = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("through"))).where(F.col("nth") <= FOLLOWING)
    docs = docs.groupBy("source").agg(F.max("part").alias("part"), F.sort_array(F.collect_list(F.struct("through", "size"))).alias("docs"))

    def meet(done: Column, d: Column) -> Column:
        over = (d["through"] > done["cut"]) & (F.size(done["skipped"]) < SKIPS)
        one = F.array(F.struct(d["through"].alias("through"), d["size"].alias("size")))
        return F.struct(
            F.when(over, done["cut"] + d["size"]).otherwise(done["cut"]).alias("cut"),
            F.when(over, F.concat(done["skipped"], one)).otherwise(done["skipped"]).alias("skipped"),
        )

    start = F.struct(F.col("part").cast("double").alias("cut"), F.array().cast(SKIPPED).alias("skipped"))
    return docs.select("source", F.aggregate("docs", start, meet).alias("end")).select("source", "end.cut", "end.skipped")


def settled(placed: DataFrame, left: DataFrame, most: int, few: bool) -> DataFrame:
    """source and ``changes``: the documents that are taken other than ``base`` times so that ``rest`` is met most nearly.

    ``placed`` has source, size, through (distinct for each document of a source)
    and base; ``left`` has source and rest.  Sources whose rest no whole number of
    words betters have no row.
    """
    choices = most + 1
    half = max(1, int(math.log(3 ** (SETTLED // 2) + 1) / math.log(choices)))
    open_ = left.where(F.abs("rest") > 0.5).select("source", "rest")
    docs = placed.where("size > 0").select("source", "size", "through", "base")
    right = open_.withColumnRenamed("source", "__source")
    docs = docs.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    docs = docs.withColumn("class", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    # The first few of each class and number of copies: the planner limits each task's rows before they are dealt.
    docs = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source", "class", "base").orderBy("through"))).where(F.col("nth") <= 2 * half)
    # In turn those that the prefix has and those that it lacks, so that the rest can be neared from either side.
    beyond = (F.col("class") > F.floor(F.log2(F.abs("rest"))) + 1).cast("int")
    docs = docs.withColumn("turn", F.row_number().over(Window.partitionBy("source", "base").orderBy(beyond, "nth", F.col("class").desc())))
    docs = docs.withColumn("slot", F.row_number().over(Window.partitionBy("source").orderBy("turn", "base"))).where(F.col("slot") <= 2 * half)
    side, place = (F.col("slot") % 2).cast("int"), F.floor((F.col("slot") - 1) / 2).cast("int")
    unit = F.pow(F.lit(float(choices)), place).cast("long")
    # "unit" is what a document's copies count for in the number that names a choice.
    entry = F.struct("slot", side.alias("side"), unit.alias("unit"), "through", "size", F.col("base").cast("int").alias("base"))
    groups = stored(docs.groupBy("source").agg(F.max("rest").alias("rest"), F.sort_array(F.collect_list(entry)).alias("docs")), "mix-free")

    digit = lambda code, d: F.floor(code / d["unit"]) % choices
    sides = groups.select("source", "rest", "docs", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    own = sides.select("source", "rest", "side", F.filter("docs", lambda d: d["side"] == F.col("side")).alias("docs"))
    codes = own.withColumn("code", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(float(choices)), F.size("docs")).cast("long") - 1)))
    total = F.aggregate("docs", F.lit(0).cast("long"), lambda acc, d: acc + (digit(F.col("code"), d) - d["base"]) * d["size"])
    sums = codes.select("source", "rest", "side", total.alias("sum"), "code").groupBy("source", "rest", "side", "sum").agg(F.min("code").alias("code"))
    # Sums of one side, and what each of the other's leaves, in one order: neighbours are the nearest.
    one = F.col("side") == 1
    line = sums.withColumn("value", F.when(one, F.col("sum").cast("double")).otherwise(F.col("rest") - F.col("sum")))
    line = line.withColumn("partner", F.when(one, F.struct("sum", "code")))
    upward, downward = (Window.partitionBy("source").orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (("value", F.col("side").desc()), (F.col("value").desc(), "side")))
    below, above = F.last("partner", True).over(upward), F.last("partner", True).over(downward)
    near = line.withColumns({"below": below, "above": above}).where(~one)
    miss = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col("value") - F.col(f"{c}.sum")), 6).alias("miss"), F.lit(c == "above").alias("over"), F.col("code").alias("left"), F.col(f"{c}.code").alias("right")))
    best = near.groupBy("source").agg(F.min(F.least(miss("below"), miss("above"))).alias("best")).withColumnRenamed("source", "__source")
    met = groups.join(best, F.col("source").eqNullSafe(F.col("__source")))
    copies = lambda d: digit(F.when(d["side"] == 0, F.col("best.left")).otherwise(F.col("best.right")), d).cast("int")
    changes = F.transform("docs", lambda d: F.struct(d["through"].alias("through"), d["size"].alias("size"), d["base"].alias("base"), copies(d).alias("copies")))
    return met.select("source", F.filter(changes, lambda d: d["copies"] != d["base"]).alias("changes"))


def _words(copies: Column, base: Column, size: Column, j: Column) -> Column:
    """What a changed document adds to pass j."""
    return ((copies > j).cast("long") - (base > j).cast("long")) * size


def _passes(told: DataFrame) -> DataFrame:
    """Adds ``starts`` to sources: the words before each pass of the stream, and behind the last."""
    count = F.greatest(F.col("rounds") + 1, F.coalesce(F.array_max(F.transform("changes", lambda d: d["copies"])), F.lit(0)))
    whole = lambda j: F.when(j < F.col("rounds"), F.col("source_size")).when(j == F.col("rounds"), F.col("prefix")).otherwise(F.lit(0))
    more = lambda j: F.aggregate("changes", F.lit(0).cast("long"), lambda acc, d: acc + _words(d["copies"], d["base"], d["size"], j))
    words = F.transform(F.sequence(F.lit(0), count - 1), lambda j: whole(j) + more(j))
    none = F.array(F.lit(0).cast("long"))
    return told.withColumn("starts", F.aggregate(words, none, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))))


def _positions(told: DataFrame) -> DataFrame:
    """Adds copies and positions, from base, through, rounds, skipped, prefix, changes, starts and pieces.

    Pass j of a source's stream holds the documents that are taken more than j
    times; the few that changed are corrected for one by one.
    """
    own = F.filter("changes", lambda d: d["through"] == F.col("through"))
    copies = F.when(F.col("size") > 0, F.coalesce(F.get(own, F.lit(0))["copies"], F.col("base"))).otherwise(F.lit(0))
    jumped = F.aggregate("skipped", F.lit(0).cast("long"), lambda acc, d: acc + F.when(d["through"] <= F.col("through"), d["size"]).otherwise(F.lit(0)))
    last = F.least(F.col("through") - jumped, F.col("prefix"))
    within = lambda j: F.when(j < F.col("rounds"), F.col("through")).when(j == F.col("rounds"), last).otherwise(F.lit(0))
    before = lambda d: d["through"] <= F.col("through")
    more = lambda j: F.aggregate("changes", F.lit(0).cast("long"), lambda acc, d: acc + F.when(before(d), _words(d["copies"], d["base"], d["size"], j)).otherwise(F.lit(0)))
    told = told.withColumn("copies", copies)
    turns = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    share = lambda j: F.least((F.get("starts", j) + within(j) + more(j) - F.col("size") / 2) / F.element_at("starts", -1), F.lit(1.0))
    return told.withColumn("positions", positions(F.transform(turns, share), F.col("pieces")))


def training_order(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` (with these options) takes, each as often as it is taken, range-sorted by position.

    Files written from it are in that order by name, and rows inside them.
    """
    keyed, row = with_row_key(docs)
    place = free_name(keyed.columns, "place")
    mixed = mix(keyed, weights, row_col=row, **options).where("copies > 0").select(F.col("key").alias(row), F.explode("positions").alias(place))
    taken = keyed.join(mixed.hint("merge"), row)
    return taken.orderBy(place, row).select(*docs.columns)
