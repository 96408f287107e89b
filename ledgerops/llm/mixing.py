"""Mixing sources to target weights, by a splitting tree with exact quotas.

Each source's documents are laid on a line in a permuted order, and the mix takes its target from the line's start, over the line again where the target is
larger. A source's target is cut into blocks; which output shard takes how many blocks of each source is settled by a tree: a node holds a range of shards and
blocks of all sources, and half its shards draw half its blocks at random, without replacement, so each child's count per source follows the multivariate
hypergeometric distribution and all counts add up exactly. The shards then take disjoint runs of each source's blocks, and order their documents by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerops.llm.tables import fresh, small, written

WEIGHTS = (5, 2, 1)
#: Most repeats of a source; blocks in the whole mix, about; output shards (a power of two); documents in one cell of a line.
MOST, BLOCKS, SHARDS, CELL = 3, 4096, 16, 5000
#: Words that a shard of the written mix should hold, about.
SHARD_WORDS = 16_000_000
_WHITE = "\\x20\\t\\n\\x0B\\f\\r"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    words = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(words), F.lit(0)) == 0, 0).otherwise(F.size(F.split(words, f"[{_WHITE}]+"))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Weights repeat over the sources in the order of their names, null last. All targets add up to all sizes; none is above ``most`` times its source's size, and
    what such caps leave over is shared by weight again. With a level L each target is min(most * size, weight * L): sources are capped in the
    order of size by weight, and L follows from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    all_of = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(all_of))
    rest = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", rest / open_weight)
    # the first source, in the order of capping, that the level left for it does not fill
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_of)["level"]
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """(source, shard, lo, hi): which of its ``blocks`` (lo to hi - 1) each shard takes of a source, from (source, blocks).

    One row per block and log2(shards) draws: at each node the blocks are ranked by a hash, and the first half goes left.
    """
    slots = quotas.where("blocks > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot")).withColumn("shard", F.lit(0))
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    for level in range(levels):
        node = Window.partitionBy("shard")
        drawn = node.orderBy(F.xxhash64("source", "slot", F.lit(seed), F.lit(level)), "source", "slot")
        slots = slots.withColumn("shard", F.col("shard") * 2 + (F.row_number().over(drawn) * 2 > F.count("*").over(node) + 1).cast("int"))
    counts = slots.groupBy("source", "shard").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return counts.select("source", "shard", (upto - F.col("n")).alias("lo"), upto.alias("hi"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and targets, and the places of all copies the mix takes.

    First (row, id, text_hash, size, source, source_size, target), a row for each row of ``docs``; second (row, pass, shard, place), one for each copy, to be ordered by place in its shard.
    A document of the line's first ``target`` words is taken in pass 0, and so on; one that the end of the target cuts is taken if the cut leaves its middle inside, so a
    source's taken words differ from its target by half a document at most. Texts without words have size 0 and are taken as often as their place says. A null
    source is a source of its own. Rows that repeat an id are documents of their own; equal rows lie next to each other on the line.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
    )
    sized = sized.withColumn("place", F.xxhash64("id", "text_hash", F.lit(seed)))
    sized = written(sized.select("id", "source", "size", "place", "text_hash"), "sized")
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    goal = written(targets(per_source.select("source", "source_size"), weights), "targets")
    n = per_source.agg(F.sum("n"), F.sum("source_size"), F.count("*")).first()
    cells = 1 + (n[0] or 0) // CELL
    block = max(1.0, (n[1] or 0) / max(BLOCKS, 32 * shards))

    # places on the line: sums of cells of hash values first, then within each cell
    cell = F.pmod(F.shiftright("place", 20), F.lit(cells))
    rows = sized.withColumn("cell", cell)
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    ahead = F.coalesce(F.sum("in_cell").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(per_cell.withColumn("ahead", ahead).drop("in_cell"), "cells")
    inside = Window.partitionBy("source", "cell").orderBy("place", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    lined = lined.join(small(starts, starts.count()), same(lined, starts) & (lined["cell"] == starts["cell"])).select(lined["*"], (starts["ahead"] + lined["inside"]).alias("start"))
    goal_side = small(goal, n[2] or 0)
    lined = lined.join(goal_side, same(lined, goal)).select(lined["*"], goal["source_size"], goal["target"])
    lined = lined.withColumn("row", F.monotonically_increasing_id())
    lined = written(lined.select("row", "id", "text_hash", "size", "source", "source_size", "target", "start", "place"), "lined")

    middle = F.col("start") + F.col("size") / 2.0
    passes = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - middle) / F.col("source_size"))).otherwise(0)
    passes = F.greatest(F.lit(0), F.least(F.lit(MOST), passes)).cast("int")
    copies = lined.withColumn("pass", F.explode(F.when(passes > 0, F.sequence(F.lit(0), passes - 1)))).withColumn(
        "block", F.floor((F.col("pass") * F.col("source_size") + F.col("start")) / block).cast("long")
    )
    quotas = goal.select("source", F.ceil(F.col("target") / block).cast("long").alias("blocks"))
    tree = written(split(quotas, shards, seed), "tree")
    # a run of blocks per source and shard: shards x sources rows; the block decides the run
    runs = tree.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lo", "shard", "hi"))).alias("runs"))
    runs = small(runs, n[2] or 0)
    placed = copies.join(runs, same(copies, runs), "left").select(copies["*"], "runs")
    own = F.filter("runs", lambda r: (r.lo <= F.col("block")) & (F.col("block") < r.hi))
    last = F.element_at("runs", -1)
    shard = F.coalesce(F.try_element_at(own, F.lit(1))["shard"], last["shard"], F.lit(0))
    places = placed.select("row", "pass", shard.alias("shard"), F.xxhash64("place", "pass", F.lit(seed + 1)).alias("place"))
    return lined.select("row", "id", "text_hash", "size", "source", "source_size", "target"), places


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source, source_size, target, taken) for each row of ``docs``: taken are the words of all copies that the mix places."""
    rows, places = mix(docs, id_col, text_col, source_col, **options)
    times = places.groupBy("row").agg(F.count("*").alias("times"))
    out = rows.join(times, "row", "left")
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))


def shards_for(words: int) -> int:
    """Shards for a mix of so many words: a power of two, ``SHARDS`` at least."""
    return max(SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with the same columns; rows are dealt by shard and ordered within it.

    Of rows that are equal in id, text and source, one stands for all, and comes as often as the mix takes them together. Unless ``shards`` is given, their number
    grows with the words (``shards_for``); each shard is one partition.
    """
    if "shards" not in options:
        options["shards"] = shards_for(docs.agg(F.sum(word_count(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0)
    rows, places = mix(docs, id_col, text_col, source_col, **options)
    # rows that are not taken count too: the mix may take some of several equal rows
    each = rows.select("row", "id", "source", "text_hash").join(places, "row", "left")
    place = F.when(F.col("place").isNotNull(), F.struct("shard", "place"))
    each = each.groupBy("id", "source", "text_hash").agg(F.collect_list(place).alias("places"), F.countDistinct("row").alias("n"))
    wanted = written(each.where(F.size("places") > 0), "wanted")
    mark = fresh("mix", docs.columns)
    names = {c: f"{mark}_{c}" for c in wanted.columns}
    own = {"id": F.col(f"`{id_col}`"), "source": F.col(f"`{source_col}`").cast("string"), "text_hash": F.xxhash64(F.col(f"`{text_col}`"))}
    on = None
    for c, value in own.items():
        on = value.eqNullSafe(F.col(names[c])) if on is None else on & value.eqNullSafe(F.col(names[c]))
    repeated = wanted.where("n > 1")
    full = docs.join(small(wanted.where("n = 1").withColumnsRenamed(names), wanted.count()), on)
    if not repeated.isEmpty():
        twice = docs.join(repeated.withColumnsRenamed(names), on)
        full = full.unionByName(twice.dropDuplicates([names["id"], names["source"], names["text_hash"]]))
    out = full.withColumn(mark, F.explode(names["places"])).repartitionById(options["shards"], F.col(f"{mark}.shard")).sortWithinPartitions(f"{mark}.shard", f"{mark}.place")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
