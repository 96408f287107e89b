"""A Merkle manifest of a dataset: one digest for the whole, one for each group, and a proof for every row.

Rows are leaves. Within a group the leaves stand in the order of their ids, and every three neighbours become a node until one is left, the group's
root; the roots of the groups, in their order, are the leaves of one more tree of the same kind, whose root stands for the dataset.

Proofs come from pointer jumping: each node holds the digests of its siblings on the way to its parent; joining the table of nodes with itself doubles the
distance and puts the two segments one after the other, so that after log2(depth) rounds each leaf holds all siblings up to the root.
In a round only nodes whose level is a multiple of the distance are still needed. The upper side of a join is broadcast if its counted bytes are few.

Positions come from a range-partitioned order, and each node is grouped with two neighbours at most, so no group of any size meets in one task. Each level is
written to the shared folder, which keeps plans short and lets work survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.llm.tables import written
from ledgerops.operators.ordered import OrderedRows

#: Neighbours that become one node.
ARITY = 3
#: The upper side of a join is broadcast up to so many bytes (counted rows times the bytes of its digests).
BROADCAST_BYTES = 8 << 20


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 in hex of the values, each as ``-`` if null and else its bytes in UTF-8, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _hex(column: Column | str) -> Column:
    return F.lower(F.hex(column))


def _node(digests: Column) -> Column:
    """Digest of a node from its children's, all binary."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), "").cast("binary"), 256))


def _levels(leaves: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Nodes of the trees in ``leaves`` (tree, pos, n, digest), level by level with their counts, and the roots (tree, root).

    A node holds ``segment``: one step (digests of the siblings to its left, and to its right) if it has a parent, else none.
    """
    here, levels, roots = leaves, [], []
    while True:
        alone = here.where("n = 1")
        up = here.where("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        up = written(up.select("tree", F.col("up").alias("pos"), "n", _node(F.col("run.digest")).alias("digest"), "run"), "merkle-level")
        side = lambda i, left: F.array_join(
            F.transform(F.filter("run", lambda r: (r["pos"] < i["pos"]) if left else (r["pos"] > i["pos"])), lambda r: _hex(r["digest"])), ""
        )
        step = lambda i: F.struct(i["pos"].alias("pos"), i["digest"].alias("digest"), F.struct(F.unhex(side(i, True)).alias("l"), F.unhex(side(i, False)).alias("r")).alias("step"))
        below = up.select("tree", F.inline(F.transform("run", step))).select("tree", "pos", "digest", F.array("step").alias("segment"))
        count = up.agg(F.count("*"), F.sum(F.size("run"))).first()
        roots.append(alone.select("tree", F.col("digest").alias("root")))
        levels.append((below, count[1] or 0))
        if not count[0]:
            break
        here = up.select("tree", "pos", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "digest")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, written(out, "merkle-roots")


def _jump(nodes: DataFrame, above: DataFrame, distance: int, rows: int) -> DataFrame:
    """``nodes`` with the segments of their ancestors ``distance`` levels up put after their own."""
    far = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("segment").alias("_more"))
    if rows * (distance * (ARITY - 1) * 32 + 64) <= BROADCAST_BYTES:
        far = F.broadcast(far)
    met = nodes.join(far, (F.col("tree") == F.col("_tree")) & (F.expr(f"pos div {ARITY ** distance}") == F.col("_pos")), "left")
    joined = F.when(F.col("_more").isNull(), F.col("segment")).otherwise(F.concat("segment", "_more"))
    return met.withColumn("segment", joined).drop("_tree", "_pos", "_more")


def _proofs(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (tree, pos, n, digest, ..) with all siblings up to the root of their tree in ``segment``, and the roots."""
    levels, roots = _levels(leaves.select("tree", "pos", "n", "digest"))
    none = F.expr("cast(array() as array<struct<l:binary,r:binary>>)")
    # a lone leaf has no parent and no step
    first = levels[0][0].select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "segment")
    out = leaves.join(first, (F.col("tree") == F.col("_tree")) & (F.col("pos") == F.col("_pos")), "left").drop("_tree", "_pos")
    out = out.withColumn("segment", F.coalesce("segment", none))
    upper = {level: nodes for level, nodes in enumerate(levels) if level and nodes[1]}
    distance = 1
    while upper:
        if distance in upper:
            out = _jump(out, upper[distance][0], distance, upper[distance][1])
        # nodes on levels that the doubled distance still meets jump as well; the others have done their part
        nodes = {level: part for level, part in upper.items() if level % (2 * distance) == 0}
        upper = {
            level: (written(_jump(part, upper[level + distance][0], distance, upper[level + distance][1]), "merkle-jump"), rows) if level + distance in upper else (part, rows)
            for level, (part, rows) in nodes.items()
        }
        distance *= 2
    return out, roots


def _placed(leaves: DataFrame) -> DataFrame:
    """``pos`` and ``n`` of each leaf in its tree, in the order of id and then digest."""
    counts = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    placed = OrderedRows.of(leaves, ["tree"], ["id", "digest"]).running_sum(pos=F.lit(1).cast("bigint")).rows
    sizes = written(counts, "merkle-sizes").withColumnRenamed("tree", "_tree")
    return placed.withColumn("pos", F.col("pos") - 1).join(sizes, F.col("tree") == F.col("_tree")).drop("_tree")


def fold(segment: Column | str, leaf: Column) -> Column:
    """The root that a leaf's digest and its siblings give, in hex."""
    return F.aggregate(segment, leaf, lambda acc, s: F.sha2(F.concat(_hex(s["l"]), acc, _hex(s["r"])).cast("binary"), 256))


def manifest(rows: DataFrame, id_col: str, group_col: str, value_cols: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: (id, leaf, subroot, root, segment) and the columns ``keep``; digests are hex text.

    ``segment`` is the proof: steps from the leaf to the root, each with the digests of the siblings to the left and to the right. A leaf is the digest of
    ``value_cols``. Groups are ordered by code point, null first and apart from empty text; ids ascend, null first; rows that repeat an id are ordered by their digest, so
    equal rows may stand either way. An empty table gives no rows. Other columns are not looked at, and ``keep`` may not use the names of the result.
    """
    keep = keep or {}
    tree = F.when(F.col(f"`{group_col}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")))
    leaves = rows.select(
        tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.unhex(leaf_digest(*[F.col(f"`{c}`") for c in value_cols])).alias("digest"), *[c.alias(n) for n, c in keep.items()]
    )
    placed = written(_placed(written(leaves, "merkle-leaves")), "merkle-placed")
    inner, roots = _proofs(placed)
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"))
    outer, top = _proofs(written(_placed(written(tops, "merkle-tops")), "merkle-tops"))
    root = top.first()
    if root is None:
        root = {"root": None}
    tops = written(outer.select(F.col("id").alias("_tree"), F.col("digest").alias("subroot"), F.col("segment").alias("_more")), "merkle-tops")
    found = inner.join(tops, F.col("tree") == F.col("_tree"))
    return found.select(
        F.col("id").alias(id_col), _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), F.lit(root["root"].hex() if root["root"] else None).cast("string").alias("root"),
        F.concat("segment", "_more").alias("segment"), *keep,
    )


def verified(documents: DataFrame) -> DataFrame:
    """The contract's columns: proofs of all documents, and the roots that their (partly tampered) leaves give with them.

    Where the CRC-32 of the decimal id is even, the leaf is made from the text without its line feeds; a null id has no CRC and is left as it is.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    changed = F.when(even & F.contains("text", F.lit("\n")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = F.when(even & F.contains("text", F.lit("\n")), F.unhex(leaf_digest(*[F.col(c) for c in names[:-1]], changed)))
    rows = manifest(documents, "doc_id", "source", names, {"_now": tampered})
    proof = F.sha2(F.array_join(F.transform("segment", lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))), "").cast("binary"), 256)
    folded = fold("segment", F.coalesce(_hex("_now"), F.col("leaf")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
