"""Merkle manifest of a dataset: a persistent tree whose versions copy only paths.

Each row is a leaf; the leaves of a group (say a source) in key order make one tree, every FAN nodes in a row
one parent; the groups' roots, in group order, make one more tree.  A tampered leaf makes a version of the
manifest: new nodes for the leaf and its ancestors, everything else shared with the base version.

1. Leaves are numbered within their group by a range sort on (group, key, digest): a large group takes many
   partitions.  Only digests are shuffled, never texts.
2. ``BLOCK`` = FAN ** HEIGHT numbered nodes make an aligned block, one row; its inner nodes are hashed there.
   The blocks' tops are the nodes of the next round, until each tree is down to one block: log(n) / log(BLOCK)
   rounds, each BLOCK times smaller.
3. On the way back each block learns the siblings between its top and the root (FAN - 1 digests a level).
4. A version copies the ancestors of its leaf inside the leaf's block first; the copied top then goes on along
   the siblings that the block learned.  Versions stay with their block, at most BLOCK of them, however
   many the dataset has.

Cases: null fields are written as such, so every row has a leaf; a null group is a group of its own and
comes first; null keys come first, rows with equal keys go by digest, so repeated rows are neighbours and it doesn't
matter which is which; an empty table gives no rows; a tree of one leaf has that leaf as its root.  The key, group, and
field columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsift.llm.shared import written

FAN = 16
HEIGHT = 2                       # levels of a block
BLOCK = FAN ** HEIGHT


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts one after the other (digests as hex text)."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _numbered(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0 in its tree, by ``order``) and ``n`` (the tree's rows)."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(tree).asc(), *[F.col(o).asc() for o in order]]
    # The partition ids are written with the rows: a lost task can't deal them anew.
    cut = written(rows.repartitionByRange(ranges, *keys).withColumn("_part", F.spark_partition_id()), name)
    parts = cut.groupBy(tree, "_part").agg(F.count("*").alias("_rows"))
    # One row a tree and partition it lies in: partitions + trees rows.
    line = Window.partitionBy(tree).orderBy("_part")
    parts = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_p"),
                         (F.sum("_rows").over(line) - F.col("_rows")).alias("_before"),
                         F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    inside = Window.partitionBy("_part", tree).orderBy(*[F.col(o).asc() for o in order])
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    on = ranked[tree].eqNullSafe(parts["_tree"]) & (ranked["_part"] == parts["_p"])
    return (ranked.join(parts, on).withColumn("pos", F.col("_rank") + F.col("_before"))
            .drop("_part", "_rank", "_tree", "_p", "_before"))


def _parents(nodes: Column) -> Column:
    """Digests of every FAN nodes."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1),
                       lambda g: digest(F.array_join(F.slice(nodes, g * FAN + 1, FAN), "")))


def _blocks(nodes: DataFrame, tree: str, carried: Sequence[str]) -> DataFrame:
    """Nodes (tree, pos, n, digest, carried) -> one row a block: members, l0 to l2 (nodes by level), levels, top."""
    own = F.struct("pos", "digest", *carried)
    out = (nodes.groupBy(tree, F.floor(F.col("pos") / BLOCK).alias("block"))
           .agg(F.array_sort(F.collect_list(own)).alias("members"), F.first("n").alias("n")))
    out = out.withColumn("l0", F.col("members.digest"))
    for h in range(1, HEIGHT):
        out = out.withColumn(f"l{h}", _parents(F.col(f"l{h - 1}")))
    # The tree's only block ends where one node is left; others have all their levels.
    levels = F.when(F.col("n") > BLOCK, HEIGHT)
    for h in range(HEIGHT):
        levels = levels.when(F.col("n") <= FAN ** h, h)
    levels = levels.otherwise(HEIGHT)
    out = out.withColumn("levels", levels.cast("int"))
    top = _parents(F.col(f"l{HEIGHT - 1}"))[0]
    for h in reversed(range(HEIGHT)):
        top = F.when(F.col("levels") == h, F.col(f"l{h}")[0]).otherwise(top)
    return out.withColumn("top", top)


def _steps(place: Column) -> Column:
    """Siblings on the path of the block's member number ``place`` to the block's top: (left, right) a level."""
    out = []
    for h in range(HEIGHT):
        nodes, at = F.col(f"l{h}"), F.floor(place / FAN ** h).cast("int")
        head = (F.floor(at / FAN) * FAN).cast("int")
        step = F.struct(F.array_join(F.slice(nodes, head + 1, at - head), "").alias("left"),
                        F.array_join(F.slice(nodes, at + 2, head + FAN - at - 1), "").alias("right"))
        none = F.array().cast("array<struct<left: string, right: string>>")
        out.append(F.when(F.col("levels") > h, F.array(step)).otherwise(none))
    return F.concat(*out)


def _placed(blocks: DataFrame, *columns: Column) -> DataFrame:
    """One row a member: ``columns``, the member ``m`` and its siblings up to the root.

    The block's nodes stay in the block's row; only what a member needs leaves it.
    """
    each = F.transform("members", lambda m, at: F.struct(m.alias("m"), F.concat(_steps(at), "up").alias("siblings")))
    return blocks.select(*columns, F.explode(each).alias("x")).select(
        *[F.col(c) for c in blocks.select(*columns).columns], "x.m", "x.siblings")


def _climb(nodes: DataFrame, tree: str, carried: Sequence[str], name: str) -> list[DataFrame]:
    """Rounds of blocks, the leaves' first; each later round has the tops of the trees that still had several blocks."""
    rounds = []
    while True:
        blocks = written(_blocks(nodes, tree, carried if not rounds else ["child"]), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        more = blocks.where(F.col("n") > BLOCK)
        if more.isEmpty():
            return rounds
        nodes = more.select(tree, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
                            F.col("top").alias("digest"), F.col("block").alias("child"))


def _roots(rounds: list[DataFrame], tree: str) -> DataFrame:
    """(tree, subroot): the top of each tree's last block."""
    out = None
    for blocks in rounds:
        own = blocks.where(F.col("n") <= BLOCK).select(tree, F.col("top").alias("subroot"))
        out = own if out is None else out.unionByName(own)
    return out


def _descend(rounds: list[DataFrame], tree: str, above: DataFrame, name: str) -> DataFrame:
    """Blocks of the first round with ``up``: the siblings from the block's top to the root.

    ``above``: (tree, up) of each whole tree.
    """
    above = above.select(F.col(tree).alias("_t"), "up")
    learned = None                               # (_t, _b, up) of the blocks of the round below
    for k in reversed(range(len(rounds))):
        blocks = rounds[k]
        last = blocks.where(F.col("n") <= BLOCK)
        out = last.join(above, last[tree].eqNullSafe(above["_t"])).drop("_t")
        if learned is not None:
            more = blocks.where(F.col("n") > BLOCK)
            on = more[tree].eqNullSafe(learned["_t"]) & (more["block"] == learned["_b"])
            out = out.unionByName(more.join(learned, on).drop("_t", "_b"))
        if k:
            below = _placed(out, F.col(tree).alias("_t"))
            learned = written(below.select("_t", F.col("m.child").alias("_b"), F.col("siblings").alias("up")), f"{name}-learned-{k}")
    return out


def _fold(node: Column, steps: Column) -> Column:
    """All nodes that a version copies above ``node``, up to its root."""
    start = F.array(node)
    return F.aggregate(steps, start, lambda made, s: F.concat(
        made, F.array(digest(s["left"], F.element_at(made, -1), s["right"]))))


def manifest(docs: DataFrame, group: str, key: str, values: Sequence[str], tampered: Column, altered: dict[str, Column],
             ) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes): the manifest of ``docs`` and of its versions.

    A leaf hashes the columns ``values``.  Rows for which ``tampered`` holds make a version in which the columns
    of ``altered`` have those values.

    leaves: key, leaf, subroot, root, siblings (left and right texts, a level each), version (the nodes that
    the row's version copies: its leaf, then the ancestors up to the root; null where nothing was tampered),
    folded_root (the version's root, else the root folded from the leaf).  nodes: tree ("group" or "root"),
    group, round, block, level, at, digest: the base version's nodes inside blocks, for reading the shared ones.
    """
    rows = docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), leaf(*[F.col(v) for v in values]).alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)),
               leaf(*[altered.get(v, F.col(v)) for v in values])).alias("own"))
    numbered = _numbered(rows, "grp", ["key", "digest"], "leaves")
    rounds = _climb(numbered, "grp", ["key", "own"], "blocks")
    subroots = _roots(rounds, "grp").withColumn("whole", F.lit(0))
    top = _climb(_numbered(subroots.withColumnRenamed("subroot", "digest"), "whole", ["grp"], "subroots"),
                 "whole", ["grp"], "subroot-blocks")
    root = top[-1].where(F.col("n") <= BLOCK).select(F.col("whole").alias("_w"), F.col("top").alias("root"))
    none = F.array().cast("array<struct<left: string, right: string>>")
    placed = _descend(top, "whole", top[-1].select("whole", none.alias("up")).distinct(), "root")
    above = _placed(placed, F.col("whole")).select(
        F.col("m.grp").alias("grp"), F.col("m.digest").alias("subroot"), "whole", F.col("siblings").alias("up"))
    above = written(above.join(F.broadcast(root), F.col("whole") == F.col("_w")).drop("whole", "_w"), "groups")
    told = _descend(rounds, "grp", above.select("grp", "up"), "groups")
    ends = above.select(F.col("grp").alias("_g"), "subroot", "root")
    told = told.join(ends, told["grp"].eqNullSafe(ends["_g"])).drop("_g")
    each = _placed(told, F.col("subroot"), F.col("root")).withColumn(
        "path", _fold(F.coalesce(F.col("m.own"), F.col("m.digest")), F.col("siblings")))
    leaves = each.select(F.col("m.key").alias(key), F.col("m.digest").alias("leaf"), "subroot", "root", "siblings",
                         F.when(F.col("m.own").isNotNull(), F.col("path")).alias("version"),
                         F.element_at("path", -1).alias("folded_root"))
    return leaves, _nodes(rounds, "grp", "group").unionByName(_nodes(top, "whole", "root"))


def _nodes(rounds: list[DataFrame], tree: str, name: str) -> DataFrame:
    out = None
    for k, blocks in enumerate(rounds):
        levels = F.array(*[F.col(f"l{h}") for h in range(HEIGHT)], F.array("top"))
        # The nodes of a block's levels, without the empty ones above the root of a small tree.
        own = blocks.select(F.lit(name).alias("tree"), F.col(tree).cast("string").alias("group"), F.lit(k).alias("round"), "block",
                            F.posexplode(F.slice(levels, 1, F.col("levels") + 1)).alias("level", "made"))
        own = own.select("tree", "group", "round", "block", "level", F.posexplode("made").alias("at", "digest"))
        out = own if out is None else out.unionByName(own)
    return out


def proof(siblings: Column) -> Column:
    """One digest of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""))
