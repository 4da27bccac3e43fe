"""Operator 12: a Merkle manifest of the dataset, built with lag and lead windows.

Every row is a leaf, the hash of its columns. The leaves of a group (its lang)
stand in doc_id order; while a group has more than one node, every ``ARITY``
consecutive nodes become their hash (the last run may be shorter, even one node).
What remains is the group's subroot; the subroots in group order make the
root in the same way.

A level is one window over a chunk of ARITY ** ``LEVELS`` consecutive nodes: the
first row of each run holds the node, the node's neighbours are lag and lead
columns at fixed offsets, masked by the node's slot in its run and by the run's
length, and the row of the first child hashes the parent. The last level's
nodes are the rows of the next tier. A chunk has a bounded number of rows, so a
group with a third of all rows is as many tasks as it has chunks, and the chunk's
siblings above are looked up per chunk, not per group. All of it is DataFrame functions.

Positions come from one range sort of the leaves (digests, not texts) by group
and doc_id, whose partitions count their rows per group.

Cases: null columns are ``-`` in a leaf, so null and empty texts differ; a null group
comes first, a null doc_id first in its group; rows that share a doc_id go
by leaf; rows equal throughout are leaves each; an empty table gives no rows; extra
columns, also ones named like the result's, are not part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
LEVELS = 10  # of a chunk: at arity 2 a window of 1,024 rows
TAMPER_MOD = 7
SIBLINGS = "array<struct<left:string,right:string>>"


def H(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return H(*map(field, columns))


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``n`` (rows) within ``group``, in ``order``.

    One range sort; a partition's part of a group is numbered where it stands
    and moved by the rows of the group in the partitions before it. ``rows`` is read
    twice (ranges are found on a sample of it), so it should be a written table.
    """
    # rows equal throughout still spread over partitions by where they were read
    keys = [group, *order, "scan"]
    rows = rows.withColumn("scan", F.monotonically_increasing_id())
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()).drop("scan"), name)
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy(part, F.col(group).alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("many"))
    here = Window.partitionBy("of")
    runs = runs.select("part", "of", "first", F.sum("many").over(here).alias("n"),
                       (F.sum("many").over(here.orderBy("part")) - F.col("many")).alias("before"))
    met = (F.shiftright(rows["at"], 33) == runs["part"]) & rows[group].eqNullSafe(runs["of"])
    return rows.join(runs, met).select(*[c for c in rows.columns if c != "at"],
                                       (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One tier: ``grp, pos, n, hash`` -> the same with ``up`` (on a chunk's first row: its node above) and ``path``.

    ``path`` holds the siblings to the left and right of the node's ancestors, level by level.
    """
    size = arity ** levels
    chunk = F.floor(F.col("pos") / size)
    here = Window.partitionBy("grp", "chunk").orderBy("pos")
    rows = nodes.withColumn("chunk", chunk).withColumn("up", F.col("hash"))
    for level in range(levels):
        width = arity ** level
        many = F.ceil(F.col("n") / width)                      # nodes of the level
        number = F.floor(F.col("pos") / width)
        slot = F.pmod(number, F.lit(arity))
        run = F.least(F.lit(arity), many - (number - slot))    # nodes of the run
        is_node = (F.pmod("pos", F.lit(width)) == 0) & (many > 1)
        before = [F.when(slot >= j, F.lag("up", j * width).over(here)).otherwise("") for j in range(arity - 1, 0, -1)]
        after = [F.when(slot + j < run, F.lead("up", j * width).over(here)).otherwise("") for j in range(1, arity)]
        rows = rows.withColumns({"left": F.concat(*before), "right": F.concat(*after)})
        rows = rows.withColumn(f"s{level}", F.when(is_node, F.struct("left", "right")))
        rows = rows.withColumn("up", F.when(is_node & (slot == 0), H(F.col("up"), F.col("right"))).otherwise(F.col("up")))
    # a node's ancestors are the last first rows before it
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.filter(F.array(*[F.last(f"s{i}", ignorenulls=True).over(so_far) for i in range(levels)]), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "chunk", "up", path.alias("path"))


def paths(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The written tiers of all groups' trees, and ``grp, root``, one row per group."""
    size, tiers = arity ** levels, []
    while True:
        tiers.append(written(climbed(nodes, arity, levels), "tier"))
        tops = tiers[-1].filter(F.pmod("pos", F.lit(size)) == 0).select(
            "grp", F.col("chunk").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("up").alias("hash"))
        if tops.filter("n > 1").isEmpty():
            return tiers, tops.select("grp", F.col("hash").alias("root"))
        nodes = tops


def siblings(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first tier's rows with the whole ``path`` to the root and the other columns of ``above``.

    ``above``: ``grp``, the ``path`` of each group's own node and what its members are to carry. Each tier's
    chunks look up the path of their node in the tier above, from the top down.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]
    higher = above.select(F.col("grp").alias("_g"), F.lit(0).cast("long").alias("_p"), F.col("path").alias("_path"), *carried)
    for tier in reversed(tiers):
        met = tier["grp"].eqNullSafe(higher["_g"]) & (tier["chunk"] == higher["_p"])
        here = tier.join(higher, met).withColumn("path", F.concat("path", "_path")).drop("_g", "_p", "_path")
        higher = here.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), F.col("path").alias("_path"), *carried)
    return here


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its way up."""
    return F.aggregate(path, start, lambda node, s: H(s["left"], node, s["right"]))


def leaves(docs: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """doc_id, grp, hash and, for the rows that the check tampers with, the leaf of n_chars + 1 as ``tampered``."""
    now = [F.col(c) for c in columns]
    then = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in columns]
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_MOD)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(group).alias("grp"), leaf_of(now).alias("hash"),
                       F.when(touched, leaf_of(then)).alias("tampered"))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", arity: int = ARITY,
             levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position (in its group).

    ``folded_root`` starts from the tampered leaf where there is one, and goes up the
    siblings of the untampered tree.
    """
    nodes = ranked(written(leaves(docs, columns, group), "leaves"), "grp", ["doc_id", "hash"], "ranked")
    tiers, subroots = paths(nodes, arity, levels)
    subroots = written(subroots, "subroots")
    every = F.lit(0).cast("long")  # the subroots are one group
    tops = ranked(subroots.select(F.col("grp").alias("name"), every.alias("grp"), F.col("root").alias("hash")),
                  "grp", ["name"], "tops")
    top_tiers, root = paths(tops, arity, levels)
    above = siblings(top_tiers, root.withColumn("path", F.array().cast(SIBLINGS)))
    above = written(above.select(F.col("name").alias("grp"), "path", F.col("hash").alias("subroot"), "root"), "above")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    found = siblings(tiers, above).withColumn("folded_root", folded(F.coalesce("tampered", "hash"), F.col("path")))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"), F.col("pos").alias("position"))
