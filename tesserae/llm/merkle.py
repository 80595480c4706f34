"""Merkle manifest of a table: a tree of hashes for each partition of the data, one tree over their roots, and a proof for each row.

Built bottom-up: a leaf is the hash of a row's fields, and every ``FAN`` consecutive nodes of a level become the hash of
their hashes in the next one, until one is left (the subroot of the partition). Subroots are the leaves of the upper tree.
Every level is written as a table. Proofs are pushed top-down: each level is joined with the one above it, and a child puts
its siblings in front of the proof that its parent has inherited. A level has an eighth of the rows below it, so all levels
together cost little more than the leaves; texts are hashed where they are read and never shuffled. The height of a tree
follows from its number of rows; the only values that come to the driver are the largest number of rows and the root.

Nulls: a null field is hashed as ``-``, which no value is; a null partition is one of its own and comes first; a null id
comes before all others. Rows that repeat an id are leaves of their own, in the order of their hashes. An empty table gives
no row. Very long texts are hashed whole. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import shared_dir, written
from tesserae.llm.positions import placed

#: Children of a node.
FAN = 8
_STEP = "array<struct<left: string, right: string>>"


def row_hash(*fields: Column) -> Column:
    """Hash of a row: each field as its number of UTF-8 bytes, a colon and its value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _levels(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """Tables (tree, pos, n, h, kids) from the given nodes (tree, pos, n, h) up; in each tree that has n > 1 nodes at a level, the next one has their parents."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        groups = levels[-1].filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"))
        kids = groups.agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("kids"))  # FAN at most
        kids = kids.withColumn("kids", F.transform("kids", lambda k: k["h"]))
        levels.append(written(kids.select("tree", "pos", "n", F.sha2(F.array_join("kids", ""), 256).alias("h"), "kids"), folder))
        most = -(-most // FAN)
    return levels


def _proved(levels: list[DataFrame], tops: DataFrame, folder: str) -> DataFrame:
    """The lowest level with subroot and proof: per level up to the root the hashes left and right of the path. tops: (tree, above) proofs of the subroots."""
    parents = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        ends = level.filter("n = 1").join(tops, "tree").withColumn("subroot", F.col("h")).withColumnRenamed("above", "proof")
        found = ends.select(*level.columns, "subroot", "proof")
        if parents is not None:
            up = parents.select("tree", F.col("pos").alias("_up"), F.col("kids").alias("_run"), "subroot", F.col("proof").alias("_above"))
            at = (F.col("pos") % FAN).cast("int")
            siblings = F.struct(F.array_join(F.slice("_run", 1, at), "").alias("left"), F.array_join(F.slice("_run", at + 2, FAN), "").alias("right"))
            children = level.filter("n > 1").withColumn("_up", F.floor(F.col("pos") / FAN)).join(up, ["tree", "_up"])
            children = children.withColumn("proof", F.concat(F.array(siblings), F.col("_above")))
            found = found.unionByName(children.select(*level.columns, "subroot", "proof"))
        parents = written(found, folder) if k else found
    return parents


def manifest(rows: DataFrame, fields: list[str], partition: str, id_col: str, **extra: Column) -> DataFrame:
    """(id, leaf, subroot, root, proof) of every row, and the extra columns, which are computed from the rows.

    Trees are those of the column ``partition``, their leaves in the order of ``id_col``. proof: from the leaf up to the root, for each
    level the hashes left and right of the path, each side as one string; see folded() and proof_hash().
    """
    folder = shared_dir(rows.sparkSession)
    tree = F.coalesce(F.concat(F.lit("1"), F.col(partition).cast("string")), F.lit("0"))  # null first, then by bytes
    leaves = rows.select(tree.alias("tree"), F.col(id_col).alias("id"), row_hash(*map(F.col, fields)).alias("h"), *[c.alias(n) for n, c in extra.items()])
    leaves = written(leaves.withColumn("_row", F.monotonically_increasing_id()), folder)
    levels = _levels(written(placed(leaves, folder, "id", "h", "_row"), folder), folder)
    subroots = None
    for level in levels:
        ends = level.filter("n = 1").select(F.lit("all").alias("tree"), F.col("tree").alias("part"), "h")
        subroots = ends if subroots is None else subroots.unionByName(ends)
    upper = _levels(written(placed(subroots, folder, "part"), folder), folder)
    root = upper[-1].filter("n = 1").select("h").first()
    tops = _proved(upper, upper[-1].select("tree", F.array().cast(_STEP).alias("above")).limit(1), folder)
    proved = _proved(levels, written(tops.select(F.col("part").alias("tree"), F.col("proof").alias("above")), folder), folder)
    return proved.select("id", F.col("h").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "proof", *extra)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
