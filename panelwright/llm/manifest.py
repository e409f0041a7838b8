"""A Merkle manifest of a dataset: leaves of rows, a tree for each group, one over the groups, and proofs by octopus multiproofs.

Every hash is the lowercase hex SHA-256 of its inputs' text one after another. A level's nodes
become the next level two by two; a last node without a partner is hashed alone, as long as the
level has more than one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.runtime import checkpoint

#: Leaves of a leaf partition: 2 to this power consecutive ones of one tree.
HEIGHT = 12


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: str | Column) -> Column:
    """The hash of a row: each value as its UTF-8 byte count, a colon and its text, ``-`` for null."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    return max(n - 1, 0).bit_length()


def missing(known: np.ndarray, n: int, level: int = 0) -> list[tuple[int, int]]:
    """The octopus: the fewest nodes ``(level, place)`` from which, with the nodes ``known`` of one level, all paths to the root follow.

    ``n`` is the number of leaves. Going up, a sibling is missing only if it exists and no known
    node lies below it; both then make known nodes of the next level.
    """
    found = []
    known = np.unique(known)
    for at in range(level, height(n)):
        beside = np.setdiff1d(known ^ 1, known, assume_unique=True)
        found += [(at, int(i)) for i in beside if int(i) << at < n]
        known = np.unique(known >> 1)
    return found


def _above(nodes: dict[int, str]) -> dict[int, str]:
    """The next level's nodes that follow from ``nodes`` by place."""
    return {p: sha(*(nodes[c] for c in (2 * p, 2 * p + 1) if c in nodes)) for p in dict.fromkeys(i >> 1 for i in sorted(nodes))}


_NODES = "tree string, n bigint, level int, place bigint, digest string"
_NODE_SCHEMA = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])


def _raising(span: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        """Up to ``span`` levels above one block of nodes; of those inside a leaf partition only its root stays."""
        tree, n, level = part["tree"][0].as_py(), part["n"][0].as_py(), part["level"][0].as_py()
        nodes = dict(zip(part["place"].to_pylist(), part["digest"].to_pylist(), strict=True))
        rows = []
        top = min(level + span, height(n))
        for at in range(level, top):
            nodes = _above(nodes)
            if level or at + 1 == top:
                rows += [(tree, n, at + 1, place, digest) for place, digest in nodes.items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _NODE_SCHEMA.types, strict=True)], schema=_NODE_SCHEMA)

    return run


def upper_nodes(leaves: DataFrame, span: int = HEIGHT) -> DataFrame:
    """``(tree, n, level, place, digest)`` of all nodes from the leaf partitions' roots to the trees' roots.

    ``leaves`` has ``tree, n, place, digest``. Each round takes blocks of 2 to the power of
    ``span`` nodes up by that many levels, a block a group; the next round has as many times
    fewer nodes, so that three rounds raise 10 to the power of 10 leaves. A tree of one leaf has
    that leaf as root.
    """
    nodes = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "digest")
    done = [nodes.where("n = 1")]
    nodes = nodes.where("n > 1")
    top = height(leaves.agg(F.max("n")).first()[0] or 0)
    for level in range(0, top, span):
        raised = checkpoint(nodes.groupBy("tree", F.shiftright("place", span)).applyInArrow(_raising(span), _NODES))
        done.append(raised)
        nodes = raised.where(F.col("level") == level + span)
    whole = done[0]
    for each in done[1:]:
        whole = whole.unionByName(each)
    return whole


def placed(rows: DataFrame, tree: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``place``, their number from 0 within their ``tree``, and ``n``, the tree's size.

    Rows are sorted by ranges of tree and order, so that a tree of any size spreads over tasks;
    each task's rows of a tree are numbered from the counts of the tasks before. The working
    columns need names of their own: ``_run`` and ``_id``.
    """
    keys = [F.asc_nulls_first(o) if isinstance(o, str) else o for o in [tree, *order]]
    ordered = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_id")))
    runs = ordered.groupBy(tree, "_run").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(tree)
    before = F.sum("_count").over(whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(tree).alias("_tree"), F.col("_run").alias("_at"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    joined = ordered.join(runs, (F.col(tree) == F.col("_tree")) & (F.col("_run") == F.col("_at")))
    return joined.withColumn("place", F.col("_id") + F.col("_shift")).drop("_run", "_id", "_tree", "_at", "_shift")


def _coordinates(n: int, low: int, high: int) -> list[tuple[int, int]]:
    return missing(np.arange(low, high + 1), n)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The coordinates that each leaf partition needs beside its own leaves, once each."""
    for batch in batches:
        rows = [(tree, part, level, place) for tree, part, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True) for level, place in _coordinates(n, low, high)]
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["tree", "part", "level", "place"])


def fetched(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(tree, part, root, nodes)``: what each leaf partition lacks for its proofs, as a list of ``(level, place, digest)``, and its tree's root.

    A partition asks for the union of its leaves' missing nodes; each node comes once. A list has
    at most as many entries as the tree has levels.
    """
    parts = leaves.groupBy("tree", "part").agg(F.first("n").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    asked = parts.select("tree", "part", "n", "low", "high").mapInArrow(_asked, "tree string, part bigint, level int, place bigint")
    roots = nodes.where(F.col("place") == 0).groupBy("tree").agg(F.max_by("digest", "level").alias("root"))
    answers = asked.join(nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"]).groupBy("tree", "part").agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
    return parts.select("tree", "part").join(answers, ["tree", "part"], "left").join(roots, "tree").select("tree", "part", "root", "nodes")


def fold(digest: str, place: int, siblings: list[str | None]) -> str:
    """The root that follows from a leaf, its place and its sibling on each level (None where it has none)."""
    for sibling in siblings:
        digest = sha(digest) if sibling is None else sha(sibling, digest) if place & 1 else sha(digest, sibling)
        place >>= 1
    return digest


def _levels(part: pa.Table, found: list[dict]) -> list[dict[int, str]]:
    """All nodes of a leaf partition's paths, by level and place: its leaves, the fetched nodes, and what follows from both."""
    n = part["n"][0].as_py()
    levels = [dict(zip(part["place"].to_pylist(), part["digest"].to_pylist(), strict=True))]
    for at in range(height(n)):
        mine = dict.fromkeys(i >> 1 for i in sorted(levels[at]))
        levels[at].update({r["place"]: r["digest"] for r in found if r["level"] == at})
        levels.append({p: sha(*(levels[at][c] for c in (2 * p, 2 * p + 1) if c in levels[at])) for p in mine})
    return levels


def _expanding(names: list[str]):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        levels = _levels(rows, (found["nodes"][0].as_py() or []) if found.num_rows else [])
        above = (found["above"][0].as_py() or []) if found.num_rows else []
        over = found["over"][0].as_py() if found.num_rows else 0
        folded, hashed = [], []
        for place, changed in zip(rows["place"].to_pylist(), rows["changed"].to_pylist(), strict=True):
            siblings = [level.get((place >> at) ^ 1) for at, level in enumerate(levels[:-1])]
            subroot = fold(changed, place, siblings)
            folded.append(fold(subroot, over, above))
            hashed.append(sha(*(s for s in [*siblings, *above] if s is not None)))
        size = rows.num_rows
        root, subroot = found["top"][0].as_py(), found["root"][0].as_py()
        columns = [*(rows[n] for n in names), pa.array([subroot] * size, pa.string()), pa.array([root] * size, pa.string()), pa.array(hashed, pa.string()), pa.array(folded, pa.string())]
        return pa.Table.from_arrays(columns, [*names, "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _sibling_lists(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Each leaf's siblings up to the root, null where it has none."""
    levels = _levels(rows, (found["nodes"][0].as_py() or []))
    lists = [[level.get((place >> at) ^ 1) for at, level in enumerate(levels[:-1])] for place in rows["place"].to_pylist()]
    return pa.Table.from_arrays([rows["over_tree"], rows["place"], pa.array([found["root"][0].as_py()] * rows.num_rows, pa.string()), pa.array(lists, pa.list_(pa.string()))], ["tree", "over", "top", "above"])


def manifest(rows: DataFrame, group: str, order: str, values: list[str], changed: Column | None = None, span: int = HEIGHT) -> DataFrame:
    """``(order, leaf, subroot, root, proof_sha256, folded_root)`` of every row.

    A row's leaf is the hash of its ``values``. Leaves of a ``group`` are ordered by ``order``,
    null first, equal ones by their leaves (equal leaves can change places without any change);
    groups by their UTF-8 bytes, null first, which is a group of its own apart from the empty
    string's. ``changed`` is the leaf to fold up the original siblings in place of the row's own
    where it isn't null, as one would check a copy of the row. A leaf partition has 2 to the power
    of ``span`` leaves.

    Other columns don't matter, whatever their names; repeated rows have a leaf each; a group of
    one leaf has it as subroot, one group has its subroot as root; an empty table gives no rows.
    Long values are hashed by Spark where they are; from then on only digests move.
    """
    own = leaf(*values)
    leaves = rows.select(
        F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"), F.col(order).alias("key"), own.alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    ).withColumn("changed", F.coalesce("changed", "digest"))
    leaves = placed(leaves, "tree", ["key", "digest"]).withColumn("part", F.shiftright("place", span))
    nodes = upper_nodes(leaves, span)
    mine = fetched(leaves, nodes)
    groups = nodes.where("place = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest")).select(F.lit("").alias("all"), F.col("tree").alias("over_tree"), "digest")
    groups = placed(groups, "all", ["over_tree"]).withColumnRenamed("all", "tree").withColumn("part", F.shiftright("place", span))
    over = fetched(groups, upper_nodes(groups, span))
    tops = groups.groupBy("tree", "part").cogroup(over.toDF(*over.columns).groupBy("tree", "part")).applyInArrow(_sibling_lists, "tree string, over bigint, top string, above array<string>")
    found = mine.join(tops, "tree")
    names = ["key", "digest"]
    kinds = dict(leaves.dtypes)
    schema = f"key {kinds['key']}, digest string, subroot string, root string, proof_sha256 string, folded_root string"
    proved = leaves.groupBy("tree", "part").cogroup(found.toDF(*found.columns).groupBy("tree", "part")).applyInArrow(_expanding(names), schema)
    return proved.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root")
