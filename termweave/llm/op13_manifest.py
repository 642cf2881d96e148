"""A Merkle manifest of a table: a tree per source, a tree over the sources, a proof per row.

Rows become leaves by SQL functions, so texts are read where they lie and never
shuffled, and leaves are numbered within their source by range partitions. ``3 ** DEPTH``
neighbouring leaves are a superblock; a source of any size is many of them.

Upward, each superblock is reduced to its top, the tops are the leaves of the next
layer, and so on until every tree has one top: three layers for 10 ** 11 leaves.
Downward, each superblock's nodes are cogrouped with the one row that it needs from
outside, the siblings on the way from its top to the root: the group's task reduces
it again, puts each node's inner siblings before the outer ones and, at the leaves,
hashes the proof and folds the presented leaf to a root. No task holds more than a
superblock, and no tree passes the driver but for its root.

Rows. Each row is a leaf, repeated rows and null ids too; null ids come first and
rows of equal id are in order of their leaves. A null of any column is ``-``. Null
ids are never tampered with, as they have no decimal. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import send_code
from termweave.operators.ordering import number_rows
from termweave.storage import materialize

ARITY = 3
#: Levels of a superblock: 3 ** 8 = 6,561 nodes.
DEPTH = 8
DIGEST = 64


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return rows


def levels_to_one(n: int) -> int:
    """Levels until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def siblings(rows: list[list[str]], place: int) -> Iterator[str]:
    """Per level: a node's place in its run as a digit, then the run's other nodes."""
    for row in rows[:-1]:
        first = place - place % ARITY
        yield str(place - first) + "".join(row[first:place] + row[place + 1 : first + ARITY])
        place //= ARITY


def folded(node: str, path: list[str]) -> str:
    for step in path:
        left = 1 + DIGEST * int(step[0])
        node = digest(step[1:left], node, step[left:])
    return node


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    fields = [_field(c) for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (which names the source and sorts like it, null first), doc_id, leaf, and the leaf presented for proof."""
    same = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, number = leaf_of(*same, docs["text"]), docs["doc_id"].cast("string")
    tampered = F.coalesce(F.crc32(number) % 2 == 0, F.lit(False)) & F.contains(docs["text"], F.lit("\n"))
    changed = F.when(tampered, leaf_of(*same, F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("-"))
    rows = docs.select(tree.alias("tree"), docs["doc_id"], leaf.alias("leaf"), changed.alias("shown"))
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


class Forest:
    """Trees of one layer of nodes (tree, place, node), reduced layer by layer.

    ``layers`` holds, from the nodes up, the tops of the layer's superblocks: tree,
    place (the superblock's number), node (its top) and levels (of the superblock).
    """

    def __init__(self, nodes: DataFrame, depth: int):
        self.depth, self.block = depth, ARITY**depth
        self.layers: list[DataFrame] = []
        most = 2
        while most > 1:
            self.layers.append(materialize(self._tops(nodes), "superblocks"))
            nodes = self.layers[-1]
            most = (nodes.agg(F.max("place")).first()[0] or 0) + 1

    def _tops(self, nodes: DataFrame) -> DataFrame:
        depth = self.depth

        def top(group: pd.DataFrame) -> pd.DataFrame:
            found = group.sort_values("place")
            levels = levels_to_one(len(found))
            node = reduced(found["node"].tolist(), levels)[-1][0]
            return pd.DataFrame({"tree": found["tree"].iloc[:1], "place": found["block"].iloc[0], "node": node, "levels": levels})

        blocks = nodes.select("tree", "place", "node", self._block().alias("block"))
        tops = blocks.groupBy("tree", "block").applyInPandas(top, "tree string, place long, node string, levels int")
        tops = materialize(tops, "tops")
        many = tops.groupBy("tree").agg((F.count(F.lit(1)) > 1).alias("many"))
        # Where a tree has more superblocks, a short last one is hashed as high as the others.
        missing = F.array_repeat(F.lit(0), F.lit(depth) - F.col("levels"))
        raised = F.aggregate(missing, F.col("node"), lambda node, _: F.sha2(node.cast("binary"), 256))
        return tops.join(many, "tree").select(
            "tree",
            "place",
            F.when(F.col("many"), raised).otherwise(F.col("node")).alias("node"),
            F.when(F.col("many"), F.lit(depth)).otherwise(F.col("levels")).alias("levels"),
        )

    def _block(self) -> Column:
        return F.call_function("div", F.col("place"), F.lit(self.block))

    @property
    def tops(self) -> DataFrame:
        """tree and node: the one top of each tree."""
        return self.layers[-1].select("tree", "node")

    def outer(self, above: DataFrame) -> DataFrame:
        """What each superblock of nodes needs from outside: tree, block, levels, subroot and path.

        ``above`` has the path from each tree's top on, with the tree's subroot.
        """
        found = self.layers[-1].join(above, "tree").select("tree", F.col("place").alias("block"), "levels", "subroot", "path")
        for layer in reversed(self.layers[:-1]):  # its superblocks are the nodes of the layer above
            found = self.joined(layer, found, _paths, "tree string, block long, levels int, subroot string, path array<string>")
        return found

    def joined(self, nodes: DataFrame, outer: DataFrame, make, schema: str) -> DataFrame:
        """``make`` of each superblock's nodes and its row of ``outer``."""
        by = ["tree", "block"]
        placed = nodes.withColumn("block", self._block())
        return placed.groupBy(*by).cogroup(outer.groupBy(*by)).applyInPandas(make, schema)


def _ways(nodes: pd.DataFrame, outer: pd.DataFrame) -> Iterator[list[str]]:
    """Per node, in order of place, the siblings from it to the root."""
    levels, beyond = int(outer["levels"].iloc[0]), list(outer["path"].iloc[0])
    rows = reduced(nodes["node"].tolist(), levels)
    for place in range(len(nodes)):
        yield [*siblings(rows, place), *beyond]


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    found = nodes.sort_values("place")
    return pd.DataFrame(
        {
            "tree": found["tree"],
            "block": found["place"],
            "levels": found["levels"],
            "subroot": outer["subroot"].iloc[0],
            "path": list(_ways(found, outer)),
        }
    )


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    send_code(docs.sparkSession)
    numbered = number_rows(leaves(docs), ["tree"], ["doc_id", "leaf"], "place")
    rows = materialize(
        numbered.select("tree", F.col("doc_id").cast("string"), F.col("leaf").alias("node"), "shown", (F.col("place") - 1).alias("place")),
        "leaves",
    )  # ids are text in pandas, where numbers beside nulls lose digits
    sources = Forest(rows, depth)
    ranked = number_rows(sources.tops, [], ["tree"], "place")
    place = (F.col("place") - 1).alias("place")
    subroots = materialize(ranked.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node", place), "subroots")
    whole = Forest(subroots, depth)
    first = whole.tops.first()
    root = first["node"] if first else None

    def of_source(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        found = nodes.sort_values("place")
        return pd.DataFrame({"tree": found["source"], "subroot": found["node"], "path": list(_ways(found, outer))})

    def of_leaf(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        found = nodes.sort_values("place")
        ways = list(_ways(found, outer))
        ends = [folded(shown, way) for shown, way in zip(found["shown"], ways, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": found["doc_id"],
                "leaf": found["node"],
                "subroot": outer["subroot"].iloc[0],
                "root": root,
                "proof_sha256": [digest(*(step[1:] for step in way)) for way in ways],
                "folded_root": ends,
                "verified": [end == root for end in ends],
            }
        )

    at_top = whole.tops.select("tree", F.col("node").alias("subroot"), F.array().cast("array<string>").alias("path"))
    above = whole.joined(subroots, whole.outer(at_top), of_source, "tree string, subroot string, path array<string>")
    result = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = sources.joined(rows, sources.outer(materialize(above, "paths")), of_leaf, result)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
