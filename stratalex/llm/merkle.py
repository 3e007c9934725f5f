"""Merkle manifest of a dataset: digests, inclusion proofs and their check, by fractal traversal of aligned blocks.

1. A row is hashed where it is read; only (tree, id, digests) moves on.  Rows are dealt by ranges and numbered within their
   tree (number = rows of the ranges before + place in the range), so that no task sees a tree.
2. The 2**HEIGHT nodes of an aligned block meet in one task.  A fractal traversal emits their authentication paths one
   after the other: on each of the stacked levels it holds the subtree over the present node and builds, two steps a node,
   the one that comes next, so that a block of n nodes needs memory in the order of log(n) subtrees.
3. The roots of the blocks are the nodes of the next tier, up to one root a tree; the trees' roots, in order, are the
   leaves of the last tree.  What the upper tiers add to the path of a block is joined to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.llm.common import discard, materialise, type_of

#: Levels of an aligned block, and of each of the subtrees that are stacked in it.
HEIGHT, SUBTREE = 9, 3
#: Rows whose id's CRC-32 this divides are tampered with.
TAMPER = 7


def node(left: bytes | None, right: bytes | None) -> bytes | None:
    """The digest, as hex, over one or two digests; None over none."""
    if left is None:
        return None
    return sha256(left if right is None else left + right).hexdigest().encode()


class _Growing:
    """A subtree over the leaves of one place, built step by step.  Of what it hashes it keeps the levels from `low` up."""

    def __init__(self, leaves: list[bytes], low: int, high: int, place: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.end = place << high, (place + 1) << high
        self.stack: list[tuple[int, bytes | None]] = []
        self.kept: dict[tuple[int, int], bytes | None] = {}

    def _add(self, level: int, place: int, digest: bytes | None) -> None:
        if level >= self.low:
            self.kept[level, place] = digest
        self.stack.append((level, digest))

    def step(self) -> bool:
        """One leaf read or two nodes joined; False where nothing is left to do."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            level, right = s.pop()
            left = s.pop()[1]
            self._add(level + 1, (self.next - 1) >> (level + 1), node(left, right))
        elif self.next < self.end:
            leaf = self.leaves[self.next] if self.next < len(self.leaves) else None
            self.next += 1
            self._add(0, self.next - 1, leaf)
        else:
            return False
        return True


class Traversal:
    """The authentication paths of all leaves of an aligned block, in order, and its root.

    leaves: hex digests, at most 2**height; the block is raised to `height` levels, however few they are.
    """

    def __init__(self, leaves: list[bytes], height: int, subtree: int = SUBTREE):
        self.leaves, self.height, self.subtree = leaves, height, subtree
        self.lows = list(range(0, height, subtree))
        first = _Growing(leaves, 0, height, 0)
        bounds = [(low, min(low + subtree, height)) for low in self.lows]
        self.existing: list[dict] = [{} for _ in bounds]
        while first.step():
            # Of the first pass only the leftmost subtrees and the root stay.
            level, place = first.stack[-1][0], (first.next - 1) >> first.stack[-1][0]
            if level < height and (place << level) >> bounds[level // subtree][1] == 0:
                self.existing[level // subtree][level, place] = first.stack[-1][1]
            first.kept.clear()
        self.root = first.stack[0][1]
        self.bounds = bounds
        self.desired = [_Growing(leaves, low, high, 1) for low, high in bounds[:-1]]

    def paths(self) -> Iterator[list[tuple[bool, bytes | None]]]:
        """For each leaf, from below: whether the sibling is to the left, and its digest (None: there is none)."""
        for at in range(len(self.leaves)):
            yield [(bool(at >> k & 1), self.existing[k // self.subtree].get((k, at >> k ^ 1))) for k in range(self.height)]
            for i, growing in enumerate(self.desired):
                growing.step() and growing.step()
                high = self.bounds[i][1]
                if (at + 1) % (1 << high) == 0:
                    self.existing[i] = growing.kept
                    self.desired[i] = _Growing(self.leaves, *self.bounds[i], ((at + 1) >> high) + 1)


def levels(total: int) -> int:
    """Levels above the leaves of a tree."""
    return max(0, total - 1).bit_length()


_SCHEMA = "tree string, block long, p long, total long, id {id}, digest binary, folded binary, path binary, up array<string>, root binary"


def _walk(height: int, schema: pa.Schema):
    """Nodes in the order of tree and place -> their paths within the aligned block.

    folded: what `start` becomes at the block's root; path: the siblings' digests; up: the same with their sides, L or R, and
    - where a node is alone; root: the block's, on its first row.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        total = rows[0][2]
        walk = Traversal([r[3].hex().encode() for r in rows], min(height, levels(total)))
        out = []
        for n, (r, path) in enumerate(zip(rows, walk.paths())):
            tree, p, total, digest, start, id_ = r
            folded = start.hex().encode()
            for left, sibling in path:
                folded = node(sibling, folded) if left else node(folded, sibling)
            raw = b"".join(bytes.fromhex(s.decode()) for _, s in path if s is not None)
            up = ["-" if s is None else ("L" if left else "R") + s.decode() for left, s in path] if id_ is None else None
            out.append((tree, p >> height, p, total, id_, digest, bytes.fromhex(folded.decode()), raw, up, bytes.fromhex(walk.root.decode()) if n == 0 else None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (rows[0][0] != r[0] or rows[0][1] >> height != r[1] >> height):
                    yield block(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield block(rows)

    return walk


def _walked(nodes: DataFrame, height: int) -> DataFrame:
    """nodes(tree, p, total, digest, start, id); id null in the tiers above the leaves, whose sides are told."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, ddl = nodes.sparkSession, _SCHEMA.format(id=type_of(nodes, "id"))
    arrow = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    dealt = nodes.select("tree", "p", "total", "digest", "start", "id").repartition("tree", F.shiftright("p", height)).sortWithinPartitions("tree", "p")
    return materialise(dealt.mapInArrow(_walk(height, arrow), ddl), "walked")


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(tree, ...) with p, their number within the tree in this order, and total, the tree's nodes."""
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "ranges")  # range << 33, plus the place in it
    part = F.shiftright("at", 33).alias("part")
    counts = at.groupBy("tree", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # A row for each range and tree in it.
    before = counts.select("tree", "part", "first", (F.sum("n").over(W.partitionBy("tree").orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("tree")).alias("total"))
    return at.withColumn("part", part).join(before, ["tree", "part"]).withColumn("p", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def _climb(blocks: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """blocks(tree, p, total, digest), the roots of aligned blocks -> (tree, p, up), the path above each block up to the
    root of its tree, and (tree, root).  Each tier has 2**height times fewer nodes than the one below."""
    tiers, roots = [], None
    while True:
        done = blocks.filter("total = 1").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        open_ = blocks.filter("total > 1")
        if open_.isEmpty():
            break
        walked = _walked(open_.select("*", F.col("digest").alias("start"), F.lit(None).cast("long").alias("id")), height)
        tiers.append(walked)
        blocks = _block_roots(walked, height)
    paths = None
    for walked in reversed(tiers):
        here = walked.select("tree", "p", "block", "up")
        if paths is not None:
            above = paths.select("tree", F.col("p").alias("block"), F.col("up").alias("above"))
            here = here.join(above, ["tree", "block"], "left").withColumn("up", F.concat("up", F.coalesce("above", _none())))
        paths = here.select("tree", "p", "up")
    if paths is None:
        paths = blocks.limit(0).select("tree", "p", _none().alias("up"))
    return paths, roots


def _none() -> Column:
    return F.array().cast("array<string>")


def _block_roots(walked: DataFrame, height: int) -> DataFrame:
    return walked.filter("root is not null").select("tree", F.col("block").alias("p"), F.shiftright(F.col("total") + ((1 << height) - 1), height).alias("total"), F.col("root").alias("digest"))


def _said(c: Column) -> Column:
    """A value with the bytes that it takes; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_said, columns)), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), bump: str = "n_chars", every: int = TAMPER, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified, digests as lower-case hex.

    A leaf is the digest of the row's fields.  Leaves of one tree_col ascend by id (null ids first, equal ids by their
    leaf), every two consecutive nodes become one until one is left, and the roots of the trees, null first, then by UTF-8
    bytes, likewise give the root.  proof_sha256 is the digest of the siblings on the way from leaf to root; where there are
    none, of nothing.  Rows whose id's decimal CRC-32 `every` divides are tampered with: `bump` grows by one, unless it is
    null (a null id is never tampered with); folded_root is what such a row, or the row as it is, gives with the siblings of the
    untampered tree, and verified tells whether that is the root.

    Nulls in any column, empty and very long texts (hashed where they are read), ties and repeated rows are rows like
    others; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if id_col not in docs.columns:
        raise ValueError(id_col)
    columns = [F.col(f"`{c}`") for c in fields]
    changed = [F.col(f"`{c}`") + 1 if c == bump else F.col(f"`{c}`") for c in fields]
    told = F.col(f"`{id_col}`").cast("string")
    tampered = F.coalesce(F.crc32(F.encode(told, "UTF-8")) % every == 0, F.lit(False))
    # Null is the first tree, and the others keep their order.
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(columns).alias("digest"), F.when(tampered, leaf(changed)).alias("start"))
    rows = materialise(rows, "leaves")
    placed = _placed(rows, ["id", "digest"])
    walked = _walked(placed.withColumn("start", F.coalesce("start", "digest")), height)
    discard(rows)
    paths, subroots = _climb(_block_roots(walked, height), height)
    subroots = materialise(subroots, "subroots")
    # The last tree, over the roots of the others.
    tops = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"])
    tops = materialise(tops, "tops")
    top = _walked(tops.select("*", F.col("digest").alias("start"), F.lit(None).cast("long").alias("id")), height)
    over, root = _climb(_block_roots(top, height), height)
    over = top.select("p", "block", "up").join(over.select(F.col("p").alias("block"), F.col("up").alias("above")), "block", "left")
    over = over.select("p", F.concat("up", F.coalesce("above", _none())).alias("over"))
    trees = tops.join(over, "p").crossJoin(root.select(F.hex("root").alias("root"))).select(F.col("of").alias("tree"), F.hex("digest").alias("subroot"), "root", "over")  # root: one row
    trees = materialise(trees, "trees")
    blocks = walked.filter("root is not null").select("tree", "block").join(paths.select("tree", F.col("p").alias("block"), "up"), ["tree", "block"], "left").join(trees, "tree")
    blocks = materialise(blocks.select("tree", "block", F.concat(F.coalesce("up", _none()), "over").alias("up"), F.lower("subroot").alias("subroot"), F.lower("root").alias("root")), "uppers")
    met = walked.select("tree", "block", "id", "digest", "folded", "path").join(blocks, ["tree", "block"])
    siblings = F.array_join(F.transform(F.filter("up", lambda x: x != "-"), lambda x: F.substring(x, 2, 64)), "")

    def fold(acc: Column, x: Column) -> Column:
        sibling = F.substring(x, 2, 64)
        return F.sha2(F.when(x == "-", acc).when(x.startswith("L"), F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)), 256)

    text = lambda c: F.lower(F.hex(c))
    out = met.select(F.col("id").alias(id_col), text("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat(text("path"), siblings), 256).alias("proof_sha256"), F.aggregate("up", text("folded"), fold).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
