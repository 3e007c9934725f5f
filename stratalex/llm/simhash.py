"""SimHash near-duplicates, linked through Gray-order hierarchical indexes.

1. Fingerprints are made where the text is read; only (id, fingerprint) moves on.
2. Two fingerprints that differ in at most 2 bits agree on two of their four 16-bit bands.  So each distinct fingerprint
   goes to the 6 groups named by a pair of bands.  A group above HOT_GROUP distinct fingerprints is dealt anew by a pair
   of the four bytes that its key leaves open; a group then holds 65,536 distinct fingerprints at most.  Nothing is capped.
3. Groups are read in key order.  In each run of them a Gray-order hierarchical index joins the fingerprints with
   themselves (class GrayIndex), and each cluster found is told as a star: links grow with fingerprints, not with pairs.
4. The stars meet in components().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm import minhash
from stratalex.llm.common import materialise, tune, type_of
from stratalex.llm.components import components

#: Distinct fingerprints of a group beyond which its key is refined.
HOT_GROUP = 4096
#: Rows of whole groups that one index takes (more only where a single group has more).
RUN_ROWS = 65_536
#: Most differing bits that the band pairs find for certain.
MAX_BITS = 2
FANOUT = 8
#: Nodes that an index meets at a time.
PIECE = 32_768
_PAIRS = list(combinations(range(4), 2))
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the shingles' XXH64.  No words: 0."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return of_hashes(np.fromiter(map(_HASH, shingles), np.uint64, max(1, len(w) - words + 1)))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles by their 64-bit hashes; of none 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp the fingerprint as a signed long.  A null text counts as empty."""
    tune(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(make, f"`{id_col}` {type_of(docs, id_col)}, fp long")


class GrayIndex:
    """Distinct 64-bit codes in the order of their Gray rank, under a tree of fan-out FANOUT.

    Neighbours in Gray order share most bits.  An upper node holds the bits that all codes below it share and that no
    node above holds already; a query adds up its differences down a path and leaves a node, with all its codes, once
    they exceed the limit.
    """

    def __init__(self, codes: np.ndarray):
        rank = codes.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        self.order = np.argsort(rank, kind="stable")
        self.codes = codes[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        ands, ors, masks = [self.codes], [self.codes], [np.full(len(codes), full)]
        while len(ands[-1]) > FANOUT:
            at = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], at))
            ors.append(np.bitwise_or.reduceat(ors[-1], at))
            masks.append(~(ands[-1] ^ ors[-1]))
        #: From the leaves up: the pattern of each node, and the bits that it adds to those held above it.
        self.levels = []
        for k, (pattern, mask) in enumerate(zip(ands, masks)):
            above = masks[k + 1][np.arange(len(mask)) // FANOUT] if k + 1 < len(masks) else np.uint64(0)
            self.levels.append((pattern, mask & ~above))

    def pairs(self, bits: int, block: int = 2048, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j in Gray order, of all codes that differ in at most `bits` bits, in pieces.  Nodes are met
        PIECE at a time, depth first, so memory does not grow with the number of pairs.

        root: what stands for the cluster of each position, as far as the caller knows by now.  Pairs of one cluster are then
        left out, and a node whose codes all lie in the query's cluster is not entered.
        """
        top = len(self.levels) - 1
        one, told = self._one_root(root), 0
        for begin in range(0, len(self.codes), block):
            mine = np.arange(begin, min(begin + block, len(self.codes)))
            n = len(self.levels[top][0])
            met = [(top, np.repeat(mine, n), np.tile(np.arange(n), len(mine)), np.zeros(n * len(mine), np.uint8))]
            while met:
                k, q, node, acc = met.pop()
                if len(q) > PIECE:
                    met.append((k, q[PIECE:], node[PIECE:], acc[PIECE:]))
                    q, node, acc = q[:PIECE], node[:PIECE], acc[:PIECE]
                pattern, mask = self.levels[k]
                later = (node + 1) * FANOUT**k - 1 > q  # the node holds a later position
                if root is not None:
                    later &= one[k][node] != root[q]
                q, node, acc = q[later], node[later], acc[later]
                acc = acc + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
                near = acc <= bits
                q, node, acc = q[near], node[near], acc[near]
                if k:
                    q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < len(self.levels[k - 1][0])
                    met.append((k - 1, q[there], node[there], acc[there]))
                elif len(q):
                    yield q, node
                    told += len(q)
                    if told >= len(self.codes):
                        one, told = self._one_root(root), 0

    def _one_root(self, root: np.ndarray | None) -> list[np.ndarray] | None:
        """For each node, from the leaves up, the root that all codes below it have; -1 if they differ."""
        if root is None:
            return None
        out = [root.copy()]
        for pattern, _ in self.levels[1:]:
            at = np.arange(len(pattern)) * FANOUT
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def roots(self, bits: int) -> np.ndarray:
        """For each code, as given, the place of the code that stands for its cluster."""
        root = np.arange(len(self.codes))
        for a, b in self.pairs(bits, root=root):
            while True:
                ra, rb = root[a], root[b]
                differ = ra != rb
                if not differ.any():
                    break
                a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root[root] != root).any():
                    root[:] = root[root]
        out = np.empty_like(root)
        out[self.order] = self.order[root]
        return out


def _bands_first(fp: np.ndarray, pair: int) -> np.ndarray:
    """The same bits with the two bands of the pair on top, so that codes of one group are neighbours in Gray order."""
    rest = [i for i in range(4) if i not in _PAIRS[pair]]
    out = np.zeros_like(fp)
    for place, band in enumerate([*rest, *_PAIRS[pair]]):
        out |= ((fp >> np.uint64(16 * band)) & np.uint64(0xFFFF)) << np.uint64(16 * place)
    return out


def _stars(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Star-shaped links of the fingerprints of whole groups, in the order of their keys."""
    if len(key) == 0:
        return
    same = key[1:] == key[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    pair = (key >> 51).astype(np.int64)
    for p in np.unique(pair[shared]):
        codes = np.unique(_bands_first(fp[shared & (pair == p)].view(np.uint64), int(p)))
        index = GrayIndex(codes)
        root = index.roots(bits)
        child = np.flatnonzero(root != np.arange(len(codes)))
        if len(child):
            back = _bands_back(codes, int(p)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back[child]), pa.array(back[root[child]])], names=["a", "b"])


def _bands_back(codes: np.ndarray, pair: int) -> np.ndarray:
    rest = [i for i in range(4) if i not in _PAIRS[pair]]
    out = np.zeros_like(codes)
    for place, band in enumerate([*rest, *_PAIRS[pair]]):
        out |= ((codes >> np.uint64(16 * place)) & np.uint64(0xFFFF)) << np.uint64(16 * band)
    return out


def _link_groups(bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            key, fp = np.r_[key, b.column(0).to_numpy()], np.r_[fp, b.column(1).to_numpy()]
            if len(key) >= RUN_ROWS:
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                yield from _stars(key[:cut], fp[:cut], bits)
                key, fp = key[cut:], fp[cut:]
        yield from _stars(key, fp, bits)

    return link


def _field(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """distinct(fp) -> (a, b): links that connect just the fingerprints that chains of at most `bits` differing bits connect."""
    if bits > MAX_BITS:
        raise ValueError(f"pairs of four bands find up to {MAX_BITS} differing bits")
    fp = F.col("fp")
    long = lambda x: F.lit(x).cast("long")
    pair_keys = [F.shiftleft(long(n), 32).bitwiseOR(F.shiftleft(_field(fp, 16 * b, 16), 16)).bitwiseOR(_field(fp, 16 * a, 16)) for n, (a, b) in enumerate(_PAIRS)]
    keyed = distinct.select("fp", F.explode(F.array(*pair_keys)).alias("pair_key"))
    hot = keyed.groupBy("pair_key").count().filter(F.col("count") > HOT_GROUP).select("pair_key", F.lit(True).alias("hot"))
    # What the pair leaves open: four bytes.
    finer = F.lit(None)
    for n, pair in reversed(list(enumerate(_PAIRS))):
        spare = [16 * b + o for b in range(4) if b not in pair for o in (0, 8)]
        keys = [F.shiftleft(long(m + 1), 16).bitwiseOR(F.shiftleft(_field(fp, spare[j], 8), 8)).bitwiseOR(_field(fp, spare[i], 8)) for m, (i, j) in enumerate(_PAIRS)]
        finer = F.when(F.shiftrightunsigned("pair_key", 32) == n, F.array(*keys)).otherwise(finer)
    dealt = keyed.join(hot, "pair_key", "left").select(F.shiftleft("pair_key", 19).alias("whole_key"), "fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array(long(0)))).alias("part"))
    dealt = dealt.select(F.col("whole_key").bitwiseOR(F.col("part")).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_link_groups(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fp (signed long) and component_id, the least id that links reach.

    Null texts and texts without words have fingerprint 0 and link like any other.  Rows with a null id take part; they
    get the least id of their component (null if it has none).  Repeated rows each return.  Texts of any length are read
    whole.  An empty table gives an empty result, other columns are ignored.
    """
    made = materialise(fingerprints(docs, id_col, text_col, words), "fp")
    distinct = materialise(made.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fp")
    tree = components(links(distinct, bits))
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(rooted.join(named, "root").select("fp", "component_id"), "fp-component")
    return made.join(by_fp, "fp", "left").select(id_col, "fp", "component_id")


def class_links(classes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """classes(class, fp) -> (a, b): classes to compare, since their fingerprints are equal or chains of at most `bits`
    differing bits connect them.  Each fingerprint is represented by its least class."""
    least = materialise(classes.groupBy("fp").agg(F.min("class").alias("least")), "fp-class")
    equal = classes.join(least, "fp").filter(F.col("class") != F.col("least")).select(F.col("least").alias("a"), F.col("class").alias("b"))
    near = links(least.select("fp"), bits)
    ends = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("ca")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("cb")), "b")
    return equal.unionAll(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).distinct()


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = minhash.LEAST) -> DataFrame:
    """One row per document: id and component_id, the least id that links of a five-word Jaccard similarity of at least
    `least` reach.

    Candidates are the links of five-word SimHash fingerprints through the Gray-order index.  Within the two bits that the
    index finds for certain lie few pairs of that similarity (a pair at 0.8 differs in some ten of 64 bits), so the bands of
    minhash.near_duplicates() add the others; each link of either is verified, and pairs that it does not bear out are
    dropped.  Nulls, empty texts, repeats, empty tables and other columns are as there.
    """
    return minhash.near_duplicates(docs, id_col, text_col, least, fingerprint=of_hashes, also=class_links)
