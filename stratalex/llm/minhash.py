"""MinHash document fingerprints.

Shingles of five words are hashed once; PERMUTATIONS universal hash functions (multiply-shift over 64 bits) are applied
to all of them in numpy, and the minimum of each is kept, cut to 16 bits.  The share of equal places estimates the
Jaccard similarity of two texts' shingles.  Documents are dealt by ranges of their id to meet the next one; texts travel
compressed, once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.llm.common import bitmap, discard, in_bitmap, materialise, tune, type_of, whole
from stratalex.llm.components import components

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of the similarity join and places of the signature in each: at a similarity of 0.8 a pair shares one with
#: probability 1 - (1 - 0.8**4)**32 > 0.9999999.
BANDS, ROWS = 32, 4
LEAST = 0.8
#: The rows of fingerprint_chain() that are asked against all: those whose id is divisible by this.
EVERY = 100
#: Texts asked for that may stand in one row.
SLOT = 1000
#: Rounds of drawn pairs in groups of several components.
DRAWS = 1
#: Buckets of shingles whose counts order the prefix join, and what rounding may take from a bound.
BUCKETS = 1 << 20
EPS = 1e-9
_draw = np.random.default_rng(20_231)
_A = _draw.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False) | np.uint64(1)
_B = _draw.integers(0, 1 << 64, PERMUTATIONS, np.uint64, endpoint=False)
_EMPTY = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
_HASH = partial(xxhash.xxh64_intdigest, seed=7)


def split(text: str) -> list[bytes]:
    """Words, between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def full_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles, in order; of fewer words the whole sequence is the one shingle; of none, none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([_HASH(b" ".join(words))], np.uint64)
    return np.fromiter(map(_HASH, map(b" ".join, zip(*(words[i:] for i in range(size))))), np.uint64, len(words) - size + 1)


def hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """32 bits of the shingles' hashes."""
    return full_hashes(words, size) >> np.uint64(32)


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each permutation."""
    out = _EMPTY
    for at in range(0, len(h), 512):
        x = np.multiply.outer(_A, h[at : at + 512])
        x += _B[:, None]
        out = np.minimum(out, x.min(axis=1))
    return out


def signature(least: np.ndarray) -> bytes:
    """The lowest 16 bits of each minimum's 32-bit hash value, big-endian."""
    return (least >> np.uint64(32)).astype(np.uint16).astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal places."""
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def fingerprint(text: str | None) -> bytes:
    return signature(minima(hashes(split(text or ""))))


class Document:
    """A text with its words and the minima of its first shingles, for edits that keep its beginning."""

    def __init__(self, text: str):
        self.text, self.words = text, split(text)
        self.h = hashes(self.words)
        self.cut = len(text) - len(text) // 4
        # Words that the first three quarters hold for certain, and the shingles that lie in them.
        self.kept = max(0, len(split(text[: self.cut])) - 1)
        self.head = max(0, self.kept - SHINGLE + 1) if len(self.words) >= SHINGLE else 0
        self.least = minima(self.h[: self.head])
        self.signature = signature(np.minimum(self.least, minima(self.h[self.head :])))

    def edited(self, following: str) -> tuple[str, bytes]:
        """The text with its last quarter replaced by the beginning of the following one, and its fingerprint."""
        n = len(self.text) // 4
        text = self.text[: self.cut] + following[:n]
        words = split(text)
        if self.head and len(words) >= SHINGLE:
            return text, signature(np.minimum(self.least, minima(hashes(words[self.head :]))))
        return text, signature(minima(hashes(words)))


def _pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for b in batches:
            bodies = [t.encode() for t in b.column(1).to_pylist()]
            tie = [xxhash.xxh64_intdigest(t) >> 1 for t in bodies]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tie, pa.int64()), pa.array([press.compress(t) for t in bodies], pa.binary()), b.column(2)], names=["id", "tie", "body", "h"])

    rows = docs.select(F.col(id_col), whole(text_col).alias("text")).select(id_col, "text", _text_hash(F.col("text")).alias("h"))
    return rows.mapInArrow(make, f"id {type_of(docs, id_col)}, tie long, body binary, h long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


_DONE = "n_chars long, sig binary, edited_sig binary, edited_sha256 binary, near_edited double, near_next double"


def _facts(a: Document, b: Document) -> list:
    text, sig = a.edited(b.text)
    return [len(a.text), a.signature, sig, hashlib.sha256(text.encode()).digest(), likeness(a.signature, sig), likeness(a.signature, b.signature)]


def _pairs(schema: pa.Schema):
    """Rows in the order of ids -> the facts of each row but the last; bodies of the first (edge 0) and the last (1)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        last, last_key, last_body, rows = None, None, None, []
        for b in batches:
            for *key, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist()):
                doc = Document(open_.decompress(body).decode())
                rows.append([*key, part, 0, body] + [None] * 6 if last is None else [*last_key, None, None, None, *_facts(last, doc)])
                last, last_key, last_body = doc, key, body
            yield _batch(rows, schema)
            rows = []
        if last is not None:
            yield _batch([[*last_key, part, 1, last_body] + [None] * 6], schema)

    return walk


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least: float = LEAST) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_alike,
    alike_id.

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones of the next document, by
    ascending id (null ids first, equal ids by a hash of the text; after the last comes the first).  A null text counts
    as empty; without words a fingerprint is all ones, and two of these are alike (1.0).  A table of one row follows
    itself; an empty table gives an empty result; texts of any length are read whole; other columns are ignored.

    n_alike and alike_id answer the queries, the rows whose id is divisible by `every`, against all rows (see alike()):
    how many others are verified to be alike, and the least id among them; null for rows that are no queries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    tune(docs.sparkSession)
    spark = docs.sparkSession
    id_type = type_of(docs, id_col)
    ddl = f"id {id_type}, h long, part int, edge int, body binary, {_DONE}"
    arrow = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    ordered = _pack(docs, id_col, text_col).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    made = materialise(ordered.mapInArrow(_pairs(arrow), ddl), "chain")
    # Two rows of each part meet across its borders: the last of one with the first of the next.
    edges = made.filter(F.col("edge").isNotNull()).select("id", "h", "part", "edge", "body")
    parts = edges.filter("edge = 0").select("part")
    nth = parts.select("part", F.row_number().over(W.orderBy("part")).alias("nth"))  # one row per part
    nth = nth.select("part", "nth", F.count(F.lit(1)).over(W.partitionBy()).alias("of"))
    first = edges.filter("edge = 0").join(nth, "part").select(F.col("nth").alias("to"), F.col("body").alias("following"))
    last = edges.filter("edge = 1").join(nth, "part").select("id", "h", "body", (F.pmod("nth", "of") + 1).alias("to"))
    out = to_arrow_schema(spark.createDataFrame([], f"id {id_type}, h long, {_DONE}").schema)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [[open_.decompress(x).decode() for x in b.column(k).to_pylist()] for k in (2, 3)]
            yield _batch([[*key, *_facts(Document(x), Document(y))] for *key, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *texts)], out)

    closed = materialise(last.join(first, "to").select("id", "h", "body", "following").mapInArrow(close, f"id {id_type}, h long, {_DONE}"), "closed")
    both = made.filter(F.col("edge").isNull()).select(*closed.columns).unionByName(closed)
    asked = F.coalesce(F.col("id") % every == 0, F.lit(False)) if id_type in ("bigint", "int", "smallint", "tinyint") else F.lit(False)
    found = materialise(alike(docs, both.select("id", "h", "sig"), asked, text_col, least), "alike")
    answered = both.filter(asked).join(found.select(F.col("h").alias("of"), "n_alike", F.col("ids").alias("ids")), F.col("h") == F.col("of"), "left").drop("of")
    other = F.get(F.filter("ids", lambda x: ~x.eqNullSafe(F.col("id"))), F.lit(0))
    answered = answered.select(*closed.columns, F.coalesce("n_alike", F.lit(0)).cast("long").alias("n_alike"), other.alias("alike_id"))
    none = F.lit(None)
    every_row = answered.unionByName(both.filter(~asked).select("*", none.cast("long").alias("n_alike"), none.cast(id_type).alias("alike_id")))
    text = lambda c: F.lower(F.hex(c))
    return every_row.select(F.col("id").alias(id_col), "n_chars", text("edited_sha256").alias("edited_sha256"), text("sig").alias("fingerprint"), text("edited_sig").alias("edited_fingerprint"), "near_edited", "near_next", "n_alike", "alike_id")


def _bands(sig: Column | str = "sig") -> Column:
    """The keys of a signature's bands."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(sig, i * 2 * ROWS + 1, F.lit(2 * ROWS))))


def alike(docs: DataFrame, rows: DataFrame, asked: Column, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """rows(id, h, sig) of docs, `asked` a condition on them -> (h, n_alike, ids): for each text asked for, by its hash, the
    number of other rows whose five-word shingles have a Jaccard similarity of at least `least`, and the two least ids
    (its own may be among them).

    Texts are compared once, however many rows hold them.  The bands of the texts asked for are joined with those of all
    texts; a bitmap keeps back the bands that none of them has.  Every pair that shares a band is verified, on the shingles
    of both texts, which are made for these texts alone.
    """
    texts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max(F.when(asked, 1)).alias("asked"), F.first("sig").alias("sig"))
    texts = materialise(texts.select(F.col("h").alias("class"), "n", "first", "asked", "sig"), "texts")
    twice = texts.filter("asked = 1 and n > 1").select(F.col("class").alias("h"), "first")
    second = rows.join(materialise(twice, "twice"), "h").filter("id <> first").groupBy("h").agg(F.min("id").alias("second"))
    asking = texts.filter("asked = 1")
    # The texts asked for that share a band stand in one row, dealt into slots of some SLOT of all, so that a pair of many
    # common bands is written out once.
    slot = F.pmod(F.xxhash64("class"), F.lit(max(1, asking.count() // SLOT)))
    mine = asking.select("class", slot.alias("slot"), F.explode(_bands()).alias("key")).groupBy("key", "slot").agg(F.collect_list("class").alias("asked"))
    mine = materialise(mine, "asked-bands")
    theirs = in_bitmap(texts.select(F.col("class").alias("b"), F.explode(_bands()).alias("key")), bitmap(mine, F.col("key")), F.col("key"), "met").filter("met").drop("met")
    met = materialise(theirs, "met-bands").join(mine, "key").groupBy("b", "slot").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked"))
    pairs = materialise(met.select(F.explode("asked").alias("a"), "b").filter("a <> b"), "pairs")
    wanted = materialise(pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct(), "wanted")
    some = docs.select(whole(text_col).alias("text")).select("text", _text_hash(F.col("text")).alias("class"))
    some = in_bitmap(some, bitmap(wanted, F.col("class")), F.col("class"), "met").filter("met").select("class", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(hashes(split(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.uint32).view(np.int32) for x in h], pa.list_(pa.int32()))], names=["class", "shingles"])

    sets = some.mapInArrow(make, "class long, shingles array<int>").join(wanted, "class", "left_semi")
    sets = materialise(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    near = materialise(_alike(pairs, sets, least), "near")
    own = texts.filter("asked = 1").select(F.col("class").alias("a"), (F.col("n") - 1).alias("n"), "first")
    own = own.join(second, own.a == second.h, "left").select("a", "n", F.array_compact(F.array("first", "second")).alias("ids"))
    others = near.join(texts.select(F.col("class").alias("b"), "n", "first"), "b").groupBy("a").agg(F.sum("n").alias("more"), F.min("first").alias("least"))
    all_ids = F.slice(F.sort_array(F.array_compact(F.concat("ids", F.array("least")))), 1, 2)
    return own.join(others, "a", "left").select(F.col("a").alias("h"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_alike"), all_ids.alias("ids"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(id, sig, shingles, fp): the signature and the sorted distinct shingle hashes (their 32 bits as ints) of each
    document, and what `fingerprint` makes of its 64-bit ones (as a signed long; else 0)."""
    tune(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [full_hashes(split(t.as_py())) for t in b.column(1)]
            h = [np.unique(x >> np.uint64(32)) for x in full]
            fp = np.array([fingerprint(x) if fingerprint else 0 for x in full], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(minima(x)) for x in h], pa.binary()), pa.array([x.astype(np.uint32).view(np.int32) for x in h], pa.list_(pa.int32())), pa.array(fp)], names=["id", "sig", "shingles", "fp"])

    return docs.select(F.col(id_col), whole(text_col).alias("text")).mapInArrow(make, f"id {type_of(docs, id_col)}, sig binary, shingles array<int>, fp long")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have a Jaccard similarity of at least `least`."""
    met = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(both >= least * (F.size("sa") + F.size("sb") - both) - EPS).select("a", "b")


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of BUCKETS."""
    token = F.explode("shingles").alias("token")
    counts = sets.select(token).groupBy(F.col("token").bitwiseAND(BUCKETS - 1).alias("bucket")).count().toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    return out


def _prefix_candidates(sets: DataFrame, least: float) -> DataFrame:
    """sets(class, root, shingles) -> (a, b): all pairs of different roots that may be alike.

    Sets are read from their rarest bucket on.  Two that are alike share a shingle within the first n - ceil(least * n) + 1
    of each, and what follows their first common shingle is long enough for the overlap that they need.  Both hold in any
    order that all sets have in common, so no pair is lost.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_bucket_counts(sets))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for b in batches:
            rows = []
            for key, root, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = s.values.to_numpy()
                often = seen[s & (BUCKETS - 1)]
                n = len(s)
                first = np.lexsort((s, often))[: n - int(np.ceil(least * n - EPS)) + 1]
                at = np.flatnonzero(often[first] > 1)  # others are in no other set
                rows.append((s[first][at], np.full(len(at), key), np.full(len(at), root), np.full(len(at), n, np.int32), at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["token", "class", "root", "n", "at"])

    filled = sets.filter("size(shingles) > 0").select("class", "root", "shingles")
    heads = materialise(filled.mapInArrow(make, "token int, class long, root long, n int, at int"), "heads")
    x, y = (heads.select("token", *(F.col(c).alias(c + side) for c in ("class", "root", "n", "at"))) for side in "ab")
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    fits = rest >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - EPS
    pairs = x.join(y, (x.token == y.token) & (F.col("classa") < F.col("classb")) & (F.col("roota") != F.col("rootb")) & fits)
    return pairs.select(F.col("classa").alias("a"), F.col("classb").alias("b")).distinct()


def _named(classes: DataFrame, tree: DataFrame) -> DataFrame:
    """(class, root)."""
    return classes.select("class").join(tree, F.col("class") == tree.node, "left").select("class", F.coalesce("root", "class").alias("root"))


def _drawn(members: DataFrame, turn: int) -> DataFrame:
    """members(key, class, n, root) of groups in several components -> (a, b): pairs of different roots, drawn within each
    group by dealing it into n / 2 slots: as many pairs as members at most."""
    slot = F.pmod(F.xxhash64("class", "key", F.lit(turn)), F.ceil(F.col("n") / 2))
    ends = members.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("class", "root")).alias("x"), F.max(F.struct("class", "root")).alias("y"))
    return ends.filter("x.root <> y.root").select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, fingerprint: Callable[[np.ndarray], int] | None = None, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per document: id and component_id, the least id that links of verified similarity reach.

    Documents of equal shingles are one class, and classes that share a band form a group.  First each class of a group is
    compared with the group's least one (and with those that `also` names: classes(class, fp) -> (a, b)).  Groups that are
    then of several components get DRAWS rounds of drawn pairs, which join what is much alike at a cost that grows with the
    group alone.  All pairs of classes that still lie in different components are settled by an exact prefix join, so no
    pair of a shared band is left out.  Similarities are of the sets of 32-bit shingle hashes.

    A null text counts as empty; texts without words are alike.  Rows with a null id take part and get the least id of
    their component (null if it has none); repeated rows each return; texts of any length are read whole; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    made = materialise(signatures(docs, id_col, text_col, fingerprint).withColumn("class", F.xxhash64("shingles")), "signatures")
    classes = materialise(made.groupBy("class").agg(F.min("id").alias("least"), F.first("sig").alias("sig"), F.min("fp").alias("fp")), "classes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring("sig", i * 2 * ROWS + 1, F.lit(2 * ROWS)).alias("key"))))
    banded = classes.select("class", band.alias("b")).select("class", F.xxhash64("b.band", "b.key").alias("key"))
    banded = materialise(banded, "banded")
    leaders = materialise(banded.groupBy("key").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaders")
    shared = in_bitmap(banded, bitmap(leaders, F.col("key")), F.col("key"), "shared").filter("shared").drop("shared")
    grouped = materialise(shared.join(leaders, "key"), "grouped")
    discard(banded, leaders)
    stars = grouped.filter("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b"))
    pairs = stars if also is None else stars.unionAll(also(classes.select("class", "fp")))
    pairs = materialise(pairs.distinct(), "pairs")
    compared = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    compared = materialise(compared, "compared")
    sets = in_bitmap(made.select("class", "shingles"), bitmap(compared, F.col("class")), F.col("class"), "compared").filter("compared").drop("compared")
    sets = sets.join(compared, "class", "left_semi")
    sets = materialise(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    labels = materialise(_named(sets, components(_alike(pairs, sets, least))), "labels")
    discard(pairs, compared)
    members, held = grouped.select("key", "class", "n"), grouped
    for turn in range(DRAWS + 1):
        named = members.join(labels, "class")
        mixed = materialise(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "mixed")
        open_ = materialise(named.join(mixed, "key", "left_semi"), "open")
        discard(mixed, held)
        if turn == DRAWS:
            unsettled = sets.join(open_.groupBy("class").agg(F.min("root").alias("root")), "class")
            found = _prefix_candidates(materialise(unsettled, "unsettled"), least)
        else:
            found = _drawn(open_.filter("n > 2"), turn)
            members = open_.select("key", "class", "n")  # settled groups stay so
        found = materialise(found, "found")
        # Links between components, as few as there are, decide how these meet.
        links = _alike(found, sets, least)
        for side in "ab":
            links = links.join(labels.select(F.col("class").alias(side), F.col("root").alias(f"root_{side}")), side)
        met = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        grown = labels.join(met, labels["root"] == met["node"], "left").select("class", F.coalesce(met["root"], labels["root"]).alias("root"))
        grown = materialise(grown, "labels")
        discard(labels, found)
        labels, held = grown, open_
    named = classes.select("class", "least").join(labels, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialise(named.join(roots, "root").select("class", "component_id"), "class-component")
    discard(held, sets, labels)
    return made.select("id", "class").join(by_class, "class").select(F.col("id").alias(id_col), "component_id")
