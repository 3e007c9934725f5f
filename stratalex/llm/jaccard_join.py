"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents of equal shingle sets are one class.  Every set is read in one order, rarest shingles first.  If two sets are alike,
so that they share t shingles or more, their first n - t + l shingles have l in common, for any l up to t.  So a longer prefix
lets a pair be dismissed that shares less, at the price of more matches: each class asks with the l that is cheapest for it.

1. Counts of shingles by bucket fix the order (one pass over the texts; BUCKETS bytes, whatever the corpus' size): what many
   documents share comes last, and stays out of most prefixes.
2. Each class writes the shingles of its longest prefix; those that no other class wrote are dropped.
3. Lists (the classes that wrote one shingle) are joined by stars: each class with the least one of its list and of about
   its length, then by drawn pairs.  Most copies of one text meet here, at a cost that grows with the lists alone.
4. Lists that still hold classes of different components decide the rest: each class takes its l from what their lengths
   make it cost, pairs that match l times and can reach the overlap are verified, and none else.

Every link is verified on both whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm import minhash
from stratalex.llm.common import bitmap, bucketed, discard, in_bitmap, materialise, tune, type_of, whole
from stratalex.llm.components import components

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, LEAST = 5, 80
#: The most matches that a prefix may ask for.
MATCHES = 4
#: What it costs to verify a pair, in matches: a share of its shingles.
VERIFY = 1 / 8
#: Buckets of shingles whose counts order the sets, and how many of them travel in one row.
BUCKETS, BLOCK = 1 << 24, 1 << 16
#: Pairs of classes of different components that lists may give for each of their rows before more pairs are drawn, and
#: the most rounds of that.
CROSSING, ROUNDS = 8, 3
#: Rows of a list in one run, and those of all its lists that a class meets at a time, about.
RUN, MEET = 512, 500_000
#: Lists that the pairs of a class are dealt into where they meet its bitmap.
SLOTS = 8
#: Parts of the shingles of prefixes that are counted one after the other, so that what is shuffled for it is on disk in parts.
SLICES = 2
#: Hashes of words that a worker keeps, and of sets.
WORDS = 500_000
_ODD = np.random.default_rng(5_080).integers(0, 1 << 64, (SHINGLE, SHINGLE), np.uint64, endpoint=False) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


_known = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, each a sum of its words' hashes times odd numbers that go with their
    place, mixed; fewer words are one shingle, with numbers of their own, none are none."""
    words = minhash.split(text or "")
    if len(_known) > WORDS:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    if not size:
        return h
    odd = _ODD[size - 1]
    x = h[: len(h) - size + 1] * odd[0]
    for k in range(1, size):
        x += h[k : len(h) - size + 1 + k] * odd[k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def required(n, least: int = LEAST):
    """Shingles that a set of n must share with one that is like it."""
    return -(-n * least // 100)


def _facts(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(id, class, other, n) of each row, and (block, counts): how many shingles of a task's texts are in each bucket.
    class: a hash of the set (null if it is empty); other: a second one, to tell sets of one hash apart."""
    names = ["id", "class", "other", "n", "block", "counts"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint16)  # an overflow would change the order, for all sets alike
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            for s in sets:
                np.add.at(counts, s & np.uint64(BUCKETS - 1), 1)
            class_, other = ([_signed(xxhash.xxh64_intdigest(s.tobytes(), k)) if len(s) else None for s in sets] for k in (seed * 2, seed * 2 + 1))
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(class_, pa.int64()), pa.array(other, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), none, pa.nulls(len(sets), pa.binary())], names=names)
        some = [k for k in range(BUCKETS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        packed = [zstandard.compress(counts[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in some]
        none = [pa.nulls(len(some), t) for t in (id_type, pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"id {type_of(docs, id_col)}, class long, other long, n int, block int, counts binary"
    return docs.select(id_col, text_col).mapInArrow(make, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _often(facts: DataFrame) -> np.ndarray:
    """How often shingles of each bucket occur, on a scale of 16 steps to a doubling: the counts of all tasks, added block by
    block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, np.int64)

        def done():
            scale = np.minimum(255, np.rint(16 * np.log2(total + 1))).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([scale.tobytes()], pa.binary())], names=["block", "often"])

        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield done()
                    at, total = block, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(zstandard.decompress(packed), np.uint16)
        if at is not None:
            yield done()

    dealt = facts.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(BUCKETS, np.uint8)
    for block, often in dealt.mapInArrow(add, "block int, often binary").collect():  # BUCKETS bytes in all
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(often, np.uint8)
    return out


def _prefixes(texts: DataFrame, often: np.ndarray, seed: int, least: int) -> DataFrame:
    """texts(text) -> (token, class, n, p, level): the shingles of each longest prefix, p their place, level the least number
    of matches whose prefix reaches them.  A class that a task has just met is not written again."""
    seen = texts.sparkSession.sparkContext.broadcast(often)  # BUCKETS bytes

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, met = seen.value, set()
        for b in batches:
            rows = [[np.empty(0, t)] for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
            for t in b.column(0):
                s = shingles(t.as_py())
                n = len(s)
                class_ = _signed(xxhash.xxh64_intdigest(s.tobytes(), seed * 2))
                if not n or class_ in met:
                    continue
                if len(met) >= WORDS:
                    met.clear()
                met.add(class_)
                spare = n - required(n, least)
                first = s[np.lexsort((s, often[s & np.uint64(BUCKETS - 1)]))[: spare + MATCHES]]
                p = np.arange(len(first), dtype=np.int32)
                one = (first.view(np.int64), np.full(len(p), class_), np.full(len(p), n, np.int32), p, np.maximum(1, p - spare + 1))
                for all_, x in zip(rows, one):
                    all_.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows[:4]] + [pa.array(np.concatenate(rows[4]).astype(np.int32))], names=["token", "class", "n", "p", "level"])

    return texts.mapInArrow(make, "token long, class long, n int, p int, level int")


def bits_of(s: np.ndarray) -> np.ndarray:
    """A set as a bitmap of two to four bits a shingle, in 64-bit words, as many as a power of two."""
    size = 64 << max(0, (2 * max(1, len(s)) - 1).bit_length() - 6)
    out = np.zeros(size // 8, np.uint8)
    at = (s & np.uint64(size - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view("<i8")


def may_be_alike(least: int) -> Column:
    """Whether two sets (na, bita, nb, bitb) can be alike by their bitmaps: every bit that differs stands for a shingle that only
    one of them has.  The longer bitmap is folded to the shorter one's length."""
    fold = lambda bits, size: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, size), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(bits, j))))
    a, b = F.col("bita"), F.col("bitb")
    a_, b_ = F.when(F.size(a) > F.size(b), fold(a, F.size(b))).otherwise(a), F.when(F.size(b) > F.size(a), fold(b, F.size(a))).otherwise(b)
    differ = F.aggregate(F.zip_with(a_, b_, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    both = F.floor((F.col("na") + F.col("nb") - differ) / 2)
    return both * 100 >= (F.col("na") + F.col("nb") - both) * least


def _sets(texts: DataFrame, seed: int) -> DataFrame:
    """(class, shingles, bits)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in (shingles(t.as_py()) for t in b.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), seed * 2)) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bits_of(s) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles", "bits"])

    return texts.mapInArrow(make, "class long, shingles array<long>, bits array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) of classes whose sets are alike.  Bitmaps go first, so that whole sets meet for few others; the sets of
    classes that no such pair has do not move."""
    small = lambda side: sets.select(F.col("class").alias(side), F.size("shingles").alias(f"n{side}"), F.col("bits").alias(f"bit{side}"))
    asking = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(SLOTS)).alias("slot")).agg(F.collect_list("b").alias("bs"))
    asking = asking.join(small("a"), "a").select("a", "na", "bita", F.explode("bs").alias("b"))
    pairs = materialise(asking.join(small("b"), "b").filter(may_be_alike(least)).select("a", "b"), "pairs")
    ends = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("class")), F.col("class"))
    sets = in_bitmap(sets.select("class", "shingles"), materialise(ends, "ends"), F.col("class"), "met").filter("met")
    met = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return met.filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * least).select("a", "b")


def _listed(entries: DataFrame) -> DataFrame:
    """The entries whose shingle comes more than once, once for each class; dealt by the shingle.  Only shingles move to be
    counted: most come once.  A list may hold one class alone, where rows without an id repeat it; it joins nothing."""
    slices = [entries.filter(F.pmod("token", F.lit(SLICES)) == k).groupBy("token").count().filter("count > 1").select("token") for k in range(SLICES)]
    slices = [materialise(x, "shared") for x in slices]
    shared = reduce(DataFrame.unionAll, slices)
    listed = in_bitmap(entries, bitmap(shared, F.col("token")), F.col("token"), "met").filter("met").drop("met")
    # The hint: else rows of few tokens might be written where they lie, a file for each bucket and task.
    listed = bucketed(listed.join(shared.hint("merge"), "token", "left_semi").dropDuplicates(["token", "class"]), "listed", "token")
    discard(*slices)
    return listed


def _stars(listed: DataFrame, least: int) -> DataFrame:
    """Pairs of each class with the least one of its list and of about its length.  listed is dealt by token, so no row moves."""
    band = F.floor(F.log("n") / math.log(100 / least)).cast("int").alias("band")
    near = listed.filter("level = 1").select("token", band, "class", "n")
    leaders = near.groupBy("token", "band").agg(F.min(F.struct("class", "n")).alias("x")).select("token", F.col("band").alias("of"), F.col("x.class").alias("a"), F.col("x.n").alias("na"))
    # Not ==, which would become a second key, by which nothing is dealt.
    pairs = near.join(leaders.hint("merge"), "token").filter(F.col("of").between(F.col("band"), F.col("band")) & (F.col("class") != F.col("a")))
    fits = F.least("n", "na") * 100 >= F.greatest("n", "na") * least
    return pairs.filter(fits).select("a", F.col("class").alias("b")).distinct()


def _matches(open_: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """open_(token, class, n, p, level), held(token, held) -> (class, matches, rows): how many matches each class asks for.  A
    prefix costs the rows that its lists hold, and the pairs that may match often enough in them cost their verification."""
    rows = [F.sum(F.when(F.col("level") <= k, F.col("held") - 1).otherwise(0)).alias(f"rows{k}") for k in range(1, MATCHES + 1)]
    cost = open_.select("token", "class", "n", "level").join(held, "token").groupBy("class", "n").agg(*rows)
    needs = F.ceil(F.col("n") * least / 100)
    costs = [F.when(F.lit(k) <= needs, F.struct((F.col(f"rows{k}") * (1 + VERIFY * F.col("n") / k)).alias("cost"), F.lit(k).alias("k"), F.col(f"rows{k}").alias("rows"))) for k in range(1, MATCHES + 1)]
    best = cost.select("class", F.array_min(F.array_compact(F.array(*costs))).alias("x"))
    return best.select("class", F.col("x.k").alias("matches"), "x.rows")


def _power(x: Column) -> Column:
    """The least power of two that is not below x."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x.cast("double"), F.lit(1.0))))).cast("int")


def candidates(open_: DataFrame, least: int = LEAST) -> DataFrame:
    """open_(token, class, root, n, p, level): whole prefixes over lists -> (a, b): all pairs of classes of different roots
    that may be alike.

    The longer set (x) of a pair asks; of the shorter one (y) a shorter prefix is enough.  What lies behind a match, with the
    matches before it, must reach the overlap.  A list is dealt into runs of about RUN rows by a hash of the class, and x meets
    runs, not rows; who has many rows to meet meets them in parts, by the same hash.  So matches are counted where they meet, and
    only pairs leave.
    """
    held = materialise(open_.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "held")
    matches = materialise(_matches(open_, held, least), "matches")
    part = 100 + least
    h = F.xxhash64("class").bitwiseAND(F.lit((1 << 30) - 1).cast("long")).cast("int")
    short = open_.filter((F.col("n") - F.col("p") + (MATCHES - 1)) * part >= F.col("n") * 2 * least).join(held, "token")
    short = short.withColumns({"h": h, "runs": _power(F.col("held") / RUN)})
    runs = short.groupBy("token", "runs", F.col("h").bitwiseAND(F.col("runs") - 1).alias("run")).agg(F.collect_list(F.struct("class", "root", "n", "p", "level", "h")).alias("ys"))
    asking = open_.join(matches, "class").filter("level <= matches").select("token", "class", "root", "n", "p", "matches", _power(F.col("rows") / MEET).alias("parts"))
    met = asking.join(materialise(runs, "runs"), "token")
    # What cannot be among the first matches of two that are alike stays behind, and of the rest what the task that counts does
    # not read; it looks at lengths and places again.
    behind = lambda y: F.least(F.col("n") - F.col("p"), y["n"] - y["p"]) + F.col("matches") - 1
    near = lambda y: (y["root"] != F.col("root")) & (y["level"] <= F.col("matches")) & (y["n"] <= F.col("n")) & (behind(y) * part >= (F.col("n") + y["n"]) * least)
    left = lambda y: F.struct(y["class"].alias("class"), y["n"].alias("n"), y["p"].alias("p"), y["h"].alias("h"))
    met = met.withColumn("ys", F.transform(F.filter("ys", near), left)).filter(F.size("ys") > 0)
    # The parts that a run has rows of: one, or several where it is wider than a part.
    more = F.greatest(F.lit(1), F.col("parts") / F.col("runs")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), more - 1), lambda i: F.col("run").bitwiseAND(F.col("parts") - 1) + i * F.col("runs"))
    met = met.select("class", F.explode(parts).alias("part"), "n", "p", "matches", "parts", "ys")
    met = met.repartition("class", "part").sortWithinPartitions("class", "part")
    return met.mapInArrow(_count_matches(least), "a long, b long")


def _count_matches(least: int):
    def pairs(m: np.ndarray) -> pa.RecordBatch:
        """Rows (x, y, n of x, n of y, p of x, p of y, matches asked) of whole groups -> the pairs that match often enough."""
        m = m[:, np.lexsort((m[1], m[0]))]
        first = np.flatnonzero(np.r_[True, (m[:2, 1:] != m[:2, :-1]).any(axis=0)]) if m.shape[1] else np.empty(0, np.int64)
        found = np.diff(np.r_[first, m.shape[1]])
        x, y, nx, ny, _, _, asked = m[:, first]
        most = np.minimum(nx - np.minimum.reduceat(m[4], first), ny - np.minimum.reduceat(m[5], first)) if len(first) else nx
        keep = (found >= asked) & (most * (100 + least) >= (nx + ny) * least)  # all that they share lies behind the first match
        return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["a", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(("class", "part", "n", "p", "matches", "parts", "ys"))}
            lengths = c["ys"].value_lengths().to_numpy()
            one = lambda n: np.repeat(c[n].to_numpy().astype(np.int64), lengths)  # noqa: E731, B023
            ys = c["ys"].flatten()
            y, ny, py, h = (ys.field(k).to_numpy().astype(np.int64) for k in range(4))
            x, nx, px, asked = one("class"), one("n"), one("p"), one("matches")
            good = ((nx > ny) | ((nx == ny) & (x > y))) & (ny * 100 >= nx * least) & ((h & (one("parts") - 1)) == one("part"))
            good &= (np.minimum(nx - px, ny - py) + asked - 1) * (100 + least) >= (nx + ny) * least
            rows = np.stack([x, y, nx, ny, px, py, asked])[:, good]
            group = np.stack([x, one("part")])[:, good]
            last = (c["class"][-1].as_py(), c["part"][-1].as_py())
            ended = (group[0] != last[0]) | (group[1] != last[1])
            if held and key != last:
                yield pairs(np.concatenate([*held, rows[:, ended & (group[0] == key[0]) & (group[1] == key[1])]], axis=1))
                ended &= (group[0] != key[0]) | (group[1] != key[1])
                held = []
            yield pairs(rows[:, ended])
            held, key = [*held, rows[:, (group[0] == last[0]) & (group[1] == last[1])]], last
        if held:
            yield pairs(np.concatenate(held, axis=1))

    return count


def _open(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the lists that hold several roots, with their roots; dealt by token, as listed is.  Only rows of classes that
    are not their own root move, to be told so."""
    joined = materialise(labels.filter("root <> class"), "joined")
    bits = materialise(bitmap(joined, F.col("class")), "joined-bits")
    marked = in_bitmap(listed, bits, F.col("class"), "met")
    stay = marked.filter("not met").drop("met").withColumn("root", F.col("class"))
    told = marked.filter("met").drop("met").join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    told = bucketed(told.repartition("token"), "told", "token")
    ends = lambda rows, k: rows.groupBy("token").agg(F.min("root").alias(f"low{k}"), F.max("root").alias(f"high{k}"))
    both = ends(stay, 0).join(ends(told, 1).hint("merge"), "token", "full")
    mixed = bucketed(both.filter(F.least("low0", "low1") != F.greatest("high0", "high1")).select("token"), "mixed", "token")
    some = lambda rows: rows.join(mixed.hint("merge"), "token", "left_semi")
    out = bucketed(some(stay).unionByName(some(told)), "open", "token")
    discard(joined, bits, told, mixed)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(class, root) after links(a, b) of classes."""
    for side in "ab":
        links = links.join(labels.select(F.col("class").alias(side), F.col("root").alias(f"root_{side}")), side)
    met = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return materialise(labels.join(met, labels["root"] == met["node"], "left").select("class", F.coalesce(met["root"], labels["root"]).alias("root")), "labels")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two documents link when their sets of distinct five-word shingles (A-Z in lower case, words between ASCII white space)
    have a Jaccard similarity of least / 100 or more; component_id is the least id that links reach, the row's own included.
    Fewer than five words are one shingle; a null text and one without words have none and link with nothing.  Rows with a
    null id take part and get the least id of their component (null if it has none); repeated rows each return; texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.

    Shingles are compared by 64-bit hashes.  Two sets of one class hash are told apart by a second one; should it ever
    happen, the classes are made anew with another seed.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    seed = 0
    while True:
        made = materialise(_facts(docs, "id", "text", seed), "facts")
        rows = materialise(made.filter("block is null").select("id", "class", "n"), "rows")
        of = made.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
        classes = materialise(of, "classes")
        if classes.filter("low <> high").isEmpty():
            break
        seed += 1
    often = _often(made)
    discard(made)
    once = _representatives(docs, rows, classes)
    entries = materialise(_prefixes(once, often, seed, least), "entries")
    listed = _listed(entries)
    discard(entries)
    met = materialise(listed.select("class").distinct(), "met")
    texts = _representatives(docs, rows, classes, ["id", "text"])

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The verified ones of pairs: the texts of their classes alone are read again."""
        pairs = materialise(pairs, name)
        asked = materialise(pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct(), "asked")
        ids = F.xxhash64("id")
        wanted = bitmap(classes.join(asked, "class").select(F.col("least").alias("id")), ids)
        some = in_bitmap(texts, wanted, ids, "met").filter("met or id is null").select("text")
        sets = in_bitmap(_sets(some, seed), bitmap(asked, F.col("class")), F.col("class"), "met").filter("met").drop("met")
        sets = materialise(sets, "sets")
        # Few classes repeat, unless rows without an id or with the same one do; no other set moves to be told from its copies.
        twice = materialise(sets.groupBy("class").count().filter("count > 1").select("class"), "twice")
        marked = in_bitmap(sets, materialise(bitmap(twice, F.col("class")), "twice-bits"), F.col("class"), "twice")
        once = marked.filter("twice").groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
        once = materialise(once, "once")
        out = materialise(verified(pairs, marked.filter("not twice").drop("twice").unionAll(once), least), "links")
        discard(pairs, asked, sets, twice, once)
        return out

    labels = materialise(minhash._named(met, components(links(_stars(listed, least), "stars"))), "labels")
    for turn in range(ROUNDS + 1):
        open_ = _open(listed, labels)
        listed_once = open_.filter("level = 1")
        # Of a pair that is alike the shorter set's first match lies in its shorter prefix.
        short = listed_once.filter((F.col("n") - F.col("p")) * (100 + least) >= F.col("n") * 2 * least)
        held = short.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("n")).alias("own"))
        rows_of, pairs_of = held.agg(F.sum("held"), F.sum((F.col("held").cast("double") * F.col("held") - F.col("own")) / 2)).first()
        if turn == ROUNDS or (pairs_of or 0) <= CROSSING * (rows_of or 0):
            break
        # Drawn pairs: what is much alike meets at a cost that grows with the lists.
        counts = materialise(listed_once.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "held")
        drawn = minhash._drawn(listed_once.join(counts, "token").select(F.col("token").alias("key"), "class", F.col("held").alias("n"), "root"), turn)
        labels = _merged(labels, links(drawn, "drawn"))
        discard(open_, counts)
    labels = _merged(labels, links(candidates(open_, least), "candidates"))
    discard(open_, listed)
    named = classes.select("class", "least").join(labels, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = materialise(named.join(roots, "root").select("class", "component"), "class-component")
    out = rows.join(by_class, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _representatives(docs: DataFrame, rows: DataFrame, classes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """At least one row of each class, and few others: a row is left out if its id stands for no class.  Bitmaps decide, so no
    text moves; the few rows too many that they let through repeat a class."""
    h: Column = F.xxhash64("id")
    stand = classes.select(F.col("least").alias("id")).filter("id is not null")
    gone = rows.filter("id is not null and class is not null").join(classes.select("class", "least"), "class").filter("id <> least").select("id")
    away = materialise(bitmap(gone, h), "gone")
    kept = bitmap(in_bitmap(stand, away, h, "met").filter("met"), h)
    marked = in_bitmap(in_bitmap(docs, away, h, "away"), materialise(kept, "kept"), h, "kept")
    return marked.filter("not away or kept or id is null").select(*(columns or ["text"]))
