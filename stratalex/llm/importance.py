"""Importance resampling towards a target distribution, by hashed word n-grams over an integer word dictionary.

1. Texts are read chunk by chunk (CHUNK_CHARS of text).  A chunk maps its distinct words to integers and keeps its texts as
   sequences of them, packed, in a stored table that does not move again.
2. A chunk's distinct n-grams are tuples of word ids with their counts.  They are dealt by a hash into slices; a slice meets,
   from all chunks, its tuples and the words that these use, maps the distinct words to ids of its own, and so sees each
   distinct tuple of the whole corpus once: there its bytes are put together and hashed, once.
3. A tuple's bucket goes back to each chunk that has it, in the order in which it came, and its counts are added to the
   bucket's.  The bucket counts of corpus and target (BUCKETS numbers) give the gains.
4. A chunk joins buckets to the tuples of its texts by position; gains add up to a document's weight, and the draw is a
   rank over narrow rows, numbered by ranges.

A frequent n-gram is one entry of a chunk, so no slice is larger than others.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import bucketed, materialise, tune, type_of, whole
from stratalex.operators.windows import number_all

#: Code points after which a chunk is closed (a longer text is a chunk of its own).
CHUNK_CHARS = 16_000_000
#: Slices at least; else as many as chunks, so that a slice meets the same number of tuples whatever the corpus' size.
SLICES = 64
BUCKETS = 10_000
#: Share of the documents that is drawn, in hundredths, words that a document needs to be drawn, and the draw's seed.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Ids(dict):
    """A dictionary of words: each new one gets the next integer."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())  # of bytes, so A-Z only


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _chunks(id_type: pa.DataType):
    """(target, id, text) -> a row for each chunk: its ids, the number of words of each text, all words' ids, the words."""
    names = ["chunk", "target", "ids", "sizes", "places", "words"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, open_ = TaskContext.get().partitionId(), 0, None

        def close():
            target, ids, sizes, places, known, _ = open_
            row = [(part << 33) | n, target, ids, _pack(np.array(sizes)), _pack(np.concatenate(places)), zstandard.compress(b" ".join(known), 1)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.bool_(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()))], names=names)

        for b in batches:
            for target, id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                if open_ and (open_[0] != target or open_[5] + len(text) > CHUNK_CHARS):
                    yield close()
                    n, open_ = n + 1, None
                open_ = open_ or [target, [], [], [], Ids(), 0]
                found = words(text)
                open_[1].append(id_)
                open_[2].append(len(found))
                open_[3].append(np.fromiter(map(open_[4].__getitem__, found), np.int64, len(found)))
                open_[5] += len(text)
        if open_:
            yield close()

    return make


class Chunk:
    """The n-grams of a stored chunk: `tuples` its distinct (first, second + 1) word ids, second + 1 = 0 for a lone word, as one
    number, `of` the slice of each; dealt: their places, slice by slice."""

    def __init__(self, row: dict):
        self.sizes, places = _unpack(row["sizes"]), _unpack(row["places"])
        raw = zstandard.decompress(row["words"])
        self.words = raw.split(b" ") if raw else []
        self.base = len(self.words) + 1
        ends = np.cumsum(self.sizes)
        follows = np.ones(len(places), bool)
        follows[(ends - 1)[self.sizes > 0]] = False  # the last word of a text has none after it
        at = np.flatnonzero(follows)
        self.singles, self.doubles = places * self.base, places[at] * self.base + places[np.minimum(at + 1, len(places) - 1)] + 1
        # Where the n-grams of each text end among each kind.
        self.ends = ends, ends - np.cumsum(self.sizes > 0)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tuples, of each n-gram (lone words first, then pairs) its tuple, and the counts."""
        return np.unique(np.r_[self.singles, self.doubles], return_inverse=True, return_counts=True)

    def slices(self, tuples: np.ndarray, slices: int) -> np.ndarray:
        """The slice of each tuple, by a hash of its words."""
        h = np.array([0, *map(xxhash.xxh64_intdigest, self.words)], np.uint64)
        first, second = h[tuples // self.base + 1], h[tuples % self.base]
        mixed = (first ^ (second * np.uint64(0x9E3779B97F4A7C15) + (first << np.uint64(7)))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)


def _messages(slices: int):
    """Stored chunks -> a row for each slice of each: the words it uses, its tuples in their order, their counts."""
    names = ["slice", "chunk", "target", "words", "first", "second", "counts"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                chunk = Chunk(row)
                tuples, _, counts = chunk.distinct()
                of = chunk.slices(tuples, slices)
                dealt = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[dealt], np.arange(slices + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = dealt[cuts[k] : cuts[k + 1]]
                    first, second = tuples[mine] // chunk.base, tuples[mine] % chunk.base
                    used, at = np.unique(np.r_[first + 1, second], return_inverse=True)  # 0: no second word
                    said = zstandard.compress(b" ".join([chunk.words[i - 1] for i in used.tolist() if i]), 1)
                    lone = int(used[0] != 0)  # so that 0 stays no word
                    at = at + lone
                    out.append((k, row["chunk"], row["target"], said, _pack(np.diff(at[: len(mine)], prepend=0)), _pack(at[len(mine) :]), _pack(counts[mine])))
                    if len(out) == 16:
                        yield _rows(out, names)
                        out = []
                if out:
                    yield _rows(out, names)

    return make


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"slice": pa.int32(), "chunk": pa.int64(), "target": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.binary())) for c, n in zip(zip(*rows), names)], names=names)


_BACK = "chunk long, slice int, buckets binary, sums array<long>, target_sums array<long>"


def _hashed(buckets: int):
    """Messages, slice by slice -> (chunk, slice, buckets of its tuples in their order); at the end the counts of each bucket."""
    types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["chunk", "slice", "buckets", "sums", "target_sums"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        known, held, at = Ids(), [], None

        def done() -> Iterator[pa.RecordBatch]:
            tuples, of = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            said = list(known)
            bucket = np.fromiter((zlib.crc32(said[a] if b == 0 else said[a] + b" " + said[b - 1]) % buckets for a, b in zip((tuples >> 32).tolist(), (tuples & 0xFFFFFFFF).tolist())), np.int64, len(tuples))
            start = 0
            for chunk, target, t, counts in held:
                got = bucket[of[start : start + len(t)]]
                start += len(t)
                sums[int(target)] += np.bincount(got, counts, buckets).astype(np.int64)
                yield batch([(chunk, at, zstandard.compress(got.astype("<u2").tobytes(), 1), None, None)])

        for b in batches:
            for k, chunk, target, packed, first, second, counts in zip(*(c.to_pylist() for c in b.columns)):
                if k != at and held:
                    yield from done()
                    known, held = Ids(), []
                at = k
                mine = np.array([0, *(known[w] + 1 for w in zstandard.decompress(packed).split(b" "))], np.int64)
                held.append((chunk, target, ((mine[np.cumsum(_signed(first))] - 1) << 32) | mine[_unpack(second)], _unpack(counts)))
        if held:
            yield from done()
            yield batch([(None, None, None, sums[0].tolist(), sums[1].tolist())])

    return make


def _signed(packed: bytes) -> np.ndarray:
    return _unpack(packed).astype(np.uint32).view(np.int32).astype(np.int64)


def gains(sums: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's share of the target to that of the corpus, smoothed by one, floored."""
    all_, most, n = float(sums.sum()), float(target.sum()), len(sums)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_ + n) / ((s + 1) * (most + n)))) for s, t in zip(sums.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def gumbel(id_, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(id_name: str, gain, slices: int, seed: int):
    """A stored chunk and the buckets of its tuples -> (id, n_features, weight, score)."""

    def weigh(stored: pa.Table, lists: pa.Table) -> pa.Table:
        row = stored.to_pylist()[0]
        chunk = Chunk(row)
        tuples, of, _ = chunk.distinct()
        dealt = np.argsort(part := chunk.slices(tuples, slices), kind="stable")
        cuts = np.searchsorted(part[dealt], np.arange(slices + 1))
        each = np.zeros(len(tuples), np.int64)
        for one in lists.to_pylist():
            each[dealt[cuts[one["slice"]] : cuts[one["slice"] + 1]]] = gain.value[np.frombuffer(zstandard.decompress(one["buckets"]), "<u2")]
        singles, doubles = np.split(each[of], [len(chunk.singles)])
        total = sum(np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]]) for x, ends in zip((singles, doubles), chunk.ends))
        n = np.maximum(0, 2 * chunk.sizes - 1)
        weight = total // np.maximum(n, 1)
        score = weight + np.array([gumbel(i, seed) for i in row["ids"]], np.int64)
        return pa.table({id_name: pa.array(row["ids"], stored.schema.field("ids").type.value_type), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64()), "score": pa.array(score, pa.int64())})

    return weigh


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score) of each row of docs."""
    from pyspark.sql.pandas.types import to_arrow_type

    tune(docs.sparkSession)
    if buckets > 1 << 16:
        raise ValueError("buckets travel in 16 bits")
    kind = type_of(docs, id_col)
    rows = docs.select(F.lit(False).alias("target"), F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    rows = rows.unionAll(target.select(F.lit(True), F.lit(None).cast(kind), whole(text_col)))
    schema = f"chunk long, target boolean, ids array<{kind}>, sizes binary, places binary, words binary"
    stored = bucketed(rows.mapInArrow(_chunks(to_arrow_type(docs.schema[id_col].dataType)), schema), "ngram_chunks", "chunk")
    slices = max(SLICES, stored.count())
    sent = stored.mapInArrow(_messages(slices), "slice int, chunk long, target boolean, words binary, first binary, second binary, counts binary")
    back = materialise(sent.repartition("slice").sortWithinPartitions("slice", "chunk").mapInArrow(_hashed(buckets), _BACK), "buckets")
    sums = back.filter("sums is not null").select(F.posexplode(F.arrays_zip("sums", "target_sums")).alias("bucket", "x"))
    got = sums.groupBy("bucket").agg(F.sum("x.sums").alias("s"), F.sum("x.target_sums").alias("t")).collect()  # a row for each bucket
    counts = np.zeros((2, buckets), np.int64)
    for r in got:
        counts[:, r.bucket] = r.s, r.t
    gain = docs.sparkSession.sparkContext.broadcast(gains(*counts))
    lists = back.filter("chunk is not null").select(F.col("chunk").alias("of"), "slice", "buckets")
    out = stored.filter("not target").drop("target").groupBy("chunk").cogroup(lists.groupBy("of")).applyInArrow(_guarded(_weighed("id", gain, slices, seed), to_arrow_type(docs.schema[id_col].dataType)), f"id {kind}, n_features long, weight long, score long")
    return out


def _guarded(weigh, id_type: pa.DataType):
    """Chunks of the target have lists but no row here."""
    none = pa.table({"id": pa.array([], id_type)} | {c: pa.array([], pa.int64()) for c in ("n_features", "weight", "score")})
    return lambda stored, lists: weigh(stored, lists) if stored.num_rows else none


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    Features are the words (A-Z in lower case; digits, letters and all beyond ASCII) and pairs of neighbours, repeats counted;
    a feature's bucket is its CRC-32 modulo `buckets`.  weight is the floored mean of the features' gains (see gains(); 0
    without features), score adds a Gumbel variate of `seed` and id.  Of the documents with `least_words` words or more the
    floor of `percent` hundredths are drawn, highest score first, and bear their rank; ties go to the smaller id (null ids
    last), then to fewer features and the smaller weight.

    A null text counts as empty, in docs and in target; a null id is written as nothing in the variate; repeated rows each
    return; texts of any length are read whole; an empty table gives an empty result, an empty target weighs by
    the corpus alone; other columns are ignored, whatever their names.
    """
    scored = materialise(weights(docs, target, id_col, text_col, buckets, seed), "scored")
    may = F.col("n_features") >= 2 * least_words - 1
    drawn = scored.filter(may).count() * percent // 100
    order = F.struct(F.col("id").isNull().alias("none"), "id", "n_features", "weight")
    ranked = number_all(scored.filter(may).withColumns({"down": -F.col("score"), "order": order}), "down", "order", "place")
    ranked = ranked.select("id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
    rest = scored.filter(~may).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)
