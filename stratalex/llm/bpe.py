"""Byte-level BPE over a distinct-word table.

1. Documents are split into words, chunk by chunk (CHUNK_CHARS of text).  A chunk keeps its distinct words, dealt into
   BUCKETS lists by a hash of the word, and for each document the places of its words among them.  Chunks are written to the
   shared folder once, bucketed by their number, so that places do not move again.
2. The lists of a bucket meet, over the chunks of a part (those of PART_TASKS input tasks): that is the table of distinct words, in
   which each word is encoded once.  Lists grow with the chunks alone, and a part bounds what one task meets.
3. The ids of each list go back to its chunk and, by position, to the documents.  Decoding goes from ids to bytes through
   a hash join with the id-to-piece table, whose size is the vocabulary's.

Lists and places move packed (zstandard).  A frequent word costs one entry a chunk, not one an occurrence, so no bucket
is larger than others.  word_table() gives the table of distinct words as rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import bucketed, tune, type_of

#: Code points after which a chunk is closed (a longer document is a chunk of its own).
CHUNK_CHARS = 16_000_000
#: Lists that the words of a chunk are dealt into, and input tasks whose chunks' lists meet: a task of step 2 meets the
#: same number of words however large the corpus, at the price of encoding a word once in each part.
BUCKETS, PART_TASKS = 128, 256
#: Words that a task of step 2 keeps encoded at a time.
KNOWN_WORDS = 2_000_000
#: How byte-level BPE splits text before merging: the published pattern, for the characters that UNSETTLED leaves.  Words
#: and digits come first, which changes nothing since no other part begins as they do.
_NUMERALS = "\u00b2\u00b3\u00b9\u00bc-\u00be\u2776-\u2793"
WORDS = re.compile(rf" ?[^\W\d_{_NUMERALS}]+| ?[\d{_NUMERALS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Beyond these blocks, whose letters, digits and spaces have long been settled, the library and Python may know different
#: versions of Unicode; such texts are split by the library itself.
UNSETTLED = re.compile("[^\u0000-\u001b\u0020-\u0370\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u1E00-\u1EFF\u2010-\u2064\u20A0-\u20BF\u2190-\u23FF\u2500-\u27BF\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\U0001F300-\U0001F64F]")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers file (byte-level BPE, no truncation or padding in use), as text so that it can travel to executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        data = json.loads(self.source)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data.get("normalizer"):
            raise ValueError(f"{path}: a byte-level BPE without normaliser is needed")
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.vocab = data["model"]["vocab"] | self.added

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of each entry."""
        to_byte = byte_alphabet()
        return [(n, bytes(to_byte[c] for c in piece)) for piece, n in self.vocab.items()]


class Splitter:
    """Splits texts into words; the strings of added tokens are words of their own."""

    def __init__(self, source: str, added: list[str]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source).pre_tokenizer
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def words(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        out = []
        for k, part in enumerate(self.added.split(text)):
            out += [part] if k % 2 else self.plain(part)
        return out


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as planes of their low and high bytes, compressed."""
    x = np.ascontiguousarray(x, np.uint32)
    planes = x.view(np.uint8).reshape(-1, 4).T
    used = 4 if len(x) and x.max() >= 1 << 16 else 2
    return zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())


def _unpack_numbers(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(-1, n) if n else np.empty((0, 0), np.uint8)
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


class Chunk:
    """Texts as places among their distinct words; words are not kept beyond their text."""

    def __init__(self):
        self.ids: list = []
        self.at: list[np.ndarray] = []
        self.known: dict[str, int] = {}
        self.chars = 0

    def add(self, key, words: list[str], chars: int) -> None:
        known = self.known
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = len(known)
        self.ids.append(key)
        self.at.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        self.chars += chars


def _each_chunk(batches: Iterator[pa.RecordBatch], split_words) -> Iterator[Chunk]:
    now = Chunk()
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            now.add(key, split_words(text), len(text))
            if now.chars >= CHUNK_CHARS:
                yield now
                now = Chunk()
    if now.ids:
        yield now


def _bucket(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.uint8, len(words))


def _pack_words(data: list[bytes]) -> bytes:
    """Lengths stand in front, since words may hold any character."""
    packed = _pack_numbers(np.array([len(d) for d in data], np.uint32))
    return len(packed).to_bytes(4, "little") + packed + zstandard.ZstdCompressor(level=3).compress(b"".join(data))


def chunks(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """A row for each chunk: ids; sizes, the words of each text; places, of all words in turn, among the chunk's n
    distinct ones, the most frequent first; buckets, of each distinct word; lists, the distinct words of each bucket."""
    id_type, added = docs.schema[id_col].dataType, list(vocabulary.added)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary.source)  # one file's text
    of_list = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("n", pa.int32())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_words = Splitter(source.value, added).words
        first = next(batches, None)
        if first is None:
            return
        for chunk in _each_chunk(chain([first], batches), split_words):
            known, at = chunk.known, chunk.at
            flat = np.concatenate(at)
            order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[order] = np.arange(len(known), dtype=np.uint32)
            data = [w.encode() for w in known]
            data = [data[i] for i in order.tolist()]
            of = _bucket(data)
            by_bucket = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=BUCKETS)).tolist()
            lists = [{"bucket": k, "words": _pack_words([data[i] for i in by_bucket[a:b].tolist()]), "n": b - a} for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
            sizes = _pack_numbers(np.array([len(a) for a in at], np.uint32))
            columns = [pa.array([chunk.ids], pa.list_(first.column(0).type)), pa.array([sizes], pa.binary()), pa.array([_pack_numbers(rank[flat])], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(of.tobytes())], pa.binary()), pa.array([len(known)], pa.int32()), pa.array([lists], of_list)]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "places", "buckets", "n", "lists"])

    made = docs.select(id_col, text_col).mapInArrow(make, f"ids array<{id_type.simpleString()}>, sizes binary, places binary, buckets binary, n int, lists array<struct<bucket:int,words:binary,n:int>>")
    return made.withColumn("chunk", F.monotonically_increasing_id())


def _words_of(packed: bytes, n: int) -> list[str]:
    at = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(_unpack_numbers(packed[4:at], n)).tolist()
    data = zstandard.ZstdDecompressor().decompress(packed[at:])
    return [data[a:b].decode() for a, b in zip([0, *ends], ends)]


def encode_lists(lists: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """lists(chunk, part, bucket, words, n) -> (chunk, bucket, n_ids, ids): of each word in its order the number of ids,
    and the ids one after the other.  The lists of a part's bucket meet, so each distinct word is encoded once in it."""
    source = lists.sparkSession.sparkContext.broadcast(vocabulary.source)  # one file's text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(source.value)
        model.no_truncation()
        model.no_padding()
        known: dict[str, list[int]] = {}
        for b in batches:
            counts, ids = [], []
            for packed, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = _words_of(packed, n)
                new = [w for w in words if w not in known]
                known.update(zip(new, (e.ids for e in model.encode_batch_fast(new, add_special_tokens=False))))
                got = [known[w] for w in words]
                counts.append(_pack_numbers(np.array([len(x) for x in got], np.uint32)))
                ids.append(_pack_numbers(np.array([i for x in got for i in x], np.uint32)))
                if len(known) > KNOWN_WORDS:
                    known = {}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "bucket", "n_ids", "ids"])

    # Sorted, so that a task is done with one bucket's words before the next.
    met = lists.select("chunk", "bucket", "words", "n", "part").repartition("part", "bucket").sortWithinPartitions("part", "bucket").drop("part")
    return met.mapInArrow(encode, "chunk long, bucket int, n_ids binary, ids binary")


def _join_back(id_name: str, with_texts: bool, pieces):
    """Ids of the words' lists -> the documents of a chunk, by position."""

    def join(docs: pa.Table, lists: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        n = row["n"]
        of = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["buckets"]), np.uint8)
        piece = pieces.value  # the join with the id-to-piece table
        words: list = [None] * (n if with_texts else 0)
        raw, texts, counts = [b""] * n, [""] * n, np.zeros(n, np.int64)
        # The words of each bucket, in their order.
        by_bucket = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by_bucket], np.arange(int(of.max(initial=0)) + 2))
        for one in lists.to_pylist():
            mine = by_bucket[starts[one["bucket"]] : starts[one["bucket"] + 1]]
            ends = np.cumsum(_unpack_numbers(one["n_ids"], len(mine))).tolist()
            ids = _unpack_numbers(one["ids"], ends[-1]).tolist()
            counts[mine] = np.diff([0, *ends])
            for at, a, b in zip(mine.tolist(), [0, *ends], ends):
                x = ids[a:b]
                raw[at], texts[at] = b"".join([piece[i] for i in x]), ",".join(map(str, x))
                if with_texts:
                    words[at] = x
        sizes = _unpack_numbers(row["sizes"], len(row["ids"])).tolist()
        flat = _unpack_numbers(row["places"], sum(sizes))
        out = {id_name: row["ids"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_texts else {})
        start = 0
        for size in sizes:
            at = flat[start : start + size]
            start += size
            places = at.tolist()
            pick = itemgetter(*places) if len(places) > 1 else lambda xs, p=places: [xs[i] for i in p]
            decoded = b"".join(pick(raw)).decode("utf-8", "replace")
            out["n_tokens"].append(int(counts[at].sum()))
            out["ids_sha256"].append(hashlib.sha256(",".join(pick(texts)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_texts:
                out["ids"].append([i for x in pick(words) for i in x])
                out["decoded"].append(decoded)
        types = {id_name: docs.schema.field("ids").type.value_type, "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, types.get(k, pa.string())) for k, v in out.items()})

    return join


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if with_texts.

    ids are those of the tokenizers library without special tokens added; the strings of added tokens in a text become
    their ids, as there.  A null or empty text has no ids and decodes to the empty text.  Repeated rows and null ids are
    kept as they are, an empty table gives an empty result, other columns are ignored.

    A very long text is a chunk of its own.  docs is read once.
    """
    vocabulary = Vocabulary(path)
    stored = _stored(docs, id_col, text_col, vocabulary)
    table = dict(vocabulary.pieces())
    pieces = docs.sparkSession.sparkContext.broadcast([table.get(i, b"") for i in range(max(table) + 1)])  # a vocabulary's fixed size
    encoded = encode_lists(_lists(stored), vocabulary).withColumnRenamed("chunk", "of")
    schema = f"`{id_col}` {type_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_texts else "")
    return stored.drop("lists").groupBy("chunk").cogroup(encoded.groupBy("of")).applyInArrow(_join_back(id_col, with_texts, pieces), schema)


def _stored(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    tune(docs.sparkSession)
    return bucketed(chunks(docs, id_col, text_col, vocabulary), "chunks", "chunk")


def _lists(stored: DataFrame) -> DataFrame:
    part = F.floor(F.shiftrightunsigned("chunk", 33) / PART_TASKS)  # the high bits of a chunk's number are its task
    return stored.select("chunk", part.alias("part"), F.explode("lists").alias("x")).select("chunk", "part", "x.*")


def word_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, ids): a row for each distinct word of the texts, as the vocabulary's splitter finds them."""
    vocabulary = Vocabulary(path)
    lists = _lists(_stored(docs.select(F.lit(0).alias("id"), text_col), "id", text_col, vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n_ids, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                each = _words_of(words["words"], words["n"])
                ends = np.cumsum(_unpack_numbers(n_ids, len(each))).tolist()
                flat = _unpack_numbers(ids, ends[-1]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array([flat[x:y] for x, y in zip([0, *ends], ends)], pa.list_(pa.int32()))], names=["word", "ids"])

    encoded = encode_lists(lists, vocabulary).join(lists.select("chunk", "bucket", F.struct("words", "n").alias("words")), ["chunk", "bucket"])
    return encoded.select("words", "n_ids", "ids").mapInArrow(rows, "word string, ids array<int>").dropDuplicates(["word"])
