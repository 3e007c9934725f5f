"""The manifest against a plain tree, and the traversal's paths and memory."""

import zlib
from hashlib import sha256

import pytest

from stratalex.llm import merkle

from .helpers import SCHEMA, frame, prose, rows

H = lambda *x: sha256("".join(x).encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, at):
    return [(at >> k & 1, level[at >> k ^ 1] if at >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def leaf(r):
    return H(*("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS))


def plain(table):
    """(id, leaf) -> the rest of the row."""
    by = {}
    for r in table:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"], leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))]) for k, v in by.items()}
    over = tree([trees[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for at, (_, id_, digest, r) in enumerate(sorted(by[k], key=lambda x: (x[0], x[1] or 0, x[2]))):
            path = way(trees[k], at) + way(over, n)
            tampered = id_ is not None and zlib.crc32(str(id_).encode()) % 7 == 0
            folded = leaf(r | {"n_chars": r["n_chars"] and r["n_chars"] + 1}) if tampered else digest
            for left, s in path:
                folded = H(folded) if s is None else H(s, folded) if left else H(folded, s)
            out.append((id_, digest, trees[k][-1][0], over[-1][0], H(*(s for _, s in path if s)), folded, folded == over[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 63, 64, 65, 200, 511, 512])
@pytest.mark.parametrize("raised", [0, 2])
def test_traversal(n, raised):
    leaves = [H(str(i)).encode() for i in range(n)]
    height = merkle.levels(n) + raised
    levels = tree([x.decode() for x in leaves])
    while len(levels) <= height:
        levels.append([H(levels[-1][0])])
    walk = merkle.Traversal(leaves, height)
    assert walk.root.decode() == levels[-1][0]
    held = 0
    for at, path in enumerate(walk.paths()):
        assert [(left, s and s.decode()) for left, s in path] == [(bool(a), b) for a, b in way(levels, at)]
        held = max(held, sum(map(len, walk.existing)) + sum(len(d.kept) + len(d.stack) for d in walk.desired))
    assert held <= 2 * (len(walk.bounds) + 1) * (2 << merkle.SUBTREE) + height * height


@pytest.mark.parametrize("height", [2, 9])
def test_awkward_rows(spark, height):
    texts = [None, "", "a", "A", "ünï 漢", "x" * 300_000, *prose(3, 90), *["same"] * 20]
    ids = [i % 110 if i % 13 else None for i in range(len(texts))]
    table = rows(texts, ids=ids)
    table = [(*r[:2], [None, "", "en", "é", "zz", "en", "en"][i % 7], r[3], None if i % 5 == 0 else i, *r[5:]) for i, r in enumerate(table)]
    table += table[-3:]  # rows that repeat in full
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert got(merkle.manifest(df, height=height)) == plain([dict(zip(names, r)) for r in table])


def test_empty_and_single(spark):
    assert merkle.manifest(frame(spark, [])).collect() == []
    one = frame(spark, ["alone"])
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H()


def test_query_equals_plain(spark):
    from stratalex.llm import queries

    table = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(queries.op13_merkle(spark, "/root/testdata/sf0.001")) == plain(table)
