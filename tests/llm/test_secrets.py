import hashlib
import re

from stratalex.llm import secrets

from .helpers import frame

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Z9" * 10
OPAQUE = "Ab3" * 10
TEXTS = [
    f"é password = 'hunter22' and TOKEN:abcdef {HEX} end",
    "password: token: abcdefgh secret=abc api_key = x.y-z_9/+",
    f"{KEY} akia AKIAshort {HEX[:23]} {HEX[:24]}",
    None,
    "",
    f"passwd={HEX}",
    f"copied {OPAQUE} here",
    f"copied {OPAQUE} there",
    f"copied {OPAQUE} again",
    "mine Qw7" + "xY8" * 9,
    "ghp_" + "a1B2" * 9,
    "word " * 3000 + f"Secret='{OPAQUE}'",
    f"password = '{HEX}' " * 40,
]


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_base_and_added(spark):
    got = {r.doc_id: r for r in secrets.scan(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = base(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
    # One string in the hands of four owners is an example; strings of one owner are not.
    assert got[6].spans == got[7].spans == ""
    assert got[9].spans == "opaque:5:35" and got[10].spans.startswith("issued:0:40")
    assert got[11].n_example == 1 and got[0].n_live + got[0].n_example == 3


def test_repeats_and_empty(spark):
    twice = frame(spark, ["token=abcdefgh", "token=abcdefgh"], ids=[5, 5])
    assert [(r.doc_id, r.n_assign) for r in secrets.scan(twice).collect()] == [(5, 1), (5, 1)]
    assert secrets.scan(frame(spark, ["x"]).limit(0)).count() == 0
    assert secrets.scan(frame(spark, ["token=abcdefgh", "a"], ids=[None, None])).count() == 2


def test_one_text_with_very_many_matches(spark):
    """100,000 matches take seconds: the work does not grow with their square."""
    import time

    many = [f"token=a{i:06d}" for i in range(50_000)] + [f"{i:024x}" for i in range(50_000)]
    began = time.time()
    (r,) = secrets.scan(frame(spark, [" ".join(many)])).collect()
    assert (r.n_assign, r.n_hex, r.n_live) == (50_000, 50_000, 100_000) and time.time() - began < 60
    want = base(" ".join(many))
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans == ",".join(want)


def test_repositories_take_part(spark):
    """Two owners are enough where many repositories hold a value; one owner's copies never are.  A value counts once."""
    rows = [(i, f"x {OPAQUE} y", f"o{i % 2}", f"l{i // 2}") for i in range(4)] + [(9, f"{OPAQUE[::-1]} {OPAQUE[::-1]}", "o1", "l1")]
    rows += [(20 + i, f"see {'Zz9' * 9}", "o1", f"l{i}") for i in range(6)] + [(30, "ghp_" + "a1B2" * 9 + " and ghp_" + "a1B2" * 9, "o5", "l")]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert all(got[i].spans == "" for i in range(4))
    assert all(got[20 + i].n_live == 1 for i in range(6)) and got[9].n_live == 1 and got[9].spans.count("opaque") == 2
    assert got[30].n_live == 1 and got[30].spans == "issued:0:40,issued:45:85"


def test_extra_columns_with_names_in_use(spark):
    names = ["id", "row", "owner", "repo", "spans", "hash", "example", "_text", "_m_hex", "start"]
    from pyspark.sql import functions as F

    df = frame(spark, TEXTS).select("*", *(F.lit("q").alias(n) for n in names))
    plain = sorted(map(tuple, secrets.scan(frame(spark, TEXTS)).collect()))
    assert sorted(map(tuple, secrets.scan(df).collect())) == plain
