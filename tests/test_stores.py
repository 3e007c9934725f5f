"""What is stored: the index's plans and rebuilds, the register of seals, containment by pairs, streams that start anew."""

import random

import pytest
from pyspark.sql import functions as F

from stratalex.functions.text import norm
from stratalex.operators import containment, stored, windows
from stratalex.operators.corpus import Corpus, leaves
from stratalex.plans import build, classify
from stratalex.sources import seals
from stratalex.storage import shared_dir
from stratalex.streaming import state

from test_hierarchy import SCHEDULE


def moved(df, name):
    """Exchanges below which the table of that name is scanned."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Exchange" in node.nodeName() and name in node.toString():
            found.append(node.nodeName())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


@pytest.fixture()
def plain_plans(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_index_of_a_build(spark, tmp_path, plain_plans):
    """A build stores the index; lookups do not move its postings; a rebuilt chapter is replaced, the others stay."""
    out = str(tmp_path / "tariff")
    schedule = lambda text: spark.createDataFrame([("s", text)], "source_file string, text string")
    build.build(schedule(SCHEDULE), out, date="2026-08-28")
    corpus = build.load(spark, out)
    assert isinstance(corpus, stored.StoredCorpus)
    fresh = Corpus(corpus.tariff, "2026-08-28")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    for kind in ("leaves", "postings", "weights", "terms"):
        assert same(getattr(corpus, kind), getattr(fresh, kind)), kind
    assert (corpus.leaf_count, corpus.mean_terms) == (fresh.leaf_count, fresh.mean_terms)
    asked = spark.createDataFrame([("bred animals",), ("cows meat",)], "q string").select("q", F.split("q", " ").alias("tokens"))
    each = asked.select("q", F.explode("tokens").alias("token"))
    name = corpus.postings._jdf.queryExecution().analyzed().toString()
    assert "postings" in name
    assert moved(each.join(corpus.postings, "token").groupBy("q", "hs_code").count(), "stratalex_postings") == ["Exchange"]  # what is found, not what is read
    joined = each.join(corpus.weights, "token").join(corpus.postings, "token")
    assert moved(joined, "stratalex_postings") == [] and moved(joined, "stratalex_words") == []
    changed = SCHEDULE.replace("Cows", "Heifers").replace("free    free   free", "free    free   9%").replace("MEAT", "FLESH").replace("Meat", "Flesh")
    build.build(schedule(changed), out, date="2026-08-28", chapters=["01"])
    corpus = build.load(spark, out)
    tokens = {r.token for r in corpus.postings.collect()}
    assert {"heifer", "bred"} <= tokens and "cow" not in tokens
    assert same(corpus.postings, Corpus(corpus.tariff).postings) and same(corpus.weights, Corpus(corpus.tariff).weights)
    assert corpus.tariff.filter("chapter = '02'").first().description.startswith("Meat")
    stored.write(leaves(corpus.tariff).filter("chapter <> '01'"), f"{out}/index", ["01"])
    assert build.load(spark, out).leaf_count == 0  # chapter 02 has no leaf


def test_search_over_the_stored_index(spark, tmp_path):
    out = str(tmp_path / "tariff")
    build.build(spark.createDataFrame([("s", SCHEDULE)], "source_file string, text string"), out, date="2026-08-28")
    corpus = build.load(spark, out)
    items = spark.createDataFrame([("Cows",), ("Horses, pure-bred breeding",)], "description string").select("description", *(F.lit(None).cast(t).alias(n) for n, t in (("part_number", "string"), ("quantity", "double"), ("source_file", "string"))))
    got, want = (sorted((r.description, r.hs_code, r.score) for r in classify.classify(items, c).collect()) for c in (corpus, Corpus(corpus.tariff, "2026-08-28")))
    assert got == want and [r[1] for r in got] == ["0102.10.10", "0101.21.00"]


def test_register(spark, tmp_path):
    rows = [(c, n, f"goods {n}", None, "ok", n % 2 == 0) for c in range(9) for n in range(c + 1)] + [(None, 1, None, None, None, None)]
    lines = spark.createDataFrame(rows, "customer int, place int, description string, hs_code string, flag string, amended boolean")
    register = seals.Register(spark, str(tmp_path / "seals"), ("Ann",), buckets=4)
    tokens = {r.customer: r.seal for r in register.seal(lines.filter("customer is not null"), "customer", "Ann", "s").collect()}
    assert len(set(tokens.values())) == 9 and all(len(x) == 12 for x in tokens.values())
    register.seal(lines.filter("customer < 5"), "customer", "Ann", "s")  # again: nothing more
    assert register.rows().count() == 45
    with pytest.raises(ValueError):
        register.seal(lines, "customer", "Bob", "s")
    found = register.lookup(tokens[3])
    assert sorted(r.place for r in found.collect()) == [0, 1, 2, 3] and register.lookup("nosuchtoken1").count() == 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    plan = register.lookup(tokens[3])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in plan
    asked = spark.createDataFrame([(tokens[8],), ("unknown",)], "seal string")
    assert sorted(map(tuple, register.verify(asked).collect())) == sorted([(tokens[8], True, 9), ("unknown", False, 0)])
    other = register.tokens(lines.filter("customer = 3").withColumn("flag", F.lit("critical")), "customer", "s", "Ann").first().seal
    assert other != tokens[3]


def test_containment_like_the_fold(spark):
    rng = random.Random(4)
    words = ["bolt", "steel bolt", "steel", "hex steel bolt", "nut", "Nut", "brass nut m8", "m8", "a nut", "box of nuts", "x", "12", "steel  bolt "]
    rows = [(d, p, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for d in range(8) for p in range(40)]
    df = spark.createDataFrame(rows, "d int, p int, t string").repartition(3)
    got = containment.without_contained(df, "d", "p", "t").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("x")).select("d", "x.t")
    folded = df.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("x")).select("d", windows.greedy_containment(F.col("x.t")).alias("t"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, folded.collect()))
    assert containment.without_contained(df.limit(0), "d", "p", "t").collect() == []
    assert df.select(norm(F.col("t"))).count() == 320


def test_state_over_restarts(spark, tmp_path):
    """Three lots, one file at a time, both queries started anew for each: as if all had been there at once."""
    rng = random.Random(6)
    base, want, seen = str(tmp_path), [], set()
    (tmp_path / "in").mkdir()
    for lot in range(3):
        rows = [(f"g{rng.randrange(25)}", lot * 100 + n) for n in range(40)]
        (tmp_path / "in" / f"lot{lot}.txt").write_text("\r\n".join(f"{g},{n}" for g, n in rng.sample(rows, 40)))
        for g, n in rows:
            if g not in seen:
                seen.add(g)
                want.append((g, n, len(want) + 1))
        lines = state.text_lines(spark, f"{base}/in", 1)
        cells = F.split("line", ",")
        goods = lines.select(F.lit("all").alias("k"), cells[0].alias("g"), cells[1].cast("long").alias("n"))
        state.append(state.first_wins(goods, ["g"], ["n"]), f"{base}/first", f"{base}/s1")
        state.append(state.number_on(spark.readStream.schema(goods.schema).parquet(f"{base}/first"), ["k"], ["n"]), f"{base}/out", f"{base}/s2")
    got = spark.read.parquet(f"{base}/out")
    assert sorted((r.g, r.n, r.line_number) for r in got.collect()) == sorted(want)
    assert shared_dir(spark)
