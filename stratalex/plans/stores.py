"""Driver queries over what is stored and read again: the search index, seals, streams with state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import text as t
from stratalex.operators import rank, stored, windows
from stratalex.operators.corpus import leaves
from stratalex.plans.generated import _WARES, _corpus, _duck, _wares
from stratalex.plans.queries import sql_tokens
from stratalex.sources import documents, seals
from stratalex.storage import materialise, shared_dir
from stratalex.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A stored index of which one chapter is rebuilt -------------------------------------------------------------------------
_FIRST = "(SELECT min(left(heading, 2)) FROM w)"
_NOW_SQL = f"""WITH w AS ({_duck(_WARES)}), now AS (SELECT code, p_name, CASE WHEN left(heading, 2) = {_FIRST} THEN replace(own, 'zq', 'zy') ELSE own END AS own, heading_text FROM w WHERE NOT (left(heading, 2) = {_FIRST} AND p_partkey % 10 = 3)),
line AS (SELECT code, heading_text || ' ' || p_name || ' ' || own AS x FROM now),
ask AS (SELECT own AS q FROM w UNION SELECT replace(own, 'zq', 'zy') FROM w WHERE left(heading, 2) = {_FIRST} UNION SELECT p_name FROM w)"""


@query(f"""{_NOW_SQL}, {sql_tokens('line', 'code', 'x', 'lk')}, {sql_tokens('ask', 'q', 'q', 'qk', True)},
lt AS (SELECT DISTINCT code, token FROM lk), qt AS (SELECT DISTINCT q, token FROM qk), n AS (SELECT q, count(*) AS n FROM qt GROUP BY q),
idf AS (SELECT token, ln(((SELECT greatest(count(*), 1) FROM now) + 1) / (count(*) + 1)) + 1.0 AS idf FROM lt GROUP BY token),
s AS (SELECT q, code, round(sum(idf) * (0.65 + 0.35 * count(*) / max(n)), 6) AS score FROM qt JOIN idf USING (token) JOIN lt USING (token) JOIN n USING (q) GROUP BY q, code)
SELECT q, code AS hs_code, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS INT) AS place FROM s QUALIFY place <= 3""")
def stored_index(spark, sf_dir):
    """An index written by a build, of which one chapter is then replaced (new words, lines gone): the best lines for the old
    and the new words and for all names are those of an index built afresh."""
    wares = _wares(spark, sf_dir)
    path = f"{shared_dir(spark)}/stratalex/index-{uuid.uuid4().hex}"
    stored.write(leaves(_corpus(wares).tariff), path)
    first = wares.agg(F.min(F.left("heading", F.lit(2)))).first()[0]
    mine = F.left("heading", F.lit(2)) == first
    anew = F.replace("own", F.lit("zq"), F.lit("zy"))
    changed = _corpus(wares.filter(mine & (F.col("p_partkey") % 10 != 3)).withColumn("own", anew))
    stored.write(leaves(changed.tariff), path, chapters=[first])
    corpus = stored.StoredCorpus(changed.tariff, "2026-08-28", path)
    ask = wares.select(F.col("own").alias("q")).union(wares.filter(mine).select(anew)).union(wares.select("p_name")).distinct()
    ask = materialise(ask.select("q", t.token_set(F.col("q"), True).alias("tokens")), "asked")
    each = ask.select("q", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    found = each.join(corpus.weights, "token").join(corpus.postings, "token")
    score = F.round(rank.overlap_score(F.sum("idf"), F.count(F.lit(1)), F.col("n")), 6)
    return rank.top_k(found.groupBy("q", "hs_code", "n").agg(score.alias("score")), "q", "hs_code", 3).select("q", "hs_code", "score", "place")


# Seals: a report for each customer, a line for each order ----------------------------------------------------------------
_SAID = "concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), o_orderpriority, chr(0), o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END)"
_DIGITS = [f"CAST(sum(CAST('0x' || substr(sha256({_SAID}), {1 + 12 * k}, 12) AS BIGINT)) AS HUGEINT)" for k in range(4)]


@query(f"""WITH d AS (SELECT o_custkey, {', '.join(f'{x} AS d{k}' for k, x in enumerate(_DIGITS))}, count(*) AS n FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, replace(replace(to_base64(unhex(left(sha256(concat_ws(chr(31), 'a secret', 'Ann', CAST(o_custkey AS VARCHAR), CAST(d0 AS VARCHAR), CAST(d1 AS VARCHAR), CAST(d2 AS VARCHAR), CAST(d3 AS VARCHAR), CAST(n AS VARCHAR))), 18))), '+', '-'), '/', '_') AS seal FROM d)
SELECT seal, CAST(o_custkey AS VARCHAR) AS source, o_orderkey AS place, o_orderpriority AS description, o_orderstatus AS flag, o_orderkey % 2 = 0 AS amended FROM orders JOIN s USING (o_custkey)""")
def sealed_orders(spark, sf_dir):
    """The orders of each customer, sealed twice over in two halves and as a whole: the register holds each line once."""
    lines = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("description"), F.lit(None).cast("string").alias("hs_code"), F.col("o_orderstatus").alias("flag"), (F.col("o_orderkey") % 2 == 0).alias("amended"))
    register = seals.Register(spark, f"{shared_dir(spark)}/stratalex/seals-{uuid.uuid4().hex}", ("Ann",))
    for some in (lines.filter("o_custkey % 2 = 0"), lines):
        register.seal(some, "o_custkey", "Ann", "a secret")
    return register.rows().select("seal", "source", "place", "description", "flag", "amended")


# Streams whose state outlives a batch -------------------------------------------------------------------------------------
_GOODS = "o_orderpriority || ' of ' || CAST(o_custkey % 50 AS {s})"


@query(f"""WITH r AS (SELECT o_custkey % 4 AS folder, o_orderkey, o_orderkey % 2 AS batch, {_duck(_GOODS)} AS goods FROM orders),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY folder, goods ORDER BY batch, o_orderkey) = 1)
SELECT CAST(folder AS VARCHAR) AS folder, goods, o_orderkey, row_number() OVER (PARTITION BY folder ORDER BY batch, o_orderkey) AS line_number FROM f""")
def stream_state(spark, sf_dir):
    """Files that come in two lots, the streams started anew for the second: the first of equal goods of a folder, over all
    files, numbered on from lot to lot."""
    base = f"{shared_dir(spark)}/stratalex/lots-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), F.expr(_GOODS.format(s="STRING")))
    for lot in (0, 1):
        rows = orders.filter(F.col("o_orderkey") % 2 == lot).select(line.alias("value"), (F.col("o_custkey") % 4).alias("folder"))
        rows.write.mode("append").partitionBy("folder").text(f"{base}/in")
        lines = state.text_lines(spark, f"{base}/in")
        cells = F.split("line", "\t")
        goods = lines.select(F.regexp_extract("path", "folder=([^/]+)", 1).alias("folder"), cells[1].alias("goods"), cells[0].cast("long").alias("o_orderkey"))
        state.append(state.first_wins(goods, ["folder", "goods"], ["o_orderkey"]), f"{base}/first", f"{base}/first-state")
        firsts = spark.readStream.schema(goods.schema).parquet(f"{base}/first")
        state.append(state.number_on(firsts, ["folder"], ["o_orderkey"]), f"{base}/numbered", f"{base}/numbered-state")
    return spark.read.schema("folder string, goods string, o_orderkey long, line_number long").parquet(f"{base}/numbered")


# Files in folders ---------------------------------------------------------------------------------------------------------
_FILE = "r_name || '/' || n_name || CASE n_nationkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.tiff' ELSE '' END"


@query(f"SELECT {_FILE} AS file, CAST(length(n_name) AS BIGINT) AS length, row_number() OVER (ORDER BY {_FILE}) AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 IN (0, 1, 3)")
def input_files(spark, sf_dir):
    """Files in a folder for each region: those of a known type, in any case, in the order of their paths."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    base = f"{shared_dir(spark)}/stratalex/inputs-{uuid.uuid4().hex}"
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.expr(_FILE).alias("file"), "n_name")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in rows.collect():  # a file for each nation
        place = jvm.org.apache.hadoop.fs.Path(f"{base}/{r.file}")
        out = place.getFileSystem(conf).create(place)
        out.write(r.n_name.encode())
        out.close()
    found = documents.sorted_inputs(spark, base).select(F.regexp_extract("path", "inputs-[0-9a-f]+/(.*)$", 1).alias("file"), "length")
    return windows.number_all(found, "file", "length", "place").select("file", "length", "place")
