"""Driver queries: each operator over the driver's tables, and the same in DuckDB SQL.

A query and its SQL stand together.  SQL text is built from small fragments (tokenizer, stemmer, formats) so that both
sides state the same semantics in their own dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions import rules
from stratalex.functions import text as t
from stratalex.operators import hierarchy, index, lines, pruned, rank, verify, windows
from stratalex.operators.corpus import heading_text
from stratalex.plans import generated
from stratalex.plans.generated import fuzzy_sql
from stratalex.sources import sinks
from stratalex.storage import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments -------------------------------------------------------------------------------------------------------
def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_stem(x: str) -> str:
    return f"""CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y'
      WHEN length({x}) > 4 AND regexp_matches({x}, '([sxz]es|ches|shes|oes)$') THEN left({x}, length({x}) - 2)
      WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"""


def sql_tokens(table: str, key: str, text: str, name: str, pack: bool = False) -> str:
    """CTEs that end in name(key, pos, token)."""
    gone = t.STOPWORDS + (t.PACK_WORDS if pack else [])
    return f"""
{name}_w AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS ws FROM {table}),
{name}_p AS (SELECT {key}, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM {name}_w),
{name}_l AS (SELECT *, lag(w, 1) OVER x AS w1, lag(w, 2) OVER x AS w2, lag(w, 3) OVER x AS w3 FROM {name}_p WINDOW x AS (PARTITION BY {key} ORDER BY pos)),
{name}_k AS (SELECT {key}, pos, {sql_stem('w')} AS token FROM {name}_l
  WHERE w NOT IN ({_list(t.NEGATORS)}) AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 3
    AND NOT (coalesce(w1 IN ({_list(t.NEGATORS)}), false) AND NOT coalesce(w1 = 'not' AND w2 = 'or' AND w3 = 'whether', false))),
{name} AS (SELECT * FROM {name}_k WHERE token NOT IN ({_list(gone)}) AND length(token) >= 3)"""


def sql_format_code(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    full = f"CASE WHEN length({d}) = 6 THEN {d} || '00' WHEN length({d}) = 8 THEN {d} END"
    return f"(substr({full}, 1, 4) || '.' || substr({full}, 5, 2) || '.' || substr({full}, 7, 2))"


# Text ----------------------------------------------------------------------------------------------------------------
@query(f"WITH {sql_tokens('documents', 'doc_id', 'text', 'k')} SELECT doc_id, token, count(*) AS n FROM k GROUP BY doc_id, token")
def tokenize_negation(spark, sf_dir):
    """Words of each document after negation, stemming and stopwords, with their counts."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokenize(F.col("text"))).alias("token"))
    return d.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT w, {sql_stem('w')} AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY w")
def stem_terms(spark, sf_dir):
    """Every word of the corpus with its stem."""
    w = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(t.WORD), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w", t.stem(F.col("w")).alias("stem"), "n")


def _sql_mass(text: str) -> str:
    m = r"'(?i)(\d+(?:[.,]\d+)?)\s*(kg|kgs|kilograms?|g|gr|grams?|mg|milligrams?)\b'"
    v, u = f"TRY_CAST(replace(regexp_extract({text}, {m}, 1), ',', '.') AS DOUBLE)", f"lower(regexp_extract({text}, {m}, 2))"
    return f"CASE WHEN {u} LIKE 'mg%' OR {u} LIKE 'milligram%' THEN {v} / 1000000 WHEN {u} LIKE 'k%' THEN {v} WHEN {u} <> '' THEN {v} / 1000.0 END"


_PACK = "p_name || ' - ' || CASE p_partkey % 4 WHEN 0 THEN p_size || 'g' WHEN 1 THEN p_size || ',5 kg' WHEN 2 THEN p_size || ' mg' ELSE 'TIN' END"


@query(f"SELECT p_partkey, round({_sql_mass('d')}, 9) AS mass_kg FROM (SELECT p_partkey, {_PACK} AS d FROM part)")
def mass_parse(spark, sf_dir):
    """The pack mass in a description."""
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(_PACK).alias("d"))
    return d.select("p_partkey", F.round(t.mass_kg(F.col("d")), 9).alias("mass_kg"))


@query(f"SELECT p_partkey, {sql_format_code('d')} AS code FROM (SELECT p_partkey, substr(CAST(p_partkey * 7919 + 100000 AS VARCHAR), 1, 5 + CAST(p_partkey % 4 AS INT)) || CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '' END AS d FROM part)")
def code_format(spark, sf_dir):
    """Digits of varying length as tariff codes."""
    d = F.expr("substr(CAST(p_partkey * 7919 + 100000 AS STRING), 1, 5 + CAST(p_partkey % 4 AS INT)) || CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '' END")
    return read(spark, sf_dir, "part").select("p_partkey", t.format_code(d).alias("code"))


@query("SELECT p_partkey, substr(h, 1, 2) || '.' || substr(h, 3, 2) AS heading FROM (SELECT p_partkey, CASE WHEN length(d) >= 4 THEN left(d, 4) ELSE lpad(d, 4, '0') END AS h FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS d FROM part))")
def heading_format(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.format_heading(F.col("p_partkey").cast("string")).alias("heading"))


_QTY = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN CAST(o_custkey AS {s}) WHEN 1 THEN CAST(o_custkey AS {s}) || ',5' WHEN 2 THEN '1,' || lpad(CAST(o_custkey % 1000 AS {s}), 3, '0') || '.25' WHEN 3 THEN CAST(o_custkey AS {s}) || ' pcs' ELSE ' 1 000 ' END"


@query(f"""SELECT o_orderkey, CASE WHEN regexp_full_match(p, '\\d+(\\.\\d+)?') THEN CAST(p AS DOUBLE) END AS quantity FROM (
  SELECT o_orderkey, CASE WHEN regexp_full_match(q, '\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') THEN replace(q, ',', '') WHEN contains(q, ',') AND NOT contains(q, '.') THEN replace(q, ',', '.') ELSE q END AS p
  FROM (SELECT o_orderkey, replace(trim({_QTY.format(s='VARCHAR')}), ' ', '') AS q FROM orders))""")
def number_normalize(spark, sf_dir):
    """Quantities in several notations."""
    return read(spark, sf_dir, "orders").select("o_orderkey", t.number(F.expr(_QTY.format(s="STRING"))).alias("quantity"))


_NOTE = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '\"' WHEN 1 THEN 'x ' || lpad(CAST(p_partkey % 10000 AS {s}), 4, '0') || '.' || lpad(CAST(p_size AS {s}), 2, '0') WHEN 2 THEN lpad(CAST(p_partkey % 10000 AS {s}), 4, '0') || '-' || lpad(CAST(p_size AS {s}), 2, '0') || '.10 y' WHEN 3 THEN 'ditto' ELSE 'none' END"


@query(f"""SELECT p_partkey, coalesce(CASE WHEN m <> '' AND CAST(left(m, 2) AS INT) BETWEEN 1 AND 97 AND NOT (length(m) = 7 AND substr(m, 6, 2) = '00')
    THEN left(m, 4) || '.' || substr(m, 6, 2) || '.' || CASE WHEN length(m) > 7 THEN substr(m, 9, 2) ELSE '00' END END,
    CASE WHEN regexp_matches(' ' || n || ' ', '(?i)(^|\\s)("|ditto)(\\s|$)') THEN '"' END) AS noted
  FROM (SELECT p_partkey, n, regexp_extract(n, '(^|[^A-Za-z0-9])(\\d{{4}}[.\\-]\\d{{2}}([.\\-]\\d{{2}})?)($|[^0-9])', 2) AS m FROM (SELECT p_partkey, {_NOTE.format(s='VARCHAR')} AS n FROM part))""")
def written_code(spark, sf_dir):
    """A written tariff code or a ditto mark in a note."""
    return read(spark, sf_dir, "part").select("p_partkey", t.noted_code(F.expr(_NOTE.format(s="STRING"))).alias("noted"))


# Search --------------------------------------------------------------------------------------------------------------
def _query_tokens(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), t.token_set(F.col("text")).alias("tokens"))


def _texts(spark, sf_dir) -> DataFrame:
    """Texts dealt over tasks before they are tokenized: a file is as many tasks as it has row groups, which may be one."""
    return generated._dealt(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _posted(spark, sf_dir) -> DataFrame:
    return index.postings(_texts(spark, sf_dir), "doc_id", t.tokenize(F.col("text")))


_INDEX_SQL = f"""WITH {sql_tokens('documents', 'doc_id', 'text', 'dk')}, {sql_tokens('benchmark', 'item_id', 'text', 'qk')},
post AS (SELECT DISTINCT doc_id, token FROM dk), q AS (SELECT DISTINCT item_id, token FROM qk),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
idf AS (SELECT token, df, ln(((SELECT greatest(count(*), 1) FROM documents) + 1) / (df + 1)) + 1.0 AS idf FROM df)"""


@query(f"{_INDEX_SQL} SELECT token, df FROM df")
def doc_frequency(spark, sf_dir):
    return index.doc_frequency(_posted(spark, sf_dir))


@query(f"{_INDEX_SQL} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_weights(spark, sf_dir):
    total = read(spark, sf_dir, "documents").count()
    return index.with_idf(index.doc_frequency(_posted(spark, sf_dir)), total).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"""{_INDEX_SQL}, n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
s AS (SELECT q.item_id, doc_id, round(sum(idf) * (0.65 + 0.35 * count(*) / max(n.n)), 6) AS score FROM q JOIN idf USING (token) JOIN post USING (token) JOIN n USING (item_id) GROUP BY q.item_id, doc_id)
SELECT item_id, doc_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 8""")
def search_topk(spark, sf_dir):
    """The eight documents that share most of each query, by IDF and coverage.  The flagship."""
    docs = read(spark, sf_dir, "documents")
    asked = _query_tokens(spark, sf_dir)
    each = materialise(asked.select("q", F.size("tokens").alias("n"), F.explode("tokens").alias("term")), "asked")
    # Only documents' words that some query has are worth a shuffle; the queries' words are few.
    # Tokenizing is what costs: the postings that count are written once and read again.
    posted = _posted(spark, sf_dir).withColumnRenamed("token", "term")
    posted = materialise(posted.join(each.select("term").distinct(), "term", "left_semi"), "postings")
    frequency = index.with_idf(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs.count())
    gains = posted.join(frequency.select("term", F.col("idf").alias("gain")), "term")
    blocks = materialise(pruned.in_blocks(gains, "doc_id"), "blocks")
    best = pruned.pruned_top_k(each, blocks, 8, "q", "doc_id", cover=(rank.COVER, rank.FULL))
    return best.withColumnRenamed("q", "item_id")


@query(f"""WITH {sql_tokens('documents', 'doc_id', 'text', 'dk')}, {sql_tokens('benchmark', 'item_id', 'text', 'qk')},
tf AS (SELECT doc_id, token, count(*) AS tf FROM dk GROUP BY doc_id, token), len AS (SELECT doc_id, count(*) AS len FROM dk GROUP BY doc_id),
q AS (SELECT item_id, token FROM (SELECT DISTINCT item_id, token FROM qk) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY token) <= 12),
n AS (SELECT token, count(*) AS n FROM tf GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(greatest(ln(((SELECT count(*) FROM documents) - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM len)))), 6) AS bm25
  FROM q JOIN n USING (token) JOIN tf USING (token) JOIN len USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, bm25 FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) <= 25""")
def bm25_topk(spark, sf_dir):
    """The 25 best documents of each query by BM25 over its first twelve words."""
    docs = read(spark, sf_dir, "documents")
    asked = _query_tokens(spark, sf_dir).select(F.col("q").alias("item_id"), F.explode(index.first_terms(F.col("tokens"))).alias("term"))
    # Only words that some query has are worth a shuffle; a document's length comes along as a row without a word.
    # Texts without words leave once the rows are stored: a filter ahead of that would tokenize every text a second time.
    each = _texts(spark, sf_dir).select("doc_id", t.tokenize(F.col("text")).alias("tokens"))
    each = each.select("doc_id", F.size("tokens").alias("length"), F.explode(F.array_append("tokens", F.lit(None))).alias("term"))
    each = each.join(asked.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left").filter("asked or term is null")
    terms = materialise(each.groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf")), "terms")
    total = docs.count()
    mean = terms.filter("term is null and length > 0").agg(F.avg("length")).first()[0] or 1.0
    return index.bm25(asked, terms.filter("term is not null"), total, mean, "item_id", "doc_id", digits=6)


@query(f"""{_INDEX_SQL}, r AS (SELECT item_id, token, df, row_number() OVER (PARTITION BY item_id ORDER BY df, token) AS rk FROM q JOIN df USING (token)),
e AS (SELECT * FROM r WHERE rk = 1 OR df <= {index.LONG}), h AS (SELECT item_id, doc_id, min(rk) AS rk FROM e JOIN post USING (token) GROUP BY item_id, doc_id),
p AS (SELECT item_id, rk, count(*) AS new FROM h GROUP BY item_id, rk),
c AS (SELECT item_id, rk, coalesce(sum(new) OVER (PARTITION BY item_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found FROM p)
SELECT h.item_id, h.doc_id FROM h JOIN c ON h.item_id = c.item_id AND h.rk = c.rk WHERE found <= {index.ENOUGH}""")
def candidate_cap(spark, sf_dir):
    """Candidates of each query: no further word once ENOUGH were found, postings over LONG skipped."""
    asked = _query_tokens(spark, sf_dir).select(F.col("q").alias("item_id"), F.explode("tokens").alias("token"))
    posted = materialise(_posted(spark, sf_dir).join(asked.select("token").distinct(), "token", "left_semi"), "postings")
    return index.capped_candidates(asked, posted, index.doc_frequency(posted), "item_id", "doc_id")


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All part names as queries over all distinct descriptions as lines."""
    part = read(spark, sf_dir, "part")
    kinds = part.select("p_name", "p_type").distinct().withColumn("id", F.concat_ws("|", "p_name", "p_type"))
    search = F.concat_ws(" ", "p_name", "p_type")
    these = kinds.select("id", t.token_set(search).alias("tokens"), t.token_set(F.col("p_type")).alias("specific"), t.nearest_tokens(F.col("p_type")).alias("nearest"), search.alias("legal_path"))
    asked = kinds.select(F.concat_ws(" ", "p_name", F.lit("steel bolt")).alias("expanded")).distinct()
    return asked.select(F.col("expanded").alias("q"), "expanded", t.token_set(F.col("expanded"), True).alias("tokens")), these


def _part_scores(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, these = _parts(spark, sf_dir)
    posted = index.postings(these, "id", F.col("tokens"))
    weights = index.with_idf(index.doc_frequency(posted), these.count())
    pool = asked.select("q", F.explode("tokens").alias("token")).join(posted, "token").select("q", "id").distinct()
    return rank.score_pool(pool, asked, these, weights, "q", "id"), asked, these


@query(f"""WITH kinds AS (SELECT DISTINCT p_name, p_type, p_name || '|' || p_type AS id FROM part),
ask AS (SELECT DISTINCT p_name || ' steel bolt' AS q FROM kinds), {sql_tokens("(SELECT id, p_name || ' ' || p_type AS x FROM kinds)", 'id', 'x', 'lk')},
{sql_tokens('kinds', 'id', 'p_type', 'sk')}, {sql_tokens('ask', 'q', 'q', 'qk', True)},
lt AS (SELECT DISTINCT id, token FROM lk), sp AS (SELECT DISTINCT id, token FROM sk), qt AS (SELECT DISTINCT q, token FROM qk),
idf AS (SELECT token, ln(((SELECT greatest(count(*), 1) FROM kinds) + 1) / (count(*) + 1)) + 1.0 AS idf FROM lt GROUP BY token),
nq AS (SELECT q, count(*) AS n FROM qt GROUP BY q),
o AS (SELECT q, id, sum(idf) AS w, count(*) AS k FROM qt JOIN lt USING (token) JOIN idf USING (token) GROUP BY q, id),
nr AS (SELECT q, id, sum(coalesce(idf, 1.0)) AS w, count(*) AS k FROM qt JOIN sp USING (token) LEFT JOIN idf USING (token) GROUP BY q, id),
ns AS (SELECT id, count(*) AS n, sum(coalesce(idf, 1.0)) AS w FROM sp LEFT JOIN idf USING (token) GROUP BY id)
SELECT o.q, o.id, round(o.w * (0.65 + 0.35 * o.k / nq.n) + 1.2 * coalesce(nr.w, 0) - 0.45 * (coalesce(ns.n, 0) - coalesce(nr.k, 0)) - 0.2 * (coalesce(ns.w, 0) - coalesce(nr.w, 0)) + CASE WHEN ns.n IS NULL THEN 0.15 ELSE 0 END, 6) AS score, CAST(o.k AS BIGINT) AS n_overlap
FROM o JOIN nq USING (q) LEFT JOIN nr ON nr.q = o.q AND nr.id = o.id LEFT JOIN ns ON ns.id = o.id""")
def full_score(spark, sf_dir):
    """The whole score: overlap, nearest words, missing nearest words, extra words, residual lines."""
    return _part_scores(spark, sf_dir)[0]


@query(fuzzy_sql(ORACLE["full_score"]))
def fuzzy_rerank(spark, sf_dir):
    """All candidates of each query, the first eight ranked anew with the token-set ratio."""
    scored, asked, these = _part_scores(spark, sf_dir)
    both = materialise(scored, "scored").join(asked.select("q", "expanded"), "q").join(these.select("id", "legal_path"), "id")
    return rank.fuzzy_rerank(both, "expanded", "legal_path", "q", "id").select("q", "id", "score", "place")


# Rules ---------------------------------------------------------------------------------------------------------------
def _bolt(name: str, heading: str, pattern: str) -> rules.Rule:
    return rules.Rule(name, heading, lambda x: x.rlike(pattern), None)


PART_RULES = (
    rules.Rule("bolts", "7318", lambda x: x.rlike(r"\bbolts?\b") & ~x.rlike(r"\bbrass\b"), None),
    _bolt("gears", "8483", r"\bgears?\b|\bbearings?\b"),
    _bolt("rings", "7326", r"\brings?\b|\bsteel\b"),
    _bolt("others", "7419", r"\b(?:brass|copper)\b"),
)


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(d, '\bbolts?\b') AND NOT regexp_matches(d, '\bbrass\b') THEN 'bolts' WHEN regexp_matches(d, '\bgears?\b|\bbearings?\b') THEN 'gears'
  WHEN regexp_matches(d, '\brings?\b|\bsteel\b') THEN 'rings' WHEN regexp_matches(d, '\b(?:brass|copper)\b') THEN 'others' END AS rule
  FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g'))) AS d FROM part)""")
def rule_dispatch(spark, sf_dir):
    """The first of an ordered table of rules that fires on a part's description."""
    return read(spark, sf_dir, "part").select("p_partkey", rules.rule_id(F.concat_ws(" ", "p_name", "p_type"), PART_RULES).alias("rule"))


_GOODS = ["Clear silicone sealant", "Copper slip in a pot", "Wood glue, 500 g", "Epoxy adhesive, 20 kg", "White portland cement", "Asphalt sealants for gutters", "Bearing seals", "Tectyl wax as an aerosol", "Hydraulic oils", "Crankcase oils", "Rust preventing primer", "Garden chairs"]
_GOODS_RULES = ["mastic_3214 3214.10.00", "lubricant_3403 3403.99.90", "adhesive_3506 3506.10.00", "adhesive_3506 3506.91.00", "hydraulic_cement_2523 2523.21.00", "bituminous_mastic_2715 2715.00.20", "mechanical_seal_8484 8484.20.00", "surface_coating_3403_19 3403.19.10", "synthetic_hydraulic_3403 3403.99.90", "petroleum_oil_2710 -", "- -", "- -"]


@query(f"SELECT p_partkey, list_element([{', '.join(f'{chr(39)}{x}{chr(39)}' for x in _GOODS_RULES)}], CAST(p_partkey % {len(_GOODS)} AS INT) + 1) AS outcome FROM part")
def goods_rules(spark, sf_dir):
    """Rule and preferred code of goods named in turn by the part's key."""
    goods = F.element_at(F.array(*map(F.lit, _GOODS)), (F.col("p_partkey") % len(_GOODS)).cast("int") + 1)
    df = read(spark, sf_dir, "part").select("p_partkey", goods.alias("d")).withColumn("rule", rules.rule_id(F.col("d")))
    code = rules.rule_columns(F.col("rule"), F.col("d"))["rule_code"]
    return df.select("p_partkey", F.concat_ws(" ", F.coalesce("rule", F.lit("-")), F.coalesce(code, F.lit("-"))).alias("outcome"))


# Order within documents ----------------------------------------------------------------------------------------------
@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN last_value(CASE WHEN role <> 'assistant' AND turn % 3 <> 1 THEN left(md5(text), 8) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, md5(text) ROWS UNBOUNDED PRECEDING)
    WHEN turn % 3 <> 1 THEN left(md5(text), 8) END AS code, role = 'assistant' AS same_as_above FROM conversations""")
def ditto_fill(spark, sf_dir):
    """Assistant turns repeat the last code above them; some turns have none."""
    m = F.md5("text")
    code = F.when(F.col("role") == "assistant", windows.DITTO_MARK).when(F.col("turn") % 3 != 1, F.left(m, F.lit(8)))
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", m.alias("m"), code.alias("noted_code"))
    return windows.fill_dittos(df, ["conv_id"], ["turn", "m"]).select("conv_id", "turn", F.col("noted_code").alias("code"), "same_as_above")


@query("SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_number FROM lineitem")
def line_numbering(spark, sf_dir):
    """Lines numbered over all orders, without one task that sees them all."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    df = read(spark, sf_dir, "lineitem").withColumn("o", order)
    return windows.number_all(df, "l_orderkey", "o").select("l_orderkey", "l_partkey", "l_quantity", "line_number")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) = 1")
def exact_dedup(spark, sf_dir):
    """The first of equal texts within a source, by normalised form."""
    df = read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64(norm_ := t.norm(F.col("text"))).alias("h1"), F.md5(norm_).alias("h2"))
    return windows.first_wins(df, ["source"], [F.col("h1"), F.col("h2")], ["doc_id"]).select("doc_id", "source")


@query(r"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(l, '[A-Za-z]{3,}')) AS n_valid, count(*) FILTER (h >= 2) AS n_header, CAST(sum(length(l)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, l, (contains(lower(l), 'description')::INT + contains(lower(l), 'qty')::INT + contains(lower(l), 'quantity')::INT + contains(lower(l), 'part no')::INT + contains(lower(l), 'part number')::INT + contains(lower(l), 'part nr')::INT + contains(lower(l), 'sku')::INT + contains(lower(l), 'serial')::INT) AS h
  FROM (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l FROM documents)) GROUP BY doc_id""")
def line_split_filter(spark, sf_dir):
    """Lines of each document, and how many are valid or headers."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.explode(lines.split_lines(F.col("text"))).alias("l"))
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(t.valid_description(F.col("l"))).alias("n_valid"), F.count_if(lines.is_header_line(F.col("l"))).alias("n_header"), F.sum(F.char_length("l")).alias("n_chars"))


def _sql_part(x: str) -> str:
    return rf"(regexp_full_match(upper({x}), '[A-Z0-9][A-Z0-9\-/_.]{{1,24}}') AND lower({x}) NOT IN ({_list(t.UNIT_WORDS)}) AND regexp_matches({x}, '[\d\-/_]'))"


def _sql_number(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({x}, '\d{{1,3}}(,\d{{3}})+(\.\d+)?') THEN CAST(replace({x}, ',', '') AS DOUBLE) WHEN contains({x}, ',') AND NOT contains({x}, '.') THEN TRY_CAST(replace({x}, ',', '.') AS DOUBLE) ELSE TRY_CAST({x} AS DOUBLE) END"


_HEADERS = " + ".join(f"contains(lower(raw), '{k}')::INT" for k in lines.HEADER_KEYS)
_SKIP = lines.SKIP.replace("(?iU)", "(?i)").replace("'", "''")
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '({_BREAK})$', ''), '{_BREAK}') AS ls FROM documents)),
r AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '[|\t]', ' ', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')) AS raw FROM l),
c AS (SELECT *, regexp_extract(raw, '(?i)^(\d+(?:[.,]\d+)?)\s*[x×]\s+(.+)$', 1) AS times, regexp_extract(raw, '(?i)^(\d+(?:[.,]\d+)?)\s*[x×]\s+(.+)$', 2) AS goods FROM r
  WHERE length(raw) >= 5 AND ({_HEADERS}) < 2 AND NOT regexp_matches(raw, '^[\W_]+$') AND NOT regexp_matches(raw, '{_SKIP}') AND regexp_matches(raw, '[A-Za-z]{{3}}')),
k AS (SELECT *, string_split(CASE WHEN goods <> '' THEN goods ELSE raw END, ' ') AS ts0 FROM c),
i AS (SELECT *, CASE WHEN goods = '' AND regexp_full_match(ts0[1], '[0-9]+') AND TRY_CAST(ts0[1] AS BIGINT) < 500 AND len(ts0) >= 3 THEN ts0[2:] ELSE ts0 END AS ts FROM k),
n AS (SELECT *, regexp_full_match(ts[-1], '\d+(?:[.,]\d+)?') AS num, lower(coalesce(ts[-2], '')) AS bef FROM i),
q AS (SELECT *, CASE WHEN goods <> '' OR NOT num THEN 0 WHEN bef IN ('qty', 'quantity') THEN 2 WHEN bef IN ({_list(t.MEASURE_UNITS)}) THEN 0 ELSE 1 END AS cut FROM n),
v AS (SELECT *, ts[1:len(ts) - cut] AS rest, CASE WHEN goods <> '' THEN {_sql_number('times')} WHEN cut > 0 THEN {_sql_number('ts[-1]')} END AS quantity FROM q),
w AS (SELECT *, coalesce(starts_with(rest[2], '-') AND {_sql_part("(rest[1] || rest[2])")}, false) AS joined, coalesce({_sql_part('rest[1]')}, false) AS alone FROM v WHERE len(rest) > 0),
d AS (SELECT *, CASE WHEN joined THEN upper(rest[1] || rest[2]) WHEN alone THEN upper(rest[1]) END AS part_number, trim(array_to_string(CASE WHEN joined THEN rest[3:] WHEN alone THEN rest[2:] ELSE rest END, ' '), CASE WHEN goods <> '' THEN ' ' ELSE ' -' END) AS description FROM w)
SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(pos AS INT) AS pos, part_number, description, quantity FROM d WHERE regexp_matches(description, '[A-Za-z]{{3,}}') AND (goods <> '' OR quantity IS NOT NULL OR part_number IS NOT NULL OR regexp_matches(raw, '\d'))
QUALIFY row_number() OVER (PARTITION BY doc_id, upper(coalesce(part_number, '')), lower(description), lower(raw) ORDER BY pos) = 1""")
def product_lines(spark, sf_dir):
    """Product lines of the documents.  The SQL is of free lines: no document of the tables has a header or serial rows."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text")
    return lines.extract_lines(docs).select("source_file", "pos", "part_number", "description", "quantity")


@query("""WITH w AS (SELECT doc_id, 0 AS way, quality AS value FROM labels UNION ALL SELECT doc_id, 1, CAST(n_chars % 2 AS INT) FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, 2, -1 FROM documents)
SELECT doc_id, way, value FROM w QUALIFY way = min(way) OVER (PARTITION BY doc_id)""")
def fallback_precedence(spark, sf_dir):
    """Labels before lengths before nothing: the first that a document has."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ways = labels.select("doc_id", F.lit(0).alias("way"), F.col("quality").alias("value"))
    ways = ways.unionAll(docs.filter("n_chars > 500").select("doc_id", F.lit(1), (F.col("n_chars") % 2).cast("int"))).unionAll(docs.select("doc_id", F.lit(2), F.lit(-1)))
    return windows.by_precedence(ways, ["doc_id"], "way").select("doc_id", "way", "value")


# Hierarchy -----------------------------------------------------------------------------------------------------------
@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'OTHER' THEN r_name || ' | ' || n_name ELSE r_name || ' | ' || n_name || ' | ' || c_mktsegment END AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_path(spark, sf_dir):
    """Region, nation and segment of each customer as a path."""
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return df.select("c_custkey", hierarchy.legal_path(F.array("r_name", "n_name"), F.col("c_mktsegment")).alias("path"))


_CODE = "lpad(CAST(p_partkey % 97 + 1 AS {s}), 4, '0') || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN CAST(p_size % 10 AS {s}) WHEN 2 THEN lpad(CAST(p_size AS {s}), 2, '0') ELSE lpad(CAST(p_size AS {s}), 2, '0') || '10' END"
_ROWS_SQL = f"WITH r AS (SELECT p_brand AS doc, p_partkey AS pos, {_CODE.format(s='VARCHAR')} AS digits, p_name AS description FROM part), o AS (SELECT doc, digits, row_number() OVER (PARTITION BY doc ORDER BY left(digits, 4), pos) AS pos, description FROM r)"
_ENDS_SQL = "e AS (SELECT a.doc, a.pos, a.digits, min(b.pos) AS stop FROM o a LEFT JOIN o b ON a.doc = b.doc AND b.pos > a.pos AND left(a.digits, 4) = left(b.digits, 4) AND NOT (starts_with(b.digits, a.digits) AND length(b.digits) > length(a.digits)) GROUP BY ALL)"


def _code_rows(spark, sf_dir) -> DataFrame:
    df = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.expr(_CODE.format(s="STRING")).alias("digits"), F.col("p_name").alias("description"))
    return df.withColumn("pos", F.row_number().over(W.partitionBy("doc").orderBy(F.left("digits", F.lit(4)), "p_partkey")))


@query(f"{_ROWS_SQL}, {_ENDS_SQL} SELECT o.doc, CAST(o.pos AS INT) AS pos, CAST(e.pos AS INT) AS a_pos, e.digits AS a_digits FROM o JOIN e ON o.doc = e.doc AND o.pos > e.pos AND (e.stop IS NULL OR o.pos < e.stop) AND left(o.digits, 4) = left(e.digits, 4) AND starts_with(o.digits, e.digits) AND length(o.digits) > length(e.digits)")
def prefix_ancestors(spark, sf_dir):
    """Ancestors by digits in document order."""
    return hierarchy.ancestors(_code_rows(spark, sf_dir), "doc").select("doc", "pos", "a_pos", "a_digits")


@query(f"{_ROWS_SQL} SELECT doc, CAST(pos AS INT) AS pos, digits FROM o a WHERE length(digits) >= 6 AND NOT EXISTS (SELECT 1 FROM o b WHERE a.doc = b.doc AND b.pos > a.pos AND starts_with(b.digits, a.digits) AND length(b.digits) > length(a.digits))")
def leaf_lines(spark, sf_dir):
    """Codes of six digits and more that no later one extends."""
    rows = _code_rows(spark, sf_dir)
    return rows.join(hierarchy.extended(rows, "doc"), ["doc", "pos"], "left_anti").filter(F.char_length("digits") >= 6).select("doc", "pos", "digits")


@query(f"WITH r AS (SELECT p_partkey, {_CODE.format(s='VARCHAR')} AS digits, CASE WHEN p_partkey % 5 = 0 THEN 'Other:' ELSE p_name END AS d FROM part) SELECT left(digits, 4) AS heading, arg_min(d, (length(digits), digits, p_partkey)) AS heading_text FROM r WHERE d <> 'Other:' GROUP BY 1")
def heading_wording(spark, sf_dir):
    """The first wording of each heading."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE.format(s="STRING")).alias("digits"), F.when(F.col("p_partkey") % 5 == 0, "Other:").otherwise(F.col("p_name")).alias("description"))
    return heading_text(df.withColumn("heading", F.left("digits", F.lit(4))), id_col="p_partkey")


# Lookups and checks --------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def code_lookup(spark, sf_dir):
    """Lines with what their key names, if it is declared."""
    part = read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_brand")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY l_partkey")
def undeclared_code(spark, sf_dir):
    """Keys of lines that are not declared."""
    part = read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").join(part, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


_CHECK_SQL = """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '3214.10.00' WHEN o_orderkey % 4 = 2 THEN '3304.99.90' ELSE '9' || substr(o_orderpriority, 1, 1) || '01.10.00' END AS written,
  CASE WHEN o_orderkey % 3 = 0 THEN '3214.10.00' WHEN o_orderkey % 3 = 1 THEN '3403.99.90' END AS checked, o_orderkey % 4 = 1 AS declared, o_orderkey % 2 = 0 AS ditto FROM orders),
f AS (SELECT *, CASE WHEN written IS NULL THEN '' WHEN written = coalesce(checked, '') THEN 'ok' WHEN written LIKE '33%' AND coalesce(checked, '') NOT LIKE '33%' THEN 'critical' ELSE 'incorrect' END AS flag FROM x)"""


def _checked(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.when(k % 4 == 0, None).when(k % 4 == 1, "3214.10.00").when(k % 4 == 2, "3304.99.90").otherwise(F.concat(F.lit("9"), F.substring("o_orderpriority", 1, 1), F.lit("01.10.00")))
    checked = F.when(k % 3 == 0, "3214.10.00").when(k % 3 == 1, "3403.99.90")
    df = read(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"), checked.alias("checked"), (k % 4 == 1).alias("declared"), (k % 2 == 0).alias("ditto"))
    return df.withColumn("flag", verify.flag(F.col("written"), F.col("checked"), F.col("declared")))


@query(f"""{_CHECK_SQL} SELECT o_orderkey, flag, CASE flag WHEN '' THEN '' WHEN 'ok' THEN 'Handwritten code matches.'
  WHEN 'critical' THEN 'Handwritten ' || written || ' is Chapter 33, cosmetics and skincare. These goods are ' || coalesce(checked, '') || '.'
  ELSE CASE WHEN NOT declared THEN 'Handwritten ' || written || ' is not a declarable code on this schedule.' ELSE 'Handwritten ' || written || ' does not match ' || coalesce(checked, '') || '.' || CASE WHEN ditto THEN ' The quote repeats the line above.' ELSE '' END END END AS note FROM f""")
def verify_flags(spark, sf_dir):
    """The ordered check of written codes."""
    c = F.col
    return _checked(spark, sf_dir).select("o_orderkey", "flag", verify.flag_note(c("flag"), c("written"), c("checked"), c("declared"), c("ditto")).alias("note"))


@query(f"{_CHECK_SQL} SELECT count(*) FILTER (flag IN ('incorrect', 'critical')) AS flagged FROM f")
def flag_summary(spark, sf_dir):
    return sinks.flagged(_checked(spark, sf_dir))


@query(r"""SELECT page_id, CAST(p AS INT) AS pos, line FROM (SELECT page_id, p, trim(regexp_replace(l, '[\s\x1c-\x1f]+', ' ', 'g')) AS line FROM (
  SELECT page_id, generate_subscripts(ls, 1) - 1 AS p, unnest(ls) AS l FROM (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
    '(?s)</?(?:p|div|li|h[1-6]|br|ul|nav|article|footer)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '\r\n|\r|\n') AS ls FROM pages))) WHERE line <> ''""")
def html_text_lines(spark, sf_dir):
    """Pages as lines of their text, markup away."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<(?:/?(?:p|div|li|h[1-6]|br|ul|nav|article|footer)\b[^>]*)>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "")
    df = read(spark, sf_dir, "pages").select("page_id", F.posexplode(lines.split_lines(bare)).alias("pos", "line"))
    return df.select("page_id", "pos", t.squash(F.col("line")).alias("line")).filter("line <> ''")


@query("""SELECT o_orderkey, CASE WHEN length(d) <= 56 THEN d ELSE rtrim(left(d, 55)) || '…' END AS report_description, concat_ws(' · ', CASE f WHEN 'critical' THEN 'Critical' WHEN 'incorrect' THEN 'Incorrect' WHEN 'ok' THEN 'Correct' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Amended' END, nullif(duty, '')) AS note FROM (
  SELECT o_orderkey, c_name || ' in ' || c_mktsegment || ' orders at priority ' || o_orderpriority || ' and status ' || o_orderstatus AS d, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'ok' ELSE 'incorrect' END AS f, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Free' END AS duty FROM orders JOIN customer ON o_custkey = c_custkey)""")
def report_rows(spark, sf_dir):
    """Descriptions clipped for a long report, with their notes."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    d = F.concat("c_name", F.lit(" in "), "c_mktsegment", F.lit(" orders at priority "), "o_orderpriority", F.lit(" and status "), "o_orderstatus")
    flag = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "ok").otherwise("incorrect")
    df = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", d.alias("description"), flag.alias("flag"), (F.col("o_orderkey") % 2 == 0).alias("amended"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("Free").alias("duty_rate_general"))
    return sinks.report_rows(df, 100).select("o_orderkey", "report_description", "note")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS line_number, CAST(o_custkey AS VARCHAR) AS source_file, '' AS part_number, o_orderpriority AS description, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS quantity, '' AS hs_code, o_orderstatus AS duty_rate_general, '' AS wco_reasoning FROM orders""")
def public_projection(spark, sf_dir):
    """The public columns as CSV text."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    q = F.when(k % 3 == 1, F.col("o_custkey").cast("double")).when(k % 3 == 2, F.col("o_custkey") + 0.5)
    df = read(spark, sf_dir, "orders").select(k.alias("line_number"), F.col("o_custkey").alias("source_file"), none.alias("part_number"), F.col("o_orderpriority").alias("description"), q.alias("quantity"), none.alias("hs_code"), F.col("o_orderstatus").alias("duty_rate_general"), none.alias("wco_reasoning"), F.lit(1).alias("more"))
    return sinks.csv_columns(df)


def queries() -> dict[str, Query]:
    from stratalex.plans import ruled, stores

    return QUERIES | generated.QUERIES | stores.QUERIES | ruled.QUERIES


def oracle_sql() -> dict[str, str]:
    from stratalex.plans import ruled, stores

    return ORACLE | generated.ORACLE | stores.ORACLE | ruled.ORACLE
