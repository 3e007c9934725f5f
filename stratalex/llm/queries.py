"""The operators as queries over the input tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import bpe, chat, exact_dedup, html_extract, importance, jaccard_join, line_dedup, merkle, minhash, mixing, quality, secrets, simhash
from stratalex.llm.common import read


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary_path(), with_texts=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_chain(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = quality.select_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return picked.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_exact_dedup, op4_bpe, op5_html_extraction, op6_mixing, op7_fingerprints, op8_quality, op9_simhash, op10_chat_format, op11_importance, op12_jaccard_join, op13_merkle)}


def _sql_secrets() -> str:
    """Matches of each kind, placed by the text between them; then ownership, as in the operator."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern) in enumerate(secrets.KINDS.items()):
        value = f"regexp_extract(m, {quote(pattern)}, 2)" if kind == "assign" else "m"
        keep = {"assign": "length(value) >= 6", "opaque": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9].*[0-9]')"}.get(kind, "true")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, begin_ AS start_, begin_ + length(m) AS end_, value FROM (
  SELECT doc_id, m, {value} AS value, CAST(sum(length(b)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_ FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), {quote(pattern)}) AS ms, string_split_regex(coalesce(text, ''), {quote(pattern)}) AS bs FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}""")
    first, weak = len(secrets.BASE), secrets.WEAK
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT * FROM f WHERE rank < {weak} OR NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.rank < {weak} AND f.start_ < b.end_ AND b.start_ < f.end_)),
c AS (SELECT value FROM g JOIN documents USING (doc_id) GROUP BY value HAVING count(DISTINCT coalesce(source, '\x00')) >= {secrets.EXAMPLE_OWNERS} OR (count(DISTINCT coalesce(source, '\x00')) > 1 AND count(DISTINCT (coalesce(source, '\x00'), concat_ws('/', source, lang))) >= {secrets.EXAMPLE_REPOS})),
h AS (SELECT *, value IN (SELECT value FROM c) AS example FROM g),
k AS (SELECT * FROM h WHERE rank <> {weak} OR NOT example),
s AS (SELECT doc_id, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank, end_) AS spans, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank, end_) FILTER (rank < {first}) AS base,
  count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(DISTINCT value) FILTER (NOT example) AS n_live, count(DISTINCT value) FILTER (example) AS n_example FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN s USING (doc_id)"""


_LINES_SQL = f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, p, l || chr(10) || lead(l, 1) OVER x || chr(10) || lead(l, 2) OVER x AS w FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY w) AS again FROM w WHERE w IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest(range({line_dedup.WINDOW})) AS o) WHERE again)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS text, count(*) AS n_lines, count(g.p) AS n_removed FROM l LEFT JOIN g USING (doc_id, p) GROUP BY doc_id"""

_EXACT_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

_COPIES = f"""CASE WHEN x.size > 0 THEN greatest(0, least(least({mixing.MOST}, CAST(ceil(x.rate / {mixing.UNIT}.0) AS BIGINT) + 1), (x.size * x.rate + acc.owed + x.size * {mixing.UNIT // 2}) // greatest(x.size * {mixing.UNIT}, 1))) ELSE least(1, CAST(ceil(x.rate / {mixing.UNIT}.0) AS BIGINT)) END"""
_MILLIONTHS = lambda x: f"coalesce(CAST(sum(CAST(round(({x}) * {mixing.UNIT}) AS HUGEINT)) AS DOUBLE) / {mixing.UNIT}, 0)"
#: The dual's Newton steps as a recursion over beta and its bracket; one block per source, as where none has over
#: BLOCK_ROWS documents.
_LEVELS = f"""SELECT *, least(coalesce(level * tilt, {mixing.MOST}), {mixing.MOST}) * size * n AS mass, CASE WHEN level * tilt < {mixing.MOST} THEN level * tilt * size * n ELSE 0 END AS bends FROM (
  SELECT *, arg_max(try_, (beta * f, -size)) FILTER (try_ * tilt <= {mixing.MOST}) OVER (PARTITION BY place) AS level FROM (
    SELECT *, (target - above) / below AS try_ FROM (
      SELECT *, coalesce(sum({mixing.MOST} * size * n) OVER (PARTITION BY place ORDER BY beta * f DESC, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(size * n * tilt) OVER (PARTITION BY place ORDER BY beta * f, size DESC ROWS UNBOUNDED PRECEDING) AS below FROM (
        SELECT *, exp(beta * f) AS tilt FROM {{state}}, c))))"""
_MIX_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
o AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
v AS (SELECT *, CAST(sum(total) OVER () - {mixing.MOST} * coalesce(sum(total) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level FROM o WINDOW b AS (ORDER BY total / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT *, least(weight * (SELECT arg_min(level, (total / weight, place)) FROM v WHERE level * weight <= {mixing.MOST} * total), CAST({mixing.MOST} * total AS DOUBLE)) AS target FROM v),
z AS (SELECT CAST(sum(target) AS DOUBLE) AS tokens FROM t),
c0 AS (SELECT place, target, size, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY place, target, size),
mid AS (SELECT round({_MILLIONTHS("size * n * ln(size)")} / CAST(sum(size * n) AS DOUBLE), 9) AS centre FROM c0),
c AS MATERIALIZED (SELECT place, target, size, n, round(ln(size) - centre, 9) AS f FROM c0, mid),
it AS (
SELECT 0 AS k, CAST(0 AS DOUBLE) AS beta, CAST(-{mixing.BETA_MOST} AS DOUBLE) AS low, CAST({mixing.BETA_MOST} AS DOUBLE) AS high
UNION ALL
SELECT k + 1, CASE WHEN low < moved AND moved < high THEN moved ELSE (low + high) / 2 END, low, high FROM (
  SELECT k, CASE WHEN slope > 0 THEN beta ELSE low END AS low, CASE WHEN slope > 0 THEN high ELSE beta END AS high, beta + slope / greatest(bend + {mixing.RIDGE} * tokens, {mixing.RIDGE} * tokens) AS moved FROM (
    SELECT k, beta, low, high, tokens, -{_MILLIONTHS("g")} - {mixing.RIDGE} * tokens * beta AS slope, {_MILLIONTHS("dd - CASE WHEN a > 0 THEN b * b / a ELSE 0 END")} AS bend FROM (
      SELECT k, beta, low, high, place, {_MILLIONTHS("bends")} AS a, {_MILLIONTHS("bends * f")} AS b, {_MILLIONTHS("bends * f * f")} AS dd, {_MILLIONTHS("mass * f")} AS g FROM ({_LEVELS.format(state="it")}) GROUP BY k, beta, low, high, place), z
    GROUP BY k, beta, low, high, tokens)
  WHERE k < {mixing.STEPS} AND abs(slope) > {mixing.NEAR} * tokens AND high - low >= {mixing.NARROW})),
last_ AS (SELECT * FROM it ORDER BY k DESC LIMIT 1),
y AS (SELECT place, max(level) AS reached FROM ({_LEVELS.format(state="last_")}) GROUP BY place),
e AS (SELECT d.doc_id, d.source, CAST(d.size AS BIGINT) AS size, t.total, t.target, CASE WHEN t.total > 0 THEN CAST(round(least(coalesce(reached * exp(beta * CASE WHEN size > 0 THEN round(ln(greatest(size, 1)) - centre, 9) ELSE 0 END), {mixing.MOST}), {mixing.MOST}) * {mixing.UNIT}) AS BIGINT) ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN y ON y.place = t.place, last_, mid),
k AS (SELECT source, any_value(total) AS total, any_value(target) AS target, list(doc_id ORDER BY size DESC, doc_id DESC) AS ids, list({{'size': size, 'rate': rate, 'owed': 0::BIGINT, 'out': []::BIGINT[]}} ORDER BY size DESC, doc_id DESC) AS docs FROM e GROUP BY source),
f AS (SELECT total, target, ids, docs, list_reduce(docs, lambda acc, x: {{'size': x.size, 'rate': x.rate, 'owed': x.size * x.rate + acc.owed - x.size * {mixing.UNIT} * {_COPIES}, 'out': list_append(acc.out, {_COPIES})}}, {{'size': 0::BIGINT, 'rate': 0::BIGINT, 'owed': 0::BIGINT, 'out': []::BIGINT[]}}).out AS copies FROM k)
SELECT unnest(ids) AS doc_id, unnest(list_transform(docs, lambda x: x.size)) AS size, total AS source_size, target, unnest(list_transform(docs, lambda x: x.size)) * unnest(copies) AS taken FROM f"""


_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT row, md5_number_lower(array_to_string(ws[i:i + {jaccard_join.SHINGLE - 1}], ' ')) AS s FROM (SELECT row, ws, unnest(range(1, greatest(len(ws) - {jaccard_join.SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT row, count(*) AS n FROM s GROUP BY row),
b AS (SELECT x.row AS a, y.row AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.row < y.row GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * k >= {jaccard_join.LEAST} * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT row, row FROM w),
r AS (SELECT row AS a, row AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y.doc_id) FROM r JOIN w y ON y.row = r.b WHERE r.a = x.row) AS component_id FROM w x LEFT JOIN n USING (row)"""

#: The CRC-32 of a text, bit by bit over its bytes.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = "SELECT tree, lvl + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM {t} WHERE n > 1 GROUP BY tree, lvl, p // 2, n"
#: A row climbs its tree: the digest that it gives, and the siblings so far.
_FOLD = "SELECT x.row, x.tree, x.lvl + 1, x.p // 2, sha256(CASE WHEN s.h IS NULL THEN x.h WHEN x.p % 2 = 1 THEN s.h || x.h ELSE x.h || s.h END), x.said || coalesce(s.h, '') FROM {f} x JOIN {t} o ON o.tree = x.tree AND o.lvl = x.lvl AND o.p = x.p AND o.n > 1 LEFT JOIN {t} s ON s.tree = x.tree AND s.lvl = x.lvl AND s.p = xor(x.p, 1)"
_GRAMS = "SELECT doc, unnest(ws) AS f FROM {t} UNION ALL SELECT doc, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc, ws, unnest(range(1, len(ws))) AS i FROM {t})"
_TOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws"
_IMPORTANCE_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_TOLD} FROM documents), b AS (SELECT item_id AS doc, {_TOLD} FROM benchmark),
df AS MATERIALIZED (SELECT doc, f, count(*) AS n FROM ({_GRAMS.format(t='d')}) GROUP BY ALL), bf AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_GRAMS.format(t='b')}) GROUP BY f),
h AS MATERIALIZED (SELECT f, {_CRC.format(x='f')} % {importance.BUCKETS} AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT k, sum(n) AS n FROM df JOIN h USING (f) GROUP BY k), t AS (SELECT k, sum(n) AS n FROM bf JOIN h USING (f) GROUP BY k),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
g AS MATERIALIZED (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + {importance.BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * (tot.t + {importance.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k), tot),
w AS (SELECT doc, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY doc),
e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS gumbel FROM d LEFT JOIN w USING (doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {importance.LEAST_WORDS} ORDER BY weight + gumbel DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {importance.LEAST_WORDS}) AS n FROM e)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN n_words >= {importance.LEAST_WORDS} AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM r"""
_MERKLE_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(n='n_chars')} AS leaf, CASE WHEN {_CRC.format(x='CAST(doc_id AS VARCHAR)')} % {merkle.TAMPER} = 0 THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS start FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM d WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
t AS (SELECT tree, 0 AS lvl, p, n, leaf AS h FROM o UNION ALL {_UP.format(t='t')}),
f AS (SELECT row, tree, 0 AS lvl, p, start AS h, '' AS said FROM o UNION ALL {_FOLD.format(f='f', t='t')}),
r AS MATERIALIZED (SELECT tree AS of_, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT '' AS tree, 0 AS lvl, p, n, h FROM r UNION ALL {_UP.format(t='u')}),
e AS MATERIALIZED (SELECT row, arg_max(h, lvl) AS h, arg_max(said, lvl) AS said FROM f GROUP BY row),
g AS (SELECT e.row, '' AS tree, 0 AS lvl, r.p, e.h, e.said FROM e JOIN o USING (row) JOIN r ON r.of_ = o.tree UNION ALL {_FOLD.format(f='g', t='u')}),
z AS (SELECT row, arg_max(h, lvl) AS h, arg_max(said, lvl) AS said FROM g GROUP BY row), top AS (SELECT h FROM u WHERE n = 1)
SELECT doc_id, leaf, r.h AS subroot, top.h AS root, sha256(z.said) AS proof_sha256, z.h AS folded_root, z.h = top.h AS verified FROM d JOIN z USING (row) JOIN r ON r.of_ = d.tree, top"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _sql_secrets(), "op2_line_dedup": _LINES_SQL, "op3_exact_dedup": _EXACT_SQL, "op6_mixing": _MIX_SQL, "op11_importance": _IMPORTANCE_SQL, "op12_jaccard_join": _JACCARD_SQL, "op13_merkle": _MERKLE_SQL}
