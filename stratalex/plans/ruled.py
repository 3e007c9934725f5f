"""Driver queries of the rule table: names made of every trigger and every guard, the outcome spelled out in SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import rules
from stratalex.plans.queries import _sql_mass

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_TRIGGERS = (
    "bituminous mastic", "asphalt compounds", "bitumen mastics", "mechanical seal", "oil seals", "shaft  seal", "fuel additive", "oil additives", "tectyl 891d", "ardrox av40", "corban 27", "corrosion inhibitor",
    "scotch brite", "scouring pads", "abrasive pad", "anti-seize compound", "copper slip", "moly paste", "bearing grease", "cutting-oil", "anti rust", "gearbox oil", "gear box oils", "aeroshell 555", "hydraulic fluid",
    "hydraulic oils", "engine oil", "gear oil", "crankcase oils", "portland cement", "slag cement", "cement clinker", "aluminous cements", "silicone sealant", "pro seal", "putties", "resin cement", "rtv 108", "wood glue",
    "loctite 243", "pva", "super glue", "wall filler", "garden chair",
)
_GUARDS = (
    "", "mineral", "petroleum based", "synthetic", "nyco", "sealant", "sealing compound", "in aerosol", "primer", "greaseproof", "for gearbox", "for the engine", "surfacing facade", "white", "emulsion", "25kg drum", "500 g",
    "bulk epoxy", "2,5 kg rubber", "caulk",
)
_NAMED = "CASE WHEN p_partkey % 2 = 0 THEN upper(tr) ELSE tr END || ' ' || gu || ' of ' || p_type"


def _pick(words: tuple[str, ...], at: str, array: str) -> str:
    return array.format(", ".join(f"'{w}'" for w in words), f"CAST({at} AS INT) + 1")


def _made(array: str, table: str) -> str:
    n = len(_TRIGGERS)
    return f"SELECT p_partkey, {_NAMED} AS d FROM (SELECT p_partkey, p_type, {_pick(_TRIGGERS, f'p_partkey % {n}', array)} AS tr, {_pick(_GUARDS, f'floor(p_partkey / {n}) % {len(_GUARDS)}', array)} AS gu FROM {table})"


_M = lambda pattern, x="t": f"regexp_matches({x}, '{pattern}')"
#: In firing order: the condition on the text in lower case, and the code by the text as given.
_OUTCOMES = {
    "bituminous_mastic_2715": (_M(r"\bbituminous mastics?\b|\basphalt (sealant|mastic|compound)s?\b|\bbitumen mastics?\b"), f"CASE WHEN {_M('(?i)mastic|seal', 'd')} THEN '2715.00.20' WHEN {_M('(?i)emulsion', 'd')} THEN '2715.00.10' ELSE '2715.00.90' END"),
    "mechanical_seal_8484": (_M(r"\b(mechanical|oil|shaft|bearing)\s+seals?\b") + " AND NOT " + _M("sealant|sealing compound|mastic|caulk"), "'8484.20.00'"),
    "oil_additive_3811": (_M(r"\b(fuel|gasoline|petrol|oil) additives?\b"), "'3811.90.00'"),
    "surface_coating_3403_19": (_M(r"\btectyl\b|\bardrox\s*av"), f"CASE WHEN {_M(r'\baerosol\b|\bspray\b')} THEN '3403.19.10' ELSE '3403.19.90' END"),
    "surface_coating_3403_99": (_M(r"\bcorban\b|\bcorrosion inhibitors?\b"), "'3403.99.90'"),
    "abrasive_6805": (_M(r"\bscotch\s*brite\b|\b(abrasive|scouring) pads?\b"), "'6805.30.00'"),
    "lubricant_3403": ("NOT contains(t, 'greaseproof') AND " + _M(r"\banti[- ]?seize\b|\bcopper\s*slip\b|\bmoly(bdenum)?\s+(paste|grease)\b|\bcutting[- ]?oils?\b|\bgreases?\b|\blubricants?\b|\banti[- ]?rust\b|\brust[- ]?prevent") + " AND NOT " + _M(r"\b(gearbox|engine|hydraulic)\b") + " AND NOT (" + _M(r"\banti[- ]?rust\b|\brust[- ]?prevent") + " AND " + _M(r"\bpaint|enamel|lacquer|primer\b") + ")",
        f"CASE WHEN {_M('(?i)petroleum|mineral oils?|oil[- ]?based', 'd')} THEN '3403.19' ELSE '3403.99' END || CASE WHEN {_M(r'(?i)\baerosol\b|\bspray\b', 'd')} THEN '.10' ELSE '.90' END"),
    "synthetic_gearbox_3403": (_M(r"\bgear\s*box\s+oils?\b|\baeroshell\b") + " AND NOT " + _M(r"\b(mineral|petroleum)\b"), "'3403.99.90'"),
    "mineral_hydraulic_2710": (_M(r"\bhydraulic\s+(oil|fluid)s?\b") + " AND " + _M(r"\b(mineral|petroleum)\b") + " AND NOT " + _M(r"\b(synthetic|nyco)\b"), "'2710.19.80'"),
    "synthetic_hydraulic_3403": (_M(r"\bhydraulic\s+(oil|fluid)s?\b"), "'3403.99.90'"),
    "petroleum_oil_2710": (_M(r"\b(engine|motor|gear|crankcase)\s+oils?\b") + " AND NOT " + _M(r"cutting[- ]?oil|gear\s*box"), "NULL"),
    "hydraulic_cement_2523": (_M(r"\b(portland|aluminous|hydraulic|slag)\s+cements?\b|\bcement clinkers?\b"), f"CASE WHEN {_M('clinker')} THEN '2523.10.00' WHEN {_M(r'\bwhite\b')} THEN '2523.21.00' WHEN {_M('aluminous')} THEN '2523.30.00' WHEN {_M('portland')} THEN '2523.29.00' ELSE '2523.90.00' END"),
    "mastic_3214": (_M(r"\b(sealants?|sealing compounds?|caulks?|mastics?|putties|putty|resin cements?|pro\s*seals?|rtv)\b"), f"CASE WHEN {_M('surfac|facade|skim coat|floor levell|rendering')} AND NOT {_M('seal|mastic|caulk|putty|resin cement')} THEN '3214.90.00' ELSE '3214.10.00' END"),
    "adhesive_3506": (_M(r"\b(glues?|adhesives?|superglue|loctite)\b|\bpva\b"), f"CASE WHEN NOT coalesce(mass > 1, {_M(r'\b(drum|bulk|pail|ibc|hobbock)\b')}) THEN '3506.10.00' WHEN {_M('polymer|pva|polyvinyl|polyurethane|epoxy|rubber|acrylic|plastic|resin')} THEN '3506.91.00' ELSE '3506.99.00' END"),
}
_SQL = f"""WITH m AS ({_made('list_element([{}], {})', 'part')}), x AS (SELECT p_partkey, d, lower(trim(regexp_replace(d, '\\s+', ' ', 'g'))) AS t, {_sql_mass('d')} AS mass FROM m),
r AS (SELECT *, CASE {' '.join(f"WHEN {fires} THEN '{name}'" for name, (fires, _) in _OUTCOMES.items())} END AS rule FROM x)
SELECT p_partkey, rule, CASE rule {' '.join(f"WHEN '{name}' THEN {code}" for name, (_, code) in _OUTCOMES.items())} END AS code FROM r"""


def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the code of names that put each trigger beside each guard: all fourteen rules, their guards, their order."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    df = spark.sql(_made("element_at(array({}), {})", "{part}"), part=part)
    df = df.withColumn("rule", rules.rule_id(F.col("d")))
    return df.select("p_partkey", "rule", rules.rule_columns(F.col("rule"), F.col("d"))["rule_code"].alias("code"))


QUERIES["rule_outcomes"], ORACLE["rule_outcomes"] = rule_outcomes, _SQL
