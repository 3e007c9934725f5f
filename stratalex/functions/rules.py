"""Ordered keyword rules: the first that fires decides the heading.

RULES is a table in firing order.  match() folds it into one CASE per result column; nothing is evaluated twice by
hand, Catalyst shares what is common.  Triggers see the text in lower case with single spaces; choices within a heading
see the text as given, without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalex.functions.text import mass_kg, norm

# ---------------------------------------------------------------------------------------------------------------------
# Patterns, codes and wordings, as classification results must state them.
# ---------------------------------------------------------------------------------------------------------------------
DUTY = " General duty: {duty} (SARS Schedule 1 Part 1, {schedule})."

BITUMINOUS = r"\bbituminous mastics?\b|\basphalt (?:sealants?|mastics?|compounds?)\b|\bbitumen mastics?\b"
SEAL = r"\b(?:mechanical|oil|shaft|bearing)\s+seals?\b"
NOT_SEAL = r"sealant|sealing compound|mastic|caulk"
ADDITIVE = r"\b(?:fuel|gasoline|petrol)\s+additives?\b|\boil additives?\b"
COATING_PETROLEUM = r"\btectyl\b|\bardrox\s*av"
COATING = r"\bcorban\b|\bcorrosion inhibitors?\b"
ABRASIVE = r"\bscotch\s*brite\b|\babrasive pads?\b|\bscouring pads?\b"
LUBRICANT = (
    r"\banti[-\s]?seize\b|\bcopper\s*slip\b|\bmoly(?:bdenum)?\s+(?:paste|grease)\b|\bthread lubricants?\b|"
    r"\bfriction reduc(?:er|ing|tion)\b|\bcutting[-\s]?oils?\b|\blithium greases?\b|\bbearing greases?\b|"
    r"\b(?:lubricating|multipurpose)\s+greases?\b|\bgreases?\b|\blubricants?\b|\banti[-\s]?rust\b|\brust[-\s]?prevent"
)
NOT_LUBRICANT = r"\b(?:gearbox|engine|hydraulic)\b"
ANTI_RUST = r"\banti[-\s]?rust\b|\brust[-\s]?prevent"
PAINT = r"\bpaint|enamel|lacquer|primer\b"
GEARBOX = r"\b(?:gearbox|gear\s*box)\s+oils?\b|\baeroshell\b"
MINERAL = r"\bmineral\b|\bpetroleum\b"
HYDRAULIC = r"\bhydraulic\s+(?:oils?|fluids?)\b"
SYNTHETIC = r"\bsynthetic\b|\bnyco\b"
ENGINE_OIL = r"\b(?:engine|motor|gear|crankcase)\s+oils?\b"
NOT_ENGINE_OIL = r"cutting[-\s]?oil|gearbox|gear\s*box"
CEMENT = r"\b(?:portland|aluminous|hydraulic|slag)\s+cements?\b|\bcement clinkers?\b"
MASTIC = (
    r"\b(?:sealants?|sealing compounds?|caulks?|caulking(?:\s+compounds?)?|mastics?|putties|putty|glaziers?'?\s+putty|"
    r"resin cements?|painters?'?\s+fillings?|silicone sealants?|pro\s*seals?|rtv)\b"
)
ADHESIVE = r"\b(?:glues?|adhesives?|superglue|super glue|cyanoacrylates?|wood glues?|contact adhesives?|loctite)\b|\bpva\b"
AEROSOL = r"\baerosol\b|\bspray\b"
PETROLEUM = r"petroleum|mineral oils?|oil[-\s]?based"
SURFACING = r"surfac|facade|skim coat|floor levell|rendering"
MASTIC_WORDS = r"seal|mastic|caulk|putty|resin cement"
BULK = r"\b(drum|bulk|pail|ibc|hobbock)\b"
POLYMER = r"polymer|pva|polyvinyl|polyurethane|epoxy|rubber|acrylic|cyanoacrylate|plastic|resin"

REASONS = {
    "bituminous_mastic_2715": "Classified under {hs_code} as a bituminous mastic. GRI 1 and Chapter 32 Note 1(c): mastics of asphalt or other bituminous mastics are excluded from Chapter 32 and fall in heading 27.15.",
    "mechanical_seal_8484": "Classified under {hs_code} as a mechanical seal. GRI 1: heading 84.84 covers mechanical seals. An oil seal or shaft seal is an article of machinery, not a chemical mastic of heading 32.14.",
    "oil_additive_3811": "Classified under {hs_code} as a prepared additive for mineral oils. GRI 1: heading 38.11 covers anti-knock preparations, oxidation inhibitors and other prepared additives for mineral oils or for other liquids used for the same purposes.",
    "surface_coating_3403_19": "Classified under {hs_code} as a petroleum-based anti-corrosion preparation. GRI 1: heading 34.03 covers anti-rust and anti-corrosion preparations. Heading 38.11 is for additives put into fuel or oil, not a coating applied to a surface. Subheading 3403.19 is the petroleum-oil split.",
    "surface_coating_3403_99": "Classified under {hs_code} as a surface anti-corrosion preparation. GRI 1: heading 34.03 covers anti-rust and anti-corrosion preparations. Heading 38.11 is limited to additives for mineral oils and similar liquids, not a compound applied to a metal surface.",
    "abrasive_6805": "Classified under {hs_code} as abrasive powder or grain on a base. GRI 1: heading 68.05 covers natural or artificial abrasive on a base of textile, paper or other materials. A nylon scouring pad is on a base of other materials, so subheading 6805.30 applies.",
    "lubricant_3403": "Classified under {hs_code} as a lubricating preparation. GRI 1: heading 34.03 covers lubricating preparations, including cutting-oil preparations, bolt or nut release preparations, anti-rust preparations and mould-release preparations. Anti-seize and other friction reducers are bolt-release preparations; they are not mastics of heading 32.14. GRI 3(a) prefers this specific lubricating-preparation wording over a general sealant category. {split}",
    "synthetic_gearbox_3403": "Classified under {hs_code} as a synthetic lubricating preparation. GRI 1: heading 34.03 covers lubricating preparations other than those based on petroleum oils. A synthetic gearbox oil is not a cosmetic of heading 33.04 and is not a petroleum oil of heading 27.10.",
    "mineral_hydraulic_2710": "Classified under {hs_code} as a petroleum hydraulic fluid. GRI 1: heading 27.10 covers petroleum oils. Mineral-oil hydraulic transmission fluids are named in subheading 2710.19.",
    "synthetic_hydraulic_3403": "Classified under {hs_code} as a synthetic lubricating preparation. GRI 1: heading 34.03 covers lubricating preparations that are not 70 per cent or more petroleum oil. A synthetic aviation hydraulic fluid is not a cosmetic of heading 33.04.",
    "petroleum_oil_2710": "Classified under {hs_code} as a petroleum oil. GRI 1: heading 34.03 excludes preparations whose basic constituents are 70 per cent or more by mass of petroleum oils. Engine and motor oils of that kind fall in heading 27.10.",
    "hydraulic_cement_2523": "Classified under {hs_code} as a hydraulic cement. GRI 1: heading 25.23 covers Portland cement, aluminous cement and similar hydraulic cements. This is not a resin cement or mastic of heading 32.14.",
    "mastic_3214": "Classified under {hs_code} as a mastic or sealing compound. GRI 1: heading 32.14 covers glaziers' putty, grafting putty, resin cements, caulking compounds and other mastics, and painters' fillings. Subheading 3214.10 names those goods; residual subheading 3214.90 is for other surfacing preparations, so GRI 3(a) selects 3214.10. Chapter 32 Note 1(c) sends bituminous mastics to heading 27.15, and this description is not bituminous.",
    "adhesive_3506": "Classified under {hs_code} as a prepared glue or adhesive. GRI 1: heading 35.06 covers prepared glues and other prepared adhesives, including products put up for retail sale as glues not exceeding a net mass of 1 kg. {split}",
}
SURFACING_REASON = "Classified under {hs_code} as a non-refractory surfacing preparation. GRI 1: heading 32.14 covers mastics and non-refractory surfacing preparations for facades, walls, floors and ceilings. The goods are not described as putty, caulk or mastic, so residual subheading 3214.90 applies (GRI 3(a))."
LUBRICANT_SPLITS = (
    "The description names petroleum or mineral oil, so the split for preparations containing petroleum oils (3403.1) applies.",
    "The invoice does not state that petroleum oils are the basic constituent, so the residual lubricating-preparation split 3403.99 applies.",
)
ADHESIVE_SPLITS = {
    "mass": "The stated pack mass is {mass} kg, which does not exceed 1 kg.",
    "unknown": "No pack above 1 kg is stated, so the retail put-up of subheading 3506.10 is applied.",
    "3506.91.00": "The pack exceeds 1 kg and the adhesive is polymer or rubber based, so subheading 3506.91 applies rather than the retail subheading 3506.10.",
    "3506.99.00": "The pack exceeds 1 kg, so the goods are outside the retail subheading 3506.10 and fall in residual subheading 3506.99.",
}
REVIEWS = {
    "oil_additive_3811": "3811.90 is for fuel and oil additives. This description is that kind of additive.",
    "surface_coating_3403_19": "3811.90 is for fuel and oil additives. This is a surface anti-corrosion coating, so 3403.19 applies when it is petroleum-based.",
    "surface_coating_3403_99": "Reclassified from fuel additives (3811.90) to a surface anti-corrosion preparation under 3403.99.",
    "abrasive_6805": "Abrasive powder on a non-woven or synthetic base is 6805.30.",
    "lubricant_3403": "Anti-seize and dry-film or synthetic lubricants are 3403.99, not sealants or surfacing preparations of 3214.90.",
    "synthetic_gearbox_3403": "Synthetic gearbox lubricating oil is 3403.99. Heading 3304 is cosmetics and skincare, and heading 27.10 is for petroleum oils.",
    "mineral_hydraulic_2710": "Mineral-oil hydraulic fluid is 2710.19. Synthetic hydraulic fluid is 3403.99.",
    "synthetic_hydraulic_3403": "Synthetic hydraulic fluid is 3403.99. Mineral-oil hydraulic fluid is 2710.19. Heading 3304 is cosmetics and cannot apply.",
    "petroleum_oil_2710": "Engine and motor oils that are petroleum oils fall in heading 27.10.",
    "mastic_3214": "Mastics, sealants and caulking compounds are 3214.10. 3214.90 is only for non-refractory wall and facade surfacing preparations.",
    "adhesive_3506": "Adhesives and glues put up for retail sale at 1 kg or less are 3506.10.",
}
#: Wording that the tariff uses for commercial names: (all these patterns, what is added).
EXPANSIONS = (
    ((r"\blaptops?\b|\bnotebook computers?\b",), "portable automatic data processing machine"),
    ((r"\bt-?shirts?\b",), "t-shirt singlet knitted vest"),
    ((r"\bhex(?:agon)?(?:agonal)?\b", r"\b(?:screw|bolt)s?\b"), "hexagon head screw bolt threaded stainless"),
    ((r"\broasted\b", r"\bcoffee\b"), "coffee roasted"),
    ((r"\bbeer\b",), "beer made from malt"),
)
# ---------------------------------------------------------------------------------------------------------------------


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _any_case(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _code_3403(d: Column) -> Column:
    tail = F.when(_any_case(d, AEROSOL), ".10").otherwise(".90")
    return F.concat(F.when(_any_case(d, PETROLEUM), "3403.19").otherwise("3403.99"), tail)


def _code_3214(d: Column) -> Column:
    return F.when(_any_case(d, SURFACING) & ~_any_case(d, MASTIC_WORDS), "3214.90.00").otherwise("3214.10.00")


def _code_3506(d: Column) -> Column:
    mass = mass_kg(d)
    bulk = F.when(mass.isNotNull(), mass > 1).otherwise(_any_case(d, BULK))
    return F.when(~bulk, "3506.10.00").when(_any_case(d, POLYMER), "3506.91.00").otherwise("3506.99.00")


def _code_2715(d: Column) -> Column:
    return F.when(_any_case(d, "mastic|seal"), "2715.00.20").when(_any_case(d, "emulsion"), "2715.00.10").otherwise("2715.00.90")


def _code_2523(d: Column) -> Column:
    kinds = (("clinker", "2523.10.00"), (r"\bwhite\b", "2523.21.00"), ("aluminous", "2523.30.00"), ("portland", "2523.29.00"))
    out = F.lit("2523.90.00")
    for pattern, code in reversed(kinds):
        out = F.when(_any_case(d, pattern), code).otherwise(out)
    return out


def _short(mass: Column) -> Column:
    """A mass without needless zeros."""
    return F.regexp_replace(F.format_number(mass, 6), r"\.?0+$", "")


def _split_3506(d: Column) -> Column:
    code, mass = _code_3506(d), mass_kg(d)
    retail = F.when(mass.isNotNull(), F.replace(F.lit(ADHESIVE_SPLITS["mass"]), F.lit("{mass}"), _short(mass))).otherwise(ADHESIVE_SPLITS["unknown"])
    return F.when(code == "3506.10.00", retail).when(code == "3506.91.00", ADHESIVE_SPLITS["3506.91.00"]).otherwise(ADHESIVE_SPLITS["3506.99.00"])


@dataclass(frozen=True)
class Rule:
    """fires(text) over the normalised text; code and detail over the description as given (None: rank in the heading)."""

    name: str
    heading: str
    fires: Callable[[Column], Column]
    code: Callable[[Column], Column] | None
    detail: Callable[[Column], Column] | None = None
    reason: Callable[[Column], Column] | None = None
    #: Parts of words of which a text that fires has one at least; none: not known.
    stems: tuple[str, ...] = ()


def _const(code: str) -> Callable[[Column], Column]:
    return lambda d: F.lit(code)


RULES = (
    Rule("bituminous_mastic_2715", "2715", lambda t: _has(t, BITUMINOUS), _code_2715, stems=("bitum", "asphalt")),
    Rule("mechanical_seal_8484", "8484", lambda t: _has(t, SEAL) & ~_has(t, NOT_SEAL), _const("8484.20.00"), stems=("seal",)),
    Rule("oil_additive_3811", "3811", lambda t: _has(t, ADDITIVE), _const("3811.90.00"), stems=("additive",)),
    Rule("surface_coating_3403_19", "3403", lambda t: _has(t, COATING_PETROLEUM), lambda d: F.when(_has(norm(d), AEROSOL), "3403.19.10").otherwise("3403.19.90"), stems=("tectyl", "ardrox")),
    Rule("surface_coating_3403_99", "3403", lambda t: _has(t, COATING), _const("3403.99.90"), stems=("corban", "corrosion")),
    Rule("abrasive_6805", "6805", lambda t: _has(t, ABRASIVE), _const("6805.30.00"), stems=("brite", "pad")),
    Rule(
        "lubricant_3403",
        "3403",
        lambda t: ~t.contains("greaseproof") & _has(t, LUBRICANT) & ~_has(t, NOT_LUBRICANT) & ~(_has(t, ANTI_RUST) & _has(t, PAINT)),
        _code_3403,
        lambda d: F.when(_has(norm(d), PETROLEUM), LUBRICANT_SPLITS[0]).otherwise(LUBRICANT_SPLITS[1]),
        stems=("seize", "slip", "moly", "lubric", "friction", "cutting", "greas", "rust"),
    ),
    Rule("synthetic_gearbox_3403", "3403", lambda t: _has(t, GEARBOX) & ~_has(t, MINERAL), _const("3403.99.90"), stems=("gear", "aeroshell")),
    Rule("mineral_hydraulic_2710", "2710", lambda t: _has(t, HYDRAULIC) & _has(t, MINERAL) & ~_has(t, SYNTHETIC), _const("2710.19.80"), stems=("hydraulic",)),
    Rule("synthetic_hydraulic_3403", "3403", lambda t: _has(t, HYDRAULIC), _const("3403.99.90"), stems=("hydraulic",)),
    Rule("petroleum_oil_2710", "2710", lambda t: _has(t, ENGINE_OIL) & ~_has(t, NOT_ENGINE_OIL), None, stems=("oil",)),
    Rule("hydraulic_cement_2523", "2523", lambda t: _has(t, CEMENT), _code_2523, stems=("cement",)),
    Rule("mastic_3214", "3214", lambda t: _has(t, MASTIC), _code_3214, reason=lambda d: F.when(_code_3214(d) == "3214.90.00", SURFACING_REASON).otherwise(REASONS["mastic_3214"]), stems=("seal", "caulk", "mastic", "putt", "cement", "filling", "rtv")),
    Rule("adhesive_3506", "3506", lambda t: _has(t, ADHESIVE), _code_3506, _split_3506, stems=("glue", "adhesive", "cyano", "loctite", "pva")),
)


def _first(rules: tuple[Rule, ...], name: Column, value: Callable[[Rule], Column]) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(name == rule.name, value(rule)).otherwise(out)
    return out


def rule_id(description: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the first rule that fires; null if none does.

    One pass over the stems of all rules tells most texts apart that none will fire on; only the others meet the rules.
    """
    text = norm(F.coalesce(description, F.lit("")))
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fires(text), rule.name).otherwise(out)
    if all(rule.stems for rule in rules):
        out = F.when(text.rlike("|".join(sorted({x for rule in rules for x in rule.stems}))), out)
    return out


def rule_columns(name: Column, description: Column, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """heading, preferred code, reason template and review of a rule that rule_id() gave."""
    none = F.lit(None).cast("string")

    def reason(rule: Rule) -> Column:
        text = rule.reason(description) if rule.reason else F.lit(REASONS[rule.name])
        if rule.detail:
            text = F.replace(text, F.lit("{split}"), rule.detail(description))
        return F.concat(text, F.lit(DUTY))

    return {
        "rule_heading": _first(rules, name, lambda r: F.lit(r.heading)),
        "rule_code": _first(rules, name, lambda r: r.code(description) if r.code else none),
        "rule_reason": _first(rules, name, reason),
        "rule_review": F.coalesce(_first(rules, name, lambda r: F.lit(REVIEWS.get(r.name, ""))), F.lit("")),
    }


def expand_query(description: Column) -> Column:
    """The description, with the tariff's wording added for some commercial names."""
    text = F.lower(description)
    extras = []
    for patterns, words in EXPANSIONS:
        fires = _has(text, patterns[0])
        for p in patterns[1:]:
            fires = fires & _has(text, p)
        extras.append(F.when(fires, words))
    return F.concat_ws(" ", description, *extras)
