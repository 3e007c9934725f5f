"""Scalar text functions as column expressions.

Higher-order functions evaluate an outer expression for every element, so let() binds an intermediate result to a lambda
variable first.  Regular expressions that must know Unicode letters and spaces carry (?U).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count in a search, words that name the pack, and words that negate the next one.
STOPWORDS = (
    "the of and or for with from other including excluding whether not than per cent mass heading chapter into onto such "
    "only but its are was which that this these those under over more less non any all their without within between above "
    "below same being been have has had also compound compounds product products material materials preparation "
    "preparations kind thereof therein hereby where when each item line description qty quantity"
).split()
PACK_WORDS = "tin can drum pail bottle tube cartridge bag box set kit pack jar bucket carton".split()
NEGATORS = "not excluding except without non".split()
# Unit words that are no part numbers, and units that make a number a measure.
UNIT_WORDS = "kg kgs g gr mg ml l mm cm m ea each pcs pc set tin bag box unit units".split()
MEASURE_UNITS = "kg kgs g gr mg ml l mm cm m".split()
# Patterns.
WORD = r"[a-z0-9]+"
_NEGATOR = rf"(?:{'|'.join(NEGATORS)})(?![a-z0-9])[^a-z0-9]+"
COUNTING = rf"(?:{_NEGATOR})++[a-z0-9]++|[0-9]++(?![a-z])|[a-z0-9]{{1,2}}(?![a-z0-9])|([a-z0-9]++)"
WHETHER = r"(?<![a-z0-9])(whether[^a-z0-9]+or[^a-z0-9]+)not(?![a-z0-9])"
SPACE = r"(?U)[\s\x1c-\x1f]+"
MASS = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|kgs|kilograms?|g|gr|grams?|mg|milligrams?)\b"
CODE = r"(?<![A-Za-z\d])\d{4}[.\-]\d{2}(?:[.\-]\d{2})?(?!\d)"
DITTO = r"""(?i)(?:^|\s)(["“”″]|''|\bditto\b)(?:\s|$)"""
PART = r"^[A-Z0-9][A-Z0-9\-/_.]{1,24}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_of(token: Column, words: list[str]) -> Column:
    return token.isin(words)


def squash(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def norm(text: Column) -> Column:
    return F.lower(squash(text))


def strip_chars(text: Column, chars: str) -> Column:
    """Without these characters (written for a character class) at both ends."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def stem(token: Column) -> Column:
    """Light plural stemmer."""
    n = F.char_length(token)
    cut = lambda k: F.left(token, n - k)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & token.endswith("es") & token.rlike("(?:[sxz]es|ches|shes|oes)$"), cut(2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def tokenize(text: Column, drop_pack_words: bool = False) -> Column:
    """Stemmed words of a text, without stopwords, numbers, short words and words right after a negator ("whether or not"
    does not negate).

    One expression takes the text apart: negators with the word that they negate, numbers and short words are matched but
    not captured, so that only words that may count are touched one by one.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(lowered.contains("whether"), F.regexp_replace(lowered, WHETHER, "$1")).otherwise(lowered)
    words = F.filter(F.regexp_extract_all(plain, F.lit(COUNTING), F.lit(1)), lambda w: (w != "") & ~one_of(w, NEGATORS))
    gone = STOPWORDS + (PACK_WORDS if drop_pack_words else [])
    return F.filter(F.transform(words, stem), lambda t: ~one_of(t, gone) & (F.char_length(t) >= 3))


def token_set(text: Column, drop_pack_words: bool = False) -> Column:
    return F.array_distinct(tokenize(text, drop_pack_words))


def nearest_tokens(legal_path: Column) -> Column:
    """Token set of the last path segment that has tokens; empty without one."""
    sets = F.transform(F.reverse(F.split(F.coalesce(legal_path, F.lit("")), r"\|")), lambda part: token_set(part))
    return F.coalesce(F.get(F.filter(sets, lambda s: F.size(s) > 0), F.lit(0)), F.array().cast("array<string>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def format_code(value: Column) -> Column:
    """NNNN.NN.NN of 8 digits (6 get a tail of 00), else null."""
    d = digits(value)
    full = F.when(F.char_length(d) == 6, F.concat(d, F.lit("00"))).when(F.char_length(d) == 8, d)
    return F.concat(F.substring(full, 1, 4), F.lit("."), F.substring(full, 5, 2), F.lit("."), F.substring(full, 7, 2))


def format_heading(heading: Column) -> Column:
    d = F.lpad(digits(heading), 4, "0")  # keeps the first four of longer input
    return F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 2))


def schedule_date(raw: Column, unknown: str = "the current SARS Schedule 1 Part 1") -> Column:
    """An ISO date in words, other text as it is."""
    raw = F.coalesce(raw, F.lit(""))
    iso = (F.char_length(raw) == 10) & (F.substring(raw, 5, 1) == "-")
    spelled = F.when(iso, F.date_format(F.try_to_date(raw), "d MMMM yyyy"))
    return F.coalesce(spelled, F.when(raw != "", raw), F.lit(unknown))


def clip(text: Column, limit: int = 240) -> Column:
    """At most limit code points, cut at a word with an ellipsis."""
    return let(squash(text), lambda t: F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit - 1)), r"^(.+) [^ ]*$", "$1"), F.lit("…"))))


def clip_mid_word(text: Column, limit: int) -> Column:
    """At most limit code points, cut anywhere with an ellipsis."""
    return let(squash(F.coalesce(text, F.lit(""))), lambda t: F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))))


def sentence(text: Column) -> Column:
    return let(squash(text), lambda t: F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))


def number(value: Column) -> Column:
    """A quantity: commas separate thousands if they stand so, else decimals.  Null if it is no number."""
    text = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    thousands = text.rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$")
    plain = F.when(thousands, F.replace(text, F.lit(","), F.lit(""))).when(text.contains(",") & ~text.contains("."), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return let(plain, lambda t: F.when(t.rlike(r"^\d+(?:\.\d+)?$"), t.try_cast("double")))


def mass_kg(text: Column) -> Column:
    """The first stated mass in kilograms; a comma is a decimal sign.  Null without one."""
    value = F.replace(F.regexp_extract(text, MASS, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, MASS, 2))
    return F.when(unit.startswith("mg") | unit.startswith("milligram"), value / 1_000_000).when(unit.startswith("k"), value).when(unit != "", value / 1000.0)


def find_code(text: Column) -> Column:
    """The first plausible tariff code in a text, as NNNN.NN.NN."""

    def plausible(m: Column) -> Column:
        chapter = F.left(m, F.lit(2)).cast("int")
        return chapter.between(1, 97) & ~((F.char_length(m) == 7) & (F.substring(m, 6, 2) == "00"))

    first = F.get(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE), F.lit(0)), plausible), F.lit(0))
    return let(first, lambda m: F.concat(F.substring(m, 1, 4), F.lit("."), F.substring(m, 6, 2), F.lit("."), F.when(F.char_length(m) > 7, F.substring(m, 9, 2)).otherwise("00")))


def noted_code(text: Column) -> Column:
    """A written code, or a quote for a mark that repeats the one above."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.coalesce(find_code(text), F.when(padded.rlike(DITTO), F.lit('"')))


def words_of(text: Column) -> Column:
    """Between white space; of an empty text none."""
    return let(squash(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def valid_description(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[A-Za-z]{3,}")


def tidy_description(text: Column) -> Column:
    """Without leading marks and leading tokens that are short or look like numbers."""
    cleaned = F.trim(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"(?U)^[\W_]+", ""))

    def rest(tokens: Column) -> Column:
        good = lambda t: t.rlike("[A-Za-z]{3,}") & (~t.rlike(r"\d") | t.rlike("[A-Za-z]{4,}"))
        first = F.array_position(F.transform(tokens, good), F.lit(True))
        return F.when(first > 0, F.array_join(F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.size(tokens) + 1), " ")).otherwise("")

    return strip_chars(let(words_of(cleaned), rest), " \\-")


def looks_like_part(token: Column) -> Column:
    return F.upper(token).rlike(PART) & ~one_of(F.lower(token), UNIT_WORDS) & token.rlike(r"[\d\-/_]")


def take_part(tokens: Column) -> Column:
    """struct(part, rest): the first token, or the first two if the second continues it, if that looks like a part."""

    def split(t: Column) -> Column:
        first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
        from_ = lambda k: F.slice(t, F.lit(k + 1), F.size(t) + 1)
        joined = F.coalesce(second.startswith("-") & looks_like_part(F.concat(first, second)), F.lit(False))
        alone = F.coalesce(looks_like_part(first), F.lit(False))
        none = F.lit(None).cast("string")
        return F.struct(F.when(joined, F.upper(F.concat(first, second))).when(alone, F.upper(first)).otherwise(none).alias("part"), F.when(joined, from_(2)).when(alone, from_(1)).otherwise(t).alias("rest"))

    return let(tokens, split)


def letter_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def enough_text(text: Column, least: int = 40) -> Column:
    return letter_count(text) >= least
