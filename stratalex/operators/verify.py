"""Reasons of a classification, checks of written codes, and their explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import clip, digits, format_code, format_heading, sentence
from stratalex.operators.corpus import Corpus

# The rules cited and the wordings of results.
GRI_1 = "GRI 1: classification is determined by the terms of the headings and the relative Section or Chapter Notes."
GRI_3A = "GRI 3(a): the heading or subheading with the more specific description is preferred to one with a general description."
GRI_6 = "GRI 6: GRI 1 to 5 apply at subheading level within the chosen heading."
NO_DESCRIPTION = "No product description was supplied, so no tariff line was selected."
NO_LINE = "No declarable tariff line in the local SARS Schedule 1 Part 1 index matched this description. Add a clearer commercial description before relying on a code."
INDICATIVE = "Indicative classification — confirm the heading terms before lodging a customs declaration. "
COSMETICS = f"{GRI_1} Chapter 33 covers beauty, make-up and skin-care preparations. That heading does not cover these goods."
OTHER_LINE = f" {GRI_3A} The invoice does not use a more specific subheading phrase, so the residual subheading in this heading is selected."


def said(template: str, **parts: Column | str) -> Column:
    """The template with {names} replaced; null if a part is null."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), part if isinstance(part, Column) else F.lit(part))
    return out


def rule_reason(template: Column, date: str) -> Column:
    """A rule's reason for the chosen line (hs_code, duty_general)."""
    out = F.replace(template, F.lit("{hs_code}"), F.col("hs_code"))
    return F.replace(F.replace(out, F.lit("{duty}"), F.col("duty_general")), F.lit("{schedule}"), F.lit(date))


def search_reason(indicative: Column, date: str) -> Column:
    """The reason for a line (hs_code, heading, heading_text, legal_path, line_description, duty_general) that search found."""
    excerpt = clip(F.coalesce(F.when(F.col("heading_text") != "", F.col("heading_text")), F.col("legal_path")))
    plain = F.regexp_replace(F.lower("line_description"), "^[ :]+|[ :]+$", "")
    specific = F.when((F.col("line_description") != "") & (plain != "other"), said(f' {GRI_3A} {GRI_6} Subheading wording "{{words}}" is preferred to a residual Other provision.', words=clip(F.col("line_description"), 180))).otherwise(OTHER_LINE)
    body = said(f"Classified under {{code}}. {GRI_1} Heading {{heading}} covers: {{excerpt}}.{{specific}} General duty: {{duty}} (SARS Schedule 1 Part 1, {date}).", code=F.col("hs_code"), heading=format_heading(F.col("heading")), duty=F.col("duty_general"), excerpt=excerpt, specific=specific)
    return F.concat(F.when(indicative, INDICATIVE).otherwise(""), body)


def flag(written: Column, checked: Column, declared: Column) -> Column:
    """The ordered check of a written code: empty, ok, critical (cosmetics) or incorrect."""
    checked = F.coalesce(checked, F.lit(""))
    return F.when(F.coalesce(written, F.lit("")) == "", "").when(written == checked, "ok").when(written.startswith("33") & ~checked.startswith("33"), "critical").otherwise("incorrect")


def flag_note(flag_: Column, written: Column, checked: Column, declared: Column, ditto: Column) -> Column:
    checked = F.coalesce(checked, F.lit(""))
    carried = F.when(ditto, " The quote repeats the line above.").otherwise("")
    return (
        F.when(flag_ == "", "")
        .when(flag_ == "ok", "Handwritten code matches.")
        .when(flag_ == "critical", F.concat(F.lit("Handwritten "), written, F.lit(" is Chapter 33, cosmetics and skincare. These goods are "), checked, F.lit(".")))
        .when(~declared, F.concat(F.lit("Handwritten "), written, F.lit(" is not a declarable code on this schedule.")))
        .otherwise(F.concat(F.lit("Handwritten "), written, F.lit(" does not match "), checked, F.lit("."), carried))
    )


def schedule_wording(codes: DataFrame, corpus: Corpus, code: str = "code") -> DataFrame:
    """codes(code), distinct -> (code, formatted, code_heading, wording): the schedule's words for a written code.

    Wordings of 5, 6 and 8 digits come by one equi-join on (heading, digits).
    """
    known = codes.select(code, format_code(F.col(code)).alias("formatted")).join(corpus.leaves.select(F.col("hs_code").alias("formatted"), "heading", "legal_path"), "formatted", "left").join(corpus.headings, "heading", "left")
    words = F.regexp_replace(clip(F.coalesce(F.when(F.col("heading_text") != "", F.col("heading_text")), F.col("legal_path")), 220), ":+$", "")
    known = known.select(code, "formatted", "heading", words.alias("heading_words"), digits(F.col(code)).alias("d"))
    cuts = known.filter(F.col("heading").isNotNull()).select(code, "heading", F.explode(F.array(*map(F.lit, (5, 6, 8)))).alias("n"), "d").withColumn("digits", F.expr("left(d, n)"))
    found = cuts.join(corpus.wording, ["heading", "digits"]).groupBy(code).agg(F.sort_array(F.collect_list(F.struct("n", "wording"))).alias("found"))  # three at most
    df = known.join(found, code, "left")
    bare = lambda t: F.regexp_replace(t, ":+$", "")
    usable = F.filter("found", lambda x: (x["wording"] != "") & (bare(F.lower(x["wording"])) != "other") & (bare(x["wording"]) != F.col("heading_words")))
    splits = F.array_distinct(F.transform(usable, lambda x: bare(x["wording"])))
    detail = F.when(F.coalesce(F.size(splits), F.lit(0)) > 0, F.concat(F.lit(" The schedule split reads: "), F.array_join(F.transform(splits, lambda s: clip(s, 160)), "; "), F.lit("."))).otherwise(" This is the residual subheading of that heading.")
    here = F.concat(F.col(code), F.lit(" falls in heading "), format_heading(F.col("heading")), F.lit(": "), F.col("heading_words"), F.lit("."), detail)
    absent = F.concat(F.col(code), F.lit(" is not a declarable 8-digit line in this SARS Schedule 1 Part 1."))
    return df.select(code, F.col("heading").alias("code_heading"), F.when(F.col("heading").isNull(), absent).otherwise(here).alias("wording"))


def check_written(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """rows with hs_code, noted_code, same_as_above, rule_review and wco_reasoning -> rows with the check's columns."""
    written, checked = F.nullif(F.col("noted_code"), F.lit("")), F.coalesce("hs_code", F.lit(""))
    df = rows.withColumns({"written": written, "checked": checked})
    codes = df.select(F.explode(F.array("written", "checked")).alias("code")).filter("code is not null and code <> ''").distinct()
    words = schedule_wording(codes, corpus)
    side = lambda name: words.select(F.col("code").alias(name), F.col("code_heading").alias(f"{name}_heading"), F.col("wording").alias(f"{name}_wording"))
    df = df.join(side("written"), "written", "left").join(side("checked"), "checked", "left")
    declared = F.col("written_heading").isNotNull()
    df = df.withColumn("flag", flag(F.col("written"), F.col("checked"), declared))
    df = df.withColumn("flag_note", flag_note(F.col("flag"), F.col("written"), F.col("checked"), declared, F.col("same_as_above")))
    same_heading = F.coalesce(F.col("written_heading") == F.col("checked_heading"), F.lit(False))
    none = F.lit(None).cast("string")
    other = said(f"Written {{w}} is another subheading of heading {{h}}. {GRI_1} {GRI_3A} {GRI_6} {{c}} is the subheading whose terms describe these goods.", w=F.col("written"), h=format_heading(F.col("written_heading")), c=F.col("checked"))
    judged = F.when(F.col("flag") == "critical", COSMETICS).when(declared & (F.col("checked") != ""), said(f"{GRI_1} {GRI_3A} The written heading does not describe these goods. {{c}} is the line whose terms do.", c=F.col("checked")))
    on_written = F.when(F.col("written").isNull(), none).when(F.col("written") == F.col("checked"), "The handwritten code is that same 8-digit line. No change.").when(same_heading, other).otherwise(F.concat_ws(" ", F.concat(F.lit("Written line. "), F.col("written_wording")), judged))
    explanation = F.concat_ws(
        " ",
        F.lit(f"Classified under the WCO Harmonized System as applied in SARS Schedule 1 Part 1 ({corpus.date})."),
        F.when(F.trim("rule_review") != "", sentence(F.col("rule_review"))),
        F.when(F.col("checked") != "", F.concat(F.lit("Recommended line. "), F.col("checked_wording"))),
        on_written,
    )
    df = df.withColumn("explanation", explanation)
    shown = F.when(F.col("same_as_above") & F.col("written").isNotNull(), F.concat("written", F.lit(' "'))).otherwise(F.coalesce("written", F.lit("")))
    return df.withColumns(
        {
            "handwritten": F.coalesce("written", F.lit("")),
            "handwritten_shown": shown,
            "hs_shown": F.col("checked"),
            "recommended_label": F.when(F.col("flag") == "ok", F.concat("checked", F.lit(" · No change"))).otherwise(F.col("checked")),
            "wco_reasoning": F.when(F.col("flag").isin("incorrect", "critical"), F.concat_ws(" ", "flag_note", "explanation")).otherwise(F.col("wco_reasoning")),
        }
    ).drop("written", "checked", "written_heading", "checked_heading", "written_wording", "checked_wording")


def amend(rows: DataFrame, edits: DataFrame, corpus: Corpus, keys: tuple[str, ...] = ("source_file", "line_number")) -> DataFrame:
    """rows with the codes of edits(keys, code) in place of theirs.

    Adds amended and error (a line whose code is not one of 8 digits); a code of the corpus brings its duty, another
    keeps the old one.
    """
    df = rows.join(edits.select(*keys, F.col("code").alias("_edit")), list(keys), "left")
    df = df.withColumn("_new", format_code(F.coalesce(F.nullif("_edit", F.lit("")), "hs_code")))
    duty = corpus.leaves.select(F.col("hs_code").alias("_new"), F.col("duty_general").alias("_duty"))
    df = df.join(duty, "_new", "left")
    wrong = F.when(F.col("_new").isNull(), F.concat(F.lit("Enter an 8-digit HS code for "), F.coalesce(F.nullif("description", F.lit("")), F.lit("each line")), F.lit(".")))
    return df.withColumns({"amended": F.coalesce(F.col("_new") != F.coalesce("hs_code", F.lit("")), F.lit(False)), "error": wrong, "hs_code": F.coalesce("_new", "hs_code"), "recommended_label": F.coalesce("_new", "recommended_label"), "duty_rate_general": F.coalesce("_duty", "duty_rate_general")}).drop("_edit", "_new", "_duty")
