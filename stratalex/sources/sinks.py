"""Results out: public columns, JSON, CSV, the tariff tables, report rows and seals."""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import clip_mid_word
from stratalex.schemas import PUBLIC_FIELDS
from stratalex.storage import discard, materialise

#: Description limits of a report by its number of rows, and the words for flags.
LIMITS = ((8, 88), (14, 70), (None, 56))
MARKS = {"critical": "Critical", "incorrect": "Incorrect", "ok": "Correct"}


def public(rows: DataFrame) -> DataFrame:
    return rows.select(*PUBLIC_FIELDS)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; fields without a value are kept as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_array(rows: DataFrame, most: int = 10_000) -> str:
    """A small result as one pretty array (at most `most` rows, else an error: write_json() is for large ones)."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write them with write_json()")
    tidy = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return json.dumps([{k: tidy(v) for k, v in r.asDict(recursive=True).items()} for r in got], indent=2, ensure_ascii=False)


def csv_columns(rows: DataFrame) -> DataFrame:
    """The public columns as text: null is empty, whole quantities have no fraction."""
    q = F.col("quantity").cast("double")
    whole = F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string"))
    return rows.select(*(F.coalesce(whole if c == "quantity" else F.col(c).cast("string"), F.lit("")).alias(c) for c in PUBLIC_FIELDS))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_columns(rows).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def emit(rows: DataFrame, path: str, form: str = "json") -> None:
    """json, csv, or both as siblings of the path."""
    if form not in ("json", "csv", "both"):
        raise ValueError(form)
    stem = path.rsplit(".", 1)[0] if path.endswith((".json", ".csv")) else path
    if form == "both":
        rows = materialise(rows, "emitted")
    if form != "csv":
        write_json(rows, path if form == "json" else f"{stem}.json")
    if form != "json":
        write_csv(rows, path if form == "csv" else f"{stem}.csv")
    if form == "both":
        discard(rows)


def write_tariff(tariff: DataFrame, chapters: DataFrame, metadata: DataFrame, path: str, only: list[str] | None = None) -> None:
    """only: of the lines these chapters alone are replaced."""
    if only is None:
        tariff.write.mode("overwrite").partitionBy("chapter").parquet(f"{path}/tariff_lines")
    else:
        tariff.filter(F.col("chapter").isin(only)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chapter").parquet(f"{path}/tariff_lines")
    chapters.write.mode("overwrite").parquet(f"{path}/chapters")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def note(flag: Column, amended: Column, duty: Column) -> Column:
    """Mark, Amended and duty, as far as they are, joined by a dot."""
    mark = F.lit(None).cast("string")
    for name, word in MARKS.items():
        mark = F.when(flag == name, word).otherwise(mark)
    return F.concat_ws(" · ", mark, F.when(amended, "Amended"), F.nullif(duty, F.lit("")))


def report_rows(rows: DataFrame, n_rows: int, amended: str = "amended") -> DataFrame:
    """rows with their report description (clipped by the report's length) and note."""
    limit = next(cut for upto, cut in LIMITS if upto is None or max(n_rows, 1) <= upto)
    was = F.col(amended) if amended in rows.columns else F.lit(False)
    return rows.withColumns({"report_description": clip_mid_word(F.col("description"), limit), "note": note(F.col("flag"), was, F.col("duty_rate_general"))})


def flagged(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("flag").isin("incorrect", "critical")).alias("flagged"))


def seal(rows: DataFrame, author: str, source: str, authorisers: list[str]) -> tuple[str, DataFrame]:
    """A seal's token and its record, as in schemas.SEALS: append it to a table.  Only listed authors may seal.

    A sealed report is one document; its lines make one array.
    """
    if author not in authorisers:
        raise ValueError("this author may not seal")
    token = secrets.token_urlsafe(9)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    was = F.coalesce("amended", F.lit(False)) if "amended" in rows.columns else F.lit(False)
    line = F.struct(F.col("line_number").alias("n"), text("description"), text("hs_code"), text("flag"), was.alias("amended"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: F.struct(x["description"], x["hs_code"], x["flag"], x["amended"]))
    record = rows.agg(lines.alias("lines")).select(F.lit(token).alias("seal"), F.lit(author).alias("author"), F.current_timestamp().alias("checked_at"), F.lit(source).alias("source"), "lines")
    return token, record


def verify_seal(seals: DataFrame, token: str) -> DataFrame:
    """The record of a seal; no row if it is unknown."""
    return seals.filter(F.col("seal") == token)
