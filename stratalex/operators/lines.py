"""Product lines out of document text and tables.

A document becomes rows (doc, pos, line).  Row-local parsing is one struct expression per strategy; what depends on
other rows of the document (header above, where to stop, dittos, repeats) is a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions import text as t
from stratalex.functions.text import let, norm, squash, strip_chars
from stratalex.operators.containment import without_contained
from stratalex.operators.windows import by_precedence, fill_dittos, first_wins
from stratalex.storage import materialise

# What headers and lines to skip look like.
HEADER_KEYS = ("description", "qty", "quantity", "part no", "part number", "part nr", "sku", "serial")
SKIP = (
    r"(?iU)(^date\b|^page\b|^tel\b|^fax\b|^attn\b)|\b(subtotal|grand total|^total\b|vat\b|tax invoice|invoice no|"
    r"invoice number|bill to|ship to|sold to|customer|supplier|telephone|phone|email|e-mail|swift|iban|bank|page \d|"
    r"pty\b|ltd\b|limited|street|avenue|road|p\.?o\.? box|commercial invoice|tax invoice|amount due|balance due|currency|"
    r"payment terms|incoterms?|delivery address)\b"
)
DESCRIPTION_LABEL = r"(?i)\b(description|line description|goods description|item description)\b"
HEADER_WORDS = r"(?i)\b(part|qty|quantity|serial|price|sku)\b"
BARE_HEADER = r"(?i)^(item |line |goods |product )?descriptions?$"
COLUMNS = {
    "part": r"(?i)\b(part\s*(?:no\.?|number|#|nr|num)?|sku|item\s*code|product\s*code)\b",
    "description": r"(?i)\b(description|goods|line\s*description)\b",
    "serial": r"(?i)\bserial\s*(?:no\.?|nr|number)?\b",
    "quantity": r"(?i)\b(qty|quantity)\b",
}
NA_ROW = r"(?i)^(.+?)\s+N/?A\b\s*(.*)$"
LIST_MARK = r"^(?:\d{1,3}[\.\)]\s+|[-*•]\s+)"
TIMES = r"(?i)^(\d+(?:[.,]\d+)?)\s*[x×]\s+(.+)$"
NUMBER = r"^\d+(?:[.,]\d+)?$"
QUANTITY_FIRST = r"""^["“”″']*\s*(\d+(?:[.,]\d+)?)\b"""
PART_LABELS = ("part no", "part number", "part #", "sku", "item code", "product code")
GOODS_LABELS = ("goods", "product", "line description")
#: Rows that a serial block needs, and the first rows of a table among which its header must be.
SERIAL_ROWS, HEADER_ROWS = 3, 5

ITEM = "struct<part_number:string,description:string,quantity:double,raw_text:string,noted_code:string>"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)


def split_any_lines(text: Column) -> Column:
    """At every kind of line boundary; no empty line at the end."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)


def is_header_line(line: Column) -> Column:
    lowered = F.lower(line)
    hits = sum((lowered.contains(k).cast("int") for k in HEADER_KEYS), F.lit(0))
    return hits >= 2


def is_description_header(line: Column) -> Column:
    compact = squash(line)
    return compact.rlike(DESCRIPTION_LABEL) & (is_header_line(compact) | compact.rlike(HEADER_WORDS) | compact.rlike(BARE_HEADER))


def skip_line(line: Column) -> Column:
    return line.rlike(r"(?U)^[\W_]+$") | line.rlike(SKIP)


def _item(part: Column, description: Column, quantity: Column, raw: Column, noted: Column | None = None) -> Column:
    noted = F.lit(None).cast("string") if noted is None else noted
    return F.struct(part.alias("part_number"), description.alias("description"), quantity.cast("double").alias("quantity"), raw.alias("raw_text"), noted.alias("noted_code"))


def _none() -> Column:
    return F.lit(None).cast(ITEM)


def free_text_item(line: Column) -> Column:
    """One free line: `N x body`, or an optional index, part, description and quantity.  Null if it is no product line."""
    raw = squash(F.regexp_replace(line, r"[|\t]", " "))

    def parse(raw: Column) -> Column:
        body = F.regexp_extract(raw, TIMES, 2)
        times = let(t.take_part(t.words_of(body)), lambda p: let(F.trim(F.array_join(p["rest"], " ")), lambda d: F.when(t.valid_description(d), _item(p["part"], d, t.number(F.regexp_extract(raw, TIMES, 1)), raw)).otherwise(_none())))
        return F.when((F.char_length(raw) < 5) | is_header_line(raw) | skip_line(raw), _none()).when(raw.rlike(TIMES), times).otherwise(let(F.split(raw, " "), lambda ts: _plain(ts, raw)))

    return let(raw, parse)


def _plain(tokens: Column, raw: Column) -> Column:
    first = F.get(tokens, F.lit(0))
    index = first.rlike("^[0-9]+$") & (first.try_cast("long") < 500) & (F.size(tokens) >= 3)
    tokens = F.when(F.coalesce(index, F.lit(False)), F.slice(tokens, F.lit(2), F.size(tokens) + 1)).otherwise(tokens)

    def body(ts: Column) -> Column:
        last, before = F.get(ts, F.size(ts) - 1), F.lower(F.get(ts, F.size(ts) - 2))
        is_number = last.rlike(NUMBER)
        labelled = F.coalesce(before.isin("qty", "quantity") & is_number, F.lit(False))
        bare = ~labelled & is_number & ~F.coalesce(before.isin(t.MEASURE_UNITS), F.lit(False))
        cut = F.when(labelled, 2).when(bare, 1).otherwise(0)
        quantity = F.when(cut > 0, t.number(last))
        rest = F.slice(ts, F.lit(1), F.greatest(F.size(ts) - cut, F.lit(0)))

        def done(p: Column) -> Column:
            description = strip_chars(F.array_join(p["rest"], " "), " \\-")
            ok = t.valid_description(description) & (quantity.isNotNull() | p["part"].isNotNull() | raw.rlike(r"\d"))
            return F.when(ok, _item(p["part"], description, quantity, raw)).otherwise(_none())

        return F.when(F.size(rest) > 0, let(t.take_part(rest), done)).otherwise(_none())

    return let(tokens, body)


def serial_item(line: Column) -> Column:
    """A line split at its serial column, which says NA: part and description left, quantity and code right."""

    def parse(compact: Column) -> Column:
        head = strip_chars(F.regexp_extract(compact, NA_ROW, 1), " \\-")
        tail = F.trim(F.regexp_extract(compact, NA_ROW, 2))
        quantity = F.regexp_extract(tail, QUANTITY_FIRST, 1)
        rest = F.when(quantity != "", F.regexp_replace(tail, QUANTITY_FIRST, "")).otherwise(tail)

        def done(p: Column) -> Column:
            return let(t.tidy_description(F.array_join(p["rest"], " ")), lambda d: F.when(t.valid_description(d), _item(p["part"], d, t.number(F.nullif(quantity, F.lit(""))), line, t.noted_code(rest))).otherwise(_none()))

        return F.when(compact.rlike(NA_ROW), let(t.take_part(t.words_of(head)), done)).otherwise(_none())

    return let(squash(line), parse)


def column_spans(header: Column) -> Column:
    """struct of 1-based starts of the labelled columns and of what follows description and part; null where absent."""
    starts = {name: F.nullif(F.regexp_instr(header, F.lit(p)), F.lit(0)) for name, p in COLUMNS.items()}
    after = lambda name: F.array_min(F.filter(F.array(*starts.values()), lambda s: s > starts[name]))
    return F.struct(*(s.alias(n) for n, s in starts.items()), after("description").alias("after_description"), after("part").alias("after_part"))


def aligned_item(line: Column, spans: Column) -> Column:
    """A row cut at the header's character columns."""
    start, n = spans["description"], F.char_length(line)
    cut = lambda a, b: F.substring(line, a, F.greatest(F.coalesce(b, n + 1) - a, F.lit(0)))
    broken = (start > 1) & F.substring(line, start - 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]$")

    def done(d: Column) -> Column:
        part_text = cut(spans["part"], F.coalesce(spans["after_part"], start))
        token = F.get(t.words_of(part_text), F.lit(0))
        part = F.when((spans["part"] <= n) & t.looks_like_part(token), F.upper(token))
        quantity = F.when(spans["quantity"] <= n, t.number(F.get(t.words_of(cut(spans["quantity"], F.lit(None).cast("int"))), F.lit(0))))
        return F.when(t.valid_description(d) & ~skip_line(d), _item(part, d, quantity, line)).otherwise(_none())

    description = strip_chars(squash(cut(start, spans["after_description"])), " \\-")
    return F.when(start.isNotNull() & (n >= start) & ~broken, let(description, done)).otherwise(_none())


def bare_item(line: Column) -> Column:
    """The whole line as a description."""
    return let(strip_chars(F.regexp_replace(squash(line), LIST_MARK, ""), " ;"), lambda d: F.when((F.char_length(d) >= 3) & t.valid_description(d) & ~skip_line(d) & ~is_header_line(d), _item(F.lit(None).cast("string"), d, F.lit(None), line)).otherwise(_none()))


def _lines(docs: DataFrame, doc: str, split) -> DataFrame:
    return docs.select(doc, F.posexplode(split(F.col("text"))).alias("pos", "line"))


def _flat(df: DataFrame, doc: str) -> DataFrame:
    return df.filter("item is not null").select(doc, "pos", "item.*")


def under_header(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    """Rows below the first description header of each document, up to two blank lines or a line to skip after an item."""
    # A header names a description: other documents' lines need not be split, nor meet.
    lines = _lines(docs.filter(F.lower("text").contains("description")), doc, split_lines)
    whole = W.partitionBy(doc)
    header_at = F.min(F.when(is_description_header(F.col("line")), F.col("pos"))).over(whole)
    df = lines.withColumn("at", header_at).filter("pos >= at")
    df = df.withColumn("header", F.max(F.when(F.col("pos") == F.col("at"), F.col("line"))).over(whole)).filter("pos > at")
    spans, line = column_spans(F.col("header")), F.col("line")
    has_serial = F.col("header").rlike(r"(?i)\bserial\b")
    blank, skipped = F.trim(squash(line)) == "", skip_line(line)
    item = F.coalesce(F.when(has_serial, serial_item(line)), aligned_item(line, spans), free_text_item(line), bare_item(line))
    df = df.withColumns({"blank": blank, "skipped": ~blank & skipped, "item": F.when(~blank & ~skipped & ~is_header_line(line) & ~is_description_header(line), item)})
    so_far = whole.orderBy("pos")
    earlier = F.coalesce(F.count("item").over(so_far.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    second_blank = F.col("blank") & F.coalesce(F.lag("blank").over(so_far), F.lit(False))
    df = df.withColumn("ends", earlier & (F.col("skipped") | second_blank))
    df = df.withColumn("stop", F.min(F.when(F.col("ends"), F.col("pos"))).over(whole)).filter("stop is null or pos < stop")
    return _flat(df, doc)


def serial_block(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    """Rows with NA as serial number, if a document has at least three."""
    rows = _lines(docs.filter(F.col("text").rlike(r"(?i)\sN/?A\b")), doc, split_lines).filter(F.col("line").rlike(r"(?iU)\sN/?A\b"))
    df = rows.withColumn("item", serial_item(F.col("line"))).filter("item is not null")
    df = df.filter(~skip_line(F.col("item.description")))
    return _flat(df.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(doc))).filter(F.col("n") >= SERIAL_ROWS), doc)


def free_lines(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    # A product line has a word and a digit or a part number, which has a digit or a mark.
    rows = _lines(docs, doc, split_any_lines).filter(F.col("line").rlike(r"[\d\-/_]") & F.col("line").rlike("[A-Za-z]{3}"))
    return _flat(rows.withColumn("item", free_text_item(F.col("line"))), doc)


def _map_columns(header: Column) -> Column:
    """struct(part, description, quantity) of 0-based columns; later matches win for description and quantity."""
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("part"), none.alias("description"), none.alias("quantity"))
    indexed = F.transform(header, lambda c, i: F.struct(F.lower(c).alias("c"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        c, i = x["c"], x["i"]
        strong = F.lit(False)
        for k in PART_LABELS:
            strong = strong | c.contains(k)
        part = strong | (c.contains("part") & acc["part"].isNull())
        description = ~part & (c.contains("description") | c.isin(*GOODS_LABELS))
        quantity = ~part & ~description & (c.contains("qty") | c.contains("quantity"))
        return F.struct(F.when(part, i).otherwise(acc["part"]).alias("part"), F.when(description, i).otherwise(acc["description"]).alias("description"), F.when(quantity, i).otherwise(acc["quantity"]).alias("quantity"))

    return F.aggregate(indexed, start, step)


def table_rows(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    """Product rows of a document's tables (tables: array of tables of rows of cells)."""
    tables = docs.select(doc, F.posexplode("tables").alias("table", "rows"))
    rows = tables.select(doc, "table", F.posexplode("rows").alias("at", "cells"))
    rows = rows.withColumn("cells", F.transform("cells", lambda c: squash(F.coalesce(c, F.lit(""))))).filter(F.exists("cells", lambda c: c != ""))
    of = W.partitionBy(doc, "table")
    rows = rows.withColumns({"nth": F.row_number().over(of.orderBy("at")) - 1, "n": F.count(F.lit(1)).over(of)}).filter("n >= 2")
    is_header = (F.col("nth") < HEADER_ROWS) & is_header_line(F.array_join("cells", " "))
    rows = rows.withColumn("header_at", F.min(F.when(is_header, F.col("nth"))).over(of)).filter("nth >= header_at")
    rows = rows.withColumn("columns", F.max(F.when(F.col("nth") == F.col("header_at"), _map_columns(F.col("cells")))).over(of)).filter("nth > header_at and columns.description is not null")
    at = lambda name: F.coalesce(F.get("cells", F.col(f"columns.{name}")), F.lit(""))
    part = F.nullif(at("part"), F.lit(""))
    others = F.filter(F.transform("cells", lambda c, i: F.when((i == F.col("columns.description")) | F.coalesce(i == F.col("columns.part"), F.lit(False)) | F.coalesce(i == F.col("columns.quantity"), F.lit(False)), F.lit(None)).otherwise(t.noted_code(c))), lambda c: c.isNotNull())
    d = F.col("d")
    rows = rows.withColumn("d", at("description")).filter((d != "") & ~is_header_line(d) & ~skip_line(d) & t.valid_description(d))
    item = _item(F.when(t.looks_like_part(part), part), d, t.number(F.nullif(at("quantity"), F.lit(""))), F.array_join(F.filter("cells", lambda c: c != ""), " | "), F.get(others, F.size(others) - 1))
    df = rows.select(doc, "table", "at", item.alias("item"))
    df = df.withColumn("pos", F.row_number().over(W.partitionBy(doc).orderBy("table", "at")) - 1)
    return _flat(df, doc)


def _marked(docs: DataFrame, doc: str) -> list[DataFrame]:
    """Rows of the strategies that need marks in a document, in their order."""
    found = [under_header(docs, doc), serial_block(docs, doc)]
    return [table_rows(docs, doc), *found] if "tables" in docs.columns else found


def documents_with_lines(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    """(doc), distinct: the documents of which extract_lines() gives a row.  Precedence, dittos and repeats leave each of them
    one at least, so any row of any strategy tells."""
    every = free_lines(docs, doc).select(doc)
    for df in _marked(docs, doc):
        every = every.unionAll(df.select(doc))
    return every.distinct()


def extract_lines(docs: DataFrame, doc: str = "source_file", page: int | None = None) -> DataFrame:
    """schemas.LINE_ITEMS of documents (doc, text, optionally tables).

    Of each document the first strategy that finds rows counts: tables, rows under a header, a serial block, free lines.
    """
    found = _marked(docs, doc)
    every = found[0].withColumn("way", F.lit(0))
    for k, df in enumerate(found[1:], 1):
        every = every.unionByName(df.withColumn("way", F.lit(k)))
    from_table = F.lit("tables" in docs.columns) & (F.col("way") == 0)
    # Few documents have a header, a table or serial numbers: free lines are all that the others shuffle.
    every = materialise(by_precedence(every, [doc], "way"), "lines")
    rest = free_lines(docs, doc).join(every.select(doc).distinct(), doc, "left_anti").withColumn("way", F.lit(len(found)))
    chosen = every.unionByName(rest)
    # A ditto looks at the rows before repeats go, except under free text and tables, where repeats go first.
    free = from_table | (F.col("way") == len(found))
    keys = [F.upper(F.coalesce("part_number", F.lit(""))).alias("k1"), norm(F.col("description")).alias("k2"), F.when(from_table, "").otherwise(norm(F.col("raw_text"))).alias("k3")]
    late = first_wins(chosen.filter(free), [doc], keys, ["pos"])
    late = fill_dittos(late, [doc], ["pos"])
    early = fill_dittos(chosen.filter(~free), [doc], ["pos"])
    early = first_wins(early, [doc], keys, ["pos"])
    out = early.unionByName(late)
    return out.select(F.col(doc).alias("source_file"), "pos", "part_number", "description", "quantity", "raw_text", F.lit(page).cast("int").alias("page"), "noted_code", "same_as_above")


def collect_descriptions(docs: DataFrame, doc: str = "source_file") -> DataFrame:
    """(doc, descriptions): under a description header if there is one, else one per line; none that contains another."""
    header = docs.select(doc, F.exists(split_lines(F.col("text")), is_description_header).alias("has_header"))
    under = under_header(docs, doc).select(doc, "pos", "description")
    cleaned = strip_chars(F.regexp_replace(squash(F.col("line")), LIST_MARK, ""), " ;")
    plain = _lines(docs, doc, split_lines).withColumn("description", cleaned)
    d = F.col("description")
    plain = plain.filter((F.char_length(d) >= 3) & ~is_header_line(d) & ~skip_line(d) & t.valid_description(d)).select(doc, "pos", "description")
    plain = plain.join(header.filter("not has_header").select(doc), doc, "left_semi")
    each = materialise(under.unionByName(plain), "descriptions")
    stay = without_contained(each, doc, "pos", "description").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("pos", "description"))).alias("x"))
    none = F.array().cast("array<string>")
    return each.select(doc).distinct().join(stay, doc, "left").select(doc, F.coalesce("x.description", none).alias("descriptions"))
