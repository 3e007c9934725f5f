"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a token target, and the mixture is to keep the corpus' mean log length of a document (by tokens), so that
no source is filled up with its short or its long documents.  Among all document rates of 0 to MOST the one nearest to 1
in relative entropy (by token mass) is exponentially tilted:
    rate = min(MOST, exp(lambda of the source + beta * f)),   f the document's centred log length.
The convex dual is
    max  sum over sources of lambda * target  -  sum over documents of size * phi(lambda + beta * f)  -  ridge / 2 * beta**2
and given beta each lambda has a closed form: documents reach MOST in the order of beta * f, so the level of the others
follows from running sums along that order.  What remains is concave in beta; Newton steps, kept within a bracket, find
its top.  Each step takes gradient and curvature as sums over all documents in one distributed aggregate; documents of one
source and size have one rate, so they enter as one row with their number.  The ridge is for corpora where lengths cannot
be kept: there beta stays finite, and sources still meet their targets.  Sums are of whole millionths, so that reruns
agree to the bit.

Rates become whole copies by error diffusion within blocks of a source (about BLOCK_ROWS documents by a hash of the id and
the text): largest documents first, each takes the copies that bring the block's running total nearest to its target.  A
source of any size is dealt over as many blocks, so none meets in one task; rows that repeat id and text are counted first
and enter in parts of at most BLOCK_ROWS.  Where documents too long for their block leave it off target, and its source has
other blocks, these documents are rounded by an even sequence, and what they owe is shared by the other documents of all
the source's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.llm.common import discard, materialise, packed, whole

WEIGHTS = (1, 2, 3)
#: Most copies of a document, and most times its size that a source's target may be.
MOST = 3
BLOCK_ROWS = 800
#: Most Newton steps, and the share of all tokens at which the gradient counts as zero.
STEPS, NEAR = 60, 1e-9
#: The ridge as a share of all tokens, the bracket of beta, and its width at which the steps end as well.
RIDGE, BETA_MOST, NARROW = 0.01, 4.0, 1e-6
#: Rates are rounded to this fraction, so that all later arithmetic is in whole numbers; sums of the dual as well.
UNIT = 1_000_000
#: Copies that one row is expanded to at a time.
PART = 1000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sized(source, size) -> (place, source, n, source_size, target).

    Sources by code point, null last, weigh weights in turn and share the sum of all sizes; a target stops at `most`
    times its source's size and the excess goes to the others by weight.  The windows run over one row per source.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    df = stats.withColumn("place", place).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights)))))
    # Sources reach their cap in the order of cap / weight.  Were just those before a row capped, the level would be:
    by = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(W.partitionBy()), F.sum("weight").over(W.partitionBy())
    left = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    df = df.withColumn("level", left / (all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    free = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.struct(F.col("source_size") / F.col("weight"), "place"))).over(W.partitionBy())
    target = F.least(level * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return df.select("place", "source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _whole(x: Column) -> Column:
    """The sum of x in whole millionths, whatever the order of rows."""
    return F.sum(F.round(x * UNIT).cast("decimal(38,0)"))


def _levels(cells: DataFrame, beta: float, most: int) -> DataFrame:
    """cells with level, e**lambda of their source, so that the source meets its target, and mass, the tokens taken."""
    own = F.col("size") * F.col("n")
    tilt = F.exp(F.lit(beta) * F.col("f"))
    first = W.partitionBy("place").orderBy(F.desc(F.lit(beta) * F.col("f")), "size")  # whoever reaches the highest rate first
    last = W.partitionBy("place").orderBy(F.lit(beta) * F.col("f"), F.desc("size"))
    df = cells.withColumn("tilt", tilt)
    df = df.withColumn("above", F.coalesce(F.sum(most * own).over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("below", F.sum(own * F.col("tilt")).over(last.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("try", (F.col("target") - F.col("above")) / F.col("below"))
    fits = F.col("try") * F.col("tilt") <= most
    df = df.withColumn("level", F.max_by(F.when(fits, F.col("try")), F.when(fits, F.struct(F.lit(beta) * F.col("f"), -F.col("size")))).over(W.partitionBy("place")))
    rate = F.least(F.coalesce(F.col("level") * F.col("tilt"), F.lit(float(most))), F.lit(float(most)))
    return df.withColumn("mass", own * rate).withColumn("bends", F.when(F.col("level") * F.col("tilt") < most, F.col("mass")).otherwise(0.0))


def solve(sized: DataFrame, sources: DataFrame, most: int = MOST, steps: int = STEPS) -> tuple[DataFrame, float]:
    """(place, level, centre) of the sources with words, and beta; level is e**lambda, null where all are at the highest
    rate; cells' log length is centred as in length()."""
    total = float(sources.agg(F.sum("target")).first()[0] or 0.0)
    cells = sized.filter("size > 0").join(sources, F.col("sized_source").eqNullSafe(F.col("source")))
    cells = materialise(cells.groupBy("place", "target", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    centre = _centre(cells)
    cells = cells.withColumn("f", length(F.col("size"), centre))
    beta, low, high, ridge = 0.0, -BETA_MOST, BETA_MOST, RIDGE * total
    f, real = F.col("f"), lambda x: F.coalesce(_whole(x).cast("double") / UNIT, F.lit(0.0))
    for _ in range(steps):
        by = _levels(cells, beta, most).groupBy("place").agg(real(F.col("bends")).alias("a"), real(F.col("bends") * f).alias("b"), real(F.col("bends") * f * f).alias("d"), real(F.col("mass") * f).alias("g"))
        one = by.agg(real(F.col("g")).alias("g"), real(F.col("d") - F.when(F.col("a") > 0, F.col("b") * F.col("b") / F.col("a")).otherwise(0.0)).alias("bend")).first()
        slope = -one.g - ridge * beta
        if abs(slope) <= NEAR * total or high - low < NARROW:
            break
        low, high = (beta, high) if slope > 0 else (low, beta)
        moved = beta + slope / max(one.bend + ridge, ridge)
        beta = moved if low < moved < high else (low + high) / 2
    levels = _levels(cells, beta, most).groupBy("place").agg(F.max("level").alias("level")).withColumn("centre", F.lit(centre))
    out = materialise(levels, "levels")
    discard(cells)
    return out, beta


def _centre(cells: DataFrame) -> float:
    """The corpus' mean log length by tokens."""
    r = cells.agg(_whole(F.col("size") * F.col("n") * F.log("size")).cast("double").alias("x"), F.sum(F.col("size") * F.col("n")).cast("double").alias("n")).first()
    return round(r.x / UNIT / r.n, 9) if r.n else 0.0


def length(size: Column, centre: Column | float) -> Column:
    """A document's centred log length; of one without words 0."""
    return F.when(size > 0, F.round(F.log(size) - centre, 9)).otherwise(0.0)


def _top(rate: Column, most: int) -> Column:
    """Most copies of a document at the rate in units."""
    return F.least(F.lit(most).cast("long"), F.ceil(rate / UNIT) + 1)


def _diffuse(docs: Column, most: int, owed: Column) -> Column:
    """(owed, out): copies of the documents (size, rate, n: rows alike), in their order, of all n together, and what is
    owed in the end; owed in the beginning is as given."""

    def step(acc: Column, doc: Column) -> Column:
        size, n, rate = doc["size"], doc["n"], doc["rate"]
        want = size * n * rate + acc["owed"]
        nearest = F.floor((want + size * (UNIT // 2)) / F.greatest(size * UNIT, F.lit(1)))
        copies = F.when(size > 0, F.greatest(F.lit(0).cast("long"), F.least(n * _top(rate, most), nearest))).otherwise(n * F.least(F.lit(1).cast("long"), F.ceil(rate / UNIT)))
        return F.struct((want - copies * size * UNIT).alias("owed"), F.concat(acc["out"], F.array(copies)).alias("out"))

    start = F.struct(owed.cast("long").alias("owed"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(docs, start, step)


def _room(doc: Column, most: int) -> Column:
    """By how much the rounding of a document can go either way."""
    return doc["size"] * doc["n"] * F.least(doc["rate"], _top(doc["rate"], most) * UNIT - doc["rate"])


def _total(docs: Column, value) -> Column:
    return F.aggregate(docs, F.lit(0).cast("long"), lambda acc, doc: acc + value(doc))


def _too_long(docs: Column, most: int) -> Column:
    """How many of the first documents are so long that settling their rounding would take the smaller ones of their block
    over half the way that they can go."""

    def step(acc: Column, doc: Column) -> Column:
        rest = acc["rest"] - _room(doc, most)
        long_ = acc["open"] & (doc["size"] * UNIT > rest)
        return F.struct(rest.alias("rest"), long_.alias("open"), (acc["n"] + long_.cast("int")).alias("n"))

    start = F.struct(_total(docs, lambda doc: _room(doc, most)).alias("rest"), F.lit(True).alias("open"), F.lit(0).alias("n"))
    return F.aggregate(docs, start, step, lambda acc: acc["n"])


def _settle(blocks: DataFrame, most: int) -> DataFrame:
    """Adds copies to blocks(place, block, docs)."""
    docs, zero = F.col("docs"), F.lit(0).cast("long")
    least = F.array_min(F.filter(F.transform(docs, lambda doc: doc["size"]), lambda x: x > 0))
    done = blocks.withColumn("done", _diffuse(docs, most, zero))
    done = materialise(done.withColumn("stuck", F.coalesce(F.abs("done.owed") > least * (UNIT // 2), F.lit(False))), "blocks")
    several = done.groupBy("place").agg(F.count(F.lit(1)).alias("blocks"), F.max("stuck").alias("any")).filter("blocks > 1 and any").select("place", F.lit(True).alias("redo"))
    marked = done.join(several, "place", "left")
    fine = marked.filter("redo is null").withColumn("copies", F.col("done.out"))
    again = marked.filter("redo").withColumn("n_long", _too_long(docs, most))
    again = again.withColumn("long", F.slice("docs", F.lit(1), F.col("n_long"))).withColumn("tame", F.slice("docs", F.col("n_long") + 1, F.size("docs")))
    # A sequence that is even over blocks and places, so that the long documents of a source nearly meet its rate.
    even = lambda i: F.pmod(F.col("block") * 618_034 + i * 754_878, F.lit(UNIT))
    drawn = F.transform("long", lambda doc, i: F.least(doc["n"] * _top(doc["rate"], most), F.floor((doc["n"] * doc["rate"] + even(i)) / UNIT)))
    again = again.withColumn("drawn", drawn).withColumn("tame_room", _total(F.col("tame"), lambda doc: _room(doc, most)))
    owed = F.aggregate(F.arrays_zip("long", "drawn"), zero, lambda acc, x: acc + x["long"]["size"] * (x["long"]["n"] * x["long"]["rate"] - x["drawn"] * UNIT))
    again = materialise(again.withColumn("debt", owed), "blocks")
    debts = again.groupBy("place").agg(F.sum("debt").alias("all_debt"), F.sum(F.col("tame_room").cast("double")).alias("all_tame"))
    share = F.floor(F.col("all_debt") * (F.col("tame_room") / F.greatest("all_tame", F.lit(1.0))))
    again = again.join(debts, "place").withColumn("copies", F.concat("drawn", _diffuse(F.col("tame"), most, share)["out"]))
    return fine.select(*blocks.columns, "copies").unionByName(again.select(*blocks.columns, "copies"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target, id, size, text_hash, n, copies): of n rows alike, at most BLOCK_ROWS, all copies."""
    text = whole(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("sized_source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = materialise(sized, "sized")
    sources = materialise(targets(sized.withColumnRenamed("sized_source", "source"), weights, most), "sources")
    dual, beta = solve(sized, sources, most)
    facts = sources.join(dual, "place", "left")
    known = sized.join(facts, F.col("sized_source").eqNullSafe(F.col("source")))
    tilted = F.coalesce(F.col("level") * F.exp(F.lit(beta) * length(F.col("size"), F.col("centre"))), F.lit(float(most)))
    rate = F.when(F.col("source_size") > 0, F.round(F.least(tilted, F.lit(float(most))) * UNIT)).otherwise(0.0).cast("long")
    alike = known.groupBy("place", F.col("n").alias("rows"), "id", "size", "text_hash", rate.alias("rate")).agg(F.count(F.lit(1)).alias("all"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / BLOCK_ROWS)))
    parts = alike.withColumn("part", part).withColumn("n", F.least(F.lit(BLOCK_ROWS).cast("long"), F.col("all") - F.col("part") * BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.col("id").cast("string"), "text_hash", "part"), F.ceil(F.col("rows") / BLOCK_ROWS))
    doc = F.struct("size", "id", "text_hash", "part", "n", "rate")
    # The order of structs, from the largest size.
    blocks = parts.groupBy("place", block.alias("block")).agg(F.sort_array(F.collect_list(doc), asc=False).alias("docs"))
    settled = _settle(blocks, most).select("place", F.explode(F.arrays_zip("docs", "copies")).alias("x"))
    return settled.join(sources.select("place", "source", "source_size", "target"), "place").select("source", "source_size", "target", "x.docs.id", "x.docs.size", "x.docs.text_hash", "x.docs.n", "x.copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies, text_hash.

    A null text has size 0; a document without words is taken once at most.  A null source is a source of its own, last
    in order.  Repeated rows are documents of their own and share the copies of all of them evenly.  Reruns agree: rates,
    blocks and order depend on id, size and text alone, and rows equal in all of these are interchangeable.  Texts of any
    length are counted whole.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, most)
    n, k = F.col("n"), F.col("copies")
    each = plan.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), n))).withColumn("copies", F.floor(k / n) + (F.col("nth") <= k % n).cast("long"))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_hash")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as many times as mix() takes it, with all its columns, whatever their names.

    Rows that repeat id, source and text are one document with their copies together, in the columns of one of the rows.
    Nulls and empty texts are as in mix(); an empty table gives an empty result.  Texts are shuffled once.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, most)
    plan = plan.groupBy("id", "source", "text_hash").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).filter("copies > 0")
    plan = materialise(plan.toDF("p_id", "p_source", "p_hash", "n", "copies"), "plan")  # read anew, so that the join can split a group of equal rows
    plan = plan.hint("merge")  # a row for each document is nothing to broadcast
    keyed = docs.select(packed(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(whole(text_col)).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("hash") == F.col("p_hash"))
    out = keyed.join(plan.filter("n = 1"), same).select("row", "copies")
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
    repeats = plan.filter("n > 1")
    if repeats.isEmpty():
        return out
    one = keyed.join(repeats, same).groupBy("p_id", "p_source", "p_hash", "copies").agg(F.first("row").alias("row"))
    parts = one.select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PART))).alias("part")).repartition(F.col("part"), F.xxhash64("row"))
    many = parts.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PART).cast("long"), F.col("copies") - F.col("part") * PART))))
    return out.unionByName(many.select("row.*"))
