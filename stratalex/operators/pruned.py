"""Exact top-k over postings with block maxima: most pairs of query and row are never scored.

Rows stand in blocks by falling impact (the sum of their gains), so that the maxima of later blocks are low.  A query's
threshold is the k-th score of a few rows that its rarest terms find.  In each block, the terms of least maxima that together
cannot reach the threshold find nothing on their own: only the postings of the others are met (MaxScore, block by block), and
of the rows met only those are scored in full that the rest could still lift to the threshold.

Scores are sums of gains, each at least 0, times a + b x (share of the query's terms that match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.operators.rank import top_k
from stratalex.operators.windows import number_all
from stratalex.storage import materialise

#: Rows of a block, and postings that a query reads for its threshold (its rarest term is read whole).
BLOCK, SEEDS = 128, 256
#: What rounding may take from a bound.
EPS = 2e-6


def in_blocks(gains: DataFrame, id_col: str, block: int = BLOCK) -> DataFrame:
    """gains(term, id, gain) with block: the rows' number by falling impact, in blocks."""
    impact = gains.groupBy(id_col).agg((-F.sum("gain")).alias("down"))
    placed = number_all(impact, "down", id_col, "nth").select(id_col, F.floor((F.col("nth") - 1) / block).alias("block"))
    return gains.join(placed, id_col)


def _score(total: Column, matched: Column, cover: tuple[float, float]) -> Column:
    return total * (cover[0] + cover[1] * matched / F.col("n"))


def thresholds(asked: DataFrame, postings: DataFrame, k: int, query_col: str, id_col: str, cover: tuple[float, float], seeds: int = SEEDS) -> DataFrame:
    """(query, theta): the k-th best score of the rows that the rarest terms find; of fewer rows than k, none."""
    lengths = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = W.partitionBy(query_col).orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    first = asked.join(lengths, "term").withColumn("read", F.coalesce(F.sum("df").over(rarest), F.lit(0))).filter(F.col("read") < seeds)
    some = materialise(first.select(query_col, "term").join(postings, "term").select(query_col, id_col).distinct(), "seeds")
    each = some.join(asked, query_col).join(postings.select("term", id_col, "gain"), ["term", id_col])
    scored = each.groupBy(query_col, id_col, "n").agg(_score(F.sum("gain"), F.count(F.lit(1)), cover).alias("score"))
    return top_k(scored, query_col, id_col, k).filter(F.col("place") == k).select(query_col, F.col("score").alias("theta"))


def candidates(asked: DataFrame, postings: DataFrame, k: int, query_col: str, id_col: str, cover: tuple[float, float] = (1.0, 0.0), seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """asked(query, term, n), distinct, n the query's terms; postings as in_blocks() gives them ->

    met(query, id, n, block, got, matched, hopes): the rows that the essential terms of their block meet, with what these
    give, and whether the others could lift them to the threshold; spare(query, block, term): the others.
    """
    theta = thresholds(asked, postings, k, query_col, id_col, cover, seeds)
    maxima = postings.groupBy("term", "block").agg(F.max("gain").alias("top"))
    here = asked.join(theta, query_col, "left").join(maxima, "term")
    least_first = W.partitionBy(query_col, "block").orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0)
    here = here.withColumns({"_sum": F.sum("top").over(least_first), "_n": F.count(F.lit(1)).over(least_first)})
    reach = lambda total, n: F.coalesce(_score(total, n, cover) >= F.col("theta") - EPS, F.lit(True))
    here = here.withColumn("essential", reach(F.col("_sum"), F.col("_n")))
    whole = W.partitionBy(query_col, "block")
    rest = {"rest": F.coalesce(F.max(F.when(~F.col("essential"), F.col("_sum"))).over(whole), F.lit(0.0)), "rest_n": F.coalesce(F.max(F.when(~F.col("essential"), F.col("_n"))).over(whole), F.lit(0))}
    here = here.withColumns(rest).withColumn("any", F.max("essential").over(whole)).filter("any")
    here = materialise(here.select(query_col, "block", "term", "n", "theta", "essential", "rest", "rest_n"), "essential")
    met = here.filter("essential").join(postings, ["term", "block"]).groupBy(query_col, id_col, "n", "block", "theta", "rest", "rest_n").agg(F.sum("gain").alias("got"), F.count(F.lit(1)).alias("matched"))
    met = met.withColumn("hopes", reach(F.col("got") + F.col("rest"), F.col("matched") + F.col("rest_n")))
    return met.select(query_col, id_col, "n", "block", "got", "matched", "hopes"), here.filter("not essential").select(query_col, "block", "term")


def pruned_top_k(asked: DataFrame, postings: DataFrame, k: int, query_col: str, id_col: str, cover: tuple[float, float] = (1.0, 0.0), digits: int = 6, seeds: int = SEEDS) -> DataFrame:
    """(query, id, score, place): the best k rows of each query, as if all were scored; ties go to the lower id."""
    met, spare = candidates(asked, postings, k, query_col, id_col, cover, seeds)
    hopeful = materialise(met.filter("hopes").drop("hopes"), "hopeful")
    more = hopeful.select(query_col, id_col, "n", "block").join(spare, [query_col, "block"]).join(postings, ["term", id_col, "block"])
    both = hopeful.select(query_col, id_col, "n", "got", "matched").unionByName(more.select(query_col, id_col, "n", F.col("gain").alias("got"), F.lit(1).cast("long").alias("matched")))
    score = F.round(_score(F.sum("got"), F.sum("matched"), cover), digits)
    return top_k(both.groupBy(query_col, id_col, "n").agg(score.alias("score")), query_col, id_col, k).select(query_col, id_col, "score", "place")
