"""Scoring of candidate lines and the fuzzy re-ranking of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.similarity import token_set_ratio_udf

#: Fixed values of the score.
COVER, FULL = 0.65, 0.35
NEAREST, NEAR_EXTRA, EXTRA, RESIDUAL = 1.2, 0.45, 0.2, 0.15
FUZZY, HEAD = 1.5, 8
DIGITS = 6


def overlap_score(weights: Column, overlap: Column, query_size: Column) -> Column:
    """IDF weight of the overlap, discounted by how much of the query it covers."""
    return weights * (COVER + FULL * overlap / query_size)


def score_pool(pool: DataFrame, queries: DataFrame, lines: DataFrame, weights: DataFrame, query_col: str, id_col: str) -> DataFrame:
    """Scores of pairs (query, id).

    queries(query, tokens), lines(id, tokens, specific, nearest): token sets; weights(token, idf).  Unknown tokens weigh
    1.  -> (query, id, score, n_overlap); pairs that share no token are dropped.
    """
    # Weights go to the tokens of queries and lines once, not to each pair; a pair is then a row that no shuffle splits up.
    told = queries.select(query_col, F.explode("tokens").alias("token")).join(weights.select("token", "idf"), "token", "left")
    asked = told.groupBy(query_col).agg(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("w"))).alias("asked"))
    own = lines.select(id_col, F.explode(F.array_distinct("specific")).alias("token")).join(weights.select("token", "idf"), "token", "left")
    own = own.groupBy(id_col).agg(F.sum(F.coalesce("idf", F.lit(1.0))).alias("own"))
    pairs = pool.join(asked, query_col).join(lines.select(id_col, "tokens", "specific", "nearest").join(own, id_col, "left"), id_col)
    among = lambda c: F.filter("asked", lambda x: F.array_contains(c, x["token"]))
    pairs = pairs.select(query_col, id_col, "own", "nearest", "specific", F.size("asked").alias("n_query"), among("tokens").alias("overlap"), among("nearest").alias("near"), among("specific").alias("mine")).filter(F.size("overlap") > 0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["w"])
    n_overlap = F.size("overlap").cast("long")
    near_extra = F.size(F.array_distinct("nearest")) - F.size("near")
    extra = F.coalesce("own", F.lit(0.0)) - total("mine")
    score = overlap_score(total("overlap"), n_overlap, F.col("n_query")) + NEAREST * total("near") - NEAR_EXTRA * near_extra - EXTRA * extra + F.when(F.size("specific") == 0, RESIDUAL).otherwise(0.0)
    return pairs.select(query_col, id_col, F.round(score, DIGITS).alias("score"), n_overlap.alias("n_overlap"))


def top_k(scored: DataFrame, query_col: str, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The best k rows of each query with their place; ties go to the lower id."""
    best = W.partitionBy(query_col).orderBy(F.desc(score), id_col)
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def fuzzy_rerank(scored: DataFrame, text: str, legal_path: str, query_col: str, id_col: str, head: int = HEAD, several: str | None = None) -> DataFrame:
    """The first `head` of each query with the fuzzy bonus added and placed anew, then the others, whose places stay as
    they are.  A lone candidate gets no bonus.

    Only the first reach Python, however many candidates a query has.  several: a column that tells queries with candidates
    beside those given.
    """
    placed = scored.withColumn("place", F.row_number().over(W.partitionBy(query_col).orderBy(F.desc("score"), id_col)))
    first, tail = placed.filter(F.col("place") <= head), placed.filter(F.col("place") > head)
    many = F.count(F.lit(1)).over(W.partitionBy(query_col)) > 1
    first = first.withColumn("_many", many | F.col(several) if several else many).withColumn("fuzzy", token_set_ratio_udf(text, legal_path))
    score = F.round(F.col("score") + F.when(F.col("_many"), F.col("fuzzy") / 100 * FUZZY).otherwise(0.0), DIGITS)
    return top_k(first.drop("place").withColumn("score", score).drop("_many", "fuzzy"), query_col, id_col, head).unionByName(tail)
