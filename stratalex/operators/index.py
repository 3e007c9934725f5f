"""Inverted index over a corpus: postings, document frequency, IDF, BM25 and the candidate pool.

All lookups are equi-joins on the token.  Postings of a token that is everywhere are skewed; adaptive execution splits
them, and candidates() drops such tokens as the search semantics ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.storage import materialise

#: Fixed values of the search: postings longer than LONG are skipped once something was found; no further token is looked
#: up once more than ENOUGH lines were; BM25 adds its best BM25_HITS over the first BM25_TERMS tokens.
LONG, ENOUGH, BM25_HITS, BM25_TERMS = 2500, 800, 25, 12
K1, B = 1.2, 0.75


def postings(corpus: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(token, id), one row per distinct token of a row."""
    return corpus.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(id_col))


def doc_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, total: Column) -> Column:
    return F.log((F.greatest(total, F.lit(1)) + 1) / (df + 1)) + 1.0


def with_idf(frequency: DataFrame, total: int) -> DataFrame:
    """Adds idf.  total: rows of the corpus, a number, so that no join is needed for it."""
    return frequency.withColumn("idf", idf(F.col("df"), F.lit(total)))


def capped_candidates(query_tokens: DataFrame, posted: DataFrame, frequency: DataFrame, query_col: str, id_col: str, long: int = LONG, enough: int = ENOUGH) -> DataFrame:
    """query_tokens(query, token), distinct -> (query, id): the pool of the capped lookup.

    Tokens are looked up by falling IDF, then by name.  A token with more than `long` postings counts only while nothing
    was found; a token counts only while at most `enough` distinct rows were found before it.

    The lookup goes in rounds.  A round takes of each query the tokens that are due whatever they find: as long as their
    postings before them, added to the rows found, are no more than `enough`.  Queries that have enough, or no token
    left, leave; so no posting is read that the pool does not hold, but for rows that several tokens share.
    """
    known = query_tokens.join(frequency.select("token", "df"), "token")
    # Rare tokens first: IDF falls as the frequency rises.
    by_rank = W.partitionBy(query_col).orderBy("df", "token")
    ranked = known.withColumn("rank", F.row_number().over(by_rank)).filter((F.col("rank") == 1) | (F.col("df") <= long))
    ahead = F.sum("df").over(by_rank.rowsBetween(W.unboundedPreceding, -1))
    ranked = materialise(ranked.withColumn("ahead", F.coalesce(ahead, F.lit(0))), "ranked")
    open_ = ranked.groupBy(query_col).agg(F.lit(0).cast("long").alias("found"), F.min("ahead").alias("base"))
    pool = None
    while True:
        due = materialise(ranked.join(open_, query_col).filter((F.col("ahead") >= F.col("base")) & (F.col("ahead") - F.col("base") + F.col("found") <= enough)), "due")
        if due.isEmpty():
            break
        hits = due.select(query_col, "token").join(posted, "token").select(query_col, id_col).distinct()
        if pool is not None:
            hits = hits.join(pool, [query_col, id_col], "left_anti")
        hits = materialise(hits, "hits")
        pool = hits if pool is None else pool.unionByName(hits)
        # Where the next token stands, and how much was found.
        at = due.groupBy(query_col).agg(F.max("found").alias("had"), F.max(F.col("ahead") + F.col("df")).alias("base"))
        new = hits.groupBy(query_col).agg(F.count(F.lit(1)).alias("new"))
        open_ = at.join(new, query_col, "left").select(query_col, (F.col("had") + F.coalesce("new", F.lit(0))).alias("found"), "base").filter(F.col("found") <= enough)
        open_ = materialise(open_, "open")
    return posted.select(id_col).limit(0).crossJoin(ranked.select(query_col).limit(0)).select(query_col, id_col) if pool is None else pool


def bm25(query_terms: DataFrame, terms: DataFrame, total: int, mean_length: float, query_col: str, id_col: str, hits: int = BM25_HITS, digits: int = 9) -> DataFrame:
    """query_terms(query, term), distinct; terms(term, id, tf, length) of the corpus -> (query, id, bm25): the best rows.

    Lucene-style saturation with k1 = 1.2 and b = 0.75; the inverse frequency is floored at 1e-6.  Ties go to the lower id.
    """
    from stratalex.operators.pruned import in_blocks, pruned_top_k

    n = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(query_terms.select("term").distinct(), "term")
    weight = F.greatest(F.log((F.lit(total) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    gain = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean_length))))
    gains = materialise(terms.join(n, "term").select("term", id_col, gain.alias("gain")), "gains")
    blocks = materialise(in_blocks(gains, id_col), "blocks")
    best = pruned_top_k(query_terms.withColumn("n", F.lit(1)), blocks, hits, query_col, id_col, digits=digits)
    return best.select(query_col, id_col, F.col("score").alias("bm25"))


def term_table(corpus: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(term, id, tf, length) of the corpus, for bm25()."""
    df = corpus.select(F.col(id_col), tokens.alias("tokens"))
    return df.select(id_col, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(id_col, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def first_terms(tokens: Column, most: int = BM25_TERMS) -> Column:
    """The tokens that BM25 takes: the first in the alphabet."""
    return F.slice(F.sort_array(F.array_distinct(tokens)), 1, most)
