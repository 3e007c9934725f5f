"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

1. Patterns give spans where the text is read; only (id, owner, repository, spans) is written to the shared folder.
2. Candidate values, hashed, are counted by distinct repositories and owners: rows shrink to one per hash, owner and
   repository before they are grouped by hash, so a value that is everywhere is never gathered in one task.
3. A value is a widely copied example if EXAMPLE_OWNERS owners hold it, or if at least two do in EXAMPLE_REPOS
   repositories; others, however often one owner repeats them, are live-looking.  Weak patterns (long opaque strings) are
   trusted only where a value is no example: those spans the method adds.

The work on a text grows with n log n of its matches: positions are running sums, overlaps running extremes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import materialise, whole

#: Distinct owners from which a value counts as a widely copied example, and distinct repositories if two owners hold it.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
#: The kinds in their order and their patterns.  Letters of keywords stand in both cases.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_BOTH_CASES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in _KEYWORDS)
ASSIGN = rf"""({_BOTH_CASES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",  # as AKIA[A-Z0-9]+ of 20 characters or more: a run too short has no longer start
    "hex": r"[0-9a-f]{24,}",
    "issued": r"gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
    "opaque": r"[A-Za-z0-9+/_-]{24,}",
}
BASE = ("assign", "access", "hex")
#: The place of the weak kind, which is the last.
WEAK = len(KINDS) - 1
_FAR = 2**31 - 1


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running total of an array under an associative function, in log2(n) passes that double their reach."""
    passes = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(passes, values, lambda acc, far: F.transform(acc, lambda v, i: F.when(i >= far, combine(F.get(acc, i - far), v)).otherwise(v)))


def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    found = F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))
    return found, F.split(text, KINDS[kind], -1)


def _spans(kind: str, found: Column, between: Column) -> Column:
    """Array of (start, rank, end, value): code points, end exclusive.  A match follows the text between it and the last."""
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)")
    steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.char_length(m) + F.char_length(b))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2) if kind == "assign" else m
    rank = F.lit(list(KINDS).index(kind))
    spans = F.zip_with(found, running(steps, lambda a, b: a + b), lambda m, end: F.struct((end - F.char_length(m)).alias("start"), rank.alias("rank"), end.alias("end"), value(m).alias("value")))
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def _keep(kind: str, spans: Column) -> Column:
    if kind == "assign":
        return F.filter(spans, lambda s: F.char_length(s["value"]) >= 6)
    if kind == "opaque":  # upper case, lower case and digits together: not a word, path or number
        return F.filter(spans, lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9].*[0-9]"))
    return spans


def _apart(spans: Column) -> Column:
    """Sorted spans without the weak ones that overlap another kind's: those say nothing new."""
    strong = lambda s, value, other: F.when(s["rank"] < WEAK, value).otherwise(F.lit(other))
    reached = running(F.transform(spans, lambda s: strong(s, s["end"], 0)), F.greatest)
    ahead = F.reverse(running(F.transform(F.reverse(spans), lambda s: strong(s, s["start"], _FAR)), F.least))
    seen = F.zip_with(spans, F.zip_with(reached, ahead, lambda a, b: F.struct(a.alias("reached"), b.alias("ahead"))), lambda s, e: F.struct(s.alias("span"), e.alias("by")))
    kept = F.filter(seen, lambda x: (x["span"]["rank"] < WEAK) | ((x["by"]["reached"] <= x["span"]["start"]) & (x["by"]["ahead"] >= x["span"]["end"])))
    return F.transform(kept, lambda x: x["span"])


def _told(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"]))
    return F.array_join(said, ",")


def find_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo: Column) -> DataFrame:
    """(id, row, owner, repo, spans): spans of all kinds, sorted, with the hash of their value; row tells rows apart."""
    text = F.col("_text")
    df = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), repo.alias("repo"), whole(text_col).alias("_text"))
    # The matches are a step of their own, so that they are computed once; texts without any are not split.
    df = df.select("*", *(_matches(text, k)[0].alias(f"_m_{k}") for k in KINDS))
    df = df.select("*", *(F.when(F.size(f"_m_{k}") > 0, _matches(text, k)[1]).alias(f"_b_{k}") for k in KINDS))
    df = df.select("id", "owner", "repo", F.sort_array(F.concat(*(_keep(k, _spans(k, F.col(f"_m_{k}"), F.col(f"_b_{k}"))) for k in KINDS))).alias("spans"))
    some = F.when(F.exists("spans", lambda s: s["rank"] == WEAK) & F.exists("spans", lambda s: s["rank"] < WEAK), _apart(F.col("spans"))).otherwise(F.col("spans"))
    sealed = F.transform(some, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    return df.select("id", F.monotonically_increasing_id().alias("row"), "owner", "repo", sealed.alias("spans"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(hash, n_owners, n_repos, example) of each candidate value over the whole corpus."""
    held = found.select("owner", "repo", F.explode("spans").alias("span")).select("span.hash", "owner", "repo").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    return counts.withColumn("example", (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    repo: what counts as a repository (by default each language of an owner is one).  spans holds all base spans, issued
    keys by their prefixes, and opaque strings that overlap neither and are no examples; n_live and n_example count the
    distinct values among them of either sort.  Null or empty texts have no spans; a null owner counts as one owner.
    Repeated rows each return and count once for their owner; an empty table gives an empty result; other columns are
    ignored, whatever their names.  A very long text with 100,000 matches takes seconds.
    """
    if repo is None:
        repo = F.concat_ws("/", F.col(owner_col), F.col("lang")) if "lang" in docs.columns else F.col(owner_col)
    found = materialise(find_spans(docs, id_col, text_col, owner_col, repo), "spans")
    # Read anew, so that the join can split a value that is everywhere.
    examples = materialise(ownership(found, example_owners, example_repos).filter("example").select("hash", "example"), "examples")
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(examples, "hash", "left")
    span = F.struct("start", "rank", "end", "hash", F.coalesce("example", F.lit(False)).alias("example"))
    by_row = each.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # the spans of one text
    df = found.select("id", "row").join(by_row, "row", "left")
    spans = F.coalesce(F.filter("spans", lambda s: (s["rank"] < WEAK) | ~s["example"]), F.expr("cast(array() as array<struct<start:int,rank:int,end:int,hash:string,example:boolean>>)"))
    df = df.select(F.col("id").alias(id_col), spans.alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    values = lambda test: F.size(F.array_distinct(F.transform(F.filter("spans", test), lambda s: s["hash"]))).cast("long")
    return df.select(id_col, *map(count, BASE), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), values(lambda s: ~s["example"]).alias("n_live"), values(lambda s: s["example"]).alias("n_example"))
