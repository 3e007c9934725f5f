"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < 2: toxic, poor, good.  One vector of hashed-token weights w is shared by all grades and the thresholds are
ordered: P(grade >= k) = sigmoid(w.x - threshold k).  Training takes at most SAMPLE labelled documents, those with the
smallest hashes of their ids, so the sample does not depend on the order of rows or the size of the corpus.  Only buckets
whose presence depends on the grade beyond chance (a chi-squared screen) get weights; these few go to the executors with
the scoring function.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalex.llm.common import materialise, packed, tune, type_of

#: Most labelled documents that training takes.
SAMPLE = 20_000
#: Hash buckets of tokens.
BUCKETS = 1 << 22
#: Probability of the top grade from which a document is selected.
SELECT = 0.5
GRADES = 3
#: Chi-squared statistic (one degree of freedom) that a bucket needs against some split of the grades; chance reaches it
#: for one bucket in 200,000.  Fewer than 1,100 documents have fewer buckets, and need 3 ln(documents).
SCREEN = 21.0
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_LETTERS = re.compile(r"[\W\d_]+")
_NOT_UPPER = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def tokens(text: str) -> set[str]:
    """Distinct words and runs of marks, in lower case, with the share of repeated words and of capitals as tokens too."""
    words = _TOKENS.findall(text.lower())
    out = set(words)
    if len(words) >= 10:
        out.add(f"\x00distinct {10 * len(out) // len(words)}" if len(words) < 200 else f"\x00distinct of many {10 * len(out) // len(words)}")
    letters = len(_LETTERS.sub("", text))
    if letters >= 20:
        out.add(f"\x00capitals {10 * len(_NOT_UPPER.sub('', text)) // letters}")
    return out


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        return [1 / (1 + math.exp(max(-60.0, min(60.0, t - score)))) for t in self.thresholds]


def fit(features: list[np.ndarray], grades: np.ndarray, epochs: int = 12, rate: float = 0.3, l1: float = 0.1, l2: float = 0.1) -> Model:
    """FTRL-proximal steps on the negative log-likelihood.  features: the screened buckets of each document.  Without two
    grades the model selects everything."""
    if len(set(grades.tolist())) < 2:
        return Model({}, [-20.0] * (GRADES - 1))
    used, flat = np.unique(np.concatenate(features).astype(np.int32), return_inverse=True)
    docs = np.split(flat, np.cumsum([len(f) for f in features])[:-1])
    z, n = np.zeros(len(used)), np.zeros(len(used))
    tail = [(grades >= k).mean() for k in range(1, GRADES)]
    theta = np.array([-math.log(max(p, 1e-3) / max(1 - p, 1e-3)) for p in tail])
    weights = lambda z, n: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate + l2), 0.0)
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        for i in order.permutation(len(docs)):
            d, y = docs[i], int(grades[i])
            zi, ni = z[d], n[d]
            w = weights(zi, ni)
            s = float(w.sum())
            up = [1.0, *(1 / (1 + math.exp(max(-60.0, min(60.0, t - s)))) for t in theta), 0.0]
            p = max(up[y] - up[y + 1], 1e-9)
            # Derivatives of -log(up[y] - up[y + 1]) in the score and in the thresholds.
            low, high = up[y] * (1 - up[y]), up[y + 1] * (1 - up[y + 1])
            g = max(-1.0, min(1.0, -(low - high) / p))
            step = 0.05 / (1 + epoch)
            if y > 0:
                theta[y - 1] += step * max(-1.0, min(1.0, -low / p))
            if y < GRADES - 1:
                theta[y] += step * max(-1.0, min(1.0, high / p))
            theta = np.maximum.accumulate(theta)
            z[d] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rate * w
            n[d] = ni + g * g
    w = weights(z, n)
    some = np.flatnonzero(w)
    return Model(dict(zip(used[some].tolist(), w[some].tolist())), theta.tolist())


def grade(quality: str = "quality", toxic: str = "toxic"):
    """The graded rating of a labels row: 0 toxic, 1 poor, 2 good; null if both are."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, screen: float = SCREEN) -> Model:
    """labels: id and grade.  Of rows that share an id one is used."""
    tune(docs.sparkSession)
    picked = labels.filter(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # narrow rows
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # at most `sample` rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({bucket(t) for t in tokens(x or "")}) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=[id_col, "grade", "buckets"])

    made = rows.mapInArrow(make, f"`{id_col}` {type_of(docs, id_col)}, grade int, buckets array<int>").groupBy(id_col).agg(F.min("grade").alias("grade"), F.min("buckets").alias("buckets"))
    # Documents of equal features and grade count once.
    same = F.md5(F.array_join(F.col("buckets").cast("array<string>"), ",")).alias("same")
    made = made.groupBy("grade", same).agg(F.max(id_col).alias("id"), F.first("buckets").alias("buckets"))
    made = materialise(made.select("id", "grade", "buckets"), "training")
    screened = materialise(_screened(made, screen), "screened")
    # Only what the screen lets through comes to the driver.
    some = made.select("id", F.explode("buckets").alias("bucket")).join(screened, "bucket").groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    got = made.select("id", "grade").join(some, "id", "left").toArrow().sort_by("id")
    return fit([np.array(x or [], np.int32) for x in got["buckets"].to_pylist()], got["grade"].to_numpy().astype(np.int64))


def _screened(made: DataFrame, screen: float) -> DataFrame:
    """(bucket): those whose presence depends on some split of the grades."""
    splits = range(1, GRADES)
    total, *ups = made.agg(F.count(F.lit(1)), *(F.count_if(F.col("grade") >= k) for k in splits)).first()
    least = min(screen, 3 * math.log(max(total, 1)))
    held = made.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.count_if(F.col("grade") >= k).cast("double").alias(f"up{k}") for k in splits))
    keep = F.lit(False)
    for k, up in zip(splits, ups):
        spread = F.col("n") * (total - F.col("n")) * float(up) * float(total - up)
        keep = keep | ((spread > 0) & (float(total) * F.pow(F.col(f"up{k}") * total - F.col("n") * up, F.lit(2.0)) > least * F.greatest(spread, F.lit(1e-9))))
    return held.filter(keep).select("bucket")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs(row, ...), row a struct with the text -> (row, expected_grade, tail_probability), the last of the top grade.  A null
    text counts as empty."""
    tune(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # of the screened buckets
    schema = T.StructType([docs.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    at = docs.schema["row"].dataType.names.index(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        known = weights.value
        for b in batches:
            tails = []
            for text in b.column(0).field(at):
                s = 0.0
                for t in tokens(text.as_py() or ""):
                    w = seen.get(t)
                    if w is None:
                        w = seen[t] = known.get(bucket(t), 0.0)
                    s += w
                tails.append(model.tails(round(s, 9)))
            if len(seen) > 500_000:
                seen.clear()
            expected, top = pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), expected, top], names=["row", "expected_grade", "tail_probability"])

    thresholds = model.thresholds
    model = Model({}, thresholds)  # the weights travel once
    return docs.select("row").mapInArrow(make, schema)


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SELECT, sample: int = SAMPLE) -> DataFrame:
    """(row, expected_grade, tail_probability) of the rows of docs that select_documents() selects; row has all their columns,
    whatever their names."""
    model = train(docs, labels.select(id_col, grade().alias("grade")), id_col, text_col, sample)
    return score(docs.select(packed(docs)), model, text_col).filter(F.col("tail_probability") >= least)


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SELECT, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose probability of the top grade reaches `least`, with expected_grade and tail_probability.  A
    probability of just `least` is selected.

    labels: id, quality (0 or 1), toxic (0 or 1); rows without either, and an empty table, teach nothing (then all
    documents stay).  Null texts count as empty, texts of any length are read whole, repeated rows each return, null ids
    take part, an empty table gives an empty result, and other columns stay as they are unless they bear the name of one of
    the two that are added, in any case, which then replace them; scored_rows() keeps these, too.
    """
    added = ("expected_grade", "tail_probability")
    found = scored_rows(docs, labels, id_col, text_col, least, sample)
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added), *added)
