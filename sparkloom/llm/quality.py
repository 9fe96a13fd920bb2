"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of the whole text.

Each class has a mean and a covariance, shrunk towards the pooled covariance and that towards its diagonal. The score is the
logistic function of the difference of the classes' log densities: the Mahalanobis distances come from Cholesky factors that the
model keeps. Sums over the labelled rows (counts, sums and products of features by class) are made by Spark; all labelled rows
take part, and what reaches the driver has a fixed size.

Cases: a null or empty text has a score of its own, from its statistics like any other; rows that share a doc_id are scored one
by one; a label that occurs twice counts twice, a null one not; with labels of one class or none every score is that class's
share (1/2 without labels); an empty table gives an empty result; other columns than doc_id and text, quality are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, load, stash, texts, tidy

FEATURES = ("log_words", "word_length", "word_spread", "longest", "distinct", "repeats", "line_repeats", "top_word", "upper", "digits", "marks", "symbols", "shouts", "spaces", "letters_entropy", "line_words", "ends")
_symbol, _mark, _upper, _digit, _space = (np.zeros(256, bool) for _ in range(5))
_symbol[list(b"#*$%&|<>{}[]\\^~=_@")] = True
_mark[list(b".,;:!?'\"()-")] = True
_upper[65:91] = _digit[48:58] = True
_space[[9, 10, 11, 12, 13, 32]] = True


def _logit(part: float, whole: float) -> float:
    """A share's log odds, with half a case on either side."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one text, in the order of FEATURES."""
    words = Words(text)
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(counts.sum())
    lengths = (words.ends - words.starts) if n else np.zeros(1, np.int64)
    runs = words.runs(3)
    windows, first, times = np.unique(runs, return_index=True, return_counts=True) if len(runs) else (runs, runs, np.zeros(0, np.int64))
    repeated = int(times[times > 1].sum() - (times > 1).sum())
    ones, per = np.unique(words.runs(1), return_counts=True) if n else (np.zeros(0), np.zeros(1, np.int64))
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    letters = np.concatenate([counts[97:123] + counts[65:91], counts[128:]]).astype(float)
    share = letters[letters > 0] / max(letters.sum(), 1)
    shouts = sum(len(w) > 1 and w.isupper() for w in words.words)
    words_in_lines = np.array([len(x.split()) for x in lines] or [0])
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return np.array(
        [
            np.log1p(n),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            np.log1p(lengths.max()),
            _logit(len(ones), n),
            _logit(repeated, max(len(runs), 0)),
            _logit(len(lines) - len(set(lines)), len(lines)),
            _logit(int(per.max()), n),
            _logit(int(counts[_upper].sum()), size),
            _logit(int(counts[_digit].sum()), size),
            _logit(int(counts[_mark].sum()), size),
            _logit(int(counts[_symbol].sum()), size),
            _logit(shouts, n),
            _logit(int(counts[_space].sum()), size),
            float(-(share * np.log(share)).sum()) if len(share) else 0.0,
            np.log1p(words_in_lines.mean()),
            _logit(ends, len(lines)),
        ]
    )


def _features(batches):
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each text."""
    return texts(docs).mapInArrow(tidy(_features), "doc_id long, x array<double>")


def _moments(batches):
    """By class: the number of rows, the sum of (1, x) outer (1, x)."""
    d = len(FEATURES) + 1
    total = {}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(-1, d - 1)
        x = np.concatenate([np.ones((len(x), 1)), x], 1)
        y = batch.column("quality").to_numpy()
        for c in np.unique(y):
            total[int(c)] = total.get(int(c), 0) + x[y == c].T @ x[y == c]
    for c, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(m.reshape(-1))], ["quality", "place", "sum"])


class Discriminant:
    """Classes 0 and 1 by their mean, the Cholesky factor of the shrunk covariance, its log determinant and the log prior."""

    def __init__(self, sums: dict[int, np.ndarray], to_pooled: float = 0.1, to_diagonal: float = 0.05):
        self.share = sums[1][0, 0] / (sums[0][0, 0] + sums[1][0, 0]) if len(sums) == 2 else float(next(iter(sums), 0.5))
        self.classes = []
        if len(sums) < 2:
            return
        n = {c: m[0, 0] for c, m in sums.items()}
        means = {c: m[0, 1:] / m[0, 0] for c, m in sums.items()}
        scatter = {c: sums[c][1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in sums}
        pooled = sum(scatter.values()) / max(sum(n.values()) - 2, 1)
        pooled += np.diag(np.full(len(pooled), 1e-6) + 1e-3 * np.diag(pooled))
        for c in (0, 1):
            # a class of few rows leans more on the pooled covariance
            lean = (to_pooled * n[c] + len(pooled)) / (n[c] + len(pooled))
            cov = (1 - lean) * scatter[c] / max(n[c] - 1, 1) + lean * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[c], factor, 2 * np.log(np.diag(factor)).sum(), np.log(n[c] / sum(n.values()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        log = []
        for mean, factor, det, prior in self.classes:
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(prior - 0.5 * (det + (z * z).sum(0)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """labelled: x and quality (0 or 1). The driver gets two matrices, whatever the number of rows."""
    sums = labelled.select("x", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").mapInArrow(_moments, "quality int, place int, sum double")
    d = len(FEATURES) + 1
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("quality", "place").agg(F.sum("sum").alias("sum")).collect():
        out.setdefault(r.quality, np.zeros(d * d))[r.place] = r["sum"]
    return Discriminant({c: m.reshape(d, d) for c, m in out.items()})


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of rows of features()."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_query(spark, sf_dir):
    rows = stash(features(load(spark, sf_dir, "documents")), "features")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    model = fit(rows.join(labels, "doc_id"))
    out = score(rows, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
