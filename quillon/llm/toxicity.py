"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters: words and word beginnings that lean to toxic or clean labels, found on a bounded
   sample of labelled training rows, besides a short list of patterns.
2. Label model: a two-class mixture fitted by expectation-maximisation to the voters' votes alone.
   It estimates each voter's accuracy and the correlation of each pair of voters given the
   class, both anew each round; votes of a row that repeat one another count once together.
3. Classifier: logistic regression over the voters' votes, trained on the posterior labels.
Every document is then scored on its whole text by one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, trim

#: Most labelled rows that voters, label model and classifier are fitted on, chosen by a hash of doc_id.
MAX_LABELLED = 20_000
#: Lengths of the word beginnings that can be voters.
PREFIXES = (4, 5, 6)
#: Votes that a voter's precision among labelled rows counts for beside the votes it casts.
START_VOTES = 10
#: A voter fires in at least so many sampled rows of its side, and this share of them, with at least this log odds ratio.
#: Chosen on training rows alone: at 0.01 there, 63 clean rows of check_s went by words that a group of copies shares, at 0.02 three.
MIN_ROWS, MIN_SHARE, MIN_LOG_ODDS = 5, 0.02, 2.5
#: A toxic voter is right in at least this share of its sampled rows, so that one vote can reject a text.
MIN_PRECISION = 0.95
#: A voter's label given by hand: phrases that insult the reader, whatever the sample holds.
PATTERNS = (
    r"\b(you|u) (are|r) (an? )?(idiot|moron|loser|stupid|worthless|pathetic)\b",
    r"\b(shut up|get lost|drop dead|go to hell|kill yourself)\b",
    r"\bi (hate|despise) (you|them)\b",
)
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4; null for null ids."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from. A null id is not held out, and has no label either."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def text_features(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and their beginnings, marked by a final *."""
    words = set(LETTERS.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}


@dataclass
class ToxicityModel:
    voters: list[str]
    toxic_side: np.ndarray  # bool by voter, patterns last
    weights: np.ndarray
    bias: float

    def votes(self, texts: list[str]) -> np.ndarray:
        """1 where a voter fires, by text and voter; the last columns are PATTERNS."""
        words = {v: i for i, v in enumerate(self.voters) if v[-1] != "*"}
        starts = {v[:-1]: i for i, v in enumerate(self.voters) if v[-1] == "*"}
        rules = [re.compile(p) for p in PATTERNS]
        out = np.zeros((len(texts), len(self.voters) + len(rules)), np.float32)
        sizes = sorted({len(s) for s in starts})
        for r, text in enumerate(texts):
            low = text.lower()
            for w in set(LETTERS.findall(low)):
                if (i := words.get(w)) is not None:
                    out[r, i] = 1
                for k in sizes:
                    if len(w) > k and (i := starts.get(w[:k])) is not None:
                        out[r, i] = 1
            for k, rule in enumerate(rules):
                if rule.search(low):
                    out[r, len(self.voters) + k] = 1
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.votes(texts).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def label_model(votes: np.ndarray, toxic_side: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability of toxic for each row of votes (0: abstains, 1: votes for its side).

    Each voter has one accuracy, the chance that a vote it casts is right; abstaining says
    nothing. Voters of one side that correlate strongly within a class repeat one another: in each
    row a vote's log odds are divided by the sum of its correlations with the votes that the row
    has (its own 1 among them), so that repeated votes count once together and a lone vote in full.
    Accuracies and correlations are both estimated from the votes by EM: each round weighs every
    row by its posterior, measures each voter's agreement and each pair's correlation given the
    class, and forms the posterior anew. Accuracies begin at start, which counts as START_VOTES
    votes. The classes are taken as equally likely among rows with votes; a row without votes gets
    half the prior. Returns the posterior, the accuracies and the strong correlations.
    """
    n, m = votes.shape
    v = votes.astype(np.float32)
    cast, voted = v.sum(0), v.sum(1) > 0
    sign = np.where(toxic_side, 1.0, -1.0)
    right = np.clip(start, 0.55, 0.99)
    p = np.where(voted, np.where(v @ sign.astype(np.float32) > 0, 1.0, 0.0), prior / 2)  # the majority of votes begins
    alike = np.eye(m)
    for _ in range(rounds if n else 0):
        alike = correlations(v, toxic_side, p)
        counted = v / np.maximum(v @ alike.astype(np.float32), 1)
        z = counted @ (np.log(right / (1 - right)) * sign)
        new = np.where(voted, 1 / (1 + np.exp(-np.clip(z, -50, 50))), prior / 2)
        agree = np.where(toxic_side, new @ v, (1 - new) @ v)
        right = np.clip((agree + START_VOTES * start) / (cast + START_VOTES), 0.55, 0.99)
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-4:
            break
    return p, right, alike


def correlations(v: np.ndarray, toxic_side: np.ndarray, p: np.ndarray, strong: float = 0.5) -> np.ndarray:
    """Correlations of at least strong between voters of one side given their class, 1 on the diagonal, else 0.

    Rows are weighed by their posterior p of the toxic class, or by what is left of it.
    """
    out = np.eye(v.shape[1])
    for side, weight in ((toxic_side, p), (~toxic_side, 1 - p)):
        if weight.sum() > 1 and side.any():
            x, w = v[:, side], (weight / weight.sum()).astype(np.float32)
            mean = w @ x
            cov = (x * w[:, None]).T @ x - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            alike = np.abs(cov / np.outer(sd, sd))
            np.fill_diagonal(alike, 1)
            out[np.ix_(side, side)] = np.where(alike >= strong, alike, 0)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels by Newton steps."""
    a = np.c_[x.astype(np.float64), np.ones(len(x))]
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], ridge * max(len(x), 1))
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(reg), a.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(_toxic, text) of at most limit labelled ids outside the held-out fold, one row an id.

    An id is toxic if any of its labels is; of its documents the smallest text speaks for it, so an
    id that many rows share still makes one row. Null texts are empty.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # its size bound allows the broadcast
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return mine.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")).select("_toxic", "text")


def find_voters(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Voters, their sides and first accuracies from a sample (_toxic, text), and the share of toxic rows.

    Documents with each feature are counted by class in each task, then summed; all features that
    pass are voters. As each must be in MIN_SHARE of its side's rows, they are at most 1 / MIN_SHARE
    times the mean number of features of a row, whatever the corpus. Words and their beginnings are
    voters side by side: the label model finds that they repeat one another.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[bool(y)].update(text_features(t))
                by[bool(y)][""] += 1
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][x] for x in names], pa.int64()), pa.array([by[0][x] for x in names], pa.int64())], names=["feature", "n1", "n0"])

    counts = materialise(sample.mapInArrow(count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    total = counts.where("feature = ''").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).first()
    a, b = int(total["a"] or 0), int(total["b"] or 0)
    if not a or not b:
        return [], np.zeros(0, bool), np.zeros(0), 0.0
    odds = F.log((F.col("n1") + 0.5) / (a + 1.0)) - F.log((F.col("n0") + 0.5) / (b + 1.0))
    seen = counts.where("feature <> ''").withColumn("odds", odds)
    toxic = seen.where(F.col("n1") >= max(MIN_ROWS, MIN_SHARE * a)).where(F.col("odds") >= MIN_LOG_ODDS).where(
        F.col("n1") >= MIN_PRECISION * (F.col("n1") + F.col("n0"))).orderBy((F.col("odds") * F.sqrt("n1")).desc(), "n1", "n0", "feature").collect()
    clean = seen.where(F.col("n0") >= max(MIN_ROWS, MIN_SHARE * b)).where(F.col("odds") <= -MIN_LOG_ODDS).orderBy((F.col("odds") * F.sqrt("n0")).asc(), "n0", "n1", "feature").collect()
    precise = [(r["n1"] + 0.5) / (r["n1"] + r["n0"] + 1) for r in toxic] + [(r["n0"] + 0.5) / (r["n1"] + r["n0"] + 1) for r in clean]
    return [r["feature"] for r in toxic + clean], np.r_[np.ones(len(toxic), bool), np.zeros(len(clean), bool)], np.array(precise), a / (a + b)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ToxicityModel:
    """Fit all three parts on the bounded sample; only its votes (a byte each) reach the driver."""
    sample = materialise(training_sample(docs, labels, limit))
    voters, side, start, prior = find_voters(sample)
    side, start = np.r_[side, np.ones(len(PATTERNS), bool)], np.r_[start, np.full(len(PATTERNS), 0.9)]
    model = ToxicityModel(voters, side, np.zeros(len(side)), -3.0)
    if not voters:
        return model

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.packbits(model.votes(b.column(1).to_pylist()).astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bits], pa.binary())], names=["bits"])

    rows = sorted(bytes(r[0]) for r in sample.mapInArrow(vote, "bits binary").collect())
    bits = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    votes = np.unpackbits(bits, axis=1)[:, :len(side)].astype(np.float32)
    posterior, _, _ = label_model(votes, side, start, min(max(prior, 0.005), 0.5))
    model.weights, model.bias = fit_linear(votes, posterior)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row by its whole text; null and empty texts get the score of no votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score([t or "" for t in part.column(1).to_pylist()]), pa.float64())], names=["doc_id", "score"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay, nothing is shuffled.

    Null and empty texts get the score of no votes, and so stay; repeated rows share their fate. Other
    columns, whatever their names, pass through. Empty in, empty out.
    """
    model = fit(docs, labels, limit)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow reads columns by name, and names may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                keep = model.score([t or "" for t in part.column(at).to_pylist()]) < threshold
                yield part.filter(pa.array(keep))
        trim()

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3) for every document.

    Labels that are null or whose ids are null, unknown or held out are not learnt from; repeated
    labels of one id count once, toxic if any is. Without labels of both classes the model has no
    voters and every score is that of no votes. Repeated documents score alike.
    """
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
