"""Quality by compression: dictionaries of good and bad text, and how much better one of them compresses.

1. Dictionaries: zstandard trains one on pieces of texts labelled good, one on pieces labelled bad, from a
   bounded sample of labelled training rows.
2. Difference: every piece of a text is compressed with either dictionary; the sum of the differences in
   size over the text's bytes says which kind of text it is made of.
3. Calibration: logistic regression on the difference of labelled rows, each measured with dictionaries that
   its own fold did not train.
Every document is then scored on its whole text by one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, trim

#: Most labelled rows that dictionaries and calibration are fitted on, chosen by a hash of doc_id.
MAX_LABELLED = 20_000
#: Most pieces of one class that its dictionaries are trained on, chosen by a hash of document and place.
MAX_PIECES = 16_384
#: Bytes of a piece, which is compressed on its own so that long texts do not become their own dictionary.
PIECE_BYTES = 1024
#: Bytes of a dictionary; compression level.
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Bytes that are added to a text's length, so that short texts get no extreme differences.
PRIOR_BYTES = 128
#: Parts of the labelled rows; each is measured with dictionaries of the others for the calibration.
FOLDS = 3
THRESHOLD = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text is 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def train(samples: list[bytes]) -> bytes:
    """A dictionary for texts like samples; too few for the trainer, they are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=4 * FOLDS)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = dictionary[:4] == b"\x37\xa4\x30\xec"  # the format's mark of a trained dictionary
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Bytes that the good dictionary saves against the bad one, per byte of each whole text; 0 without text."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        own = pieces(text)
        saved = sum(len(by_bad(p)) - len(by_good(p)) for p in own)
        out[i] = saved / (sum(map(len, own)) + PRIOR_BYTES)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and bias of P(good | x). Labels count as slightly uncertain, which keeps separable ones finite.

    Newton steps, each halved until the loss does not rise.
    """
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    soft = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.c_[x / (np.abs(x).mean() + 1e-12), np.ones(len(x))]
    loss = lambda w: np.sum(np.logaddexp(0, a @ w) - soft * (a @ w))
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (soft - p))
        before = loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / (np.abs(x).mean() + 1e-12)), float(w[1])


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; without dictionaries of both classes the same for all texts."""
        x = differences(texts, self.good, self.bad) if self.good and self.bad else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -50, 50)))


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good, fold, text) of at most limit labelled ids outside the held-out fold, one row an id.

    An id is bad if any of its labels is; of its documents the smallest text speaks for it. Equal texts
    are in one fold, so that no copy is measured with a dictionary that its like has trained.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # its size bound allows the broadcast
    mine = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = mine.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    return one.select(F.col("doc_id").cast("string").alias("doc_id"), "good", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def training_pieces(sample: DataFrame, limit: int = MAX_PIECES) -> DataFrame:
    """(good, fold, place, piece) of at most limit pieces of each class, in the order of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, good, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                own = pieces(text)
                place = [blake2b(f"{name}/{k}".encode(), digest_size=8).hexdigest() for k in range(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array([good] * len(own), pa.bool_()), pa.array([fold] * len(own), pa.int32()), pa.array(place, pa.string()),
                                                  pa.array(own, pa.binary())], names=["good", "fold", "place", "piece"])

    every = sample.mapInArrow(run, "good boolean, fold int, place string, piece binary")
    return every.where("good").orderBy("place", "piece").limit(limit).unionByName(every.where("not good").orderBy("place", "piece").limit(limit))


def dictionaries(some: DataFrame) -> dict[tuple[int, bool], bytes]:
    """By the fold that is left out (-1: none) and the class, a dictionary; each is trained by a task of its own."""

    def run(key, t):
        t = t.sort_by([("place", "ascending"), ("piece", "ascending")])
        return pa.table({"out": [key[0].as_py()], "good": [key[1].as_py()], "dictionary": pa.array([train(t.column("piece").to_pylist())], pa.binary())},
                        schema=pa.schema([("out", pa.int32()), ("good", pa.bool_()), ("dictionary", pa.binary())]))

    without = F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)]))
    dealt = some.select("good", "fold", "place", "piece", without.alias("out")).where("out <> fold")
    found = dealt.groupBy("out", "good").applyInArrow(run, "out int, good boolean, dictionary binary").collect()
    return {(r["out"], r["good"]): bytes(r["dictionary"]) for r in found}


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> QualityModel:
    """Dictionaries and calibration from the bounded sample; the driver sees dictionaries and one number a sampled row."""
    sample = materialise(training_sample(docs, labels, limit))
    known = dictionaries(materialise(training_pieces(sample)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, fold, text = (b.column(k).to_pylist() for k in (1, 2, 3))
            x = [differences([t], *(known.get((f, side), known[-1, side]) for side in (True, False)))[0] for f, t in zip(fold, text)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(good, pa.bool_())], names=["x", "good"])

    shares = sample.agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b")).first()
    model = QualityModel(known.get((-1, True), b""), known.get((-1, False), b""), 0.0, float(np.log((shares["a"] + 1) / (shares["b"] + 1))))
    if model.good and model.bad:
        rows = np.array(sorted((r["x"], float(r["good"])) for r in sample.mapInArrow(measure, "x double, good boolean").collect()))
        model.slope, model.bias = calibrate(rows[:, 0], rows[:, 1])
    return model


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row by its whole text; null and empty texts get the score of no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])
        trim()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """docs whose score is threshold or more; all columns stay, nothing is shuffled.

    Null and empty texts get the score of no difference; repeated rows share their fate. Other columns,
    whatever their names, pass through. Empty in, empty out.
    """
    model = fit(docs, labels, limit)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow reads columns by name, and names may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) >= threshold))
        trim()

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every document.

    Labels that are null or whose ids are null, unknown or held out are not learnt from; repeated labels
    of one id count once, bad if any is. Null and empty texts are scored as texts without a difference.
    Without labels of both classes all documents get the smoothed share of good labels (1/2 without any).
    Texts of any length are read to their end, a piece at a time; repeated documents score alike. Empty
    in, empty out; other columns are not read.
    """
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
