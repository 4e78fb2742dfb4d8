"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import pieces, remainder, ship_code, text_of

#: Rows whose crc32(id as text) modulo FOLDS is HELD_OUT are never learnt from; those of CALIBRATION set the thresholds.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Most labelled rows and most bytes of text that the dictionaries and thresholds are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 9_000, 32 << 20
#: Bytes of the dictionary of all text, of the part that tells a class, and of a window.
COMMON_BYTES, CLASS_BYTES, WINDOW_BYTES = 16_384, 1_024, 48
#: Bytes saved by the toxic dictionary that count at most, and from which a window counts as toxic.
MOST_SAVED, TOXIC_SAVED = 8, 4
#: A word start tells a class if its documents times the log of their ratio reach this share of the toxic documents, and
#: this many at least; and its length in bytes.
TELLING, LEAST_TELLING, START_BYTES = 0.25, 15.0, 5
#: Log ratios from which a word start is toxic, or ordinary.
TOXIC_RATIO, ORDINARY_RATIO = 1.4, 0.4

_WORD = re.compile(rb"[A-Za-z\x80-\xff]{4,}")


def windows(text: bytes, size: int = WINDOW_BYTES) -> list[bytes]:
    """Consecutive windows of about `size` bytes of the lower-cased text, cut before a space where one is near."""
    text, found, start = text.lower(), [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.find(b" ", end, end + size // 2)
            end = space if space >= 0 else end
        found.append(text[start:end])
        start = end
    return found


def _words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary of at most `size` bytes; the samples themselves where they are too few to train on."""
    import zstandard

    cut = [s[i : i + 256] for s in samples for i in range(0, len(s), 256)]
    try:
        return zstandard.train_dictionary(size, cut, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(cut)[-size:]


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries, which share their common part, and the weights and threshold of the score."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    bias: float = 0.0

    def compressors(self):
        import zstandard

        made = []
        for content in (self.ordinary, self.toxic):
            params = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=2 * WINDOW_BYTES, dict_size=len(content), min_match=4, write_content_size=0, write_dict_id=0
            )
            words = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress)
        return made

    def features(self, text: bytes, compressors) -> np.ndarray:
        ordinary, toxic = compressors
        saved = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
        if not saved:
            return np.zeros(5)
        d = np.array(saved)
        counted = np.clip(d, 0, MOST_SAVED)
        top = np.sort(counted)[-3:].mean()
        return np.array([counted.mean(), (d >= TOXIC_SAVED).mean(), top, min(20.0, counted.sum()) / 4, np.log1p(len(d))])

    def score(self, text: bytes, compressors) -> float:
        if not self.weights:
            return 0.0
        z = float(np.dot(self.weights, self.features(text, compressors)) + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _telling(texts: list[tuple[bytes, int]]) -> dict[bytes, float]:
    """Log ratios of the word starts that tell toxic from ordinary documents."""
    counts, sizes = (Counter(), Counter()), [0, 0]
    for text, label in texts:
        counts[label].update({w[:START_BYTES] for w in _words(text)})
        sizes[label] += 1
    found = {}
    enough = max(LEAST_TELLING, TELLING * sizes[1])
    for start in set(counts[0]) | set(counts[1]):
        ordinary, toxic = counts[0][start], counts[1][start]
        ratio = float(np.log((toxic + 0.5) / (sizes[1] + 1)) - np.log((ordinary + 0.5) / (sizes[0] + 1)))
        if abs(ratio) * max(ordinary if ratio < 0 else toxic, 1) >= enough and toxic + ordinary >= 5:
            found[start] = ratio
    return found


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic regression, by Newton's method on scaled columns; rows count `each`."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (each * (p - y)) + ridge @ w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(texts: list[tuple[bytes, int, bool]], toxic_share: float = 0.5) -> ToxicityModel:
    """A model from (text, label, calibrates) rows; without both classes in each part it scores 0.

    The class part of a dictionary is trained on the words whose starts tell that class; the common part,
    on all text. Weights are fitted and the threshold is set on rows the dictionaries have not seen, weighted so
    that the classes have their share among all labelled rows (`toxic_share`). The threshold has the best F0.5,
    which counts a clean document that is rejected for more than a toxic one that is kept.
    """
    learnt, held = [(t, y) for t, y, c in texts if not c], [(t, y) for t, y, c in texts if c]
    if {y for _, y in learnt} != {0, 1} or {y for _, y in held} != {0, 1}:
        return ToxicityModel(b"", b"")
    telling = _telling(learnt)
    parts = []
    for label, sign, least in ((1, 1, TOXIC_RATIO), (0, -1, ORDINARY_RATIO)):
        words = ([w for w in _words(t) if telling.get(w[:START_BYTES], 0.0) * sign > least] for t, y in learnt if y == label)
        parts.append(_train(CLASS_BYTES, [b" " + b" ".join(w) for w in words if w]))
    common = _train(COMMON_BYTES, [t[:4096].lower() for t, _ in learnt])
    bare = ToxicityModel(common + parts[0], common + parts[1])
    compressors = bare.compressors()
    x = np.array([bare.features(t, compressors) for t, _ in held])
    y = np.array([label for _, label in held], float)
    each = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    weights, bias = _logistic(x, y, each)
    z = x @ weights + bias
    order = np.argsort(-z, kind="stable")
    hits, misses = np.cumsum((each * y)[order]), np.cumsum((each * (1 - y))[order])
    total = (each * y).sum()
    best = int(np.argmax(1.25 * hits / (1.25 * hits + 0.25 * (total - hits) + misses)))
    below = z[order[best + 1]] if best + 1 < len(y) else z[order[best]] - 1
    return ToxicityModel(bare.toxic, bare.ordinary, tuple(weights.tolist()), bias - float(z[order[best]] + below) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES):
    """At most `rows` labelled rows that may be learnt from, by a hash of their ids, within `most_bytes`; and the share
    of toxic ones among all. Single texts of over an eighth of `most_bytes` are not learnt from.

    A document with several labels counts as toxic if one says so; null ids and labels are left out. Rows that repeat an id
    and a text count once, so the bounds hold for what reaches the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder("doc_id", FOLDS) != HELD_OUT).withColumn("order", F.xxhash64("doc_id"))
    text = text_of()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash")).distinct()
    known = known.join(ids, "doc_id")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked: list[tuple[int, int, int]] = []
    held = 0
    for row in known.orderBy("order", "doc_id", "hash").limit(rows).collect():
        if row["size"] > most_bytes // 8:
            continue
        held += row["size"]
        if held > most_bytes:
            break
        picked.append((row["doc_id"], row["toxic"], row["hash"]))
    spark = docs.sparkSession
    small = spark.createDataFrame(picked, "doc_id long, toxic int, hash long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"))
    # Of rows that repeat an id and a text, one.
    once = texts.join(F.broadcast(small), ["doc_id", "hash"]).groupBy("doc_id", "hash", "toxic").agg(F.first("text").alias("text"))
    found = once.select("text", "toxic", (remainder("doc_id", FOLDS) == CALIBRATION).alias("c"), "doc_id")
    rows_ = sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["text"])))
    return [(bytes(r["text"]), r["toxic"], r["c"]) for r in rows_], share


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted`: how likely each whole text is toxic, one row per input row.

    `docs` needs doc_id and text, `labels` doc_id and toxic. The model is fitted on a bounded sample of
    labelled rows and sent to the tasks; every window of every text is compressed with both dictionaries.
    Only the text enters the score. Null and empty texts score as a text without windows. Without labels
    of both classes every score is 0. Other columns are ignored, repeated rows score alike.
    """
    model = fit(*labelled_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for piece in pieces(batches):
            scores = np.array([model.score(t or b"", compressors) for t in piece.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
    )
    return ship_code(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `toxicity_scores` does not predict to be toxic, each judged by its own text, with all columns."""
    model = fit(*labelled_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            at = batch.schema.names.index("text")
            for piece in pieces([batch], column=at):
                texts = piece.column(at).cast(pa.binary()).to_pylist()
                yield piece.filter(pa.array([model.score(t or b"", compressors) < 0.5 for t in texts], pa.bool_()))

    return ship_code(docs).mapInArrow(run, docs.schema)
