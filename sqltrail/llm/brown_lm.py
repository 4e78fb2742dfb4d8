"""Class-based bigram model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import pieces, remainder, ship_code, stored

#: Rows whose crc32(id as text) modulo FOLDS is HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 7, 2
#: Most frequent words that the exchange assigns to CLASSES classes.
CLUSTERED, CLASSES, SWEEPS = 1_000, 100, 6
#: Other sent words with this count at least come to these classes in so many rounds; the rest have classes by shape.
LEAST_LEARNT, ROUNDS = 10, 2
#: Most frequent words whose counts are sent to all tasks, and so the bound of what is sent; counts of others are joined.
SENT_WORDS = 200_000
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 500_000
#: Weight of the class frequencies in a transition.
PRIOR = 20.0
SHAPES = 32


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def shape(word: bytes) -> int:
    """A class for words outside the clustering: final punctuation, letters outside ASCII, digits, length."""
    digits = len(word.translate(None, b"0123456789")) < len(word)
    size = min(3, (len(word) - 1) // 4)
    return (word[-1] in b".,;:!?") + 2 * (not word.isascii()) + 4 * digits + 8 * size


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return made

    for piece in pieces(batches, column=0):
        for text in piece.column(0).to_pylist():
            held.update(tokens(text or b""))
        if len(held) > HELD_WORDS:
            yield flush()
    yield flush()


def _f(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit: the first `clustered` units are words to assign, each of the others is a class of its own.

    `pairs[a, b]` counts unit b after unit a. Words start in classes by rank; then each in turn is moved to the
    class that raises the likelihood of the class bigrams most, until a sweep moves none.
    """
    units = len(pairs)
    classes = max(1, min(classes, clustered))
    at = np.concatenate([np.arange(clustered) % classes, classes + np.arange(units - clustered)]).astype(np.int64)
    total = classes + units - clustered
    pairs = pairs.astype(np.float64)
    right, left = pairs.sum(1), pairs.sum(0)
    # Counts of a unit with each class, before and after it; and of classes with classes.
    after, before = np.zeros((units, total)), np.zeros((units, total))
    np.add.at(after.T, at, pairs.T)
    np.add.at(before.T, at, pairs)
    matrix = np.zeros((total, total))
    np.add.at(matrix, at, after)
    heads, tails = matrix.sum(1), matrix.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            k, own = at[w], pairs[w, w]
            r, l = after[w].copy(), before[w].copy()
            r[k] -= own
            l[k] -= own
            matrix[k] -= r
            matrix[:, k] -= l
            matrix[k, k] -= own
            heads[k] -= right[w]
            tails[k] -= left[w]
            rows, cols = matrix[:classes], matrix[:, :classes].T
            i = np.arange(classes)
            nr, nl = np.nonzero(r)[0], np.nonzero(l)[0]
            gain = (_f(rows[:, nr] + r[nr]) - _f(rows[:, nr])).sum(1) + (_f(cols[:, nl] + l[nl]) - _f(cols[:, nl])).sum(1)
            same = rows[i, i]
            gain += _f(same + r[i] + l[i] + own) + _f(same) - _f(same + r[i]) - _f(same + l[i])
            gain -= _f(heads[i] + right[w]) - _f(heads[i]) + _f(tails[i] + left[w]) - _f(tails[i])
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[k] + 1e-9 else k
            matrix[best] += r
            matrix[:, best] += l
            matrix[best, best] += own
            heads[best] += right[w]
            tails[best] += left[w]
            if best != k:
                moved += 1
                at[w] = best
                after[:, k] -= pairs[:, w]
                after[:, best] += pairs[:, w]
                before[:, k] -= pairs[w]
                before[:, best] += pairs[w]
        if not moved:
            break
    return at


@dataclass
class _Words:
    """What every task holds: the sent words with their numbers and counts; bounded by SENT_WORDS."""

    index: dict[bytes, int]
    counts: np.ndarray


#: Numbers of words: from 0 on the sent words, by rank; below, a word by its shape, and the end of a text. Tables by number
#: hold the sent words, the end and the shapes backwards, so that numbers below 0 find their place from the table's end.
END = -SHAPES - 1


def _table(sent: np.ndarray, end, shapes: np.ndarray) -> np.ndarray:
    return np.concatenate([sent, [end], shapes[::-1]])


def _numbered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.index.get
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for piece in pieces(batches):
            numbers, rests = [], []
            for text in piece.column(1).to_pylist():
                words = tokens(text or b"")
                found = [get(w, END) for w in words]
                rest: Counter = Counter()
                for i, number in enumerate(found):
                    if number == END:
                        found[i] = -1 - shape(words[i])
                        rest[words[i]] += 1
                found.append(END)
                numbers.append(np.array(found, "<i4").tobytes())
                rests.append([{"word": w, "n": n} for w, n in rest.items()])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(numbers, pa.binary()), pa.array(rests, kind)], ["doc_id", "held_out", "numbers", "rest"]
            )

    return run


def _pair_counter(shared, units: int, learnt: int):
    """Counts of pairs of units, as `before * units + after`; beyond units squared, those of learnt words with units.

    `shared` holds the unit of each number, and for each number a learnt word's place or -1. A learnt word's pairs are
    told by place, then by side: the unit after the word, then the unit before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, places = shared.value
        held = np.zeros(units * units, np.int64)
        for piece in pieces(batches, column=0):
            number = np.frombuffer(b"".join(piece.column(0).to_pylist()), "<i4")
            unit = kinds[number].astype(np.int64)
            held += np.bincount(np.concatenate([[units - 1], unit[:-1]]) * units + unit, minlength=units * units)
            if learnt:
                place = places[number]
                at = np.nonzero(place >= 0)[0]
                # A word is never last, as an end follows it.
                after = (place[at] * 2) * units + unit[at + 1]
                before = (place[at] * 2 + 1) * units + np.where(at > 0, unit[at - 1], units - 1)
                pair, n = np.unique(np.concatenate([after, before]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(units * units + pair), pa.array(n.astype(np.int64))], ["pair", "n"])
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["pair", "n"])

    return run


def _assigner(gains: np.ndarray):
    """The best class of each learnt word, from its counts with units after and before it and the logs in `gains`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lists = part.column(1)
                rows = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                found = lists.flatten()
                counts = np.zeros((part.num_rows, len(gains)))
                counts[rows, found.field("at").to_numpy()] = found.field("n").to_numpy()
                best = np.argmax(counts @ gains, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int64))], ["place", "class"])

    return run


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, moves, emits, base = shared.value
        for piece in pieces(batches, column=2):
            raw = piece.column(2).to_pylist()
            if not raw:
                continue
            number = np.frombuffer(b"".join(raw), "<i4")
            sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
            starts = np.cumsum(sizes) - sizes
            kind = kinds[number]
            model = moves[np.concatenate([[len(moves) - 1], kind[:-1]]), kind] + emits[number]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    piece.column(3),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(number >= 0, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(base[number], starts)),
                    pa.array(np.add.reduceat(model, starts)),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_sent", "base_logs", "model_logs"],
            )

    return run


def least_sent(counts: DataFrame, most: int = SENT_WORDS) -> int:
    """The least count whose words and all more frequent ones are `most` at most, from a histogram of the counts.

    Counts are binned in bounded steps: first by their number of binary digits, then within one such bin by 1,024ths of it.
    """
    low, high, above = 1, 1 << 62, 0
    while True:
        # The words with counts from `low` up to `high`, `above` of which are known to be sent.
        step = max(1, -(-(high - low) // 1024))
        bins = F.col("n").between(low, high - 1)
        binned = F.floor(F.log2("n")) if (low, high) == (1, 1 << 62) else F.floor((F.col("n") - low) / step)
        found = counts.where(bins).groupBy(binned.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if above + row["words"] > most:
                first = 1 << row["bin"] if (low, high) == (1, 1 << 62) else low + row["bin"] * step
                after = first * 2 if (low, high) == (1, 1 << 62) else min(high, first + step)
                break
            above += row["words"]
        else:
            return low
        if after - first == 1:
            return after
        low, high = first, after


def _as_bytes(column: str) -> Column:
    return F.col(column).cast("binary").alias("text")


@dataclass
class ClassModel:
    """Classes and log10 probabilities; `kinds`, `emits` and `base` are tables by number (see END).

    Classes from `first_shape` on are shapes, and the last one is the end. Words with a class by shape that are not
    sent are emitted by what `emits` says times one more than their count.
    """

    words: _Words
    kinds: np.ndarray
    first_shape: int
    moves: np.ndarray
    emits: np.ndarray
    base: np.ndarray


def training_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, _Words, DataFrame, int]:
    """The rows as numbers, stored; the training rows' numbers; the sent words; all counts, stored; the least count sent."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _as_bytes("text"), (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    )
    training = ship_code(rows.where("NOT held_out").select("text"))
    counts = stored(training.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least = least_sent(counts)
    sent = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = _Words({w: i for i, w in enumerate(sent["word"].to_pylist())}, sent["n"].to_numpy())
    schema = "doc_id long, held_out boolean, numbers binary, rest array<struct<word: binary, n: long>>"
    numbered = ship_code(rows).mapInArrow(_numbered(docs.sparkSession.sparkContext.broadcast(words)), schema)
    numbered = stored(numbered.withColumn("row", F.monotonically_increasing_id()))
    return numbered, numbered.where("NOT held_out").select("numbers"), words, counts, least


def fit_classes(training: DataFrame, words: _Words, counts: DataFrame, least: int) -> ClassModel:
    """Classes by exchange over the most frequent words, then by rounds for all others that are frequent enough.

    In a round, the classes before and after each such word are counted over all training rows; each word then goes
    to the class that makes them likeliest. All words move at once, in tasks by word; classes come to the driver, one
    number for each sent word.
    """
    context = training.sparkSession.sparkContext
    ordered = list(words.index)
    clustered = min(CLUSTERED, len(ordered))
    learnt = int(np.searchsorted(-words.counts, -LEAST_LEARNT, side="right"))
    learnt = max(0, learnt - clustered) if ROUNDS else 0
    shapes = np.array([shape(w) for w in ordered], np.int64)

    def counted(kinds: np.ndarray, units: int, asked: int) -> DataFrame:
        places = np.full(len(ordered) + SHAPES + 1, -1, np.int64)
        places[clustered : clustered + asked] = np.arange(asked)
        shared = context.broadcast((kinds, places))
        return training.mapInArrow(_pair_counter(shared, units, asked), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def matrix_of(pairs: DataFrame, units: int) -> np.ndarray:
        # Bounded by the units, not by the corpus.
        found = pairs.where(F.col("pair") < units * units).toArrow()
        matrix = np.zeros(units * units)
        matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
        return matrix.reshape(units, units)

    def table(of_sent: np.ndarray, first_shape: int) -> np.ndarray:
        return _table(of_sent, first_shape + SHAPES, first_shape + np.arange(SHAPES))

    def moves_of(matrix: np.ndarray) -> np.ndarray:
        size = matrix.sum(0)
        share = (size + 1) / (size.sum() + len(size))
        return np.log10((matrix + PRIOR * share) / (matrix.sum(1, keepdims=True) + PRIOR))

    of_sent = np.where(np.arange(len(ordered)) < clustered, np.arange(len(ordered)), clustered + shapes)
    units = clustered + SHAPES + 1
    pairs = matrix_of(counted(table(of_sent, clustered), units, 0), units)
    at = exchange(pairs, clustered, CLASSES, SWEEPS)
    of_sent = at[of_sent]
    classes = max(1, min(CLASSES, clustered))
    units = classes + SHAPES + 1
    matrix = np.zeros((units, units))
    np.add.at(matrix, (at[:, None], at[None, :]), pairs)
    for _ in range(ROUNDS if learnt else 0):
        found = stored(counted(table(of_sent, classes), units, learnt))
        matrix = matrix_of(found, units)
        # Unit after a word of each class, and unit before it.
        gains = np.concatenate([moves_of(matrix)[:classes].T, moves_of(matrix.T)[:classes].T])
        side = F.col("pair") - units * units
        # A word has two counts a unit at most.
        around = found.where(side >= 0).groupBy(F.floor(side / (2 * units)).alias("place")).agg(
            F.collect_list(F.struct((side % (2 * units)).alias("at"), "n")).alias("around")
        )
        best = ship_code(around).mapInArrow(_assigner(gains), "place long, class long").toArrow()
        of_sent[clustered + best["place"].to_numpy()] = best["class"].to_numpy()
    if learnt:
        matrix = matrix_of(counted(table(of_sent, classes), units, 0), units)

    size = matrix.sum(0)
    by_shape = np.zeros(SHAPES)
    tallied = counts.select("word", F.lit(1).cast("long").alias("n")).mapInArrow(_shapes, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n"))
    for row in tallied.collect():
        by_shape[row["shape"]] = row["n"]
    by_class = np.arange(len(ordered)) < clustered + learnt
    by_shape -= np.bincount(shapes[by_class], minlength=SHAPES)
    of_shape = -np.log10(size[classes : classes + SHAPES] + by_shape + 1)
    logs = np.log10(words.counts + 1.0)
    emits = logs + of_shape[shapes]
    emits[by_class] = np.log10(words.counts[by_class] / size[of_sent[by_class]])
    none = np.zeros(SHAPES)
    return ClassModel(words, table(of_sent, classes), classes, moves_of(matrix), _table(emits, 0.0, of_shape), _table(logs, 0.0, none))


def class_model_scores(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`, one row per input row.

    Words and one end per text are counted over all training rows. The CLUSTERED most frequent words are
    assigned to classes by exchange over their bigram counts; other sent words that occur LEAST_LEARNT times come to
    the same classes by the classes around them, in ROUNDS rounds; the rest, and unknown words, have the class of
    their shape, and the end is a class. `score` is the sum of log10 of P(class | class before) * P(word | class):
    transitions are smoothed by class frequencies, words with a class by shape by one count for each known
    word and one for all unknown ones. `base_score` is the add-one unigram score.

    Counts of the most frequent words, SENT_WORDS at most, go to all tasks; counts of rarer words are joined to
    the distinct words of each text, so vocabularies of any size are scored alike. Texts are cut into words twice;
    after that they are numbers, stored.

    Null and empty texts hold an end only. A null id belongs to the training rows. Without training rows
    all counts are zero. Repeated rows count and score each. Other columns are ignored.
    """
    numbered, training, words, counts, least = training_rows(docs)
    ends = training.count()
    totals = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, known_words = totals[1] + ends, totals[0] + (ends > 0)
    model = fit_classes(training, words, counts, least)

    shared = docs.sparkSession.sparkContext.broadcast((model.kinds, model.moves, model.emits, model.base))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_sent long, base_logs double, model_logs double"
    scored = ship_code(numbered.select("doc_id", "held_out", "numbers", "row")).mapInArrow(_scorer(shared), schema)
    rest = numbered.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    rare = counts.where(F.col("n") < least)
    joined = rest.join(rare, "word", "inner").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("known")
    )
    out = scored.join(joined, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    end_known, end_log = (1, float(np.log10(ends + 1)))
    scale = float(np.log10(train_tokens + known_words + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_sent") + F.coalesce("known", F.lit(0)) + F.lit(end_known if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_logs") + logs + F.lit(end_log) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("model_logs") + logs).alias("score"),
    )


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(SHAPES, np.int64)
    for batch in batches:
        held += np.bincount([shape(w) for w in batch.column(0).to_pylist()], minlength=SHAPES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(held)], ["shape", "n"])
