"""I-Match fingerprints: terms within a band of inverse document frequency, hashed over random parts of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqltrail.llm.common import in_map, slot_map, slot_of, stored, text_of

#: Share of documents that a term of the lexicon occurs in, from and to (an idf of about 2.3 to 6.2).
LEAST_SHARE, MOST_SHARE = 0.002, 0.1
#: Slots that terms are hashed to. Terms in one slot share their document frequency, so the lexicon has a fixed size.
SLOTS = 1 << 20
#: Random parts of the lexicon, and terms of a text that should fall into each.
PARTS, TERMS = 32, 1.5
#: Times that the whole lexicon is dealt into two wide parts, so that each term of a text is in one part of each deal.
WIDE_DEALS = 2
#: Bits of a part's hash; a part without terms of the text has no hash (-1).
BITS = 16


def terms_of(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _slot(term: Column) -> Column:
    return slot_of(term, slots=SLOTS)


def lexicon(docs: DataFrame, text_col: str = "text") -> Column:
    """The map of slots whose document frequency lies in the band, counted over all rows."""
    slots = docs.select(F.explode_outer(F.array_distinct(F.transform(terms_of(text_of(text_col)), _slot))).alias("slot"))
    n = docs.count()
    return slot_map(slots.groupBy("slot").count().where(F.col("count").between(n * LEAST_SHARE, n * MOST_SHARE) & F.col("slot").isNotNull()).select("slot"), SLOTS, literal=True)


def _level(terms: str) -> Column:
    """How often the lexicon is halved, so that a part of it holds about TERMS of the text's terms."""
    return F.greatest(F.lit(0), F.round(F.log2(F.greatest(F.size(terms), F.lit(1)) / TERMS))).cast("int")


def _dealt(terms: str, level: Column) -> Column:
    """(part, term) for the terms that fall into one of the PARTS parts.

    At a level the lexicon is dealt into 2^level cells. With more cells than parts, the first are the parts;
    with fewer, the lexicon is dealt several times, each time anew.
    """
    return F.filter(
        F.flatten(
            F.transform(
                terms,
                lambda t: F.transform(
                    F.sequence(F.lit(0), F.greatest(F.lit(1), F.call_function("shiftright", F.lit(PARTS), level)) - 1),
                    lambda r: F.struct(
                        (F.call_function("shiftleft", r, level) + F.pmod(F.xxhash64(t, r), F.call_function("shiftleft", F.lit(1).cast("long"), level))).alias("part"),
                        t.alias("term"),
                    ),
                ),
            )
        ),
        lambda p: p["part"] < PARTS,
    )


def _hashes(dealt: str) -> Column:
    """For each part the hash of its terms, which are sorted."""

    def of(part: Column) -> Column:
        own = F.transform(F.filter(F.col(dealt), lambda p: p["part"] == part), lambda p: p["term"])
        return F.when(F.exists(dealt, lambda p: p["part"] == part), F.pmod(F.xxhash64(own), F.lit(1 << BITS)).cast("int")).otherwise(-1)

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), of)


def _wide_hashes(terms: str, text: str) -> Column:
    """For each half of each deal of the whole lexicon the hash of its terms; hashes of the text itself where it has none."""

    def of(deal: int, half: int) -> Column:
        own = F.filter(terms, lambda t: F.getbit(F.xxhash64(t, F.lit("wide")), F.lit(deal)) == half)
        return F.when(F.size(own) > 0, F.pmod(F.xxhash64(own), F.lit(1 << BITS)).cast("int")).otherwise(-1)

    halves = [(deal, half) for deal in range(WIDE_DEALS) for half in (0, 1)]
    own = [F.pmod(F.xxhash64(text, F.lit(i)), F.lit(1 << BITS)).cast("int") for i in range(len(halves))]
    return F.when(F.size(terms) > 0, F.array(*[of(*h) for h in halves])).otherwise(F.array(*own))


def with_fingerprint(df: DataFrame, terms: str, text: str, name: str) -> DataFrame:
    """`df` with the struct `name`: level, the hashes of the parts at that level and the next, and of the wide parts.

    `terms` is an array of distinct terms of the lexicon in `text`, in order; both columns are dropped.
    """
    low, high = f"{name}_low", f"{name}_high"
    out = df.withColumns({f"{name}_level": _level(terms)})
    out = out.withColumns({low: _dealt(terms, F.col(f"{name}_level")), high: _dealt(terms, F.col(f"{name}_level") + 1)})
    made = F.struct(F.col(f"{name}_level").alias("level"), F.size(terms).alias("terms"), _hashes(low).alias("low"), _hashes(high).alias("high"), _wide_hashes(terms, text).alias("wide"))
    return out.withColumn(name, made).drop(low, high, f"{name}_level", terms, text)


def as_text(print_: Column) -> Column:
    """A fingerprint as text: level, then the parts' hashes, the wide ones last, `----` where a part has no term."""
    digits = lambda hashes: F.array_join(F.transform(hashes, lambda h: F.when(h < 0, "----").otherwise(F.lpad(F.lower(F.hex(h)), 4, "0"))), "")
    return F.concat_ws(":", print_["level"].cast("string"), digits(print_["low"]), digits(print_["high"]), digits(print_["wide"]))


def likeness(one: Column, two: Column) -> Column:
    """Share of equal hashes among the parts that hold terms of either text, at a level both have.

    The wide parts count at every level, so a difference in any term shows. Texts whose numbers of terms are further
    apart than two levels share none and have 0. Equal fingerprints have 1; without any term, those of equal texts.
    """

    def share(x: Column, y: Column) -> Column:
        some = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] >= 0) | (p["y"] >= 0)))
        same = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] >= 0) & (p["x"] == p["y"])))
        return F.when(some > 0, same / some).otherwise(0.0)

    parts = lambda print_, level: F.concat(print_[level], print_["wide"])
    return (
        F.when(one == two, 1.0)
        .when((one["terms"] == 0) | (two["terms"] == 0), 0.0)
        .when(one["level"] == two["level"], (share(parts(one, "low"), parts(two, "low")) + share(parts(one, "high"), parts(two, "high"))) / 2)
        .when(one["level"] + 1 == two["level"], share(parts(one, "high"), parts(two, "low")))
        .when(one["level"] == two["level"] + 1, share(parts(one, "low"), parts(two, "high")))
        .otherwise(0.0)
    )


def _neighbours(keys: DataFrame) -> DataFrame:
    """`id, mark, next_id, next_mark, before_id, before_mark, before_chars`: each document's next by descending id.

    Ids are dealt to tasks by ranges; the ends of the ranges, two rows of each task, are then joined up.
    """
    order = [F.desc_nulls_last("id"), F.asc("mark")]
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    own = W.partitionBy("range").orderBy(*order)
    row = F.struct("id", "mark", "chars")
    linked = dealt.select("range", row.alias("own"), F.lead(row).over(own).alias("next"), F.lag(row).over(own).alias("before"))
    ends = linked.groupBy("range").agg(
        F.max(F.when(F.col("before").isNull(), F.col("own"))).alias("head"), F.max(F.when(F.col("next").isNull(), F.col("own"))).alias("tail")
    )
    # One row for each range.
    ranged, all_ = W.orderBy("range"), W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("head").over(ranged), F.first("head").over(all_)).alias("next_head"),
        F.coalesce(F.lag("tail").over(ranged), F.last("tail").over(all_)).alias("tail_before"),
    )
    joined = linked.join(ends, "range")
    next_, before = F.coalesce("next", "next_head"), F.coalesce("before", "tail_before")
    return joined.select(
        F.col("own.id").alias("id"), F.col("own.mark").alias("mark"), F.col("own.chars").alias("chars"),
        next_["id"].alias("next_id"), next_["mark"].alias("next_mark"),
        before["id"].alias("before_id"), before["mark"].alias("before_mark"), before["chars"].alias("before_chars"),
    )


_NO_ID = -(2**63)


def imatch_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fingerprint` for every row: equal texts have equal fingerprints, and `likeness` compares two.

    Null is the empty text. A text without terms of the lexicon has hashes of itself.
    """
    words = lexicon(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), terms_of(text_of(text_col)).alias("all_terms"))
    kept = rows.select("doc_id", "text", F.array_sort(F.filter("all_terms", lambda t: in_map(words, _slot(t)))).alias("terms"))
    return with_fingerprint(kept, "terms", "text", "fingerprint")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`, one row per input row.

    A text is compared with an edited one, whose last third is replaced by the beginning of the next document's
    text, and with the next document's, by descending id (null last, then by a hash of the text). The last
    document is followed by the first, and so is a single one by itself. Rows that repeat an id and a text count
    as one document in that order and have equal results. Null is the empty text. Other columns are ignored.
    """
    words = lexicon(docs)
    text = text_of()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.char_length(text).alias("chars"))
    order = _neighbours(keys.groupBy("id", "mark").agg(F.max("chars").alias("chars")))
    order = stored(order.withColumns({c: F.coalesce(c, F.lit(_NO_ID)) for c in ("id", "next_id", "before_id")}))

    texts = rows.join(order, ["id", "mark"])
    heads = texts.select(
        F.col("before_id").alias("id"), F.col("before_mark").alias("mark"), F.expr("substring(text, 1, CAST(before_chars div 3 AS INT))").alias("head")
    )
    # One of the rows that repeat an id and a text; the join below uses the same order of rows.
    heads = heads.withColumn("n", F.row_number().over(W.partitionBy("id", "mark").orderBy("id", "mark"))).where("n = 1").drop("n")
    both = texts.join(heads, ["id", "mark"]).select(
        "id", "mark", "next_id", "next_mark", "chars", "text",
        F.concat(F.expr("substring(text, 1, chars - CAST(chars div 3 AS INT))"), F.col("head")).alias("edited"),
    )
    known = lambda terms: F.array_sort(F.filter(terms, lambda t: in_map(words, _slot(t))))
    made = both.select(
        "id", "mark", "next_id", "next_mark", "chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"),
        known(terms_of(F.col("text"))).alias("terms"), known(terms_of(F.col("edited"))).alias("edited_terms"),
    )
    made = stored(with_fingerprint(with_fingerprint(made, "terms", "text", "print"), "edited_terms", "edited", "edited_print"))
    following = made.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("print").alias("next_print"))
    joined = made.join(following.dropDuplicates(["next_id", "next_mark"]), ["next_id", "next_mark"])
    return joined.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        F.col("chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
