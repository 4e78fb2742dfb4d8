"""References and edges from SQL texts that Java programs put together piece by piece.

A text is searched whole, so a name after a FROM of another append is found; a hit then gets the line of the append
that holds the name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.constants import RELATION_TYPES
from sqltrail.functions import java as J
from sqltrail.functions import text as X
from sqltrail.operators.edges import NARROW_KEY, build_edges, refs_to_edges
from sqltrail.operators.java import _file, _rest, builder_calls
from sqltrail.operators.references import where_owner, where_type
from sqltrail.operators.sizing import scaled_join
from sqltrail.schemas import CODE_REFS, FILE_KEY


def builder_fragments(stmts: DataFrame, by: str = "instance", keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """One row per builder with its text and the `fragments` it is made of: text and line of each literal, in order.

    Builders are those of `string_builders` with `by` instance or first; `decl_line` is NULL for a name that no scope
    declares.
    """
    keys = list(keys)
    calls = builder_calls(stmts, by, keys).filter(~F.col("declares"))
    piece = F.struct("pos", "idx", J.fragments_of(F.col("chain"), F.col("line_number")).alias("fragments"))
    file = _file(stmts, keys)
    grouped = calls.groupBy(*file, "variable", "decl_id", "decl_line").agg(*_rest(keys, file), F.array_sort(F.collect_list(piece)).alias("_pieces"))
    return grouped.select(
        *keys, "variable", "decl_line", F.flatten(F.transform("_pieces", lambda p: p["fragments"])).alias("fragments")
    ).withColumn("content", F.array_join(F.transform("fragments", lambda f: f["text"]), ""))


def _fragment_at(fragments: Column, at: Column) -> Column:
    """The fragment that holds the `at`-th character (from 1) of the joined text."""
    start = F.struct(at.alias("left"), F.lit(None).cast("struct<text:string,line_number:int>").alias("fragment"))

    def step(state: Column, fragment: Column) -> Column:
        here = state["fragment"].isNull() & (state["left"] <= F.length(fragment["text"]))
        return F.struct(
            (state["left"] - F.length(fragment["text"])).alias("left"), F.when(here, fragment).otherwise(state["fragment"]).alias("fragment")
        )

    return F.aggregate(fragments, start, step, lambda state: state["fragment"])


def builder_hits(stmts: DataFrame, by: str = "instance", keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Tables that the texts of builders read (`R`) and change (`M`), with line and text of the fragment that names them."""
    tagged = lambda hits, operation: F.transform(
        hits, lambda h: F.struct(h["name"].alias("table_name"), h["at"].alias("at"), F.lit(operation).alias("operation"))
    )
    content = F.col("content")
    found = builder_fragments(stmts, by, keys).select(
        *keys, "variable", "decl_line", "fragments", F.inline(F.concat(tagged(X.read_hits(content), "R"), tagged(X.modify_hits(content), "M")))
    )
    fragment = _fragment_at(F.col("fragments"), F.col("at"))
    return found.withColumn("_fragment", fragment).select(
        *keys, "variable", "decl_line", "table_name", "operation", F.col("_fragment.line_number").alias("line_number"), F.col("_fragment.text").alias("line")
    )


def builder_refs(
    stmts: DataFrame, catalog: DataFrame, owners: Iterable[str] | None = None, types: Sequence[str] = RELATION_TYPES, by: str = "instance"
) -> DataFrame:
    """References of reassembled texts, one for each owner that has the name, in the layout of `code_refs`.

    Of an owner's objects of that name the one whose type stands first in `types` counts. It is picked on the side of
    the catalog, once per name; `variable` and `decl_line` name the builder.
    """
    listed = F.array(*[F.lit(t) for t in types])
    best = (
        where_type(where_owner(catalog, owners), types)
        .groupBy("owner", F.upper("object_name").alias("object_name"))
        .agg(F.element_at(listed, F.min(F.array_position(listed, F.upper("object_type"))).cast("int")).alias("object_type"))
    )
    hits = builder_hits(stmts, by).withColumnRenamed("table_name", "object_name")
    return scaled_join(hits, best, ["object_name"]).withColumn("valid", F.lit("")).select(*CODE_REFS.fieldNames(), "variable", "decl_line")


def builder_edges(refs: DataFrame, key: Sequence[str] = NARROW_KEY) -> DataFrame:
    """The references as `map` edges, read and modify, one per key."""
    return build_edges(refs_to_edges(refs), key)
