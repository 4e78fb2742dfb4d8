"""Java files to declarations, annotations, string variables and reassembled SQL texts.

Files are shuffled once, by file, before they are cut into statements; every window and group after
that is by file and finer, so nothing is shuffled again. One file is one input row: its statements
come out of that row and can never be more than it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sqltrail.constants import ANNOTATION_CLASSES, MODIFY_METHODS, QUERY_METHODS
from sqltrail.functions import java as J
from sqltrail.functions import text as X
from sqltrail.schemas import FILE_KEY


#: Bytes of text that a task is given, where there is more of it than one task for each core should hold; and the least for a task.
TASK_BYTES = 16 * 1024 * 1024
LEAST_BYTES = 1024 * 1024
#: Levels of scopes that stand side by side in a row; where scopes nest deeper, rows are repeated for each level.
LEVELS = 24
#: Opening braces up to which their number is taken for the depth.
FEW_BRACES = 6


def _ids(keys: Sequence[str]) -> list[str]:
    """Columns that tell files apart, a number first: rows are sorted by it faster than by names."""
    return ["file_id", *keys]


def _file(stmts: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns that tell the files of `stmts` apart: the number alone, where no two files were measured to share it."""
    return _ids(keys) if _has_copies(stmts) else ["file_id"]


def _rest(keys: Sequence[str], file: Sequence[str]) -> list[Column]:
    """Those of `_ids` that a group by `file` does not have, the same in all its rows."""
    return [F.any_value(c).alias(c) for c in _ids(keys) if c not in file]


def statements(
    files: DataFrame, keys: Sequence[str] = FILE_KEY, content: str = "content", partitions: int | None = None,
    containing: Sequence[str] = (),
) -> DataFrame:
    """Statements in order, with line, brace depth and, where a scope begins, what opened it.

    `keys` identify a file. `line_number` is where the declaration or expression starts, past
    annotations and modifiers. `opener` is set on the first statement of a scope: its kind (type,
    anonymous, method, constructor or block), name, line and, for a type, header.

    `partitions` fixes the number of tasks the files are shuffled into; else it grows with their text. With `containing`, files that hold none of
    these texts are left out before the shuffle.
    """
    keys = list(keys)
    if containing:
        files = files.filter(reduce(or_, [F.col(content).contains(text) for text in containing]))
    dealt = files.select(F.xxhash64(*keys).alias("file_id"), *keys, F.col(content).alias("_content"))
    size, measured = _measured(dealt)
    partitions = partitions or _partitions(size, dealt.sparkSession.sparkContext.defaultParallelism)
    # Without a number, adaptive execution makes one task of little text.
    dealt = dealt.repartition(partitions, "file_id") if partitions else dealt.repartition("file_id")
    rows = (
        dealt.select(*_ids(keys), F.posexplode(J.split_statements(F.col("_content"))).alias("pos", "_raw"))
        .filter(F.col("_raw") != "")
        .withColumns({"end_mark": J.end_mark(F.col("_raw")), "lead": J.lead_of(F.col("_raw"))})
        .withColumn("_core", J.core_of(F.col("_raw"), F.col("lead"), F.col("end_mark")))
        .withColumns(
            {
                "body": J.body_of(F.col("_core")),
                # With its comments, where it has any.
                "commented": F.when(F.col("_core").contains("/"), F.col("_core")),
                "newlines": J.newlines(F.col("_raw")),
                "lead_newlines": J.newlines(F.col("lead")),
            }
        )
        .withColumn("lead", F.when(F.col("lead").contains("@"), F.col("lead")))
        .drop("_raw", "_core")
    )
    opens = F.col("end_mark") == "{"
    calls = F.col("body").contains("(")
    body = F.col("body")
    shape = (
        F.when(opens & body.rlike(J.TYPE_HEADER), "type")
        .when(opens & calls & body.rlike(J.ANONYMOUS_HEADER), "anonymous")
        .when(calls & body.rlike(J.METHOD_HEADER), "method")
        .when(opens & calls & body.rlike(J.CONSTRUCTOR_HEADER), "constructor")
        .otherwise("block")
    )
    name = (
        F.when(F.col("shape") == "type", F.regexp_extract(body, J.TYPE_HEADER, 2))
        .when(F.col("shape") == "method", F.regexp_extract(body, J.METHOD_HEADER, 2))
        .when(F.col("shape") == "constructor", F.regexp_extract(body, J.CONSTRUCTOR_HEADER, 1))
        .otherwise("")
    )
    in_file = Window.partitionBy(*(_ids(keys) if measured["copies"] > 1 else ["file_id"])).orderBy("pos")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(opens, 1).when(F.col("end_mark") == "}", -1).otherwise(0)
    opener = F.when(
        opens,
        F.struct(
            F.col("shape").alias("kind"), F.col("name").alias("name"), F.col("lead_newlines").alias("lines"),
            F.when(F.col("shape") == "type", body).alias("header"),
        ),
    )
    placed = rows.withColumn("shape", shape).withColumn("name", name).withColumns(
        {
            "first_line": (F.coalesce(F.sum("newlines").over(before), F.lit(0)) + 1).cast("int"),
            "depth": F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int"),
            "_opener": F.lag(opener).over(in_file),
            "_opener_newlines": F.lag("newlines").over(in_file),
        }
    )
    opened = F.struct(
        F.col("pos").alias("id"), F.col("_opener.kind").alias("kind"), F.col("_opener.name").alias("name"),
        # The statement before ends where this one begins.
        (F.col("first_line") - F.col("_opener_newlines") + F.col("_opener.lines")).cast("int").alias("line_number"),
        F.col("_opener.header").alias("header"),
    )
    return placed.withColumns(
        {
            "line_number": (F.col("first_line") + F.col("lead_newlines")).cast("int"),
            "opener": F.when(F.col("_opener").isNotNull(), opened),
        }
    ).drop("_opener", "_opener_newlines", "lead_newlines").withMetadata("depth", measured)


def _measured(dealt: DataFrame) -> tuple[int, dict[str, int]]:
    """Bytes of all text; and the `levels` scopes nest at most, with the number of `copies` of files that share their keys.

    Such files are cut into statements as one, so their depths add up. Hashes that collide only raise the figures.
    """
    text = F.col("_content")
    braces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("{"), F.lit("")))
    depth = F.when(braces <= FEW_BRACES, braces).otherwise(J.depth_of(text))
    by_file = dealt.groupBy("file_id").agg(F.sum(F.octet_length(text)).alias("size"), F.sum(depth).alias("levels"), F.count(F.lit(1)).alias("copies"))
    found = by_file.agg(F.sum("size").alias("size"), F.max("levels").alias("levels"), F.max("copies").alias("copies")).first()
    return found["size"] or 0, {"levels": found["levels"] or 0, "copies": found["copies"] or 0}


def _partitions(size: int, cores: int) -> int | None:
    """Tasks for `size` bytes of text: one for each core, fewer for little text, more where one would have more than TASK_BYTES.

    What is sorted and grouped is several times the text, and adaptive execution sizes tasks by compressed bytes, of which
    code has few. With a bound on its text a task's rows stay in memory however many files there are.
    """
    wanted = max(-(-size // TASK_BYTES), min(cores, size // LEAST_BYTES))
    return wanted if wanted > 1 else None


def _levels(stmts: DataFrame) -> int | None:
    """Levels that scopes of `stmts` have at most, as measured by `statements`; None where not known or more than LEVELS."""
    levels = stmts.schema["depth"].metadata.get("levels")
    return levels if levels is not None and levels <= LEVELS else None


def _has_copies(stmts: DataFrame) -> bool:
    return stmts.schema["depth"].metadata.get("copies", 2) > 1


def _parts(stmts: DataFrame, parts: Sequence[str]) -> Column:
    """The scope that begins at a statement, with some of its fields or all."""
    opener = F.col("opener")
    return F.when(opener.isNotNull(), F.struct(*[opener[c].alias(c) for c in parts])) if parts else opener


def _beside(stmts: DataFrame, wanted: Column, keys: Sequence[str], levels: int, parts: Sequence[str] = ()) -> DataFrame:
    """Wanted statements with the last scope that began at each level, `_scope_1` the outermost, those that ended since too.

    The statements of a file are in order already, so nothing is sorted. Scopes have the fields in `parts`, or all.
    """
    begins = F.col("opener").isNotNull()
    so_far = Window.partitionBy(*_file(stmts, keys)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {
        f"_scope_{n}": F.last(F.when(F.col("depth") == n, F.col("_begun")), ignorenulls=True).over(so_far) for n in range(1, levels + 1)
    }
    marked = stmts.withColumn("_wanted", wanted).filter(F.col("_wanted") | begins)
    return marked.withColumn("_begun", _parts(stmts, parts)).withColumns(last).filter("_wanted").drop("_begun")


def _innermost(levels: int, test, value, none: str) -> Column:
    """`value` of the innermost level, given its number and scope, that is around a statement of `_beside` and passes `test`."""
    found = [
        F.when((F.col("depth") >= n) & test(F.lit(n), F.col(f"_scope_{n}")), value(F.lit(n), F.col(f"_scope_{n}")))
        for n in range(levels, 0, -1)
    ]
    return F.coalesce(*found, F.lit(None).cast(none))


def enclosing(
    stmts: DataFrame, wanted: Column, payload: Sequence[str | Column], keys: Sequence[str] = FILE_KEY
) -> DataFrame:
    """One row per wanted statement and enclosing scope, `level` 1 outermost.

    The scope at a level is the last one that began at that level. Every wanted statement is repeated
    once per level, which is its nesting depth and not the size of the file; other statements are
    dropped first unless a scope begins at them.
    """
    known = _levels(stmts)
    if known is not None:
        scopes = [F.when(F.col("depth") >= n, F.col(f"_scope_{n}")) for n in range(1, known + 1)]
        none = F.lit(None).cast(stmts.schema["opener"].dataType)
        around = F.slice(F.array(*(scopes or [none])), F.lit(1), F.greatest(F.col("depth"), F.lit(1)))
        rows = _beside(stmts, wanted, keys, known).select(*_ids(keys), "pos", F.struct(*payload).alias("_data"), around.alias("_around"))
        return rows.select(*_ids(keys), "pos", "_data", F.posexplode("_around").alias("_level", "ancestor")).select(
            *_ids(keys), "pos", (F.col("_level") + 1).alias("level"), "ancestor", "_data.*"
        )
    begins = F.col("opener").isNotNull()
    levels = F.when(
        F.col("_wanted"), F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1)))
    ).otherwise(F.array("depth"))
    exploded = (
        stmts.filter(wanted | begins)
        .select(
            *_ids(keys), "pos", "depth", "opener", wanted.alias("_wanted"),
            F.when(wanted, F.struct(*payload)).alias("_data"),
        )
        .select("*", F.explode(levels).alias("level"))
    )
    at_level = Window.partitionBy(*_ids(keys), "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(begins & (F.col("level") == F.col("depth")), F.col("opener"))
    return (
        exploded.withColumn("_ancestor", F.last(begun, ignorenulls=True).over(at_level))
        .filter("_wanted")
        .select(
            *_ids(keys), "pos", "level",
            F.when(F.col("depth") >= F.col("level"), F.col("_ancestor")).alias("ancestor"), "_data.*",
        )
    )


def with_owner(
    stmts: DataFrame, wanted: Column, payload: Sequence[str], keys: Sequence[str] = FILE_KEY
) -> DataFrame:
    """Wanted statements with their scope, and the innermost named type and method around them."""
    grouped = _owners(stmts, wanted, payload, keys)
    return grouped.select(
        *_ids(keys), "pos", "scope_kind", "_data.*",
        F.col("_type.id").alias("type_id"),
        F.col("_type.name").alias("type_name"),
        F.col("_type.header").alias("type_header"),
        F.col("_method.id").alias("method_id"),
        F.col("_method.name").alias("method_name"),
        F.col("_method.line_number").alias("method_line"),
    )


def _is_type(scope: Column) -> Column:
    return scope["kind"] == "type"


def _is_method(scope: Column) -> Column:
    return scope["kind"].isin("method", "constructor")


def _around(kind: str) -> dict[str, tuple]:
    """What `_innermost` is asked for: the scope of a statement, its parent's id, and the type and method around it. `kind` is the type of scopes."""
    return {
        "_scope": (lambda n, scope: n == F.col("depth"), lambda n, scope: scope, kind),
        "_parent": (lambda n, scope: n == F.col("depth") - 1, lambda n, scope: scope["id"], "int"),
        "_type": (lambda n, scope: _is_type(scope), lambda n, scope: scope, kind),
        "_method": (lambda n, scope: _is_method(scope), lambda n, scope: scope, kind),
    }


def _owners(
    stmts: DataFrame, wanted: Column, payload: Sequence[str | Column], keys: Sequence[str], each: Sequence[str] = (), parts: Sequence[str] = ()
) -> DataFrame:
    """Wanted statements with their `payload` as `_data` (or `each` of its columns by itself), and `_scope`, `_parent` (an id), `_type`, `_method` and `scope_kind`.

    Of the scopes at least the fields in `parts` are there, or all.
    """
    # Statements of files that share their keys and stand at one place are one.
    data = (F.struct(*[F.any_value(F.col(f"_data.{c}"), True).alias(c) for c in each]) if each else F.any_value("_data")).alias("_data")
    known = _levels(stmts)
    if known is None:
        scope, level, depth = F.col("ancestor"), F.col("level"), F.col("_depth")
        rows = enclosing(stmts, wanted, [F.struct(*payload).alias("_data"), F.col("depth").alias("_depth")], keys)
        return rows.groupBy(*_ids(keys), "pos").agg(
            data,
            F.max_by(scope, level).alias("_scope"),
            F.max_by(F.when(level < depth, scope["id"]), F.when(level < depth, level)).alias("_parent"),
            F.max_by(F.when(_is_type(scope), scope), F.when(_is_type(scope), level)).alias("_type"),
            F.max_by(F.when(_is_method(scope), scope), F.when(_is_method(scope), level)).alias("_method"),
            F.max_by(scope["kind"], level).alias("scope_kind"),
        )
    found = _around(stmts.select(_parts(stmts, parts).alias("opener")).schema["opener"].dataType.simpleString())
    rows = _beside(stmts, wanted, keys, known, parts)
    values = {name: _innermost(known, *parts) for name, parts in found.items()}
    if not _has_copies(stmts):
        placed = rows.select(*_ids(keys), "pos", F.struct(*payload).alias("_data"), *[v.alias(name) for name, v in values.items()])
        return placed.withColumn("scope_kind", F.col("_scope.kind"))
    at = {f"{name}_level": _innermost(known, test, lambda n, scope: n, "int") for name, (test, *_) in found.items()}
    at["_scope_level"] = F.greatest(F.col("depth"), F.lit(1))
    return rows.select(*_ids(keys), "pos", F.struct(*payload).alias("_data"), *[v.alias(name) for name, v in (values | at).items()]).groupBy(*_ids(keys), "pos").agg(
        data,
        *[F.max_by(name, f"{name}_level").alias(name) for name in found],
        F.max_by(F.col("_scope.kind"), F.col("_scope_level")).alias("scope_kind"),
    )


# Kinds of scope whose statements are members.
_MEMBER_SCOPES = ("type", "anonymous")


def _maybe_method() -> Column:
    return (F.col("depth") > 0) & F.col("shape").isin("method", "constructor") & F.col("end_mark").isin("{", ";")


def _maybe_field() -> Column:
    return (
        (F.col("depth") > 0) & F.col("shape").isin("block", "anonymous") & F.col("end_mark").isin("{", ";")
        & F.col("body").rlike(J.FIELD_HEADER)
    )


def _annotations() -> Column:
    return J.annotations_of(F.coalesce("lead", F.lit("")), F.col("first_line"))


def package_decls(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    name = F.regexp_extract("body", rf"^package\s++([{X.WORD}$.]++)", 1)
    return stmts.filter((F.col("depth") == 0) & (name != "")).select(*keys, name.alias("package_name"))


def imports(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Imported names in order; `.*` is dropped, `static` too."""
    name = F.regexp_extract("body", rf"^import\s++(?:static\s++)?+({J.ID}++(?:\.{J.ID}++)*+)", 1)
    return stmts.filter((F.col("depth") == 0) & (name != "")).select(
        *keys, "pos", "line_number", name.alias("import_name")
    )


def type_decls(
    stmts: DataFrame, keys: Sequence[str] = FILE_KEY, kinds: Sequence[str] = ("class", "interface")
) -> DataFrame:
    """Types with what they extend and implement, and their annotations.

    Other kinds are enum, record and annotation.
    """
    kind = J.type_kind(F.col("body"))
    return stmts.filter((F.col("shape") == "type") & kind.isin(*kinds)).select(
        *keys, "pos", F.col("name").alias("type_name"), kind.alias("kind"), "line_number",
        J.extends_of(F.col("body")).alias("extends"),
        J.implements_of(F.col("body")).alias("implements"),
        _annotations().alias("annotations"),
    )


def inheritance(types: DataFrame) -> DataFrame:
    """Adds one list of implemented, then extended names."""
    return types.withColumn(
        "inheritance", F.concat("implements", F.transform("extends", lambda e: e["name"]))
    )


def methods(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Methods and constructors of classes and interfaces; a constructor has no return type.

    Methods of an anonymous class belong to the type around it.
    """
    payload = ["name", "line_number", "shape", "body", "lead", "first_line"]
    returned = F.when(F.col("shape") == "constructor", "").otherwise(
        J.compact(F.regexp_extract("body", J.METHOD_HEADER, 1))
    )
    members = with_owner(stmts, _maybe_method(), payload, keys).filter(F.col("scope_kind").isin(*_MEMBER_SCOPES))
    return members.select(
        *keys, "pos", "type_name", "type_header", F.col("name").alias("method_name"), "line_number",
        returned.alias("return_type"), _annotations().alias("annotations"),
    )


def _field_rows(stmts: DataFrame, keys: Sequence[str], wanted: Column | None = None) -> DataFrame:
    payload = ["body", "commented", "lead", "line_number", "first_line"]
    candidates = _maybe_field() if wanted is None else _maybe_field() & wanted
    return with_owner(stmts, candidates, payload, keys).filter(F.col("scope_kind").isin(*_MEMBER_SCOPES))


def _declared() -> Column:
    """Names and initialisers that a field statement declares."""
    return J.declarators(F.regexp_replace("body", J.FIELD_HEADER, ""))


def fields(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Fields with type, initialiser text without white space (NULL if none) and annotations.

    A declaration of several names gives a row for each, numbered by `ordinal` from 0.
    """
    return _field_rows(stmts, keys).select(
        *keys, "pos", "type_name", "line_number", "body", "lead", "first_line",
        F.posexplode(_declared()).alias("ordinal", "_declared"),
    ).select(
        *keys, "pos", "type_name", F.col("_declared.name").alias("field_name"), "line_number",
        J.compact(F.regexp_extract("body", J.FIELD_HEADER, 1)).alias("field_type"),
        X.nullif_empty(J.compact(F.col("_declared.value"))).alias("value"),
        _annotations().alias("annotations"), "ordinal",
    )


def string_fields(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """String fields, a row per name: line and joined text of the initialiser; empty if not a literal."""
    value, text = F.col("value"), F.coalesce("commented", "body")
    before = F.substring(F.col("_text"), F.lit(1), F.instr(F.col("_text"), value))
    line = F.when(value != "", F.col("line_number") + J.newlines(before)).otherwise(F.col("line_number"))
    literal = value.contains('"') & ~value.rlike(rf"^{J.ID}++\s*+\(|^new\s")
    rows = _field_rows(stmts, keys, F.col("body").rlike(rf"^String\s++{J.ID}")).withColumn("_text", text)
    return rows.select(
        *keys, "type_name", "line_number", "_text",
        F.inline(J.declarators(F.regexp_replace("_text", r"^String\s++", ""))),
    ).select(
        *keys, "type_name", F.col("name").alias("field_name"), line.cast("int").alias("line_number"),
        F.when(literal, X.join_literals(value)).otherwise("").alias("content"),
    )


def annotations(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Annotations of types, methods and fields, a row each, with what they stand on: of several fields, the first."""
    marked = F.col("lead").isNotNull()
    wanted = marked & ((F.col("shape") == "type") | _maybe_method() | _maybe_field())
    payload = ["shape", "name", "body", "lead", "first_line"]
    target = (
        F.when(F.col("shape") == "type", "type").when(F.col("shape").isin("method", "constructor"), "method")
        .otherwise("field")
    )
    rows = with_owner(stmts, wanted, payload, keys).filter(
        (F.col("shape") == "type") | F.col("scope_kind").isin(*_MEMBER_SCOPES)
    )
    name = F.when(target == "field", F.try_element_at(_declared(), F.lit(1))["name"]).otherwise(F.col("name"))
    return rows.select(
        *keys, "pos", target.alias("target"), name.alias("target_name"),
        F.posexplode(_annotations()).alias("ordinal", "_annotation"),
    ).select(*keys, "pos", "target", "target_name", "ordinal", "_annotation.*")


def annotation_class(names: DataFrame, column: str = "name") -> DataFrame:
    """A row per class of each annotation: QUERY, CALL, MODIFY, ENTITY; other annotations have none."""
    bare = F.regexp_replace(F.col(column), "^@", "")
    labels = [F.when(bare.isin(*known), F.lit(label)) for label, known in ANNOTATION_CLASSES.items()]
    return names.select("*", F.explode(F.array_compact(F.array(*labels))).alias("annotation_class"))


def is_method_of_interest(name: Column) -> Column:
    return name.isin("append", *MODIFY_METHODS, *QUERY_METHODS)


def method_class(names: DataFrame, column: str = "method_name") -> DataFrame:
    """Adds `modify`, `query` or NULL by the method's name."""
    name = F.col(column)
    return names.withColumn(
        "method_class", F.when(name.isin(*MODIFY_METHODS), "modify").when(name.isin(*QUERY_METHODS), "query")
    )


def entity_tables(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Entity classes as package.Class with the name of their table."""
    marks = F.col("annotations")
    table_mark = F.try_element_at(F.filter(marks, lambda a: a["name"] == "Table"), F.lit(1))
    types = stmts.filter(
        ((F.col("shape") == "type") & F.col("lead").isNotNull())
        | ((F.col("depth") == 0) & F.col("body").startswith("package "))
    )
    package = F.nullif(F.regexp_extract("body", rf"^package\s++([{X.WORD}$.]++)", 1), F.lit(""))
    in_file = Window.partitionBy(*_file(stmts, keys)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        types.withColumn("_package", F.last(package, ignorenulls=True).over(in_file))
        .filter((F.col("shape") == "type") & (J.type_kind(F.col("body")) == "class"))
        .withColumn("annotations", _annotations())
        .filter(F.exists(marks, lambda a: a["name"] == "Entity"))
        .select(
            *keys,
            F.concat_ws(".", "_package", "name").alias("entity"),
            F.replace(J.parameter(table_mark, "name"), F.lit('"'), F.lit("")).alias("table_name"),
        )
        .filter(F.col("table_name").isNotNull())
    )


def repositories(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Interfaces that extend a generic base: base, entity, and each annotation of their methods.

    The base and entity come from the header of the interface, so nothing is joined.
    """
    base = F.try_element_at(J.extends_of(F.col("type_header")), F.lit(1))
    listed = methods(stmts, keys).filter(F.col("type_header").rlike(r"^interface\s"))
    return (
        listed.withColumn("_base", base)
        .filter(F.size(F.col("_base.generics")) > 0)
        .select(
            *keys, "type_name", F.col("_base.name").alias("base_name"),
            F.try_element_at("_base.generics", F.lit(1)).alias("entity_name"), "method_name",
            F.explode("annotations").alias("_mark"),
        )
        .select(
            *keys, "type_name", "base_name", "entity_name", "method_name",
            F.col("_mark.name").alias("annotation_name"), F.col("_mark.arguments").alias("arguments"),
        )
    )


# --- string variables -----------------------------------------------------------------------


def _maybe_local() -> Column:
    return (F.col("depth") > 0) & F.col("body").contains("String") & F.col("body").rlike(J.STRING_LOCAL)


def string_variables(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Local String and StringBuilder variables, a row per declared name, with the method around them."""
    rows = with_owner(stmts, _maybe_local(), ["body", "line_number"], keys)
    return rows.filter(~F.col("scope_kind").isin(*_MEMBER_SCOPES)).select(
        *_ids(keys), "pos", "type_name", "method_id", "method_name", "method_line", "line_number",
        F.regexp_extract("body", J.STRING_LOCAL, 1).alias("variable_type"),
        F.inline(J.declarators(F.regexp_replace("body", J.STRING_LOCAL, ""))),
    )


def string_locals(
    stmts: DataFrame, mode: str = "literals", keys: Sequence[str] = FILE_KEY
) -> DataFrame:
    """Local String variables with an initialiser.

    Content by mode: `literals` joins every literal, numbers too, without quotes; `text` is the
    expression without white space and without its outer quotes; `raw` keeps those quotes.
    """
    value = F.col("value")
    content = {
        "literals": J.literal_values(value),
        "text": F.regexp_replace(J.compact(value), r'^"++|"++$', ""),
        "raw": J.compact(value),
    }[mode]
    return string_variables(stmts, keys).filter(
        (F.col("variable_type") == "String") & (value != "")
    ).select(
        *keys, "type_name", "method_name", F.col("name").alias("variable"), "line_number",
        content.alias("content"),
    )


def methods_with_strings(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Methods that declare a local String or StringBuilder, with how many of each."""
    is_string = F.col("variable_type") == "String"
    return (
        string_variables(stmts, keys)
        .filter(F.col("method_id").isNotNull())
        .groupBy(*_ids(keys), "method_id", "method_name", "method_line")
        .agg(
            F.count_if(is_string).cast("int").alias("strings"), F.count_if(~is_string).cast("int").alias("builders")
        )
        .drop("method_id", "file_id")
    )


def _declared_builders() -> Column:
    """Builder names that a statement declares or assigns anew, if it stands in code."""
    body = F.col("body")
    local = _maybe_local() & (F.regexp_extract(body, J.STRING_LOCAL, 1) == "StringBuilder")
    again = (
        (F.col("depth") > 0) & body.contains("StringBuilder") & ~body.rlike(J.STRING_LOCAL)
        & (F.regexp_extract(body, J.REASSIGNED, 2) == "StringBuilder")
    )
    return (
        F.when(local, F.transform(J.declarators(F.regexp_replace(body, J.STRING_LOCAL, "")), lambda d: d["name"]))
        .when(again, F.array(F.regexp_extract(body, J.REASSIGNED, 1)))
        .otherwise(F.array().cast("array<string>"))
    )


def _called_chains() -> Column:
    body = F.col("body")
    return F.when(body.contains("append"), J.calls_of(body)).otherwise(
        F.array().cast("array<struct<variable:string,chain:string,lines:int>>")
    )


def _maybe_builder() -> Column:
    return F.col("body").contains("append") | F.col("body").contains("StringBuilder")


def _declaring(names: Column) -> Column:
    """Declared names as events."""
    return F.transform(
        names,
        lambda v: F.struct(
            v.alias("variable"), F.lit("").alias("chain"), F.lit(0).alias("lines"), F.lit(-1).alias("idx"), F.lit(True).alias("declares")
        ),
    )


def _calling(chains: Column) -> Column:
    """Append chains as events."""
    return F.transform(
        chains,
        lambda c, i: F.struct(
            c["variable"].alias("variable"), c["chain"].alias("chain"), c["lines"].alias("lines"), i.alias("idx"),
            F.lit(False).alias("declares"),
        ),
    )


def _builder_events(levels: int) -> Column:
    """The declarations and append chains of a statement of `_beside`, in order; a name it declares twice is one."""
    kind = _innermost(levels, lambda n, scope: n == F.col("depth"), lambda n, scope: scope["kind"], "string")
    declares = F.when(~kind.isin(*_MEMBER_SCOPES), _declaring(F.array_distinct(_declared_builders())))
    return F.concat(F.coalesce(declares, _declaring(F.array().cast("array<string>"))), _calling(_called_chains()))


def _scope_ids(levels: int) -> list[Column]:
    """Ids of the scopes around a statement of `_beside`."""
    return [F.when(F.col("depth") >= n, F.col(f"_scope_{n}.id")).alias(f"_id_{n}") for n in range(1, levels + 1)]


def _resolved(events: DataFrame, levels: int, file: Sequence[str]) -> DataFrame:
    """Events with `_decl`, the last declaration of their name before them in the innermost scope around them that has one.

    The last declaration at a level is in the scope that is open there, or that scope has none.
    """
    so_far = Window.partitionBy(*file, "variable").orderBy("pos", "idx").rowsBetween(Window.unboundedPreceding, 0)
    found = F.struct(F.col("pos").alias("decl_id"), F.col("line_number").alias("decl_line"))
    declared = lambda n: F.when(F.col("declares") & (F.col("depth") == n), F.struct(F.col(f"_id_{n}").alias("id"), found.alias("decl")))
    last = {f"_decl_{n}": F.last(declared(n), ignorenulls=True).over(so_far) for n in range(1, levels + 1)}
    open_there = [F.when(F.col(f"_decl_{n}.id") == F.col(f"_id_{n}"), F.col(f"_decl_{n}.decl")) for n in range(levels, 0, -1)]
    none = F.lit(None).cast("struct<decl_id:int,decl_line:int>")
    return events.withColumns(last).withColumn("_decl", F.coalesce(*open_there, none))


def builder_calls(stmts: DataFrame, by: str = "instance", keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Append chains, each with the declaration its variable resolves to, NULL if none is in scope.

    A name means the declaration in the innermost enclosing scope that has one before the call. If a
    scope declares it more than once, `instance` takes the last before the call, `first` the first.
    Declarations are `StringBuilder x` and `x = new StringBuilder(…)`.

    `line_number` is the line where the declaration or the chain begins.

    Calls meet the declarations in a window over (file, name), with the last declaration at each level beside
    them, or are repeated per enclosing scope in one over (file, scope, name) where scopes nest deeper than LEVELS,
    for `first`, and for files that share keys. Calls and declarations are never paired with one another.
    """
    candidates = _maybe_builder()
    known = _levels(stmts)
    if known is not None and by != "first" and not _has_copies(stmts):
        rows = _beside(stmts, candidates, keys, known, ("id", "kind"))
        events = rows.select(*_ids(keys), "pos", "depth", "line_number", *_scope_ids(known), F.inline(_builder_events(known)))
        found = _resolved(events.withColumn("line_number", F.col("line_number") + F.col("lines")), known, _file(stmts, keys))
        return found.select(*_ids(keys), "pos", "idx", "variable", "declares", "chain", "line_number", "_decl.*")
    payload = [
        _declared_builders().alias("_declared"), _called_chains().alias("_called"), F.col("line_number"), F.col("depth"),
    ]
    levels = enclosing(stmts, candidates, payload, keys)

    # An event is a declaration at its own level, or a call at each level.
    declares_here = (F.col("level") == F.col("depth")) & ~F.col("ancestor.kind").isin(*_MEMBER_SCOPES)
    declares, calls = _declaring(F.col("_declared")), _calling(F.col("_called"))
    events = levels.select(
        *_ids(keys), "pos", "level", F.col("ancestor.id").alias("_scope"), "line_number",
        F.inline(F.concat(F.when(declares_here, declares).otherwise(F.slice(declares, 1, 0)), calls)),
    ).withColumn("line_number", F.col("line_number") + F.col("lines"))
    same_name = Window.partitionBy(*_ids(keys), "_scope", "variable").orderBy("pos", "idx").rowsBetween(
        Window.unboundedPreceding, 0
    )
    declaration = F.when(F.col("declares"), F.struct(F.col("pos").alias("decl_id"), F.col("line_number").alias("decl_line")))
    pick = F.first if by == "first" else F.last
    found = events.withColumn("_decl", pick(declaration, ignorenulls=True).over(same_name))
    has = F.col("_decl").isNotNull()
    return (
        found.groupBy(*_ids(keys), "pos", "idx", "variable", "declares")
        .agg(
            F.any_value("chain").alias("chain"),
            F.any_value("line_number").alias("line_number"),
            F.max_by(F.when(has, F.col("_decl")), F.when(has, F.col("level"))).alias("_decl"),
        )
        .select(*_ids(keys), "pos", "idx", "variable", "declares", "chain", "line_number", "_decl.*")
    )


def string_builders(stmts: DataFrame, by: str = "instance", keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """One text per builder: what its appends put together.

    `instance` and `first` attach each chain to one declaration (see `builder_calls`) and join every
    literal of every call of the chain; chains on a name that no scope declares, such as a parameter,
    form one row per name with a NULL declaration line. `name` gives each declaration in a method the
    first arguments, where literal, of all statements of that method on that name.
    """
    keys = list(keys)
    if by == "name":
        return _builders_by_name(stmts, keys)
    found = _builder_texts(builder_calls(stmts, by, keys), keys, _file(stmts, keys))
    return found.select(*keys, "variable", F.col("decl_line").alias("line_number"), "appends", "content")


def _text_parts() -> list[Column]:
    """Aggregates of the events of a builder: `_pieces` of its text, and `appends`."""
    appended = ~F.col("declares")
    piece = F.when(
        appended,
        F.struct("pos", "idx", F.array_join(J.literal_texts(F.col("chain")), "").alias("text")),
    )
    return [
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.coalesce(
            F.sum(F.when(appended, F.size(F.regexp_extract_all("chain", F.lit(J.APPEND), F.lit(0))))), F.lit(0)
        ).cast("int").alias("appends"),
    ]


def _content() -> Column:
    return F.array_join(F.transform("_pieces", lambda p: p["text"]), "")


def _builder_texts(calls: DataFrame, keys: Sequence[str], file: Sequence[str]) -> DataFrame:
    """One text per name and declaration, from the rows of `builder_calls`."""
    grouped = calls.groupBy(*file, "variable", "decl_id", "decl_line").agg(*_rest(keys, file), *_text_parts())
    return grouped.withColumn("content", _content()).drop("_pieces")


def _builders_by_name(stmts: DataFrame, keys: list[str]) -> DataFrame:
    body = F.col("body")
    local = _maybe_local() & (F.regexp_extract(body, J.STRING_LOCAL, 1) == "StringBuilder")
    declared = F.transform(
        J.declarators(F.regexp_replace(body, J.STRING_LOCAL, "")),
        lambda d: F.struct(d["name"].alias("variable"), F.lit(True).alias("declares"), F.lit("").alias("text")),
    )
    calls = F.transform(
        _called_chains(),
        lambda c: F.struct(
            c["variable"].alias("variable"), F.lit(False).alias("declares"),
            F.coalesce(J.first_literal(c["chain"]), F.lit("")).alias("text"),
        ),
    )
    found = F.concat(F.when(local, declared).otherwise(F.slice(declared, 1, 0)), calls)
    candidates = body.contains("append") | body.contains("StringBuilder")
    rows = with_owner(stmts, candidates, ["body", "depth", "line_number"], keys)
    events = rows.filter(F.col("method_id").isNotNull() & ~F.col("scope_kind").isin(*_MEMBER_SCOPES)).select(
        *_ids(keys), "method_id", "method_name", "pos", "line_number", F.posexplode(found).alias("idx", "_event")
    ).select(*_ids(keys), "method_id", "method_name", "pos", "idx", "line_number", "_event.*")
    # The text is put together once per method and name, then repeated for each declaration.
    grouped = events.groupBy(*_ids(keys), "method_id", "method_name", "variable").agg(
        F.array_sort(F.collect_list(F.when(~F.col("declares"), F.struct("pos", "idx", "text")))).alias("_pieces"),
        F.collect_list(F.when(F.col("declares"), F.col("line_number"))).alias("_lines"),
        F.count_if(~F.col("declares")).cast("int").alias("appends"),
    )
    return grouped.select(
        *keys, "method_name", "variable", F.explode("_lines").alias("line_number"), "appends",
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("content"),
    )


def scopes(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Scopes with kind, name, level, number of statements, and first and last line."""
    keys = list(keys)
    file = _file(stmts, keys)
    at_depth = Window.partitionBy(*file, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = stmts.filter(F.col("depth") > 0).select(
        *_ids(keys), "depth", "end_mark", (F.col("first_line") + F.col("newlines")).alias("_last_line"),
        F.last("opener", ignorenulls=True).over(at_depth).alias("scope"),
    )
    grouped = inside.groupBy(*file, F.col("scope.id").alias("scope_id")).agg(
        *_rest(keys, file),
        F.any_value("depth").alias("level"),
        F.any_value("scope.kind").alias("kind"),
        F.any_value("scope.name").alias("name"),
        F.any_value("scope.line_number").alias("line_number"),
        F.max(F.when(F.col("end_mark") == "}", F.col("_last_line"))).cast("int").alias("end_line"),
        F.count(F.lit(1)).cast("int").alias("statements"),
    )
    return grouped.select(*keys, "scope_id", "level", "kind", "name", "line_number", "end_line", "statements")


def method_documents(stmts: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """One nested document per method or constructor with a body: its scopes, and the strings and builders of each.

    `scopes` are in order of their first statement, which numbers them; the first is the body. `parent` is the number
    of the scope around one, NULL for the body. `strings` are local String variables with the joined literals of
    their initialiser, `builders` StringBuilder variables with what their appends put together, each where it is
    declared, and `calls` what is called on a name, on `this` or on nothing, in order. Methods of a class inside a
    method have documents of their own; the class is a scope of the outer one. Chains on names that no scope
    declares are not among the builders.
    """
    keys = list(keys)
    return _method_scopes(stmts, keys).select(
        *keys, "type_name", F.col("method.name").alias("method_name"), F.col("method.line_number").alias("line_number"), "scopes"
    )


#: What is known of a statement by itself and by where it stands.
_FACTS = ("scope", "parent", "method", "type_name", "begins", "strings", "calls")


def _facts(stmts: DataFrame, wanted: Column, payload: Sequence[Column], keys: Sequence[str], levels: int) -> DataFrame:
    """Wanted statements with their scopes, `payload` and the builders they declare, from one reading of the statements."""
    file, parts = _file(stmts, keys), ("id", "kind", "name", "line_number")
    found = _around(stmts.select(_parts(stmts, parts).alias("opener")).schema["opener"].dataType.simpleString())
    value = {name: _innermost(levels, *of) for name, of in found.items()}
    own = (value["_scope"], value["_parent"], value["_method"], value["_type"]["name"], *payload)
    events = _builder_events(levels)
    # A wanted statement is an event without a name.
    itself = F.struct(
        F.lit(None).cast("string").alias("variable"), F.lit("").alias("chain"), F.lit(0).alias("lines"), F.lit(-2).alias("idx"), F.lit(False).alias("declares")
    )
    rows = _beside(stmts.withColumn("_placed", F.coalesce(wanted, F.lit(False))), F.col("_placed") | _maybe_builder(), keys, levels, parts)
    every = rows.select(
        *_ids(keys), "pos", "depth", "line_number", *_scope_ids(levels),
        F.when(F.col("_placed"), F.struct(*[v.alias(name) for name, v in zip(_FACTS, own, strict=True)])).alias("_fact"),
        F.inline(F.concat(F.when(F.col("_placed"), F.array(itself)).otherwise(F.slice(F.array(itself), 1, 0)), events)),
    ).withColumns({"line_number": F.col("line_number") + F.col("lines"), "_fact": F.when(F.col("variable").isNull(), F.col("_fact"))})
    # What is known of a builder stands with the statement that declares it.
    at = F.when(F.col("variable").isNull(), F.col("pos")).otherwise(F.col("_decl.decl_id"))
    by_name = _resolved(every, levels, file).withColumn("_at", at).where("_at IS NOT NULL").groupBy(*file, "_at", "variable").agg(
        *_rest(keys, file), F.any_value("_fact", True).alias("_fact"), F.any_value("_decl.decl_line", True).alias("decl_line"), *_text_parts()
    )
    builder = F.struct(F.col("variable").alias("name"), F.col("decl_line").alias("line_number"), "appends", _content().alias("content"))
    return by_name.withColumn("builder", F.when(F.col("variable").isNotNull(), builder)).groupBy(*file, F.col("_at").alias("pos")).agg(
        *_rest(keys, file), F.any_value("_fact", True).alias("_fact"), F.collect_list("builder").alias("builders")
    ).select(*_ids(keys), "pos", "_fact.*", "builders")


def _method_scopes(stmts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`file_id`, `keys`, `_method` (the id of its scope), `method`, `type_name` and `scopes` of each method with a body."""
    begins = F.col("opener").isNotNull() & (F.col("depth") > 0)
    local = _maybe_local() & (F.regexp_extract("body", J.STRING_LOCAL, 1) == "String")
    strings = F.transform(
        F.filter(J.declarators(F.regexp_replace("body", J.STRING_LOCAL, "")), lambda d: d["value"] != ""),
        lambda d: F.struct(d["name"].alias("name"), F.col("line_number").alias("line_number"), J.literal_values(d["value"]).alias("content")),
    )
    builder = (F.col("depth") > 0) & F.col("body").contains("StringBuilder")
    calling = (F.col("depth") > 0) & F.col("body").contains("(") & ~F.col("shape").isin("method", "constructor", "type")
    calls = F.transform(J.receiver_calls(F.col("body")), lambda c: F.struct(F.col("line_number").alias("line_number"), c["receiver"].alias("receiver"), c["method"].alias("method")))
    payload = [
        F.when(begins, True).alias("_begins"), F.when(local, strings).alias("strings"), F.when(calling, calls).alias("calls"),
    ]
    wanted = begins | local | builder | calling
    known, file = _levels(stmts), _file(stmts, keys)
    if known is not None and not _has_copies(stmts):
        facts = _facts(stmts, wanted, payload, keys, known)
    else:
        placed = _owners(stmts, wanted, payload, keys, each=("_begins", "strings", "calls")).select(
            *_ids(keys), "pos", F.col("_scope").alias("scope"), F.col("_parent").alias("parent"), F.col("_method").alias("method"),
            F.col("_type.name").alias("type_name"), F.col("_data._begins").alias("begins"), "_data.strings", "_data.calls",
        )
        texts = _builder_texts(builder_calls(stmts, keys=keys), keys, file).where("decl_id IS NOT NULL").select(
            *_ids(keys), F.col("decl_id").alias("pos"),
            F.struct(F.col("variable").alias("name"), F.col("decl_line").alias("line_number"), "appends", "content").alias("builder"),
        )
        facts = placed.unionByName(texts, allowMissingColumns=True).groupBy(*_ids(keys), "pos").agg(
            *[F.any_value(c, True).alias(c) for c in _FACTS], F.collect_list("builder").alias("builders"),
        )
    facts = facts.where("method IS NOT NULL")
    # Fields of a class inside a method are no locals, and what they are set to is not called here; its scope stays.
    in_code = ~F.col("scope.kind").isin(*_MEMBER_SCOPES)
    facts = facts.withColumns({c: F.when(in_code, F.col(c)) for c in ("strings", "builders", "calls")})
    in_order = lambda c: F.array_sort(
        F.flatten(F.collect_list(F.transform(c, lambda v, i: F.struct(F.col("pos").alias("pos"), i.alias("i"), v.alias("v")))))
    ).alias(c)
    own = F.col("scope.id") == F.col("method.id")
    per_scope = facts.groupBy(*file, F.col("method.id").alias("_method"), F.col("scope.id").alias("_scope")).agg(
        *_rest(keys, file),
        F.any_value("method").alias("method"), F.any_value("type_name", True).alias("type_name"),
        F.any_value(F.when(F.col("begins") & ~own, F.col("parent")), True).alias("parent"),
        F.any_value("scope.kind").alias("kind"), F.any_value("scope.line_number").alias("line_number"),
        in_order("strings"), in_order("calls"),
        F.array_sort(F.flatten(F.collect_list(F.transform("builders", lambda v: F.struct(F.col("pos").alias("pos"), v.alias("v")))))).alias("builders"),
    )
    values = lambda rows: F.transform(rows, lambda r: r["v"])
    record = F.struct(
        F.col("_scope").alias("id"), "parent", "kind", "line_number", values("strings").alias("strings"), values("builders").alias("builders"),
        values("calls").alias("calls"),
    )
    per_method = per_scope.groupBy(*file, "_method").agg(
        *_rest(keys, file),
        F.any_value("method").alias("method"), F.any_value("type_name", True).alias("type_name"), F.array_sort(F.collect_list(record)).alias("found")
    )
    starts = F.transform("found", lambda x: x["id"])
    scopes_of = F.transform(
        "found",
        lambda x, i: F.struct(
            i.alias("ordinal"), F.nullif(F.array_position(starts, F.coalesce(x["parent"], F.lit(-1))), F.lit(0)).cast("int").alias("parent"),
            x["kind"].alias("kind"), x["line_number"].alias("line_number"), x["strings"].alias("strings"), x["builders"].alias("builders"),
            x["calls"].alias("calls"),
        ),
    )
    return per_method.select(
        *_ids(keys), "_method", "method", "type_name",
        F.transform(scopes_of, lambda x: x.withField("parent", x["parent"] - 1)).alias("scopes"),
    )


def all_documents(files: DataFrame, keys: Sequence[str] = FILE_KEY, content: str = "content") -> DataFrame:
    """The document of every file, with the scopes of its methods; for empty and missing text one without any fact."""
    keys = list(keys)
    documents = file_documents(statements(files, keys, content), keys, with_scopes=True)
    empty = files.filter(F.coalesce(F.col(content), F.lit("")) == "").select(*keys)
    return documents.unionByName(
        empty.select(*keys, *[
            (F.lit(None) if name == "package_name" else F.array()).cast(documents.schema[name].dataType).alias(name)
            for name in documents.columns if name not in keys
        ])
    )


def file_documents(stmts: DataFrame, keys: Sequence[str] = FILE_KEY, with_scopes: bool = False) -> DataFrame:
    """One nested document per file: package, imports, types with their fields and methods.

    A file that declares nothing has a document too, unless it is empty text. With `with_scopes` each method has the
    `scopes` of its `method_documents`, NULL where it has no body. All facts of a file come from its own row, so the
    groups are no larger than the file.
    """
    keys = list(keys)
    at_top = F.col("depth") == 0
    package = F.regexp_extract("body", rf"^package\s++([{X.WORD}$.]++)", 1)
    imported = F.regexp_extract("body", rf"^import\s++(?:static\s++)?+({J.ID}++(?:\.{J.ID}++)*+)", 1)
    fact = (
        F.when(F.col("shape") == "type", "type").when(_maybe_method(), "method").when(_maybe_field(), "field")
        .when(at_top & (package != ""), "package").when(at_top & (imported != ""), "import").when(F.col("pos") == 0, "file")
    )
    payload = ["fact", "shape", "name", "body", "line_number", "lead", "first_line"]
    file = _file(stmts, keys)
    placed = _owners(stmts.withColumn("fact", fact), F.col("fact").isNotNull(), payload, keys, parts=("id", "kind"))
    owned = placed.select(*_ids(keys), "pos", "scope_kind", "_data.*", F.col("_type.id").alias("type_id")).filter(
        ~F.col("fact").isin("method", "field") | F.col("scope_kind").isin(*_MEMBER_SCOPES)
    ).withColumn("annotations", _annotations())
    owner = F.when(F.col("fact") == "type", F.col("pos") + 1).when(
        F.col("fact").isin("method", "field"), F.col("type_id")
    )
    detailed = owned.select(
        *_ids(keys), "pos", "fact", owner.alias("_owner"),
        F.when(F.col("fact") == "package", package).when(F.col("fact") == "import", imported).alias("text"),
        F.when(
            F.col("fact") == "type",
            F.struct(
                F.col("name").alias("name"), J.type_kind(F.col("body")).alias("kind"), "line_number",
                J.extends_of(F.col("body")).alias("extends"), J.implements_of(F.col("body")).alias("implements"),
                "annotations",
            ),
        ).alias("type"),
        F.when(
            F.col("fact") == "method",
            F.struct(
                F.col("pos").alias("pos"), F.col("name").alias("name"), "line_number",
                F.when(F.col("shape") == "constructor", "").otherwise(
                    J.compact(F.regexp_extract("body", J.METHOD_HEADER, 1))).alias("return_type"),
                "annotations",
            ),
        ).alias("method"),
        F.when(
            F.col("fact") == "field",
            F.transform(
                _declared(),
                lambda d, ordinal: F.struct(
                    F.col("pos").alias("pos"), ordinal.alias("ordinal"), d["name"].alias("name"), F.col("line_number").alias("line_number"),
                    J.compact(F.regexp_extract("body", J.FIELD_HEADER, 1)).alias("type"),
                    X.nullif_empty(J.compact(d["value"])).alias("value"), F.col("annotations").alias("annotations"),
                ),
            ),
        ).alias("fields"),
    )
    if with_scopes:
        # The scopes come to the row where their method begins; files stay where they are.
        found = _method_scopes(stmts, keys).select(*_ids(keys), (F.col("_method") - 1).cast("int").alias("pos"), "scopes")
        merged = detailed.unionByName(found, allowMissingColumns=True).groupBy(*file, "pos").agg(
            *_rest(keys, file), *[F.any_value(c, True).alias(c) for c in (*detailed.columns[len(_ids(keys)) + 1 :], "scopes")]
        )
        scoped = F.col("method").withField("scopes", F.col("scopes"))
        detailed = merged.where("fact IS NOT NULL").withColumn("method", F.when(F.col("method").isNotNull(), scoped)).drop("scopes")
    per_type = detailed.groupBy(*file, "_owner").agg(
        *_rest(keys, file),
        F.max("pos").alias("pos"),
        F.max(F.when(F.col("fact") == "package", F.col("text"))).alias("package_name"),
        F.array_sort(F.collect_list(F.when(F.col("fact") == "import", F.struct("pos", "text")))).alias("_imports"),
        F.any_value(F.col("type"), True).alias("_type"),
        F.array_sort(F.flatten(F.collect_list("fields"))).alias("fields"),
        F.array_sort(F.collect_list("method")).alias("methods"),
    )
    types = F.when(F.col("_owner").isNotNull(), F.struct("_owner", "_type", "fields", "methods"))
    documents = per_type.groupBy(*file).agg(
        *_rest(keys, file),
        F.max("package_name").alias("package_name"),
        F.flatten(F.collect_list(F.transform("_imports", lambda i: i["text"]))).alias("imports"),
        F.transform(
            F.array_sort(F.collect_list(types)),
            lambda t: F.struct(
                t["_type"]["name"].alias("name"), t["_type"]["kind"].alias("kind"),
                t["_type"]["line_number"].alias("line_number"), t["_type"]["extends"].alias("extends"),
                t["_type"]["implements"].alias("implements"), t["_type"]["annotations"].alias("annotations"),
                t["fields"].alias("fields"), t["methods"].alias("methods"),
            ),
        ).alias("types"),
    )
    return documents.select(*keys, "package_name", "imports", "types")
