"""Queries that are named after what they do: `findFirst3ByNameAndAgeGreaterThanOrderByNameDesc`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that begin such a name, by what the query does.
READ_WORDS = ("find", "read", "get", "query", "search", "stream")
COUNT_WORDS = ("count", "exists")
CHANGE_WORDS = ("delete", "remove")
# Conditions that may end a part of a name.
CONDITIONS = (
    "IsGreaterThanEqual", "GreaterThanEqual", "IsLessThanEqual", "LessThanEqual", "IsNotContaining", "NotContaining",
    "IsStartingWith", "StartingWith", "IsNotNull", "NotNull", "IsGreaterThan", "GreaterThan", "IsEndingWith", "EndingWith",
    "IsContaining", "Containing", "IsLessThan", "LessThan", "IsNotEmpty", "NotEmpty", "IsBetween", "Between", "IsNotLike",
    "NotLike", "IsBefore", "Before", "IsAfter", "After", "IsNotIn", "NotIn", "IsEmpty", "IsFalse", "IsTrue", "IsNull",
    "Equals", "IsLike", "IsNot", "Empty", "False", "True", "Null", "Like", "IsIn", "Not", "In", "Is",
)

_START = rf"^({'|'.join((*READ_WORDS, *COUNT_WORDS, *CHANGE_WORDS))})(?![a-z])"
_SUBJECT = rf"{_START}((?:(?!By(?![a-z]))[A-Za-z0-9_$])*+)(?:By([A-Z_$].*))?$"
_JOINED = "(?<=[a-z0-9_$])(?:And|Or)(?=[A-Z_$])"


def _property(part: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(part, "(?:AllIgnoreCase|AllIgnoringCase|IgnoreCase|IgnoringCase)$", ""), rf"(?<=.)(?:{'|'.join(CONDITIONS)})$", "")
    return F.concat(F.lower(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare)))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda part: part != "")


def derived_query(name: Column) -> Column:
    """What a name says, NULL if it does not begin as one: `action` (read, count, exists, delete), `is_distinct`, `most`
    (rows at most, NULL if all), `properties` asked for and `ordered` (property with ` asc` or ` desc`)."""
    word = F.regexp_extract(name, _START, 1)
    subject = F.regexp_extract(name, _SUBJECT, 2)
    rest = F.regexp_extract(name, _SUBJECT, 3)
    condition = F.regexp_replace(rest, "OrderBy[A-Z_$].*$", "")
    order = F.regexp_extract(rest, "OrderBy([A-Z_$].*)$", 1)
    limit = F.regexp_extract(subject, r"(?:First|Top)([0-9]*)", 1)
    ordered = F.transform(
        _parts(F.regexp_replace(order, "(Asc|Desc)(?=[A-Z_$]|$)", "$1,"), ","),
        lambda part: F.concat(_property(F.regexp_replace(part, "(?:Asc|Desc)$", "")), F.when(part.endswith("Desc"), " desc").otherwise(" asc")),
    )
    action = F.when(word.isin(*READ_WORDS), "read").when(word.isin(*CHANGE_WORDS), "delete").otherwise(word)
    return F.when(
        word != "",
        F.struct(
            action.alias("action"), subject.contains("Distinct").alias("is_distinct"),
            F.when(subject.rlike("First|Top"), F.when(limit == "", 1).otherwise(limit.try_cast("int"))).alias("most"),
            F.transform(_parts(condition, _JOINED), _property).alias("properties"), ordered.alias("ordered"),
        ),
    )
