"""Literals, tokens, operations and SQL targets as built-in column expressions.

Patterns are constants, so each task compiles them once. Character classes are written out to
mean the same as in Python: WS is what `str.isspace` accepts, WORD what `\\w` accepts on text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltrail.constants import CP1252_HIGH, MODIFY_KEYWORDS, READ_KEYWORDS

WS = r"\x20\t-\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Common characters come first in a class: the regex engine tries its parts in order.
WORD = r"a-z_A-Z0-9\p{L}\p{N}"
_WIDE_WS = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The characters of WS.
_BLANKS = "".join(map(chr, (0x20, *range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NOT_DELIMITER = rf"[<-\x7f\--9!-+\x00-\x08\x0e-\x1b[^\x00-\x7f{_WIDE_WS}]]"
_DELIMITER = rf"[\x20,;:\t-\r\x1c-\x1f{_WIDE_WS}]"

DOUBLE_QUOTED = r'(?d)"(.*?)"'
SINGLE_QUOTED = r"(?d)'(.*?)'"
_ESCAPED_SINGLE = r"'[^\\']*+(?:\\.[^\\']*+)*+'"
_ESCAPED_DOUBLE = r'"[^\\"]*+(?:\\.[^\\"]*+)*+"'
_ESCAPED_BACKTICK = r"`[^\\`]*+(?:\\.[^\\`]*+)*+`"
JS_LITERAL = rf"(?d){_ESCAPED_SINGLE}|{_ESCAPED_DOUBLE}|{_ESCAPED_BACKTICK}"
PHP_LITERAL = rf"(?d){_ESCAPED_SINGLE}|{_ESCAPED_DOUBLE}"

_READ = "|".join(READ_KEYWORDS)
_MODIFY = "|".join(MODIFY_KEYWORDS)
# One stretch of a literal: its first token, then every token up to the next keyword.
STRETCH = (
    rf"{_NOT_DELIMITER}++"
    rf"(?:{_DELIMITER}++(?!(?:{_READ}|{_MODIFY})(?!{_NOT_DELIMITER})){_NOT_DELIMITER}++)*+"
)
STARTS_READ = rf"^(?:{_READ})(?!{_NOT_DELIMITER})"
STARTS_MODIFY = rf"^(?:{_MODIFY})(?!{_NOT_DELIMITER})"
_DELETE_FROM = rf"(?<!{_NOT_DELIMITER})DELETE{_DELIMITER}+FROM(?!{_NOT_DELIMITER})"

UPPER_IDENTIFIER = rf"(?<![{WORD}])[A-Z_][A-Z0-9_]*+(?![{WORD}])"
_LAST_FROM = rf"(?s)^.*[{WS}](?iu:FROM)[{WS}]+[{WORD}]+"
_SELECT_FROM = rf"(?s)(?iu:SELECT)[{WS}].*?[{WS}](?iu:FROM)[{WS}]+([{WORD}]+)"
_JOIN = rf"(?iu:JOIN)[{WS}]+([{WORD}]+)[{WS}]"
_CHANGE = rf"(?iu:(INSERT INTO|UPDATE|DELETE FROM))[{WS}]+([{WORD}]+)"

Extractor = Callable[[Column], Column]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def py_strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    # A pattern for the end would be tried at every blank inside the text.
    return F.btrim(text, F.lit(_BLANKS))


def decode_as(content: Column, encoding: str) -> Column:
    """Bytes to text with `\\n` line ends, from `utf-8` or `windows-1252`."""
    if encoding.lower() == "utf-8":
        text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
            F.raise_error(F.lit("content is not valid utf-8"))
        )
    elif encoding.lower() in ("windows-1252", "cp1252"):
        text = _from_cp1252(content)
    else:
        raise ValueError(f"unsupported encoding {encoding}")
    return normalize_newlines(text)


def decode_fallback(content: Column) -> Column:
    """Bytes to text: utf-8 where valid, windows-1252 elsewhere."""
    as_utf8 = content.cast("string")
    return normalize_newlines(
        F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(_from_cp1252(content))
    )


def _from_cp1252(content: Column) -> Column:
    latin = F.decode(content, "ISO-8859-1")
    return F.translate(latin, "".join(chr(0x80 + i) for i in range(32)), CP1252_HIGH)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def literals_dq(line: Column) -> Column:
    """Texts between double quotes, without the quotes."""
    return _all(line, DOUBLE_QUOTED, 1)


def literals_sq(line: Column) -> Column:
    """Texts between single quotes, without the quotes."""
    return _all(line, SINGLE_QUOTED, 1)


def literals_js(line: Column) -> Column:
    """Script literals in any of three quotes, with the quotes and their escapes."""
    return _all(line, JS_LITERAL)


def literals_php(line: Column) -> Column:
    """Literals in single or double quotes, with the quotes and their escapes."""
    return _all(line, PHP_LITERAL)


def whole_line(line: Column) -> Column:
    """The line as its own literal, for scripts that are SQL throughout."""
    return F.array(line)


EXTRACTORS: dict[str, Extractor] = {
    "java": literals_dq,
    "sql": literals_dq,
    "php": literals_php,
    "js": literals_js,
}


def literals_for_ext(
    line: Column, ext: Column, extractors: dict[str, Extractor] | None = None
) -> Column:
    """Literals by file suffix; other suffixes give an empty array."""
    by_function: dict[Extractor, list[str]] = {}
    for suffix, function in (extractors or EXTRACTORS).items():
        by_function.setdefault(function, []).append(suffix)
    result = None
    for function, suffixes in by_function.items():
        branch = F.lower(ext).isin(suffixes)
        result = F.when(branch, function(line)) if result is None else result.when(branch, function(line))
    return result.otherwise(F.array().cast("array<string>"))


def tokens(literal: Column) -> Column:
    """Parts between delimiters, empty parts kept."""
    return F.split(literal, rf"{_DELIMITER}[{WS}]*", -1)


def stretches(literal: Column, strict: bool = False) -> Column:
    """Upper-cased stretches of tokens that share one operation.

    Every stretch but the first starts with a keyword, so the operation of all its tokens is known
    from its first token. `strict` drops a FROM right after DELETE, which then stays a change.
    """
    upper = F.upper(literal)
    if strict:
        upper = F.regexp_replace(upper, _DELETE_FROM, "DELETE")
    return _all(upper, STRETCH)


def stretch_operation(stretch: Column) -> Column:
    """`R`, `M` or empty, from the first token."""
    return (
        F.when(stretch.rlike(STARTS_READ), "R").when(stretch.rlike(STARTS_MODIFY), "M").otherwise("")
    )


def stretch_tokens(stretch: Column) -> Column:
    """Tokens that are not empty."""
    return _all(stretch, rf"{_NOT_DELIMITER}++")


def read_targets(text: Column) -> Column:
    """Upper-cased names after SELECT … FROM, then after JOIN.

    The search for FROM stops at the last one there is, so text with many SELECT words and no FROM
    behind them is still scanned a constant number of times.
    """
    return F.transform(read_names(text), F.upper)


def read_names(text: Column) -> Column:
    """`read_targets` as they are written."""
    selected = _all(F.regexp_extract(text, _LAST_FROM, 0), _SELECT_FROM, 1)
    return F.concat(selected, _all(text, _JOIN, 1))


def modify_targets(text: Column) -> Column:
    """Upper-cased names after INSERT INTO, UPDATE and DELETE FROM."""
    return F.transform(modify_names(text), F.upper)


def modify_names(text: Column) -> Column:
    """`modify_targets` as they are written."""
    return _all(text, _CHANGE, 2)


def _found_at(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern whose last word is the group: the group, and where it begins in the text (from 1).

    Matches do not overlap and come in order, and equal texts match alike, so each is the first of its text
    after the one before.
    """
    pairs = F.arrays_zip(_all(text, pattern, 0).alias("whole"), _all(text, pattern, group).alias("name"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<name:string,at:int>>").alias("found"))

    def place(state: Column, match: Column) -> Column:
        at = F.call_function("locate", match["whole"], text, state["next"])
        end = at + F.length(match["whole"])
        name_at = end - F.length(F.regexp_extract(match["whole"], rf"[{WORD}]+[{WS}]?$", 0))
        return F.struct(end.alias("next"), F.array_append(state["found"], F.struct(match["name"].alias("name"), name_at.alias("at"))).alias("found"))

    return F.aggregate(pairs, start, place, lambda state: state["found"])


def read_hits(text: Column) -> Column:
    """`read_targets` with where each name begins."""
    selected = _found_at(F.regexp_extract(text, _LAST_FROM, 0), _SELECT_FROM, 1)
    return F.transform(F.concat(selected, _found_at(text, _JOIN, 1)), _upper_hit)


def modify_hits(text: Column) -> Column:
    """`modify_targets` with where each name begins."""
    return F.transform(_found_at(text, _CHANGE, 2), _upper_hit)


def _upper_hit(hit: Column) -> Column:
    return F.struct(F.upper(hit["name"]).alias("name"), hit["at"].alias("at"))


def upper_identifiers_of(text: Column) -> Column:
    """Identifiers written in upper case."""
    return _all(text, UPPER_IDENTIFIER)


def words_of(text: Column) -> Column:
    return _all(text, rf"[{WORD}]++")


def nullif_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def cast_or_null(value: Column, kind: str) -> Column:
    """Cast, NULL where the text does not fit; text that is no whole number is not tried as one."""
    cast = value.try_cast(kind)
    if kind.lower() in ("int", "integer", "long", "bigint", "smallint", "tinyint"):
        return F.when(value.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), cast)
    return cast


def package_name(content: Column) -> Column:
    return nullif_empty(F.regexp_extract(content, rf"package[{WS}]+([{WORD}.]+);", 1))


def first_class_name(content: Column) -> Column:
    return nullif_empty(F.regexp_extract(content, rf"class[{WS}]+([{WORD}]+)", 1))


def join_literals(expression: Column) -> Column:
    """Quoted fragments of a concatenation, joined.

    Each line is cut at its first `//`, quoted or not; a fragment may run over line breaks, which
    it loses.
    """
    uncommented = F.regexp_replace(expression, r"//[^\n]*+", "")
    return F.array_join(_all(F.replace(uncommented, F.lit("\n"), F.lit("")), r'"([^"]*+)"', 1), "")


def keywords_in_quotes(text: Column, words: Sequence[str]) -> Column:
    """Which of `words` occur in quoted text, sorted.

    A segment with a quote on both sides counts when it holds one of the words as a whole word; then
    every word found anywhere in the segment is reported.
    """
    whole = "|".join(quoted_pattern(w) for w in words)
    has_word = rf"(?<![{WORD}])(?:{whole})(?![{WORD}])"
    parts = F.split(text, '"', -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    segments = F.filter(inner, lambda part: part.rlike(has_word))
    listed = F.array(*[F.lit(w) for w in sorted(words)])
    return F.filter(listed, lambda word: F.exists(segments, lambda segment: segment.contains(word)))


def quoted_pattern(word: str) -> str:
    """A word as a literal pattern."""
    return r"\Q" + word + r"\E"


def action_label(read: Column, modified: Column) -> Column:
    """`read`, `modified`, both or empty."""
    return F.concat_ws(", ", F.when(read, "read"), F.when(modified, "modified"))
