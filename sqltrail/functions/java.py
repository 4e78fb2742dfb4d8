"""Java text as built-in column expressions: statements, declarations, annotations and calls.

No grammar is used. A file is cut into statements at `;`, `{` and `}` outside literals, comments,
annotation arguments and initialisers in braces; each statement is then read with patterns. Loops are
possessive, which the regex engine runs without recursion, so long files and literals are safe.

Brackets nest to any depth. The patterns follow DEPTH levels; in files that nest deeper, `fold` walks
the text's pieces with a running depth and stands other signs in for the brackets below those levels,
which the patterns pass over and `unfold` turns back. A lambda body inside call arguments is cut out of
them; an initialiser in braces is one value, classes inside it included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltrail.functions.text import WORD, nullif_empty

#: Levels of brackets that the patterns follow, with one copy of a loop for each; deeper ones are folded.
DEPTH = 8
BRACKETS = "(){}<>"
#: What stands for deeper brackets: code points that are no characters and may not stand in a text that is exchanged.
FOLDED = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5"
#: Pieces of a text that are walked together.
RUN_PIECES = 128
ID = rf"[{WORD}$]"
TEXT_BLOCK = r'"""[\s\S]*?"""'
STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
CHAR = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
LITERAL = rf"{TEXT_BLOCK}|{STRING}|{CHAR}"
COMMENT = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"


def _nested(opener: str, closer: str, depth: int) -> str:
    """Text in which `opener` and `closer` balance, to `depth` levels, literals and comments aside."""
    atom = rf"[^{opener}{closer}\"'/]++|{LITERAL}|{COMMENT}|[\"'/]"
    pattern = rf"(?:{atom})*+"
    for _ in range(depth):
        pattern = rf"(?:{atom}|{opener}{pattern}{closer})*+"
    return pattern


def _nested_angles(depth: int, other: str = "[^<>]") -> str:
    pattern = f"{other}*+"
    for _ in range(depth):
        pattern = rf"{other}*+(?:<{pattern}>{other}*+)*+"
    return pattern


ARGS = _nested(r"\(", r"\)", DEPTH - 1)
BRACES = _nested(r"\{", r"\}", DEPTH - 1)
GENERIC = rf"<{_nested_angles(DEPTH - 1)}>"
ANNOTATION = rf"@(?!interface\b){ID}++(?:\.{ID}++)*+(?:\s*+\({ARGS}\))?+"
# Braces that a value begins with, as in `= {` and `[] {`, and those after `default`.
# The brace comes first, so that only there is looked back.
_VALUE_BRACE = r"\{(?<=[=\]]\s{0,9}\{|\bdefault\s{1,9}\{)"
INITIALISER = rf"{_VALUE_BRACE}{BRACES}\}}"
# Plain text comes first, as it is tried most often; no other choice begins with its signs.
STATEMENT = rf"(?:[^\"'/;{{}}@]++|{LITERAL}|{COMMENT}|{ANNOTATION}|{INITIALISER}|[\"'/@])*+(?:[;{{}}]|\z)"
# An opening bracket that the patterns cannot pass over: what it holds nests too deep, or is not closed.
_IN_TYPE = r"[^<>;{}()=&|\"']"
_DEEP = rf"\({ARGS}\(|{_VALUE_BRACE}{BRACES}\{{|<{_nested_angles(DEPTH - 1, _IN_TYPE)}<"
# The text up to the first of these; what follows is not read.
DEEP = rf"\A(?:[^\"'/({{<]++|{LITERAL}|{COMMENT}|(?!{_DEEP})[\s\S])*+(?:{_DEEP})"
# Text in front of a bracket that leaves the depths as they are.
_PLAIN = r"[^\"'/@(){}<>;=&|]*+"
_MARK = rf"@{ID}++(?:\.{ID}++)*+\s*+\("
# Brackets of one kind that follow each other are one piece, so a file has few pieces however deep it nests.
PIECE = (
    rf"{LITERAL}|{COMMENT}|{_MARK}(?:\s*+\{{\s*+{_MARK})*+|(?:{_PLAIN}\()++|(?:{_PLAIN}<)++|\)++|\{{++|\}}++|>++|;"
    r"|[^\"'/@(){}<>;]++|[\"'/@]"
)

# Words that may stand before a declaration.
MODIFIERS = (
    "public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|"
    "default|sealed|non-sealed"
)
LEAD = rf"^(?:\s++|{COMMENT}|{ANNOTATION}|(?:{MODIFIERS})(?!{ID}|\s*+[:(]))*+"
# Words that look like calls or types but are not.
_CONTROL = "if|for|while|switch|catch|synchronized|try|else|do|return|throw|new|case|finally|assert|yield|super|this"

TYPE = rf"{ID}++(?:\.{ID}++)*+(?:\s*+{GENERIC})?+(?:\s*+\[\s*+\])*+"
TYPE_HEADER = rf"^(class|interface|enum|record|@interface)\s++({ID}++)"
METHOD_HEADER = (
    rf"^(?:{GENERIC}\s*+)?(?!(?:{_CONTROL})(?!{ID}))({TYPE})\s++({ID}++)\s*+\({ARGS}\)"
    rf"(?:\s*+\[\s*+\])*+\s*+(?:throws\s++[^;{{]*+|default\s++[^;{{]*+)?+$"
)
CONSTRUCTOR_HEADER = rf"^(?!(?:{_CONTROL})(?!{ID}))({ID}++)\s*+\({ARGS}\)\s*+(?:throws\s++[^;{{]*+)?+$"
ANONYMOUS_HEADER = rf"(?<!{ID})new\s++{TYPE}\s*+\({ARGS}\)\s*+$"
FIELD_HEADER = rf"^(?!(?:{_CONTROL}|import|package)(?!{ID}))({TYPE})\s++(?={ID}++\s*+(?:\[\s*+\]\s*+)*+(?:[=,]|$))"
STRING_LOCAL = rf"^(?:(?:case\b[^:]*+|default\s*+):\s*+)*+(?:for\s*+\(\s*+)?+(?:final\s++)?+(String|StringBuilder)\s++(?={ID}++\s*+(?:[=,]|$))"
# One declared name with its initialiser, up to the next comma that is not nested.
_VALUE = rf"(?:[^,()\"'{{}}/]++|{LITERAL}|{COMMENT}|\({ARGS}\)|\{{{BRACES}\}}|[\"'/(){{}}])*+"
DECLARATOR = rf"({ID}++)\s*+(?:\[\s*+\]\s*+)*+(?:=\s*+({_VALUE}))?+(?:,\s*+|\s*+$)"
ANNOTATION_PAIR = rf"\s*+({ID}++)\s*+=\s*+({_VALUE})(?:,|$)"
REASSIGNED = rf"(?:^|[\s);:])((?:this\.)?+{ID}++)\s*+=\s*+new\s++(String|StringBuilder)\s*+[(<]"
# `.append(…)` calls on one name; literals are matched first, so that text inside them is not read.
CHAIN = rf"(?:{LITERAL})|(?<!{ID})(?:this\s*+\.\s*+)?+{ID}++(?:\s*+\.\s*+append\s*+\({ARGS}(?:\)|\z))++"
APPEND = rf"\.\s*+append\s*+\(({ARGS})(?:\)|\z)"
LITERAL_TEXT = rf'{CHAR}|"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"'
NUMBER = rf"(?<![{WORD}.$])[0-9][0-9A-Fa-f_.xXlLdD]*+"


_PARAMETERS = "array<struct<key:string,value:string>>"
_ANNOTATIONS = f"array<struct<name:string,line_number:int,arguments:string,parameters:{_PARAMETERS}>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, then) -> Column:
    """What `then` makes of `value`, which is worked out once however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def runs_of(items: Column) -> Column:
    """`items` in runs of RUN_PIECES, for walks that join their results at the end."""
    starts = F.sequence(F.lit(0), F.floor(F.size(items) / RUN_PIECES).cast("int"))
    return F.transform(starts, lambda i: F.slice(items, i * RUN_PIECES + 1, F.lit(RUN_PIECES)))


def is_deep(content: Column) -> Column:
    """Whether brackets may nest below the levels that the patterns follow."""
    return content.rlike(DEEP)


def _fold_from(text: Column, opener: str, plain: Column, count: Column) -> Column:
    """`text` with `count` opening brackets, those after the first `plain` ones folded."""
    head = F.call_function("substring_index", text, F.lit(opener), plain)
    sign = FOLDED[BRACKETS.index(opener)]
    rest = F.replace(F.substring(text, F.length(head) + 2, F.length(text)), F.lit(opener), F.lit(sign))
    return F.when(plain >= count, text).when(plain <= 0, F.replace(text, F.lit(opener), F.lit(sign))).otherwise(F.concat(head, F.lit(opener), rest))


def _fold_to(closer: str, folded: Column, count: Column) -> Column:
    """`count` closing brackets, the first `folded` ones folded."""
    deep = F.least(F.greatest(folded, F.lit(0)), count)
    return F.concat(F.repeat(F.lit(FOLDED[BRACKETS.index(closer)]), deep), F.repeat(F.lit(closer), count - deep))


def fold(content: Column) -> Column:
    """`content` with other signs for the brackets below DEPTH levels, so that patterns of that depth hold.

    Pieces (literals, comments, runs of one kind of bracket, the rest) are walked in order with the depth of parentheses,
    of braces of an initialiser and of angle brackets. Parentheses start anew at the end of a statement. The walk goes
    over runs of RUN_PIECES pieces, whose texts are joined at the end, so its cost grows with the length of the text.
    """
    names = ("parens", "annotation", "braces", "angles", "before")
    none = F.struct(*[F.lit(0).alias(c) for c in names[:4]], F.lit("").alias("before"), F.lit("").alias("out"))

    def described(x: Column) -> Column:
        """A piece with its kind (what it ends with: a bracket, `;`; else text or other) and how many of these it has."""
        first, last = F.left(x, F.lit(1)), F.right(x, F.lit(1))
        kind = F.when(first.isin('"', "'") | x.startswith("//") | x.startswith("/*"), "other").when(
            (first == "@") & (last == "("), "@").when(last.isin(*BRACKETS, ";"), last).otherwise("text")
        opener = F.when(first == "@", "(").otherwise(last)
        count = F.when(kind.isin("other", "text"), 0).otherwise(F.length(x) - F.length(F.replace(x, opener, F.lit(""))))
        return F.struct(x.alias("x"), kind.alias("kind"), count.cast("int").alias("count"))

    def after(s: Column, piece: Column) -> Column:
        parens, annotation, braces, angles = s["parens"], s["annotation"], s["braces"], s["angles"]
        x, kind, count = piece["x"], piece["kind"], piece["count"]
        plain = annotation == 0
        value = plain & ((braces > 0) | s["before"].isin("=", "]", "default"))
        zero = F.lit(0)
        closed = lambda depth: F.greatest(depth - count, zero)

        def become(out: Column, **changed: Column) -> Column:
            return F.struct(*[changed.get(name, s[name]).alias(name) for name in names], F.concat(s["out"], out).alias("out"))

        bare = F.rtrim(x, F.lit(" \t\n\r\f"))
        comment = x.startswith("//") | x.startswith("/*")
        seen = F.when((bare == "") | comment, s["before"]).when(bare.rlike(r"(?s)(^|\W)default$"), "default").otherwise(F.right(bare, F.lit(1)))
        opened = _fold_from(x, "(", DEPTH - parens, count)
        return (
            F.when(kind == "other", become(x, before=seen))
            .when(kind == "text", become(x, before=seen, angles=F.when(x.rlike(r"^[^\"'/].*[=&|]|^[=&|]"), 0).otherwise(angles)))
            .when(kind == "(", become(opened, parens=parens + count, angles=zero, before=kind))
            .when(kind == ")", become(
                _fold_to(")", parens - DEPTH, count), parens=closed(parens), angles=zero, before=kind,
                annotation=F.when(annotation > closed(parens), 0).otherwise(annotation),
            ))
            .when(kind == "{", become(
                F.when(value, _fold_from(x, "{", DEPTH - braces, count)).otherwise(x), braces=F.when(value, braces + count).otherwise(braces),
                parens=F.when(plain & ~value, 0).otherwise(parens), angles=zero, before=kind,
            ))
            .when(kind == "}", become(
                F.when(plain, _fold_to("}", braces - DEPTH, count)).otherwise(x), braces=F.when(plain, closed(braces)).otherwise(braces),
                parens=F.when(plain & (count > braces), 0).otherwise(parens), angles=zero, before=kind,
            ))
            .when(kind == "<", become(_fold_from(x, "<", DEPTH - angles, count), angles=angles + count, before=kind))
            .when(kind == ">", become(_fold_to(">", angles - DEPTH, count), angles=closed(angles), before=kind))
            # Braces between the marks of a run stand inside the first one's parentheses.
            .when(kind == "@", become(
                opened, parens=parens + count, annotation=F.when(plain, parens + 1).otherwise(annotation),
                angles=F.when(x.contains("{"), 0).otherwise(angles), before=F.lit("("),
            ))
            .otherwise(become(x, parens=F.when(plain & (braces == 0), 0).otherwise(parens), angles=zero, before=kind))
        )

    def with_out(s: Column, out: Column) -> Column:
        return F.struct(*[s[name].alias(name) for name in names], out.alias("out"))

    def walk(s: Column, run: Column) -> Column:
        last = F.aggregate(run, with_out(s["state"], F.lit("")), after)
        return let(last, lambda found: F.struct(found.alias("state"), F.array_append(s["outs"], found["out"]).alias("outs")))

    runs = let(F.transform(_all(content, PIECE), described), runs_of)
    start = F.struct(none.alias("state"), F.array().cast("array<string>").alias("outs"))
    return F.array_join(F.aggregate(runs, start, walk)["outs"], "")


def unfold(text: Column) -> Column:
    """The brackets that `fold` replaced."""
    return F.translate(text, FOLDED, BRACKETS)


def split_statements(content: Column) -> Column:
    """Statements with their end mark, comments included; together they are the whole content, deep brackets folded."""
    return _all(F.when(is_deep(content), fold(content)).otherwise(content), STATEMENT)


def depth_of(content: Column) -> Column:
    """How deep the scopes of a text nest at most."""
    mark = lambda raw: F.right(raw, F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def after(s: Column, raw: Column) -> Column:
        depth = s["depth"] + F.when(mark(raw) == "{", 1).when(mark(raw) == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(s["most"], depth).alias("most"))

    return F.aggregate(split_statements(content), start, after, lambda s: s["most"])


def without_comments(text: Column) -> Column:
    """Text without its comments; the line ends inside them stay, so that lines can be counted in what is left."""
    pieces = _all(text, rf"{LITERAL}|{COMMENT}|[^\"'/]++|[\"'/]")
    shortened = lambda x: F.when(x.startswith("/*"), F.regexp_replace(x, r"[^\n]++", "")).when(x.startswith("//"), "").otherwise(x)
    return (
        F.when(~text.contains("/"), text).when(text.contains("/*") & text.contains("\n"), F.array_join(F.transform(pieces, shortened), ""))
        .otherwise(F.regexp_replace(text, rf"({LITERAL})|{COMMENT}", "$1"))
    )


def end_mark(raw: Column) -> Column:
    last = F.right(raw, F.lit(1))
    return F.when(last.isin(";", "{", "}"), last).otherwise("")


def lead_of(raw: Column) -> Column:
    """White space, comments, annotations and modifiers in front."""
    return F.regexp_extract(raw, LEAD, 0)


def core_of(raw: Column, lead: Column, mark: Column) -> Column:
    """The statement between lead and end mark, comments included."""
    width = F.length(raw) - F.length(lead) - F.length(mark)
    return F.substring(raw, F.length(lead) + 1, width)


def body_of(core: Column) -> Column:
    """The statement without comments and outer white space."""
    return F.trim(without_comments(core), F.lit(" \t\n\r\f"))


def compact(text: Column) -> Column:
    """Text without white space outside literals, with all its brackets."""
    bare = lambda x: unfold(F.regexp_replace(without_comments(x), rf"({LITERAL})|\s++", "$1"))
    return let(text, lambda x: F.when(x.rlike(rf"[\s/{FOLDED}]"), bare(x)).otherwise(x))


def literal_texts(text: Column) -> Column:
    """Contents of the string literals, in order."""
    return _all(text, LITERAL_TEXT, 1)


def declarators(text: Column) -> Column:
    """Names and initialisers of a declaration list; no initialiser is empty text."""
    pairs = lambda x: F.arrays_zip(_all(x, DECLARATOR, 1).alias("name"), _all(x, DECLARATOR, 2).alias("value"))
    return let(text, pairs)


def type_refs(text: Column) -> Column:
    """Types of a comma-separated list, as name and generic parameters."""
    ref = rf"({ID}++(?:\.{ID}++)*+)\s*+({GENERIC})?"
    names, generics = _all(text, ref, 1), _all(text, ref, 2)
    return F.transform(
        F.arrays_zip(names.alias("n"), generics.alias("g")),
        lambda r: F.struct(
            r["n"].alias("name"),
            F.transform(
                _all(F.regexp_replace(r["g"], r"^<|>$", ""), rf"[^,<>]++(?:{GENERIC})?+"), compact
            ).alias("generics"),
        ),
    )


def _after_name(header: Column) -> Column:
    return F.regexp_replace(header, rf"{TYPE_HEADER}\s*+(?:{GENERIC})?+", "")


def extends_of(header: Column) -> Column:
    return type_refs(
        F.regexp_extract(_after_name(header), r"(?s)^\s*+extends\s++(.*?)(?:\simplements\s|\spermits\s|$)", 1)
    )


def implements_of(header: Column) -> Column:
    listed = F.regexp_extract(
        _after_name(header), r"(?s)(?:^|\s)implements\s++(.*?)(?:\spermits\s|$)", 1
    )
    return F.transform(_all(listed, rf"{ID}++(?:\.{ID}++)*+(?:\s*+{GENERIC})?+"), compact)


def annotations_of(lead: Column, first_line: Column) -> Column:
    """Annotations of a declaration: name, line, raw arguments and parameters.

    A lone value is stored under the annotation's own name. Of repeated parameters the last counts.
    """
    piece = rf"{COMMENT}|{ANNOTATION}|\s++|{ID}++|[\s\S]"

    def described(text: Column, index: Column, pieces: Column) -> Column:
        name = F.regexp_extract(text, rf"^@({ID}++(?:\.{ID}++)*+)", 1)
        arguments = F.when(text.contains("("), F.regexp_extract(text, r"(?s)^[^(]*+(\(.*\))\s*+$", 1)).otherwise("")
        return let(F.struct(name.alias("name"), arguments.alias("arguments")), lambda x: entry(x["name"], x["arguments"], index, pieces))

    def entry(name: Column, arguments: Column, index: Column, pieces: Column) -> Column:
        entries = F.when(arguments == "", F.array().cast(_PARAMETERS)).otherwise(let(F.regexp_extract(arguments, r"(?s)^\((.*)\)$", 1), lambda x: parameters(name, x)))
        before = F.array_join(F.slice(pieces, F.lit(1), index), "")
        return F.struct(
            name.alias("name"),
            (first_line + newlines(before)).cast("int").alias("line_number"),
            unfold(arguments).alias("arguments"),
            entries.alias("parameters"),
        )

    def parameters(name: Column, inside: Column) -> Column:
        pairs = F.transform(
            F.arrays_zip(_all(inside, ANNOTATION_PAIR, 1).alias("k"), _all(inside, ANNOTATION_PAIR, 2).alias("v")),
            lambda p: F.struct(p["k"].alias("key"), compact(p["v"]).alias("value")),
        )
        named = inside.rlike(rf"^\s*+{ID}++\s*+=(?!=)")
        return (
            F.when(named, pairs)
            .when(F.trim(inside) != "", F.array(F.struct(name.alias("key"), compact(inside).alias("value"))))
            .otherwise(F.array().cast(_PARAMETERS))
        )

    def found(pieces: Column) -> Column:
        numbered = F.transform(pieces, lambda text, index: F.struct(text.alias("text"), index.alias("index")))
        kept = F.filter(numbered, lambda p: p["text"].startswith("@"))
        return F.transform(kept, lambda p: described(p["text"], p["index"], pieces))

    # What stands before a declaration seldom has an annotation; nothing is looked for where there is none.
    return F.when(lead.contains("@"), let(_all(lead, piece), found)).when(lead.isNotNull(), F.array().cast(_ANNOTATIONS))


def parameter(annotation: Column, key: str) -> Column:
    """Value of one parameter, NULL if absent."""
    return F.try_element_at(F.filter(annotation["parameters"], lambda p: p["key"] == key), F.lit(-1))["value"]


def calls_of(code: Column) -> Column:
    """`.append` chains of a statement: variable, chain text, and the line ends before the chain."""
    found = F.filter(_all(code, CHAIN), lambda text: ~text.substr(1, 1).isin('"', "'"))
    variable = rf"^(?:this\s*+\.\s*+)?+{ID}++"
    before = lambda text: F.substring(code, F.lit(1), F.instr(code, text) - 1)
    return F.transform(
        found,
        lambda text: F.struct(
            F.regexp_replace(F.regexp_extract(text, variable, 0), r"\s++", "").alias("variable"),
            F.regexp_replace(text, variable, "").alias("chain"),
            F.when(code.contains("\n"), newlines(before(text))).otherwise(0).alias("lines"),
        ),
    )


def fragments_of(chain: Column, line: Column) -> Column:
    """String literals of a chain that begins in `line`: text and the line each stands in."""
    pieces = _all(chain, rf"{LITERAL}|[^\"']++|[\"']")
    numbered = F.transform(pieces, lambda piece, i: F.struct(piece.alias("piece"), i.alias("i")))
    return F.transform(
        F.filter(numbered, lambda p: p["piece"].startswith('"')),
        lambda p: F.struct(
            F.array_join(literal_texts(p["piece"]), "").alias("text"),
            (line + F.when(chain.contains("\n"), newlines(F.array_join(F.slice(pieces, F.lit(1), p["i"]), ""))).otherwise(0)).cast("int").alias("line_number"),
        ),
    )


def receiver_calls(code: Column) -> Column:
    """Calls of a statement as receiver and method; a call on nothing or on `this` has an empty receiver.

    Calls on what another call or a field of another object gives, and constructors, are left out.
    """
    pattern = (
        rf"{LITERAL}|(?<![{WORD}$.])new\s++{ID}++(?:\.{ID}++)*+|(?<![{WORD}$.])(?:this\s*+\.\s*+)?+(?:({ID}++)\s*+\.\s*+)?+"
        rf"(?!(?:{_CONTROL})(?!{ID}))({ID}++)\s*+\("
    )
    pairs = F.arrays_zip(_all(code, pattern, 1).alias("receiver"), _all(code, pattern, 2).alias("method"))
    return F.filter(pairs, lambda c: c["method"] != "")


def first_literal(chain: Column) -> Column:
    """First argument of the first call when it is one literal, quotes dropped; else empty."""
    first = F.try_element_at(_all(chain, APPEND, 1), F.lit(1))
    alone = F.regexp_extract(first, rf"^\s*+({LITERAL}|-?{NUMBER}|true|false|null)\s*+(?:,|$)", 1)
    return F.replace(alone, F.lit('"'), F.lit(""))


def literal_values(text: Column) -> Column:
    """Every literal of an expression, numbers too, joined without quotes."""
    found = _all(text, rf"{LITERAL}|{NUMBER}|(?<!{ID})(?:true|false|null)(?!{ID})")
    return F.replace(F.array_join(found, ""), F.lit('"'), F.lit(""))


def type_kind(body: Column) -> Column:
    """class, interface, enum, record or annotation; NULL for other statements."""
    return nullif_empty(F.replace(F.regexp_extract(body, TYPE_HEADER, 1), F.lit("@interface"), F.lit("annotation")))
