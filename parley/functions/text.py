"""Text, array and JSON column functions.

All of these return ``Column`` expressions that stay inside whole-stage
codegen (regex and string functions) or run as JVM higher-order functions
(``transform``/``filter`` over arrays).  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schemas import UTTERANCES
from parley.session import cut_lineage

# Fixed values that define the cleaning contract.
DIGIT = r"\p{Nd}"  # any Unicode decimal digit
DIGIT_MASK = "X"  # digits become X, lowercased later to x
NOT_LETTER_OR_SPACE = r"[^\p{L} ]"  # everything but letters and U+0020 vanishes
LINE_BREAKS = r"[\r\n\t]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c: Column | str, separator: str | None = None) -> Column:
    """Mask digits, drop every non-letter except space, lowercase.

    Null becomes ``''``.  Newlines and tabs vanish without a space by default
    (words on both sides merge); ``separator=" "`` turns them into spaces.
    """
    text = F.coalesce(_col(c), F.lit(""))
    if separator is not None:
        text = F.regexp_replace(text, LINE_BREAKS, separator)
    text = F.regexp_replace(text, DIGIT, DIGIT_MASK)
    text = F.regexp_replace(text, NOT_LETTER_OR_SPACE, "")
    return F.lower(text)


def clean_text(c: Column | str, is_array: bool = False, separator: str | None = None) -> Column:
    """Scalar-or-list cleaning: a string column or an ``array<string>`` column."""
    if is_array:
        return F.transform(F.coalesce(_col(c), F.array()), lambda x: clean_string(x, separator))
    return clean_string(c, separator)


def tokenize(c: Column | str) -> Column:
    """Split cleaned text on runs of spaces; empty text gives ``[]``."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), " +"), lambda x: x != "")


def clean_tokens(c: Column | str, separator: str | None = None) -> Column:
    """``tokenize(clean_string(c))`` in one expression."""
    return tokenize(clean_string(c, separator))


def flatten_tokens(c: Column | str) -> Column:
    """Flatten ``array<array<string>>``; null inner lists are dropped, null cell -> ``[]``."""
    return F.flatten(F.filter(F.coalesce(_col(c), F.array().cast(UTTERANCES)), lambda x: x.isNotNull()))


# Tokens of a list literal: strings in either quotes, None, white space, any other character.
_LITERAL = r"""(?s)'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|None(?![A-Za-z0-9_])|\s++|."""
# Pieces of a string literal: plain text and escapes; surrogates and names are none.
_PIECES = r"(?s)[^\\]++|\\x[0-9a-fA-F]{2}|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|\\U(?!0000[dD][89a-fA-F])(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^xuUN0-7]"
# Fixed values of string literals: the escapes of one character.
_ESCAPES = {"\\\\": "\\", "\\'": "'", '\\"': '"', "\\a": "\a", "\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v", "\\\n": ""}
# Shapes: s string, n None, then the inner lists as L.
_INNER = r"\[(?:[sn](?:,[sn])*+,?+)?\]"
_OUTER = r"^\[(?:[Ln](?:,[Ln])*+,?+)?\]$"
_BARE = r"^\[(?:n(?:,n)*+,?+)?\]$"


def _unescaped(piece: Column) -> Column:
    """One piece of a string literal as the text it stands for."""
    point = lambda digits, width, charset: F.decode(F.unhex(F.lpad(digits, width, "0")), charset)
    digits = F.substring(piece, 3, 8)
    octal = F.conv(F.substring(piece, 2, 3), 8, 16)
    out = F.when(piece.rlike(r"^\\[xu]"), point(digits, 4, "UTF-16BE")).when(piece.rlike(r"^\\U"), point(digits, 8, "UTF-32")).when(piece.rlike(r"^\\[0-7]"), point(octal, 4, "UTF-16BE"))
    for escape, char in _ESCAPES.items():
        out = out.when(piece == F.lit(escape), F.lit(char))
    return out.otherwise(piece)  # an unknown escape keeps its backslash


def parse_nested_list(c: Column | str) -> Column:
    """Parse a list-literal cell such as ``[['a', "it's"], None, ['\\xe9']]``.

    The cell is cut into tokens; a quote, bracket or ``None`` inside a string
    is text.  Strings in either quotes are taken with their escapes, and the
    tokens' kinds must have the shape of a list of lists of strings (``None``
    in place of any of them, trailing commas allowed).  Any other cell is null
    (``split_nested_list`` routes it to the rejects).
    """
    tokens = F.regexp_extract_all(_col(c), F.lit(_LITERAL), F.lit(0))
    quoted = lambda t: t.rlike("^['\"]") & (F.length(t) > 1)
    inner = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    pieces = lambda t: F.regexp_extract_all(inner(t), F.lit(_PIECES), F.lit(0))
    legal = lambda t: ~F.contains(t, F.lit("\\")) | (F.array_join(pieces(t), "") == inner(t))
    kind = lambda t: F.when(quoted(t) & legal(t), "s").when(t == "None", "n").when(t.rlike(r"^\s"), "").when(t.isin("[", "]", ","), t).otherwise("!")
    shape = F.array_join(F.transform(tokens, kind), "")
    valid = F.regexp_replace(shape, _INNER, "L").rlike(_OUTER) | shape.rlike(_BARE)
    said = lambda t: F.when(F.contains(t, F.lit("\\")), F.array_join(F.transform(pieces(t), _unescaped), "")).otherwise(inner(t))
    as_json = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)  # noqa: E731  without the brackets of a list of one
    rendered = lambda t: F.when(quoted(t), as_json(F.to_json(F.array(said(t))))).when(t == "None", "null").when(t.rlike(r"^\s"), "").otherwise(t)
    text = F.regexp_replace(F.array_join(F.transform(tokens, lambda t: F.when(t == ",", "\u0000").otherwise(rendered(t))), ""), "\u0000\\]", "]")
    return F.when(valid, F.from_json(F.regexp_replace(text, "\u0000", ","), UTTERANCES))


def split_nested_list(df: DataFrame, cell: str, parsed: str) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: rows with the parsed cell as ``parsed``, and the
    rows whose cell is no list of lists of strings, as they came.  A null cell
    is an empty list.

    The parsed rows are written to the shared folder once: both halves, and the
    conditions they are told apart by, read them from there.
    """
    tried = cut_lineage(df.withColumn(parsed, F.when(F.col(cell).isNull(), F.array().cast(UTTERANCES)).otherwise(parse_nested_list(cell))))
    return tried.where(F.col(parsed).isNotNull()), tried.where(F.col(parsed).isNull()).drop(parsed)


def _literal(x: Column) -> Column:
    """A string as a literal: double quotes around text with only single ones."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def render_nested_list(c: Column | str) -> Column:
    """Inverse of :func:`parse_nested_list`: ``[['a', "it's"], None]`` text."""
    string = lambda x: F.when(x.isNull(), F.lit("None")).otherwise(_literal(x))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, string), ", "), F.lit("]"))
    inner = F.transform(_col(c), lambda xs: F.when(xs.isNull(), F.lit("None")).otherwise(listed(xs)))
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))


def encode_message(*cols: Column | str) -> Column:
    """One JSON line per row (the stream producer's encoding)."""
    return F.to_json(F.struct(*[_col(c) for c in cols]))
