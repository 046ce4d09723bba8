"""Text: signatures, summaries, white space, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_BYTES = 200


def normalize_whitespace(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^ | $", "")


def func_signature(receiver: Column, name: Column, params: Column, result: Column) -> Column:
    """``func [(receiver) ]name(params)[ result]``."""
    e = F.lit("")
    head = F.when(F.coalesce(receiver, e) != "", F.concat(F.lit("("), receiver, F.lit(") "))).otherwise(e)
    tail = F.when(F.coalesce(result, e) != "", F.concat(F.lit(" "), result)).otherwise(e)
    return F.concat(F.lit("func "), head, name, F.lit("("), F.coalesce(params, e), F.lit(")"), tail)


def type_signature(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("type "), name, F.lit(" "), kind)


def first_sentence(comment: Column) -> Column:
    """A comment without its markers, up to the first full stop, exclamation or question mark."""

    def strip(line: Column) -> Column:
        for pattern in (r"^//", r"^/\*", r"\*/$", r"^\*"):
            line = F.regexp_replace(line, pattern, "")
        return line

    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(comment, "\n"), lambda line: trim(strip(trim(line))))
    return F.coalesce(F.regexp_extract(F.array_join(F.filter(lines, lambda x: x != ""), " "), r"(?s)^[^.!?]*[.!?]?", 0), F.lit(""))


def template_summary(kind: Column, name: Column, params: Column, result: Column) -> Column:
    """What stands in for a missing comment."""
    e = F.lit("")
    accepts = F.when(F.coalesce(params, e) != "", F.concat(F.lit(" accepting "), params)).otherwise(e)
    comma = F.when((F.coalesce(params, e) != "") & (F.coalesce(result, e) != ""), F.lit(",")).otherwise(e)
    returns = F.when(F.coalesce(result, e) != "", F.concat(comma, F.lit(" returns "), result)).otherwise(e)
    callable_ = F.concat(kind, F.lit(" "), name, accepts, returns)
    return (
        F.when(kind.isin("function", "method"), callable_)
        .when(kind == "const", F.concat(F.lit("constant "), name))
        .when(kind == "var", F.concat(F.lit("variable "), name))
        .otherwise(F.concat(kind, F.lit(" "), name))
    )


def strip_outer_parens(s: Column) -> Column:
    """Without one pair of enclosing parentheses, white space normalised."""
    return normalize_whitespace(F.regexp_replace(F.trim(s), r"(?s)^\((.*)\)$", "$1"))


def receiver_type(s: Column) -> Column:
    """The type of a method's receiver: last field before any type parameters, without pointer."""
    inner = F.trim(F.substring_index(strip_outer_parens(s), "[", 1))
    return F.regexp_replace(F.element_at(F.split(inner, " "), -1), r"^\*+", "")


def strip_type_arguments(s: Column) -> Column:
    return F.trim(F.substring_index(s, "<", 1))


def _arguments(depth: int) -> str:
    """A pattern for arguments in parentheses, strings taken whole, to this depth."""
    atom = r"""[^()"'`]|"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`"""
    return rf"\((?:{atom}{'|' + _arguments(depth - 1) if depth else ''})*+\)"


def callee_name(raw: Column) -> Column:
    """The identifier called: what stands before the last arguments, after the last dot or double colon.

    Type arguments are left out. Where the last arguments can't be told (very deep, or quotes that aren't strings), it is
    what stands before the first parenthesis.
    """
    whole = F.regexp_replace(raw, rf"(?s)(?:(?:::)?\s*<[^<>()]*>)?\s*{_arguments(5)}\s*$", "")
    head = F.when(whole != raw, whole).otherwise(F.regexp_extract(raw, r"(?s)^([^(]*)", 1))
    return F.trim(F.regexp_replace(F.regexp_extract(head, r"(?s)([^.:]*)$", 1), r"[!?]+$", ""))


def callee_name_compat(raw: Column) -> Column:
    """Only what follows the last dot, parentheses included."""
    return F.substring_index(raw, ".", -1)


def truncate_summary(s: Column) -> Column:
    """The first line, cut to 197 bytes and three dots if it has more than 200 bytes; a split character is dropped."""
    line = F.trim(F.substring_index(F.trim(s), "\n", 1))
    cut = F.decode(F.substring(line.cast("binary"), 1, SUMMARY_BYTES - 3), "ISO-8859-1")  # a character for each byte
    whole = F.regexp_replace(cut, r"(?:[\u00C0-\u00FF]|[\u00E0-\u00FF][\u0080-\u00BF]|[\u00F0-\u00FF][\u0080-\u00BF]{2})$", "")
    kept = F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(line) > SUMMARY_BYTES, F.concat(kept, F.lit("..."))).otherwise(line)


def prompt(kind: Column, name: Column, signature: Column, source: Column) -> Column:
    """The request for a one-line summary of a symbol."""
    e = F.lit("")
    return F.format_string(
        "Describe this %s '%s' in one sentence of at most 120 characters.\nSignature: %s\nSource:\n%s\nAnswer with the sentence only.",
        F.coalesce(kind, e), F.coalesce(name, e), F.coalesce(signature, e), F.coalesce(source, e),
    )
