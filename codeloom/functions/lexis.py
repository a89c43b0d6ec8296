"""Lexical masking: blank out strings and comments without moving a character.

One left-to-right regular expression per language finds the literal and comment
tokens of a whole file. The text between tokens stays, every other character is
replaced by a filler, and newlines survive, so that lines and columns of the mask
are lines and columns of the source. All of it runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT_FILL = "\u0001"
STRING_FILL = "\u0002"
END_OF_FILE = "\u0003"
BLANKS = " \t"


def _quoted(q: str) -> str:
    return rf"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}"


def _quoted_across_lines(q: str) -> str:
    return rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+{q}"


def _tripled(q: str) -> str:
    return rf"{q * 3}[^{q}\\]*+(?:(?:\\[\s\S]|{q}{{1,2}}(?!{q}))[^{q}\\]*+)*+{q * 3}"


_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*[\s\S]*?\*/"


def _nested_comment(depth: int = 24) -> str:
    """A block comment with block comments in it, ``depth`` levels deep."""
    comment = r"/\*[\s\S]*?\*/"
    for _ in range(depth - 1):
        comment = rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{comment})*+\*/"
    return comment


_NESTED_BLOCK_COMMENT = _nested_comment()
# A slash begins a literal behind an operator, a bracket or one of the words that an expression follows.
_BEFORE_LITERAL = r"[=(,:;!&|?{}\[+*%~^<>]|\b(?:return|typeof|case|delete|void|throw|else|do|yield|await|in|of)"
_REGEX_LITERAL = rf"(?=/)(?<=(?:{_BEFORE_LITERAL})\s{{0,400}})/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_SCRIPT = "|".join(
    [_LINE_COMMENT, _BLOCK_COMMENT, _quoted('"'), _quoted("'"), _quoted_across_lines("`"), _REGEX_LITERAL]
)

TOKENS = {
    "python": "|".join([_tripled('"'), _tripled("'"), _quoted('"'), _quoted("'"), r"#[^\n]*+"]),
    "go": "|".join([_LINE_COMMENT, _BLOCK_COMMENT, _quoted('"'), _quoted("'"), r"`[^`]*+`"]),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "rust": "|".join(
        [
            _LINE_COMMENT,
            _NESTED_BLOCK_COMMENT,
            r'r(#*+)"[\s\S]*?"\1',
            _quoted_across_lines('"'),
            r"'(?:[^'\\\n]|\\u\{[^}\n]*+\}|\\x[0-9A-Fa-f]{2}|\\[^\n])'",
        ]
    ),
}


def _filled(token: Column) -> Column:
    is_comment = token.startswith("#") | token.startswith("//") | token.startswith("/*")
    one_line = ~token.contains("\n")
    rest = token.substr(F.lit(2), F.length(token))
    # A string keeps its first character: a line that *starts* with the string
    # filler is therefore the inside of a literal, never the start of a statement.
    return (
        F.when(is_comment & one_line, F.repeat(F.lit(COMMENT_FILL), F.length(token)))
        .when(is_comment, F.regexp_replace(token, r"[^\n]", COMMENT_FILL))
        .when(one_line, F.concat(token.substr(1, 1), F.repeat(F.lit(STRING_FILL), F.length(token) - 1)))
        .otherwise(F.concat(token.substr(1, 1), F.regexp_replace(rest, r"[^\n]", STRING_FILL)))
    )


def masked_as(text: Column, language: str) -> Column:
    tokens = TOKENS[language]
    between = F.split(text, tokens, -1)
    found = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    pairs = F.zip_with(between, found, lambda code, token: F.concat(code, F.coalesce(_filled(token), F.lit(""))))
    return F.array_join(pairs, "")


def masked(text: Column, language: Column, languages: Sequence[str]) -> Column:
    """Mask ``text`` by the rules of its language; one compiled expression per language.

    Carriage returns and form feeds become blanks, so lines only hold blanks and tabs.
    """
    chain = None
    for name in languages:
        chain = (F.when if chain is None else chain.when)(language == name, masked_as(text, name))
    return plain_blanks(chain)


#: What ``flattened`` puts in place of a bracket pair and its content.
PAIR_FILL = "\u0004"
_INNERMOST = r"[(\[{][^()\[\]{}]*+[)\]}]"


def _fill_innermost(text: Column) -> Column:
    between = F.split(text, _INNERMOST, -1)
    found = F.regexp_extract_all(text, F.lit(_INNERMOST), F.lit(0))
    pairs = F.zip_with(between, found, lambda code, pair: F.concat(code, F.coalesce(F.repeat(F.lit(PAIR_FILL), F.length(pair)), F.lit(""))))
    return F.array_join(pairs, "")


def flattened(text: Column) -> Column:
    """``text`` with every balanced bracket pair, content included, replaced by ``PAIR_FILL``, at any depth.

    Columns do not move, and unbalanced brackets stay. The number of passes is the text's own nesting depth,
    read from its brackets in one pass; each pass fills the innermost pairs. No depth is fixed.
    """
    steps = F.transform(
        F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), "", -1),
        lambda c: F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0),
    )
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("high"), F.lit(0).alias("low"))
    reach = F.aggregate(
        steps,
        start,
        lambda state, step: F.struct(
            (state["d"] + step).alias("d"),
            F.greatest(state["high"], state["d"] + step).alias("high"),
            F.least(state["low"], state["d"] + step).alias("low"),
        ),
    )
    passes = reach["high"] - reach["low"]
    filled = F.aggregate(F.sequence(F.lit(1), F.greatest(passes, F.lit(1))), text, lambda acc, _: _fill_innermost(acc))
    return F.when(text.rlike(_INNERMOST), filled).otherwise(text)


def plain_blanks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit(" ")), F.lit("\f"), F.lit(" "))


def right_trimmed(line: Column) -> Column:
    """Without trailing blanks and tabs; the general trim only where a tab asks for it."""
    return F.when(line.endswith("\t"), F.rtrim(line, F.lit(BLANKS))).otherwise(F.rtrim(line))


def uncommented(mask: Column) -> Column:
    """Masked text with comments as blanks and no trailing white space."""
    return right_trimmed(F.replace(mask, F.lit(COMMENT_FILL), F.lit(" ")))


def _count(code: Column, characters: str) -> Column:
    left = F.length(code) * len(characters)
    for character in characters:
        left = left - F.length(F.replace(code, F.lit(character), F.lit("")))
    return left


def bracket_change(code: Column) -> Column:
    """Opening minus closing brackets."""
    return _count(code, "([{") - _count(code, ")]}")


def lead_length(code: Column) -> Column:
    """Number of leading white space characters."""
    general = F.length(code) - F.length(F.ltrim(code, F.lit(BLANKS)))
    return F.when(code.contains("\t"), general).otherwise(F.length(code) - F.length(F.ltrim(code)))


def indent_width(mask: Column) -> Column:
    """Width of the leading white space; a tab counts eight columns."""
    lead = lead_length(mask)
    tabs = _count(mask.substr(F.lit(1), lead), "\t")
    return F.when(mask.contains("\t"), lead + tabs * 7).otherwise(lead)
