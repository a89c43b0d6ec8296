"""Declaration spans of Go, JavaScript, TypeScript and Rust files, with windows only.

The bracket depth of every line is a running sum. A declaration that starts at depth
``k`` ends at the first later line whose depth has come back to ``k`` and that closes a
block (or finishes a statement): again a next-row window per (file, depth).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexis
from codeloom.operators.lines import masked_lines
from codeloom.operators.patterns import NAME, SCRIPT_NAME, Pattern, matches

LANGUAGES = ["go", "javascript", "typescript", "rust"]

# A line that ends like this goes on in the next line.
_CONTINUES = r"(?:[=+\-*/%&|^<>?:,.(\[{~!]|\b(?:where|extends|implements|in|of|as))\z"


def _list(depth: int = 24) -> str:
    """A parameter list with parentheses in its defaults, ``depth`` levels deep."""
    inner = r"\([^()]*+\)"
    for _ in range(depth - 1):
        inner = rf"\((?:[^()]|{inner})*+\)"
    return inner


def _type_arguments(depth: int = 24) -> str:
    """Type arguments, ``depth`` levels deep; a comparison that runs into an assignment is none."""
    inner = r"<(?:[^<>=;]|=>)*+>"
    for _ in range(depth - 1):
        inner = rf"<(?:[^<>=;]|=>|{inner})*+>"
    return inner


_TYPE_ARGUMENTS = _type_arguments()
_FILLED = f"{lexis.PAIR_FILL}++"
# Where a masked line is cut into pieces: behind an opening brace or a semicolon, in front of a closing brace, and
# behind one that a word follows which begins a statement (not one that goes on with an expression).
_GOES_ON = r"(?:as|satisfies|instanceof|in|of|extends|implements|where)\b"
_PIECE_CUT = r"(?<=[{;])|(?=\})|(?<=\})(?=[ \t]*[\p{L}_$#])(?![ \t]*" + _GOES_ON + ")"
_ARROW = rf"(?:async\s*)?{_list()}\s*(?::[^=;{{}}]*+)?=>"


def _last_brace(code: Column) -> Column:
    return F.length(code) - F.instr(F.reverse(code), "}") + 1


def _places(code: Column, expression: str, describe: Callable[[Column, Column], Column]) -> Column:
    """``describe(token, number of characters ahead of it)`` of everything in a line that ``expression`` finds."""
    found = F.regexp_extract_all(code, F.lit(expression), F.lit(0))
    between = F.split(code, expression, -1)

    def placed(token: Column, i: Column) -> Column:
        ahead = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda total, text: total + F.length(text))
        inside = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda total, text: total + F.length(text))
        return describe(token, ahead + inside)

    return F.transform(found, placed)


def _inline(code: Column, pattern: Pattern) -> Column:
    """Statements that ``pattern`` finds in this line: (chunk_type, style, name, col, own_end)."""

    def describe(token: Column, at: Column) -> Column:
        rest = code.substr(at + F.length(token) + 1, F.length(code))
        # Brackets opened in front of the token are not in ``rest``, so what closes them stays unbalanced.
        found = F.regexp_extract(lexis.flattened(rest), r"^[^()\[\]{};]*+;?", 0)

        def described(body: Column) -> Column:
            whole = F.length(body) == F.length(rest)
            ends = ~whole | body.endswith(";")
            return F.struct(
                F.lit(pattern.chunk_type).alias("chunk_type"),
                F.lit("names").alias("style"),
                F.lit("").alias("name"),
                (at + 1).alias("col"),
                # A bracket that stays open in this line is no end; one that is closed but not opened is.
                F.when(ends & ~rest.substr(F.length(body) + 1, F.lit(1)).isin(*"([{"), at + F.length(token) + F.length(F.rtrim(body)))
                .cast("int")
                .alias("own_end"),
            )

        # The body is worked out once: inside a lambda Spark would evaluate each use anew.
        return F.transform(F.array(found), described)[0]

    rows = _places(code, pattern.head, describe)
    found = code.contains(pattern.hint) & code.rlike(pattern.head) if pattern.hint else code.rlike(pattern.head)
    return F.when(found, rows).otherwise(F.slice(rows, 1, 0))


def declared_names(content: Column, language: Column, chunk_type: Column) -> Column:
    """The names that one declaration declares, in order.

    A declaration begins outside of literals, so it is masked by itself. Brackets are taken out; what is left of a Go
    declaration are its lines, what is left of a script's are its declarators.
    """
    return F.when(language == "go", _go_names(content, chunk_type)).otherwise(_script_names(content, language))


def _flat(content: Column, language: str) -> Column:
    return lexis.uncommented(lexis.masked_as(content, language))


def _go_names(content: Column, chunk_type: Column) -> Column:
    inner = F.regexp_replace(_flat(content, "go"), r"^(?:type|var|const)\b\s*(?:\(([\s\S]*)\))?", "$1")
    flat = F.regexp_replace(lexis.flattened(inner), _FILLED, "")
    flat = F.regexp_replace(flat, r"([=+\-*/%&|^<>,.:!])\s*\n\s*", "$1 ")
    specs = F.filter(
        F.split(flat, r"[\n;]", -1),
        lambda spec: F.when(chunk_type == "constants", spec.contains("="))
        .when(chunk_type == "types", ~spec.rlike(rf"^\s*{NAME}\s*="))
        .otherwise(F.lit(True)),
    )
    lists = F.transform(specs, lambda spec: F.regexp_extract(spec, rf"^\s*({NAME}(?:\s*,\s*{NAME})*)", 1))
    names = F.flatten(F.transform(lists, lambda listed: F.split(listed, r"\s*,\s*", -1)))
    return F.filter(names, lambda name: name != "")


def _script_names(content: Column, language: Column) -> Column:
    flat = F.regexp_replace(_flat(content, "javascript"), r"^(?:const|let|var)\s+", "")
    flat = F.regexp_replace(lexis.flattened(flat), _FILLED, "")
    # Type arguments hold commas, too.
    flat = F.when(language == "typescript", F.regexp_replace(flat, _TYPE_ARGUMENTS, "")).otherwise(flat)
    declarators = F.split(flat, ",", -1)
    names = F.transform(declarators, lambda one: F.regexp_extract(one, rf"^\s*({SCRIPT_NAME})\s*(?:[=:;!]|\z)", 1))
    return F.filter(names, lambda name: name != "")


def _arrows(code: Column) -> Column:
    """Arrow functions that start in this line, nameless: (chunk_type, style, name, col, own_end)."""
    nothing = F.lit(None).cast("int")

    def describe(token: Column, at: Column) -> Column:
        # An expression body ends in front of the comma or bracket that follows it.
        rest = F.ltrim(code.substr(at + F.length(token) + 1, F.length(code)))
        found = F.rtrim(F.regexp_extract(lexis.flattened(rest), r"^[^()\[\]{},;]*+", 0))
        blank = F.length(code) - at - F.length(token) - F.length(rest)

        def described(body: Column) -> Column:
            one_line = ~rest.startswith("{") & (body != "") & ~body.rlike(_CONTINUES)
            return F.struct(
                F.lit("functions").alias("chunk_type"),
                F.when(rest.startswith("{"), "block").otherwise("statement").alias("style"),
                F.lit("").alias("name"),
                (at + 1).alias("col"),
                F.when(one_line, at + F.length(token) + blank + F.length(body)).otherwise(nothing).alias("own_end"),
            )

        return F.transform(F.array(found), described)[0]

    rows = _places(code, _ARROW, describe)
    return F.when(code.contains("=>"), rows).otherwise(F.slice(rows, 1, 0))


def statement_pieces(lines: DataFrame) -> DataFrame:
    """Masked lines cut where a statement can begin: behind ``{`` and ``;``, in front of ``}``, behind it before a word.

    Each piece is a row (path, language, ln, k: its place in the line, off: characters in front of it, code). A
    declaration behind other code of its line, or a block that opens and closes within one line, then starts
    and ends pieces of its own, so every later step can keep reading rows as lines. A brace that an operator,
    a bracket or a word like ``as`` follows stays with them. Pieces of blanks only are dropped; the end-of-file row
    stays one piece.
    """
    parts = lines.select(
        "path", "language", "ln", F.posexplode(F.split(F.col("code"), _PIECE_CUT, -1)).alias("k", "piece")
    )
    in_line = Window.partitionBy("path", "ln").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("off", F.coalesce(F.sum(F.length("piece")).over(in_line), F.lit(0)).cast("int"))
    return placed.select(
        "path", "language", "ln", "k", "off", lexis.right_trimmed(F.col("piece")).alias("code")
    ).where(F.trim(F.col("code"), F.lit(lexis.BLANKS)) != "")


def spans(partitioned: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Declarations: path, language, chunk_type, name, s, scol, e, ecol."""
    languages = [name for name in LANGUAGES if any(p.language == name for p in patterns)]
    lines = statement_pieces(masked_lines(partitioned, languages))
    order = Window.partitionBy("path").orderBy("ln", "k")
    code = F.col("code")
    at_end = code == lexis.END_OF_FILE
    before = F.coalesce(
        F.sum(lexis.bracket_change(code)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rows = (
        lines.where(code != "")
        .withColumn("before", before.cast("int"))
        .withColumn("after", F.when(at_end, F.lit(-1)).otherwise(F.col("before") + lexis.bracket_change(code)).cast("int"))
        .withColumn("has_brace", code.contains("}"))
    )

    found = None
    for language in languages:
        mine = [p for p in patterns if p.language == language and p.style in ("block", "statement")]
        arrows = any(p.language == language and p.style == "arrow" for p in patterns)
        listed = F.transform(matches(code, mine), lambda d: d.withField("own_end", F.lit(None).cast("int")))
        if arrows:
            listed = F.concat(listed, _arrows(code))
        for pattern in (p for p in patterns if p.language == language and p.style == "inline"):
            listed = F.concat(listed, _inline(code, pattern))
        found = (F.when if found is None else found.when)(F.col("language") == language, listed)

    inside = code.substr(F.lit(1), F.lit(1)) == lexis.STRING_FILL
    declared = F.transform(
        F.when(~at_end & ~inside, found),
        lambda d: F.struct(
            (
                F.col("before")
                + F.when(d["name"] == "", lexis.bracket_change(code.substr(F.lit(1), d["col"] - 1))).otherwise(0)
            )
            .cast("int")
            .alias("level"),
            d["chunk_type"].alias("chunk_type"),
            d["style"].alias("style"),
            d["name"].alias("name"),
            d["col"].alias("scol"),
            d["own_end"].alias("own_end"),
        ),
    )
    semicolon = code.endswith(";")
    # A function of this language has its brace on the header line; without one it has no body.
    bodyless = semicolon | ((F.col("language") == "go") & ~code.rlike(_CONTINUES))
    finished = F.when(F.col("language") == "rust", semicolon).otherwise(~code.rlike(_CONTINUES))
    ends_block = F.col("has_brace") | bodyless | at_end
    ends_statement = finished | at_end
    closers = F.transform(
        F.when(
            ends_block | ends_statement, F.sequence(F.col("after"), F.greatest(F.col("before"), F.col("after")))
        ),
        lambda level: F.struct(
            level.alias("level"),
            F.lit(None).cast("string").alias("chunk_type"),
            F.lit(None).cast("string").alias("style"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("int").alias("scol"),
            F.lit(None).cast("int").alias("own_end"),
        ),
    )
    none = F.slice(
        F.array(
            F.struct(
                F.lit(0).alias("level"),
                F.lit("").alias("chunk_type"),
                F.lit("").alias("style"),
                F.lit("").alias("name"),
                F.lit(0).alias("scol"),
                F.lit(0).alias("own_end"),
            )
        ),
        1,
        0,
    )
    opens = F.translate(code, "([{", "") != code
    nth = F.length(F.expr("substring_index(code, '}', greatest(before - event.level, 1))")) + 1
    brace_at = F.when(opens, _last_brace(code)).otherwise(F.least(nth, _last_brace(code)))
    events = rows.select(
        "path",
        "language",
        "ln",
        "k",
        "off",
        "code",
        "before",
        "has_brace",
        ends_block.alias("ends_block"),
        ends_statement.alias("ends_statement"),
        at_end.alias("at_end"),
        F.explode(F.concat(F.coalesce(declared, none), F.coalesce(closers, none))).alias("event"),
    ).select(
        "path",
        "language",
        "ln",
        "k",
        "off",
        "event.*",
        F.when(
            F.col("event.chunk_type").isNull() & F.col("ends_block"),
            F.struct("ln", "k", "off", brace_at.alias("end"), (F.col("has_brace") & ~F.col("at_end")).alias("body")),
        ).alias("block_end"),
        F.when(
            F.col("event.chunk_type").isNull() & F.col("ends_statement"),
            F.struct(
                "ln",
                "k",
                "off",
                F.length("code").alias("end"),
                (~F.col("at_end")).alias("body"),
                F.length(F.rtrim("code", F.lit(";, "))).alias("expression"),
            ),
        ).alias("statement_end"),
    )
    later = (
        Window.partitionBy("path", "level")
        .orderBy(F.desc("ln"), F.desc("k"), F.col("chunk_type").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    events = events.withColumn("block_end", F.last("block_end", ignorenulls=True).over(later)).withColumn(
        "statement_end", F.last("statement_end", ignorenulls=True).over(later)
    )
    own = F.struct("ln", "off", F.col("own_end").alias("end"), F.lit(True).alias("body"))
    # An arrow function ends with its expression, not with the statement around it.
    is_arrow = (F.col("chunk_type") == "functions") & (F.col("name") == "")
    statement = F.struct(
        F.col("statement_end.ln").alias("ln"),
        F.col("statement_end.off").alias("off"),
        F.when(is_arrow, F.col("statement_end.expression")).otherwise(F.col("statement_end.end")).alias("end"),
        F.col("statement_end.body").alias("body"),
    )
    end = (
        F.when(F.col("own_end").isNotNull(), own)
        .when(F.col("style") == "block", F.col("block_end").dropFields("k"))
        .otherwise(statement)
    )
    return (
        events.where(F.col("chunk_type").isNotNull())
        .withColumn("end", end)
        .where(F.col("end.body"))
        .select(
            "path",
            "language",
            "chunk_type",
            "style",
            "name",
            F.col("ln").alias("s"),
            (F.col("off") + F.col("scol")).alias("scol"),
            F.col("end.ln").alias("e"),
            (F.col("end.off") + F.col("end.end")).alias("ecol"),
        )
    )
