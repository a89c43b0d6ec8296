"""Declaration spans of Python files, with windows only (no parser, no range join).

Everything after the shuffle on ``path`` is linear in the number of lines apart from
sorting: the end of an indented block is the *next row with a smaller indent*, found
with one window per (file, indent level) over "dedent" rows, and the nearest class
around a function is the last class that was opened at the current nesting depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexis
from codeloom.operators.lines import masked_lines
from codeloom.operators.patterns import NAME, Pattern, matches

# Words that can stand in front of "=" or ":" but are not names.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()


# Statements are read with their bracket pairs filled (``lexis.flattened``): a pair of any depth is one run.
_PAIR = f"{lexis.PAIR_FILL}++"
_ATOM = rf"\*?(?:{NAME}|{_PAIR})(?:\s*\.\s*{NAME}|{_PAIR})*+"
_TARGETS = rf"{_ATOM}(?:\s*,\s*{_ATOM})*+\s*,?\s*"
_ANNOTATION = r"(?::(?!=)[^=()\[\]{}]*+)?"
_ASSIGN = rf"{_TARGETS}{_ANNOTATION}=(?!=)\s*"
_HEADER_WITH_BODY = (
    r"^\s*(?:async\s+)?(?:if|elif|else|for|while|try|except|finally|with|def|class|case(?=\s+[^\s:=]))\b"
    r"(?:[^()\[\]{}:]|:=)*+:(?=\s*\S)"
)

# Larger than any indent, so that a later statement always outweighs an earlier one.
_STEP = 1 << 32


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def is_compound(code: Column) -> Column:
    """Lines that hold more than one statement."""
    return code.contains(";") | (code.contains(":") & ~code.endswith(":") & code.rlike(_HEADER_WITH_BODY))


def pieces(code: Column) -> Column:
    """Statements of one line: split at ``;`` and behind the colon of a one-line header.

    Returns structs (off, code), ``off`` being the number of characters in front.
    """
    header = F.length(F.regexp_extract(code, _HEADER_WITH_BODY, 0))
    parts = F.split(code.substr(header + 1, F.length(code)), ";", -1)
    tail = F.transform(
        parts,
        lambda part, i: F.struct(
            (
                header
                + F.aggregate(
                    F.slice(parts, F.lit(1), i), F.lit(0), lambda total, earlier: total + F.length(earlier) + 1
                )
            ).alias("off"),
            lexis.right_trimmed(part).alias("code"),
        ),
    )
    head = F.array(F.struct(F.lit(0).alias("off"), code.substr(F.lit(1), header).alias("code")))
    return F.filter(F.concat(head, tail), lambda piece: piece["code"] != "")


def assignments(code: Column, mode: str) -> Column:
    """Assignments of one statement, as structs (chunk_type, style, name, col).

    In ``effective`` mode a right side that is a plain name gives the name, and the
    outer part of a chain ``a = b = 1`` takes the inner assignment as its content.
    """
    keywords = [F.lit(word) for word in KEYWORDS]

    def rows(prefix: Column) -> Column:
        lead = lexis.lead_length(code)
        heads = F.regexp_extract_all(prefix.substr(lead + 1, F.length(prefix)), F.lit(_ASSIGN), F.lit(0))
        rest = code.substr(F.length(prefix) + 1, F.length(code))
        return bound(F.struct(lead.alias("lead"), heads.alias("heads"), rest.alias("rest")), listed)

    def listed(parts: Column) -> Column:
        heads, rest = parts["heads"], parts["rest"]

        def describe(head: Column, i: Column) -> Column:
            left = F.regexp_extract(head, rf"^({NAME})\s*(?::.*)?=\s*\z", 1)
            at = F.aggregate(
                F.slice(heads, F.lit(1), i), parts["lead"], lambda total, earlier: total + F.length(earlier)
            )
            name = left
            if mode == "effective":
                last = i == F.size(heads) - 1
                right_is_name = rest.rlike(rf"^{NAME}\z") & ~rest.isin(*keywords)
                name = F.when(last & (left != "") & right_is_name, rest).otherwise(left)
                at = F.when(last, at).otherwise(at + F.length(head))
            return F.struct(
                F.lit("variables").alias("chunk_type"),
                F.lit("assignment").alias("style"),
                F.when(left.isin(*keywords), "").otherwise(name).alias("name"),
                (at + 1).alias("col"),
            )

        return F.filter(F.transform(heads, describe), lambda row: row["name"] != "")

    nothing = F.slice(
        F.array(
            F.struct(
                F.lit("").alias("chunk_type"), F.lit("").alias("style"), F.lit("").alias("name"), F.lit(0).alias("col")
            )
        ),
        1,
        0,
    )
    prefix = F.regexp_extract(code, rf"^\s*(?:{_ASSIGN})++", 0)
    return F.when(code.contains("="), bound(prefix, rows)).otherwise(nothing)


def statements(partitioned: DataFrame) -> DataFrame:
    """Statement lines and comment lines of Python files, in file order.

    Columns: path, language, ln, code, ind, is_start, next_ind, eff and prev_eff (the
    indent that counts for closing blocks), seen and coded (line and last column of the
    row before, with and without comment rows), next_seen and next_coded (where this
    statement ends).
    """
    code = F.col("code")
    at_end = code == lexis.END_OF_FILE
    order = Window.partitionBy("path").orderBy("ln")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = masked_lines(partitioned, ["python"]).withColumn("code", lexis.flattened(code)).select(
        "path",
        "language",
        "ln",
        "code",
        F.when(at_end, F.lit(-1)).otherwise(lexis.indent_width(F.col("mask"))).alias("ind"),
        lexis.bracket_change(code).alias("change"),
        F.struct("ln", F.length("mask").alias("end")).alias("mine"),
        F.when(code != "", F.struct("ln", F.length("code").alias("end"))).alias("mine_coded"),
    )
    rows = rows.select(
        "path",
        "language",
        "ln",
        "code",
        "ind",
        (F.sum("change").over(running) - F.col("change")).alias("depth"),
        F.lag(code.endswith("\\"), 1, False).over(order).alias("joined"),
        F.lag("mine").over(order).alias("seen"),
        F.expr("lag(mine_coded) ignore nulls over (partition by path order by ln)").alias("coded"),
    )
    free = (F.col("depth") <= 0) & ~F.col("joined")
    is_start = at_end | ((code != "") & free & ~code.startswith(lexis.STRING_FILL))
    is_note = (code == "") & free
    rows = rows.withColumn("is_start", is_start).where(F.col("is_start") | is_note)

    # A comment row closes a block only if no later statement reopens it, and only
    # once a comment to the left of the block was seen in the same gap. Weighing the
    # indent with the number of the statement makes the running minimum restart at
    # every statement without a second partitioning.
    rank = F.sum(F.col("is_start").cast("long")).over(running)
    rows = rows.select("*", rank.alias("rank"), F.when(F.col("is_start"), F.col("ind")).alias("start_ind"))
    rows = rows.select(
        "*",
        F.min(F.col("ind") - F.col("rank") * F.lit(_STEP)).over(running).alias("lowest"),
        F.expr("lead(start_ind) ignore nulls over (partition by path order by ln)").alias("next_ind"),
        F.lead("seen").over(order).alias("next_seen"),
        F.lead("coded").over(order).alias("next_coded"),
    )
    gap_indent = (F.col("lowest") + F.col("rank") * F.lit(_STEP)).cast("int")
    eff = F.when(F.col("is_start"), F.col("ind")).otherwise(F.greatest(gap_indent, F.col("next_ind")))
    rows = rows.select(
        "path", "language", "ln", "code", "ind", "is_start", "seen", "next_ind", "next_seen", "next_coded", eff.alias("eff")
    )
    return rows.withColumn("prev_eff", F.lag("eff").over(order))


def _event(level: Column, chunk_type: Column, name: Column, scol: Column, end: Column) -> Column:
    return F.struct(
        level.alias("level"),
        chunk_type.alias("chunk_type"),
        name.alias("name"),
        scol.alias("scol"),
        end["ln"].alias("end_ln"),
        end["end"].alias("end_col"),
    )


def spans(partitioned: DataFrame, patterns: Sequence[Pattern], mode: str) -> DataFrame:
    """Declarations of Python files: path, language, chunk_type, name, s, scol, e, ecol."""
    rows = statements(partitioned)
    plain = [p for p in patterns if p.style in ("indent", "statement")]
    assigns = any(p.style == "assignment" for p in patterns)
    code = F.col("code")
    has_block = F.col("next_ind") > F.col("ind")

    def found(text: Column) -> Column:
        listed = matches(text, plain)
        return F.concat(listed, assignments(text, mode)) if assigns else listed

    def described(d: Column, off: Column, end: Column) -> Column:
        indented = d["style"] == "indent"
        # An indented block ends in front of the next row that closes its indent. A
        # declaration without one (level -2) ends with its own statement.
        return _event(
            F.when(indented & has_block, F.col("next_ind") - 1).otherwise(F.lit(-2)),
            d["chunk_type"],
            d["name"],
            off + d["col"],
            F.when(indented, F.col("next_seen")).otherwise(end),
        )

    def several(parts: Column) -> Column:
        def listed(part: Column) -> Column:
            # Only the piece that reaches the end of the line can go on below it.
            stop = part["off"] + F.length(part["code"])
            own = F.struct(F.col("ln").alias("ln"), stop.alias("end"))
            end = F.when(stop < F.length(code), own).otherwise(F.col("next_coded"))
            return F.transform(found(part["code"]), lambda d: described(d, part["off"], end))

        return F.flatten(F.transform(parts, listed))

    single = F.transform(found(code), lambda d: described(d, F.lit(0), F.col("next_coded")))
    none = F.filter(
        F.array(_event(F.lit(0), F.lit(""), F.lit(""), F.lit(0), F.col("seen"))), lambda _: F.lit(False)
    )
    hints = [p.hint for p in plain] + (["="] if assigns else [])
    may_declare = reduce(Column.__or__, [code.contains(hint) for hint in hints])
    declared = (
        F.when(~F.col("is_start") | ~may_declare | (code == lexis.END_OF_FILE), none)
        .when(is_compound(code), bound(pieces(code), several))
        .otherwise(single)
    )
    empty = F.lit(None).cast("string")
    closed = F.when(
        F.col("eff") < F.col("prev_eff"),
        F.transform(
            F.sequence(F.col("eff"), F.col("prev_eff") - 1),
            lambda level: _event(level, empty, empty, F.lit(None).cast("int"), F.col("seen")),
        ),
    ).otherwise(none)
    events = rows.select("path", "language", "ln", F.explode(F.concat(declared, closed)).alias("event")).select(
        "path", "language", "ln", "event.*"
    )

    # Going backwards through the file, the last closing row seen is the next one below.
    backwards = Window.partitionBy("path", "level").orderBy(F.desc("ln"), F.col("chunk_type").isNull())
    closing = F.when(F.col("chunk_type").isNull(), F.struct("end_ln", "end_col"))
    events = events.withColumn("closing", F.last(closing, ignorenulls=True).over(backwards.rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    ))).where(F.col("chunk_type").isNotNull())
    by_statement = F.col("level") == -2
    return events.select(
        "path",
        "language",
        "chunk_type",
        "name",
        F.col("ln").alias("s"),
        "scol",
        F.when(by_statement, F.col("end_ln")).otherwise(F.col("closing.end_ln")).alias("e"),
        F.when(by_statement, F.col("end_col")).otherwise(F.col("closing.end_col")).alias("ecol"),
    )


def with_owner(declared: DataFrame) -> DataFrame:
    """Add ``owner``: the nearest class around a function, null outside of classes.

    Spans of one file are nested or disjoint. So the class around a row is the last
    one that was opened with the nesting depth that holds at the row.
    """
    is_class = F.col("chunk_type") == "classes"
    mark = lambda at, step: F.struct(at.alias("at"), F.lit(step).alias("step"))
    opened = F.when(is_class, F.array(mark(F.col("s") * 2, 1), mark(F.col("e") * 2 + 1, -1))).otherwise(
        F.array(mark(F.col("s") * 2, 0))
    )
    rows = declared.withColumn("mark", F.explode(opened))
    order = Window.partitionBy("path").orderBy(F.col("mark.at"), F.col("scol"))
    rows = rows.withColumn(
        "nesting",
        F.coalesce(F.sum("mark.step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        + F.greatest(F.col("mark.step"), F.lit(0)),
    ).where(F.col("mark.step") >= 0)
    depth = Window.partitionBy("path", "nesting").orderBy(F.col("mark.at"), F.col("scol"))
    around = F.last(F.when(is_class, F.col("name")), ignorenulls=True).over(
        depth.rowsBetween(Window.unboundedPreceding, -1)
    )
    is_function = F.col("chunk_type") == "functions"
    return rows.withColumn("owner", F.when(is_function & (F.col("nesting") > 0), around)).drop("mark", "nesting")
