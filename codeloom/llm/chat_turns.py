"""Transcript parsing with a hidden Markov model (operator 6).

A conversation is a sequence of segments: its rows in the order of ``turn``, each cut in front of lines that begin with a
speaker marker. Hidden states are the roles; what is seen of a segment are its marker and features of its lines. Emission
and transition weights are counted from rows whose role is known (rows whose conversation's crc32 is divisible by
five are not learnt from), and the Viterbi path gives the roles, from which canonical turns are rendered.

Segments are sorted over all tasks, so a conversation may be cut between tasks wherever it is long. Each task reduces its open
first and last pieces to a table: the best weight from any state before the piece to any state at its end. These
tables, two for each task, are composed in order, which fixes the states at all cuts; then every task decodes
its own rows. Weights are whole numbers, so composed tables equal the unbroken recursion.

Defined results: rows without text have one empty segment; a null conv_id is a conversation of its own; a null turn comes
first; ties of turn are ordered by text; repeated rows are repeated segments; without known roles the weights come
from the markers alone; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, map_texts

ROLES = ("system", "user", "assistant", "tool")
#: Names that other formats give to the roles.
NAMES = {
    "system": 0, "developer": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "prompter": 1, "customer": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "answer": 2, "a": 2, "agent": 2, "tool": 3, "function": 3, "observation": 3,
}
_MARKER = re.compile(
    r"^[ \t]*(?:<\|im_start\|>|<\||\[|\*\*|#{1,4} *)?(%s)(?:\|>|\]|\*\*)?[ \t]*(?::(?:\*\*)?|>|(?<=[\]>])|(?=\n))[ \t]*\n?" % "|".join(sorted(NAMES, key=len, reverse=True)),
    re.IGNORECASE | re.MULTILINE,
)
_END = re.compile(r"<\|(?:im_end|end)\|>\s*\Z")
#: Observations: marker (0 none, else role + 1), size, lines, question, listing.
SIZES = (5, 14, 8, 2, 2)
#: Weights are logarithms in millionths.
UNIT = 1_000_000
#: Pseudo-counts: a marker nearly always tells its role.
RIGHT_MARKER, WRONG_MARKER = 200.0, 0.02
LOW = -(10**15)


def segments(text: str) -> list[tuple[int, str]]:
    """(marker, text without it) for each segment of a row."""
    cuts = [m for m in _MARKER.finditer(text)]
    if not cuts:
        return [(0, text)]
    out = [(0, text[: cuts[0].start()])] if text[: cuts[0].start()].strip() else []
    for cut, following in zip(cuts, [*cuts[1:], None], strict=True):
        body = text[cut.end() : following.start() if following else len(text)]
        out.append((NAMES[cut[1].lower()] + 1, _END.sub("", body).strip("\n")))
    return out


_LISTING = re.compile(r"(?m)^[^\S\n]*(?:[-*] |\d+[.)] |```)")


def seen(marker: int, text: str) -> list[int]:
    """What the model sees of a segment."""
    lines = text.strip().count("\n") + 1
    # White space other than newlines: a line start is then tried once, not run over every later line.
    listing = bool(_LISTING.search(text))
    return [marker, min(13, len(text).bit_length()), min(7, lines - 1), int(text.rstrip().endswith("?")), int(listing)]


def segment_rows(conversations: DataFrame) -> DataFrame:
    """The segments of all rows with what is seen of them; ``known`` is the state of rows with a known role, else null."""

    def work():
        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, numbers, marks, texts = [], [], [], []
            for i, text in enumerate(batch.column(4).to_pylist()):
                for number, (marker, body) in enumerate(segments(text or "")):
                    at.append(i)
                    numbers.append(number)
                    marks.append(seen(marker, body))
                    texts.append(body)
            index = pa.array(at, pa.int64())
            kept = [batch.column(c).take(index) for c in range(4)]
            columns = [*kept, pa.array(numbers, pa.int32()), pa.array(marks, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "known", "text_hash", "segment", "seen", "text"])

        return of_batch

    name = F.lower(F.trim("role"))
    known = F.coalesce(*[F.when(name == n, F.lit(state)) for n, state in NAMES.items()])
    rows = conversations.select("conv_id", "turn", known.cast("int").alias("known"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "conv_id bigint, turn bigint, known int, text_hash bigint, segment int, seen array<int>, text string"
    return map_texts(rows, rows.columns, schema, work)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 5 == 0


def _log(value: float) -> int:
    return round(math.log(value) * UNIT)


class Weights:
    """Weights of first states, transitions and observations."""

    def __init__(self, first: dict[int, int], moves: dict[tuple[int, int], int], marks: dict[tuple[int, int, int], int]) -> None:
        k = range(len(ROLES))
        self.first = [_log((first.get(s, 0) + 1) / (sum(first.values()) + len(ROLES))) for s in k]
        self.moves = [
            [_log((moves.get((r, s), 0) + 1) / (sum(moves.get((r, t), 0) for t in k) + len(ROLES))) for s in k] for r in k
        ]
        self.marks = []
        for s in k:
            tables = []
            for feature, size in enumerate(SIZES):
                prior = [1.0] * size
                if feature == 0:
                    prior = [RIGHT_MARKER, *(RIGHT_MARKER if m == s else WRONG_MARKER for m in k)]
                counts = [marks.get((s, feature, v), 0) + prior[v] for v in range(size)]
                tables.append([_log(c / sum(counts)) for c in counts])
            self.marks.append(tables)

    def emission(self, values: list[int]) -> list[int]:
        return [sum(table[v] for table, v in zip(tables, values, strict=True)) for tables in self.marks]

    def advance(self, before: list[int] | None, values: list[int]) -> tuple[list[int], list[int]]:
        """Weights after a segment and the states they come from; ``before`` is None where a conversation begins."""
        emission, k = self.emission(values), range(len(ROLES))
        if before is None:
            return [a + b for a, b in zip(self.first, emission, strict=True)], [-1] * len(ROLES)
        best = [max(k, key=lambda r, s=s: (before[r] + self.moves[r][s], -r)) for s in k]
        return [before[r] + self.moves[r][s] + emission[s] for s, r in zip(k, best, strict=True)], best


def weights_of(rows: DataFrame) -> Weights:
    """Counts of what is known; each a small aggregate of all rows."""
    known = rows.where(F.col("known").isNotNull() & (F.col("segment") == 0) & ~held_out())
    marks = known.select("known", F.posexplode("seen").alias("feature", "value")).groupBy("known", "feature", "value").count()
    # One state for each place, so that repeated rows do not multiply; neighbours meet by conversation and turn.
    places = checkpointed(
        known.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("known").alias("known"))
    )
    # The largest turn has no next one; try_add gives null there instead of an overflow.
    before = places.select("conv_id", F.try_add(F.col("turn"), F.lit(1)).alias("turn"), F.col("known").alias("before"))
    met = places.join(before, ["conv_id", "turn"], "left").groupBy("before", "known").count().collect()
    return Weights(
        {r.known: r["count"] for r in met if r.before is None},
        {(r.before, r.known): r["count"] for r in met if r.before is not None},
        {(r.known, r.feature, r.value): r["count"] for r in marks.collect()},
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[list[int]]]]:
    """Conversations of a sorted partition with what is seen of their segments."""
    current, rows = None, []
    for batch in batches:
        for conversation, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if current is None or current[0] != conversation:
                if current is not None:
                    yield current[0], rows
                current, rows = (conversation,), []
            rows.append(values)
    if current is not None:
        yield current[0], rows


def _tables(weights: Weights, values: list[list[int]]) -> list[list[int]]:
    """For each state before the values, and last for a beginning conversation: best weights of the states after them."""
    out = []
    for state in [*range(len(ROLES)), None]:
        now = None if state is None else [0 if s == state else LOW for s in range(len(ROLES))]
        for seen_here in values:
            now, _ = weights.advance(now, seen_here)
        out.append(now)
    return out


def _cuts(pieces: list[tuple[int, int | None, int | None, list[list[int]], list[list[int]]]], same: list[bool]) -> dict[int, tuple[int | None, int | None]]:
    """For each partition the state before its first row, if a conversation goes on there, and the state at its end.

    ``pieces`` have the partition, the number of its conversations, and the tables of its first and last one.
    ``same`` tells whether a partition goes on with the conversation of the one before.
    """
    after, k = [], range(len(ROLES))
    for at, (_, runs, _, first, last) in enumerate(pieces):
        if runs == 1 and same[at]:
            before = after[-1]
            after.append([max(before[r] + first[r][s] for r in k) for s in k])
        else:
            after.append(last[-1])
    ends: list[int | None] = [None] * len(pieces)
    begins: list[int | None] = [None] * len(pieces)
    for at in range(len(pieces) - 1, -1, -1):
        if ends[at] is None:
            ends[at] = max(k, key=lambda s, at=at: (after[at][s], -s))
        if same[at]:
            _, runs, _, first, _ = pieces[at]
            before = after[at - 1]
            if runs == 1:
                end = ends[at]
            else:
                whole = [max(before[r] + first[r][s] for r in k) for s in k]
                end = max(k, key=lambda s, whole=whole: (whole[s], -s))
            begins[at] = ends[at - 1] = max(k, key=lambda r, end=end, before=before, first=first: (before[r] + first[r][end], -r))
    return {piece[0]: (begins[at], ends[at]) for at, piece in enumerate(pieces)}


def path(weights: Weights, values: list[list[int]], begin: int | None, end: int | None) -> list[int]:
    """The best states, given those before the first and at the last of the values, or None."""
    now = None if begin is None else [0 if s == begin else LOW for s in range(len(ROLES))]
    steps = []
    for seen_here in values:
        now, best = weights.advance(now, seen_here)
        steps.append(best)
    state = max(range(len(ROLES)), key=lambda s: (now[s], -s)) if end is None else end
    out = []
    for best in reversed(steps):
        out.append(state)
        state = best[state]
    return out[::-1]


def chat_turns(conversations: DataFrame) -> DataFrame:
    """For each segment ``conv_id``, ``turn``, ``segment``, ``role``, ``opens`` (a new turn begins) and ``rendered``.

    The rendered segments of a conversation in the order of ``place``, joined by line breaks, are its canonical transcript.
    """
    rows = checkpointed(segment_rows(conversations))
    weights = weights_of(rows)
    keys = ["conv_id", "turn", "text_hash", "segment", "tie"]
    # Equal rows are dealt to several tasks too; which of them comes first makes no difference.
    ordered = rows.withColumn("tie", F.monotonically_increasing_id())
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(
        ordered.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("tie", "known", "text_hash")
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, last = 0, None, None
        for run in _runs(batches):
            first, last, count = first or run, run, count + 1
        if count:
            tables = [_tables(weights, values) for _, values in (first, last)]
            names = ["task", "runs", "first_id", "last_id", "first", "last"]
            values = [TaskContext.get().partitionId(), count, first[0], last[0], *[sum(t, []) for t in tables]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    schema = "task bigint, runs bigint, first_id bigint, last_id bigint, first array<bigint>, last array<bigint>"
    found = sorted(ordered.select("conv_id", "seen").mapInArrow(reduce, schema).collect(), key=lambda r: r.task)
    width = len(ROLES)

    def square(flat: list[int]) -> list[list[int]]:
        return [flat[i : i + width] for i in range(0, len(flat), width)]

    same = [i > 0 and found[i - 1].last_id == r.first_id for i, r in enumerate(found)]
    cuts = _cuts([(r.task, r.runs, r.first_id, square(r.first), square(r.last)) for r in found], same)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        task = TaskContext.get().partitionId()
        begin, end = cuts[task]
        runs = list(_runs(iter([b.select([0, 3]) for b in batches])))
        states, opens = [], []
        for i, (_, values) in enumerate(runs):
            before = begin if i == 0 else None
            found = path(weights, values, before, end if i == len(runs) - 1 else None)
            opens += [a != b for a, b in zip([-1 if before is None else before, *found], found, strict=False)]
            states += found
        at = 0
        for batch in batches:
            roles = [ROLES[s] for s in states[at : at + batch.num_rows]]
            opening = opens[at : at + batch.num_rows]
            texts = batch.column(4).to_pylist()
            rendered = [f"<|{role}|>\n{text}" if new else text for role, new, text in zip(roles, opening, texts, strict=True)]
            places = pa.array([task << 33 | i for i in range(at, at + batch.num_rows)], pa.int64())
            at += batch.num_rows
            columns = [*batch.columns[:3], pa.array(roles), pa.array(opening), pa.array(rendered), places]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "segment", "role", "opens", "rendered", "place"])

    schema = "conv_id bigint, turn bigint, segment int, role string, opens boolean, rendered string, place bigint"
    return ordered.select("conv_id", "turn", "segment", "seen", "text").mapInArrow(decode, schema)
