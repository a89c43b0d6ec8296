"""Removal of personal data, and of terms that disclose it (operator 9).

Direct identifiers (mail and network addresses, card and phone numbers) are found by their form. They are the protected
entities. Terms near an entity may disclose it too. Over all documents it is counted
in how many a term occurs, an entity occurs, and both occur near each other; the information that a term gives about an
entity is their pointwise mutual information, and an entity's own information is that of its rarity.
A term that gives more than the share ``DISCLOSED`` of it, seen in ``LEAST_TEXTS`` different texts, is a
disclosing term and goes wherever it stands: a capitalised one is generalised to a name, another one removed.

Only terms within ``REACH`` words of an entity are candidates, so pairs grow with the entities found. Sets of terms
go to the tasks in blocks of at most ``BLOCK_TERMS``; more terms mean more passes.

Defined results: a null or empty text has no spans and stays as it is; repeated rows give repeated rows, and count as
often; an empty table gives an empty one; further columns are kept by ``sanitised`` and ignored otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, map_texts, strings

KINDS = ("email", "ip", "card", "phone")
REACH = 5
LEAST_TEXTS = 3
DISCLOSED = 0.95
BLOCK_TERMS = 500_000
#: A term: four letters or more.
_TERM = re.compile(r"[^\W\d_]{4,}")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive forms of the given patterns. A run of digits that fails from its first digit fails from all, so that
#: they find the same and stay linear in long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(done, at + 1))


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """Direct identifiers, by kind and place."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    if "." in text:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def entity_of(kind: str, value: str) -> str:
    """The same for all ways to write an identifier."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(_DIGIT.findall(value))}"


def _outside(terms: Iterator[re.Match], spans: list[Span]) -> Iterator[re.Match]:
    """Terms that no span touches."""
    taken = sorted((b, e) for _, b, e in spans)
    at = 0
    for term in terms:
        while at < len(taken) and taken[at][1] <= term.start():
            at += 1
        if at == len(taken) or term.end() <= taken[at][0]:
            yield term


def nearby(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """(term, entity) for the terms up to ``REACH`` words before and after each identifier."""
    pairs = set()
    # Spans sorted once by start: those that reach into a window are found by bisection, reaching back by the
    # longest span, so a text with many identifiers costs a logarithm for each window, not a pass over all spans.
    ordered = sorted(spans, key=lambda span: span[1])
    starts = [span[1] for span in ordered]
    longest = max((span[2] - span[1] for span in spans), default=0)

    def touching(low: int, high: int) -> list[Span]:
        return [s for s in ordered[bisect_left(starts, low - longest) : bisect_left(starts, high)] if s[2] > low]

    for kind, begin, end in spans:
        entity = entity_of(kind, text[begin:end])
        # Words can be long; terms are looked for in a window that grows until it has enough.
        for left, right, side in ((0, begin, -1), (end, len(text), 1)):
            size = 200
            while True:
                low, high = (max(left, right - size), right) if side < 0 else (left, min(right, left + size))
                others = touching(low, high)
                found = [m.group().lower() for m in _outside(_TERM.finditer(text, low, high), others)]
                if side < 0 and low > left:
                    found = found[1:]  # the first may be cut
                elif side > 0 and high < right:
                    found = found[:-1]
                if len(found) >= REACH or (low <= left and high >= right):
                    break
                size *= 4
            pairs.update((term, entity) for term in (found[-REACH:] if side < 0 else found[:REACH]))
    return pairs


def identifiers(docs: DataFrame) -> DataFrame:
    """``text_hash``, the (term, entity) ``pairs`` and the ``entities`` of every row with direct identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("term", pa.string()), ("entity", pa.string())])
        for batch in batches:
            at, pairs, entities = [], [], []
            for i, text in enumerate(strings(batch.column(1))):
                spans = base_spans(text)
                if spans:
                    at.append(i)
                    pairs.append([{"term": t, "entity": e} for t, e in sorted(nearby(text, spans))])
                    entities.append(sorted({entity_of(k, text[b:e]) for k, b, e in spans}))
            if at:
                columns = [batch.column(0).take(pa.array(at)), pa.array(pairs, pa.list_(pair)), pa.array(entities, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["text_hash", "pairs", "entities"])

    schema = "text_hash bigint, pairs array<struct<term:string,entity:string>>, entities array<string>"
    return docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def term_blocks(terms: DataFrame) -> Iterator[frozenset[str]]:
    """The terms in sets of bounded size, read as a stream; the caller keeps every set it has taken, so the driver
    holds all disclosing terms while it plans (they are a vocabulary, bounded by the distinct terms, not by rows)."""
    block: list[str] = []
    for (term,) in terms.toLocalIterator():
        block.append(term)
        if len(block) == BLOCK_TERMS:
            yield frozenset(block)
            block = []
    if block:
        yield frozenset(block)


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` and ``n_term``: in how many rows each of ``terms`` occurs."""

    def counted(block: frozenset[str]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, counts = shared.value, Counter()
            for batch in batches:
                for text in strings(batch.column(0)):
                    counts.update(wanted.intersection(_TERM.findall(text.lower())))
            if counts:
                columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

        return docs.select("text").mapInArrow(run, "term string, n bigint")

    parts = [counted(block) for block in term_blocks(terms)]
    if not parts:
        return terms.select("term", F.lit(0).cast("bigint").alias("n_term"))
    return reduce(DataFrame.union, parts).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term``: the terms that disclose an entity."""
    found = checkpointed(identifiers(docs))
    pairs = found.select("text_hash", F.explode("pairs").alias("pair")).select("text_hash", "pair.*")
    both = (
        pairs.groupBy("term", "entity", "text_hash")
        .agg(F.count("*").alias("rows"))
        .groupBy("term", "entity")
        .agg(F.sum("rows").alias("n_both"), F.count("*").alias("texts"))
        .where(F.col("texts") >= LEAST_TEXTS)
    )
    both = checkpointed(both.drop("texts"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = document_counts(docs, both.select("term").distinct())
    total = docs.count()
    given = F.log2(F.col("n_both") * float(total) / (F.col("n_term") * F.col("n_entity").cast("double")))
    own = F.log2(float(total) / F.col("n_entity"))
    judged = both.join(terms, "term").join(entities, "entity").where((own > 0) & (given >= DISCLOSED * own))
    return checkpointed(judged.select("term").distinct())


def all_spans(text: str, terms: frozenset[str]) -> list[Span]:
    """Direct identifiers, then disclosing terms."""
    spans = base_spans(text)
    if terms and not terms.isdisjoint(_TERM.findall(text.lower())):
        found = (m for m in _TERM.finditer(text) if m.group().lower() in terms)
        spans += [("term", *m.span()) for m in _outside(found, spans)]
    return spans


def cleaned(text: str, spans: list[Span]) -> str:
    """The text with its spans generalised or removed."""
    out, done = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin < done:
            done = max(done, end)
            continue
        out.append(text[done:begin])
        out.append(f"[{kind.upper()}]" if kind != "term" else "[NAME]" if text[begin].isupper() else "[REMOVED]")
        done = end
    return "".join([*out, text[done:]])


def _terms_of(docs: DataFrame) -> list[frozenset[str]]:
    return list(term_blocks(disclosing_terms(docs)))


def personal_spans(docs: DataFrame) -> DataFrame:
    """For each row ``doc_id`` and ``spans``: kind, begin and end in code points, end exclusive; by kind, then place."""
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in _terms_of(docs)]

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in strings(batch.column(1)):
                spans = all_spans(text, shared[0].value if shared else frozenset())
                for block in shared[1:]:
                    spans += [s for s in all_spans(text, block.value) if s[0] == "term"]
                rows.append([{"kind": k, "begin": b, "end": e} for k, b, e in spans])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

        return of_batch

    schema = "doc_id bigint, spans array<struct<kind:string,begin:int,end:int>>"
    return map_texts(docs, ["doc_id", "text"], schema, work)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; all other columns as they are."""
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in _terms_of(docs)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    spans = all_spans(text, shared[0].value if shared else frozenset())
                    for block in shared[1:]:
                        spans += [s for s in all_spans(text, block.value) if s[0] == "term"]
                    texts[i] = cleaned(text, spans) if spans else text
            yield batch.set_column(at, "text", pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)


def span_digest(rows: DataFrame) -> DataFrame:
    """Counts and checksums of what ``personal_spans`` gives."""
    written = "transform({}, s -> concat_ws(':', s.kind, s.begin, s.end))"
    base = F.expr("array_join(" + written.format("filter(spans, s -> s.kind <> 'term')") + ", ',')")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    every = F.expr("array_join(" + written.format("spans") + ", ',')")
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
