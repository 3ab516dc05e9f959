"""Secret scans: fixed patterns, and automata of the formats of what the patterns have found.

The patterns label credentials by kind. A bounded sample of each kind, and one of other tokens, is
turned into probabilistic automata; every token of the corpus is then scored by them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import Rows, durable
from runloom.llm.grammar import Automaton, infer

KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
PER_KIND = 2000
LONGEST = 200
# A credential is so many times likelier as one of its kind than as an ordinary token.
MARGIN = math.log(1000)
# What the automaton of ordinary tokens asks for a symbol that it does not expect.
FLOOR = math.log(1e-3)

# The patterns, and the lengths from which their matches count.
NAMED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = re.compile(NAMED, re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LEAST_TOKEN = 12
WORDS = ("password", "passwd", "secret", "token", "api")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]], list[tuple[int, int]]]:
    """(spans, labelled credentials, other tokens) of a text.

    Spans are in order of start, then kind. What access and hex match lies within one token, so
    those two are searched there. Other tokens are those that no span touches.
    """
    spans: list[Span] = []
    labelled = []
    low = text.lower()
    if any(word in low for word in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                spans.append((m.start(), 0, m.end()))
                labelled.append(("assign", m[2]))
    tokens = [m.span() for m in TOKEN.finditer(text) if m.end() - m.start() >= LEAST_TOKEN]
    for begin, end in tokens:
        for place, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(text, begin, end):
                if m.end() - m.start() >= LEAST[KINDS[place]]:
                    spans.append((m.start(), place, m.end()))
                    labelled.append((KINDS[place], m[0]))
    spans.sort()
    other, at, reach = [], 0, -1
    for begin, end in tokens:
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= begin:
            other.append((begin, end))
    return spans, labelled, other


@dataclass
class Formats:
    """The automaton of each kind, the likelihoods its credentials have, and the ordinary automaton."""

    kinds: dict[str, tuple[Automaton, float, float]]
    ordinary: Automaton | None

    def kind_of(self, token: str) -> str | None:
        """The kind under which ``token`` is likeliest, if its likelihood is one that credentials of
        that kind have and an ordinary token is far less likely; else None.
        """
        best = None
        for kind, (automaton, least, most) in self.kinds.items():
            score = automaton.score(token)
            if least <= score <= most and (best is None or score > best[0]):
                best = (score, kind)
        if best is None:
            return None
        if self.ordinary is not None and best[0] - self.ordinary.score(token, FLOOR) < MARGIN:
            return None
        return best[1]


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64())]))),
        ("labelled", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
        ("others", pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))),
    ]
)
SPAN = "array<struct<start:bigint,place:int,end:bigint>>"
FOUND_DDL = f"""doc_id bigint, spans {SPAN}, labelled array<struct<kind:string,value:string>>,
    others array<struct<start:bigint,value:string>>"""


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, labelled, others): what the patterns find, and every other token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(FOUND)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                spans, labelled, other = base_spans(text)
                yield from rows.add(
                    (
                        doc_id,
                        [{"start": a, "place": p, "end": b} for a, p, b in spans],
                        [{"kind": k, "value": v} for k, v in labelled],
                        [{"start": a, "value": text[a:b]} for a, b in other],
                    ),
                    sum(b - a for a, b in other) + 64,
                )
        yield from rows.flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return durable(docs.mapInArrow(scan, FOUND_DDL))


def learn(found: DataFrame, per_kind: int = PER_KIND, longest: int = LONGEST, alpha: float = 0.05) -> Formats:
    """Automata from a bounded sample: of each kind and of other tokens at most ``per_kind`` different
    ones of at most ``longest`` characters, in order of a hash. Only these come to the driver.
    """
    named = found.select(F.explode("labelled").alias("l")).select("l.kind", "l.value")
    other = found.select(F.explode("others.value").alias("value")).select(F.lit(ORDINARY).alias("kind"), "value")
    distinct = named.unionByName(other).where(F.length("value") <= longest).distinct()
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    sample = distinct.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= per_kind)
    values: dict[str, list[str]] = {}
    for row in sample.select("kind", "value").collect():
        values.setdefault(row.kind, []).append(row.value)
    kinds = {}
    for kind in KINDS:
        automaton = infer(values.get(kind, ()), alpha)
        if automaton is not None:
            scores = [automaton.score(value) for value in values[kind]]
            kinds[kind] = (automaton, min(scores), max(scores))
    return Formats(kinds, infer(values.get(ORDINARY, ()), alpha))


SCANNED = pa.schema([("doc_id", pa.int64()), FOUND.field("spans"), ("added", FOUND.field("spans").type)])
SCANNED_DDL = f"doc_id bigint, spans {SPAN}, added {SPAN}"


def scan(docs: DataFrame, per_kind: int = PER_KIND, longest: int = LONGEST) -> DataFrame:
    """(doc_id, spans, added): what the patterns find in each text, and what the automata add.

    A span is (start, place of its kind in ``KINDS``, end) in code points, its end exclusive; both
    lists are ordered by start, then kind. ``spans`` are the patterns' matches, leftmost and not
    overlapping within a kind, and never change. ``added`` are whole tokens, runs of at least twelve
    credential characters that no pattern's match touches, whose likelihood under a kind's automaton is
    within the range of the credentials that it was learned from, and at least 1,000 times that under
    the automaton of ordinary tokens. Ties between kinds go to the first.

    Every row of ``docs`` gives one row, repeated ids too; a null or empty text has no spans, a null
    id stays null, other columns are left out. Without labelled credentials nothing is added. Texts
    are scanned whole, in linear time, one at a time.
    """
    found = find_base(docs)
    formats = learn(found, per_kind, longest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(SCANNED)
        places = {kind: place for place, kind in enumerate(KINDS)}
        for batch in batches:
            for doc_id, spans, others in zip(*(batch.column(i) for i in range(3))):
                added = []
                for token in others.as_py():
                    kind = formats.kind_of(token["value"])
                    if kind is not None:
                        end = token["start"] + len(token["value"])
                        added.append({"start": token["start"], "place": places[kind], "end": end})
                yield from rows.add((doc_id.as_py(), spans.as_py(), added), 64)
        yield from rows.flush()

    return found.select("doc_id", "spans", "others").mapInArrow(score, SCANNED_DDL)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_{kind}..., base_sha256, spans) of scanned documents, spans as text."""

    def joined(spans):
        names = F.array(*[F.lit(kind) for kind in KINDS])
        parts = F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(parts, ",")

    def count(place: int):
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")

    return scanned.select(
        "doc_id",
        *[count(place).alias(f"n_{kind}") for place, kind in enumerate(KINDS)],
        F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("spans", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
