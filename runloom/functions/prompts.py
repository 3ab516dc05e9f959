"""Prompt templates and one-pass slot filling.

A template is user data: text with ``{slot}`` places. It is cut into literal
pieces once, on the driver; the values are columns and are never expanded again,
so braces, ``$`` or backslashes inside a document stay as they are.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.functions.text import strip

# Each template names its inputs first and the wanted output last.
DISTIL = (
    "Input document:\n---\n{text}\n---\n"
    "Output: bullet points, at most one line each. One point per thing the document names, with its"
    " fields; one per link between two things, with how many of each; one per condition."
    " Leave out everything else."
)

GENERATE = (
    "Input document:\n---\n{text}\n---\n"
    "Output: PlantUML source of its class diagram. First line: @startuml. Last line: @enduml. No other text."
)

SIMILARITY = (
    "Input A, PlantUML source:\n---\n{script}\n---\nInput B, document:\n---\n{text}\n---\n"
    "Output: a JSON object, no other text, with the keys\n"
    "extracted_description: string, what A models\n"
    "similarity_score: number, 0 (A has nothing of B) to 100 (all of it)\n"
    "discrepancies: strings, where A and B contradict\n"
    "missing_elements: strings, in B only\n"
    "additional_elements: strings, in A only"
)

_AGAIN = (
    "---\n{text}\n---\nInput B, PlantUML source of its class diagram:\n---\n{script}\n---\n"
    "Input C, review of B:\n---\n{analysis}\n---\n"
    "Output: B with every point of C settled in favour of A. First line: @startuml. Last line: @enduml."
    " No other text."
)
REGENERATE_ORIG = "Input A, document:\n" + _AGAIN
REGENERATE_DIST = "Input A, bullet points of a document:\n" + _AGAIN


def fill(template: str, **slots: Column) -> Column:
    """Concatenate the literal pieces of ``template`` with the slot columns."""
    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            pieces.append(F.coalesce(slots[slot], F.lit("")))
    return F.concat(*pieces)


def distil(text: Column, template: str = DISTIL) -> Column:
    """The filled template, stripped; on the driver if both its ends are literal."""
    bare = template.strip()
    prompt = fill(bare, text=text)
    return strip(prompt) if bare.startswith("{") or bare.endswith("}") else prompt


def generate(text: Column, template: str = GENERATE) -> Column:
    return fill(template, text=text)


def similarity(script: Column, text: Column, template: str = SIMILARITY) -> Column:
    return fill(template, script=script, text=text)


def regenerate(
    flow: str, text: Column, script: Column, analysis: Column, template: str | None = None
) -> Column:
    chosen = template or {"orig": REGENERATE_ORIG, "dist": REGENERATE_DIST}[flow]
    return fill(chosen, text=text, script=script, analysis=analysis)
