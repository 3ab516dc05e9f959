"""Plain versions of operators, for small inputs."""

from __future__ import annotations

import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def symbols(text: str | None, by_words: bool):
    data = (text or "").encode()
    return WORDS.findall(data) if by_words else [data[k : k + 1] for k in range(len(data))]


def without_repeats(rows, by_words: bool, width: int = 50):
    """For each (doc_id, text): its symbols, which are removed, and what is left."""
    least: dict = {}
    cut = [(doc_id, symbols(text, by_words)) for doc_id, text in rows]
    for doc_id, found in cut:
        if doc_id is not None:
            for k in range(len(found) - width + 1):
                window = tuple(found[k : k + width])
                least[window] = min(doc_id, least.get(window, doc_id))
    out = []
    for doc_id, found in cut:
        gone = [False] * len(found)
        if doc_id is not None:
            for k in range(len(found) - width + 1):
                if least[tuple(found[k : k + width])] < doc_id:
                    gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = [s for s, g in zip(found, gone) if not g]
        kept = b" ".join(left).decode() if by_words else b"".join(left)
        out.append((doc_id, len(found), sum(gone), spans, kept))
    return out
