"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import json
import os
from array import array

from runloom.llm.common import per_worker

# Bytes of distinct words and their ids that a Python worker keeps; then it starts anew.
CACHE_BYTES = 192 << 20
# What a kept word costs beside its own bytes.
ENTRY_BYTES = 160

# Steps of the tokenizers that take a word of letters as one lower-case piece.
LETTER_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
# Up to here, letters are the same to every Unicode version and unchanged by NFC.
LAST_LETTER = "\u024f"
# Marks that such tokenizers cut off behind a word of letters as a piece of their own.
MARKS = ".,;:!?"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in out)
    out.update({b: chr(256 + k) for k, b in enumerate(others)})
    return [out[b] for b in range(256)]


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space and never join tokens across it, so that a text's
    ids are its words' ids in a row. Words are cut at ASCII white space only, which every
    such tokenizer drops; each distinct word goes through the library once per worker. Of a
    tokenizer that lower-cases words and cuts them where letters end, words of letters, with or
    without marks behind them, go straight to the library's model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        kinds = (
            [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])],
            [x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])],
        )
        self.letters = kinds == LETTER_STEPS
        self.characters = byte_characters()
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0

    @staticmethod
    def of_worker(path: str) -> WordEncoder:
        return per_worker(("word encoder", path), lambda: WordEncoder(path))

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        missing = list(set(words).difference(self.known))
        if missing:
            self._learn(missing)
        ids = b"".join(map(self.known.__getitem__, words))
        if self.bytes > CACHE_BYTES:
            self.known, self.bytes = {}, 0
        return ids

    def _learn(self, words: list[bytes]) -> None:
        others = []
        for word in words:
            ids = self._of_letters(word) if self.letters else None
            if ids is None:
                others.append(word)
            else:
                self._keep(word, ids)
        if others:
            texts = [word.decode() for word in others]
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for word, one in zip(others, encoded):
                self._keep(word, pack(one.ids))

    def _of_letters(self, word: bytes) -> bytes | None:
        text = word.decode()
        core = text.rstrip(MARKS)
        plain = core.lower()
        if not plain.isalpha() or max(plain) > LAST_LETTER:
            return None
        if not plain.isascii():
            plain = "".join(map(self.characters.__getitem__, plain.encode()))
        ids = [token.id for token in self.model.tokenize(plain)]
        if len(core) < len(text):
            ids += [token.id for token in self.model.tokenize(text[len(core) :])]
        return pack(ids)

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.bytes += len(word) + len(ids) + ENTRY_BYTES


def pack(ids) -> bytes:
    packed = array("I", ids)
    if array("H", [1]).tobytes() != b"\x01\x00":
        packed.byteswap()
    return packed.tobytes()
