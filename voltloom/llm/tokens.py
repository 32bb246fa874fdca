"""Ids of whole texts by public tokenizers, in bounded memory.

A text longer than ``CHUNK`` characters is encoded in chunks. They are cut
only before a space that follows a character which is neither white space nor
the mark that stands for one: there every piece of the byte-level splitting
pattern ends, and no entry of a piece vocabulary holds a space behind another
character (``Pieces`` refuses one that does), so the ids are those of the
uncut text. A text without such a place stays in one chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import sentencepiece
import tiktoken

from voltloom.llm.bpe import byte_letters, laid_out, spans

#: The splitting pattern of the byte-level vocabulary, and the mark of a space in piece vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"

CHUNK = 1 << 19
#: Tokens laid out as bytes at one time.
LAID = 1 << 16

_PLACE = re.compile(rf"(?<=[^\s{SPACE_MARK}]) ")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where no token can reach across."""
    start = 0
    while len(text) - start > size:
        place = _PLACE.search(text, start + size)
        if place is None:
            break
        yield text[start:place.start()]
        start = place.start()
    yield text[start:] if start else text


def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> Iterator[bytes]:
    """The strings of the ids, one after the other, some at a time."""
    for start in range(0, len(ids), LAID):
        yield laid_out(table, ids[start:start + LAID])


def spells(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, raw: bytes) -> bool:
    """Whether the strings of the ids are ``raw``."""
    at = 0
    for part in joined(table, ids):
        if raw[at:at + len(part)] != part:
            return False
        at += len(part)
    return at == len(raw)


class Bytes:
    """A byte-level BPE vocabulary, as its library encodes with it."""

    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        model, added = data["model"], data["added_tokens"]
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take white space or whole words are not supported")
        special = {a["content"]: a["id"] for a in added}
        byte_of = byte_letters()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.library = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.strings = [self.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.table = spans(self.strings)

    def encode(self, text: str, special: bool) -> np.ndarray:
        """The ids; ``special`` says whether strings of special tokens in the text become those tokens."""
        taken = "all" if special else set()
        ids = [np.array(self.library.encode(c, allowed_special=taken, disallowed_special=()), np.int32)
               for c in chunks(text)]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)


class Pieces:
    """A piece vocabulary with byte fallback that adds a space before the text."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names):
            raise ValueError("a piece holds a space behind another character")
        silent = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(len(names))]
        self.strings = [b"" if quiet else bytes([int(n[1:-1], 16)]) if self.library.is_byte(i)
                        else n.replace(SPACE_MARK, " ").encode()
                        for i, (n, quiet) in enumerate(zip(names, silent))]
        self.table = spans(self.strings)

    def encode(self, text: str) -> np.ndarray:
        # The library puts the first space of each chunk back.
        ids = [np.array(self.library.encode(c[1:] if k else c, num_threads=1), np.int32)
               for k, c in enumerate(chunks(text))]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)


#: By kind, the file that this Python worker used last: its digest and what was made of it.
_LOADED: dict[type, tuple[bytes, object]] = {}


class File:
    """A vocabulary file, read on the driver and broadcast; its size is fixed, whatever the corpus.

    A Python worker keeps the one of each kind that it used last.
    """

    def __init__(self, spark, path: str) -> None:
        with open(path, "rb") as f:
            content = f.read()
        self.digest = hashlib.sha256(content).digest()
        self.shared = spark.sparkContext.broadcast(content)

    def _loaded(self, kind: type):
        if _LOADED.get(kind, (b"",))[0] != self.digest:
            _LOADED[kind] = self.digest, kind(self.shared.value)
        return _LOADED[kind][1]

    def bytes(self) -> Bytes:
        return self._loaded(Bytes)

    def pieces(self) -> Pieces:
        return self._loaded(Pieces)
