"""Byte-pair encoding and decoding by forced-boundary splitting.

Two adjacent bytes that stand next to each other inside no vocabulary token
can never end up in one token: the place between them is a certain cut. Each
piece of the tokenizer's splitting pattern is cut there, the fragments are
encoded independently of each other (and remembered, since most recur), and
their ids are put in a row. Merges cannot cross a certain cut, so the ids are
those of the uncut piece.

The vocabulary file is read once on the driver and broadcast: its size is
that of the file, whatever the corpus. Texts are handled whole, one row at a
time, without any shuffle; a lost executor repeats its own partitions only.

Defined results: a null text is encoded as the empty one (no ids, empty
decoding); repeated rows give repeated results; an empty table gives an empty
result; further columns pass through, and one that has the name of an output
column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voltloom.llm.base import append

#: White space as the splitting pattern of the vocabulary sees it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The splitting pattern of the byte-level vocabulary, for all texts and for ASCII texts.
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPLIT_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Pieces remembered inside one partition (some 25 MB); the next text beyond it starts anew.
REMEMBERED = 200_000

OUTPUTS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Known(dict):
    """Pieces and their ids; what is missing is made, and remembered if it is short."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def spans(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings in a row, with the start and the length of each."""
    lengths = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


def laid_out(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The strings of the ids, one after the other."""
    pool, starts, lengths = table
    n = lengths[ids]
    ends = np.cumsum(n)
    at = np.repeat(starts[ids] - (ends - n), n)
    at += np.arange(len(at))
    return pool[at].tobytes()


class ByteBpe:
    """A vocabulary with its merges, its certain cuts and its remembered fragments."""

    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        model, added = data["model"], data["added_tokens"]
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take white space or whole words are not supported")
        byte_of = byte_letters()
        special = {a["content"]: a["id"] for a in added}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        joint: set[int] = set()
        for b in self.bytes_of.values():
            joint.update(x << 8 | y for x, y in zip(b, b[1:]))
        self.cut = [x not in joint for x in range(1 << 16)]
        # Merging by the ids of the merged tokens is merging in the order of the list of merges only if both rise together.
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids do not follow the order of the merges")
        # One fragment's merges run in a public library, on bytes that this class has cut.
        self.merged = tiktoken.Encoding(
            "fragments", pat_str=r"[\s\S]+", special_tokens={},
            mergeable_ranks={b: i for i, b in self.bytes_of.items()})._core_bpe.encode_single_piece
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = special
        # Group 0 alone: an added token is taken before any other splitting, the longest first.
        self.at_special = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.bytes_at = spans([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)])
        self.digits_at = spans([b"%d," % i for i in range(max(self.bytes_of) + 1)])
        self.known = Known(self.piece)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut between bytes that no token holds side by side."""
        cut, start, out = self.cut, 0, []
        for i in range(1, len(piece)):
            if cut[piece[i - 1] << 8 | piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def piece(self, text: str) -> bytes:
        """The ids of one piece, four bytes each."""
        out: list[int] = []
        for fragment in self.fragments(text.encode()):
            out += self.merged(fragment)
        return np.array(out, np.int32).tobytes()

    def plain(self, text: str) -> bytes:
        pieces = (SPLIT_ASCII if text.isascii() else SPLIT).findall(text)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.at_special.split(text) if self.at_special else [text]
        return np.frombuffer(b"".join(
            np.int32(self.special[p]).tobytes() if p in self.special else self.plain(p) for p in parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that are none become the replacement character."""
        raw = laid_out(self.bytes_at, ids)
        return raw.decode("utf-8", "replace").encode()

    def results(self, text: str | None, wanted: Sequence[str]) -> dict[str, object]:
        ids = self.encode(text)
        out: dict[str, object] = {"n_tokens": len(ids), "ids": ids}
        if "ids_sha256" in wanted:
            out["ids_sha256"] = hashlib.sha256(laid_out(self.digits_at, ids)[:-1]).hexdigest()
        if "decoded" in wanted or "decoded_sha256" in wanted:
            decoded = self.decode(ids)
            out["decoded"] = decoded.decode() if "decoded" in wanted else None
            out["decoded_sha256"] = hashlib.sha256(decoded).hexdigest()
        return out


_LOADED: dict[int, ByteBpe] = {}


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text",
                  outputs: Sequence[str] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``df`` with the wanted ones of ``OUTPUTS``: ids of the whole text, and their decoding.

    ``vocabulary`` is the path of a byte-level BPE file on the driver.
    """
    spec = open(vocabulary, "rb").read()
    shared = df.sparkSession.sparkContext.broadcast(spec)
    wanted = tuple(outputs)
    name = hash(spec)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = ByteBpe(shared.value)
        bpe = _LOADED[name]
        column = batch.column(batch.schema.names.index(text))
        out: dict[str, list] = {k: [] for k in wanted}
        for value in column:
            got = bpe.results(value.as_py(), wanted)
            for k in wanted:
                out[k].append(got[k])
        return out

    def done() -> None:
        if name in _LOADED:
            _LOADED[name].known.clear()

    return append(df, {k: OUTPUTS[k] for k in wanted}, work, done)
