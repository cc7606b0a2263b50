"""Byte-level BPE, encoding and decoding.

Method: the bytes of a piece are read as Latin-1 text, so that an Aho-Corasick automaton over the token strings can scan them; it
runs over the reversed piece, which gives the longest token that starts at each position. The encoder walks from left to right
with these longest tokens and backtracks to shorter ones (a table gives each token's longest proper prefix token). A token may
follow another only if merging the bytes of both would leave exactly these two, a test on the merge tree whose answers
are kept; positions that proved to be dead ends are marked and never tried again, so the work is linear in the piece. The
result is the one that repeated merging by rank gives.

Defined cases: a null text is encoded as the empty one; a piece that is itself a token is that token, as in other encoders; pieces
come from the given pattern; ids out of the vocabulary raise an error on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import bounded_batches
from plcatlas.llm.words import slices

# Pieces whose ids a worker keeps, in each of two generations. Bounds its memory, never changes a result.
KEPT_PIECES = 100_000
LONGEST_KEPT = 64
KEPT_PAIRS = 250_000
# Texts of this size are encoded at a time; a worker holds the ids of a slice and not of a whole batch.
SLICE_BYTES = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is; about a megabyte, read once by the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Tokens by rank, and what the encoder needs to know about them."""

    def __init__(self, rank_file: bytes):
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.raw = {rank: token.encode("latin-1") for rank, token in self.token.items()}
        self.longest = max(map(len, self.rank))
        self.machine = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.machine.add_word(token[::-1], rank)
        self.machine.make_automaton()
        self.shorter = {rank: self._prefix(token) for token, rank in self.rank.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.token):
            self._find_parts(rank)

    def _prefix(self, token: str) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            found = self.rank.get(token[:end])
            if found is not None:
                return found
        return None

    def _find_parts(self, rank: int) -> None:
        """The two tokens that the last merge into this one joined; none for single bytes and tokens that no merge makes."""
        token = self.token[rank]
        left = self.shorter[rank]
        while left is not None:
            right = self.rank.get(token[len(self.token[left]) :])
            if right is not None and left < rank and right < rank and self._fit(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with just these two.

        Merges happen in order of rank. Undoing them from the latest on, the two bytes strings that meet at the border must never
        have been joinable before one of them was built up further.
        """
        limit = 1 << 60
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            from_left = left in self.parts and (right not in self.parts or left > right)
            if from_left:
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                # merges of one rank run from left to right, so a join of the same rank at the border comes first
                limit, right = right + 1, self.parts[right][0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        answer = self.pairs.get((left, right))
        if answer is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            answer = self.pairs[left, right] = self._fit(left, right)
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        size = len(text)
        longest: list[int | None] = [None] * size
        for end, rank in self.machine.iter(text[::-1]):
            at = size - 1 - end
            if longest[at] is None or len(self.token[rank]) > len(self.token[longest[at]]):
                longest[at] = rank
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < size:
            while candidate is not None:
                end = at + len(self.token[candidate])
                if open_at[end] and (not out or self.fits(out[-1], candidate)):
                    break
                candidate = self.shorter[candidate]
            if candidate is not None:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < size else None
            elif out:
                open_at[at] = 0
                last = out.pop()
                at -= len(self.token[last])
                candidate = self.shorter[last]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out


class Codec(dict):
    """Maps pieces of text to their ids as little-endian 32-bit numbers; computes and keeps what it hasn't met lately."""

    def __init__(self, rank_file: bytes, pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(rank_file)
        self.pieces = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.vocabulary.encode_piece(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[bytes, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _ids(own: Codec, texts: pa.Array) -> pa.Array:
    encoded = [own.encode(text.as_py() or "") for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])]).astype(np.int32)
    # ids are far below 2^31, so their bytes are those of signed numbers too
    ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), ids)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids: an array of token ids for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            at = 0
            for part in slices(b.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), _ids(own, part)], names=["doc_id", "ids"])
                at += len(part)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and data: the bytes that the ids stand for."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            data = [own.decode(np.asarray(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    rows = encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, data binary")


def encode_and_check(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids again, and returns the digest of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            counts, ids_digest, data_digest = [], [], []
            for text in b.column(1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                data_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(data_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
