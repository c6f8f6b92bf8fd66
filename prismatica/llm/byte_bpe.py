"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece exactly one last token is valid: a token
sequence is what the merges would produce if and only if every adjacent pair
is (the two tokens' joined bytes encode to just them). So the last token of a
prefix is found among the tokens that end there, longest first, whose pair with
the last token of the remaining prefix is valid. The table of last tokens is
the encoding of all prefixes at once: appending bytes only extends it, and an
edit redoes the piece from the edit on.

Texts are cut into pieces by the vocabulary's pattern. A text is cut first at
each blank that follows a non-blank, where pieces always end, so repeated
chunks are encoded once per worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled

#: Entries a worker keeps in each cache before it starts afresh.
CACHE = 300_000
NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(self.sizes.values())
        self.endings = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), rank)
        self.endings.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._splits: dict[int, tuple | None] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """By definition: merge the adjacent pair of least rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token's bytes are just before their last merge; None for a byte."""
        if token not in self._splits:
            parts, before = [self.ranks[bytes([b])] for b in self.tokens[token]], None
            while len(parts) > 1:
                rank, at = min((self.ranks.get(self.tokens[a] + self.tokens[b], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                before, parts = parts, [*parts[:at], rank, *parts[at + 2 :]]
            self._splits[token] = (before and tuple(before)) if parts == [token] else ()
        return self._splits[token]

    def own(self, token: int) -> bool:
        """Whether the merges of the token's bytes end in the token."""
        return self.split(token) != ()

    def fits(self, a: int, b: int) -> bool:
        """Whether the joined bytes of two tokens encode to just the two.

        The merges next to the seam are undone, latest first. If the two parts
        that then meet could merge at a lower rank than what was undone, they
        would have merged across the seam before.
        """
        ranks, tokens, splits = self.ranks, self.tokens, self._splits
        if not (self.own(a) and self.own(b)):
            return False
        limit = NEVER
        while True:
            if ranks.get(tokens[a] + tokens[b], NEVER) < limit:
                return False
            left = splits[a] if a in splits else self.split(a)
            right = splits[b] if b in splits else self.split(b)
            if left and (not right or a > b):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def extend(self, last: list[int], piece: bytes, start: int) -> None:
        """Fill ``last``, the last token of each prefix, for prefixes longer than ``start``."""
        pairs, fits, sizes = self._pairs, self.fits, self.sizes
        if len(pairs) > 4 * CACHE:
            pairs.clear()
        del last[start + 1 :]
        # tokens ending at each byte come longest first
        skip = max(0, start - self.longest)
        for at, token in self.endings.iter(piece[skip:].decode("latin-1")):
            end = skip + at + 1
            begin = end - sizes[token]
            if len(last) != end or begin < 0:
                continue
            if begin:
                pair = last[begin] << 32 | token
                found = pairs.get(pair)
                if found is None:
                    found = pairs[pair] = fits(last[begin], token)
                if found:
                    last.append(token)
            elif self.own(token):
                last.append(token)
        if len(last) != len(piece) + 1:
            raise ValueError(f"byte {piece[len(last) - 1]} has no token")

    def prefixes(self, piece: bytes) -> list[int]:
        """The last token of each prefix; the first entry stands for the empty one."""
        last = [-1]
        self.extend(last, piece, 0)
        return last

    def append(self, piece: bytes, last: list[int], more: bytes) -> list[int]:
        """Prefix table of ``piece + more``, from the table of ``piece``."""
        last = list(last)
        self.extend(last, piece + more, len(piece))
        return last

    def edit(self, piece: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``piece[begin:end]``: the table is kept up to the edit and redone after it."""
        piece, last = piece[:begin] + new + piece[end:], list(last)
        self.extend(last, piece, begin)
        return piece, last

    def walk(self, last: list[int]) -> list[int]:
        """Token ids of the whole piece, back from its last token."""
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def piece(self, piece: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) > CACHE:
                self._pieces.clear()
            whole = self.ranks.get(piece)
            ids = [whole] if whole is not None else self.walk(self.prefixes(piece))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) < 100:
                self._pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = self._chunks.get(chunk)
        if found is None:
            if len(self._chunks) > CACHE:
                self._older, self._chunks = self._chunks, {}
            found = self._older.get(chunk)
            if found is None:
                found = b"".join([self.piece(p.encode()) for p in self.pattern.findall(chunk)])
            if len(chunk) < 100:
                self._chunks[chunk] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if BLANK_AFTER_BLANK.search(text):
            parts = AFTER_WORD.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + p for p in rest]] if rest else [first]
        chunk = self.chunk
        return b"".join([self._chunks.get(p) or chunk(p) for p in parts])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


BLANK_AFTER_BLANK = re.compile(r"\s ")
AFTER_WORD = re.compile(r"(?<=\S)(?= )")

_MODELS: dict[tuple, Bpe] = {}


def model(data: bytes, pattern: str) -> Bpe:
    """One model per worker and vocabulary."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _MODELS:
        _MODELS[key] = Bpe(read_ranks(data), pattern)
    return _MODELS[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``n_tokens, ids, decoded`` (binary: 32-bit ids, bytes).

    ``ranks`` is the content of a rank file, which goes to the executors in a
    broadcast of its fixed size. Null and empty texts have no tokens. Without
    ``with_ids`` the SHA-256 of both come instead, as ``ids_sha256`` and
    ``decoded_sha256``. Texts of any length are encoded whole; repeated rows, and
    rows without an id, are encoded like any other. An empty table gives no rows,
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    output = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), *([("ids", pa.binary()), ("decoded", pa.binary())] if with_ids else [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    coded = bpe.encode_bytes(text)
                    back = bpe.decode(np.frombuffer(coded, "<u4").tolist())
                    counts.append(len(coded) // 4)
                    ids.append(coded if with_ids else hashlib.sha256(coded).hexdigest())
                    decoded.append(back if with_ids else hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(ids, output.field(2).type), pa.array(decoded, output.field(3).type)], schema=output)

    kind = "id long, n_tokens long, " + ("ids binary, decoded binary" if with_ids else "ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_column).cast("long").alias("id"), filled(text_column).alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_column)
