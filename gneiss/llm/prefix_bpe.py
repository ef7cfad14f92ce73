"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token with which the encoding of that prefix ends. It
is the token that is a suffix of the prefix, and that stays apart from the last token of what precedes
it: two tokens stay apart if undoing their merges step by step along the seam, latest merge first, never
meets a pair that would have merged earlier. Storing only that last token for each prefix gives the
encoding of any prefix by walking back, makes appending exact and local, and lets an edit keep all
prefixes before it.

`PieceTable` is that array for one piece. `Codec` encodes and decodes whole texts, piece by piece of a
pattern, as the tiktoken library would without special tokens; distinct chunks of a slice of texts are
encoded once (see chunks.py).

Results for odd input: null is the empty text, which has no ids; rows repeat their own results; an empty
table stays empty; a piece of any length takes time in proportion to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import PLAIN, Chunks, text_slices
from .common import small_batches

#: White space of the pattern, spelled out: engines differ in what \s holds.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks (which are the ids), with what the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        #: Every suffix of a token -> the token that it is itself, or -1: tells when longer tokens can't end here.
        self.suffixes = dict.fromkeys((t[i:] for t in ranks for i in range(len(t))), -1)
        self.suffixes |= {t: r for t, r in ranks.items() if self.reachable(r)}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that no merge makes."""
        if token not in self._halves:
            parts = self._merged(self.tokens[token], token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Ids of data by merges of a rank under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            got = self._apart[key] = self._seam_holds(left, right)
        return got

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill last, which holds the tokens of the first len(last) prefixes, for the other prefixes."""
        suffixes, known, apart = self.suffixes, self._apart.get, self.apart
        for end in range(len(last) + 1, len(data) + 1):
            ending = []  # (start, token) of tokens that end here, from the shortest on
            start = end - 1
            while start >= 0:
                token = suffixes.get(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    ending.append((start, token))
                start -= 1
            for start, token in reversed(ending):
                if not start:
                    last.append(token)
                    break
                before = last[start - 1]
                holds = known(before << 32 | token)
                if holds is None:
                    holds = apart(before, token)
                if holds:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def _seam_holds(self, left: int, right: int) -> bool:
        """Go back in time: at each step the later of the two merges at the seam is undone. A pair that
        meets before the next undone merge, with a lower rank, would have merged across the seam."""
        until = len(self.tokens)  # merges of a lower rank than this happen while the two are neighbours
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and joint < until:
                return False
            # Equal ranks merge from the left, so the left one's merge comes first on a tie.
            undo_left, undo_right = self.halves(left), self.halves(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                until, left = left, undo_left[1]
            else:
                until, right = right + 1, undo_right[0]


class PieceTable:
    """last[i]: the token that ends the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def truncate(self, size: int) -> None:
        self.data, self.last = self.data[:size], self.last[:size]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put new in the place of bytes start to end; prefixes before start keep their tokens."""
        rest = new + self.data[end:]
        self.truncate(start)
        self.append(rest)

    def ids(self, size: int | None = None) -> list[int]:
        """The encoding of the first `size` bytes."""
        at, out, tokens = len(self.data) if size is None else size, [], self.vocabulary.tokens
        while at:
            out.append(self.last[at - 1])
            at -= len(tokens[out[-1]])
        return out[::-1]


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.short: dict[str, list[int]] = {}
        self.chunks = Chunks(self._chunks, self.encode, words=False)
        self.decimal = self._spread([b" %d" % i for i in range(len(self.vocabulary.tokens))])
        self.bytes = self._spread(self.vocabulary.tokens)

    @staticmethod
    def _spread(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths

    def piece(self, piece: str) -> list[int]:
        return PieceTable(self.vocabulary, piece.encode()).ids()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self._kept(p)]

    def _kept(self, piece: str) -> list[int]:
        got = self.short.get(piece)
        if got is None:
            if len(self.short) > 50_000:
                self.short.clear()
            got = self.short[piece] = self.piece(piece)
        return got

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for text in texts:
            lead = text[:1]
            if lead == "\x01":
                text = text[1:]
            elif lead != "\n":
                text = " " + text
            got = PLAIN.fullmatch(text, 1 if lead != "\x01" else 0)
            if got is None:
                own = self.encode(text)
            else:
                own = self._kept("\n") + self.piece(got[1]) if lead == "\n" else self.piece(text[: got.end(1)])
                if got[2]:
                    own = own + self._kept(got[2])
            ids += own
            counts.append(len(own))
        return np.array(ids, np.int64), np.array(counts, np.int64)

    @staticmethod
    def _laid(spread: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The parts of ids in a row, and where each ends."""
        flat, starts, lengths = spread
        n = lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(starts[ids] - ends + n, n)
        at += np.arange(len(at))
        return flat[at].tobytes(), ends

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, sha256 of the ids in decimal, sha256 of the bytes that the ids decode to)."""
        ids, ends = self.chunks.encode(texts)
        step, at = 1 << 20, 0
        bounds = ends.tolist()
        i = 0
        while i < len(bounds):
            j = max(i + 1, int(np.searchsorted(ends, at + step, side="right")))
            own = ids[at : bounds[j - 1]].astype(np.int64)
            written, upto = self._laid(self.decimal, own)
            decoded, upto_bytes = self._laid(self.bytes, own)
            a = b = 0
            before = at
            for k in range(i, j):
                n = bounds[k] - before
                last = bounds[k] - at - 1
                to, to_bytes = (int(upto[last]), int(upto_bytes[last])) if n else (a, b)
                yield n, hashlib.sha256(written[a + 1 : to]).hexdigest(), hashlib.sha256(decoded[b:to_bytes]).hexdigest()
                a, b, before = to, to_bytes, bounds[k]
            i, at = j, bounds[j - 1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.vocabulary.tokens[i] for i in ids])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in text_slices(batches, "text"):
            got = list(c.digests(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
