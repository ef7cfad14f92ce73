"""Token ids of whole texts by encoding each distinct chunk once for a slice of texts.

The two public vocabularies used here never merge across the start of a word. A text is therefore cut
into chunks at spaces (and, for the byte-level vocabulary, before line ends); Arrow numbers the distinct
chunks of a slice; only those go through the encoder, and NumPy puts the ids back together. Texts in
which white space could be cut wrongly (runs of it, rare kinds) or that hold a special token's string are
found first and go through the whole-text encoder, so the ids always equal those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RARE_WHITE = r"[\x00\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
ODD_BYTE_LEVEL = r"  | \n|\n |\n\n\n|\n\n\z|<\||" + RARE_WHITE
ODD_WORDS = r"<\||" + RARE_WHITE
TABLE_LIMIT = 1_500_000
AT_ONCE = 10_000
BOUND, NOTHING = pa.scalar("\x01", pa.large_string()), pa.scalar("", pa.large_string())
#: Letters that every Unicode version, and both regex engines, agree on.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


class Chunks:
    """encode(texts) -> (ids, ends): ids of all texts in a row, and where each text's ids end.

    encode_chunks gives the ids of each of some chunks, encode_text those of a whole text. With words,
    white space has no ids; else it is part of what follows it. Chunks met before are kept, up to
    TABLE_LIMIT; when they are dropped, they are only encoded again."""

    def __init__(
        self, encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], list[int]], words: bool
    ):
        self.encode_chunks, self.encode_text, self.words = encode_chunks, encode_text, words
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)  # ends[i + 1]: where the ids of chunk i end

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk; chunks that are new get the next ones."""
        got = pc.index_in(chunks, value_set=self.known)
        if got.null_count:
            fresh = pc.unique(chunks.filter(got.is_null()))
            ids, counts = self.encode_chunks(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            missing = got.is_null()
            own = pc.add(pc.index_in(chunks.filter(missing), value_set=fresh), pa.scalar(len(self.known) - len(fresh), pa.int32()))
            got = pc.replace_with_mask(got, missing, own)
        return got.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD_WORDS if self.words else ODD_BYTE_LEVEL)
        if not pc.any(odd).as_py():
            return self.plain(texts)
        is_odd = odd.to_numpy(zero_copy_only=False)
        ids, ends = self.plain(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
        counts, parts, at = np.diff(ends, prepend=0), [], 0
        for i in np.flatnonzero(is_odd):
            own = np.asarray(self.encode_text(texts[i].as_py()), np.uint32)
            parts += [ids[at : ends[i]], own]
            at, counts[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[at:]]), np.cumsum(counts)

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > TABLE_LIMIT:
            self.forget()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.words:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            chunks = lists.flatten()
        else:  # a first chunk has no space before it: it is marked by \x01, and \x01 itself goes as odd
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(BOUND, texts, NOTHING), "\n", " \n"), " ")
            chunks = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        chunk = self.numbers(chunks)
        first = self.ends[:-1][chunk]
        lengths = (self.ends[1:] - self.ends[:-1])[chunk]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first - upto[:-1], lengths)
        at += np.arange(upto[-1])
        return self.flat[at], upto[offsets[1:] - offsets[0]]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def spelled(piece: str, letters: dict[int, str] = byte_letters()) -> str:
    return "".join([letters[b] for b in piece.encode()])


def _joined(model, spell: dict[int, str], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, each on its own, by the library's model in a few calls, and the piece of each id."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(model)
    alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\x00")
    ids, of = [], []
    for at in range(0, len(pieces), AT_ONCE):
        text = "\x00".join(pieces[at : at + AT_ONCE]).encode().decode("latin-1").translate(spell)
        got = alone.encode(text, add_special_tokens=False)
        ids.append(np.array(got.ids, np.int64))
        of.append(np.array(got.word_ids, np.int64) + at)
    return np.concatenate(ids), np.concatenate(of)


def library_encoder(path: str, words: bool) -> Chunks:
    """Ids of a vocabulary of the tokenizers library: byte-level, or of lower-case words. A letter run,
    with or without a mark at its end, goes straight to the library's model, many at a time; any other
    chunk goes through the whole of the library."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    spell = {b: c for b, c in byte_letters().items() if b}

    def whole(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        owner: list[int] = []
        others: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            lead = text[:1]
            body = text[1:] if lead in ("\n", "\x01") and not words else text
            got = PLAIN.fullmatch(body)
            if got is None:
                body = body if words or lead == "\x01" else text if lead == "\n" else " " + text
                others[i] = whole(body) if body else []
                continue
            if words:
                own = [got[1].lower()]
            elif lead == "\n":
                own = ["\n", got[1]]
            else:
                own = [got[1] if lead == "\x01" else " " + got[1]]
            own += [got[2]] if got[2] else []
            pieces += own
            owner += [i] * len(own)
        ids, piece = _joined(tok.model, spell, pieces) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of = np.array(owner, np.int64)[piece] if pieces else piece
        if others:
            ids = np.concatenate([ids, *(np.array(x, np.int64) for x in others.values())])
            of = np.concatenate([of, np.repeat(np.array(list(others), np.int64), [len(x) for x in others.values()])])
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        return ids, np.bincount(of, minlength=len(texts))

    return Chunks(chunks, whole, words)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes of text: large ones are cut, and small ones put together, so that the
    chunks of many texts are numbered at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        lengths = pc.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy()
        at = 0
        upto = np.cumsum(lengths)
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + limit - size, side="right")))
            part = b.slice(at, end - at)
            held.append(part)
            size += int(upto[end - 1]) - before
            at = end
            if size >= limit or at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
