"""Subword ids by the tokenizers library, with a memo of what it returned for recurring pieces.

A byte-level BPE tokenizer encodes each pre-token alone, so ids are a function of the pre-token.
A space between two characters that aren't white space always starts a new pre-token, and so does
a line feed there; texts are split at these places, and the library's model is called once for each new piece.
Where a text has any other white space, or a piece has letters past Latin, the whole text or
piece goes through the library's full encoder.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import Memo

#: The pre-token pattern of byte-level BPE.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed rule of byte-level BPE: printable bytes stand for themselves, others for U+0100 and up.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_PRINTABLE)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(_REST)}
#: What characters to U+024F stand as in pieces; marks that are a pre-token of their own after letters.
_LATIN = {c: "".join(chr(BYTE_CHARS[b]) for b in chr(c).encode()) for c in range(0x250)}
_MARKS = frozenset(".,;:!?")
#: ASCII that is neither letter, digit nor the apostrophe of contractions: in a row a pre-token of its own.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Words that plain() takes, for Arrow.
_PLAIN = r"^([!-&(-~]+|[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[!-&(-/:-@\[-`{-~]*)$"
#: Chunks of a memo's generation: some 160 bytes each.
MEMO = 200_000
#: Characters of texts whose distinct chunks are encoded together, and chunks put in their places at a time; each at most one text over.
TOGETHER, PLACED = 16_000_000, 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _first_end(text: str) -> int:
    """Where a text's first chunk ends."""
    space = text.find(" ")
    space = len(text) if space < 0 else space
    line = text.find("\n", 0, space)
    return space if line < 0 else line


class SubwordEncoder:
    """encode(text) gives the library's ids (add_special_tokens=False; the strings of special
    tokens are ordinary text) as little-endian unsigned 16-bit bytes. memo_limit bounds memory,
    not results."""

    def __init__(self, path: str | None = None, memo_limit: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.tokenizer.encode_special_tokens = True
        self.n_ids = self.tokenizer.get_vocab_size()
        if self.n_ids > 1 << 16:
            raise ValueError("ids over 65535")
        self.begins = np.zeros(self.n_ids, dtype=bool)  # ids that begin with a space
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.by_model = self.tokenizer.model.tokenize
        self.marks = {m: self._piece(m) for m in _MARKS}
        self.line = self._piece("\n")
        self.chunks = Memo(self._chunk, memo_limit)

    @staticmethod
    def plain(word: str) -> bool:
        """Whether a word is printable ASCII without apostrophes, or letters to U+024F and ASCII signs after them at most: words
        that plain_ids takes, as no id of the vocabulary goes from letters to digits or signs or back."""
        if word.isalpha():
            return word.isascii() or max(word) <= "\u024f"
        if word.isascii():
            return word.isprintable() and word != "" and "'" not in word and " " not in word
        body = word.rstrip(_SIGNS)
        return body.isalpha() and max(body) <= "\u024f"

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in a row, each with a space before it, and how many each has.

        No id of the vocabulary goes past the end of a pre-token, so the model may take many in one string:
        a word's first id is the next that begins with a space."""
        return self._joined_ids(" ".join(words[s : s + 32]) for s in range(0, len(words), 32))

    def _joined_ids(self, lines: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        out = array("H")
        for line in lines:
            out.extend([t.id for t in self.by_model((" " + line).translate(_LATIN))])
        ids = np.frombuffer(out.tobytes(), dtype="<u2")
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def chunk_ids(self, words: pa.Array, one: Callable[[str], bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, or of chunks as encode() cuts them, in a row, and how many each has: plain ones many at a call, others by one(); -1 where that gives None."""
        plain = pc.match_substring_regex(words, _PLAIN)
        many = words.filter(plain)
        starts = pa.array([*range(0, len(many), 32), len(many)], pa.int64())
        own, lens = self._joined_ids(pc.binary_join(pa.LargeListArray.from_arrays(starts, many), pa.scalar(" ", many.type)).to_pylist()) if len(many) else (np.empty(0, "<u2"), np.empty(0, np.int64))
        is_plain = plain.to_numpy(zero_copy_only=False)
        if is_plain.all():
            return own, lens
        rest = [one(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        sizes = np.empty(len(words), dtype=np.int64)
        sizes[is_plain], sizes[~is_plain] = lens, [-1 if x is None else len(x) // 2 for x in rest]
        held = np.maximum(sizes, 0)
        out, where = np.empty(int(held.sum()), dtype="<u2"), np.repeat(is_plain, held)
        out[where], out[~where] = own, np.frombuffer(b"".join(x for x in rest if x is not None), dtype="<u2")
        return out, sizes

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2").tobytes()

    def _ids(self, mapped: str) -> bytes:
        return array("H", [t.id for t in self.by_model(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token of characters to U+024F."""
        return self._ids(piece.translate(_LATIN))

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk with the space before it, or its line feed; of a text's first chunk, marked by a space, as it
        is. None: not to be encoded alone."""
        if chunk.isalpha():
            if chunk.isascii():
                return self._ids("\u0120" + chunk)
            if max(chunk) <= "\u024f":
                return self._ids("\u0120" + chunk.translate(_LATIN))
        first, lined = chunk[:1] == " ", chunk[:1] == "\n"
        if not first:
            body = chunk[1:] if lined else chunk
            if lined and body.isalpha() and max(body) <= "\u024f":
                return self.line + self._piece(body)
            if body[-1:] in _MARKS and body[:-1].isalpha() and max(body) <= "\u024f":
                return self.chunks[chunk[:-1]] + self.marks[chunk[-1]]
        body = chunk[1:] if first or lined else chunk
        if not body:
            return None
        whole = body if first else f"\n{body}" if lined else f" {body}"
        if not body.replace("\n", "").isprintable() or body[0] == "\n" or body[-1] == "\n":
            return None
        if max(body) > "\u024f":
            return self.full(whole)
        return b"".join(map(self._piece, PRETOKEN.findall(whole)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] != "\n":
            chunks = text.replace("\n", " \n").split(" ")
            chunks[0] = " " + chunks[0]
            try:
                return b"".join(map(self.chunks.__getitem__, chunks))
            except TypeError:  # a chunk that can't be encoded alone
                pass
        return self.full(text)

    def encode_all(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, text) to (key, encode(text)), in order: each distinct chunk of a stretch of texts is encoded once."""
        keys, texts, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from zip(keys, self._together(texts))
                keys, texts, size = [], [], 0
        yield from zip(keys, self._together(texts))

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        alone = [bool(t) and t[0] != "\n" for t in texts]  # has a first chunk
        lists = pc.split_pattern(pc.replace_substring(pa.array([t for t, a in zip(texts, alone) if a], pa.large_string()), "\n", " \n"), " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        listed = lists.flatten().dictionary_encode()
        del lists
        numbers, words = listed.indices.to_numpy(), listed.dictionary
        del listed
        sub, sizes = self.chunk_ids(words, self._chunk)
        del words
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        done, at, left = iter(()), 0, 0
        for text, a in zip(texts, alone):
            if not a:
                yield self.full(text) if text else b""
                continue
            if not left:  # the next texts' chunks in their places
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PLACED)))
                left = min(end, len(offsets) - 1) - at
                done = self._placed(numbers, offsets[at : at + left + 1], sub, sizes, starts)
                at += left
            left -= 1
            rest = next(done)
            first = self.chunks[" " + text[: _first_end(text)]] if rest is not None else None
            yield self.full(text) if first is None else first + rest

    @staticmethod
    def _placed(numbers, offsets, sub, sizes, starts) -> Iterator[bytes | None]:
        """Ids of texts without their first chunks; None: one of the others can't be encoded alone."""
        mine = numbers[offsets[0] : offsets[-1]]
        size = sizes[mine]
        size[offsets[:-1] - offsets[0]] = 0
        bad = np.concatenate([[0], np.cumsum(size < 0)])[offsets - offsets[0]]
        size = np.maximum(size, 0)
        total = np.concatenate([[0], np.cumsum(size)])
        data = sub[np.arange(total[-1]) + np.repeat(starts[mine] - total[:-1], size)].tobytes()
        ends = 2 * total[offsets - offsets[0]]
        for a, z, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), bad[:-1].tolist(), bad[1:].tolist()):
            yield data[a:z] if x == y else None

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype="<u2")


_ENCODERS: dict = {}


def encoder(path: str | None = None) -> SubwordEncoder:
    """One encoder per Python worker and file, so that its memo serves all tasks of that worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SubwordEncoder(path)
    return _ENCODERS[path]
