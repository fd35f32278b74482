"""Token ids by chunks of text, with a bounded memory of the chunks met before.

A pre-token is encoded without regard to its neighbours, so a text can be cut
at any border between pre-tokens and each chunk encoded alone. Chunks repeat
far more than texts do: each worker keeps their packed ids in two generations
(the older one goes when the younger is full), and only a chunk that is in
neither is encoded. Texts whose cuts could be doubtful are encoded whole. A column
of texts is cut and put together by Arrow, and each of its distinct words is looked up once.
"""

from __future__ import annotations

import functools
import json
import re
import weakref
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in one generation of an encoder's memory; an entry takes about 200 bytes.
GENERATION = 300_000
#: Longer chunks are encoded each time and not kept.
LONGEST_KEPT = 64
#: Characters that str.split() takes for white space and the tokenizer files do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: ASCII marks that never join a pre-token of letters (the apostrophe may); a run of them is one pre-token.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


#: Byte-level BPE writes bytes as characters: printable ones as themselves, the rest from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PLAIN]
BYTE_CHARS = str.maketrans({b: chr(256 + i) for i, b in enumerate(_REST)})
SPACE_CHAR = " ".translate(BYTE_CHARS)
CHAR_OF_BYTE = [chr(b).translate(BYTE_CHARS) for b in range(256)]


#: Fixed value: the pre-tokens of ASCII texts under the byte-level pattern.
ASCII_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall


class Whole(Exception):
    """The text cannot be cut safely; encode it as a whole."""


class Memory(dict):
    """chunk -> what ``encode`` makes of it; two generations of at most ``size`` chunks each."""

    live: list[weakref.ref] = []

    def __init__(self, encode, size: int = GENERATION):
        self.encode, self.size, self.old = encode, size, {}
        Memory.live.append(weakref.ref(self))

    def forget(self) -> None:
        self.old = {}
        self.clear()

    @classmethod
    def only(cls, *used: Memory) -> None:
        """Empty all memories of this process but those in use: stages that share workers do not add up."""
        alive = [m for r in cls.live if (m := r()) is not None]
        for m in alive:
            if not any(m is u for u in used):
                m.forget()
        cls.live = [weakref.ref(m) for m in alive]

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self.keep(chunk, found)
        return found

    def keep(self, chunk: str, found) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = found


class Words(Memory):
    """A memory that puts a word with marks behind it together from both, and keeps the word alone."""

    def __init__(self, encode, marks: Memory | None, size: int = GENERATION):
        super().__init__(encode, size)
        self.marks = self if marks is None else marks

    def __missing__(self, chunk: str):
        word = chunk.rstrip(MARKS)
        if len(word) < len(chunk) and word.isalpha():
            return self[word] + self.marks[chunk[len(word) :]]
        return super().__missing__(chunk)


class Chunks:
    """Cuts texts for pre-token patterns of letters, digits and marks with, at most, one space before.

    A subclass gives ``letters(word, space)``, the packed ids of one such
    pre-token, and ``whole(text)``, those of any text.
    """

    def __init__(self, size: int = GENERATION):
        self.bare = Words(self._bare, None, size)
        self.spaced = Words(self._spaced, self.bare, size)

    def _bare(self, chunk: str) -> bytes:
        return self.letters(chunk, "") if chunk.isalpha() else self.whole(chunk)

    def _spaced(self, chunk: str) -> bytes:
        """A chunk that follows one space and so begins a pre-token with it."""
        if chunk.isalpha():
            return self.letters(chunk, " ")
        if not chunk or chunk[0].isspace() or chunk[0] == "᠎":
            raise Whole
        return self.whole(" " + chunk)

    def spaces_dropped(self, text: str) -> bytes:
        """Packed ids where white space separates pre-tokens and yields no ids."""
        if any(c in text for c in SEPARATORS):
            return self.whole(text)
        return b"".join(map(self.bare.__getitem__, text.split()))

    def spaces_kept(self, text: str) -> bytes:
        """Packed ids where a space before a character that is not white space begins a pre-token."""
        first, *rest = text.split(" ")
        try:
            return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        except Whole:
            return self.whole(text)

    def column_spaces_kept(self, texts: pa.Array) -> list[bytes]:
        """``spaces_kept`` of every text of a column without nulls."""
        lists = pc.split_pattern(texts, " ")
        starts, chunks = np.asarray(lists.offsets), lists.values
        is_first = np.zeros(len(chunks), bool)
        is_first[starts[:-1]] = True
        behind = np.flatnonzero(~is_first).astype(np.int32)
        coded = chunks.take(pa.array(behind)).dictionary_encode()
        distinct, of_chunk = coded.dictionary, np.asarray(coded.indices)
        # a distinct chunk is two entries of a pool: a word with its space, and the marks behind it, or else itself
        trimmed = pc.utf8_rtrim(distinct, characters=MARKS)
        words = trimmed.dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.spaced.get, names))
        for k, (word, value) in enumerate(zip(names, found, strict=True)):
            if not word.isalpha():
                found[k] = None
            elif value is None:
                found[k] = self._new_word(word)
        pool = [b"", *(v or b"" for v in found)]
        heads = np.asarray(words.indices) + 1
        tails, doubtful = np.zeros_like(heads), np.zeros(len(heads), bool)
        is_word = np.asarray([v is not None for v in found], bool)[heads - 1]
        marked = np.asarray(pc.less(pc.binary_length(trimmed), pc.binary_length(distinct)))
        at_marks: dict[str, int] = {}
        for k, chunk in _those(distinct, is_word & marked):
            marks = chunk[len(chunk.rstrip(MARKS)) :]
            if marks not in at_marks:
                at_marks[marks] = len(pool)
                pool.append(self.bare[marks])
            tails[k] = at_marks[marks]
        for k, chunk in _those(distinct, ~is_word):
            try:
                pool.append(self._lines(chunk) if "\n" in chunk else self.spaced[chunk])
                heads[k] = len(pool) - 1
            except Whole:
                doubtful[k] = True
        pairs = np.zeros((len(chunks), 2), np.int32)
        pairs[behind, 0], pairs[behind, 1] = heads[of_chunk], tails[of_chunk]
        pairs[starts[:-1], 0] = len(pool) + np.arange(len(texts))
        pool += [self.bare[c] if c else b"" for _, c in _those(chunks, is_first)]
        joined = pa.array(pool, pa.large_binary()).take(pa.array(pairs.ravel()))
        _, offsets, data = joined.buffers()
        data = b"" if data is None else memoryview(data)
        ends = np.frombuffer(offsets, np.int64)[2 * starts.astype(np.int64)].tolist()
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for row in np.unique(np.searchsorted(starts, behind[doubtful[of_chunk]], "right") - 1).tolist():
            out[row] = self.whole(texts[row].as_py())
        return out

    def _new_word(self, word: str) -> bytes:
        """What ``spaced`` holds of a word of letters that is not in its younger generation."""
        found = self.spaced.old.get(word)
        if found is None:
            found = self.letters(word, " ")
        if len(word) <= LONGEST_KEPT:
            self.spaced.keep(word, found)
        return found

    def _lines(self, chunk: str) -> bytes:
        """A chunk behind a space: a line break between characters that are not white space is a pre-token."""
        first, *rest = lines = chunk.split("\n")
        if not all(lines) or any(c.isspace() or c == "᠎" for x in lines for c in (x[0], x[-1])):
            return self.spaced[chunk]
        return self.bare["\n"].join([self.spaced[first], *map(self.bare.__getitem__, rest)])


def _those(strings: pa.Array, chosen: np.ndarray):
    """``(place, string)`` of the chosen ones."""
    places = np.flatnonzero(chosen)
    return zip(places.tolist(), strings.take(pa.array(places)).to_numpy(zero_copy_only=False), strict=True)


class Encoder(Chunks):
    """``packed(text)``: ids by the tokenizers library as little-endian ``dtype`` integers; ``packed_column`` of many texts.

    An unknown run of letters, which is one pre-token, goes to the library's BPE
    model alone, as do the pre-tokens of ASCII chunks under the byte-level pattern;
    any other unknown chunk goes to its full encoding. The strings of special tokens
    are ordinary text, as the tokenizer files' description sets the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.model = self.library.model
        self.normalize = self.library.normalizer.normalize_str if spec.get("normalizer") else None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not self.normalize:
            self.packed = self.spaces_kept
            self.pre_tokens = Memory(self._pre_token, GENERATION // 4)
        elif pre.get("type") == "Sequence" and any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in pre["pretokenizers"]):
            self.packed = self.spaces_dropped
        else:
            self.packed = self.whole

    def packed_column(self, texts: pa.Array) -> list[bytes]:
        """``packed`` of every text of a column without nulls."""
        if self.packed == self.spaces_kept:
            return self.column_spaces_kept(texts)
        return [self.packed(text) for text in texts.to_pylist()]

    def whole(self, text: str) -> bytes:
        """The library's ids of a text, where it is not cut into known pre-tokens in one go."""
        if self.packed == self.spaces_kept and len(text) <= LONGEST_KEPT and text.isascii() and not any(c in text for c in SEPARATORS):
            return b"".join(map(self.pre_tokens.__getitem__, ASCII_PRE_TOKENS(text)))
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def letters(self, word: str, space: str) -> bytes:
        if self.normalize:
            lower = word.lower() if word.isascii() else self.normalize(word)
            if not lower.isalpha():
                return self.whole(word)
            if lower != word:
                return self.bare[lower]
        if word.isascii():
            return self._modelled(SPACE_CHAR + word if space else word)
        return self._pre_token(space + word)

    def _pre_token(self, pre_token: str) -> bytes:
        return self._modelled("".join(map(CHAR_OF_BYTE.__getitem__, pre_token.encode())))

    def _modelled(self, symbols: str) -> bytes:
        """Ids by the BPE model of a pre-token whose bytes are written as characters."""
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    found = _encoder(path)
    Memory.only(found.bare, found.spaced, getattr(found, "pre_tokens", found.bare))
    return found
