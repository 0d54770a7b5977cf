"""A byte-level tokenizer over whole texts, with words remembered between texts.

The library's pre-tokenizer splits a text by a fixed pattern and encodes each match by itself, so equal words may
share their result. For texts of Latin letters and common signs, whose classes all Unicode versions agree on, the
split is made here, on the bytes of all texts of a block at once, and each different word goes to the library's model
once. Words of up to 16 bytes are remembered in a hash table of their bytes, which a block looks up all together. Other
texts go through the library whole.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

from lodestar.llm.kernels import _KEEP, mix, string_buffer

# The pattern of the library's byte-level pre-tokenizer, and the characters that stand for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Texts of these characters are split by ranges that say the same as the pattern's classes, which is faster.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\u00a1-\u024f]*")
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\x09-\x0d "
_PLAIN_WORDS = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_characters() -> str:
    """The character for each byte: itself if printable, else the next one from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if b in PRINTABLE:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return "".join(out)


def plain_words(text: str) -> list[str] | None:
    """The matches of PATTERN in a text of plain characters; None for other texts."""
    return _PLAIN_WORDS.findall(text) if _PLAIN.fullmatch(text) else None


_LETTER, _DIGIT, _SPACE, _SIGN = 1, 2, 3, 4


def _character_classes() -> np.ndarray:
    """The class of each character below U+0250; 0 for those that aren't plain."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        x = chr(c)
        if _PLAIN.fullmatch(x):
            out[c] = next((k for k, p in ((_LETTER, _L), (_DIGIT, _N), (_SPACE, _S)) if re.match(f"[{p}]", x)), _SIGN)
    return out


_CLASSES = _character_classes()
#: The class of a byte that is a character by itself.
_BYTE_CLASSES = np.concatenate((_CLASSES[:128], np.zeros(128, np.uint8)))
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[list(b"stmd")] = True


def word_starts(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a match of PATTERN starts at each byte of the rows, and which rows hold plain characters only."""
    n = len(raw)
    kind = _BYTE_CLASSES[raw]
    lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
    if len(lead):
        after = raw[np.minimum(lead + 1, n - 1)].astype(np.int64)
        code = (raw[lead].astype(np.int64) & 0x1F) << 6 | after & 0x3F
        found = np.where((after & 0xC0 == 0x80) & (code < 0x250), _CLASSES[np.minimum(code, 0x24F)], 0)
        kind[lead] = found
        kind[np.minimum(lead + 1, n - 1)] = found
    plain = np.ones(len(rows) - 1, bool)
    plain[np.searchsorted(rows, np.flatnonzero(kind == 0), side="right") - 1] = False
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    edges = rows[:-1][rows[:-1] < n]
    start[edges] = True
    first = np.zeros(n + 1, bool)  # of a row
    first[rows] = True
    # white space before something else gives up its last character, a blank joins what follows
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
    start[last] = True
    start[last[raw[last] == 0x20] + 1] = False
    # an apostrophe that starts a match takes the ending of a contraction
    mark = np.flatnonzero((raw[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER) & ~first[1:n])
    if len(mark):
        one, two = raw[mark + 1], raw[np.minimum(mark + 2, n - 1)]
        inside = (mark + 2 < n) & ~first[np.minimum(mark + 2, n)]
        pair = inside & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        for taken, size in ((mark[_CONTRACTED[one]], 2), (mark[pair], 3)):
            start[taken + 1] = False
            rest = taken + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == _LETTER)]] = True
    return start, plain


class WordTable:
    """An open-addressed hash table from words of up to 16 bytes to their numbers, looked up many at a time."""

    def __init__(self, bits: int = 20):
        self._bits = bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self._bits
        self._low, self._high, self._number = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.used = 0

    @property
    def full(self) -> bool:
        return 2 * self.used > len(self._number)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + np.uint64(1))) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word; -1 for words that aren't there."""
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int32)
        todo = np.arange(len(low))
        while len(todo):
            number = self._number[slot]
            same = (self._low[slot] == low) & (self._high[slot] == high) & (number >= 0)
            out[todo[same]] = number[same]
            more = ~same & (number >= 0)
            todo, low, high, slot = todo[more], low[more], high[more], (slot[more] + 1) & (len(self._number) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Words that aren't there yet, each once."""
        for slot, a, b, x in zip(self._slots(low, high).tolist(), low, high, number.tolist(), strict=True):
            while self._number[slot] >= 0:
                slot = (slot + 1) & (len(self._number) - 1)
            self._low[slot], self._high[slot], self._number[slot] = a, b, x
        self.used += len(low)


class WordEncoder:
    """Ids of texts whose words are encoded by themselves, each different word once as long as it is remembered."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self._table = WordTable()
        self.forget()

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _encode_others(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that hold other than plain characters."""
        raise NotImplementedError

    def _splits(self) -> bool:
        """Whether PATTERN says what a word is."""
        return True

    def _whole_texts(self, raw: np.ndarray) -> np.ndarray:
        """Places in the buffer whose texts aren't to be split by PATTERN."""
        return np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drops the words remembered, once they are as many as the table holds well."""
        if self._table.used:
            self._table.clear()
        self._longer: dict[bytes, int] = {}
        self._ids, self._begin, self._count = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._n_ids = self._n_words = 0

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers for words that aren't known yet."""
        first, new = self._n_words, self._encode_words(words)
        count = np.fromiter(map(len, new), np.int64, len(new))
        end = np.cumsum(count)
        n_ids, n_words = self._n_ids + int(count.sum()), first + len(new)
        while n_ids > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        while n_words > len(self._begin):
            self._begin, self._count = (np.concatenate((x, np.zeros_like(x))) for x in (self._begin, self._count))
        self._ids[self._n_ids : n_ids] = np.fromiter(chain.from_iterable(new), self.dtype, n_ids - self._n_ids)
        self._begin[first:n_words], self._count[first:n_words] = self._n_ids + end - count, count
        self._n_ids, self._n_words = n_ids, n_words
        return np.arange(first, n_words, dtype=np.int32)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word."""
        size = ends - starts
        eight = np.ndarray((len(raw) + 9,), "<u8", np.concatenate((raw, np.zeros(16, np.uint8))), strides=(1,))
        low = eight[starts] & _KEEP[np.minimum(size, 8)]
        high = eight[np.minimum(starts + 8, len(raw))] & _KEEP[np.clip(size - 8, 0, 8)]
        out = self._table.find(low, high)
        longer = size > 16
        new = np.flatnonzero((out < 0) & ~longer)
        if len(new):
            pairs = np.stack((low[new], high[new]), axis=1)
            _, at, back = np.unique(mix(pairs[:, 0] ^ mix(pairs[:, 1] + np.uint64(1))), return_index=True, return_inverse=True)
            if (pairs[at][back] != pairs).any():  # two words of one hash: told apart by their bytes
                _, at, back = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
            at = new[at]
            whole = raw.tobytes()
            numbers = self._learn([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self._table.add(low[at], high[at], numbers)
            out[new] = numbers[back.reshape(-1)]
        long = np.flatnonzero(longer).tolist()
        out[long] = self.numbers_of([raw[starts[i] : ends[i]].tobytes() for i in long])
        return out

    def numbers_of(self, words: list[bytes]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self._longer]
        self._longer.update(zip(new, self._learn(new).tolist(), strict=True))
        return [self._longer[w] for w in words]

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and after how many ids each word ends."""
        count = self._count[number]
        end = np.cumsum(count)
        return self._ids[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self._begin[number] - end + count, count)], end

    def encode_rows(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column; a null text has none."""
        if self._table.full or len(self._longer) > 200_000:
            self.forget()
        raw, rows = string_buffer(column)
        n = len(rows) - 1
        out: list = [np.zeros(0, self.dtype)] * n
        plain = np.zeros(n, bool)
        if self._splits() and len(raw):
            start, plain = word_starts(raw, rows)
            plain[np.searchsorted(rows, self._whole_texts(raw), side="right") - 1] = False
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(raw))
            row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, rows)))
            if not plain.all():
                keep = plain[row]
                starts, ends, row = starts[keep], ends[keep], row[keep]
            ids, end = self.ids_of(self._numbers(raw, starts, ends))
            bounds = np.append(0, end)[np.searchsorted(row, np.arange(n + 1))].tolist()
            out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        others = np.flatnonzero(~plain & (np.diff(rows) > 0)).tolist()
        texts = [raw[rows[i] : rows[i + 1]].tobytes().decode() for i in others]
        for i, x in zip(others, self._encode_others(texts) if others else [], strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        return [x.tobytes() for x in self.encode_rows(pa.array(texts, pa.string()))]


class LibraryTokenizer(WordEncoder):
    """Token ids of the tokenizers library as little-endian integers of 2 or 4 bytes.

    A special token's string in a text becomes that token, as in the library; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [t.content.encode() for t in added if not (special_as_text and t.special)]
        super().__init__("<u2" if self._tokenizer.get_vocab_size() <= 65536 else "<u4")
        splitter = self._tokenizer.pre_tokenizer
        byte_level = isinstance(splitter, pre_tokenizers.ByteLevel) and splitter.use_regex and not splitter.add_prefix_space
        self._by_words = byte_level and self._tokenizer.normalizer is None
        self._characters = byte_characters()

    def _splits(self) -> bool:
        return self._by_words

    def _whole_texts(self, raw: np.ndarray) -> np.ndarray:
        text, found = raw.tobytes(), []
        for token in self._added:
            at = text.find(token)
            while at >= 0:
                found.append(at)
                at = text.find(token, at + 1)
        return np.array(found, np.int64)

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        tokenize = self._tokenizer.model.tokenize
        # a byte is one character, so the words' bounds are those of their bytes
        text, ends = b"".join(words).decode("latin-1").translate(self._characters), list(accumulate(map(len, words)))
        return [[t.id for t in tokenize(text[a:b])] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_others(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_loaded: dict = {}


def library_tokenizer(path: str, special_as_text: bool = False) -> LibraryTokenizer:
    """One tokenizer for each file and worker process."""
    key = path, special_as_text
    if key not in _loaded:
        _loaded[key] = LibraryTokenizer(path, special_as_text)
    return _loaded[key]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
