"""Subword ids by a public tokenizer's file, with a memory for the parts of texts that come again.

A tokenizer of the byte-level or word kind encodes the parts of a text alone, so a text's ids are its parts'
ids in a row if it is cut where no part can reach across. That is certain (1) after a letter before an ASCII
character that is none, and (2) before a blank that follows a character that is none. Texts of ASCII and Latin
letters are cut there, and each distinct piece is encoded once; all others are encoded whole, and so are texts that
may hold the string of a special token, which the tokenizer takes for that token.
"""

import re
import zlib
from itertools import chain

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARK = "!-@\\[-`{-~"
_BLANK = "\t-\r "
_MARKS = re.compile(f"[{_MARK}]{{2}}")
_PLAIN = re.compile(f"[{_LETTER}{_MARK}{_BLANK}]*")
#: A word, with its blank if there is one: encoded in rows of many, parted by line ends, which no part reaches across.
_WORD = re.compile(f" ?[{_LETTER}]+")
_PIECE = re.compile(f"[{_BLANK}]*(?:[{_MARK}]*[{_LETTER}]+|[{_MARK}]+)|[{_BLANK}]+")
#: Characters encoded at once.
SLICE = 1_000_000


class Encoder:
    """path: a tokenizers file, which the executors must have too. memory: pieces kept at most.

    special: whether the strings of special tokens in a text are those tokens, as the library has it, or ordinary text.
    """

    def __init__(self, path: str, memory: int = 400_000, special: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        tokens = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        #: Each special token begins with one of these; marks have no case and are not changed by normalisers.
        self.hints = sorted({t[:2] if _MARKS.fullmatch(t[:2]) else "" for t in tokens})
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.memory = memory
        self._forget()

    def _forget(self):
        new = self.new = []

        class Places(dict):
            def __missing__(self, piece):
                place = self[piece] = len(self)
                new.append(piece)
                return place

        self.places = Places()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _learn(self):
        if self.new:
            plain = [_WORD.fullmatch(piece) is not None for piece in self.new]
            order = np.argsort(~np.array(plain), kind="stable")  # words, then the rest
            words = [piece for piece, is_word in zip(self.new, plain, strict=True) if is_word]
            ids, lengths = self._lines(words)
            rest = self._whole([piece for piece, is_word in zip(self.new, plain, strict=True) if not is_word])
            lengths = np.concatenate([*lengths, np.fromiter(map(len, rest), np.int64, len(rest))])
            starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            starts[order], sizes[order] = len(self.flat) + np.cumsum(lengths) - lengths, lengths
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, *ids, *rest])
            self.new.clear()

    def _mark(self) -> tuple[str, int] | None:
        """What goes between words encoded in a row, and its one id, which no word has."""
        for mark in ("\n", "\n,\n"):
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                return mark, ids[0]
        return None

    def _lines(self, words):
        """The words' ids in a row and their lengths, as lists of arrays."""
        flat, lengths, mark = [], [], self._mark()
        for i in range(0, len(words), 4096):
            group = words[i : i + 4096]
            if mark:
                ids = self._whole([mark[0].join(group)])[0]
                between = ids == mark[1]
                ends = np.append(np.flatnonzero(between), len(ids))
            if mark and len(ends) == len(group):
                flat.append(ids[~between])
                lengths.append(np.diff(ends, prepend=-1) - 1)
            else:
                found = self._whole(group)
                flat += found
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        return flat, lengths

    def _whole(self, texts):
        out = []
        for i in range(0, len(texts), 4096):  # few encodings in memory at a time
            out += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        group, held = [], 0
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and not any(h in text for h in self.hints):
                group.append(i)
                held += len(text)
                if held > SLICE:
                    self._pieces(texts, group, out)
                    group, held = [], 0
            else:
                out[i] = self._whole([text])[0]
        self._pieces(texts, group, out)
        return out

    def _pieces(self, texts, group, out):
        if len(self.places) > self.memory:
            self._forget()
        found = [_PIECE.findall(texts[i]) for i in group]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        self._learn()
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for k, i in enumerate(group):
            out[i] = flat[bounds[k] : bounds[k + 1]]


_encoders: dict = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each Python worker and way."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special=special)
    return _encoders[path, special]


def byte_pairs(path: str):
    """A byte-level encoder of a file of ranks, one for each Python worker. Strings of special tokens are ordinary text."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def public(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
