"""Pre-tokens of byte-level vocabularies, and the ids of each different one.

The usual pattern (contractions, letters, numbers, other marks, each with a space
before it if there is one; white space) breaks where the class of a character
changes, so its breaks are found for many texts at once from an array of classes.
Unicode's classes differ from version to version, so each library is asked for its own.

Each different pre-token of a batch is looked up once, and a new one goes to a
tokenizer's library once; the ids of a text are gathered from those.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pyarrow as pa

from . import common as c

#: Fixed value: the pattern whose breaks `starts` finds by classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, _NUMBER, SPACE, _OTHER = range(4)
#: A worker forgets its pre-tokens when there are more; and when there are more characters in them than this for each.
REMEMBERED, CHARS_EACH = 400_000, 40


def _class_table(members) -> np.ndarray:
    """The class of every code point; members(class, all) gives those of a class."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, inside, outside in ((LETTER, r"\p{L}", r"\P{L}"), (_NUMBER, r"\p{N}", r"\P{N}"), (SPACE, r"\s", r"\S")):
        out[np.frombuffer(members(inside, outside, every).encode("utf-32-le"), np.uint32)] = kind
    return out


@functools.cache
def tiktoken_classes() -> np.ndarray:
    """The classes as tiktoken has them: it encodes what a pattern matches and skips the rest."""
    import tiktoken

    one = {bytes([k]): k for k in range(256)}
    return _class_table(lambda inside, _, every: bytes(tiktoken.Encoding("class", pat_str=inside, mergeable_ranks=one, special_tokens={}).encode_ordinary(every)).decode())


@functools.cache
def tokenizers_classes() -> np.ndarray:
    """The classes as tokenizers has them."""
    from tokenizers import Regex, normalizers

    return _class_table(lambda _, outside, every: normalizers.Replace(Regex(outside + "+"), "").normalize_str(every))


def starts(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions in buf at which pre-tokens begin, over all texts of a slice, by
    the classes of one of the libraries; a pre-token never reaches over the end of its text."""
    if not len(buf):
        return np.zeros(0, np.int64)
    ascii = int(buf.max()) < 128
    if ascii:
        text, first = buf, off[:-1]
    else:
        text = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        size = 1 + (text >= 0x80).astype(np.uint8) + (text >= 0x800) + (text >= 0x10000)
        at = c.running(size)  # of each character, in bytes
        first = np.searchsorted(at, off[:-1])
    n = len(text)
    kind = classes[text]
    space, edge = kind == SPACE, np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    start = edge[:n].copy()
    before, after = space[:-1], np.append(space[2:], True)[: n - 1] | edge[2:]
    # a change of class begins a pre-token, but a space goes with what follows;
    # of white space before something else, the last character stands alone
    start[1:] |= np.where(space[1:], ~before | ~after, (kind[1:] != kind[:-1]) & (text[:-1] != 32))
    for q in np.flatnonzero((text == 39) & start).tolist():
        some = text[q + 1 : q + 3].tolist()
        long = 1 if some[:1] in ([115], [116], [109], [100]) else 2 if some in ([114, 101], [118, 101], [108, 108]) else 0
        if long and not edge[q + 1 : q + 1 + long].any():
            start[q + 1] = False
            if q + 1 + long < n:
                start[q + 1 + long] = True
    found = np.flatnonzero(start)
    return found if ascii else at[found]


class Memory:
    """Ids of pre-tokens; `encode` gives the ids of each of a list of new ones."""

    def __init__(self, encode, remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        self.ids_of: dict[str, bytes] = {}  # as 32-bit integers end to end
        self.chars = 0

    def ids(self, buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each pre-token)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.ids_of) > self.remembered or self.chars > CHARS_EACH * self.remembered:
            self.forget()
        ends = np.append(start, len(buf)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
        known = list(map(self.ids_of.get, different))
        new = [k for k, x in enumerate(known) if x is None]
        if new:
            words = [different[k] for k in new]
            got = self.encode(words)
            n = np.fromiter(map(len, got), np.int64, len(got))
            raw, upto = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())).tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
            for k, word, a, b in zip(new, words, upto, upto[1:]):
                known[k] = self.ids_of[word] = raw[a:b]
            self.chars += sum(map(len, words))
        # the ids of a text are those of its pre-tokens, put end to end by Arrow
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        upto = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
        flat = np.frombuffer(taken.buffers()[2], np.uint32, int(upto[-1] - upto[0]) // 4, int(upto[0]))
        return flat, np.diff(upto) // 4
