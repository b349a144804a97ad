"""Pre-tokens of many texts at once.

The rule is that of the byte-level BPE families: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of
digits and of other signs, each with one space before it, and runs of white space, of which the last character
before other text stands apart. Boundaries follow from character classes and are found on arrays of code
points; equal pre-tokens of a batch are then encoded once, and frequent ones once a worker. A hash proposes which
pre-tokens are equal; their characters decide.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

#: The pattern that `starts` implements.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 1_000_000
#: Pre-tokens that a worker remembers, by number and by characters.
KNOWN_LIMIT, KNOWN_CHARS = 250_000, 10_000_000
OTHER, LETTER, DIGIT, WHITE = range(4)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    chars = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            table[m.start() : m.end()] = kind
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, and where each text starts, with the total at the end."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return cp, np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))


def starts(cp: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts."""
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n + 3, bool)  # first character of a text; the padding ends the last one
    first[texts_at] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    after_space = np.zeros(n, bool)
    after_space[1:] = cp[:-1] == 32
    after_space &= ~first[:n]
    start = run & (white | ~after_space)
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        pad = np.concatenate((cp, np.zeros(3, cp.dtype)))
        a, b = pad[quote + 1], pad[quote + 2]
        in_1, in_2 = ~first[quote + 1], ~first[quote + 1] & ~first[quote + 2]
        one = in_1 & np.isin(a, [ord(x) for x in "stmd"])
        two = in_2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[at + 1] = False
            end = at + size
            end = end[end < n]
            inside = ~first[end] & (kind[end] == LETTER)
            start[end[inside]] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _hashes(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pre-token's characters, from one running sum."""
    powers, inverse = _powers(max(BATCH_CHARS, 1 << int(len(cp) + 1).bit_length()) if len(cp) > BATCH_CHARS else BATCH_CHARS)
    x = (cp.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(31)
    x *= powers[: len(x)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    ends = np.append(at[1:], len(cp))
    h = (total[ends] - total[at]) * inverse[at]
    h ^= h >> np.uint64(32)
    return h * _MIX + (ends - at).astype(np.uint64)


def _groups(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pre-tokens: one of each group, and the group of each.

    Every pre-token is compared with its group's first one, character by character; one that differs from it
    in spite of an equal hash is grouped anew among those that do.
    """
    n = np.append(at[1:], len(cp)) - at
    kind, values = pd.factorize(_hashes(cp, at))
    sample = np.empty(len(values), np.int64)
    sample[kind[::-1]] = np.arange(len(at) - 1, -1, -1)
    # the character that the group's first one has in the same place
    source = np.repeat(at[sample][kind] - at, n)
    source += np.arange(len(cp))
    np.minimum(source, len(cp) - 1, out=source)
    differs = n != n[sample][kind]
    differs[np.searchsorted(at, np.flatnonzero(cp[source] != cp), "right") - 1] = True
    own: dict[bytes, int] = {}
    for k in np.flatnonzero(differs).tolist():
        kind[k] = own.setdefault(cp[at[k] : at[k] + n[k]].tobytes(), len(sample))
        if kind[k] == len(sample):
            sample = np.append(sample, k)
    return sample, kind


#: A pre-token starts at a space that other text follows, so a long text can be cut there.
_CUT = re.compile(r" (?=\S)")


def segments(text: str, size: int = BATCH_CHARS) -> list[str]:
    """The text in pieces of about `size` characters that can be encoded one by one."""
    out, first = [], 0
    while len(text) - first > size and (m := _CUT.search(text, first + size)):
        out.append(text[first : m.start()])
        first = m.start()
    return [*out, text[first:]]


class BatchEncoder:
    """Ids of whole texts; encode_new gets distinct pre-tokens and returns the ids of each.

    What a worker remembers is a pre-token's number; the ids of all are one array, and bounds says where those of a number are.
    """

    def __init__(self, encode_new, limit: int = KNOWN_LIMIT):
        self.encode_new, self.limit = encode_new, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start, with the total at the end."""
        if max(map(len, texts), default=0) <= 2 * BATCH_CHARS:
            return self._encode(texts)
        rows = [np.concatenate([self._encode([x])[0] for x in segments(text)]) for text in texts]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """The numbers of distinct pre-tokens; those that are new are encoded."""
        if len(self.known) > self.limit or self.chars > KNOWN_CHARS:
            self._forget()
        found = list(map(self.known.get, tokens))
        places = [k for k, x in enumerate(found) if x is None]
        if places:
            new = [tokens[k] for k in places]
            rows = self.encode_new(new)
            first = len(self.bounds) - 1
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(rows), np.int32, int(self.bounds[-1]) - len(self.ids))))
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.chars += sum(map(len, new))
            for k, x in enumerate(places, first):
                found[x] = k
        return np.array(found, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, texts_at = code_points(texts)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        at = starts(cp, texts_at)
        sample, kind = _groups(cp, at)
        whole, ends = "".join(texts), np.append(at[1:], len(cp))
        tokens = [whole[a:b] for a, b in zip(at[sample].tolist(), ends[sample].tolist(), strict=True)]
        number = self._numbers(tokens)[kind]
        n = (self.bounds[1:] - self.bounds[:-1])[number]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(self.bounds[number] - (upto - n), n) + np.arange(upto[-1])]
        return ids, np.concatenate(([0], upto))[np.searchsorted(at, texts_at)]


def slices(sizes: list[int], limit: int = BATCH_CHARS) -> list[tuple[int, int]]:
    """Ranges of rows of about `limit` together, one row at least."""
    out, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            out.append((first, k))
            first, total = k, 0
        total += n
    return [*out, (first, len(sizes))] if first < len(sizes) else out
