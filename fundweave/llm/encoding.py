"""Encoding whole texts with a public tokenizer at the speed of a dictionary.

A tokenizer cuts a text into pre-tokens and merges inside each alone. A text is therefore the
concatenation of its chunks' ids, where a chunk ends before white space: no pre-token reaches over the
end of a chunk. Each distinct chunk is encoded by the tokenizers library once and its ids are kept
while the worker encodes.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from .common import LOWER, trim

#: Characters with the Unicode property White_Space (fixed values), \s for the tokenizers.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters before one full stop, comma or exclamation mark at the end of a word are a chunk of their own.
_CHUNKS = re.compile(f" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[.,!](?:[{SPACE}]|\\Z))|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Chunks that an encoder keeps between batches: about 200 bytes each.
LIMIT = 300_000
#: New chunks encoded in one call; bytes of a block that is cut at once.
TOGETHER, SPAN = 100, 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15


class Numbers:
    """64-bit hash -> number, an open-addressing table in numpy; numbers go up from 1 in the order of adding."""

    def __init__(self, limit: int):
        self.bits = max(10, (4 * limit - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.hashes, self.known = np.zeros(1024, np.uint64), 1

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers; 0 for what is unknown."""
        slot = self._slots(h)
        found = self.keys[slot]
        out = np.where(found == h, self.values[slot], 0)
        rest = np.flatnonzero((found != h) & (found != 0))
        while len(rest):
            slot = (self._slots(h[rest]) if len(slot) != len(rest) else slot) + 1 & (1 << self.bits) - 1
            found = self.keys[slot]
            hit = found == h[rest]
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (found != 0)
            rest, slot = rest[go], slot[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """h: distinct and unknown."""
        n = self.known + len(h)
        if n > len(self.hashes):
            self.hashes = np.r_[self.hashes, np.zeros(n, np.uint64)]
        self.hashes[self.known : n] = h
        value, slot = np.arange(self.known, n, dtype=np.int32), self._slots(h)
        self.known = n
        if 2 * n > len(self.keys):  # so many in one call: the table grows
            self.bits += 2
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            h, value = self.hashes[1:n], np.arange(1, n, dtype=np.int32)
            slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = self.keys[slot] == h
            self.values[slot[own]] = value[own]
            h, value, slot = h[~own], value[~own], slot[~own] + 1 & (1 << self.bits) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))


class ChunkEncoder:
    """The ids of chunk number k are flat[start[k]:start[k + 1]]; chunk 0 is the end.

    Chunks are cut and hashed (64 bits) over whole blocks of texts with numpy; only a chunk that is not
    known yet is looked at by itself. At most `limit` chunks are kept between batches; beyond that the
    half not used for longest goes. A tokenizer that drops white space and lowers letters gets words of
    bytes with A-Z lowered, which makes fewer of them. Of another tokenizer's texts a chunk is a space, a
    line end or the text's start with all that follows up to the next one. Where white space meets a
    space, or three line ends meet, and where a special token may stand, the pattern cuts the text.
    """

    def __init__(self, path: str, end_id: int, drops_space: bool, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.drops_space, self.limit = end_id, drops_space, limit
        special = [k for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark = special[-1] if special else None
        self.mark_text = self.tokenizer.id_to_token(self.mark) if special else ""
        self.start, self.flat = array("i", [0, 1]), array("I", [self.end_id])
        self.numbers = Numbers(limit)
        self.calls, self.used = 0, np.zeros(1, np.int32)  # used: the call that last used each chunk
        self.power, self.inverse = _powers(SPAN + 2)
        self.parts = np.zeros(256, bool)
        self.parts[[9, 10, 11, 12, 13, 32, 0] if drops_space else [0, 10, 32]] = True

    def _forget(self) -> None:
        known = self.numbers.known
        kept = np.r_[0, np.sort(np.argsort(-self.used[1:known], kind="stable")[: self.limit // 2]) + 1]
        start, flat, hashes = np.array(self.start), np.array(self.flat), self.numbers.hashes[kept[1:]]
        self.numbers.clear()
        self.numbers.add(hashes)
        first, length = start[kept], start[kept + 1] - start[kept]
        ends = np.cumsum(length)
        self.flat = array("I", flat[np.repeat(first - (ends - length), length) + np.arange(ends[-1])].astype("I").tobytes())
        self.start = array("i", np.r_[0, ends].astype("i").tobytes())
        self.used = self.used[kept]

    def _learn(self, texts: list[str]) -> None:
        """Encode new chunks: TOGETHER of them in one call, parted by a special token, at which the tokenizer cuts before anything else."""
        for i in range(0, len(texts), TOGETHER):
            some = texts[i : i + TOGETHER]
            if self.mark is None or "<|" in "".join(some):
                for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    self.flat.extend(e.ids)
                    self.start.append(len(self.flat))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark_text.join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            own, first = ids[ids != self.mark], len(self.flat)
            self.flat.frombytes(own.tobytes())
            self.start.frombytes((np.r_[cut - np.arange(len(cut)), len(own)] + first).astype("i").tobytes())

    def _odd(self, text: str) -> bool:
        """Whether a text must be cut by the pattern."""
        return len(text) > SPAN // 4 or "<|" in text or "\0" in text or (not self.drops_space and ("\n\n\n" in text or text.endswith("\n\n")))

    def _odd_chunks(self, text: str) -> np.ndarray:
        """Numbers of the chunks that the pattern, or white space, cuts; known by their XXH64."""
        chunks = [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()] if self.drops_space else _CHUNKS.findall(text)
        h = np.fromiter((xxh64_intdigest(c.encode("utf-8", "surrogatepass")) | 1 for c in chunks), np.uint64, len(chunks))
        return self._known(h, lambda k: chunks[k])[0]

    def _known(self, h: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, and the places of those that may not be taken (text_of gives None)."""
        number = self.numbers.find(h)
        new = np.flatnonzero(number == 0)
        if not len(new):
            return number, new
        fresh, first = np.unique(h[new], return_index=True)
        texts = [text_of(k) for k in new[first].tolist()]
        good = np.array([t is not None for t in texts], bool)
        self._learn([t for t in texts if t is not None])
        self.numbers.add(fresh[good])
        number[new] = self.numbers.find(h[new])
        return number, np.flatnonzero(number == 0)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the chunks of each text of a block."""
        odd = [self._odd(t) for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        out: list = [None] * len(plain)
        if plain:
            coded = [t.encode("utf-8", "surrogatepass") for t in plain]
            data = b"\0" + b"\0".join(coded)
            if self.drops_space:
                data = data.translate(LOWER)
            a = np.frombuffer(data, np.uint8)
            at = np.flatnonzero(self.parts[a])  # the places at which chunks part
            if self.drops_space:
                s, e = at + 1, np.r_[at[1:], len(a)]
                s, e = s[s < e], e[s < e]
            else:
                s, e = at, np.r_[at[1:], len(a)]
            total = np.zeros(len(a) + 1, np.uint64)
            np.multiply(self.power[: len(a)], a, out=total[1:])  # a part's byte 0 counts by its place alone
            np.cumsum(total, out=total)
            h = (total[e] - total[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # every bit must tell words apart before the last one is set
                h ^= h >> np.uint64(shift)
                h *= np.uint64(factor)
            h ^= h >> np.uint64(31)
            h |= np.uint64(1)

            def text_of(k: int) -> str | None:
                chunk = data[s[k] : e[k]].decode("utf-8", "surrogatepass")
                if self.drops_space:
                    return chunk
                if chunk != "\n" and chunk[0] != "\0" and (len(chunk) == 1 or chunk[1].isspace() or chunk[-1].isspace()) or chunk[0] == "\0" and len(chunk) > 1 and chunk[-1].isspace():
                    return None
                return chunk[1:] if chunk[0] == "\0" else chunk

            number, bad = self._known(h, text_of)
            begin = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
            first = np.searchsorted(s, begin)
            out = np.split(number, first[1:])
            for k in np.unique(np.searchsorted(begin, s[bad], "right") - 1).tolist():
                out[k] = self._odd_chunks(plain[k])
        rest = iter(out)
        return [self._odd_chunks(t) if o else next(rest) for t, o in zip(texts, odd, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each text has."""
        if self.numbers.known > self.limit:
            self._forget()
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        end, parts, some, size = np.zeros(1, np.int32), [], [], 0
        for text in texts:
            if some and size + len(text) > SPAN // 4:
                parts += self._block(some)
                some, size = [], 0
            some.append(text)
            size += len(text) + 1
        parts += self._block(some)
        numbers = np.concatenate([x for part in parts for x in (part, end)])
        counts = np.array([len(x) + 1 for x in parts], np.int64)
        if self.numbers.known > len(self.used):
            self.used = np.r_[self.used, np.zeros(self.numbers.known, np.int32)]
        self.calls += 1
        self.used[numbers] = self.calls
        start, flat = np.frombuffer(self.start, np.int32), np.frombuffer(self.flat, np.uint32)  # views: gone before the next chunk is learnt
        first, length = start[numbers], np.diff(start)[numbers]
        ends = np.cumsum(length, dtype=np.int32)
        at = np.repeat(first - (ends - length), length)
        at += np.arange(ends[-1], dtype=np.int32)
        return flat[at], np.add.reduceat(length, np.cumsum(counts) - counts, dtype=np.int64)


_held: dict[tuple, ChunkEncoder] = {}


def release() -> None:
    """Drop the encoders of this Python worker: called where a worker turns to an operator that does not encode."""
    if _held:
        _held.clear()
        trim()


def encoder(name: str, end_id: int, drops_space: bool, path: str | None = None, limit: int = LIMIT) -> ChunkEncoder:
    """One encoder at a time for each Python worker, kept from task to task."""
    key = path or public_tokenizers.path(name), end_id, drops_space, limit
    if key not in _held:
        release()
        _held[key] = ChunkEncoder(*key)
    return _held[key]


def text_batches(column, chars: int = 4_000_000):
    """(first, texts) slices of an Arrow string column of about so many characters; null: empty."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts
