"""Byte-level BPE encoding of whole texts with the tokenizers library, mostly at the speed of a table lookup.

The byte-level pre-tokenizer never lets a token cross the place between a non-space character and a single space that
a non-space character follows. So a text can be cut at such spaces, and each word, with its space, be encoded alone. A
worker keeps the ids of the words that it has met, up to a bound, in a hash table over whole arrays (keys of 64 bits:
a polynomial of the word's bytes, mixed with its length), and asks the tokenizer for the others, many at a time. Texts
with white space beside their spaces are given to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import local_file, ranges

#: Words whose ids a worker keeps. When there are more, only those met more than once stay, half as many at most.
CACHE_WORDS = 600_000

_encoders: dict[str, Encoder] = {}
_SPACE = 32
_random = np.random.default_rng(20240501)
_VALUES = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1, 2**62)) * 8 + 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HEAD = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """_BASE to the power 0, 1, … and its inverses, modulo 2**64, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up, self.down


class Table:
    """Numbers for 64-bit keys, none of them 0, by open addressing; all steps work on arrays."""

    def __init__(self, bits: int = 19):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = (keys >> np.uint64(20)) & self.mask
        found = self.keys[slot]
        out = np.where(found == keys, self.numbers[slot], -1)
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask
            found = self.keys[slot[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.numbers[slot[rest[same]]]
            rest = rest[~same & (found != 0)]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add keys that are distinct and not there yet."""
        slot = (keys >> np.uint64(20)) & self.mask
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.numbers[slot[won]] = keys[won], numbers[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask


class Encoder:
    """encode(buf, offs) gives (ids, counts): all ids in one array and how many each text has."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(local_file(path))
        self.n_vocab = self.tokenizer.get_vocab_size()
        added = {k: len(v.content.encode()) for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        self.token_bytes = np.zeros(self.n_vocab, np.int64)
        for token, k in self.tokenizer.get_vocab().items():  # a token of the byte alphabet has a character for each byte
            self.token_bytes[k] = added.get(k, len(token))
        self.ids, self.starts, self.counts, self.uses = (np.zeros(0, np.int64) for _ in range(4))
        self.keys, self.table, self.powers = np.zeros(0, np.uint64), Table(), Powers()

    def _code(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[bytes], head: np.ndarray) -> None:
        """Encode words that are new: those with a space before them in a few long texts, told apart by their tokens'
        lengths in bytes. A word that can't be cut at gets no ids, and its texts are encoded whole."""
        count, got, inner = np.zeros(len(words), np.int64), [], []
        safe = [bool(w) and not ((t := w.decode())[0].isspace() or t[-1].isspace()) for w in words]
        order = [k for k, ok in enumerate(safe) if ok and head[k]]
        for k, ids in zip(order, self._code([words[k].decode() for k in order]), strict=True):
            count[k] = len(ids)
            got.append(ids)
        inner = [k for k, ok in enumerate(safe) if ok and not head[k]]
        groups = [inner[at : at + 500] for at in range(0, len(inner), 500)]
        for some, ids in zip(groups, self._code([b"".join([b" " + words[k] for k in some]).decode() for some in groups]), strict=True):
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(words[k]) + 1 for k in some]), "right")
            count[some] = np.diff(ends, prepend=0)
            got.append(ids)
        order = np.array(order + inner, np.int64)
        start = np.zeros(len(words), np.int64)
        start[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        if 2 * (len(self.keys) + len(keys)) > len(self.table.keys):  # a long text may hold more words than the bound
            self.table = Table((2 * (len(self.keys) + len(keys))).bit_length())
            self.table.put(self.keys, np.arange(len(self.keys)))
        self.table.put(keys, len(self.keys) + np.arange(len(keys)))
        self.ids = np.concatenate([self.ids, *got])
        self.starts, self.counts, self.keys = (np.concatenate(x) for x in ((self.starts, start), (self.counts, count), (self.keys, keys)))
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _shrink(self) -> None:
        """Keep the words met more than once, the most used half of the bound at most."""
        keep = np.flatnonzero(self.uses > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: CACHE_WORDS // 2]])
        self.ids, self.counts = self.ids[ranges(self.starts[keep], self.counts[keep])], self.counts[keep]
        self.starts, self.uses, self.keys = np.cumsum(self.counts) - self.counts, self.uses[keep] >> 1, self.keys[keep]
        self.table = Table()
        self.table.put(self.keys, np.arange(len(keep)))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > CACHE_WORDS or len(self.ids) > 16 * CACHE_WORDS:
            self._shrink()
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
        full = np.flatnonzero(np.diff(offs))
        begins = np.zeros(n + 1, bool)
        begins[np.flatnonzero(buf == _SPACE) + 1] = True
        heads = np.zeros(n + 1, bool)
        heads[offs[full]] = True
        begins |= heads
        begins[n] = True
        place = np.flatnonzero(begins)
        s, e = place[:-1], place[1:].copy()
        head = heads[s]
        e[:-1] -= ~head[1:]  # the space before the next word; a text's last word ends with the text
        up, down = self.powers.to(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[buf] * up[:n], out=sums[1:])
        keys = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _MIX
        keys ^= keys >> np.uint64(29)
        keys *= _MIX
        keys[head] ^= _HEAD
        keys[keys == 0] = 1
        at = self.table.get(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            where = missing[first]
            raw, base = buf.tobytes(), len(self.keys)
            self._learn(new, [raw[i:j] for i, j in zip(s[where].tolist(), e[where].tolist(), strict=True)], head[where])
            at[missing] = base + back
        self.uses += np.bincount(at, minlength=len(self.uses))
        counts, starts = self.counts[at], self.starts[at]
        bounds = np.append(np.flatnonzero(head), len(s))
        ids = self.ids
        if (odd := counts == 0).any():  # texts that can't be cut
            whole = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)
            raw = buf.tobytes()
            coded = self._code([raw[offs[k] : offs[k + 1]].decode() for k in full[whole]])
            counts[ranges(bounds[whole], bounds[whole + 1] - bounds[whole])] = 0
            counts[bounds[whole]] = size = np.array([len(x) for x in coded], np.int64)
            starts[bounds[whole]] = len(ids) + np.cumsum(size) - size
            ids = np.concatenate([ids, *coded])
        per_text = np.zeros(len(offs) - 1, np.int64)
        per_text[full] = np.add.reduceat(counts, bounds[:-1])
        return ids[ranges(starts, counts)], per_text


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each text's ids; gives (ids, offsets)."""
    offs = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(offs[-1], np.int32)
    out[offs[1:] - 1] = end_id
    keep = np.ones(offs[-1], bool)
    keep[offs[1:] - 1] = False
    out[keep] = ids
    return out, offs


def list_array(ids: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
