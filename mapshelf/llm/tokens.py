"""Token ids of whole texts, with a memory for the units that texts are made of.

A single space between two characters that are no white space always starts a token of a byte-level BPE whose pattern
takes one leading space along. Texts are cut before these spaces; a unit is encoded when it is first met, together with the other new ones of
the batch: joined again, the tokens that begin with a space say where each starts. Cutting, recognising known units and putting
their ids together are array operations over the bytes of many texts.

Units are known by 128 bits of hashes. The memory is bounded by its bytes and outlives a task, until one of another operator begins; when it is full, the half that was met least goes.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from mapshelf.llm.common import leftovers, raw_bytes
from mapshelf.llm.words import mix, powers, ranges

#: Units joined for one call of the tokenizer; a space as tokens show it.
_JOINED, _SPACE = 2000, "Ġ"
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: The white space of Unicode beyond ASCII, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True
_OTHER = np.array([(x * 0x94D049BB133111EB + 0x2545F4914F6CDD1D) % 2**64 for x in range(256)], np.uint64)
_BYTE = np.array([(x * 0xBF58476D1CE4E5B9 + 0xD6E8FEB86659FD93) % 2**64 for x in range(256)], np.uint64)
_NONE = np.zeros(0, np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: texts that are not empty, and single spaces between other characters."""
    white = _WHITE[data]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.uint32)
        three = padded[lead] << 16 | padded[lead + 1] << 8 | padded[lead + 2]
        for w in _WIDE:
            found = lead[three >> 8 == int.from_bytes(w, "big")] if len(w) == 2 else lead[three == int.from_bytes(w, "big")]
            for i in range(len(w)):
                white[found + i] = True
    cut = data == 0x20
    cut[1:] &= ~white[:-1]
    cut[:-1] &= ~white[1:]
    if len(data):
        cut[-1] = False
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[offsets[1:-1][offsets[1:-1] > 0] - 1] = False  # the end of a text
        cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes with the file's tokenizer, without special tokens added. About ``memory`` bytes of known units are kept."""

    def __init__(self, path: str, memory: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.key, self.check = _NONE, _NONE  # sorted by the key
        self.at, self.n, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.tokenizer.normalizer is None and self.tokenizer.pre_tokenizer is not None
        # Where these occur, units are encoded one by one.
        self.alone = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True

    @property
    def size(self) -> int:
        return 40 * len(self.key) + 4 * len(self.ids)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 places where each text's begin; a null text has none."""
        data, offsets = raw_bytes(texts)
        if not self.plain:
            found = self._encoded([data[a:z].tobytes().decode() for a, z in zip(offsets, offsets[1:])])
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        start = _cuts(data, offsets)
        stop = np.append(start[1:], len(data)) if len(start) else start
        key, check = self._hashed(data, start, stop)
        unit, first, back = np.unique(key, return_index=True, return_inverse=True)
        met = np.bincount(back, minlength=len(unit))
        # Between two cuts inside a text, both neighbours are no white space; else the bytes are looked at.
        cut = np.append(~np.isin(start, offsets), False)
        joins = cut[:-1] & (cut[1:] | ~_WHITE[data[stop - 1]] & (data[stop - 1] < 0x80))
        self._learn(data.tobytes(), start[first], stop[first], unit, check[first], joins[first])
        at = np.searchsorted(self.key, unit)
        self.met[at] += met
        where = at[back]
        wrong = np.flatnonzero(self.check[where] != check)  # another unit has the key
        n = self.n[where]
        if len(wrong):
            own = self._encoded([data[a:z].tobytes().decode() for a, z in zip(start[wrong], stop[wrong])])
            n = n.copy()
            n[wrong] = [len(x) for x in own]
        ends = np.cumsum(n)
        ids = self.ids[ranges(self.at[where], n)] if not len(wrong) else self._mended(where, n, dict(zip(wrong.tolist(), own)))
        total = np.concatenate([[0], ends])
        out = ids, total[np.searchsorted(start, offsets)]
        if self.size > self.memory:
            self._forget()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        ids, edge = self.encode_array(pa.array(texts, pa.large_string()))
        data, edge = ids.astype("<u4").tobytes(), (4 * edge).tolist()
        return [data[a:z] for a, z in zip(edge, edge[1:])]

    def _mended(self, where: np.ndarray, n: np.ndarray, own: dict[int, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(own[i] if i in own else self.ids[self.at[w] : self.at[w] + m] for i, (w, m) in enumerate(zip(where.tolist(), n.tolist())))])

    @staticmethod
    def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each unit's bytes."""
        up, down = powers(len(data) + 1)
        out = []
        for table in (_BYTE, _OTHER):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=total[1:])
            out.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return out[0], out[1]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: bytes, start: np.ndarray, stop: np.ndarray, key: np.ndarray, check: np.ndarray, joins: np.ndarray) -> None:
        """Encode those of the units that are not known. Some of them may be joined: they start with a space and no white space ends them."""
        at = np.searchsorted(self.key, key)
        new = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != key) if len(self.key) else np.arange(len(key))
        if not len(new):
            return
        place, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        found, total = [self.ids], len(self.ids)
        units = [data[a:z] for a, z in zip(start[new].tolist(), stop[new].tolist())]
        alone = np.flatnonzero(~joins[new]).tolist()
        joined = np.flatnonzero(joins[new])
        for i in range(0, len(joined), _JOINED):
            some = joined[i : i + _JOINED]
            text = b"".join([units[j] for j in some.tolist()]).decode()
            ids = self._encoded([text])[0]
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) != len(some) or self.alone.search(text):
                alone += some.tolist()
                continue
            place[some], n[some] = total + starts, np.diff(np.append(starts, len(ids)))
            found.append(ids)
            total += len(ids)
        for j, ids in zip(alone, self._encoded([units[j].decode() for j in alone])):
            place[j], n[j] = total, len(ids)
            found.append(ids)
            total += len(ids)
        self.ids = np.concatenate(found)
        for name, values in (("key", key[new]), ("check", check[new]), ("at", place), ("n", n), ("met", np.zeros(len(new), np.int64))):
            setattr(self, name, np.insert(getattr(self, name), at[new], values))

    def _forget(self) -> None:
        """Keep the units that were met most, half of the memory of them."""
        order = np.argsort(-self.met, kind="stable")
        kept = np.sort(order[np.cumsum(40 + 4 * self.n[order]) <= self.memory // 2])
        self.ids = self.ids[ranges(self.at[kept], self.n[kept])]
        for name in ("key", "check", "n"):
            setattr(self, name, getattr(self, name)[kept])
        self.at, self.met = np.cumsum(self.n) - self.n, np.zeros(len(kept), np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python process."""
    return Encoder(path)


leftovers.append(encoder.cache_clear)
