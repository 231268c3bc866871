"""Token ids of whole texts through the tokenizers library, each distinct unit of a task encoded once.

A unit is a stretch of text that the tokenizer never looks beyond.  Where the tokenizer file has the
normalizer and pre-tokenizer of `SPLIT`, units are cut from the bytes: a run of letters, a digit, or a run of
other ASCII marks; a word with anything else (an apostrophe, a sign of an added token, a control
character, a letter outside Latin and Cyrillic, a combining mark) is one unit.  For any other file
whole texts go to the library.  Units are told apart by 64-bit hashes (LONG_WORD bytes and more: blake2b);
two of the at most `cached` units of a worker share one with a chance of about cached**2 / 2**65.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from harborline.llm.common import held
from harborline.llm.textblocks import hashes_of, lowered, pieces

U64 = np.uint64

# fixed values: the normalizers and the split pattern whose units `units` cuts
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Classes of bytes.
LETTER, DIGIT, MARK, SPACE, ROUGH = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, ROUGH, np.uint8)
    c[0x21:0x7F] = MARK
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    c[ord("0") : ord("9") + 1] = DIGIT
    c[ord("A") : ord("Z") + 1] = c[ord("a") : ord("z") + 1] = LETTER
    c[0x80:0xC0] = LETTER  # goes with the byte before
    c[0xC3:0xC6] = c[0xD0:0xD2] = LETTER  # U+00C0-017F and U+0400-047F, less those of NOT_PLAIN
    c[ord("'")] = ROUGH
    return c


#: Two-byte characters under plain lead bytes that are no letters or change their length in lower case.
NOT_PLAIN = ("×", "÷", "İ")


def vocabulary(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def units(offsets: np.ndarray, body: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rough) of the units of the texts, in order, and the bytes with Latin letters of plain units in lower case."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), body
    low = lowered(body)
    low[1:] += ((body[:-1] == 0xC3) & (body[1:] < 0x9F)).astype(np.uint8) << np.uint8(5)  # U+00C0-00DE, as × is in no plain unit
    c = classes[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = (c[1:] != c[:-1]) | (c[1:] == DIGIT)
    begins |= edge[:n]
    odd = c == ROUGH
    for x in NOT_PLAIN:
        a, b = x.encode()
        odd[:-1] |= (body[:-1] == a) & (body[1:] == b)
    rough_units = np.zeros(0, bool)
    inside = c != SPACE
    if odd.any():  # words with such bytes are one unit
        word = np.empty(n, bool)
        word[0] = True
        word[1:] = ~inside[:-1]
        word |= edge[:n]
        at = np.flatnonzero(word)
        bad = np.logical_or.reduceat(odd, at)
        whole = np.repeat(bad, np.diff(np.append(at, n)))
        begins &= ~whole | word
        rough_units = whole
        low = np.where(whole, body, low)
    starts = np.flatnonzero(begins & inside)
    stops = np.append(np.flatnonzero(begins | ~inside), n)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, rough_units[starts] if len(rough_units) else np.zeros(len(starts), bool), low


class UnitIds:
    """Ids of whole texts; holds the ids of at most `cached` units."""

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # no offsets
        told = json.loads(self.tokenizer.to_str())
        model, parts = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        names = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        first = parts[0]
        suffix = model.get("end_of_word_suffix")
        self.cuts = (
            names == NORMALIZERS and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
            and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and not any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
        )
        self.classes = _classes()
        for x in told["added_tokens"]:
            self.classes[x["content"].encode()[0]] = ROUGH
        vocab = model["vocab"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a pre-token
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.cached = cached
        self.slots = np.full(1 << max(4, (4 * cached - 1).bit_length()), -1, np.int32)
        self.shift, self.mask = U64(64 - len(self.slots).bit_length() + 1), len(self.slots) - 1
        self.clear()

    def clear(self) -> None:
        self.slots.fill(-1)
        self.n, self.used = 0, 0
        self.hashes, self.at, self.size = np.zeros(1024, U64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.arena = np.zeros(4096, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the known units, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.slots[slot]
        live = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            out[live] = self.slots[slot[live]]
            live = live[(out[live] >= 0) & (self.hashes[out[live]] != h[live])]
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.hashes, self.at, self.size = (_room(x, self.n + len(h)) for x in (self.hashes, self.at, self.size))
        self.arena = _room(self.arena, self.used + len(ids))
        self.hashes[entry], self.size[entry], self.at[entry] = h, sizes, self.used + np.cumsum(sizes) - sizes
        self.arena[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(h), self.used + len(ids)
        slot = (h >> self.shift).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & self.mask

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def learn(self, h: np.ndarray, texts: list[str], rough: np.ndarray) -> None:
        """Plain units are encoded side by side in one text: each ends with an id of a word's end."""
        plain, sizes = np.flatnonzero(~rough), np.zeros(0, np.int64)
        if len(plain):
            lines = [" ".join([texts[i] for i in plain[k : k + 2048]]) for k in range(0, len(plain), 2048)]
            ids, _ = self._encoded(lines)
            stop = np.flatnonzero(self.ends[ids]) + 1
            sizes = np.diff(stop, prepend=0)
            if len(stop) != len(plain) or stop[-1] != len(ids):
                ids, sizes = self._encoded([texts[i] for i in plain])
            self._add(h[plain], ids, sizes)
        odd = np.flatnonzero(rough)
        if len(odd):
            self._add(h[odd], *self._encoded([texts[i] for i in odd]))

    def _cut(self, o: np.ndarray, body: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, rough, low = units(o, body, self.classes)
        h = hashes_of(low, starts, ends)
        place = self.find(h)
        for whole in (False, True):  # a full cache is dropped and this block's units are learnt again
            miss = np.flatnonzero(place < 0)
            if not len(miss):
                break
            new, i = np.unique(h[miss], return_index=True)
            if self.n + len(new) > self.cached and self.n and not whole:
                self.clear()
                place = self.find(h)
                continue
            i = miss[i]
            if self.n + len(new) > self.cached:
                self._grow(len(new))
            raw = body.tobytes()
            self.learn(new, [raw[a:b].decode() for a, b in zip(starts[i].tolist(), ends[i].tolist(), strict=True)], rough[i])
            place[miss] = self.find(h[miss])
            break
        of = np.searchsorted(starts, o)
        size, at = self.size[place], self.at[place]
        first = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        ids = self.arena[np.repeat(at - first[:-1], size) + np.arange(first[-1])] if len(starts) else np.zeros(0, np.uint32)
        # the separator after each text
        begin = first[of] + np.arange(len(o))
        out = np.full(len(ids) + len(o) - 1, separator, np.uint32)
        other = np.ones(len(out), bool)
        other[begin[1:] - 1] = False
        out[other] = ids
        return out, begin

    def _grow(self, more: int) -> None:
        """One block with more units than the cache has places: the table grows for it."""
        while self.n + more > len(self.slots) // 4:
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
        self.clear()
        self.shift, self.mask = U64(64 - len(self.slots).bit_length() + 1), len(self.slots) - 1
        self.cached = len(self.slots) // 4

    def __call__(self, texts: pa.Array, separator: int, at_most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids with a separator after each text, where each text begins in them)."""
        for row, o, body in pieces(texts, at_most):
            if self.cuts:
                yield row, *self._cut(o, body, separator)
            else:
                raw = body.tobytes()
                got = self.encode_batch([raw[a:b].decode() for a, b in zip(o[:-1], o[1:], strict=True)], add_special_tokens=False)
                begin = np.append(0, np.cumsum([len(e.ids) + 1 for e in got]))
                yield row, np.array([i for e in got for i in (*e.ids, separator)], np.uint32), begin


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def encoder(path: str, cached: int) -> UnitIds:
    """One for a worker process; its cache outlives the task."""
    return held(f"units {path} {cached}", lambda: UnitIds(path, cached))
