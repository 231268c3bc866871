"""Phrases of two to four words that belong together, from FM-indexes over word ids, one a shard.

Texts are cut into shards of one language.  A shard's text is the sequence of its words' ids with a 0 between pieces and in place of
every word that is too rare in the whole corpus to be in a candidate.  Its index holds the Burrows-Wheeler transform of the text
and of its reverse, sorted by `DEPTH - 1` words, which is all that phrases of `DEPTH` words need.  A phrase is a pair of
intervals, of its occurrences in the one and of its reverse's in the other.  Going through the symbols of an interval gives all
extensions to one side with their counts and both their intervals: to the left through the transform of the text, to
the right through that of the reverse (`extended`).

Rounds: words, then pairs (left extensions of words), triples (right extensions of pairs) and quadruples (left extensions of triples).
A round deals out the hashes of a shard's phrases, as steps from one to the next in byte planes, with their counts; ranges sum them.  Answers are
a bit a phrase, as a shard names its phrases in one order whenever it is asked, and the counts of those that survived.  Only what survived is extended in the next round, and only to phrases
whose other part survived too.  Each shard learns its survivors' counts, so one of them tells a phrase with the counts of its parts, its best cut
and the phrases that it drops.  A phrase's
longer candidates by one word are its extensions, so these sums also tell which phrases to drop: one that lies in a
longer candidate with most of its count lies in an extension with at least that count.

Scale: shards hold `shard_words` words; shards and indexes are tables in the shared folder, and a shard's answers are files there.  A frequent
word or phrase is one entry a shard in a round.  A range has about `range_rows` of these rows.  Scores are exact.
Words are told apart by 64-bit hashes of language and word, phrases by 64-bit hashes of these: two of the n of a round are one
with a chance of n**2 / 2**65.

Edge cases: null texts are empty, a null lang is `und`, also for rows that say so; repeated rows count again; a
language without candidates gives no rows; an empty table none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import discard, shared_dir, small_or_not, table
from harborline.llm.substring_dedup import spread, starts_of_runs
from harborline.llm.succinct import arrays_of, write_arrays
from harborline.llm.textblocks import hashes_of, lowered, mix, pieces

U64 = np.uint64
DEPTH = 4

_APART = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_APART[[0x20, 0x09]] = 1
_APART[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


@dataclass(frozen=True)
class Settings:
    least: int = 30  # occurrences of a candidate
    top: int = 2000  # rows of a language
    inside: int = 80  # per cent of a phrase's occurrences that a longer candidate has to hold to drop it
    shard_words: int = 1_000_000
    range_rows: int = 1_000_000


# ---- shards ----


def words_of(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, text, whether it begins a piece) of all words, and the bytes in lower case."""
    low, n = lowered(body), len(body)
    apart = np.full(n + 2, 2, np.uint8)
    apart[1:-1] = _APART[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    solid = apart == 0
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:n]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    marks = np.cumsum(apart[1:-1] == 2)
    new = np.append(True, (marks[starts[1:]] != marks[starts[:-1]]) | (text[1:] != text[:-1])) if len(starts) else np.zeros(0, bool)
    return hashes_of(low, starts, ends), starts, ends, new, low


def lang_key(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))



SHARD = "shard long, lang string, n_words long, keys binary, counts binary, sizes binary, spelled binary, tokens binary"
KEPT = "shard long, lang string, n_words long, keys binary, sizes binary, spelled binary"


def _shards(s: Settings):
    """A task's texts as shards of one language each."""

    def shard(number: int, lang: str, got: list[tuple]) -> pa.RecordBatch:
        h, new, keys, sizes, spelled = (np.concatenate(x) for x in zip(*got, strict=True))
        key, place, counts = np.unique(h, return_inverse=True, return_counts=True)
        _, one = np.unique(keys, return_index=True)
        begin = np.cumsum(sizes) - sizes
        tokens = np.zeros(len(h) + int(new.sum()) + 1, np.int32)
        tokens[np.arange(len(h)) + np.cumsum(new)] = place + 1
        cols = [number, lang, len(h), *(x.tobytes() for x in (mix(key ^ lang_key(lang)), counts.astype(np.int64), sizes[one].astype(np.int32), spelled[spread(begin[one], sizes[one])])), packed(tokens)]
        return pa.record_batch([pa.array([c]) for c in cols], names=[x.split()[0] for x in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, {}
        for b in batches:
            order = b.column("lang").to_numpy(zero_copy_only=False).astype(str)
            for lang in np.unique(order).tolist():
                for _, offsets, body in pieces(b.column("text").filter(pa.array(order == lang))):
                    h, starts, ends, new, low = words_of(offsets, body)
                    if not len(h):
                        continue
                    keys, first = np.unique(h, return_index=True)
                    sizes = (ends - starts)[first]
                    got = open_.setdefault(lang, [])
                    got.append((h, new, keys, sizes, low[spread(starts[first], sizes)]))
                    if sum(len(x[0]) for x in got) >= s.shard_words:
                        yield shard(number, lang, open_.pop(lang))
                        number += 1
        for lang, got in open_.items():
            yield shard(number, lang, got)
            number += 1

    return run


# ---- the index ----


def transform(text: np.ndarray, bits: int) -> np.ndarray:
    """The symbol before each suffix, in the order of the suffixes' first DEPTH - 1 symbols; the text begins and ends with 0."""
    long = np.append(text, np.zeros(DEPTH - 2, text.dtype)).astype(np.int64)
    n = len(text)
    if bits * (DEPTH - 1) < 64:
        key = np.zeros(n, np.int64)
        for k in range(DEPTH - 1):
            key = key << bits | long[k : n + k]
        order = np.argsort(key)
    else:
        order = np.lexsort([long[k : n + k] for k in range(DEPTH - 2, -1, -1)])
    return text[order - 1]  # before the first symbol comes the last, a 0


class Index:
    def __init__(self, forward: np.ndarray, reverse: np.ndarray, size: int):
        self.size, self.bits = size, max(1, int(len(forward)).bit_length())
        self.sides = forward, reverse
        self.before = np.append(0, np.cumsum(np.bincount(forward, minlength=size)))  # rows of smaller symbols
        self.sorted: list[np.ndarray | None] = [None, None]

    @staticmethod
    def of(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        bits = max(1, int(size).bit_length())
        return transform(text, bits), transform(text[::-1].copy(), bits)

    def words(self) -> Phrases:
        w = np.arange(1, self.size)
        low, high = self.before[w], self.before[w + 1]
        some = high > low
        return Phrases(w[some, None], (high - low)[some], [low[some], low[some]])

    def occurrences(self, side: int, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol comes before the row."""
        if self.sorted[side] is None:
            self.sorted[side] = self.sides[side].astype(np.int64) << self.bits | np.arange(len(self.sides[side]))
            self.sorted[side].sort()
        return np.searchsorted(self.sorted[side], symbol << self.bits | row) - self.before[symbol]

    def extended(self, p: Phrases, side: int, last: bool = False) -> Phrases:
        """All extensions by one word to the left (side 0) or right (side 1), with counts and both intervals (last: without)."""
        pair = np.repeat(np.arange(len(p.n)) * self.size, p.n)
        pair += self.sides[side][spread(p.low[side], p.n)]
        pair.sort()
        at = starts_of_runs(pair)
        n = np.diff(np.append(at, len(pair)))
        own, symbol = np.divmod(pair[at], self.size)
        smaller = at - (np.cumsum(p.n) - p.n)[own]
        good = symbol > 0
        own, symbol, n, smaller = own[good], symbol[good], n[good], smaller[good]
        ids = [symbol[:, None], p.ids[own]]
        ids = np.concatenate(ids if side == 0 else ids[::-1], 1)
        if last:
            return Phrases(ids, n, [n, n])
        low = [None, None]
        low[side] = self.before[symbol] + self.occurrences(side, symbol, p.low[side][own])
        low[1 - side] = p.low[1 - side][own] + smaller
        return Phrases(ids, n, low)


@dataclass
class Phrases:
    """ids (a row of word ids each), counts, and the first rows of their intervals on both sides (of no meaning after the last extension)."""

    ids: np.ndarray
    n: np.ndarray
    low: list[np.ndarray]

    def where(self, good: np.ndarray) -> Phrases:
        """Those that a mask or places choose."""
        return Phrases(self.ids[good], self.n[good], [x[good] for x in self.low])


def among(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which rows of ids are rows of some."""
    if not len(some) or not len(ids):
        return np.zeros(len(ids), bool)
    both = np.concatenate([some, ids])
    order = np.lexsort(both.T[::-1])
    new = np.append(True, (both[order[1:]] != both[order[:-1]]).any(1))
    group = np.empty(len(both), np.int64)
    group[order] = np.cumsum(new) - 1
    known = np.zeros(group.max() + 1, bool)
    known[group[: len(some)]] = True
    return known[group[len(some) :]]


def grown(index: Index, p: Phrases, survived: np.ndarray, last: bool = False) -> Phrases:
    """The phrases of one word more whose parts survived: pairs grow to the right, triples to the left.  p are the survivors, `survived` their ids."""
    right = p.ids.shape[1] == 2
    q = index.extended(p, 1 if right else 0, last)
    return q.where(among(q.ids[:, 1:] if right else q.ids[:, :-1], survived))


# ---- rounds ----

DEALT = "part int, shard long, hash binary, n binary"
ANSWER = "shard long, part int, bits binary, mine binary, n binary"


def each_row(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a shard's arrays are large."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def phrase_hash(keys: np.ndarray) -> np.ndarray:
    """64-bit names of phrases from their words' (a row each)."""
    h = keys[:, 0]
    for k in range(1, keys.shape[1]):
        h = mix(h) + keys[:, k]
    return mix(h)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted hashes): the order in which a shard names its phrases, the same whenever it is made."""
    h = phrase_hash(keys)
    order = np.argsort(h, kind="stable")
    return order, h[order]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes of equal weight, so that the planes that are mostly zeros compress away; empty high planes are left out."""
    planes = np.ascontiguousarray(x.astype(U64)).view(np.uint8).reshape(-1, 8)
    used = 1 + max((k for k in range(8) if planes[:, k].any()), default=0)
    return bytes([used]) + planes[:, :used].T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros(((len(x) - 1) // x[0], 8), np.uint8)
    out[:, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1).T
    return out.view(U64).ravel()


def by_part(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, last) of sorted hashes by their first bits."""
    part = (h >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
    edges = np.append(starts_of_runs(part), len(part))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), a, z


def _messages(shard: int, keys: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Whole hashes and counts."""
    order, h = in_order(keys)
    n = n[order].astype(np.int64)
    for part, a, z in by_part(h, bits):
        step = np.diff(h[a:z], prepend=U64(part) << U64(64 - bits) if bits else U64(0))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([shard]), pa.array([packed(step)]), pa.array([packed(n[a:z])])], names=["part", "shard", "hash", "n"])


def _summed(bits: int, least: int):
    """For each message, which of its phrases have `least` occurrences in all shards, how many, and which of them it is to tell."""

    def run(t: pa.Table) -> pa.Table:
        first = U64(t.column("part")[0].as_py()) << U64(64 - bits)
        h = [np.cumsum(unpacked(x), dtype=U64) + first for x in t.column("hash").to_pylist()]
        size, h = [len(x) for x in h], np.concatenate(h)
        n = np.concatenate([unpacked(x) for x in t.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        at = starts_of_runs(h[order])
        sums, one = np.empty(len(h), np.int64), np.zeros(len(h), bool)
        sums[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(h))))
        one[order[at]] = True
        good, out, a = sums >= least, [], 0
        for k in size:
            g = good[a : a + k]
            mine = one[a : a + k][g]
            out.append((np.packbits(g).tobytes(), np.packbits(mine).tobytes(), packed(sums[a : a + k][g])))
            a += k
        return pa.table({"shard": t.column("shard"), "part": t.column("part"), **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("bits", "mine", "n"))}})

    return run


def _write_answers(base: str, kind: str):
    """A shard's answers, one file; parts follow each other as its phrases do."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        packed = {c: [np.frombuffer(r[c], np.uint8) for r in rows] for c in ("bits", "mine")}
        arrays = {"part": np.array([r["part"] for r in rows], np.int32), "n": np.frombuffer(pa.compress(b"".join(unpacked(r["n"]).tobytes() for r in rows if r["n"]), "zstd", asbytes=True), np.uint8)}
        arrays["n_size"] = np.array([sum(len(unpacked(r["n"])) for r in rows if r["n"])])
        for c, x in packed.items():
            arrays |= {c: np.concatenate(x), f"{c}_size": np.array([len(k) for k in x], np.int64)}
        write_arrays(f"{base}/{kind}-{shard}", arrays)
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    return run


def _picked(answer: dict[str, np.ndarray] | None, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the sorted hashes were picked, which of the picked are mine)."""
    good, mine = np.zeros(len(h), bool), []
    if answer is None:
        return good, np.zeros(0, bool)
    at = {c: np.append(0, np.cumsum(answer[f"{c}_size"])) for c in ("bits", "mine")}
    place = {p: i for i, p in enumerate(answer["part"].tolist())}
    for part, a, z in by_part(h, bits):
        i = place[part]
        g = np.unpackbits(answer["bits"][at["bits"][i] : at["bits"][i + 1]], count=z - a).astype(bool)
        good[a:z] = g
        if at["mine"][-1]:
            mine.append(np.unpackbits(answer["mine"][at["mine"][i] : at["mine"][i + 1]], count=int(g.sum())).astype(bool))
    return good, np.concatenate(mine) if mine else np.zeros(0, bool)


def _survivors(base: str, words: int, shard: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the phrases of a round that survived, which of them this shard is to tell, and their counts in all shards."""
    answer = arrays_of(f"{base}/summed-{words}-{shard}")
    order, h = in_order(keys)
    good, mine = _picked(answer, h, bits)
    if answer is None:
        return order[good], mine, np.zeros(0, np.int64)
    n = np.frombuffer(pa.decompress(answer["n"].tobytes(), 8 * int(answer["n_size"][0]), "zstd", asbytes=True), np.int64)
    return order[good], mine, n


INDEX = "shard long, lang string, keys binary, counts binary, forward binary, reverse binary"


def _indexed(base: str, bits: int):
    """Each shard's index over its frequent words, with their counts in all shards; a word's id is its place among their hashes, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each_row(b):
                keys = np.frombuffer(r["keys"], U64)
                at, _, n = _survivors(base, 1, r["shard"], keys[:, None], bits)
                order = np.argsort(keys[at])
                at, n = at[order], n[order]
                ids = np.zeros(len(keys) + 1, np.int32)
                ids[1 + at] = np.arange(1, len(at) + 1)
                text = ids[unpacked(r["tokens"]).astype(np.int64)]
                text = np.append(text[(text > 0) | np.append(True, text[:-1] > 0)], np.int32(0))
                forward, reverse = Index.of(text, len(at) + 1)
                cols = [r["shard"], r["lang"], keys[at].tobytes(), n.tobytes(), packed(forward), packed(reverse)]
                yield pa.record_batch([pa.array([c]) for c in cols], names=["shard", "lang", "keys", "counts", "forward", "reverse"])

    return run


class Shard:
    """A shard's index and what survived in it, round by round; survivors are told once, by the first pass that needs them, and kept in a file."""

    def __init__(self, base: str, row: dict, bits: dict[int, int]):
        self.base, self.number, self.bits = base, row["shard"], bits
        self.keys = np.frombuffer(row["keys"], U64)
        self.index = Index(unpacked(row["forward"]).astype(np.int32), unpacked(row["reverse"]).astype(np.int32), len(self.keys) + 1)
        self.kept: dict[int, tuple[Phrases, np.ndarray, np.ndarray]] = {}

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return self.keys[ids - 1]

    def phrases(self, words: int, last: bool = True) -> Phrases:
        """All phrases of so many words whose parts survived."""
        if words == 2:
            return self.index.extended(self.index.words(), 0, last)
        p = self.survivors(words - 1)[0]
        return grown(self.index, p, p.ids, last)

    def survivors(self, words: int) -> tuple[Phrases, np.ndarray, np.ndarray]:
        """(phrases, counts in all shards, which of them this shard is to tell)."""
        if words not in self.kept:
            uri = f"{self.base}/survived-{words}-{self.number}"
            held = arrays_of(uri)
            if held is None:
                p = self.phrases(words, last=False)
                at, mine, n = _survivors(self.base, words, self.number, self.hashes(p.ids), self.bits[words])
                p = p.where(at)
                flat = np.concatenate([p.ids.ravel(), p.n, *p.low, n, mine]).astype(np.int64)
                write_arrays(uri, {"size": np.array([len(at)]), "packed": np.frombuffer(pa.compress(flat.tobytes(), "zstd", asbytes=True), np.uint8)})
            else:
                size = int(held["size"][0])
                flat = np.frombuffer(pa.decompress(held["packed"].tobytes(), 8 * size * (words + 5), "zstd", asbytes=True), np.int64)
                count, low, high, n, mine = flat[size * words :].reshape(5, size)
                p, mine = Phrases(flat[: size * words].reshape(size, words), count, [low, high]), mine > 0
            self.kept[words] = p, n, mine
        return self.kept[words]


def scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(2000000 a / (l + r)), exactly: in whole numbers of any size where products pass 63 bits."""
    if len(a) and int(a.max()) >= 1 << 42:
        a, left, right = (x.astype(object) for x in (a, left, right))
    return (2000000 * a // (left + right)).astype(np.int64)


def told(shard: Shard, word_counts: np.ndarray, inside: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(words' hashes, a, l, r, score) of the candidates that the shard is to tell, and at the end (hashes,) of phrases that its longer ones drop.

    A phrase's parts survived in every shard that holds it, so their counts are at hand.
    """
    f1 = np.append(0, word_counts)
    p2, n2, mine2 = shard.survivors(2)
    p3, n3, mine3 = shard.survivors(3)
    p4, n4, mine4 = shard.survivors(4)
    size = shard.index.size
    pair = p2.ids[:, 0] * size + p2.ids[:, 1]
    order2 = np.argsort(pair)
    at2 = lambda x, y: order2[np.searchsorted(pair, x * size + y, sorter=order2)]
    triple = at2(p3.ids[:, 0], p3.ids[:, 1]) * size + p3.ids[:, 2]
    order3 = np.argsort(triple)
    at3 = lambda x, y, z: order3[np.searchsorted(triple, at2(x, y) * size + z, sorter=order3)]
    dropped = []
    for p, n, mine in ((p2, n2, mine2), (p3, n3, mine3), (p4, n4, mine4)):
        ids, a = p.ids[mine], n[mine]
        if not len(a):
            continue
        w = list(ids.T)
        if len(w) == 2:
            cuts = [(f1[w[0]], f1[w[1]])]
        elif len(w) == 3:
            cuts = [(f1[w[0]], n2[at2(w[1], w[2])]), (n2[at2(w[0], w[1])], f1[w[2]])]
            subs = [(cuts[1][0], ids[:, :2]), (cuts[0][1], ids[:, 1:])]
        else:
            cuts = [(f1[w[0]], n3[at3(*w[1:])]), (n2[at2(w[0], w[1])], n2[at2(w[2], w[3])]), (n3[at3(*w[:3])], f1[w[3]])]
            subs = [(cuts[2][0], ids[:, :3]), (cuts[0][1], ids[:, 1:])]
        if len(w) > 2:
            dropped += [phrase_hash(shard.hashes(sub[100 * a >= inside * whole])) for whole, sub in subs]
        every = np.stack([scores(a, x, y) for x, y in cuts])
        best, row = every.argmin(0), np.arange(len(a))  # the first of equals
        left, right = np.stack([x for x, _ in cuts])[best, row], np.stack([y for _, y in cuts])[best, row]
        yield shard.hashes(ids), a, left, right, every[best, row]
    yield (np.unique(np.concatenate(dropped)) if dropped else np.zeros(0, U64),)


FOUND = "lang string, hash long, phrase array<long>, a long, l long, r long, score long"


def _told(base: str, bits: dict[int, int], inside: int):
    """Rows of candidates, and rows without a phrase for hashes of phrases to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            for r in each_row(b):
                if not r["keys"]:
                    continue
                for keys, *rest in told(Shard(base, r, bits), np.frombuffer(r["counts"], np.int64), inside):
                    none = [pa.nulls(len(keys), pa.int64())] * 4
                    if rest:
                        at = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                        cols = [pa.array([r["lang"]] * len(keys)), pa.array(phrase_hash(keys).view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel())), *map(pa.array, rest)]
                    else:
                        cols = [pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.list_(pa.int64())), *none]
                    yield pa.record_batch(cols, names=names)

    return run


def _spelled(base: str, bits: int):
    """key, word of the frequent words that the shard is to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each_row(b):
                keys, sizes, spelled = np.frombuffer(r["keys"], U64), np.frombuffer(r["sizes"], np.int32).astype(np.int64), r["spelled"]
                at, mine, _ = _survivors(base, 1, r["shard"], keys[:, None], bits)
                at, ends = at[mine] if len(mine) else at[:0], np.cumsum(sizes)
                word = [spelled[a:z].decode() for a, z in zip((ends - sizes)[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.record_batch([pa.array(keys[at].view(np.int64)), pa.array(word, pa.string())], names=["key", "word"])

    return run


def counted(docs: DataFrame, base: str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n of all words), rows of candidates and phrases to drop (FOUND), (key, word) of frequent words."""
    spark = docs.sparkSession
    used = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    used.mapInArrow(_shards(s), SHARD).write.option("compression", "zstd").parquet(f"{base}/shards")
    shards = spark.read.schema(SHARD).parquet(f"{base}/shards")
    n = shards.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    # ranges by the number of rows that a round may have
    bits = {k: max(3, int(np.ceil(np.log2(max(1, n / (8, 2, 16, 32)[k - 1] / s.range_rows))))) for k in range(1, DEPTH + 1)}

    def round_of(words: int, rows: DataFrame, phrases) -> None:
        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in each_row(b):
                    keys, counts = phrases(r)
                    if len(counts):
                        yield from _messages(r["shard"], keys, counts, bits[words])

        answers = rows.mapInArrow(sent, DEALT).groupBy("part").applyInArrow(_summed(bits[words], s.least), ANSWER)
        answers.groupBy("shard").applyInArrow(_write_answers(base, f"summed-{words}"), "n long").agg(F.sum("n")).first()

    def of_index(words: int):
        def phrases(r: dict) -> tuple[np.ndarray, np.ndarray]:
            if not r["keys"]:
                return np.zeros((0, words), U64), np.zeros(0, np.int64)
            shard = Shard(base, r, bits)
            p = shard.phrases(words)
            return shard.hashes(p.ids), p.n.astype(np.int64)

        return phrases

    round_of(1, shards.select("shard", "keys", "counts"), lambda r: (np.frombuffer(r["keys"], U64)[:, None], np.frombuffer(r["counts"], np.int64)))
    shards.select("shard", "lang", "keys", "tokens").mapInArrow(_indexed(base, bits[1]), INDEX).write.option("compression", "zstd").parquet(f"{base}/index")
    index = spark.read.schema(INDEX).parquet(f"{base}/index")
    # the sequences of words are in the index now; what else is needed of the shards is kept without them
    shards.select(*(x.split()[0] for x in KEPT.split(", "))).write.option("compression", "zstd").parquet(f"{base}/kept")
    discard(spark, f"{base}/shards")
    shards = spark.read.schema(KEPT).parquet(f"{base}/kept")
    for words in range(2, DEPTH + 1):
        round_of(words, index.select("shard", "keys", "forward", "reverse"), of_index(words))
    index.mapInArrow(_told(base, bits, s.inside), FOUND).write.parquet(f"{base}/found")
    spelled = shards.select("shard", "keys", "sizes", "spelled").mapInArrow(_spelled(base, bits[1]), "key long, word string")
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return totals, spark.read.schema(FOUND).parquet(f"{base}/found"), spelled


def ranked(totals: DataFrame, found: DataFrame, spelled: DataFrame, s: Settings) -> DataFrame:
    """The candidates that stay, first by score and count; words are looked up for those alone that may be among the first."""
    dropped = small_or_not(found.where("phrase is null").select("hash").distinct())
    live = found.where("phrase is not null").join(dropped, "hash", "left_anti")
    first = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    near = live.withColumn("_rank", first).where(F.col("_rank") <= s.top).select("lang", "hash", "phrase", "a", "l", "r", "score")
    word = near.select("lang", "hash", F.posexplode("phrase").alias("at", "key")).join(spelled, "key")
    text = word.groupBy("lang", "hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("spelled"))
    rows = near.join(text, ["lang", "hash"]).select("lang", F.col("spelled").alias("phrase"), "a", "l", "r", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= s.top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language of docs (lang, text)."""
    s = s or Settings()
    return ranked(*counted(docs, f"{shared_dir(docs.sparkSession)}/collocations-{uuid.uuid4().hex}", s), s)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return mined(table(spark, sf_dir, "documents"))


#: Pieces, phrases, cuts and ranks in DuckDB.
PHRASE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), seq AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM seq, range(1, 5) t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, COUNT(*)::HUGEINT AS f FROM grams GROUP BY ALL
), total AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cut AS (SELECT lang, k, phrase, a, c, array_to_string(w[1 : c], ' ') AS lp, array_to_string(w[c + 1 : k], ' ') AS rp FROM cand, range(1, 4) t(c) WHERE c < k
), scored AS (
  SELECT cut.lang, cut.k, cut.phrase, a, c, fl.f AS l, fr.f AS r, (2000000 * a) // (fl.f + fr.f) AS score
    FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.k = c AND fl.phrase = lp JOIN f fr ON fr.lang = cut.lang AND fr.k = cut.k - c AND fr.phrase = rp
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) AS o FROM scored) WHERE o = 1
), inner_ AS (
  SELECT lang, m AS k, array_to_string(w[i : i + m - 1], ' ') AS phrase, MAX(a) AS longest FROM cand, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
    FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.k = b.k AND i.phrase = b.phrase WHERE i.longest IS NULL OR 100 * i.longest < 80 * a
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
  FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
