"""Language-model scoring with an Elias-Fano trie of word n-grams (order 3).

Training counts words, then trigrams (from which bigrams and context totals follow), over all
training texts.  Probabilities are interpolated absolute discounting, every n-gram having a node:

    P(w | u v) = a(u v w) + g(u v) * (a(v w) + g(v) * P(w)),   P(w) = (c(w) + 1) / (N + V + 1)

with a = (count - D) / count of the context, and g the mass that is left.  a and g are quantised to 8 bits
apart, so the probabilities after one context sum to 1 only within that error; none exceeds 1.

The trie: level 1 is the sorted word hashes (a word's id is its place) and the running total of their counts;
levels 2 and 3 hold, for each context, its successors' ids, all as Elias-Fano sequences with monotone
pointers to the ranges of the contexts.  A lookup takes the context's range from the pointers and
searches the successor relative to the range's base.  Workers memory-map the files from the shared folder.

Scale: word u owns the stretch of its count in the running total of all counts, and bigram u v a place in it by a hash
of v.  Levels 2 and 3 are cut every `part_tokens` tokens of that total: rare words share a file, a frequent
word spreads over many.  One task merges the counts of one file and writes it, so its memory doesn't grow with the input
(one pair of words has at most as many successors as there are words).  The mass left after a word cut by
a file's border is summed over its files.  Files grow with the input, by a few bytes for each n-gram.  Ids are 32-bit: at most
4.29e9 distinct words.

Edge cases: null and empty texts are their end alone; without training rows V = N = 0 and every token has
probability 1; a null id counts as the empty id (crc32 0: training); repeated rows count and score
again; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import crc_of_id, held, kept, shared_dir, table
from harborline.llm.ngram_join import _planes, _unplanes
from harborline.llm.succinct import Monotone, map_arrays, write_arrays
from harborline.llm.textblocks import lowered, mix, pieces, words

U64 = np.uint64
END = U64(0x5E3C0A7B1D9F2468)  # stands for the end of a text among the word hashes
NONE = np.uint32(0xFFFFFFFF)  # no such word


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    block: int = 1_000_000  # tokens that a task gathers before it deals n-grams out
    shard_words: int = 4_000_000  # words in a file of level 1
    part_tokens: int = 3_000_000  # training tokens for each file of levels 2 and 3
    least_parts: int = 16  # files of levels 2 and 3 at least, so that several tasks make them
    piece: int = 1 << 22  # bytes of text scored at once


@dataclass(frozen=True)
class Model:
    base: str
    bits: int  # of the hash that name a file of level 1
    offsets: tuple[int, ...]  # first id of each of these files
    before: tuple[int, ...]  # tokens before each of these files
    step: int  # tokens for each file of levels 2 and 3
    tokens: int  # N
    words: int  # V
    made: frozenset[int] = frozenset()  # files of levels 2 and 3
    cut: tuple[tuple[int, ...], tuple[float, ...]] = ((), ())  # words that lie in several of them, ascending, and the mass of their bigrams


def sequences(texts: pa.Array, at_most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, where each text begins in them) with an end after each text's words."""
    for row, o, body in pieces(texts, at_most):
        w = words(o, lowered(body))
        n = len(o) - 1
        first = w.first + np.arange(n + 1)
        out = np.empty(len(w.hashes) + n, U64)
        last = np.zeros(len(out), bool)
        last[first[1:] - 1] = True
        out[last], out[~last] = END, w.hashes
        yield row, out, first


def _word_counts(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, n = [], 0
        done = lambda: (lambda u, c: pa.record_batch([pa.array(u.view(np.int64)), pa.array(c)], names=["hash", "n"]))(*np.unique(np.concatenate(texts), return_counts=True))
        for b in batches:
            for _, t, _ in sequences(b.column("text"), 1 << 21):
                texts.append(t)
                n += len(t)
                if n >= block:
                    yield done()
                    texts, n = [], 0
        if texts:
            yield done()

    return run


def _level_one(base: str):
    def run(t: pa.Table) -> pa.Table:
        hashes, n = t.column("hash").to_numpy().view(U64), t.column("n").to_numpy()
        order = np.argsort(hashes)
        shard, total = t.column("shard")[0].as_py(), np.append(0, np.cumsum(n[order]))
        write_arrays(f"{base}/words-{shard}", Monotone.pack(hashes[order], "hashes") | Monotone.pack(total, "totals"))
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": pa.array([len(n)], pa.int64()), "n": pa.array([int(total[-1])], pa.int64())})

    return run


class Vocabulary:
    """Ids, counts and places of words, through the mapped files of level 1."""

    def __init__(self, m: Model):
        self.m = m
        files = [map_arrays(f"{m.base}/words-{k}") if b > a else None for k, (a, b) in enumerate(zip(m.offsets[:-1], m.offsets[1:], strict=True))]
        self.hashes, self.totals = [f and Monotone(f, "hashes") for f in files], [f and Monotone(f, "totals") for f in files]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted hashes."""
        out = np.full(len(hashes), NONE, np.uint32)
        cuts = np.searchsorted(hashes, np.array([k << (64 - self.m.bits) for k in range(1, 1 << self.m.bits)], U64))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)):
            if a < b and self.hashes[k]:
                p = self.hashes[k].find(hashes[a:b])
                out[a:b] = np.where(p >= 0, p + self.m.offsets[k], int(NONE)).astype(np.uint32)
        return out

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens before, count) of sorted ids, NONE last with none."""
        before, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, np.array(self.m.offsets))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                i = ids[a:b].astype(np.int64) - self.m.offsets[k]
                low = self.totals[k].at(i).astype(np.int64)
                before[a:b], n[a:b] = low + self.m.before[k], self.totals[k].at(i + 1).astype(np.int64) - low
        return before, n


def places(before: np.ndarray, count: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
    """The file of bigrams u v: before and count are those of u."""
    share = (mix(v.astype(U64)) >> U64(12)).astype(float) / (1 << 52)
    return (before + np.minimum((count * share).astype(np.int64), np.maximum(count - 1, 0))) // step


def opened(m: Model) -> tuple[Vocabulary, dict[int, Part]]:
    """The model's files, mapped once in a worker; another model's are let go."""
    return held(f"lm {m.base}", lambda: (Vocabulary(m), {}))


def _trigrams(m: Model, s: Settings):
    """Texts to rows (file; u v, w and count of its distinct trigrams)."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        vocabulary = opened(m)[0]
        hashes = np.concatenate([t for t, _ in held])
        starts = np.zeros(len(hashes) + 2, bool)
        at = 0
        for t, first in held:
            starts[at + first[:-1]] = True
            at += len(t)
        known, inverse = np.unique(hashes, return_inverse=True)
        own = vocabulary.ids(known)
        before, count = vocabulary.counts(own)  # ids ascend as hashes do, and all are known
        i = np.flatnonzero(~starts[1 : len(hashes) + 1] & (np.arange(len(hashes)) < len(hashes) - 1))  # u and v in one text
        last = starts[i + 2] | (i + 2 >= len(hashes))
        u, v = inverse[i], own[inverse[i + 1]]
        w = np.where(last, NONE, own[inverse[np.minimum(i + 2, len(hashes) - 1)]])
        pair = (own[u].astype(U64) << U64(32)) | v
        order = np.lexsort((w, pair))
        pair, w, u, v = pair[order], w[order], u[order], v[order]
        cut = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (w[1:] != w[:-1]))[: len(pair)])
        n = np.diff(np.append(cut, len(pair))).astype(np.uint32)
        part = places(before[u[cut]], count[u[cut]], v[cut], m.step)
        order = np.argsort(part, kind="stable")
        pair, w, n, part = pair[cut][order], w[cut][order], n[order], part[order]
        edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
        rows: list[list] = [[], [], [], []]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for col, x in zip(rows, (int(part[a]), _planes(np.diff(pair[a:b], prepend=U64(0))), _planes(w[a:b]), _planes(n[a:b])), strict=True):
                col.append(x)
        return pa.record_batch([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["part", "pair", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, n = [], 0
        for b in batches:
            for _, t, first in sequences(b.column("text"), 1 << 21):
                texts.append((t, first))
                n += len(t)
                if n >= s.block:
                    yield flush(texts)
                    texts, n = [], 0
        if texts:
            yield flush(texts)

    return run


def _quantised(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """8-bit codes of logarithms: the nearest of 255 quantiles; code 0 is left for `nothing`."""
    logs = np.log10(np.maximum(values, 1e-30))
    book = np.unique(np.quantile(logs, (np.arange(255) + 0.5) / 255)) if len(logs) else np.zeros(1)
    code = np.clip(np.searchsorted((book[1:] + book[:-1]) / 2, logs), 0, len(book) - 1) + 1
    return {f"{name}.code": code.astype(np.uint8), f"{name}.book": np.append(0.0, 10.0**book)}


def _ranges(owner: np.ndarray, successor: np.ndarray, owners: int, name: str) -> dict[str, np.ndarray]:
    """Pointers to each owner's range, and its successors made monotone by the base of the range."""
    pointers = np.searchsorted(owner, np.arange(owners + 1))
    begin = pointers[:-1]
    some = pointers[1:] > begin
    top = np.zeros(owners, np.int64)
    top[some] = successor[pointers[1:][some] - 1].astype(np.int64) + 1
    base = np.cumsum(top) - top
    return Monotone.pack(pointers, f"{name}.at") | Monotone.pack(successor.astype(np.int64) + base[owner], f"{name}.next")


def _levels(m: Model, s: Settings):
    """One file of levels 2 and 3 from all counts of its bigrams and trigrams; returns the mass of words that other files share."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        read = lambda name, dtype: [_unplanes(x.as_py(), dtype) for x in t.column(name)]
        pair = np.concatenate([np.cumsum(x, dtype=U64) for x in read("pair", U64)])
        w, n = np.concatenate(read("w", np.uint32)), np.concatenate(read("n", np.uint32))
        del t
        order = np.lexsort((w, pair))
        pair, w, n = pair[order], w[order], n[order]
        del order
        at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])))
        n, pair, w = np.add.reduceat(n.astype(np.int64), at), pair[at], w[at]
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n2, two = np.add.reduceat(n, at), pair[at]
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(pair))))
        three = w != NONE
        of, w, n = of[three], w[three], n[three]
        del pair, three
        u, v = (two >> U64(32)).astype(np.int64), (two & U64(0xFFFFFFFF)).astype(np.int64)
        first = int(u[0])
        u -= first
        owners = int(u[-1]) + 1
        before, total = opened(m)[0].counts(np.arange(first, first + owners, dtype=np.uint32))
        mass = np.bincount(u, n2 - s.discount, owners)
        a3 = (n - s.discount) / n2[of]
        arrays = _ranges(u, v, owners, "two") | _ranges(of, w, len(two), "three") | {"first": np.array([first, owners], np.int64)}
        left = lambda held: np.maximum(1.0 - held, 0.0)
        for name, x in (("a2", (n2 - s.discount) / total[u]), ("a3", a3), ("g1", left(mass / np.maximum(total, 1))), ("g2", left(np.bincount(of, a3, len(two))))):
            arrays |= _quantised(x, name)
        write_arrays(f"{m.base}/ngrams-{part}", arrays)
        shared = np.flatnonzero((total > 0) & ((before < part * m.step) | (before + total > (part + 1) * m.step)))  # two at most
        return pa.table({"part": pa.array([part], pa.int64()), "words": pa.array([(first + shared).tolist()], pa.list_(pa.int64())), "mass": pa.array([mass[shared].tolist()], pa.list_(pa.float64()))})

    return run


class Part:
    """One file of levels 2 and 3."""

    def __init__(self, m: Model, k: int):
        a = map_arrays(f"{m.base}/ngrams-{k}")
        self.first, self.owners = (int(x) for x in a["first"])
        self.at = {x: Monotone(a, f"{x}.at") for x in ("two", "three")}
        self.next = {x: Monotone(a, f"{x}.next") for x in ("two", "three")}
        self.book = {x: (a[f"{x}.code"], a[f"{x}.book"]) for x in ("a2", "a3", "g1", "g2")}

    def value(self, name: str, i: np.ndarray) -> np.ndarray:
        code, book = self.book[name]
        return book[code[i]]

    def search(self, level: str, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The node of each (context, successor), or -1; NONE is no successor."""
        begin, end = self.at[level].at(context).astype(np.int64), self.at[level].at(context + 1).astype(np.int64)
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((begin < end) & (successor != int(NONE)))
        begin, end, values = begin[some], end[some], self.next[level]
        base = np.zeros(len(some), U64)
        # the base of a range is one more than the last value before it
        base[begin > 0] = values.at(begin[begin > 0] - 1) + U64(1)
        want = base + successor[some].astype(U64)
        place = values.successor(want)
        inside = np.flatnonzero(place < end)
        hit = inside[values.at(place[inside]) == want[inside]]
        out[some[hit]] = place[hit]
        return out


def log_probabilities(m: Model, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base log10, model log10) of every token of the texts."""
    vocabulary, files = opened(m)
    distinct, word = np.unique(t, return_inverse=True)
    own = vocabulary.ids(distinct)
    order = np.argsort(own, kind="stable")
    before, counts = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    before[order], counts[order] = vocabulary.counts(own[order])
    ids = own[word]
    p = (counts[word] + 1) / (m.tokens + m.words + 1)
    base = np.log10(p)
    begin = np.zeros(len(t), bool)
    begin[first[:-1]] = True
    at = np.flatnonzero(~begin)
    at = at[ids[at - 1] != NONE]
    pairs, i, back = np.unique((ids[at - 1].astype(U64) << U64(32)) | ids[at], return_index=True, return_inverse=True)
    u, v, left = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64), word[at[i] - 1]
    part = places(before[left], counts[left], v, m.step)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v, part, left, back = u[order], v[order], part[order], left[order], rank[back]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    # the context of a trigram is the node of the bigram before: keys ascend by the file of that bigram
    of = np.full(len(t), -1, np.int64)
    of[at] = back
    here = np.flatnonzero(~begin)
    here = here[of[here - 1] >= 0]
    keys, again = np.unique((of[here - 1].astype(U64) << U64(32)) | ids[here], return_inverse=True)
    context, w = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
    bounds = np.searchsorted(context, edges)
    node, a2, g1, g2 = np.full(len(u), -1, np.int64), np.zeros(len(u)), np.ones(len(u)), np.ones(len(u))
    a3 = np.zeros(len(keys))
    for x, y, lo, hi in zip(edges[:-1], edges[1:], bounds[:-1], bounds[1:], strict=True):
        k = int(part[x])
        if k not in m.made:
            continue
        if k not in files:
            files[k] = Part(m, k)
        f = files[k]
        mine = x + np.flatnonzero((u[x:y] >= f.first) & (u[x:y] < f.first + f.owners))
        g1[mine] = f.value("g1", u[mine] - f.first)
        node[mine] = got = f.search("two", u[mine] - f.first, v[mine])
        some = mine[got >= 0]
        a2[some], g2[some] = f.value("a2", node[some]), f.value("g2", node[some])
        i = lo + np.flatnonzero(node[context[lo:hi]] >= 0)
        if len(i):
            got = f.search("three", node[context[i]], w[i])
            a3[i[got >= 0]] = f.value("a3", got[got >= 0])
    if len(m.cut[0]):
        words_, mass = np.array(m.cut[0]), np.array(m.cut[1])
        i = np.minimum(np.searchsorted(words_, u), len(words_) - 1)
        cut = words_[i] == u
        g1[cut] = np.maximum(1.0 - mass[i[cut]] / counts[left[cut]], 0.0)
    p[at] = a2[back] + g1[back] * p[at]
    known = node[of[here - 1]] >= 0
    here, again = here[known], again[known]
    p[here] = a3[again] + g2[of[here - 1]] * p[here]
    return ids != NONE, base, np.log10(np.clip(p, 1e-300, 1.0))


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Train on all rows of docs (column text); the levels are files in the shared folder."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    counts = kept(docs.select("text").mapInArrow(_word_counts(s.block), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, v / s.shard_words)))))
    shard = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0)
    ones = {r.shard: r for r in counts.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(_level_one(base), "shard int, size long, n long").collect()}  # a row a file
    offsets, before = (tuple(int(x) for x in np.cumsum([0, *(getattr(ones.get(k), name, 0) for k in range(1 << bits))])) for name in ("size", "n"))
    m = Model(base, bits, offsets, before, max(1, -(-n // max(s.least_parts, -(-n // s.part_tokens)))), n, v)
    if not n:
        return m
    dealt = docs.select("text").mapInArrow(_trigrams(m, s), "part long, pair binary, w binary, n binary")
    made = dealt.groupBy("part").applyInArrow(_levels(m, s), "part long, words array<long>, mass array<double>").collect()  # a row a file, two words at most
    mass: dict[int, float] = defaultdict(float)
    for r in sorted(made):
        for word, x in zip(r.words, r.mass, strict=True):
            mass[word] += x
    return replace(m, made=frozenset(r.part for r in made), cut=(tuple(sorted(mass)), tuple(mass[k] for k in sorted(mass))))


def score_texts(docs: DataFrame, m: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)]
            for row, t, first in sequences(b.column("text"), s.piece):
                known, base, score = log_probabilities(m, t, first) if m.tokens else (np.zeros(len(t), bool), np.zeros(len(t)), np.zeros(len(t)))
                x = slice(row, row + len(first) - 1)
                cols[0][x] = np.diff(first)
                for col, v in zip(cols[1:], (known.astype(np.int64), base, score), strict=True):
                    col[x] = np.add.reduceat(v, first[:-1])
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, cols)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(7)) == 2
    m = fit(docs.where(~held))
    return score_texts(docs, m).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
