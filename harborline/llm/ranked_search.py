"""Top-k lexical search by the Best Position Algorithm over impact lists.

A document's score for an item is the sum, over the item's terms with repeats, of

    w * ((1000000000 * tf) div (1000 * tf + 8 * m)),   m = 100 - 75 + ((75 * n * N) div L),   w = floor(1000 * ln((2 N + 2) / (2 df + 1)))

The texts are cut into shards of documents.  One pass writes each shard's postings of the asked terms, and its part of N, L
and df, to the shared folder; these sums give weights and impacts.  In a shard every term has an impact list
(documents by falling impact) and direct access (the place of a document in a list).  For an item, lists are read from
the top side by side; each document met is looked up in all other lists, and every place so learnt counts as seen.  A list's best
position is the end of its seen stretch from the top.  No unmet document scores more than the sum of the lists' scores at their best
positions (0 for a list seen to its end); reading stops when the k-th best score lies above that sum, so ties
are read out and go to the smaller id.  Shards' top k are merged by a window per item.

Scale: a shard holds at most `shard_docs` documents or `shard_postings` postings, from one task's rows, and nothing but top
rows is shuffled.  Items are asked in blocks of about `item_bytes` text, so that the terms and weights sent to all tasks are bounded;
each block is one pass over the documents.  Terms are told apart by 64-bit hashes.

Edge cases: null texts have no terms, and items without terms no rows; a null id ranks after all others of its
score and stays null; rows of one id are ranked each for itself, also equal rows; rows of `items` too, those of one
item_id in one numbering; ids of documents are whole numbers, ids of items of any type; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import shared_dir, table
from harborline.llm.textblocks import hashes_of, lowered, pieces, raw

U64 = np.uint64
LAST = (1 << 63) - 1  # stands for a null id
SHARD = "ids binary, sizes binary, firsts binary, terms binary, tfs binary, n_docs long, n_terms long, seen binary, dfs binary"

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _a, _z in ("09", "AZ", "az"):
    _TERM[ord(_a) : ord(_z) + 1] = True


@dataclass(frozen=True)
class Settings:
    k: int = 10
    shard_docs: int = 16_384
    shard_postings: int = 2_000_000
    item_bytes: int = 8 << 20  # text of the items asked at once
    first_depth: int = 16  # places read from every list before the first stop test; doubled after each


def terms_of(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, where each text begins in them)."""
    low = lowered(body)
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _TERM[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return hashes_of(low, starts, ends), np.searchsorted(starts, offsets)


class Vocabulary:
    """The asked terms' hashes, ascending; a bitmap of their low bits sorts out most others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(16, int(len(hashes)).bit_length() + 6)
        self.some = np.zeros(1 << self.bits, bool)
        self.some[(hashes & U64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the vocabulary) of the terms that are asked."""
        at = np.flatnonzero(self.some[(h & U64((1 << self.bits) - 1)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[found] == h[at]
        return at[same], found[same]


def _shards(asked, s: Settings):
    """A task's rows as shards: postings by document, and the shard's share of the statistics."""

    def shard(got: list[tuple]) -> pa.RecordBatch:
        ids, sizes, counts, terms, tfs = (np.concatenate(x) for x in zip(*got, strict=True))
        some = counts > 0
        seen, dfs = np.unique(terms, return_counts=True)
        cols = [ids[some], sizes[some], np.append(0, np.cumsum(counts[some])), terms, tfs, int((sizes > 0).sum()), int(sizes.sum()), seen, dfs]
        return pa.record_batch([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x]) for x in cols], names=[x.split()[0] for x in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(np.frombuffer(asked.value, U64))
        got, docs, postings = [], 0, 0
        for b in batches:
            rank = b.column("rank").to_numpy()
            for row, offsets, body in pieces(b.column("text")):
                n = len(offsets) - 1
                h, first = terms_of(offsets, body)
                at, term = vocabulary.find(h)
                doc = np.searchsorted(first, at, "right") - 1
                key, tf = np.unique(doc * max(1, len(vocabulary.hashes)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(vocabulary.hashes)))
                got.append((rank[row : row + n], np.diff(first), np.bincount(doc, minlength=n), term.astype(np.int32), tf.astype(np.int32)))
                docs, postings = docs + n, postings + len(term)
                if docs >= s.shard_docs or postings >= s.shard_postings:
                    yield shard(got)
                    got, docs, postings = [], 0, 0
        if got:
            yield shard(got)

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for seen, dfs in zip(b.column("seen").to_pylist(), b.column("dfs").to_pylist(), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(seen, np.int32)), pa.array(np.frombuffer(dfs, np.int64))], names=["term", "df"])


class Impacts:
    """Impact lists of a shard's terms, with direct access by document."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        read = lambda c, d: np.frombuffer(row[c], d)
        self.ids, size, tf, term = read("ids", np.int64), read("sizes", np.int64), read("tfs", np.int32).astype(np.int64), read("terms", np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(read("firsts", np.int64)))
        m = 25 + (75 * size * n_docs) // max(1, n_terms)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(order))
        line = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        self.width = max(1, len(self.ids))
        key = line * self.width + self.doc
        self.place = np.argsort(key)
        self.key = key[self.place]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of terms the shard has, their lists)."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        good = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return good, at[good]

    def direct(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(there, place): for each document and list, whether it is in the list and where."""
        asked = (docs[:, None] + lists * self.width).reshape(-1)
        at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        there = self.key[at] == asked
        return there.reshape(len(docs), -1), self.place[at].reshape(len(docs), -1)


def best_positions(x: Impacts, lists: np.ndarray, weight: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, places read in turn) of a shard's k best for one item, by falling score, then id."""
    start, size = x.first[lists], np.diff(x.first)[lists]
    offset = np.append(0, np.cumsum(size))
    seen = np.zeros(offset[-1] + len(size), bool)  # one place that is never seen after each list
    offset = offset[:-1] + np.arange(len(size))
    met = np.zeros(len(x.ids), bool)
    best = np.zeros(len(size), np.int64)  # the first place not seen
    docs, scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while True:
        upto = np.minimum(size, read + depth)
        turn = np.concatenate([x.doc[a + min(read, n) : a + n] for a, n in zip(start.tolist(), upto.tolist(), strict=True)])
        new = np.unique(turn[~met[turn]])
        read, depth = read + depth, 2 * depth
        if len(new):
            met[new] = True
            there, place = x.direct(lists, new)
            scores = np.append(scores, np.where(there, x.impact[place] * weight, 0).sum(1))
            docs = np.append(docs, new)
            seen[(place - start + offset)[there]] = True
        for i, (a, n, b) in enumerate(zip(offset.tolist(), size.tolist(), best.tolist(), strict=True)):
            best[i] = b + int(np.argmin(seen[a + b : a + n + 1]))
        bound = int((np.where(best < size, x.impact[start + np.maximum(best, 1) - 1], 0) * weight).sum())
        if bound == 0 or (len(scores) >= k and int(np.partition(scores, -k)[-k]) > bound):
            break
    good = np.flatnonzero(scores > 0)
    if len(good) > k:
        good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
    good = good[np.lexsort((x.ids[docs[good]], -scores[good]))][:k]
    return docs[good], scores[good], read


def _search(asked, weights, n_docs: int, n_terms: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, keys, first, terms, times = weights.value, *asked.value
        for b in batches:
            for row in b.to_pylist():
                x = Impacts(row, n_docs, n_terms)
                out = [], [], []
                for i, key in enumerate(keys.tolist()):
                    t, q = terms[first[i] : first[i + 1]], times[first[i] : first[i + 1]]
                    good, lists = x.lists(t)
                    w = weight[t[good]] * q[good]
                    if (w > 0).any():
                        docs, scores, _ = best_positions(x, lists[w > 0], w[w > 0], s.k, s.first_depth)
                        for o, v in zip(out, (np.full(len(docs), key), x.ids[docs], scores), strict=True):
                            o.append(v)
                if out[0]:
                    yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["key", "rank_id", "score"])

    return run


def search(items: DataFrame, docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) of each row of items (item_id, text)."""
    s = s or Settings()
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    base = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.monotonically_increasing_id()).write.parquet(f"{base}/items")
    items = spark.read.parquet(f"{base}/items")
    used = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // s.item_bytes))
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).select("key", "text").toArrow()
        h, first = terms_of(*raw(own.column("text")))
        vocabulary, term = np.unique(h, return_inverse=True)
        pair, times = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * max(1, len(vocabulary)) + term, return_counts=True)
        item, term = np.divmod(pair, max(1, len(vocabulary)))
        cut = np.searchsorted(item, np.arange(len(first)))
        used.mapInArrow(_shards(sc.broadcast(vocabulary.tobytes()), s), SHARD).write.parquet(f"{base}/shards-{k}")
        shards = spark.read.schema(SHARD).parquet(f"{base}/shards-{k}")
        n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        dfs = shards.select("seen", "dfs").mapInArrow(_term_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row an asked term at most
        weight = np.zeros(len(vocabulary), np.int64)
        for t, df in zip(dfs.column("term").to_pylist(), dfs.column("df").to_pylist(), strict=True):
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        asked = sc.broadcast((own.column("key").to_numpy(), cut, term, times))
        got = shards.drop("n_docs", "n_terms", "seen", "dfs").mapInArrow(_search(asked, sc.broadcast(weight), n_docs, n_terms, s), "key long, rank_id long, score long")
        found = got if found is None else found.unionByName(got)
    order = [F.desc("score"), "rank_id"]
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= s.k)
    several = Window.partitionBy("item_id").orderBy("key", "rank")
    doc_id = F.when(F.col("rank_id") != LAST, F.col("rank_id")).cast(kind)
    return top.join(items.select("key", "item_id"), "key").select("item_id", F.row_number().over(several).alias("rank"), doc_id.alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


#: Terms, statistics and scores in DuckDB.
SEARCH_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (SELECT item_id, term, COUNT(*) AS q FROM item GROUP BY ALL
), whole AS (SELECT COUNT(*) FILTER (len(t) > 0) AS big_n, SUM(len(t))::BIGINT AS big_l FROM doc
), posting AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM doc
), tf AS (SELECT r, doc_id, n, term, COUNT(*) AS tf FROM posting GROUP BY ALL
), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term
), w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM df, whole
), scored AS (
  SELECT item_id, r, doc_id, SUM(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN w USING (term), whole GROUP BY ALL
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
