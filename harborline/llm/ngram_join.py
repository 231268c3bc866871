"""Exact Jaccard join of documents on word 5-grams, by vertical partitioning.

1. Every text becomes its set of 5-word shingles (64-bit hashes).  Texts with equal sets form one node;
   one text of each node goes on.
2. Shingles are dealt by hash range.  Each range counts in how many texts a shingle occurs and sends
   back only the shared ones; the global order is (frequency, hash), rarest first.  A block of texts
   names a shingle that several of its texts have once, with a count, and keeps its own list of these texts, so
   that a range sees at most `often` entries of one shingle for each block.
3. A node whose rarest `n - ceil(0.8 n) + 1` shingles are all unshared can't link (prefix filter).
   For the others these prefixes are posted by shingle.
4. Overlaps are counted vertically: the global order is cut into fragments, each fragment of a pair
   counts its own overlap, and the partial overlaps are summed per pair.
5. Large groups are never expanded into all pairs.  Star rounds verify one pair per node (with the hub
   that most of its prefix names) and merge nodes into components, until nothing new links; the exact
   round then verifies every candidate pair that still lies in two components, so no link between
   components is lost.

Sets are named by 64-bit hashes without comparison; shingles by 64 bits while they are counted and by their
frequency and 48 bits afterwards.  The order is by the exact frequency below 2**14 texts and by steps of 0.14 % above (`rarity`);
any order keeps all links, this one keeps prefixes rare.  There are at most 2**30 hash ranges, which then grow with the input.

Edge cases: null and wordless texts have an empty set and link with nothing (component_id is their own
id); texts of 1 to 4 words are one shingle; equal texts share a component; a null id is reported
with the component of its text, or null; several rows of one id are separate rows, each with the component
of its own text; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from harborline.llm.common import kept, let_go, small_or_not, table
from harborline.llm.textblocks import lowered, mix, pieces, windows, words

#: 64-bit words of a node's parity map of shared shingles.
MAP_WORDS = 16
#: Stands for the texts that a block keeps its own list of.
ALL = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    size: int = 5  # words in a shingle
    percent: int = 80  # least similarity
    block: int = 1 << 19  # shingles that a task gathers before it deals them out
    often: int = 4  # texts of a block that share a shingle and are named by the block itself
    range_size: int = 1_000_000  # shingles in a hash range, about
    fragments: int = 8  # vertical cuts of the global order
    rounds: int = 2  # star rounds at most, before the exact one


def sets_of(o: np.ndarray, body: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    w = words(o, lowered(body))
    run, of = windows(w.hashes, w.first, size, short=True)
    at = np.searchsorted(of, np.arange(len(o)))
    for i in range(len(o) - 1):
        yield np.unique(run[at[i] : at[i + 1]])


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    a, b = mix(s).sum(dtype=np.uint64), (mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(mix(np.array([a], np.uint64) + mix(np.array([b ^ np.uint64(len(s))], np.uint64))).view(np.int64)[0])


def nodes(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            sets = [(len(x), node_of(x) if len(x) else None) for _, o, body in pieces(b.column("text")) for x in sets_of(o, body, s.size)]
            yield pa.record_batch([b.column("doc_id"), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())], names=["doc_id", "n_shingles", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high bytes of differences of sorted values compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(x: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


#: A row of a block and a hash range, or (meta) of the block itself.
DEALT = "part int, block long, meta boolean, docs binary, toks binary, counts binary"
ASKED = "block long, meta boolean, docs binary, toks binary, counts binary"


def _deal(s: Settings, bits: int):
    """Texts to rows of (hash range, block): the block's shingles of that range and whose they are.

    The meta row of a block has its nodes and set sizes, and the texts of the shingles that `often` texts of it share;
    its range gets such a shingle with a count and no text.
    """
    names = ["part", "block", "meta", "docs", "toks", "counts"]

    def flush(block: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int64)
        toks = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(toks, kind="stable")
        toks, docs = toks[order], docs[order]
        at = np.flatnonzero(np.append(True, toks[1:] != toks[:-1]))
        df = np.diff(np.append(at, len(toks)))
        own = np.repeat(df >= s.often, df)
        kept_here = np.concatenate([toks[own], docs[own].astype(np.uint64)])
        single = ~own
        single[at[df >= s.often]] = True
        counts = np.ones(len(toks), np.uint32)
        counts[at[df >= s.often]] = df[df >= s.often]
        docs[own] = ALL
        toks, docs, counts = toks[single], docs[single], counts[single]
        ranges = (toks >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(toks))
        meta = (np.array([node_of(x) for x in sets], np.int64).tobytes(), sizes.tobytes(), kept_here.tobytes())
        rows: list[list] = [[block % (1 << bits)], [block], [True], *([x] for x in meta)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = counts[a:b] if (counts[a:b] > 1).any() else counts[:0]
            for col, v in zip(rows, (int(ranges[a]), block, False, _planes(docs[a:b]), _planes(np.diff(toks[a:b], prepend=np.uint64(0))), some.tobytes()), strict=True):
                col.append(v)
        return pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), *(pa.array(x, pa.binary()) for x in rows[3:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for _, o, body in pieces(b.column("text")):
                for x in sets_of(o, body, s.size):
                    if len(x):
                        held.append(x)
                        n += len(x)
                    if n >= s.block:
                        yield flush(block, held)
                        block, held, n = block + 1, [], 0
        if held:
            yield flush(block, held)
        held.clear()
        let_go()

    return run


def rarity(df: np.ndarray) -> np.ndarray:
    """15 bits that rise with the frequency: itself under 2**14, above it 512 steps for each doubling, up to 2**46 texts."""
    steps = np.floor((np.log2(np.maximum(df, 1 << 14)) - 14) * 512).astype(np.int64)
    return np.where(df < 1 << 14, df, (1 << 14) + np.minimum(steps, (1 << 14) - 1))


def order_key(toks: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Places in the global order: the frequency, then 48 bits of the hash."""
    return (rarity(df) << 48) | (toks >> np.uint64(16)).astype(np.int64)


def _shared(t: pa.Table) -> pa.Table:
    """One hash range: sends each block its shingles that other texts have too, as keys of the global order.

    A shingle that the block keeps a list for comes back as the pair of its hash and its key.
    """
    cols = {k: t.column(k).to_pylist() for k in ("block", "meta", "docs", "toks", "counts")}
    of = [i for i, m in enumerate(cols["meta"]) if not m]
    out = {k: [x for x, m in zip(v, cols["meta"], strict=True) if m] for k, v in cols.items()}
    if of:
        toks = [np.cumsum(_unplanes(cols["toks"][i], np.uint64), dtype=np.uint64) for i in of]
        docs = np.concatenate([_unplanes(cols["docs"][i], np.uint32) for i in of])
        n = np.concatenate([np.frombuffer(c, np.uint32) if (c := cols["counts"][i]) else np.ones(len(x), np.uint32) for i, x in zip(of, toks, strict=True)]).astype(np.int64)
        row = np.repeat(np.arange(len(of)), [len(x) for x in toks])
        all_toks = np.concatenate(toks)
        order = np.argsort(all_toks, kind="stable")
        ranked = all_toks[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        df, entries = np.add.reduceat(n[order], at), np.diff(np.append(at, len(ranked)))
        keep = np.repeat(df >= 2, entries)
        key = order_key(ranked[keep], np.repeat(df, entries)[keep])
        chosen = order[keep]
        by_row = np.argsort(row[chosen], kind="stable")
        chosen, key = chosen[by_row], key[by_row]
        cuts = np.searchsorted(row[chosen], np.arange(len(of) + 1))
        for i, r in enumerate(of):
            mine, keys = chosen[cuts[i] : cuts[i + 1]], key[cuts[i] : cuts[i + 1]]
            if len(mine):
                whole = docs[mine] == ALL
                pairs = np.concatenate([all_toks[mine[whole]], keys[whole].view(np.uint64)])
                for k, v in (("block", cols["block"][r]), ("meta", False), ("docs", docs[mine[~whole]].tobytes()), ("toks", keys[~whole].tobytes()), ("counts", pairs.tobytes())):
                    out[k].append(v)
        del toks, docs, all_toks, order, ranked, chosen, key
    let_go()
    return pa.table({"block": pa.array(out["block"], pa.int64()), "meta": pa.array(out["meta"], pa.bool_()), **{k: pa.array(out[k], pa.binary()) for k in ("docs", "toks", "counts")}})


def _prefixes(percent: int):
    """One block: its texts whose prefix holds shared shingles."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        head = next(r for r in rows if r["meta"])
        node, n = np.frombuffer(head["docs"], np.int64), np.frombuffer(head["toks"], np.int64)
        rows = [r for r in rows if not r["meta"]]
        docs = [np.frombuffer(r["docs"], np.uint32) for r in rows]
        keys = [np.frombuffer(r["toks"], np.int64) for r in rows]
        # the texts of the shingles that the block has a list for
        own = np.frombuffer(head["counts"], np.uint64).reshape(2, -1)
        named = [np.frombuffer(r["counts"], np.uint64).reshape(2, -1) for r in rows]
        if own.shape[1]:
            toks, their = np.concatenate([x[0] for x in named]), np.concatenate([x[1] for x in named]).view(np.int64)
            order = np.argsort(toks)
            docs.append(own[1].astype(np.uint32))
            keys.append(their[order[np.searchsorted(toks, own[0], sorter=order)]])
        docs, keys = np.concatenate(docs or [np.zeros(0, np.uint32)]), np.concatenate(keys or [np.zeros(0, np.int64)])
        order = np.lexsort((keys, docs))
        docs, keys = docs[order], keys[order]
        shared = np.bincount(docs, minlength=len(n))
        k = shared - ((n * percent + 99) // 100) + 1  # n - ceil(0.8 n) + 1, less the unshared ones
        good = k > 0
        at = np.append(0, np.cumsum(shared[good])).astype(np.int32)
        chosen = keys[good[docs]]
        toks = pa.ListArray.from_arrays(pa.array(at), pa.array(chosen))
        bits = np.zeros((int(good.sum()), MAP_WORDS), np.uint64)
        np.bitwise_xor.at(bits, (np.repeat(np.arange(len(bits)), shared[good]), (chosen >> 6) % MAP_WORDS), np.uint64(1) << (chosen & 63).astype(np.uint64))
        bits = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).reshape(-1)), MAP_WORDS).cast(pa.list_(pa.int64()))
        return pa.table({"node": pa.array(node[good]), "n": pa.array(n[good]), "k": pa.array(k[good]), "toks": toks, "bits": bits})

    return run


def prefixed(docs: DataFrame, all_nodes: DataFrame, s: Settings) -> DataFrame:
    """node, n (set size), k (shared shingles in the prefix), toks (its shared shingles in the global order),
    bits (the parity of its shared shingles in each of 64 * MAP_WORDS cells)."""
    total = all_nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = min(30, max(6, int(np.ceil(np.log2(max(1, total / s.range_size))))))
    known = all_nodes.where("node is not null and doc_id is not null")
    first = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # ids that stand first for no text; an id with several texts stays if one of them needs it
    copies = known.select("doc_id").distinct().join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    texts = docs.select("doc_id", "text").join(small_or_not(copies), "doc_id", "left_anti")
    dealt = texts.mapInArrow(_deal(s, bits), DEALT)
    back = dealt.groupBy("part").applyInArrow(_shared, ASKED)
    near = back.groupBy("block").applyInArrow(_prefixes(s.percent), "node long, n long, k long, toks array<long>, bits array<long>")
    return near.dropDuplicates(["node"])


def overlaps(near: DataFrame, pairs: DataFrame, cuts: list[int], s: Settings) -> DataFrame:
    """Links among pairs (a, b): partial overlaps of each fragment of the global order, summed per pair."""
    edges = [-1, *cuts, (1 << 63) - 1]
    between = lambda lo, hi: F.filter("toks", lambda t: (t > lo) & (t <= hi))
    parts = F.array(*(between(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)))
    cut = near.select("node", "n", F.posexplode(parts).alias("fragment", "part")).where(F.size("part") > 0)
    one = cut.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    two = cut.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("part_b"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("part"))
    whole = partial.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("part").alias("overlap"))
    return whole.where(100 * F.col("overlap") >= s.percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) for every id in edges (a, b)."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots, moved = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), 1
    while moved:
        seen = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("least"))
        low = roots.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "least").alias("root"), F.col("root").alias("was"))
        jump = low.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = kept(low.join(jump, "root").select("id", F.col("next").alias("root"), "was"))
        moved, roots = new.where("root <> was").count(), new.select("id", "root")
    return roots


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) after the links (a, b) between nodes."""
    of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    roots = components(edges).withColumnRenamed("id", "comp")
    return kept(comps.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def linked(near: DataFrame, s: Settings) -> DataFrame:
    """node, comp of the nodes in near, by star rounds and an exact round."""
    postings = near.select("node", "n", F.size("toks").alias("shared"), F.posexplode(F.slice("toks", F.lit(1), F.col("k").cast("int"))).alias("at", "tok"))
    cuts = near.select(F.explode("toks").alias("t")).agg(F.percentile_approx("t", F.lit([i / s.fragments for i in range(1, s.fragments)]), F.lit(1000))).first()[0]
    cuts = sorted(set(cuts or []))
    comps = near.select("node", F.col("node").alias("comp"))

    def mixed() -> DataFrame:
        """Postings of the shingles that still lie in several components, with the main one."""
        own = postings.join(comps, "node")
        sizes = own.groupBy("tok", "comp").agg(F.count("*").alias("rows"))
        most = sizes.groupBy("tok").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("rows", "comp")).alias("most")).where("comps > 1")
        return kept(own.join(most.select("tok", "most"), "tok"))

    for r in range(s.rounds):
        own = mixed()
        # nodes with few shingles of their own are central in their group
        rank = F.struct(F.ceil(F.log2(1 + F.col("n") - F.col("shared"))).alias("own"), F.xxhash64("node", F.lit(r)).alias("hash"))
        best_of = lambda c: F.min(F.when(c, F.struct(rank.alias("rank"), "node", "comp", "n")))
        main, other = best_of(F.col("comp") == F.col("most")), best_of(F.col("comp") != F.col("most"))
        hubs = own.groupBy("tok").agg(main.alias("main"), other.alias("other"))
        # members of the main component ask the best other node, all others ask the best node of the main component
        asked = own.join(hubs, "tok").withColumn("hub", F.when(F.col("comp") == F.col("most"), F.col("other")).otherwise(F.col("main")))
        fits = (F.col("n") * 100 >= s.percent * F.col("hub.n")) & (F.col("hub.n") * 100 >= s.percent * F.col("n"))
        votes = asked.where(fits).groupBy("comp", F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("votes"))
        best = votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"), F.max("votes").alias("votes"))
        links = kept(overlaps(near, best.select("a", "b"), cuts, s))
        if links.isEmpty():
            break
        comps = merged(comps, links)

    # candidates that still lie in two components: all but those between members of a shingle's main component
    own = mixed().join(near.select("node", "bits"), "node")
    side = lambda x: [F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "comp", "at", "shared", "bits"))]
    few, rest = own.where("comp <> most").select("tok", *side("a")), own.select("tok", "most", *side("b"))
    # at the first shingle that a pair shares, both still have room for the overlap that the pair needs
    room = F.least(F.col("shared_a") - F.col("at_a"), F.col("shared_b") - F.col("at_b"))
    # shingles in cells of unlike parity are not shared: an upper bound of the overlap
    unlike = sum(F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(MAP_WORDS))
    able = (
        (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("most")) | (F.col("a") < F.col("b")))
        & (room * (100 + s.percent) >= s.percent * (F.col("n_a") + F.col("n_b")))
        & ((F.col("shared_a") + F.col("shared_b") - unlike) * (100 + s.percent) >= 2 * s.percent * (F.col("n_a") + F.col("n_b")))
    )
    pairs = few.join(rest, "tok").where(able).select("a", "b").distinct()
    return merged(comps, kept(overlaps(near, pairs, cuts, s)))


def placed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, node, comp (a node's name for its group), component_id for every row of docs."""
    all_nodes = kept(nodes(docs, s))
    near = kept(prefixed(docs, all_nodes, s))
    comps = linked(near, s)
    least = all_nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of = least.join(comps, "node", "left")
    roots = of.where("comp is not null").groupBy("comp").agg(F.min("least").alias("root"))
    named = of.join(roots, "comp", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("root", "least").alias("component_id"))
    return all_nodes.join(named, "node", "left").select(
        "doc_id", "n_shingles", "node", "comp", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    return placed(docs, s).select("doc_id", "n_shingles", "component_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def with_nodes(docs: DataFrame, s: Settings) -> DataFrame:
    """docs with the column `_node_of_text` after its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [node_of(x) if len(x) else None for _, o, body in pieces(b.column("text")) for x in sets_of(o, body, s.size)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sets, pa.int64())], names=[*b.schema.names, "_node_of_text"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node_of_text", LongType())]))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs less all but one row of each component: one row of its smallest id stays (rows without an id: only
    where the component has no other); rows without words all stay."""
    found = kept(placed(docs, s))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = found.where("comp is not null").groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    groups = found.join(best, "comp")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1")
    if repeated.isEmpty():
        gone = groups.where(F.col("doc_id") != F.col("best.doc_id")).select("doc_id")
        return docs.join(small_or_not(gone), "doc_id", "left_anti").select(docs.columns)
    # rows whose id does not name one text are told apart by their sets
    odd = kept(repeated.select(F.col("doc_id").alias("_id")))
    is_odd = docs["doc_id"].eqNullSafe(odd["_id"])
    gone = groups.where(F.col("doc_id") != F.col("best.doc_id")).join(odd, F.col("doc_id") == F.col("_id"), "left_anti").select("doc_id")
    plain = docs.join(odd, is_odd, "left_anti").join(small_or_not(gone), "doc_id", "left_anti").select(docs.columns)
    lost = groups.where(~rank.eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")).distinct()
    rest = with_nodes(docs.join(odd, is_odd, "left_semi").select(docs.columns), s)
    rest = rest.join(lost, rest["doc_id"].eqNullSafe(lost["_id"]) & (rest["_node_of_text"] == lost["_of"]), "left_anti")
    once = rest.where("_node_of_text is not null").dropDuplicates(["doc_id", "_node_of_text"])
    return plain.unionByName(once.unionByName(rest.where("_node_of_text is null")).select(docs.columns))
