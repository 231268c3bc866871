"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds the rank of a pair of neighbours (and its place, so that ties go left);
the root is the next merge.  A merge changes three leaves, each repaired in logarithmic time, until no
pair can be merged.  A worker keeps the ids of the pre-tokens it has met, up to a bound.

Edge cases: null and empty texts have no ids; special tokens' strings become their id, as in the
library's defaults; a pre-token of any length costs n log n; equal texts give equal rows; ids of any type stay as they are; repeated
rows are coded each for itself; other columns are ignored.  Workers read the vocabulary at the path that the driver resolves.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from harborline.llm.common import held, table
from harborline.llm.packing import vocabulary

#: Fixed value: the published pattern that cuts text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Children of a tree node, and the value of a leaf without a merge.
FAN, NONE = 16, 1 << 62


@dataclass(frozen=True)
class Settings:
    tokenizer: str = "byte_bpe_50k.json"
    cached: int = 1 << 19  # pre-tokens whose ids a worker keeps
    cached_chars: int = 64  # of a pre-token that is kept


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, s: Settings):
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"]["vocab"]
        symbols = byte_symbols()
        value = {c: b for b, c in enumerate(symbols)}
        self.first = [vocab[c] for c in symbols]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in said["added_tokens"])]))
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(said["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank << 32, vocab[a + b])
        self.cut = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.settings, self.known = s, {}

    def merged(self, token: str) -> list[int]:
        """Ids of one pre-token, by a segment tree whose nodes have FAN children."""
        first = self.first
        ids = [first[b] for b in token.encode()]
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        leaves = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            m = get(left << 32 | right)
            leaves.append(NONE if m is None else m[0] | (i - 1))
            left = right
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        top, upper = levels[-1], levels[1:]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) != NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            new = get(ids[i] << 32 | ids[j])[1]
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            p = before[i]
            leaves[i] = NONE
            if k < n:
                leaves[j] = NONE  # the pair that began at j is gone
                before[k] = i
                m = get(new << 32 | ids[k])
                if m is not None:
                    leaves[i] = m[0] | i
            if p >= 0:
                m = get(ids[p] << 32 | new)
                leaves[p] = NONE if m is None else m[0] | p
            if upper:
                for at in (i, j, p):
                    if 0 <= at < n - 1:
                        below = leaves
                        for level in upper:
                            at //= FAN
                            least = min(below[at * FAN : at * FAN + FAN])
                            if level[at] == least:
                                break
                            level[at] = least
                            below = level
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
        known, tokens = self.known, self.cut(text)
        try:
            return b"".join(map(known.__getitem__, tokens))
        except KeyError:
            pass
        out = []
        for t in tokens:
            x = known.get(t)
            if x is None:
                x = np.array(self.merged(t), "<u4").tobytes()
                if len(t) <= self.settings.cached_chars:
                    if len(known) >= self.settings.cached:
                        known.clear()
                    known[t] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.around is None or not any(t in text for t in self.special):
            return self.plain(text)
        return b"".join(self.special[t].to_bytes(4, "little") if t in self.special else self.plain(t) for t in self.around(text) if t)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def coder(path: str, s: Settings) -> Bpe:
    """One for a worker process; its cache outlives the task."""
    return held(f"bpe {path} {s}", lambda: Bpe(path, s))


def encoded(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (the text read back from them)."""
    path = vocabulary(s.tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, s)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [bpe.encode(t or "") for t in some.column("text").to_pylist()]
                yield pa.record_batch([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of `encoded`, taken where the ids are made."""
    path = vocabulary(s.tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, s)
        for b in batches:
            n, one, two = [], [], []
            for t in b.column("text").to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
