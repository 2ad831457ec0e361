"""Byte-level BPE encoding and decoding (operator 1).

A text of up to CHUNK characters is encoded where it is read. A longer one is
cut into chunks that overlap; the chunks are pre-tokenised in parallel, and two
neighbours are stitched at the first boundary of the overlap that both scans
share: the pattern only looks forward, so from a true boundary on every later
one is true. The stitched positions cut the text into pieces that are encoded
in parallel and joined again in order. Decoding concatenates raw bytes.

The pattern must start a match at every white space after something else, as
that of public_tokenizers does: `certain` rests on it.

Defined results: a null text counts as empty (no ids, hash of nothing); rows
that repeat are each returned; lone surrogates are encoded as U+FFFD, as the
tokeniser library does. Further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices

CHUNK = 32_768
OVERLAP = 512
#: A boundary this close to a chunk's end may be owed to the cut: the longest look forward is three characters.
MARGIN = 3
#: Distinct pre-tokens whose ids a Python worker remembers.
REMEMBERED = 200_000


class Known(dict):
    """Ids of the pre-tokens met so far, merged when first asked for; emptied at REMEMBERED entries."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(utf8(piece)))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def utf8(piece: str) -> bytes:
    """The bytes of piece, U+FFFD for lone surrogates."""
    try:
        return piece.encode()
    except UnicodeEncodeError:
        return piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


class Codec:
    """Ranks of one vocabulary file with the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.none = max(self.ranks.values(), default=0) + 1
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.single = [bytes((i,)) for i in range(256)]
        self.find = regex.compile(pattern).finditer
        self.pieces = regex.compile(pattern).findall
        self.known = Known(self.merge)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: join the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > 256:
            return self._merge_long(data)
        rank, none = self.ranks.get, self.none
        parts = [self.single[b] for b in data]
        # pair[i] is the rank of parts i and i + 1 together; a join changes its two neighbours only.
        pair = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pair and (best := min(pair)) != none:
            i = pair.index(best)
            parts[i] = joined = parts[i] + parts[i + 1]
            del parts[i + 1], pair[i]
            if i:
                pair[i - 1] = rank(parts[i - 1] + joined, none)
            if i < len(pair):
                pair[i] = rank(joined + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges from a heap over a linked list, for pre-tokens of any length."""
        import heapq

        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (r, i, joined + part[k]))
            if (h := left[i]) >= 0 and (r := ranks.get(part[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, part[h] + joined))
        return [ranks[p] for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of text that don't end in white space: a cut there changes neither side."""
        return np.fromiter((e for m in self.find(text) if not text[(e := m.end()) - 1].isspace()), np.int64)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def digest(c: Codec, ids) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def certain(text: str, ends: np.ndarray) -> int | None:
    """The first boundary that holds whatever comes before: white space after something else."""
    for e in ends.tolist():
        if 0 < e < len(text) and text[e].isspace() and not text[e - 1].isspace():
            return e
    return None


def stitch(chunks: list[tuple[int, list[int], list[int], int | None]], step: int) -> list[int]:
    """Positions, 0 first, where a text can be cut between pre-tokens.

    chunks: by number, the boundaries near a chunk's start and near its end (in
    the whole text), and its first certain boundary. A chunk is trusted from the
    boundary that it shares with the trusted part of the chunk before it.
    """
    cuts, trusted = [0], 0
    before: list[int] = []
    for k, (_, head, tail, sure) in enumerate(chunks):
        if k:
            shared = sorted(set(head) & {b for b in before if trusted is not None and b >= trusted})
            trusted = shared[0] if shared else sure
            if trusted is not None and trusted > cuts[-1]:
                cuts.append(trusted)
        before = tail
    return cuts


def _scan(path: str, pattern: str, step: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "part"):
            heads, tails, sures = [], [], []
            for k, part, last in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), b.column("last").to_pylist(), strict=True):
                ends = c.boundaries(part)
                if not last:
                    ends = ends[ends <= len(part) - MARGIN]
                at = k * step
                sure = certain(part, ends)
                heads.append((ends[ends < overlap] + at).tolist())
                tails.append((ends[ends >= step] + at).tolist())
                sures.append(None if sure is None else sure + at)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("k"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), pa.array(sures, pa.int64())],
                ["key", "k", "head", "tail", "sure"],
            )

    return run


def _encode(path: str, pattern: str, keys: list[str], as_digest: bool, types: dict[str, pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "text"):
            out = [b.column(k) for k in keys]
            ids = (c.encode(t or "") for t in b.column("text").to_pylist())
            if as_digest:
                rows = [digest(c, i) for i in ids]
                out += [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out.append(pa.array([np.asarray(i, np.int32).tobytes() for i in ids], pa.binary()))
                names = ["ids"]
            yield pa.RecordBatch.from_arrays(out, keys + names)

    return run


def segments(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n, seg, text): the pieces of the texts of docs (key, n, text), cut between pre-tokens."""
    step = chunk - overlap
    last = F.ceil((F.length("text") - F.lit(overlap)) / F.lit(step)).cast("int") - 1
    parts = docs.select("key", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("k"), F.greatest(last, F.lit(0)).alias("top"), "text")
    parts = parts.select("key", "k", (F.col("k") == F.col("top")).alias("last"), F.substring(F.col("text"), F.col("k") * step + 1, F.when(F.col("k") == F.col("top"), F.lit(2**31 - 1)).otherwise(F.lit(chunk))).alias("part"))
    scanned = mapped(parts.repartition("key", "k"), _scan(path, pattern, step, overlap), "key string, k int, head array<long>, tail array<long>, sure long")
    gathered = scanned.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "head", "tail", "sure"))).alias("chunks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [stitch([(x["k"], x["head"], x["tail"], x["sure"]) for x in row], step) for row in b.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(cuts, pa.list_(pa.int64()))], ["key", "cuts"])

    cuts = mapped(gathered, cut, "key string, cuts array<long>")
    whole = docs.join(cuts, "key")
    spread = whole.select("key", "n", F.posexplode(F.col("cuts")).alias("seg", "at"), "cuts", "text")
    size = F.coalesce(F.try_element_at("cuts", F.col("seg") + 2), F.lit(2**31 - 1)) - F.col("at")
    return spread.select("key", "n", "seg", F.substring(F.col("text"), (F.col("at") + 1).cast("int"), F.least(size, F.lit(2**31 - 1)).cast("int")).alias("text"))


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row of docs; see the module's text for edge cases."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ddl = rows.schema["id"].dataType.simpleString()
    out = f"id {ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = mapped(rows.where(~is_long), _encode(path, pattern, ["id"], True, {}), out)
    # One row for each distinct long text of an id, with the times it occurs.
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")))
    held = rows.where(is_long).select("id", key.alias("key"), "text").groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n"))
    parts = segments(held.select("key", "n", "text"), path, pattern, chunk, overlap)
    coded = mapped(parts.repartition("key", "seg"), _encode(path, pattern, ["key", "n", "seg"], False, {}), "key string, n long, seg int, ids binary")
    whole = coded.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("seg", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            got = []
            for row in b.column("parts"):
                ids = np.frombuffer(b"".join(x["ids"] for x in row.as_py()), np.int32).tolist()
                got.append(digest(c, ids))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), *(pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["key", "n", "n_tokens", "ids_sha256", "decoded_sha256"])

    long = mapped(whole, join, "key string, n long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    ids = rows.where(is_long).select("id", key.alias("key")).distinct()
    long = long.join(ids, "key").select("id", "n_tokens", "ids_sha256", "decoded_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
    return short.union(long).withColumnRenamed("id", id_col)


def decode_column(ids: DataFrame, path: str, pattern: str, id_col: str, ids_col: str) -> DataFrame:
    """(id, data binary): the raw bytes of int32 id arrays in binary form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            got = [c.decode(np.frombuffer(x or b"", np.int32).tolist()) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], ["id", "data"])

    kind = ids.schema[id_col].dataType.simpleString()
    return mapped(ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("x")), run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
