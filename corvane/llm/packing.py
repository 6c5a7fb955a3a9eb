"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents above a third of the capacity go at most two to a sequence and are matched greedily, largest with the largest
that still fits; smaller ones go, largest first, into the fullest sequence with room. Only lengths decide, so the matching
is worked out on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus's size) and every piece then
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.store import settled

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Text with these characters only is split alike by every implementation of the split pattern.
ODD = re.compile("[^\n\x20-\x7e\xa1-\xac\xae-ſ–—‘’“”•…€]")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Text to ids (little-endian unsigned 32 bits) by a byte-level BPE file; remembers the ids of space-led chunks.

    No token spans the point before a single space that a non-space follows, so such chunks are encoded apart. Texts with
    characters or blanks for which that isn't certain go through the tokenizer whole.
    """

    MOST = 400_000

    def __init__(self, path: str):
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_of_char()
        ranks = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.loaded = path, None

    @property
    def whole(self):
        """The tokenizer itself; loaded by the first text that needs it."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        out = self[chunk] = pack(self.fast.encode_ordinary(chunk))
        return out

    def encode(self, text: str) -> bytes:
        if ODD.search(text) or any(s in text for s in self.special):
            return pack(self.whole.encode(text, add_special_tokens=False).ids)
        if "  " in text or " \n" in text or "\n " in text:
            return pack(self.fast.encode_ordinary(text))
        head, *rest = text.split(" ")
        return b"".join([self[head] if head else b"", *[self[" " + x] for x in rest]])


def pack(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; a worker outlives its tasks."""
    home = sys.modules.setdefault("_corvane_encoders", types.ModuleType("_corvane_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = Encoder(path)
    return home.__dict__[path]


def cut(path: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        coder, part, seen, last = encoder(path), TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + last
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if not piece else capacity
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    out.append((doc, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), part, nth))
                    start += length
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, pieces of this length in each sequence, offset of the first of them).

    Bins that are filled alike are one entry with a count; each length splits at most two entries, so the list stays
    within a small multiple of the number of lengths.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    left, rank, made = dict(counts), dict.fromkeys(counts, 0), 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, how many)
    free: list[int] = []

    def take(length: int, bins: int, each: int, first: int, offset: int) -> None:
        out.append((length, rank[length], rank[length] + bins * each, first, each, offset))
        rank[length] += bins * each
        left[length] -= bins * each

    def leave(space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append((first, bins))

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)), None)
            bins = left[s] if mate is None else left[s] // 2 if mate == s else min(left[s], left[mate])
            take(s, bins, 1, made, 0)
            if mate is not None:
                take(mate, bins, 1, made, s)
            leave(capacity - s - (mate or 0), made, bins)
            made += bins
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(free, s)
            if at < len(free):
                space = free[at]
                first, bins = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(at)
            else:
                space, first = capacity, made
                bins = -(-left[s] // (capacity // s))
                made += bins
            each = space // s
            whole = min(bins, left[s] // each)
            if whole:
                take(s, whole, each, first, capacity - space)
                leave(space - each * s, first, whole)
            rest = min(left[s], each - 1) if whole < bins else 0
            if rest:
                take(s, 1, rest, first + whole, capacity - space)
                leave(space - rest * s, first + whole, 1)
            leave(space, first + whole + (rest > 0), bins - whole - (rest > 0))
    return out



def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every row of ``docs`` (doc_id, text).

    A null or empty text is the end id alone. Longer documents are cut into pieces of ``capacity``, of which only the first
    may be shorter. Repeated rows are packed each for itself; ties by length are broken by partition and place. An empty
    table gives an empty result. The histogram brought to the driver has at most ``capacity`` rows, and the plan sent back
    a small multiple of that; the documents are tokenised once.
    """
    spark = docs.sparkSession
    pieces = settled(docs.select("doc_id", "text").mapInArrow(cut(tokenizer, capacity, end_id), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, first long, each long, at long")
    rank = F.col("before") + F.col("nth")
    placed = pieces.join(by_part, ["part", "length"]).withColumn("rank", rank)
    step = F.col("rank") - F.col("low")
    return (
        placed.join(F.broadcast(made), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).alias("offset"))
    )
