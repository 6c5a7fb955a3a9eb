"""Substring de-duplication by suffix automata over shards of reference passages.

A window (``window`` consecutive words) is kept in the document with the least doc_id that has it and removed elsewhere.

1. Anchors. Every window holds a run of ``window // 2`` words whose hash is least in it, so equal windows share an anchor.
   Anchors of two documents or more are set in a bitmap of fixed size.
2. Windows with such an anchor are grouped by their hash, within each task first; the least (doc_id, place) owns the window.
   What recurs of an owner makes its reference passages.
3. Reference passages are sharded by owner, and every shard becomes a suffix automaton whose states know the least document
   they occur in. The automaton goes to as many tasks as the documents to be streamed past it ask for; these are the
   documents that have a window owned in the shard, whole. Their matching statistics give the maximal spans of at least
   ``window`` words that a lesser document has, on the words themselves. Sending every shard past every document, the plain
   form of this method, would take the square of the corpus.
4. The spans of all shards go back to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bitmaps import bitmap_of, members, opened
from corvane.llm.store import settled
from corvane.llm.words import BASE, U, Words, grams, mix, slabs

BITS = 26
NOWHERE = 1 << 63


def least_in_windows(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(least run hash, document) of every window, in order of place."""
    run = window // 2
    g, doc = grams(h, words.first, run)
    span = window - run + 1
    low, width = g.copy(), 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        width += step
    n = len(low)
    same = doc[:n] == doc[len(doc) - n :] if n else np.zeros(0, bool)
    return low[same], doc[:n][same]


def anchors(window: int):
    def run(batches):
        for batch in batches:
            for at, _, words in slabs(batch, "text", False):
                low, doc = least_in_windows(words, words.hashes(), window)
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), batch.column(0).take(pa.array(doc[new] + at))], names=["anchor", "doc_id"])

    return run


def shared_anchors(docs: DataFrame, window: int) -> bytes:
    """The bitmap of anchors that two documents have; 8 MB at most whatever the input, and only a filter."""
    rows = docs.mapInArrow(anchors(window), "anchor long, doc_id long")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    return bitmap_of(shared, BITS)


def likely_windows(window: int, packed: bytes, most: int = 150_000):
    """Rows of kind 0: windows that may recur elsewhere; of equal ones at hand together only that of the least doc_id. Of kind 1:
    the runs of the others, whose owner is at hand. So however often a passage recurs, its windows travel once for about every
    ``most`` windows read, and tasks hold no more than that."""

    def combined(held):
        h, doc, body, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, body, doc, h))
        h, doc, body, place = (x[order] for x in (h, doc, body, place))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        owner = np.flatnonzero(new)[np.cumsum(new) - 1]
        kept, rest = np.flatnonzero(new), np.flatnonzero(doc[owner] < doc)
        yield windows_batch(h[kept], doc[kept], body[kept], place[kept])
        if len(rest):
            rest = rest[np.lexsort((place[rest], body[rest], doc[rest]))]
            d, t, p, o, u, q = doc[rest], body[rest], place[rest], doc[owner[rest]], body[owner[rest]], place[owner[rest]]
            follows = (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (o[1:] == o[:-1]) & (u[1:] == u[:-1]) & (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
            at = np.flatnonzero(np.concatenate([[True], ~follows]))
            anywhere = mix(d[at].astype(np.uint64) * U(BASE) + p[at].astype(np.uint64))
            yield windows_batch(anywhere, d[at], t[at], p[at], np.diff(np.append(at, len(d))).astype(np.int32), o[at], u[at], q[at])

    def run(batches):
        bitmap, held, n = opened(packed), [], 0
        for batch in batches:
            for at, _, words in slabs(batch, "text", False):
                h = words.hashes()
                low, doc = least_in_windows(words, h, window)
                some = np.flatnonzero(members(bitmap, low))
                if len(some):
                    whole, _ = long_grams(h, words.first, window)
                    place = some - np.searchsorted(doc, np.arange(len(words)))[doc[some]]
                    row = pa.array(doc[some] + at)
                    held.append((whole[some], batch.column(0).take(row).to_numpy(), batch.column(2).take(row).to_numpy(), place.astype(np.int32)))
                    n += len(some)
                if n >= most:
                    yield from combined(held)
                    held, n = [], 0
        if held:
            yield from combined(held)

    return run


def windows_batch(h, doc, body, place, n=None, owner=None, owner_body=None, owner_start=None) -> pa.RecordBatch:
    size = len(h)
    or_null = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x)
    cols = [pa.array(np.full(size, 0 if n is None else 1, np.int32)), pa.array(h.view(np.int64)), pa.array(doc), pa.array(body), pa.array(place), or_null(n, pa.int32()), or_null(owner, pa.int64()), or_null(owner_body, pa.int64()), or_null(owner_start, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in WINDOWS.split(", ")])


WINDOWS = "kind int, hash long, doc_id long, body long, start int, n int, owner long, owner_body long, owner_start int"


def long_grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """grams() for long runs: doubles the length hashed instead of adding word by word."""
    part, width, power = h.copy(), 1, BASE
    bits = bin(k)[3:]
    for bit in bits:
        part = part[:-width] * U(power) + part[width:] if len(part) > width else part[:0]
        width, power = 2 * width, power * power % (1 << 64)
        if bit == "1":
            part = part[:-1] * U(BASE) + h[width : width + len(part) - 1] if len(part) > 1 else part[:0]
            width, power = width + 1, power * BASE % (1 << 64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(len(h) - k + 1, 0)
    same = doc[:n] == doc[len(doc) - n :] if n else np.zeros(0, bool)
    return mix(part[:n][same]), doc[:n][same]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passages(batches):
    """Ranges ordered by owner and start, joined where they meet: a passage for each stretch of an owner that recurs."""
    last = None
    for batch in batches:
        doc, body, low, high = (batch.column(i).to_numpy() for i in range(4))
        if last is not None:
            doc, body, low, high = (np.concatenate(x) for x in zip(last, (doc, body, low, high), strict=True))
        if not len(doc):
            continue
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (body[1:] != body[:-1])])
        reach = np.maximum.accumulate((np.cumsum(new) << 32) + high) & 0xFFFFFFFF
        first = np.flatnonzero(new | np.concatenate([[True], low[1:] > reach[:-1]]))
        doc, body, low, high = doc[first], body[first], low[first], reach[np.append(first[1:] - 1, len(reach) - 1)].astype(np.int32)
        last = doc[-1:], body[-1:], low[-1:], high[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (doc, body, low, high)], names=["doc_id", "body", "low", "high"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["doc_id", "body", "low", "high"])


def passage_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "body", "low", "high"])


SORTED = "doc_id long, body long, words long, text binary, digest string"
SORTED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())


def sorted_out(packed: bytes):
    """Rows whose doc_id may be concerned keep their text; the others are done: their number of words and their words' digest."""

    def run(batches):
        bitmap = opened(packed)
        for batch in batches:
            some = members(bitmap, batch.column(3).to_numpy().view(np.uint64))
            out = []
            for doc, text, body, concerned in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), some.tolist(), strict=True):
                text = (text.as_py() or "").encode()
                words = text.split()
                out.append((doc, body, len(words), text if concerned else None, None if concerned else hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, SORTED_TYPES, strict=True)], names=[f.split()[0] for f in SORTED.split(", ")])

    return run


PIECES = "kind int, shard long, doc_id long, body long, words long, text binary"
PIECE_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def pieces(batches):
    """Of a concerned row one of kind 1 with the whole text for every shard it must be streamed past, and of kind 0 its own
    passages that recur elsewhere, for their shard."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    for batch in batches:
        out, size = [], 0
        for doc, text, body, n, shards, refs, home in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            words = text.split() if refs else None
            for r in refs or ():
                out.append((0, home, doc, body, r["high"] - r["low"], b" ".join(words[r["low"] : r["high"]])))
            for shard in shards or ():
                out.append((1, shard, doc, body, n, text))
            size += len(text) * (1 + len(shards or ()))
            if len(out) >= 2000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, PIECE_TYPES, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_TYPES, strict=True)], names=names)


class SuffixAutomaton:
    """All substrings of the word sequences added, in states with transitions, suffix links, longest lengths, and the least
    document that has the substring."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        self.least = [NOWHERE]

    def add(self, words: list[bytes], doc: int = 0) -> None:
        last = 0
        for w in words:
            last = self.extend(last, w)
            if doc < self.least[last]:
                self.least[last] = doc

    def extend(self, last: int, w: bytes) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        if w in nxt[last]:
            q = nxt[last][w]
            return q if longest[q] == longest[last] + 1 else self.clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        self.least.append(NOWHERE)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if longest[q] == longest[p] + 1 else self.clone(p, w, q)
        return new

    def clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        self.least.append(NOWHERE)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def settle(self, window: int) -> None:
        """Once all is added: the least document of every state, and for each state that of its suffix of ``window`` words."""
        order = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        least, link = self.least, self.link
        for s in reversed(order):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]
        self.first = least[:]
        for s in order:
            if link[s] > 0 and self.longest[link[s]] >= window:
                self.first[s] = self.first[link[s]]

    def spans(self, words: list[bytes], window: int, doc: int = NOWHERE) -> list[tuple[int, int]]:
        """Maximal ranges of words under windows that a document below ``doc`` has, from the matching statistics."""
        nxt, link, longest, first = self.next, self.link, self.longest, self.first
        out: list[tuple[int, int]] = []
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                length = longest[state]
            to = nxt[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            if length >= window:
                while longest[link[state]] >= window and length <= longest[link[state]]:
                    state = link[state]
                if first[state] < doc:
                    a = i + 1 - window
                    if out and a <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((a, i + 1))
        return out


def matched(window: int):
    """Rows ordered by shard, share and kind to the spans of the documents; one automaton at a time."""

    def run(batches):
        key, automaton, ready = None, SuffixAutomaton(), False
        for batch in batches:
            out = []
            for shard, share, kind, doc, body, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, share) != key:
                    key, automaton, ready = (shard, share), SuffixAutomaton(), False
                words = text.split()
                if not kind:
                    automaton.add(words, doc)
                else:
                    if not ready:
                        automaton.settle(window)
                        ready = True
                    out += [(doc, body, a, b) for a, b in automaton.spans(words, window, doc)]
            yield passage_batch(out)

    return run


REMOVED = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def trimmed(batches):
    """(doc_id, n_words, digest, text, ranges) to the removed words' number, the kept words' digest and the ranges."""
    for batch in batches:
        out = []
        for doc, n, digest, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            gone = merged([(r["low"], r["high"]) for r in ranges or ()])
            if text is not None:
                words, kept, at = text.split(), [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                digest = hashlib.sha256(b" ".join(kept + words[at:])).hexdigest()
            out.append((doc, n, sum(b - a for a, b in gone), digest, [{"low": a, "high": b} for a, b in gone]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), REMOVED)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def with_bodies(docs: DataFrame) -> DataFrame:
    """doc_id, text, body: what tells apart rows with one doc_id, a hash of the text; 0 where the doc_id is the row's alone."""
    docs = docs.select("doc_id", "text")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return docs.withColumn("body", F.lit(0).cast("long"))
    return docs.join(again, "doc_id", "left").select("doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("body"))


def remove_repeats(docs: DataFrame, window: int = 50, shard_words: int = 60_000, share_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (array of word ranges) of every row of ``docs`` (doc_id, text).

    Words are compared as they are. A word goes if a ``window`` over it also starts in a document with a smaller doc_id, on
    the input. Null, empty and blank texts have no words. Rows with the same doc_id are judged each by its own text, and none
    by the others; rows without a doc_id stay whole and are nobody's reference. What a document repeats of itself stays. An
    empty table gives an empty result; further columns are ignored. Hashes only choose which shards a document is streamed
    past: what is removed is what their automata match.
    """
    docs = with_bodies(docs)
    packed = shared_anchors(docs, window)
    seen = docs.where("doc_id is not null").mapInArrow(likely_windows(window, packed), WINDOWS)
    first = F.min(F.struct("doc_id", "start", "body")).over(Window.partitionBy("kind", "hash"))
    at = F.when(F.col("kind") == 0, F.col("o"))
    owner = [F.coalesce(at["doc_id"], "owner").alias("owner"), F.coalesce(at["body"], "owner_body").alias("owner_body")]
    begin, n = F.coalesce(at["start"], "owner_start"), F.coalesce("n", F.lit(1))
    owned = seen.withColumn("o", first).where((F.col("kind") == 1) | (F.col("o.doc_id") < F.col("doc_id")))
    found = owned.select("doc_id", "body", *owner, begin.alias("low"), (begin + n + (window - 1)).alias("high")).groupBy("doc_id", "body", "owner", "owner_body").agg(F.min("low").alias("low"), F.max("high").cast("int").alias("high"))
    found = settled(found, "found")

    ranges = found.select(F.col("owner").alias("doc_id"), F.col("owner_body").alias("body"), "low", "high").distinct()
    refs = settled(ranges.repartition("doc_id").sortWithinPartitions("doc_id", "body", "low").mapInArrow(passages, "doc_id long, body long, low int, high int"), "passages")
    total = refs.agg(F.sum(F.col("high") - F.col("low"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    shard = lambda doc, body: F.pmod(F.xxhash64(doc, body), F.lit(shards))
    concerned = bitmap_of(found.select("doc_id").union(found.select("owner")).distinct().select(F.xxhash64("doc_id")), 24)
    rows = settled(docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(sorted_out(concerned), SORTED), "rows")
    past = found.select("doc_id", "body", shard("owner", "owner_body").alias("shard")).distinct().groupBy("doc_id", "body").agg(F.collect_list("shard").alias("shards"))
    refs = refs.groupBy("doc_id", "body").agg(F.collect_list(F.struct("low", "high")).alias("refs"))
    texts = rows.where("text is not null")
    # the same kind of join at every size: a side that is small now would be sent to all tasks
    known = texts.join(past.hint("merge"), ["doc_id", "body"], "left").join(refs.hint("merge"), ["doc_id", "body"], "left").where("shards is not null or refs is not null")
    parts = settled(known.select("doc_id", "text", "body", "words", "shards", "refs", shard("doc_id", "body").alias("home")).mapInArrow(pieces, PIECES), "pieces")

    shares = parts.where("kind = 1").groupBy("shard").agg(F.ceil(F.sum("words") / share_words).cast("int").alias("shares"))
    share = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "body"), F.col("shares")).cast("int")))
    dealt = parts.join(shares, "shard").select("shard", F.explode(share).alias("share"), "kind", "doc_id", "body", "text")
    hits = dealt.repartition("shard", "share").sortWithinPartitions("shard", "share", "kind").mapInArrow(matched(window), "doc_id long, body long, low int, high int")
    spans = hits.groupBy("doc_id", "body").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<low:int,high:int>>"
    touched = texts.join(spans.hint("merge"), ["doc_id", "body"], "left").select("doc_id", F.col("words").alias("n_words"), "digest", "text", "ranges").mapInArrow(trimmed, schema)
    rest = rows.where("text is null").select("doc_id", F.col("words").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.array().cast("array<struct<low:int,high:int>>").alias("removed"))
    return touched.union(rest)
