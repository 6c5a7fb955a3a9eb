"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens: lower-cased words and one end. Every token is coded by at most three binary decisions: is it
one that has followed the previous token before; if not, one that has followed the last short word before; if not, one that
occurs at all. The first that holds is followed by the token's share of the counts in that context, and a token that no
context knows is spelled in bytes. Each decision is predicted by several hashed contexts (how often the context was seen with
the outcomes of the tokens before, those outcomes alone, the counts of both contexts, the previous token with the last
outcome): their log-odds are added with weights that a gate chooses by the decision and the last outcome, and a logistic
function makes a probability of the sum (logistic mixing). The weights start from those learned over all training
documents and are corrected after every ``CHUNK`` tokens of the document being scored, from decisions already coded only.
The bits of spelled words are mixed in the same way from the one to four bytes before. Probabilities are proper: over all texts
they add up to at most one. A training document is scored by the counts of all others, its own are taken off.

Counts of tokens and contexts grow with the corpus, so they stay distributed: documents lie in chunks of bounded size, each
chunk sends the sorted hashes it needs to the task that keeps that range of hashes, and gets the totals back in that order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.store import dropped, settled
from corvane.llm.words import U, Words, mix, slabs

SHORT = 3  # bytes of a word that serves as the sparse context
TOKEN_BITS = 63
BYTE_SLOTS = 21
BLOCK = 1 << 14
BYTE_INPUTS, BYTE_GATES = 5, 5
CHUNK = 64
PIECE = 2 << 20
#: Bytes of text behind one task's file of an intermediate table. Each file costs the executor forks of its JVM.
SHARE = 32 << 20
START, END = np.array([0x7374617274, 0x656E64656E64], np.uint64)
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
NONE = 31  # bucket of a context that was never seen
LEVELS, OUTCOMES, PREVIOUS = 3, 4, 1 << 10
SIZES = (LEVELS * 32 * 5 * 5, LEVELS * 5**4, LEVELS * 32 * 32, LEVELS * PREVIOUS * 5)
INPUTS, GATES = len(SIZES) + 1, LEVELS * 5
TOKENS, CONTEXTS = 0, 1


# chunks of documents


def chunked(batches):
    """Documents in chunks of about ``PIECE`` bytes: (chunk, compressed rows)."""
    done = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, rows, _ in slabs(batch, "text", True, PIECE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(at, rows))
            yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "body"])
            done += 1


def opened(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, document, word place or -1) with an end after each document's words."""
    h, n = words.hashes(), words.count
    doc = np.repeat(np.arange(len(words)), n + 1)
    place = np.arange(len(doc)) - doc
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(n + 1) - 1] = False
    token = np.full(len(doc), END)
    token[inner] = h
    return token, doc, np.where(inner, place, -1)


class Events:
    """Tokens of a chunk with the token before, the last short word before, and the keys of what is counted."""

    def __init__(self, words: Words, bits: int):
        token, doc, self.place = with_ends(words)
        at = np.arange(len(token))
        self.first = np.ones(len(token), bool)
        self.first[1:] = doc[1:] != doc[:-1]
        self.before = np.where(self.first, START, np.concatenate([token[-1:], token[:-1]]))
        short = np.zeros(len(token), bool)
        inner = self.place >= 0
        short[inner] = (words.end - words.start)[self.place[inner]] <= SHORT
        seen = np.maximum.accumulate(np.concatenate([[-1], np.where(short, at, -1)[:-1]])) if len(at) else at
        start = np.maximum.accumulate(np.where(self.first, at, 0)) if len(at) else at
        sparse = np.where(seen >= start, token[np.maximum(seen, 0)], START)
        self.doc = doc
        down = U(64 - bits)
        self.token = mix(token) >> U(64 - TOKEN_BITS)
        self.pair = mix(self.before * A ^ mix(token)) >> down
        self.after_short = mix(sparse * B + token * C) >> down
        self.short = mix(sparse * C ^ A) >> down


def keys_of(events: Events) -> list[tuple[int, int, np.ndarray]]:
    return [(TOKENS, TOKEN_BITS, events.token), (CONTEXTS, 0, np.concatenate([events.pair, events.after_short, events.short]))]


def tallied(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how many of each lie in training documents). Keys have 63 bits at most."""
    both = np.sort(keys << U(1) | train)
    key = both >> U(1)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(both & U(1), edge) if len(edge) else key


# hashes and counts on the way


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the low bytes of all first, without high bytes that are 0 in all; compressed."""
    wide = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    used = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    return bytes([used]) + pa.compress(wide[:used].tobytes(), codec="zstd", asbytes=True)


def unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data[0]:
        out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], data[0] * n, codec="zstd", asbytes=True), np.uint8).reshape(data[0], n).T
    return out.view(np.uint64).ravel()


def differences(keys: np.ndarray) -> bytes:
    return int(keys[0]).to_bytes(8, "little") + planes(np.diff(keys))


def summed(data: bytes, n: int) -> np.ndarray:
    first = U(int.from_bytes(data[:8], "little"))
    return np.cumsum(np.concatenate([[first], unplaned(data[8:], n - 1)]), dtype=np.uint64)


REQUEST = "kind int, block long, chunk long, n int, keys binary, counts binary"
REPLY = "kind int, block long, chunk long, n int, counts binary, total long, distinct long"


def requests(bits: int, split: tuple[int, int]):
    """What each chunk has and asks for, by range of hashes; split: binary digits of the number of ranges of either kind."""

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = opened(body)
                events = Events(Words(rows.column("text"), True), bits)
                train = rows.column("train").to_numpy(zero_copy_only=False).astype(np.uint64)[events.doc]
                out = []
                for kind, width, keys in keys_of(events):
                    key, counts = tallied(keys, np.tile(train, len(keys) // max(len(train), 1)))
                    block = key >> U((width or bits) - split[kind])
                    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True):
                        out.append((kind, int(block[a]), chunk, b - a, differences(key[a:b]), planes(counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "chunk", "n", "keys", "counts"])

    return run


def answered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals over all chunks of each chunk's keys in one range, with a mark (lowest bit) for one chunk that has the key in training."""
    kind, block = (k.as_py() for k in key)
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "keys", "counts")), strict=True)]
    rows.sort(key=lambda r: r[0])
    n = np.array([r[1] for r in rows])
    keys = np.concatenate([summed(k, m) for _, m, k, _ in rows])
    counts = np.concatenate([unplaned(c, m) for _, m, _, c in rows])
    order = ordered(keys)
    keys, counts = keys[order], counts[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    edge = np.flatnonzero(new)
    total = np.add.reduceat(counts, edge)
    group = np.cumsum(new) - 1
    has = np.flatnonzero(counts > 0)
    of = group[has]
    reply = np.empty(len(keys), np.uint64)
    mine = np.zeros(len(keys), np.uint64)
    mine[has[np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]]] = 1
    reply[order] = total[group] << U(1) | mine
    edges = np.concatenate([[0], np.cumsum(n)])
    stats = (int(total.sum()), int((total > 0).sum()))
    for i, (chunk, m, _, _) in enumerate(rows):
        out = [(kind, block, chunk, m, planes(reply[edges[i] : edges[i + 1]]), *(stats if not i else (0, 0)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["kind", "block", "chunk", "n", "counts", "total", "distinct"])


# outcomes of the decisions


def ordered(keys: np.ndarray) -> np.ndarray:
    """Places of the keys in their order, equal ones as they come.

    Keys are sorted as numbers with their places in the low bits, which is several times quicker than by place. Keys too long
    for that lose their lowest bits; where two of them then stand in the wrong order, they are sorted by place after all.
    """
    if not len(keys):
        return np.zeros(0, np.int64)
    keys = keys.astype(np.uint64) - U(int(keys.min()))
    width = len(keys).bit_length()
    lost = U(max(0, int(keys.max()).bit_length() + width - 64))
    at = (np.sort(keys >> lost << U(width) | np.arange(len(keys), dtype=np.uint64)) & U((1 << width) - 1)).astype(np.int64)
    if lost:
        key = keys[at]
        if (key[1:] < key[:-1]).any():
            return np.argsort(keys, kind="stable")
    return at


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each key's place among the distinct keys in order, how often each of these occurs)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = ordered(keys)
    key = keys[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    back = np.empty(len(keys), np.int64)
    back[at] = np.cumsum(new) - 1
    return back, np.diff(np.append(np.flatnonzero(new), len(keys)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, each key's place among them, how often each of them occurs)."""
    back, times = grouped(keys)
    out = np.empty(len(times), keys.dtype)
    out[back] = keys
    return out, back, times


def others(total: np.ndarray, group: np.ndarray, doc: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Each entry's total without its own document, where that is among the training documents."""
    out = total[group]
    out[trained & (out == 1)] = 0  # the one is its own
    some = np.flatnonzero(trained & (out > 1))
    if len(some):
        back, times = grouped(doc[some] * len(total) + group[some])
        out[some] -= times[back]
    return out


def bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(1.5 * np.log2(np.maximum(count, 0) + 1), NONE - 1).astype(np.int64), NONE)


def text_of(words: Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words at these places, -1 being the empty one, with a blank behind each; how many bytes each takes)."""
    none = place < 0
    start = np.where(none, 0, words.start[np.maximum(place, 0)]) if len(words.start) else np.zeros(len(place), np.int64)
    end = np.where(none, 0, words.end[np.maximum(place, 0)]) if len(words.start) else start
    n = end - start + 1
    spot = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    data = words.data[np.minimum(spot, max(len(words.data) - 1, 0))] if len(words.data) else np.full(len(spot), 32, np.uint8)
    data = data.copy()
    data[np.cumsum(n) - 1] = 32
    return data, n


DECIDED = "doc_id long, train boolean, n_tokens long, n_known long, base double, bits double, n_bytes long, codes binary, before binary, unknown binary, types binary"
DECIDED_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def decided(rows: pa.RecordBatch, counts: list[np.ndarray], bits: int, n_train: int, n_docs: int) -> pa.RecordBatch:
    """Outcomes, buckets and shares of the documents of a chunk; counts: of its distinct keys of either kind."""
    words = Words(rows.column("text"), True)
    events = Events(words, bits)
    doc, n = events.doc, len(events.doc)
    train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
    (token, _), (context, _) = (grouped(keys) for _, _, keys in keys_of(events))
    total, total_c = ((replies >> U(1)).astype(np.int64) for replies in counts)
    known, trained = total[token], train[doc]
    c1 = others(total, token, doc, trained)
    parts = [context[i * n : (i + 1) * n] for i in range(3)]
    c2, cs, seen_s = (others(total_c, p, doc, trained) for p in parts)
    seen_2 = np.where(events.first, n_docs - trained, np.concatenate([c1[-1:], c1[:-1]]))
    c2, cs = np.minimum(c2, seen_2), np.minimum(cs, seen_s)  # a mistaken hash must not give a share above 1
    n_tokens = np.bincount(doc, minlength=len(words))
    seen_1 = np.maximum(n_train - np.where(train, n_tokens, 0), 0)[doc]
    first_of = lambda a, b, c, d: np.where(c2 > 0, a, np.where(cs > 0, b, np.where(c1 > 0, c, d)))
    outcome, have, of = first_of(0, 1, 2, 3), first_of(c2, cs, c1, 1), first_of(seen_2, seen_s, seen_1, 1)
    per = lambda x: np.bincount(doc, weights=x, minlength=len(words))
    codes = (outcome | bucket(seen_2) << 2 | bucket(seen_s) << 7 | (seen_1 > 0) << 12).astype("<u2")
    before = (mix(events.before ^ C) >> U(54)).astype("<u2")
    edge = np.concatenate([[0], np.cumsum(n_tokens)])
    rare = np.flatnonzero(outcome == 3)
    data, size = text_of(words, events.place[rare])
    stop = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(doc[rare], np.arange(len(words) + 1))]
    mark = np.flatnonzero((counts[TOKENS] & U(1)).astype(bool))
    where = np.full(len(total), -1)
    where[token[::-1]] = np.arange(n)[::-1]
    types, _ = text_of(words, events.place[where[mark]])
    cut = lambda x, e: [x[a:b].tobytes() for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
    m = len(words)
    cols = [rows.column("doc_id").to_pylist(), train.tolist(), n_tokens.tolist(), per(known > 0).astype(np.int64).tolist(), per(np.log10(known + 0.5)).tolist(), per(np.log2(of / have)).tolist(), np.diff(words.off).tolist(), cut(codes, edge), cut(before, edge), cut(data, stop), [types.tobytes(), *[b""] * (m - 1)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, DECIDED_TYPES, strict=True)], names=[f.split()[0] for f in DECIDED.split(", ")])


def deciding(bits: int, n_train: int, n_docs: int):
    """Rows ordered by chunk, kind and block (kind -1: the chunk itself) to its documents' outcomes, one chunk at a time."""

    def run(batches):
        chunk, body, held = None, None, [[], []]

        def result():
            return decided(opened(body), [np.concatenate([unplaned(c, n) for n, c in x]) for x in held], bits, n_train, n_docs)

        for batch in batches:
            for c, kind, n, data in zip(*(batch.column(k).to_pylist() for k in ("chunk", "kind", "n", "data")), strict=True):
                if kind < 0:
                    if body is not None:
                        yield result()
                    chunk, body, held = c, data, [[], []]
                elif c == chunk:
                    held[kind].append((n, data))
        if body is not None:
            yield result()

    return run


# spelling


def spelled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of every byte of words that each end with a blank. A key has the byte in its low 8 bits and above them the
    four bytes before it in its word, the nearest lowest, 0 where there is none."""
    last = data == 32
    word = np.cumsum(last) - last
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - start[word] if len(data) else word
    key = data.astype(np.uint64)
    for k in range(1, 5):
        at = np.flatnonzero(place >= k)
        key[at] |= data[at - k].astype(np.uint64) << U(8 * k)
    return word, key


def byte_bits(key: np.ndarray, times: np.ndarray):
    """For each of a byte's eight bits, over what differs in the bytes before and the bits so far, this one included: its value,
    the slots of its contexts, how often it occurs, and the place there of each key. Keys are distinct and in order."""
    for j in range(8):
        bits = key >> U(7 - j)
        new = np.concatenate([[True], bits[1:] != bits[:-1]])[: len(key)]
        edge = np.flatnonzero(new)
        bits = bits[edge]
        node, before = (bits >> U(1)) & U((1 << j) - 1) | U(1 << j), bits >> U(j + 1)
        context = (before & U((1 << 8 * k) - 1) for k in range(1, 5))
        slots = [(mix(c * B + U(k) * C + node * A) >> U(64 - BYTE_SLOTS)).astype(np.int32) for k, c in enumerate(context, 1)]
        yield (bits & U(1)).astype(np.int8), slots, np.add.reduceat(times, edge) if len(edge) else times, np.cumsum(new) - 1


def stretches(data: np.ndarray, most: int = 400_000):
    """Words' bytes in stretches of whole words of about ``most`` bytes."""
    ends = np.flatnonzero(data == 32) + 1
    at = 0
    while at < len(data):
        to = ends[np.searchsorted(ends, min(at + most, len(data)))] if at + most < len(data) else len(data)
        yield data[at:to]
        at = int(to)


def joined_bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def eight_bits(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts scaled down, where either passes 255, to fit in one 16-bit number; a seen bit stays seen."""
    pair = counts.reshape(-1, 2).astype(np.float64)
    pair *= np.minimum(1.0, 255 / np.maximum(pair.max(1), 1))[:, None]
    pair = np.where((pair > 0) & (pair < 1), 1, np.round(pair)).astype(np.uint16)
    return pair[:, 0] | pair[:, 1] << np.uint16(8)


class Speller:
    """Mixes the byte contexts' predictions of a word's bits."""

    def __init__(self, packed: bytes, weights: np.ndarray):
        self.table, self.weights = np.frombuffer(zlib.decompress(packed), np.uint16), weights.copy()
        n0, n1 = np.arange(65536) & 255, np.arange(65536) >> 8
        self.odds = (np.log((n1 + 0.3) / (n0 + 0.3)) * (n0 + n1) / (n0 + n1 + 1.5)).astype(np.float32)

    def cost(self, data: np.ndarray, own: bool, learn: bool = False) -> np.ndarray:
        """Bits of each word. own: the words are among those counted, so each bit's own count is taken off."""
        out = []
        for part in stretches(data):
            word, key = spelled(part)
            key, back, times = distinct(key)
            total = np.zeros(len(key))
            for y, slots, n, group in byte_bits(key, times):
                x = np.ones((len(y), BYTE_INPUTS), np.float32)
                seen = np.zeros(len(y), np.int8)
                for k, slot in enumerate(slots):
                    v = self.table[slot]
                    if own:
                        c = np.where(y == 1, v >> 8, v & 255)
                        v = np.where((c > 0) & (c < 255), v - np.where(y == 1, 256, 1).astype(np.uint16), v)
                    x[:, k] = self.odds[v]
                    seen += v > 0
                seen = np.minimum(seen, BYTE_GATES - 1)
                p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", self.weights[seen], x), -12, 12)))
                total -= np.log2(np.where(y == 1, p, 1 - p))[group]
                if learn:
                    for g in range(BYTE_GATES):
                        at = seen == g
                        if at.any():
                            self.weights[g] += 0.02 * np.average((y[at] - p[at])[:, None] * x[at], axis=0, weights=n[at])
            out.append(np.bincount(word, weights=total[back], minlength=int(word[-1]) + 1))
        return np.concatenate(out) if out else np.zeros(0)


# decisions


class Decisions:
    """The decisions of a batch of documents, level by level: owner, round, value, gate, and a slot for each of the contexts."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.column("n_tokens").to_numpy()
        code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").astype(np.int32)
        before = np.frombuffer(b"".join(batch.column("before").to_pylist()), "<u2").astype(np.int32)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        nth = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        outcome, seen_2, seen_s = code & 3, code >> 2 & 31, code >> 7 & 31
        past = [np.zeros(len(doc), np.int32)]
        for k in range(1, 5):
            p = np.full(len(doc), OUTCOMES, np.int32)
            p[k:] = outcome[:-k] if k <= len(doc) else p[k:]
            p[nth < k] = OUTCOMES
            past.append(past[-1] * 5 + p)
        both, previous, size = seen_2 * 32 + seen_s, before * 5 + past[1], (seen_2 * 25 + past[2], seen_s * 25 + past[2], past[2])
        levels = [np.flatnonzero(seen_2 != NONE), np.flatnonzero((outcome > 0) & (seen_s != NONE)), np.flatnonzero((outcome > 1) & (code >> 12 > 0))]
        of = lambda values: np.concatenate([x[at] for x, at in zip(values, levels, strict=True)])
        self.owner, self.round = of([doc] * LEVELS), of([nth // CHUNK] * LEVELS)
        self.value = np.concatenate([outcome[at] == level for level, at in enumerate(levels)])
        self.gate = of([past[1] + level * 5 for level in range(LEVELS)])
        parts = [[x + level * (width // LEVELS) for level, x in enumerate(xs)] for xs, width in zip((size, [past[4]] * LEVELS, [both] * LEVELS, [previous] * LEVELS), SIZES, strict=True)]
        self.slots = [of(x) + o for x, o in zip(parts, np.cumsum([0, *SIZES[:-1]], dtype=np.int32), strict=True)]


def stretches_of(batch: pa.RecordBatch, most: int = 250_000):
    """Slices of a batch with about so many tokens, a longer document alone."""
    size = np.cumsum(batch.column("n_tokens").to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, batch.slice(at, to - at)
        at = to


class Mixer:
    def __init__(self, odds: np.ndarray, weights: np.ndarray):
        self.odds, self.weights = odds.astype(np.float32), weights.astype(np.float32)

    def cost(self, d: Decisions, docs: int, learn: np.ndarray | None = None) -> np.ndarray:
        """Bits of each document's decisions. Weights are corrected within a document; learn: tokens of each document, by which
        the corrected weights count for the start weights."""
        x = np.ones((len(d.value), INPUTS), np.float32)
        for k, slot in enumerate(d.slots):
            x[:, k] = self.odds[slot]
        key = d.round.astype(np.int64) * (docs * GATES) + d.owner * GATES + d.gate
        order = ordered(key)
        x, y, key = x[order], d.value[order].astype(np.float32), key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        group, edge = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(key))
        turn, used = np.divmod(key[edge[:-1]], max(docs * GATES, 1))
        w = np.repeat(self.weights[None], docs, 0).reshape(-1, INPUTS)
        cost = np.zeros(docs)
        turns = np.searchsorted(turn, np.arange(turn[-1] + 2)).tolist() if len(turn) else [0]
        for i, j in zip(turns[:-1], turns[1:], strict=True):
            a, b = edge[i], edge[j]
            v, back, n, at = x[a:b], group[a:b] - i, np.diff(edge[i : j + 1]), used[i:j]
            start = w[at]
            p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", start[back], v), -12, 12)))
            err = y[a:b] - p
            cost -= np.bincount(at[back] // GATES, weights=np.log2(1 - np.abs(err)), minlength=docs)
            step = np.stack([np.bincount(back, weights=err * v[:, k], minlength=j - i) for k in range(INPUTS)], 1)
            w[at] = start + (0.015 * step / np.sqrt(n)[:, None]).astype(np.float32)
        if learn is not None and docs and learn.sum():
            self.weights += 0.3 * (np.average(w.reshape(docs, GATES, INPUTS), axis=0, weights=learn) - self.weights)
        return cost


def counting(batches):
    """(slot, zeros, ones) of the training documents' decisions, and the training words' byte contexts (slots from -1 downwards)."""
    zero, one = np.zeros(sum(SIZES), np.int64), np.zeros(sum(SIZES), np.int64)
    byte = np.zeros((1 << BYTE_SLOTS) * 2, np.int32)
    for batch in batches:
        for part in stretches(joined_bytes(batch.column("types"))):
            key, _, times = distinct(spelled(part)[1])
            for bit, slots, n, _ in byte_bits(key, times):
                for slot in slots:
                    np.add.at(byte, slot * 2 + bit, n.astype(np.int32))
        batch = batch.filter(batch.column("train"))
        for _, part in stretches_of(batch):
            d = Decisions(part)
            for slot in d.slots:
                zero += np.bincount(slot[~d.value], minlength=len(zero))
                one += np.bincount(slot[d.value], minlength=len(one))
    both = np.stack([zero, one], 1).astype(np.int64).tobytes()
    blocks, out = [-1], [zlib.compress(both, 1)]
    for i in range(len(byte) // BLOCK):
        part = byte[i * BLOCK : (i + 1) * BLOCK]
        if part.any():
            blocks.append(i)
            out.append(zlib.compress(part.astype(np.int64).tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], names=["block", "data"])


def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("data").to_pylist():
            part = np.frombuffer(zlib.decompress(data), np.int64)
            total = part.copy() if total is None else total + part
    block = key[0].as_py()
    data = total.tobytes() if block < 0 else eight_bits(total).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(data, 1)], pa.binary())], names=["block", "data"])


def learning(state: dict):
    """Weights after one online pass over a partition's training documents and words, and how many tokens they come from."""

    def run(batches):
        mixer, speller, n = Mixer(state["odds"], state["weights"]), Speller(state["bytes"], state["byte_weights"]), 0
        for batch in batches:
            speller.cost(joined_bytes(batch.column("types")), True, True)
            batch = batch.filter(batch.column("train"))
            for _, part in stretches_of(batch):
                tokens = part.column("n_tokens").to_numpy()
                mixer.cost(Decisions(part), part.num_rows, tokens)
                n += int(tokens.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mixer.weights.astype(float).ravel().tolist()], pa.list_(pa.float64())), pa.array([speller.weights.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "w", "b"])

    return run


def scoring(state: dict):
    def run(batches):
        mixer, speller = Mixer(state["odds"], state["weights"]), Speller(state["bytes"], state["byte_weights"])
        for batch in batches:
            bits = batch.column("bits").to_numpy().copy()
            for at, part in stretches_of(batch):
                bits[at : at + part.num_rows] += mixer.cost(Decisions(part), part.num_rows)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for own in (False, True):
                some = np.flatnonzero(train == own)
                texts = batch.column("unknown").take(pa.array(some)).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                if len(data):
                    words = np.repeat(some, [t.count(b" ") for t in texts])
                    bits += np.bincount(words, weights=speller.cost(data, own), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "base")), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(batch.column("n_bytes").to_numpy(), 1))], names=["doc_id", "n_tokens", "n_known", "base", "score", "bits_per_byte"])

    return run


def score_texts(docs: DataFrame, train: Column, block_keys: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs`` (doc_id, text).

    The model learns from the rows with ``train`` true (null counts as false). A null or empty text is the end alone; repeated
    rows and equal doc_ids are scored each by its own text; without training rows every token is unknown; an empty table gives
    an empty result; further columns are ignored. Counts of tokens and of contexts cover all training rows and stay in ranges
    of about ``block_keys`` hashes; context hashes are long enough that one in some thousands is mistaken for another, token
    hashes have 63 bits. Sent to every executor are the decisions' tables and those of byte contexts, of fixed size
    because their contexts are. The base score counts a training document's own tokens, as its definition says.
    """
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    expected, n_docs = max((size[0] or 0) // 5, 1), size[1]
    tasks = max(-(-(size[0] or 0) // SHARE), docs.sparkSession.sparkContext.defaultParallelism)
    bits = min(max(expected.bit_length() + 12, 36), TOKEN_BITS)
    split = tuple(max(0, (expected // share // block_keys).bit_length()) for share in (5, 1))
    chunks = settled(docs.coalesce(tasks).mapInArrow(chunked, "chunk long, body binary"), "chunks")
    asked = chunks.mapInArrow(requests(bits, split), REQUEST)
    replies = settled(asked.repartition(tasks, "kind", "block").groupBy("kind", "block").applyInArrow(answered, REPLY), "replies")
    total, types_ = (int(x or 0) for x in replies.where(F.col("kind") == TOKENS).agg(F.sum("total"), F.sum("distinct")).first())
    bodies = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("n"), F.col("body").alias("data"))
    both = bodies.union(replies.select("chunk", "kind", "block", "n", F.col("counts").alias("data")))
    both = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "block")
    outcomes = settled(both.mapInArrow(deciding(bits, total, n_docs), DECIDED), "outcomes")
    dropped(chunks, replies)
    state = {"weights": np.tile(np.array([0.4, 0.25, 0.25, 0.25, 0.0]), (GATES, 1)), "byte_weights": np.tile(np.array([0.1, 0.25, 0.35, 0.4, 0.0]), (BYTE_GATES, 1))}
    table, counts = np.zeros(1 << BYTE_SLOTS, np.uint16), np.zeros((sum(SIZES), 2))
    for r in outcomes.mapInArrow(counting, "block int, data binary").groupBy("block").applyInArrow(added, "block int, data binary").collect():
        data = zlib.decompress(r["data"])
        if r["block"] < 0:
            counts = np.frombuffer(data, np.int64).reshape(-1, 2)
        else:
            table[r["block"] * BLOCK // 2 : (r["block"] + 1) * BLOCK // 2] = np.frombuffer(data, np.uint16)
    state["odds"], state["bytes"] = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)), zlib.compress(table.tobytes(), 1)
    got = outcomes.mapInArrow(learning(state), "n long, w array<double>, b array<double>").where("n > 0")
    mean = got.select("n", F.posexplode(F.concat("w", "b")).alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()
    if mean:
        flat = np.array([x for _, x in sorted((r["i"], r["x"]) for r in mean)])
        state["weights"], state["byte_weights"] = flat[: GATES * INPUTS].reshape(GATES, -1), flat[GATES * INPUTS :].reshape(BYTE_GATES, -1)
    scored = outcomes.mapInArrow(scoring(state), "doc_id long, n_tokens long, n_known long, base double, score double, bits_per_byte double")
    unit = float(np.log10(total + 0.5 * (types_ + 1)))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * unit).alias("base_score"), "score", "bits_per_byte")
