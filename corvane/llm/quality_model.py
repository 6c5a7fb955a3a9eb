"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of a
document's features in time linear in their number. Words are hashed into ``1 << BITS`` inputs (square root of the count, unit
length together); the structure inputs are ratios read off the text; metadata are logarithms of number columns.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from corvane.llm.words import BYTE, LOWER, U, Words, grams, run_hash, slabs

BITS = 16
RANK = 8
BYTE_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "beyond_ascii": range(128, 256),
}
STRUCTURE = [*BYTE_CLASSES, "words", "length", "distinct", "same_as_last", "repeated_runs", "repeated_lines", "shouted", "marked", "short", "top_share"]


def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``edges``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[edges])


def inputs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word input, its value) of every hashed word, and the documents' structure statistics."""
    data, off, n, docs = words.data, words.off, words.count, len(words)
    size = np.maximum(np.diff(off), 1)
    stats = []
    for members in BYTE_CLASSES.values():
        flag = np.zeros(256, np.int8)
        flag[list(members)] = 1
        stats.append(per_doc(flag[data], off) / size)
    some = np.maximum(n, 1)
    stats.append(np.log1p(n))
    stats.append(per_doc(words.end - words.start, words.first) / some)
    h = run_hash(BYTE[LOWER[data]], words.start, words.end)
    doc = words.doc_of()
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hs)))
    hs, ds = hs[at], ds[at]
    stats.append(np.bincount(ds, minlength=docs) / some)
    same = np.zeros(len(h), np.int8)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stats.append(per_doc(same, words.first) / some)
    g, gd = grams(h, words.first, 5)
    order = np.lexsort((g, gd))
    again = (g[order][1:] == g[order][:-1]) & (gd[order][1:] == gd[order][:-1])
    stats.append(np.bincount(gd[order][1:][again], minlength=docs) / some)
    stats.append(repeated_lines(words))
    cap = np.zeros(256, np.int8)
    cap[65:91] = 1
    capitals = per_doc(cap[data], np.append(words.start, len(data))) if len(words.start) else np.zeros(0)
    length = words.end - words.start
    stats.append(per_doc(((capitals >= 2) & (2 * capitals >= length)).astype(np.int8), words.first) / some)
    tail = data[words.end - 1] if len(words.end) else data[:0]
    mark = np.zeros(256, np.int8)
    mark[list(b"#*$%&|<>!?")] = 1
    stats.append(per_doc(mark[tail], words.first) / some)
    stats.append((n < 15).astype(float))
    top = np.zeros(docs)
    np.maximum.at(top, ds, times)
    stats.append(top / some)
    value = np.sqrt(times)
    norm = np.sqrt(np.bincount(ds, weights=times, minlength=docs))
    return ds, (hs >> U(64 - BITS)).astype(np.int64), value / norm[ds], np.stack(stats, 1)


def repeated_lines(words: Words) -> np.ndarray:
    """Share of a document's filled lines that equal an earlier one of it."""
    breaks = words.data == 10
    starts = np.unique(np.concatenate([words.off[:-1], np.flatnonzero(breaks) + 1])) if len(words.data) else np.zeros(0, np.int64)
    starts = starts[starts < len(words.data)]
    ends = np.append(starts[1:], len(words.data))
    doc = np.searchsorted(words.off, starts, "right") - 1
    ends = np.minimum(ends, words.off[doc + 1])
    trimmed = ends - (words.data[ends - 1] == 10)
    keep = trimmed > starts
    starts, ends, doc = starts[keep], trimmed[keep], doc[keep]
    h = run_hash(BYTE[words.data], starts, ends)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    count = np.bincount(doc, minlength=len(words))
    return np.bincount(doc[order][1:][again], minlength=len(words)) / np.maximum(count, 1)


class Machine:
    """Weights and factors over the hashed words followed by the structure statistics and the metadata."""

    def __init__(self, metadata: list[str] = (), seed: int = 7):
        rng = np.random.default_rng(seed)
        k = len(STRUCTURE) + len(metadata)
        n = (1 << BITS) + k
        self.metadata = list(metadata)
        self.bias, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.02, (n, RANK))
        self.mean, self.scale = np.zeros(k), np.ones(k)

    def rows(self, doc, index, value, stats):
        """Word inputs and standardised structure inputs as one list, ordered by document."""
        dense = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.5
        n, k = dense.shape
        d = np.concatenate([doc, np.repeat(np.arange(n), k)])
        i = np.concatenate([index, np.tile(np.arange(k) + (1 << BITS), n)])
        x = np.concatenate([value, dense.ravel()])
        order = np.argsort(d, kind="stable")
        return d[order], i[order], x[order]

    def logit(self, d, i, x, n):
        edges = np.searchsorted(d, np.arange(n))
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, edges, axis=0)
        q = np.add.reduceat((vx * vx).sum(1), edges)
        return self.bias + np.add.reduceat(self.w[i] * x, edges) + 0.5 * ((s * s).sum(1) - q), s, vx

    def fit(self, examples, y, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 2e-5, seed: int = 11):
        """AdaGrad on the logistic loss. examples: (index, value, stats) of each labelled document, as views of flat arrays."""
        stats = np.array([e[2] for e in examples])
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        rate_w, rate_v, rng = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), np.random.default_rng(seed)
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                own = order[at : at + batch]
                size = [len(examples[j][0]) for j in own]
                d, i, x = self.rows(np.repeat(np.arange(len(own)), size), np.concatenate([examples[j][0] for j in own]).astype(np.int64), np.concatenate([examples[j][1] for j in own]).astype(float), stats[own])
                z, s, vx = self.logit(d, i, x, len(own))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                self.bias -= 0.1 * g.sum()
                used, back = np.unique(i, return_inverse=True)
                gw = np.bincount(back, weights=g[d] * x, minlength=len(used)) + decay * self.w[used]
                part = (g[d] * x)[:, None] * (s[d] - vx)
                gv = np.stack([np.bincount(back, weights=part[:, f], minlength=len(used)) for f in range(RANK)], 1) + decay * self.v[used]
                rate_w[used] += gw * gw
                rate_v[used] += gv * gv
                self.w[used] -= rate * gw / np.sqrt(rate_w[used])
                self.v[used] -= 0.5 * rate * gv / np.sqrt(rate_v[used])
        return self

    def packed(self) -> dict:
        return {"metadata": self.metadata, "bias": self.bias, "w": self.w.astype(np.float32), "v": self.v.astype(np.float32), "mean": self.mean, "scale": self.scale}

    @classmethod
    def of(cls, state: dict) -> Machine:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out


def metadata_of(batch: pa.RecordBatch, at: int, n: int, columns: list[str]) -> np.ndarray:
    """Logarithms of number columns; null, negative and missing ones count as 0."""
    out = np.zeros((n, len(columns)))
    for j, name in enumerate(columns):
        if name in batch.schema.names:
            x = batch.column(name).slice(at, n).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
            out[:, j] = np.log1p(np.nan_to_num(np.maximum(x, 0), nan=0.0, posinf=0.0))
    return out


def all_inputs(batch: pa.RecordBatch, columns: list[str]):
    """(row offset, rows, inputs) for stretches of a batch; the metadata stand behind the structure statistics."""
    for at, n, words in slabs(batch, "text", False):
        doc, index, value, stats = inputs(words)
        yield at, n, (doc, index, value, np.hstack([stats, metadata_of(batch, at, n, columns)]))


def extracted(columns: list[str]):
    """Inputs of each labelled document, for training."""

    def run(batches):
        for batch in batches:
            for at, n, (doc, index, value, stats) in all_inputs(batch, columns):
                edge = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                wide = pa.array(np.arange(n + 1, dtype=np.int32) * stats.shape[1])
                lists = [pa.ListArray.from_arrays(o, pa.array(v)) for o, v in ((edge, index.astype(np.int32)), (edge, value.astype(np.float32)), (wide, stats.ravel()))]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, n), *lists], names=["label", "index", "value", "stats"])

    return run


EXAMPLES = "label int, index array<int>, value array<float>, stats array<double>"


def fitting(columns: list[str]):
    """The weights learned from all examples, which come to one task: their number is bounded, and the driver gets the weights alone."""

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        machine = Machine(columns)
        if held:
            y = np.concatenate([b.column("label").to_numpy() for b in held]).astype(float)
            parts = []
            for b in held:
                index, value, stats = (b.column(c) for c in ("index", "value", "stats"))
                edge = index.offsets.to_numpy()
                flat = [c.values.to_numpy() for c in (index, value)]
                wide = stats.values.to_numpy()[stats.offsets[0].as_py() : stats.offsets[-1].as_py()].reshape(b.num_rows, -1)
                parts += [(flat[0][i:j], flat[1][i:j], s) for i, j, s in zip(edge[:-1], edge[1:], wide, strict=True)]
            order = sorted(range(len(y)), key=lambda j: (y[j], len(parts[j][0]), parts[j][0].tobytes(), parts[j][2].tobytes()))
            machine.fit([parts[j] for j in order], y[order])
        else:
            machine.v[:] = 0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine.packed(), 5)], pa.binary())], names=["state"])

    return run


def scores_of(machine: Machine, batch: pa.RecordBatch):
    for at, n, parts in all_inputs(batch, machine.metadata):
        z, _, _ = machine.logit(*machine.rows(*parts), n)
        yield at, n, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scoring(state: dict):
    def run(batches):
        machine = Machine.of(state)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, n, p in scores_of(machine, batch):
                out[at : at + n] = p
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return run


def crc_fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


NUMBERS = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def numbers(docs: DataFrame, metadata: tuple[str, ...]) -> list[str]:
    """Those of the columns that ``docs`` has and that hold numbers."""
    return [f.name for f in docs.schema.fields if f.name in metadata and isinstance(f.dataType, NUMBERS)]


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", most: int = 8000, metadata: tuple[str, ...] = ("n_chars",)) -> dict:
    """Weights learned from at most ``most`` labelled documents with ``train`` true, those with the least hash of doc_id.

    The bound keeps what one task learns from at some tens of MB; the driver gets the weights alone. Rows with a null label or doc_id aren't used,
    repeated labels of a document count once; without any labelled document every score is a half. ``metadata`` columns that
    ``docs`` lacks or that hold no numbers are left out.
    """
    rows = labels.where(train & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    columns = numbers(docs, metadata)
    some = docs.select("doc_id", "text", *columns).join(F.broadcast(rows.toDF("doc_id", "__label")), "doc_id").select("text", *columns, F.col("__label").alias("label"))
    examples = some.mapInArrow(extracted(columns), EXAMPLES)
    got = examples.repartition(1).mapInArrow(fitting(columns), "state binary").collect()
    return pickle.loads(got[0]["state"])


def quality_scores(docs: DataFrame, state: dict) -> DataFrame:
    """``docs``'s doc_id and score (0 to 1) for every row (doc_id, text, metadata); null and empty texts are scored by their
    structure and metadata alone.

    One pass without a shuffle; repeated rows get equal scores; an empty table gives an empty result; further columns are
    ignored, lang, source and doc_id are no inputs.
    """
    return docs.select("doc_id", "text", *numbers(docs, tuple(state["metadata"]))).mapInArrow(scoring(state), "doc_id long, score double")


def keeping(state: dict, least: float):
    def run(batches):
        machine = Machine.of(state)
        for batch in batches:
            for at, n, p in scores_of(machine, batch):
                yield batch.slice(at, n).filter(pa.array(p >= least))

    return run


def quality_filter(docs: DataFrame, state: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text and any other columns, all kept as they are) whose score is at least ``least``.

    A metadata column of another type than the one learned from counts as missing.
    """
    usable = numbers(docs, tuple(state["metadata"]))
    marked = state | {"metadata": [c if c in usable else "" for c in state["metadata"]]}
    return docs.mapInArrow(keeping(marked, least), docs.schema)
