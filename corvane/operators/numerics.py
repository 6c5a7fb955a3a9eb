"""Tokenizer training, sampling and transformer arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """symbols (characters and </w>), freq of every whitespace word."""
    w = docs.select(F.explode(F.filter(F.split(F.col(text), "\\s+"), lambda x: F.length(x) > 0)).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    return w.select(F.concat(F.split("w", ""), F.array(F.lit("</w>"))).alias("symbols"), "freq")


def pair_statistics(vocab: DataFrame) -> DataFrame:
    """a, b, freq of adjacent symbols."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("a"), F.element_at("symbols", i + 1).alias("b")))
    return vocab.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "freq").groupBy("p.a", "p.b").agg(F.sum("freq").alias("freq"))


def merged_symbols(symbols: Column, a: str, b: str) -> Column:
    """An array of symbols with the pair joined to one wherever it stands, from the left."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        join = (last == a) & (s == b)
        return F.when(join, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def merged(vocab: DataFrame, a: str, b: str) -> DataFrame:
    """Every word of the vocabulary with the pair joined."""
    return vocab.select(merged_symbols(F.col("symbols"), a, b).alias("symbols"), "freq")


def train_bpe(vocab: DataFrame, merges: int = 20, every: int = 5, settle=None) -> list[tuple[str, str]]:
    """The first ``merges`` merge rules: the most frequent pair each time, ties to the smaller pair.

    One row comes to the driver per merge. ``settle`` (a function of a frame) cuts the lineage every so many merges.
    """
    rules = []
    for i in range(merges):
        top = pair_statistics(vocab).orderBy(F.desc("freq"), "a", "b").first()
        if top is None:
            break
        rules.append((top["a"], top["b"]))
        vocab = merged(vocab, *rules[-1])
        if settle and (i + 1) % every == 0:
            vocab = settle(vocab)
    return rules


def apply_bpe(word: str, rules: list[tuple[str, str]]) -> list[str]:
    out = [*word, "</w>"]
    for a, b in rules:
        i = 0
        while i < len(out) - 1:
            if (out[i], out[i + 1]) == (a, b):
                out[i : i + 2] = [a + b]
            i += 1
    return [s.replace("</w>", "") for s in out if s != "</w>"]


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Symbols of a whole text (blanks count as symbols) after all merges in the rules' order, without the end mark."""
    symbols = F.concat(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), F.array(F.lit("</w>")))
    for a, b in rules:
        symbols = merged_symbols(symbols, a, b)
    return F.filter(F.transform(symbols, lambda s: F.regexp_replace(s, "</w>", "")), lambda s: F.length(s) > 0)


def softmax(z: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(z - F.max(z).over(w))
    return e / F.sum(e).over(w)


def entropy(p: Column) -> Column:
    return -F.sum(p * F.log(p + 1e-10))


def top_k_renormalised(frame: DataFrame, p: str, k: int, by: str, id: str) -> DataFrame:
    w = Window.partitionBy(by)
    kept = frame.withColumn("r", F.row_number().over(w.orderBy(F.desc(p), id))).where(F.col("r") <= k)
    return kept.withColumn("q", F.col(p) / F.sum(p).over(w))


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = False) -> np.ndarray:
    s = q @ k.T / np.sqrt(q.shape[-1])
    if causal:
        s = np.where(np.tril(np.ones(s.shape, bool)), s, -1e9)
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True) @ v


def online_softmax_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, tile: int = 4) -> np.ndarray:
    """The same by tiles: running maximum, rescaled sum and output."""
    m, total, out = np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros((len(q), v.shape[1]))
    for a in range(0, len(k), tile):
        s = q @ k[a : a + tile].T / np.sqrt(q.shape[-1])
        new = np.maximum(m, s.max(1))
        e, old = np.exp(s - new[:, None]), np.exp(m - new)
        total, out, m = total * old + e.sum(1), out * old[:, None] + e @ v[a : a + tile], new
    return out / total[:, None]


def multi_head(x: np.ndarray, heads: int, kv_heads: int, seeds: tuple[int, ...]) -> np.ndarray:
    """Heads side by side; each key and value head serves heads // kv_heads query heads. One seed per projection."""
    d = x.shape[1]
    size = d // heads
    mat = lambda s, n: np.random.default_rng(s).standard_normal((d, n)) / np.sqrt(d)
    q, k, v = x @ mat(seeds[0], d), x @ mat(seeds[1], kv_heads * size), x @ mat(seeds[2], kv_heads * size)
    part = lambda a, i: a[:, i * size : (i + 1) * size]
    out = [attention(part(q, h), part(k, h // (heads // kv_heads)), part(v, h // (heads // kv_heads))) for h in range(heads)]
    return np.concatenate(out, 1) @ mat(seeds[3], d)


def sinusoidal(position: Column, i: Column, d: int) -> Column:
    angle = position / F.pow(F.lit(10000.0), (i - i % 2) / d)
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def rope(v: np.ndarray, position: int, base: float = 10000.0) -> np.ndarray:
    half = np.arange(0, len(v), 2)
    angle = position / base ** (half / len(v))
    out = np.empty_like(v, dtype=float)
    out[0::2] = v[0::2] * np.cos(angle) - v[1::2] * np.sin(angle)
    out[1::2] = v[0::2] * np.sin(angle) + v[1::2] * np.cos(angle)
    return out


def alibi(i: Column, j: Column, head: Column, heads: int) -> Column:
    return -F.pow(F.lit(2.0), -8 * (head + 1) / heads) * F.abs(i - j)


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def rms_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps)


def normed(v: Column, center: bool = True, eps: float = 1e-5) -> Column:
    """An array column scaled to unit variance around its mean (layer norm) or to unit root mean square (without ``center``)."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double"))
    shifted = F.transform(v, lambda x: x.cast("double") - total(v) / F.size(v)) if center else F.transform(v, lambda x: x.cast("double"))
    held = F.transform(F.array(shifted), lambda c: F.struct(c.alias("c"), F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + eps).alias("s")))
    return F.transform(held, lambda h: F.transform(h["c"], lambda x: x / h["s"]))[0]


def rotated(v: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary positions: each pair of neighbouring numbers turned by position / base ** (2 i / d)."""
    angle = lambda i: position / F.pow(F.lit(base), (i - i % 2) / F.size(v))
    mate = lambda i: F.element_at(v, (F.when(i % 2 == 0, i + 2).otherwise(i)).cast("int")).cast("double")
    return F.transform(v, lambda x, i: F.when(i % 2 == 0, x.cast("double") * F.cos(angle(i)) - mate(i) * F.sin(angle(i))).otherwise(mate(i) * F.sin(angle(i)) + x.cast("double") * F.cos(angle(i))))


def attended(frame: DataFrame, by: str, order: str, q: str, k: str, v: str, causal: bool = False) -> DataFrame:
    """by, order, out: scaled dot-product attention within each group's rows; groups are sequences, whose length bounds the pairs."""
    from corvane.functions.vectors import dot

    left = frame.select(by, F.col(order).alias("i"), F.col(q).alias("q"))
    right = frame.select(by, F.col(order).alias("j"), F.col(k).alias("k"), F.col(v).alias("v"))
    pairs = left.join(right, by)
    score = dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double"))
    pairs = pairs.withColumn("s", F.when(F.col("j") > F.col("i"), F.lit(-1e9)).otherwise(score) if causal else score)
    w = Window.partitionBy(by, "i")
    e = pairs.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    part = e.select(by, "i", F.posexplode(F.transform("v", lambda x: x.cast("double") * F.col("p"))).alias("d", "x")).groupBy(by, "i", "d").agg(F.sum("x").alias("x"))
    out = F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda r: r["x"])
    return part.groupBy(by, "i").agg(out.alias("out")).withColumnRenamed("i", order)


def toy_model(texts, dims: int = 16, layers: int = 2, seed: int = 5, top: int = 5):
    """Words through embedding, positions, noisy layers with norms and a head: for each text its ``top`` next words with their shares.

    Weights are seeded normals: the flow of shapes is what is shown, no word is learned.
    """
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for t in texts for w in t.split()}) or [""]
    place = {w: i for i, w in enumerate(vocabulary)}
    table = rng.standard_normal((len(vocabulary), dims))
    weights = [rng.standard_normal((dims, dims)) / np.sqrt(dims) for _ in range(layers)]
    out = []
    for t in texts:
        ids = [place[w] for w in t.split()] or [0]
        i = np.arange(dims)
        angle = np.arange(len(ids))[:, None] / 10000.0 ** ((i - i % 2) / dims)
        x = table[ids] + np.where(i % 2 == 0, np.sin(angle), np.cos(angle))
        for w in weights:
            x = layer_norm(x + np.tanh(attention(x, x, x, True) @ w))
        z = x[-1] @ table.T / np.sqrt(dims)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = np.lexsort((np.arange(len(p)), -np.round(p, 12)))[:top]
        out.append([(vocabulary[b], float(p[b])) for b in best])
    return out


def flops_per_token(d: Column, layers: Column, ff: Column) -> Column:
    """Two for each multiplication and addition: four projections and two feed-forward products a layer."""
    return layers * (8 * d * d + 4 * d * ff)


def attention_bytes(n: Column, d: Column, heads: Column, size: int = 2) -> dict[str, Column]:
    """Peak bytes of attention with its score and probability matrices, and tiled with two numbers a head and token instead."""
    rows = 4 * n * d * size
    return {"standard": 2 * heads * n * n * size + rows, "tiled": rows + 2 * n * heads * size}


def memory_needed(billions: Column, context: Column) -> Column:
    """GB for half-precision weights, their fifth as overhead, and the key-value cache of a 32-layer model with 8 heads of 128."""
    return billions * 2 * 1.2 + context * (2 * 32 * 8 * 128 * 2) / F.lit(1024.0**3)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.sqrt(2 / F.pi()) * (x + 0.044715 * x * x * x)))


def swiglu(a: Column, b: Column) -> Column:
    return a / (1 + F.exp(-a)) * b


def parameters(vocab: Column, d: Column, layers: Column, kv: Column, ff: Column, tied: Column) -> Column:
    """Embeddings, attention and gated or plain feed-forward layers, two norms a layer, a final norm and an untied head."""
    layer = 2 * d * d + 2 * d * kv + 2 * d * ff + 2 * d
    return vocab * d + layers * layer + d + F.when(tied, 0).otherwise(vocab * d)


def kv_cache_bytes(layers: Column, batch: Column, kv_heads: Column, length: Column, width: int = 2, size: int = 128) -> Column:
    return 2 * layers * batch * kv_heads * length * size * width


def tile_loads(n: int, tile: int, causal: bool = True) -> int:
    """Key and value tiles loaded by tiled attention; a causal mask skips those that start behind the query tile's end."""
    starts = range(0, n, tile)
    return sum(1 for q in starts for k in starts if not causal or k <= min(q + tile, n) - 1)
