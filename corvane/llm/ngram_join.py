"""Similarity self-join of documents on word n-gram sets by prefix filters under several global orders.

Two sets with Jaccard at least t share one of the first |s| - ceil(t |s|) + 1 shingles of each under *any* total order of
all shingles. Orders here put shingles that a counting sketch of the whole corpus shows to be frequent last, and order the
rest by differently seeded hashes, so that passages many documents share don't meet in a prefix. The first order's
prefixes are inverted to find candidates; those that share no prefix shingle under the second or the third order are
dropped, on the prefixes alone; what is left is verified on the exact sets.

Links are wanted up to connection. First each set is compared with one central set of its groups, and what links is one
component from then on; after some such rounds all pairs of different components that can still be similar are compared.
Shingles of a set's prefix that no other prefix has bound what it can share with others: of a large group of loose copies
nearly all pairs are ruled out by that before they are formed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bitmaps import bitmap_of, members, opened
from corvane.llm.components import counted_components
from corvane.llm.store import dropped, settled, tidy
from corvane.llm.words import BASE, U, Words, grams, mix, slabs, sort_within

SKETCH_BITS = 21
BLOCK = 4096
SEEDS = (0, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)


def all_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every shingle, ordered by document. Fewer than ``size`` words make one shingle."""
    h, count = words.hashes(), words.count
    shingle, doc = grams(h, words.first, size)
    parts, owners = [shingle], [doc]
    doc_of = words.doc_of()
    for n in range(1, size):
        if len(short := np.flatnonzero(count == n)):
            hashed, doc = grams(h[np.isin(doc_of, short)], np.arange(len(short) + 1) * n, n)
            parts.append(hashed)
            owners.append(short[doc])
    if len(parts) == 1:
        return owners[0], parts[0]
    doc = np.concatenate(owners)
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate(parts)[order]


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every distinct shingle, ordered by both."""
    doc, shingle = all_shingles(words, size)
    sort_within(shingle, np.searchsorted(doc, np.arange(len(words) + 1)))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[new], shingle[new]


def counted(size: int):
    """A counting sketch of the shingles of one partition, in compressed blocks."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, words in slabs(batch, "text", True):
                sketch += np.bincount(bucket(all_shingles(words, size)[1]), minlength=len(sketch))
        block = [i for i in range(len(sketch) // BLOCK) if sketch[i * BLOCK : (i + 1) * BLOCK].any()]
        data = [zlib.compress(sketch[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in block]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    return run


def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for data in batch.column(1).to_pylist():
            total += np.frombuffer(zlib.decompress(data), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "data"])


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U(64 - SKETCH_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, size: int) -> bytes:
    """For each bucket of the sketch the logarithm of how far its count lies above the mean; 2 MB whatever the input."""
    with tidy(docs.sparkSession):
        rows = docs.select("text").mapInArrow(counted(size), "block int, data binary").groupBy("block").applyInArrow(added, "block int, data binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.float64)
    for r in rows:
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["data"]), np.int64)
    mean = sketch.mean()
    over = np.maximum(sketch - mean - 4 * np.sqrt(mean), 1.0)
    return zlib.compress(np.log2(over).astype(np.uint8).tobytes(), 1)


def set_hashes(shingle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash that is equal for equal sets, 0 for empty ones."""
    total = np.concatenate([[U(0)], np.cumsum(mix(shingle ^ U(BASE)), dtype=np.uint64)])
    ends = np.cumsum(n)
    return np.where(n == 0, U(0), mix((total[ends] - total[ends - n]) ^ n.astype(np.uint64) * U(BASE)))


def prefix_lists(shingle: np.ndarray, n: np.ndarray, levels: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, how many of each set): every set's prefix in one order. A token is its shingle's place in the order: the level of
    its frequency, then its seeded hash. Different shingles share a token with probability 2**-59, which only lets pairs through.
    """
    token = levels[bucket(shingle)].astype(np.uint64) << U(59) | (mix(shingle ^ U(seed)) if seed else shingle) >> U(5)
    edges = np.concatenate([[0], np.cumsum(n)])
    sort_within(token, edges)
    size = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
    rank = np.arange(len(token)) - np.repeat(edges[:-1], n)
    return token[rank < np.repeat(size, n)], size


SETS = "doc_id long, n_shingles long, set_id long, first array<long>, second array<int>, third array<int>, parity array<long>"


def described(size: int, percent: int, packed: bytes):
    """Per document the number of its shingles, its set's hash, and, once for each set and task, the set's prefixes."""

    def run(batches):
        levels, given = np.frombuffer(zlib.decompress(packed), np.uint8), set()
        for batch in batches:
            for at, rows, words in slabs(batch, "text", True):
                doc, shingle = shingle_sets(words, size)
                n = np.bincount(doc, minlength=rows)
                sig = set_hashes(shingle, n)
                new = np.zeros(rows, bool)
                for i, s in enumerate(sig.tolist()):
                    if s and s not in given:
                        given.add(s)
                        new[i] = True
                shingle, m = shingle[new[doc]], np.where(new, n, 0)
                lists = []
                for seed in SEEDS:
                    token, many = prefix_lists(shingle, m, levels, percent, seed)
                    value = token.view(np.int64) if not seed else (mix(token) >> U(32)).astype(np.uint32).view(np.int32)
                    off = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                    lists.append(pa.ListArray.from_arrays(off, pa.array(value), mask=pa.array(~new)))
                bits = np.bincount(np.repeat(np.arange(rows), m) * 256 + (shingle & U(255)).astype(np.int64), minlength=rows * 256) & 1
                parity = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 4), pa.array(parity), mask=pa.array(~new)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(n), pa.array(sig.view(np.int64)), *lists], names=["doc_id", "n_shingles", "set_id", "first", "second", "third", "parity"])

    return run


def wanted_sets(size: int, packed_docs: bytes, packed_sets: bytes):
    """(set, text) of the documents that may be wanted, before a join settles it."""

    def run(batches):
        by_doc, by_set = opened(packed_docs), opened(packed_sets)
        for batch in batches:
            keep = np.flatnonzero(members(by_doc, batch.column(2).to_numpy().view(np.uint64)))
            some = batch.take(pa.array(keep))
            given = set()
            for at, rows, words in slabs(some, "text", True):
                doc, shingle = shingle_sets(words, size)
                sig = set_hashes(shingle, np.bincount(doc, minlength=rows))
                own = [i for i in np.flatnonzero(members(by_set, sig)).tolist() if not (sig[i] in given or given.add(sig[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(sig[own].view(np.int64)), some.column(1).take(pa.array([at + i for i in own], pa.int64()))], names=["set_id", "text"])

    return run


def verified(size: int, percent: int):
    """Rows ordered by hub, share and kind (0: the hub's own text) to the pairs whose exact sets are similar."""

    def run(batches):
        key, hub = None, None
        for batch in batches:
            b, share, kind, a = (batch.column(i).to_numpy() for i in range(4))
            out = []
            for at, rows, words in slabs(batch, "text", True):
                doc, shingle = shingle_sets(words, size)
                edge = np.searchsorted(doc, np.arange(rows + 1))
                for i in range(rows):
                    own = shingle[edge[i] : edge[i + 1]]
                    if kind[at + i] == 0:
                        key, hub = (b[at + i], share[at + i]), own.copy()
                    elif key == (b[at + i], share[at + i]):
                        both = len(np.intersect1d(own, hub, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(hub) - both):
                            out.append(at + i)
            yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out])], names=["a", "b"])

    return run


PARITIES = [f"parity{i}" for i in range(4)]


def group():
    return Window.partitionBy("token")


def fits(percent: int, x: str, y: str) -> Column:
    """Whether sets of n_x and n_y shingles with a common token at places pos_x and pos_y of the order can be similar.

    met: how many shingles before the token stand in another prefix too. A set that has the token in its prefix has all that
    it shares of those before there as well, so it shares no others of them.
    """
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    most = F.least(f"met_{x}", f"met_{y}") + F.least(n_x - F.col(f"pos_{x}"), n_y - F.col(f"pos_{y}"))
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & ((100 + percent) * most >= percent * (n_x + n_y))


def named(df: DataFrame, x: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "token"])


def best_hubs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: for every set at most one hub of another component to be compared with.

    A group's hubs are its most central set and the most central one of another component; a set takes the hub that shares
    most of its tokens. So a round compares no more pairs than there are sets, however large the groups are.
    """
    crown = F.struct("weight", "set_id", "n", "pos", "met", "c")
    near = rows.repartition("token").withColumn("h1", F.max(crown).over(group()))
    near = near.withColumn("h2", F.max(F.when(F.col("c") != F.col("h1.c"), crown)).over(group())).where("h2 is not null")
    near = near.withColumn("h", F.when(F.col("c") != F.col("h1.c"), F.col("h1")).otherwise(F.col("h2")))
    near = near.select(F.col("set_id").alias("a"), F.col("h.set_id").alias("b"), "h.weight", *[F.col(f"{h}{c}").alias(f"{c}_{x}") for h, x in (("", "a"), ("h.", "b")) for c in ("n", "pos", "met")])
    near = near.where(fits(percent, "a", "b")).select("a", "b", "weight").repartition("a").groupBy("a", "b", "weight").agg(F.count("*").alias("k"))
    near = near.groupBy("a").agg(F.max_by("b", F.struct("k", "weight", "b")).alias("b"))
    return near.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"]).select("a", "b")


def remaining(rows: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """a, b: every pair of sets of different components that share a token and can be similar; a is the smaller one.

    The smaller set of a similar pair shares so much that one of its first n + 1 - 2 * percent * n / (100 + percent) shingles is
    common. Parity bits of the whole sets that differ count shingles that only one of them has, at least. The first common
    token's places bound the overlap, for what stands before it isn't shared.
    """
    mixed = rows.repartition("token").withColumns({"lo": F.min("c").over(group()), "hi": F.max("c").over(group())}).where("lo <> hi").drop("lo", "hi", "weight")
    mixed = settled(mixed.join(parities, "set_id"), "mixed")
    n_a, n_b, n, met, pos = (F.col(c) for c in ("n_a", "n_b", "n", "met", "pos"))
    light = mixed.where((pos <= n - F.ceil(2 * percent * n / (100 + percent))) & ((100 + percent) * (met + n - pos) >= 2 * percent * n))
    ordered = (n_a < n_b) | ((n_a == n_b) & (F.col("set_id_a") < F.col("set_id_b")))
    apart = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES)
    close = (100 + percent) * (n_a + n_b - apart) >= 2 * percent * (n_a + n_b)
    both = named(light, "a").join(named(mixed, "b"), "token").where((F.col("c_a") != F.col("c_b")) & ordered & fits(percent, "a", "b") & close)
    pairs = both.groupBy(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "n_a", "n_b").agg(F.min("pos_a").alias("i"), F.min("pos_b").alias("j"))
    return pairs.where((100 + percent) * F.least(n_a - F.col("i"), n_b - F.col("j")) >= percent * (n_a + n_b)).select("a", "b")


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85, productive: int = 10, share: int = 256) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id of every row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z). Documents link where 100 * |A and B| >= percent * |A or B| on their distinct ``size``-word
    shingles; fewer words are one shingle. Null, empty and blank texts have no shingles and link with nothing. Equal sets
    are one node, so copies cost nothing; ``component_id`` is the least doc_id reachable, null only where no reachable row has one.
    Every row gives one row, rows with the same doc_id each by their own text. An empty table gives an empty result; further
    columns are ignored. Rounds with hubs go on while at least one in ``productive`` of the pairs compared links; a hub's
    partners are dealt to tasks ``share`` at a time.
    """
    docs = docs.select("doc_id", "text")
    packed = frequency_levels(docs, size)
    known = settled(docs.mapInArrow(described(size, percent, packed), SETS), "sets")
    tokens = known.where("first is not null").select("set_id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("first").alias("pos", "token"))
    shared = tokens.repartition("token").dropDuplicates(["token", "set_id"]).withColumn("many", F.count("*").over(group())).where("many > 1")
    own = Window.partitionBy("set_id")
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    weight = ((F.sum("many").over(own) + length - F.count("*").over(own)) / length).cast("float")
    rows = shared.select("token", "set_id", "n", "pos", weight.alias("weight"), (F.row_number().over(own.orderBy("pos")) - 1).alias("met"))
    rows = settled(rows, "tokens")
    columns = ["second", "third", *[F.col("parity")[i].alias(p) for i, p in enumerate(PARITIES)]]
    lists = known.where("first is not null").select("set_id", "doc_id", *columns).join(rows.select("set_id").distinct(), "set_id", "left_semi")
    lists = settled(lists.dropDuplicates(["set_id"]), "prefixes")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that share a token in the other orders' prefixes too and whose exact sets are similar."""
        side = lambda x: lists.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("second", "third")])
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
        kept = settled(both.select("a", "b"), "pairs")
        hubs = kept.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
        members = kept.join(hubs, "b").select(F.col("a").alias("set_id"), "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "a")
        middle = hubs.select(F.col("b").alias("set_id"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("b").alias("a"))
        need = kept.select("a").union(kept.select("b")).distinct().toDF("set_id")
        by_doc = bitmap_of(lists.select("set_id", "doc_id").join(need, "set_id", "left_semi").select(F.xxhash64("doc_id")), 24)
        some = docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(wanted_sets(size, by_doc, bitmap_of(need, 24)), "set_id long, text string")
        texts = some.join(need, "set_id", "left_semi").dropDuplicates(["set_id"])
        dealt = members.union(middle).join(texts, "set_id").select("b", "share", "kind", "a", "text")
        return dealt.repartition("b", "share").sortWithinPartitions("b", "share", "kind").mapInArrow(verified(size, percent), "a long, b long")

    label, tested, stars = None, None, True
    while True:
        if label is None:
            at = rows.withColumn("c", F.col("set_id"))
        else:
            at = rows.join(label, rows["set_id"] == label["node"], "left").withColumn("c", F.coalesce("component", "set_id")).drop("node", "component")
        pairs = best_hubs(at, percent) if stars else remaining(at, lists.select("set_id", *PARITIES), percent)
        if tested is not None:
            pairs = pairs.join(tested.union(tested.select("b", "a")), ["a", "b"], "left_anti")
        pairs = settled(pairs, "candidates")
        n, label = joined(label, similar(pairs))
        if not stars:
            break
        tested = pairs if tested is None else tested.union(pairs)
        stars = n * productive >= max(pairs.count(), 1)

    nodes = known.where("n_shingles > 0").join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    roots = nodes.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    linked = nodes.join(roots, "c").select("doc_id", "n_shingles", "set_id", "component_id")
    return linked.union(known.where("n_shingles = 0").select("doc_id", "n_shingles", "set_id", F.col("doc_id").alias("component_id")))


def joined(label: DataFrame | None, found: DataFrame) -> tuple[int, DataFrame]:
    """(number of new links, node and component of all nodes) after the links ``found`` are added; earlier components are contracted,
    so only new links are walked. The components are settled: left as a plan they would be planned and worked out anew at every
    use, and each round's plan would hold all earlier ones several times, in the driver's memory too."""
    if label is None:
        n, over = counted_components(found, "a", "b")
        return n, settled(over, "components")
    lead = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    edges = found.join(lead("a"), "a", "left").join(lead("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    n, over = counted_components(edges, "a", "b")
    old = label.join(over.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = settled(old.union(over.join(label.select("node"), "node", "left_anti")), "components")
    dropped(label)
    return n, new
