"""MinHash near-dedup by an LSH forest, with exact confirmation.

1. Each text becomes a set of word shingles, a MinHash signature of TREES * DEPTH values, and a digest of the set. Texts with
   equal sets are one node from here, however many they are.
2. A tree orders nodes by its own DEPTH values of the signature, one after the other. The nodes that follow one in that order are those with
   the longest common prefixes: each node descends from full depth, down to a prefix of one value, till it has NEIGHBOURS of them. Nodes that
   share the first `shallow` values are a region; each is a candidate of its region's hub (the least node), and in regions of more than
   REGION nodes of the hubs of all deeper prefixes too. That is a bounded number of candidates a node and tree, never all pairs of a
   region. Trees are dealt by ranges and taken by lots, so a huge region spreads over tasks and no task holds more than a lot.
3. Candidates that sizes or one bit of each signature value rule out are dropped (a true link with probability 2e-8).
4. Links are confirmed on full sets: first each node with its least candidate, which makes stars; then, of what is left, pairs
   of nodes that aren't in one component yet.
5. Nodes in runs too long for all their pairs to be candidates (or cut by the border of a task or lot) are crowded. They are joined exactly: two
   sets alike enough share a shingle among the rarest of each, so each node is listed by those, and nodes of one list that sizes
   and places in the order don't rule out are confirmed too, unless they are in one component by now. Lists are split by HOT.
6. Components grow by hooking to the least neighbour and pointer jumping, with lineage cut after each round.

A pair at the threshold is missed by all trees with a probability of (1 - t ** shallow) ** TREES: 7e-6 at 0.85, 1e-5 at 0.8.
Defined cases: without words (or null) a document is linked with nothing; with fewer words than a shingle, its whole
sequence is one shingle; rows with one doc_id (or none) and different texts are documents of their own, the least hash of doc_id
and text first; rows equal in both are one. A null doc_id is less than all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, STEP_BYTES, cut, forget, identified, identity, partitions, steps, trimmed, whole_row
from .kernels import BY_SPACE, LOWER, Sums, mixed, words

TREES = 16
DEPTH = 6
NEIGHBOURS = 4
REGION = 32
#: Rows of a tree that a task takes at a time.
LOT = 1 << 18
#: Edges of the graph of links in a part of a round.
EDGES = 100_000
#: Buckets by which shingles of crowded nodes are counted; any count gives an order that is right, a good one short lists.
BUCKETS = 1 << 20
#: Rows of a shingle that one task pairs with all others of it.
HOT = 1000
SHINGLE = 5
PERCENT = 80
_RNG = np.random.Generator(np.random.PCG64(8))
_MULTIPLY = _RNG.integers(0, 2**64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, TREES * DEPTH, dtype=np.uint64)
_DIGEST = _RNG.integers(0, 2**64, 2, dtype=np.uint64)


def shallow(percent: int) -> int:
    return 4 if percent >= 85 else 3


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts, sorted within each, and where each text's begin (one number more than texts)."""
    w = words(LOWER[data], off, BY_SPACE)
    n = np.diff(w.first)
    sums = Sums(w.hash)
    grams = sums.windows(k)
    each = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), each)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + w.first[:-1][doc]
    short = np.flatnonzero((n > 0) & (n < k))
    doc = np.r_[doc, short]
    grams = np.r_[grams[at], sums.of(w.first[short], w.first[short + 1])]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    if len(doc):
        first = np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])]
        doc, grams = doc[first], grams[first]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(did, rid, n, set1, set2, signature) of identified() rows; the signature is null where n is 0."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, data, off in steps(batches):
            grams, first = shingle_sets(data, off, k)
            n = np.diff(first)
            full = np.flatnonzero(n)
            values = np.zeros((len(full), TREES * DEPTH), np.uint32)
            digests = np.zeros((2, len(n)), np.uint64)
            if len(full):
                at = first[:-1][full]
                for i in range(TREES * DEPTH):
                    values[:, i] = np.minimum.reduceat((grams * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32), at)
                for i in range(2):
                    digests[i, full] = np.add.reduceat(mixed(grams ^ _DIGEST[i]), at)
            blobs: list = [None] * len(n)
            for i, row in zip(full.tolist(), values, strict=True):
                blobs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(n.astype(np.int32)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.array(blobs, pa.binary())], names=["did", "rid", "n", "set1", "set2", "signature"])

    return docs.mapInArrow(lambda batches: trimmed(sign(batches)), "did long, rid long, n int, set1 long, set2 long, signature binary")


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes into trees: p0, p1, p2 (the tree's number and its values, two to a number), sketch (a bit of each value)."""
    tree = (np.arange(TREES, dtype=np.uint64) << np.uint64(60))[None, :]
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(m, TREES, DEPTH).astype(np.uint64)
        path = [(sig[:, :, d] << np.uint64(32)) | sig[:, :, d + 1] for d in range(0, DEPTH, 2)]
        path[0] = tree | ((sig[:, :, 0] >> np.uint64(4)) << np.uint64(32)) | sig[:, :, 1]  # the first value gives 4 bits to the tree
        bits = (mixed(sig.reshape(m, -1)) & np.uint64(1)).astype(np.uint64)
        half = TREES * DEPTH // 2
        up = np.uint64(1) << np.arange(half).astype(np.uint64)
        sketch = [(bits[:, :half] * up).sum(axis=1, dtype=np.uint64), (bits[:, half:] * up).sum(axis=1, dtype=np.uint64)]
        spread = lambda x: pa.array(np.repeat(x, TREES))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.ravel().view(np.int64)) for x in path), spread(batch.column("did").to_numpy()), spread(batch.column("n").to_numpy()), spread(sketch[0].view(np.int64)), spread(sketch[1].view(np.int64))],
            names=["p0", "p1", "p2", "did", "n", "s1", "s2"],
        )


def _common(rows: dict[str, np.ndarray]) -> np.ndarray:
    """How many leading values each row but the first shares with the row before it."""
    out, going = np.zeros(max(len(rows["p0"]) - 1, 0), np.int64), True
    for c in ("p0", "p1", "p2"):
        unlike = rows[c][1:] ^ rows[c][:-1]
        for half in (unlike >> 32, unlike):
            going = going & (half == 0)
            out += going
    return out


def _pairs(rows: dict[str, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the candidates among rows in the order of their paths, and which rows are crowded."""
    m = len(rows["p0"])
    common = _common(rows)
    left, right = [], []
    # in this order the rows that follow have the longest prefixes: a node descends from full depth till it has NEIGHBOURS of them
    shared = common
    for step in range(1, NEIGHBOURS + 1):
        if m > step:
            shared = shared if step == 1 else np.minimum(shared[:-1], common[step - 1 :])
            same = np.flatnonzero(shared)
            left.append(same)
            right.append(same + step)
    here, sizes, crowded = np.arange(m), None, np.ones(m, bool)
    for level in range(depth, DEPTH + 1):
        new = np.r_[True, common < level]
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.diff(np.r_[start, m])[run]
        if sizes is None:
            sizes = size
            crowded = (size > NEIGHBOURS + 1) | (run == run[0]) | (run == run[-1])
        # the hub of each region: its row with the least did
        hub = np.lexsort((rows["did"], run))[start][run]
        star = (size > 1) & (hub != here) & ((level == depth) | (sizes > REGION))
        left.append(hub[star])
        right.append(here[star])
    return np.concatenate(left), np.concatenate(right), crowded


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a < b, of nodes (did, n, signature), each pair once; and (a, a) of crowded nodes."""
    t = percent / 100
    p = (1 + t) / 2
    enough = int(np.floor(TREES * DEPTH * (p - 5.5 * np.sqrt(p * (1 - p) / (TREES * DEPTH)))))
    depth = shallow(percent)
    names = ("p0", "p1", "p2", "did", "n", "s1", "s2")

    def found(held: list[dict[str, np.ndarray]]) -> np.ndarray:
        rows = {c: np.concatenate([h[c] for h in held]) for c in names}
        left, right, crowded = _pairs(rows, depth)
        small, large = np.minimum(rows["n"][left], rows["n"][right]).astype(np.int64), np.maximum(rows["n"][left], rows["n"][right]).astype(np.int64)
        unlike = np.bitwise_count((rows["s1"][left] ^ rows["s1"][right]).view(np.uint64)).astype(int) + np.bitwise_count((rows["s2"][left] ^ rows["s2"][right]).view(np.uint64))
        good = (100 * small >= percent * large) & (TREES * DEPTH - unlike >= enough) & (rows["did"][left] != rows["did"][right])
        alone = np.unique(rows["did"][crowded])
        a, b = np.r_[rows["did"][left[good]], alone], np.r_[rows["did"][right[good]], alone]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are taken by lots; a region that the border of a lot cuts is crowded, as one that a task's border cuts."""
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
                rows += batch.num_rows
            if held and (batch is None or rows >= LOT):
                pairs = found(held)
                for i in range(0, pairs.shape[1], 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0, i : i + 50_000]), pa.array(pairs[1, i : i + 50_000])], names=["a", "b"])
                held, rows = [], 0

    trees = nodes.mapInArrow(lambda batches: trimmed(_planted(batches)), "p0 long, p1 long, p2 long, did long, n int, s1 long, s2 long")
    dealt = trees.repartitionByRange(partitions(nodes.sparkSession), "p0", "p1", "p2", "did").sortWithinPartitions("p0", "p1", "p2", "did")
    return dealt.mapInArrow(lambda batches: trimmed(neighbours(batches)), "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are alike enough; texts has (did, blob)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        last, own = None, None

        def sets(blob: bytes) -> np.ndarray:
            data = np.frombuffer(open_.decompress(blob), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), k)[0]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "blob_a", "blob_b"))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if x[i] != last:
                    last, own = x[i], sets(x[i])
                other = sets(y[i])
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(own) + len(other) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(texts.select(F.col("did").alias("b"), F.col("blob").alias("blob_b")), "b").join(texts.select(F.col("did").alias("a"), F.col("blob").alias("blob_a")), "a")
    return both.select("a", "b", "blob_a", "blob_b").mapInArrow(lambda batches: trimmed(compare(batches)), "a long, b long")


def _opened(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with a blob, with shingle_sets() of their texts."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        at, held, size = 0, [], 0
        for i, blob in enumerate(batch.column("blob").to_pylist()):
            held.append(open_.decompress(blob))
            size += len(held[-1])
            if size >= STEP_BYTES or i + 1 == batch.num_rows:
                off = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int64)
                yield batch.slice(at, i + 1 - at), *shingle_sets(np.frombuffer(b"".join(held), np.uint8), off, k)
                at, held, size = i + 1, [], 0


def rarest(crowd: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, did, component, n, at, small) of crowd (did, component, blob): the first shingles of each set, rarest first.

    An overlap of percent * (n + m) / (100 + percent) leaves no set that shares none of them; small ones suffice in the smaller set.
    """
    mask = np.uint64(BUCKETS - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, grams, _ in _opened(batches, k):
            np.add.at(total, (grams & mask).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "rows"])

    sums = crowd.mapInArrow(counted, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    common = np.zeros(BUCKETS, np.int64)
    common[sums.column("bucket").to_numpy()] = sums.column("rows").to_numpy()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, grams, first in _opened(batches, k):
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, common[(grams & mask).astype(np.int64)], doc))
            at = np.arange(len(doc)) - first[:-1][doc]
            size = n[doc]
            keep = at <= size + -percent * size // 100
            grams, doc, at, size = grams[order][keep], doc[keep], at[keep], size[keep]
            small = at <= size + -2 * percent * size // (100 + percent)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), batch.column("did").take(take), batch.column("component").take(take), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(small)], names=["shingle", "did", "component", "n", "at", "small"])

    return crowd.mapInArrow(listed, "shingle long, did long, component long, n int, at int, small boolean")


def crowded_pairs(crowd: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a < b, of crowd (did, component, blob): every pair alike enough of two components, and a few that aren't."""
    rows = cut(rarest(crowd, k, percent))
    lists = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("small").alias("smalls"))
    lists = lists.where("low < high and smalls > 0").select("shingle", F.ceil(F.col("smalls") / HOT).cast("int").alias("parts"))
    rows = cut(rows.join(lists, "shingle"))
    x = rows.where("small").select("shingle", F.pmod(F.xxhash64("did"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"{c}_x") for c in ("did", "component", "n", "at")))
    y = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_y") for c in ("did", "component", "n", "at")))
    both = x.join(y, ["shingle", "part"]).where("component_x <> component_y and (n_x < n_y or n_x = n_y and did_x < did_y)")
    both = both.where(f"100L * n_x >= {percent}L * n_y and {100 + percent}L * least(n_x - at_x, n_y - at_y) >= {percent}L * (n_x + n_y)")
    return both.select(F.least("did_x", "did_y").alias("a"), F.greatest("did_x", "did_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) can reach.

    A round's tables have no more rows than the edges at first, so they are kept in as many parts as these need (EDGES each), not in
    one for every shuffle partition: most loops are over few rows, and each part is a file.
    """
    edges, labels = cut(edges.select("a", "b").where("a <> b").distinct()), None
    parts = min(partitions(edges.sparkSession), 1 + edges.count() // EDGES)
    kept = lambda df: cut(df.coalesce(parts))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = kept(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
        while True:  # pointer jumping: every node to its root
            above = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = kept(parent.join(above, "p", "left").select("node", F.coalesce("q", "p").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            parent = jumped.select("node", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "p")
            labels = kept(labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        a, b = parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = kept(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def linked(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(did, rid, n, component, first) of every row of identified() docs; component and first are the did and rid of its least row.

    Inside, did of a node is a number of its own: a doc_id may stand for several sets.
    """
    every = cut(signed(docs, k))
    own = every.where("n > 0").groupBy("set1", "set2").agg(F.min(F.struct("did", "rid", "n", "signature")).alias("first"))
    numbered = cut(cut(own).select("set1", "set2", F.col("first.did").alias("id"), F.col("first.rid").alias("rid"), F.monotonically_increasing_id().alias("did"), "first.n", "first.signature"))
    nodes = numbered.select("did", "n", "signature")
    met = cut(candidates(nodes, percent))
    pairs, crowd = met.where("a < b"), met.where("a = b").select(F.col("a").alias("did"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch, data, off in steps(batches):
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array([pack.compress(raw[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["id", "rid", "blob"])

    wanted = numbered.select("id", "rid", "did").join(met.select(F.explode(F.array("a", "b")).alias("did")).distinct(), "did", "left_semi")
    blobs = docs.mapInArrow(lambda batches: trimmed(packed(batches)), "id long, rid long, blob binary").join(wanted, ["id", "rid"])
    texts = cut(blobs.groupBy("id", "rid", "did").agg(F.first("blob").alias("blob")).select("did", "blob"))
    stars = cut(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, k, percent))
    first = cut(components(stars))
    # what is left: pairs between components, and not tried yet
    x, y = first.select(F.col("node").alias("a"), F.col("component").alias("ca")), first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    tried = pairs.groupBy("b").agg(F.min("a").alias("a"))
    apart = pairs.join(tried, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = cut(stars.unionByName(confirmed(apart, texts, k, percent)))
    labels = cut(components(links))
    if not crowd.isEmpty():
        crowd = crowd.join(labels, crowd["did"] == labels["node"], "left").select("did", F.coalesce("component", "did").alias("component"))
        others = crowded_pairs(texts.join(crowd, "did").select("did", "component", "blob"), k, percent).join(pairs, ["a", "b"], "left_anti")
        others = cut(confirmed(others, texts, k, percent))
        if not others.isEmpty():
            labels = components(links.unionByName(others))
    grouped = cut(numbered.join(labels, numbered["did"] == labels["node"], "left").select("set1", "set2", "id", "rid", F.coalesce("component", "did").alias("component")))
    least = grouped.groupBy("component").agg(F.min(F.struct("id", "rid")).alias("least"))
    roots = cut(grouped.join(least, "component").select("set1", "set2", "least"))
    alone = F.struct(F.col("did").alias("id"), "rid")
    rows = every.join(roots, ["set1", "set2"], "left").select("did", "rid", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("least")).otherwise(alone).alias("least"))
    return rows.select("did", "rid", "n", F.col("least.id").alias("component"), F.col("least.rid").alias("first"))


def deduplicated(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the least of their component by doc_id and hash; of rows equal in doc_id and text one, if it has words."""
    roots = linked(identified(docs), k, percent).where("did = component and rid = first")
    kept = cut(roots.groupBy("did", "rid").agg((F.max("n") > 0).alias("words"), F.count("*").alias("rows")).select("did", "rid", F.expr("words and rows > 1").alias("again")))
    named = docs.select(whole_row(docs).alias("doc"), *identity())
    rows = named.join(kept, ["did", "rid"])
    if not kept.where("again").isEmpty():
        rows = rows.where("not again").unionByName(rows.where("again").dropDuplicates(["did", "rid"]))
    return rows.select("doc.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = linked(identified(docs), 3, 85)
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return rows.select(null("did").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), F.expr("did = component and rid = first").alias("kept"))
