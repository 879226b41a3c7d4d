"""Near-duplicate groups by a chosen-path similarity join.

Every distinct shingle set gets one minwise value for each of ``coords`` coordinates. A tree starts with all sets in
one node. A node picks one coordinate, or two with the chance that makes 1/similarity on average; each set goes on
to one child for each picked coordinate, named by its minwise value there. Small nodes are compared exhaustively and
larger ones branch again, in ``TREES`` independent trees. The chance that the later trees all miss a pair at the threshold
grows with the depth of its nodes: by calculation 1.3e-05 at depth 2, 7.7e-04 at 4, 1.4e-02 at 8 and 6.6e-02 at 14.

Nothing emits all pairs of a group. Equal sets are one set from the start. Nodes of up to ``TINY`` sets give pairs,
which must look alike in their minwise values; a larger node is compared inside one task, at most ``NODE`` sets at a
time, on the full sets, and gives a spanning forest of links only. The first trees cut a node that is still too large
into random blocks; what these link is one component from then on, and later trees follow a large node only while it
holds different components. A node that is still large at the last level is compared block against block, so no pair
is left out. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import cut, fresh, lean_shuffles
from metalint.llm.components import connected
from metalint.llm.wordhash import batches_of, hash_words, mix

SHINGLE = 5
PERCENT = 75
TREES = 12
EARLY = 3
COORDS = 128
TINY = 8
#: A node of so many sets with so many shingles is compared in one task; a random block of a larger one is smaller.
NODE = 2048
NODE_SHINGLES = 1_000_000
BLOCK = 192
LEVELS = 14
#: Of a pair's minwise values so many must agree; a pair at the threshold has fewer with a chance below 1 in 100,000.
AGREE = 0.58

_RANDOM = np.random.Generator(np.random.PCG64(7))
_FLIP = _RANDOM.integers(0, 2**32, COORDS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_STEP_ARRAY = np.array(_STEP)


def _root_coords() -> list[tuple[int, int]]:
    """(tree, coordinate): one for each tree, a second for a third of the trees, so 4/3 = 1/similarity on average."""
    out = []
    for tree in range(TREES):
        picked = np.random.Generator(np.random.PCG64(1000 + tree)).choice(COORDS, 2, replace=False)
        out += [(tree, int(c)) for c in picked[:2 if tree % 3 == 0 else 1]]
    return out


ROOTS = _root_coords()


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a shorter text is one shingle, one without words none."""
    words, bounds = hash_words(texts, lower=True)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        rolled[:n - k] = rolled[:n - k] * _STEP[k % len(_STEP)] + words[k:]
    rolled = mix(rolled)
    sets = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            sets.append(np.unique(rolled[lo:hi - size + 1]))
        elif hi > lo:
            sets.append(mix((words[lo:hi] * _STEP_ARRAY[:hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of COORDS hash functions over a set."""
    low = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, ((short[at:at + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return low


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.reshape(-1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches):
        sets = shingle_sets(batch.column("text"))
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = np.zeros((len(sets), 2), np.uint64)
        values = np.zeros((len(sets), COORDS), np.uint32)
        for i, s in enumerate(sets):
            if len(s):
                digests[i] = mix(s).sum(dtype=np.uint64), mix(s ^ _STEP[1]).sum(dtype=np.uint64)
                values[i] = minwise(s)
        roots = np.stack([mix(values[:, c].astype(np.uint64) + np.uint64(tree << 44 | c << 32)) for tree, c in ROOTS], axis=1)
        short = (values >> np.uint32(16)).astype(np.uint16) ^ values.astype(np.uint16)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("th"), pa.array(sizes), pa.array(digests[:, 0].view(np.int64)),
            pa.array(digests[:, 1].view(np.int64)), _lists(roots.view(np.int64)), _lists(short.view(np.int16)),
        ], names=["doc_id", "th", "n_shingles", "d1", "d2", "roots", "sig"])


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _confirm_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 512):
        left, right = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
        keep = [linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def common_counts(sets: list[np.ndarray], asking: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some of the sets with all, from shingles that two or more sets have, some at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(asking), len(sets)), np.float32)
    width = 2048
    for at in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part[asking] @ part.T
    return total


def _node_links(group: pa.Table) -> pa.Table:
    """A spanning forest of the links in one node. Sets of one component count as joined already.

    The largest component asks for nothing: what links it to others shows from their side.
    """
    group = group.combine_chunks()
    ids = group.column("uid").to_numpy()
    _, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
    label = label.copy()
    sets = shingle_sets(group.column("text").combine_chunks())
    sizes = np.array([len(s) for s in sets])
    asking = np.flatnonzero(label != np.bincount(label).argmax())
    a, b = [], []
    if len(asking):
        common = common_counts(sets, asking)
        for k, i in enumerate(asking):
            hits = 100 * common[k] >= PERCENT * (sizes[i] + sizes - common[k])
            for j in np.flatnonzero(hits & (label != label[i])):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two or more sets, with the node's size; counted before they are joined."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    return cut(rows.join(sizes, "node"))


def _branch(rows: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """Children of nodes, by the coordinates that the node's name picks."""

    def child(coord: Column) -> Column:
        return F.xxhash64(F.col("node"), coord, F.col("sig")[coord])

    first = F.pmod(F.xxhash64(F.col("node"), F.lit(2 * level)), F.lit(COORDS)).cast("int")
    second = F.pmod(F.xxhash64(F.col("node"), F.lit(2 * level + 1)), F.lit(3 * COORDS)).cast("int")
    return rows.select("node", "uid", "early", "n_shingles").join(reps.select("uid", "sig"), "uid").select(
        "uid", "early", "n_shingles",
        F.explode(F.when((second < COORDS) & (second != first), F.array(child(first), child(second))).otherwise(F.array(child(first)))).alias("node"),
    )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).flatten().to_numpy().reshape(-1, COORDS) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b", "early"]).filter(pa.array((a == b).mean(axis=1) >= AGREE))


def _tiny_pairs(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of nodes of at most TINY sets whose minwise values look alike."""
    lists = rows.where(F.col("n") <= TINY).groupBy("node", "early").agg(F.sort_array(F.collect_set("uid")).alias("uids"))
    lists = lists.groupBy("uids").agg(F.max("early").alias("early"))
    pairs = lists.select("early", "uids", F.posexplode("uids").alias("i", "a"))
    pairs = pairs.select("early", "a", F.explode(F.slice("uids", F.col("i") + 2, F.lit(TINY))).alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.max("early").alias("early"))
    sig = reps.select("uid", "sig")
    pairs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return cut(pairs.mapInArrow(_alike, "a long, b long, early boolean"))


def _check_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.mapInArrow(_confirm_pairs, "a long, b long")


def _check_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows: (uid, label, block)."""
    return rows.join(texts, "uid").groupBy("block").applyInArrow(_node_links, "a long, b long")


def _fits() -> Column:
    return (F.col("n") <= NODE) & (F.col("weight") <= NODE_SHINGLES)


def _blocks() -> Column:
    """Random blocks of a node: as many sets and shingles each as one task compares quickly."""
    return F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / (NODE_SHINGLES // 4))).cast("int")


def _own_block() -> Column:
    return F.pmod(F.xxhash64(F.col("uid"), F.col("node"), F.lit(3)), _blocks()).cast("int")


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the nodes that hold more than one component."""
    nodes = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node")
    return rows.join(nodes, "node")


def _late_links(rows: DataFrame, reps: DataFrame, labels: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Links in the nodes of the later trees, which branch until they are small enough or hold one component."""
    out, level = [], 3
    rows = cut(_mixed(_with_labels(rows, labels)))
    # From here on only the sets in mixed nodes are looked at.
    uids = rows.select("uid").distinct()
    reps, texts, labels = (cut(df.join(uids, "uid", "left_semi")) for df in (reps.select("uid", "sig"), texts, labels))
    while True:
        small = rows.where(_fits()).withColumn("block", F.col("node"))
        out.append(cut(_check_blocks(small.select("uid", "label", "block"), texts)))
        large = rows.where(~_fits())
        if large.isEmpty():
            return out
        if level > LEVELS:
            break
        rows = cut(_mixed(_with_labels(_sized(_branch(large, reps, level)), labels)))
        level += 1
    own, other = F.col("own"), F.col("other")
    pairs = large.withColumn("own", _own_block()).withColumn("other", F.explode(F.sequence(F.lit(0), _blocks() - 1)))
    block = F.xxhash64("node", F.least(own, other), F.greatest(own, other))
    out.append(cut(_check_blocks(pairs.select("uid", "label", block.alias("block")), texts)))
    return out


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, first) for every row: th is its text's hash; first, that it leads its component."""
    with lean_shuffles(docs.sparkSession):
        return cut(_joined_groups(docs))


def _joined_groups(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    signed = cut(keyed.mapInArrow(_signatures, "doc_id long, th long, n_shingles long, d1 long, d2 long, roots array<long>, sig array<smallint>"))
    sets = ["n_shingles", "d1", "d2"]
    reps = signed.where("n_shingles > 0").groupBy(*sets).agg(
        F.min_by(F.struct("doc_id", "th", "roots", "sig"), F.struct("doc_id", "th")).alias("rep"))
    reps = cut(reps.select(*sets, "rep.*").withColumn("uid", F.monotonically_increasing_id()))

    early = F.array_contains(F.array(*[F.lit(i) for i, (tree, _) in enumerate(ROOTS) if tree < EARLY]), F.col("i"))
    level1 = _sized(reps.select("uid", "n_shingles", F.posexplode("roots").alias("i", "node")).select("uid", "n_shingles", "node", early.alias("early")))
    pairs = _tiny_pairs(level1, reps)
    level2 = _sized(_branch(level1.where(F.col("n") > TINY), reps, 2))

    need = pairs.select(F.explode(F.array("a", "b")).alias("uid")).union(level2.select("uid")).distinct()
    wanted = need.join(reps.select("uid", "doc_id", "th"), "uid")
    same = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["th"] == wanted["th"])
    texts = cut(wanted.join(keyed, same).select("uid", "text").dropDuplicates(["uid"]))

    early = level2.where("early").withColumn("label", F.col("uid")).withColumn(
        "block", F.when(_blocks() == 1, F.col("node")).otherwise(F.xxhash64("node", _own_block())))
    links = cut(_check_pairs(pairs.where("early"), texts).union(_check_blocks(early.select("uid", "label", "block"), texts)))
    labels = connected(links)

    rest = pairs.where("not early")
    for side in ("a", "b"):
        rest = rest.join(labels.toDF(side, f"label_{side}"), side, "left")
    rest = rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    late = [cut(_check_pairs(rest, texts)), *_late_links(level2.where("not early"), reps, labels, texts)]
    for part in late:
        links = links.union(part)
    labels = connected(links)

    # Ids before nulls, then the text's hash.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    named = signed.where("n_shingles > 0").select("doc_id", "th", *sets).join(reps.select(*sets, "uid"), sets)
    named = cut(_with_labels(named.select("doc_id", "th", "n_shingles", "uid"), labels).select("doc_id", "th", "n_shingles", "label"))
    smallest = named.groupBy("label").agg(F.min(place).alias("least"))
    out = named.join(smallest, "label").select(
        "doc_id", "th", "n_shingles", F.col("least.doc_id").alias("component_id"), place.eqNullSafe(F.col("least")).alias("first"))
    return out.union(signed.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; other columns are not looked at).

    Nulls and texts without words have no shingles and are their own component. Repeated rows are equal texts and
    share a component; each of them counts as kept if its doc_id is the smallest. A null doc_id is never the
    smallest, unless the whole component has none. An empty table gives an empty result.
    """
    named = _groups(docs)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, one row of each group: the one with the smallest doc_id, by its text's hash where several rows have that.

    Of equal rows one stays. A row with a null doc_id stays only if no row of its group has an id.
    """
    own, of_id, of_text = fresh(docs, "near_th", "kept_id", "kept_th")
    kept = _groups(docs).where("first").select(F.col("doc_id").alias(of_id), F.col("th").alias(of_text)).distinct()
    named = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = named.join(kept, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_text)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)
