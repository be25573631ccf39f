"""Near-duplicates by MinHash bands, odd sketches (Mitzenmacher, Pagh and Pham, 2014) and a check of the full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialise, ship_by_value, text_of
from quiver.llm.components import connected_components
from quiver.llm.shingles import WordHashes, as_bytes, mix, shingle_set, slices

ship_by_value(__name__)

#: MinHash samples, cut into bands; a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
SAMPLES, BANDS = 128, 32
#: Bits of the parity bitmap.
SKETCH_BITS = 512
#: Pairs whose sketches put them below this are not checked further: over 4 standard errors below 0.75.
SKETCH_FLOOR = 0.58
#: A pair is linked if the sets share at least so many hundredths of their union.
LINK_PERCENT = 75

#: Members of a bucket that a task compares with as many others by sketch, and shingles that a task compares with as many others exactly.
BLOCK_MEMBERS, BLOCK_SHINGLES = 8192, 2_000_000
#: Pairs of a task whose bands are compared at a time.
PAIRS_AT_ONCE = 20_000
#: Rays of a bucket's centre that one copy of the centre meets.
RAYS_OF_COPY = 1000
#: Ids of documents in candidate pairs are broadcast up to so many (8 bytes each).
MOST_BROADCAST = 2_000_000
#: Keys of at least this many rows, and of at least a share of one in MOST_HOT of all rows, are looked up from a broadcast table: at most MOST_HOT rows.
LEAST_HOT, MOST_HOT = 1000, 100_000

_PARITY = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _PARITY)


def odd_sketch(samples: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of a MinHash signature: each (position, value) flips one bit, so common samples cancel in an XOR."""
    place = np.arange(1, len(samples) + 1, dtype=np.uint64)
    bits = mix(samples + place * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def most_odd_bits(floor: float = SKETCH_FLOOR, samples: int = SAMPLES, size: int = SKETCH_BITS) -> int:
    """The XOR population count at which the estimated similarity falls to ``floor``."""
    different = 2 * samples * (1 - floor)
    return math.ceil(size / 2 * (1 - math.exp(-2 * different / size)))


def _functions(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, samples, np.uint64)[:, None] | np.uint64(1), rng.integers(0, 1 << 64, samples, np.uint64)[:, None]


def _minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), ~np.uint64(0), np.uint64)
    for start in range(0, len(found), 1024):
        low = np.minimum(low, (a * found[start : start + 1024] + b).min(axis=1))
    return low


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole shingle set of each document."""
    hashes = WordHashes()
    for batch in slices(batches):
        for start in range(0, batch.num_rows, 32):
            part = batch.slice(start, 32)
            sets = [shingle_set(text, hashes).view(np.int64) for text in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: size and two order-free sums of its shingle set, the hash of each band, and the odd sketch."""
    a, b = _functions(SAMPLES, 20140407)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    hashes = WordHashes()
    for batch in slices(batches):
        size, fp1, fp2, bands, parity = [], [], [], [], []
        for text in as_bytes(batch.column(1)):
            found = shingle_set(text, hashes)
            size.append(len(found))
            if not len(found):
                fp1.append(0), fp2.append(0), bands.append([]), parity.append(np.zeros(len(_PARITY), np.int64))
                continue
            fp1.append(found.sum(dtype=np.uint64).astype(np.int64)), fp2.append(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
            low = _minima(found, a, b)
            rows, key = low.reshape(BANDS, -1), salt
            for j in range(rows.shape[1]):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
            bands.append(key.view(np.int64))
            parity.append(odd_sketch(low))
        sketch = np.array(parity, np.int64).reshape(-1, len(_PARITY))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(fp1, np.int64)), pa.array(np.array(fp2, np.int64)), pa.array(bands, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(_PARITY)))],
            ["doc_id", "n_shingles", "fp1", "fp2", "bands", *_PARITY],
        )


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, copy, b, text of b), sorted so that a centre (b = a) stands before its rays, the pairs whose full shingle sets are similar enough."""
    hashes = WordHashes()
    at, held = None, {}  # the different sets of the centre: more than one if rows share its id
    for batch in slices(batches):
        a, copy, b = (batch.column(i).to_pylist() for i in range(3))
        keep = []
        for i, text in enumerate(as_bytes(batch.column(3))):
            if (a[i], copy[i]) != at:
                at, held = (a[i], copy[i]), {}
            y = shingle_set(text, hashes)
            if a[i] == b[i]:
                held[xxhash.xxh3_128_digest(y)] = y
            elif any(_similar(x, y) for x in held.values()):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= LINK_PERCENT * (len(x) + len(y) - both)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def candidates_of_task(members: pa.Table) -> pa.Table:
    """Members of a bucket, or of two blocks of it, that have a partner of another component whose size and sketch allow the similarity.

    A pair counts in the first band that it shares only. Whole rows of XOR population counts are built, in strips of
    bounded size; pairs never leave the task.
    """
    band = members.column("band")[0].as_py()
    component, size = members.column("component").to_numpy(), members.column("n_shingles").to_numpy()
    side, bands = members.column("side").to_numpy(), _matrix(members.column("bands"), BANDS)
    sketch = np.stack([members.column(s).to_numpy().view(np.uint64) for s in _PARITY], axis=1)
    here = np.zeros(len(component), bool)
    for left, right in _sides(component, side):
        strip = max(1, 2_000_000 // (len(right) * sketch.shape[1] + 1))
        for start in range(0, len(left), strip):
            x = left[start : start + strip]
            odd = np.bitwise_count(sketch[x][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
            least, most = np.minimum(size[x][:, None], size[right][None]), np.maximum(size[x][:, None], size[right][None])
            i, j = np.nonzero((odd <= most_odd_bits()) & (100 * least >= LINK_PERCENT * most) & (component[x][:, None] != component[right][None]))
            for part in range(0, len(i), PAIRS_AT_ONCE):
                u, v = x[i[part : part + PAIRS_AT_ONCE]], right[j[part : part + PAIRS_AT_ONCE]]
                first = bands[u, (bands[u] == bands[v]).argmax(axis=1)] == band
                here[u[first]] = here[v[first]] = True
    rows = np.flatnonzero(here)
    return pa.table({"band": pa.array(np.full(len(rows), band, np.int64)), "node": members.column("node").take(pa.array(rows)), "component": members.column("component").take(pa.array(rows))})


def _sides(component: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Left and right rows whose pairs hold all pairs of different components: block against block, or in one block all outside the largest component against all."""
    if side.any():
        return [(np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
    names, counts = np.unique(component, return_counts=True)
    return [(np.flatnonzero(component != names[counts.argmax()]), np.arange(len(component)))]


def links_of_task(members: pa.Table) -> pa.Table:
    """Links between members of different components by their whole shingle sets; of links that join the same components one is enough."""
    node, component, side = (members.column(c).to_numpy() for c in ("node", "component", "side"))
    lists = members.column("shingles").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(size, kind="stable")
    names, codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    codes = codes.astype(np.int32)  # a task has fewer than 2**31 shingles
    sets = [codes[edges[i] : edges[i + 1]] for i in order]
    node, component, side, size = node[order], component[order], side[order], size[order]
    joined, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    ids, root = np.unique(component, return_inverse=True)
    root, held = root.copy(), np.zeros(len(names), bool)
    out: list[tuple[int, int]] = []
    for left, right in _sides(component, side):
        wanted = np.zeros(len(node), bool)
        wanted[right] = True
        for x in left.tolist():
            # of similar enough sets the smaller has at least LINK_PERCENT of the larger
            lo = np.searchsorted(size, -(-LINK_PERCENT * size[x] // 100), "left")
            hi = np.searchsorted(size, 100 * size[x] // LINK_PERCENT, "right")
            if hi <= lo or not (wanted[lo:hi] & (root[lo:hi] != root[x])).any():
                continue
            held[sets[x]] = True
            both = np.add.reduceat(held[joined[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            held[sets[x]] = False
            near = lo + np.flatnonzero(wanted[lo:hi] & (100 * both >= LINK_PERCENT * (size[x] + size[lo:hi] - both)))
            for y in near.tolist():
                if root[x] != root[y]:
                    out.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _in_blocks(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Members of a bucket dealt to tasks (band, i, j) that hold every two of its blocks; side tells the second block."""
    sums = members.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = with_hot(members, sums, ["band"]).select(*members.columns, block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.withColumn("side", (F.col("block") > F.col("other")).cast("int")).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other")


def with_hot(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows to ``named``, which has one row a key with its number of rows in ``members``: a hot key meets its rows where they are."""
    named = materialise(named, "named")
    total = named.agg(F.sum("members").alias("n")).first()["n"] or 0
    hot = F.col("members") >= max(LEAST_HOT, total // MOST_HOT)
    few = F.broadcast(named.filter(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(named.filter(~hot), keys))


def _close(left: str, right: str) -> Column:
    """Sizes and sketches of two sides allow the similarity."""
    n, m = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    parts = [F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in _PARITY]
    return (100 * F.least(n, m) >= LINK_PERCENT * F.greatest(n, m)) & (sum(parts[1:], parts[0]) <= most_odd_bits())


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the ids; broadcast ids up to a number, so that the other texts stay where they are."""
    ids = materialise(ids.toDF("doc_id").distinct(), "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, copy, b) that hold on full sets. Texts of documents in no pair are left out before any shuffle, and a centre's text is sent once a copy."""
    rows = pairs.select("a", "copy", "b").union(pairs.select("a", "copy", F.col("a").alias("b")).distinct())
    needed = _only(texts, rows.select("b")).toDF("b", "text")
    sides = rows.join(needed, "b").select("a", "copy", "b", "text").repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b") != F.col("a"))
    return sides.mapInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Size of each document's shingle set, its group of near-duplicates, and whether it is the one that stays.

    1. One pass gives MinHash bands, odd sketch and fingerprint; equal sets collapse to one node.
    2. In every shared band the most central member (largest sum of bucket sizes) is paired with the others, as many
       pairs as members. Odd sketches drop hopeless pairs, full sets confirm the rest, components follow.
    3. Buckets that still hold several components are dealt to tasks by blocks. A task compares the odd sketches of its
       members of different components and names those with a partner; the whole sets of these are dealt to tasks once
       more, which let out one confirmed link for every two components that they join. So every pair that shares a band
       is either inside a component already or checked, but neither pairs nor texts of pairs are ever rows. A bucket
       of m members of which k are outside its largest component costs k * m XORs inside tasks, and its rows are copied
       once for every BLOCK_MEMBERS of m.

    Null or blank text: empty set, linked with nothing. Null doc_id: linked with nothing, component null, kept. Rows
    that share a doc_id count as one document in links. Repeated rows: each is returned. Empty table: no rows. Columns
    besides doc_id and text are ignored. Returns doc_id, n_shingles, component_id, kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    seen = materialise(texts.mapInArrow(signatures, _SIGNATURE), "signatures")
    able = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    print_of = ["n_shingles", "fp1", "fp2"]
    classes = materialise(able.groupBy(*print_of).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members")), "classes")
    first = able.dropDuplicates(["doc_id", *print_of]).join(classes.select(*print_of, F.col("node").alias("doc_id")), ["doc_id", *print_of])
    nodes = materialise(first.withColumnRenamed("doc_id", "node").drop("fp1", "fp2"), "nodes")
    texts = texts.filter("doc_id IS NOT NULL")

    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = materialise(with_hot(spread, shared, ["band"]), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    sketches = nodes.drop("bands")
    groups = nodes.select("node", F.col("node").alias("component")).limit(0)

    def placed() -> DataFrame:
        """Members of the buckets that hold several components, with their component."""
        now = buckets.join(groups, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
        mixed = now.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members")).filter("least < most").select("band", "members")
        return materialise(with_hot(now, mixed, ["band"]).drop("members"), "placed")

    def link(found: DataFrame) -> None:
        """Merge the components that links join."""
        nonlocal groups
        if not found.isEmpty():
            groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))

    # the most central member of a bucket is paired with the others
    members = buckets.select("band", "node", "n_shingles")
    top = F.max(F.struct("weight", "node", "n_shingles")).alias("c")
    centre = members.join(weight, "node").groupBy("band").agg(top, F.count(F.lit(1)).alias("members"))
    rays = with_hot(members, centre, ["band"]).filter((F.col("node") != F.col("c.node")) & (100 * F.least("n_shingles", "c.n_shingles") >= LINK_PERCENT * F.greatest("n_shingles", "c.n_shingles")))
    rays = materialise(rays.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct(), "rays")
    # a centre of very many rays is copied, and each copy meets a share of them
    copies = F.ceil(F.col("members") / RAYS_OF_COPY).cast("int")
    counts = materialise(rays.groupBy("a").agg(F.count(F.lit(1)).alias("members")), "counts")
    centres = counts.select("a", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    rays = with_hot(rays, counts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("copy"))
    x = centres.join(sketches.withColumnRenamed("node", "a"), "a")
    near = rays.alias("r").join(sketches.alias("y"), F.col("r.b") == F.col("y.node")).join(x.alias("x"), (F.col("r.a") == F.col("x.a")) & (F.col("r.copy") == F.col("x.copy"))).filter(_close("x", "y"))
    link(materialise(_confirm(materialise(near.select("r.a", "r.b", "r.copy").distinct(), "pairs"), texts), "links"))

    rest = placed().drop("n_shingles").join(nodes, "node")
    task = ["band", "i", "j"]
    near = _in_blocks(rest, F.lit(1), BLOCK_MEMBERS).groupBy(*task).applyInArrow(candidates_of_task, "band long, node long, component long")
    near = materialise(near.distinct(), "near")
    sets = _only(texts, near.select("node")).mapInArrow(shingle_sets, "node long, shingles array<long>")
    full = materialise(near.join(sets, "node"), "sets")
    link(materialise(_in_blocks(full, F.size("shingles"), BLOCK_SHINGLES).groupBy(*task).applyInArrow(links_of_task, "a long, b long").distinct(), "links"))

    named = classes.join(groups, "node", "left").select(*print_of, "members", F.coalesce("component", "node").alias("component_id"))
    linked = with_hot(able.select("doc_id", *print_of), named, print_of).select("doc_id", "n_shingles", "component_id")
    alone = seen.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


#: Links by counting common shingles of all pairs, and the smallest document reachable by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(r.b) AS BIGINT) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
