"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Identical shingle sets are first folded into one class by a 128-bit digest, so that groups of copies cost
one row. Classes that share a band are compared with the band's smallest class, and the links found join
classes to components. A second round takes, in bands whose classes are still apart, another leader in each
band, spread over the classes. A third compares in full what is then still apart. A pair of one component
needs no comparison. Classes that candidate pairs connect form a neighbourhood, which is dealt into blocks
of bounded size, and pairs of blocks are compared inside a task; only links leave it, and two blocks of one
component are not compared. So groups of thousands, linked or just not, are never expanded into rows of
pairs. Pairs across neighbourhoods, which are few, are compared one by one.

A pair is first pruned by its sizes and by a batch of one-bit hashes (equal with probability (1 + J) / 2),
then by its signatures, read in batches: after n hashes with m equal, the posterior of the similarity
(uniform prior) gives P(J >= t) = P(Bin(n + 1, t) <= m), and the pair goes once this is under `miss`. Pairs
that survive all batches are verified on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .components import connected_components
from .scratch import Scratch, documents, join_groups, shuffle_partitions

BLOCK = 1 << 20
#: One-bit hashes of a class, in so many longs: a bit of each of the first hashes' least values, mixed.
LONGS = 3
SKETCH = [f"s{k}" for k in range(LONGS)]
#: What a block of classes holds on average at most.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 17
_SEEDS = np.random.default_rng(11).integers(0, 2**32, (2, 4096), dtype=np.uint32)


def signatures(sets: list[np.ndarray], hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures, one row a set, of each least value's low 16 bits, and the one-bit hashes; sets are
    not empty. The low bits of a least value are those of its shingle, the same for all hashes but for a
    constant, so a one-bit hash is taken after mixing."""
    out, bits = np.empty((len(sets), hashes), np.uint16), np.empty((len(sets), 64 * LONGS), np.uint8)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 16384):
            n += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> B.U64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        y = np.empty_like(x)
        for k in range(hashes):
            np.bitwise_xor(x, _SEEDS[0, k], out=y)
            np.multiply(y, _SEEDS[1, k] | np.uint32(1), out=y)
            least = np.minimum.reduceat(y, starts)
            out[i:j, k] = least.astype(np.uint16)
            if k < 64 * LONGS:
                bits[i:j, k] = B.mix(least.astype(B.U64)) & B.U64(1)
        i = j
    return out, bits


def _signed(width: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.buffers(batch.column(1))
            for i, j in B.blocks(at, BLOCK):
                sets = B.shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig, one = signatures([sets[k] for k in full], hashes) if full else (None, None)
                keys, sigs = [None] * len(sets), [None] * len(sets)
                bits = np.zeros((len(sets), LONGS), np.int64)
                if full:
                    bits[full] = np.packbits(one, axis=1).view(np.int64)
                for n, k in enumerate(full):
                    keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    sigs[k] = sig[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(sigs, pa.binary()),
                        *(pa.array(bits[:, k]) for k in range(LONGS)),
                    ],
                    ["doc_id", "n", "setkey", "sig", *SKETCH],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.buffers(batch.column(1))
            for i, j in B.blocks(at, BLOCK):
                sets = B.shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                rid, sig = (batch.column(k).slice(i, j - i) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([rid, sig, pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "sig", "shingles"])

    return run


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                rid = some.column(0).to_numpy(zero_copy_only=False)
                sig = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(len(rid), -1)
                keys = np.empty((len(rid), bands), B.U64)
                for b in range(bands):
                    value = np.full(len(rid), b + 1, B.U64)
                    for k in range(b * rows, (b + 1) * rows):
                        value = B.mix(value * B.U64(0x9E3779B97F4A7C15) + sig[:, k])
                    keys[:, b] = value
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rid, bands))], ["key", "rid"])

    return run


@lru_cache
def least_matches(hashes: int, step: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch end n the fewest equal hashes at which P(J >= threshold) is not under `miss`."""
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return tuple(out)


def enough(shared: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * shared >= percent * (na + nb - shared)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verified(least: tuple[int, ...], step: int, percent: int):
    """Pairs (a, b, sig_a, sig_b, x, y) that are linked: signature batches, then full sets of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, most in enumerate(least):
                at = slice(k * step, (k + 1) * step)
                equal = equal + (p[alive, at] == q[alive, at]).sum(1)
                alive, equal = alive[equal >= most], equal[equal >= most]
            keep = []
            for k in alive.tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), B.U64) for c in (4, 5))
                if enough(overlap(x, y), len(x), len(y), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of the sets of two blocks, by products of their incidence matrices."""
    gx, gy = np.concatenate(x), np.concatenate(y)
    words = np.intersect1d(gx, gy)
    out = np.zeros((len(x), len(y)), np.float32)
    ix, iy = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    for part in range(0, len(words), 8192):
        some = words[part : part + 8192]
        grids = []
        for g, i, n in ((gx, ix, len(x)), (gy, iy, len(y))):
            at = np.minimum(np.searchsorted(some, g), len(some) - 1)
            here = some[at] == g
            grid = np.zeros((n, len(some)), np.float32)
            grid[i[here], at[here]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _compared(least: tuple[int, ...], step: int, percent: int):
    """Links between two blocks of classes of different components: sizes, signature batches, full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for k in range(2):
                    block = batch.column(k)[row].values
                    rid, comp = (block.field(f).to_numpy(zero_copy_only=False) for f in ("rid", "comp"))
                    sig = np.frombuffer(b"".join(block.field("sig").to_pylist()), np.uint16).reshape(len(rid), -1)
                    sets = [np.frombuffer(x, B.U64) for x in block.field("shingles").to_pylist()]
                    sides.append((rid, comp, sig, sets, np.array([len(x) for x in sets])))
                (ra, ca, sa, xa, na), (rb, cb, sb, xb, nb) = sides
                alive = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
                a, b = np.nonzero(alive)
                equal = np.zeros(len(a), np.int64)
                for k, most in enumerate(least):
                    at = slice(k * step, (k + 1) * step)
                    equal = equal + (sa[a, at] == sb[b, at]).sum(1)
                    keep = equal >= most
                    a, b, equal = a[keep], b[keep], equal[keep]
                if len(a) > 2000:
                    shared = overlaps(xa, xb)[a, b]
                else:
                    shared = np.array([overlap(xa[i], xb[j]) for i, j in zip(a, b, strict=True)], np.int64)
                keep = enough(shared, na[a], nb[b], percent)
                yield pa.RecordBatch.from_arrays([pa.array(ra[a[keep]]), pa.array(rb[b[keep]])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, miss: float = 1e-9) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents whose sets of `width`-word shingles have a Jaccard similarity of at least percent/100 are
    linked; component_id is the smallest doc_id reachable by links and kept marks that row. Words are
    runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text of fewer words has its word
    sequence as its one shingle. Null or empty texts and texts without words have no shingle and are
    linked with nothing. Rows of one doc_id count as one document. A row without doc_id is kept, with a
    null component. Other columns are ignored. With the defaults a pair at exactly 0.8 misses all bands
    with probability 1.2e-7, a pair at 0.85 with 2e-11.
    """
    scratch = Scratch(docs.sparkSession)
    hashes = bands * rows
    if hashes < 64 * LONGS:
        raise ValueError(f"bands * rows must be {64 * LONGS} at least")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n long, setkey binary, sig binary, " + ", ".join(f"{c} long" for c in SKETCH)
    signed = scratch.table(docs.mapInArrow(_signed(width, hashes), schema), "signed")
    classes = signed.where("setkey is not null and doc_id is not null").groupBy("setkey").agg(F.min("doc_id").alias("rid"), *(F.max(c).alias(c) for c in ("n", "sig", *SKETCH)))
    classes = scratch.table(classes, "classes")
    # Bands that hold more than one class. XOR with the key is undone by another, so the least XOR names a class.
    banded = classes.select("rid", "sig").mapInArrow(_banded(bands, rows), "key long, rid long")
    mixed = F.col("rid").bitwiseXOR(F.col("key"))
    leads = banded.groupBy("key").agg(F.min("rid").alias("lead"), F.max("rid").alias("last"), F.min(mixed).alias("other"), F.count(F.lit(1)).alias("members")).where("lead < last")
    leads = scratch.table(leads.select("key", "lead", F.col("other").bitwiseXOR(F.col("key")).alias("other"), "members"), "leads")
    shared = scratch.table(join_groups(banded, leads, "key", "members", "rid").drop("members"), "shared")
    scratch.drop(leads)
    sigs = classes.join(shared.select("rid").distinct(), "rid").select("rid", "n", "sig", *SKETCH)
    sigs = scratch.table(sigs, "sigs")
    texts = docs.join(sigs.select("rid", "sig"), docs.doc_id == sigs.rid).select("rid", "text", "sig")
    sets = scratch.table(texts.mapInArrow(_sets(width), "rid long, sig binary, shingles binary"), "sets")
    step = next(k for k in range(min(20, hashes), 0, -1) if hashes % k == 0)
    least = least_matches(hashes, step, percent / 100, miss)
    (bits,) = least_matches(64 * LONGS, 64 * LONGS, (1 + percent / 100) / 2, miss)

    def side(name: str, *columns: str) -> DataFrame:
        return sigs.select(F.col("rid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def alike() -> Column:
        """By size, exactly, and by the one-bit hashes."""
        equal = 64 * LONGS - sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH)
        return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (equal >= bits)

    def sketched(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a", "n", *SKETCH), "a").join(side("b", "n", *SKETCH), "b").where(alike()).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = sets.toDF("a", "sig_a", "x"), sets.toDF("b", "sig_b", "y")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b", "x", "y")
        return scratch.table(both.mapInArrow(_verified(least, step, percent), "a long, b long"), "links")

    def in_mixed(rows: DataFrame, part: str) -> DataFrame:
        """The rows of the bands whose rows differ in `part`."""
        sizes = rows.groupBy("key").agg(F.min(part).alias("lo"), F.max(part).alias("hi"), F.count(F.lit(1)).alias("members"))
        mixed = scratch.table(sizes.where("lo < hi").select("key", "members"), "mixed")
        return join_groups(rows, mixed, "key", "members", "rid").drop("members")

    def placed(comps: DataFrame) -> DataFrame:
        """The rows of bands that are in more than one component, with the component of each."""
        rows = shared.join(comps, shared.rid == comps.id, "left").select("key", "rid", "other", F.coalesce("comp", "rid").alias("comp"))
        return in_mixed(scratch.table(rows, "placed"), "comp")

    def led(rows: DataFrame, leader: str) -> DataFrame:
        return rows.where(F.col("rid") != F.col(leader)).select(F.least("rid", leader).alias("a"), F.greatest("rid", leader).alias("b")).distinct()

    star = led(shared, "lead")
    near = scratch.table(sketched(star), "near")
    links = confirmed(near)
    comps = connected_components(links, scratch)
    over = comps.select(F.col("id").alias("other"), F.col("comp").alias("comp_other"))
    apart = placed(comps).join(over, "other", "left").where(F.col("comp") != F.coalesce("comp_other", "other"))
    near2 = scratch.table(sketched(led(apart, "other").join(star, ["a", "b"], "left_anti")), "near")
    links = links.union(confirmed(near2))
    comps = connected_components(links, scratch)
    hoods = connected_components(near.union(near2), scratch).select("id", F.col("comp").alias("hood"))
    rest = placed(comps).join(hoods, F.col("rid") == hoods.id, "left").select("key", "rid", "comp", F.coalesce("hood", "rid").alias("hood"))
    rest = scratch.table(rest, "apart")
    # Across neighbourhoods: by pairs of a band.
    wide = in_mixed(rest, "hood").join(sigs.select("rid", "n", *SKETCH), "rid")
    left, right = (wide.select("key", F.col("rid").alias(k), F.col("hood").alias(f"hood_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("n", *SKETCH))) for k in "ab")
    pairs = left.join(right, (left.key == right.key) & F.expr("a < b and hood_a <> hood_b") & alike()).select("a", "b").distinct()
    across = confirmed(pairs)
    # Within: blocks of one component, or of small ones, that hold so many rows and shingles.
    members = rest.select("rid", "comp", "hood").distinct().join(sets, "rid")
    sizes = rest.select("rid", "comp", "hood").distinct().join(sigs.select("rid", "n"), "rid").groupBy("hood", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    sizes = sizes.withColumn("pool", F.when(F.col("c") >= BLOCK_ROWS // 2, F.col("comp")).otherwise(-1))
    mixed = sizes.groupBy("hood").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hood")
    pools = sizes.groupBy("hood", "pool").agg(F.ceil(F.greatest(F.sum("c") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    home = sizes.select("hood", "comp", "pool", "c").join(mixed, "hood").join(pools, ["hood", "pool"])
    home = scratch.table(home.select(F.struct("hood", "comp").alias("own"), "hood", "pool", "parts", "c"), "home")
    members = members.select(F.struct("hood", "comp").alias("own"), "rid", "comp", "sig", "shingles")
    blocks = join_groups(members, home, "own", "c", "rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    blocks = blocks.groupBy("hood", "pool", "part").agg(F.collect_list(F.struct("rid", "comp", "sig", "shingles")).alias("block"))
    blocks = scratch.table(blocks, "blocks")
    names = blocks.select("hood", "pool", "part")
    x, y = names.toDF("hood", "pool_a", "part_a"), names.toDF("hood", "pool_b", "part_b")
    order = F.struct("pool_a", "part_a") <= F.struct("pool_b", "part_b")
    couples = x.join(y, "hood").where(order & ~((F.col("pool_a") == F.col("pool_b")) & (F.col("pool_a") >= 0)))
    for k in "ab":
        couples = couples.join(blocks.toDF("hood", f"pool_{k}", f"part_{k}", f"block_{k}"), ["hood", f"pool_{k}", f"part_{k}"])
    within = couples.select("block_a", "block_b").repartition(shuffle_partitions(docs.sparkSession)).mapInArrow(_compared(least, step, percent), "a long, b long")
    last = scratch.table(within.union(across), "links")
    if last.limit(1).count():
        comps = connected_components(links.union(last), scratch)
    scratch.drop(shared, sets, sigs, rest, home, blocks, near, near2)
    found = classes.select("setkey", "rid").join(comps, classes.rid == comps.id, "left").select("setkey", F.coalesce("comp", "rid").alias("comp"))
    out = signed.select("doc_id", "n", "setkey").join(found, "setkey", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM t),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
