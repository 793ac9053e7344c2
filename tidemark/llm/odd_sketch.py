"""Near duplicates on word shingles: MinHash bands find candidates, odd sketches of the same samples sift them, full sets decide.

An odd sketch folds all MinHash samples of a set into a bitmap by parity. The number of ones in the exclusive or of two
bitmaps tells how many samples differ, most sharply where few do; so it sifts candidates near the threshold before their full
sets meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, components, mix, pieces, span_hashes, words
from tidemark.session import stage

ROWS = 6
BANDS = 42
SAMPLES = ROWS * BANDS
BITS = 1024
WORDS = BITS // 64
# Buckets up to this size give their pairs directly; larger ones go through blocks of RING x MEMBERS classes.
SMALL = 16
RING, MEMBERS = 64, 512
_R = np.random.default_rng(11)
_FACTORS = _R.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _R.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ORDER = _R.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = "n_shingles long, h1 long, h2 long, bands array<bigint>, sketch array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a piece, one text after the other, and their bounds.

    Words are lower-cased in A-Z. A text of fewer words than a shingle is one shingle; one without words has none.
    """
    low = LOWER[data]
    starts, ends, doc = words(low, offsets)
    h = span_hashes(low, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        full += h[k : len(h) - width + 1 + k] * _ORDER[k % 64] + np.uint64(k)
    full = mix(full)
    edges = np.concatenate([[0], np.cumsum(count)])
    sets = []
    for d in range(n):
        a, b = edges[d], edges[d + 1]
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            sets.append(s[new])
        elif b > a:
            part = (h[a:b] * _ORDER[: b - a]).sum(keepdims=True, dtype=np.uint64)
            sets.append(mix(part + np.uint64(0x5851F42D4C957F2D) * np.uint64(b - a)))
        else:
            sets.append(full[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else full[:0], bounds


def set_names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit names of sets: equal sets have equal names."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    if len(values):
        for k, salt in enumerate((np.uint64(0), np.uint64(0xD6E8FEB86659FD93))):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt))])
            out[k] = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return out.view(np.int64)


def samples_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples (sets x SAMPLES) of non-empty sets."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(bounds) - 1), np.uint32)
    for j in range(SAMPLES):
        out[j] = np.minimum.reduceat(low * _FACTORS[j] + _SHIFTS[j], bounds[:-1])
    return out.T


def band_keys(samples: np.ndarray) -> np.ndarray:
    grouped = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(samples), 0)
    for r in range(ROWS):
        key = mix(key + grouped[:, :, r] * _ORDER[r])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Bitmaps of BITS bits: each sample flips the bit that its number and value hash to."""
    n = len(samples)
    bit = (mix(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount((bit + BITS * np.arange(n)[:, None]).ravel(), minlength=n * BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def differing_bits(similarity: float) -> int:
    """Expected ones in the exclusive or of two sketches of sets this similar."""
    return round(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def similarity_of(differing: int) -> float:
    """The estimate that `differing` ones stand for; 0 where the bitmaps look unrelated."""
    return max(0.0, 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing / BITS)))


def _features(batches, width):
    for batch in batches:
        for first, data, offsets in pieces(batch.column("text")):
            values, bounds = shingle_sets(data, offsets, width)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            keys, sketch = np.zeros((len(size), BANDS), np.int64), np.zeros((len(size), WORDS), np.int64)
            if len(some):
                s = samples_of(values, np.append(bounds[:-1][some], len(values)))
                keys[some], sketch[some] = band_keys(s), odd_sketches(s)
            names = set_names(values, bounds)
            listed = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
            carried = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, len(size)) for c in carried], pa.array(size), pa.array(names[0]), pa.array(names[1]), listed(keys), listed(sketch)],
                [*carried, "n_shingles", "h1", "h2", "bands", "sketch"])


def _sets(batches, width):
    """(cid, set) of the texts whose set has the name of the class that they were joined with."""
    for batch in batches:
        wanted = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")])
        for first, data, offsets in pieces(batch.column("text")):
            values, bounds = shingle_sets(data, offsets, width)
            names = set_names(values, bounds)
            right = np.flatnonzero((names == wanted[:, first : first + names.shape[1]]).all(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(pa.array(right + first)), pa.array([values[bounds[d] : bounds[d + 1]].tobytes() for d in right], pa.binary())],
                ["cid", "members"])


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(batches, percent):
    for batch in batches:
        keep = [
            jaccard_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _far(x: Column, y: Column) -> Column:
    """Ones in the exclusive or of two sketches."""
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(x[k].bitwiseXOR(y[k]))
    return total


def _block_links(table: pa.Table, percent: int, most: int) -> pa.Table:
    """Links of one block: each ring class against all others, nearest sketches first, one link for each pair of class and label."""
    ring = table.column("ring").to_numpy(zero_copy_only=False)
    cid, label = table.column("cid").to_numpy(), table.column("label").to_numpy()
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(cid), WORDS).view(np.uint64)  # counts of ones need unsigned numbers
    sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
    left, right = [], []
    others = np.flatnonzero(~ring)
    for i in np.flatnonzero(ring):
        ones = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1)
        near = others[(ones <= most) & (label[others] != label[i])]
        linked = set()
        for j in near[np.argsort(np.bitwise_count(sketch[near] ^ sketch[i]).sum(1), kind="stable")]:
            if label[j] not in linked and jaccard_reaches(sets[i], sets[j], percent):
                linked.add(label[j])
                left.append(cid[i])
                right.append(cid[j])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def similar_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, name: Column | None = None) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept); with `name`, a string that tells rows apart, also (name, root).

    root is one number for each component, also where components share their smallest id, and NULL without shingles.
    Rows are linked where 100 * |A and B| >= percent * |A or B|.

    component_id is the smallest id reachable over links; kept says whether a row has that id. NULL, empty and word-free texts have no
    shingles and are linked with nothing, each kept. Rows with a NULL id take part; they are kept only where no id is reachable. Repeated
    rows have equal results.

    1. Equal sets become one class, so copies cost one row of an aggregate. 2. Classes meet in buckets of equal bands; only
    buckets of two or more are kept. 3. In each bucket every class is paired with one centre (the member met most often), pairs are sifted
    by sketches and decided on full sets. 4. Components of these links label the classes; pairs with equal labels need no test. What
    is left in a bucket has labels other than its centre's: small buckets give those pairs directly, in large ones (bounded blocks
    of) such classes are tested against (blocks of) the centre's component and each other, and only one link for each class and
    label leaves the task. 5. Components of all links. A pair at 0.8 shares no band with probability 3e-6; sketches pass down to
    an estimate 0.2 below the threshold, eight deviations.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    named_rows = given if name is None else docs.select(F.col(id).cast("long").alias("id"), name.alias("name"), F.col(text).alias("text"))
    extra = [] if name is None else ["name"]
    schema = ", ".join(["id long", *[f"{c} string" for c in extra], FEATURES])
    seen = stage(named_rows.mapInArrow(lambda it: _features(it, width), schema), "features")
    classes = seen.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    most = differing_bits(percent / 100 - 0.2)

    rows = classes.select("cid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stage(rows.join(shared, "key"), "buckets")
    often = met.groupBy("cid").agg(F.sum("size").alias("often"))
    centre = stage(met.join(often, "cid").groupBy("key").agg(F.max(F.struct("often", "cid"))["cid"].alias("centre"), F.max("size").alias("size")), "centres")

    # full sets of all classes in some bucket, made again from one text of each
    wanted = met.select("cid").distinct().join(classes.select("cid", "least", "h1", "h2"), "cid")
    texts = given.join(wanted, given["id"].eqNullSafe(wanted["least"])).select("cid", "h1", "h2", "text")
    sets = stage(texts.mapInArrow(lambda it: _sets(it, width), "cid long, members binary").dropDuplicates(["cid"]), "sets")
    sketches = classes.select("cid", "n", "sketch")

    def sifted(pairs: DataFrame) -> DataFrame:
        x, y = (sketches.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return pairs.join(x, "a").join(y, "b").where(near & (_far(F.col("sa"), F.col("sb")) <= most)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("cid").alias(c), F.col("members").alias(m)) for c, m in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _confirm(it, percent), "a long, b long")

    star = met.join(centre.drop("size"), "key").where("cid != centre").select(F.col("cid").alias("a"), F.col("centre").alias("b")).distinct()
    links = stage(confirmed(stage(sifted(star), "pairs")), "links")

    labels = components(links).select(F.col("node").alias("cid"), F.col("root").alias("label"))
    main = centre.where("size > 2").join(labels.withColumnRenamed("cid", "centre"), "centre", "left").select(
        "key", "centre", "size", F.coalesce("label", "centre").alias("main"))
    tied = met.drop("size").join(main, "key").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = tied.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    tied = stage(tied.join(mixed, "key"), "mixed")

    small = tied.where(F.col("size") <= SMALL)
    other = small.select("key", F.col("cid").alias("b"), F.col("label").alias("lb"))
    ring = small.where("label != main").select("key", F.col("cid").alias("a"), F.col("label").alias("la"), "centre")
    direct = ring.join(other, "key").where("la != lb and b != centre").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stage(confirmed(stage(sifted(direct), "pairs")), "links")

    far = _blocks(tied.where(F.col("size") > SMALL), labels, sketches, sets, percent, most)
    roots = components(links.union(more).union(far))
    root = F.coalesce("root", "cid")
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("h1", "h2", "least", root.alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "component_id", "root")
    out = seen.select("id", *extra, "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    reached = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    if name is not None:
        extra = ["name", "root"]
    return out.select("id", "n_shingles", reached.alias("component_id"), *extra).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _blocks(tied: DataFrame, labels: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links of classes in large buckets whose label is not the centre's: against the centre's component, and each other."""
    ring = stage(tied.where("label != main").select("main", "cid", "label").distinct(), "ring")
    sizes = ring.groupBy("main").agg(F.count(F.lit(1)).alias("ring_rows"))
    own = labels.union(ring.select("main", "main")).distinct().withColumnRenamed("label", "main")  # a centre without links is its own component
    members = own.join(sizes, "main").select("main", "cid", F.col("main").alias("label")).union(ring.select("main", "cid", "label"))
    counts = members.groupBy("main").agg(F.count(F.lit(1)).alias("member_rows")).join(sizes, "main").select(
        "main", F.ceil(F.col("ring_rows") / RING).cast("int").alias("i_n"), F.ceil(F.col("member_rows") / MEMBERS).cast("int").alias("j_n"))
    counts = stage(counts, "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = ring.join(counts, "main").select("main", "cid", "label", mine("i_n").alias("i"), every("j_n").alias("j"), F.lit(True).alias("ring"))
    right = members.join(counts, "main").select("main", "cid", "label", mine("j_n").alias("j"), every("i_n").alias("i"), F.lit(False).alias("ring"))
    both = left.unionByName(right).join(sketches.drop("n"), "cid").join(sets, "cid")
    columns = both.select("main", "i", "j", "cid", "label", "ring", "sketch", "members")
    return stage(columns.groupBy("main", "i", "j").applyInArrow(lambda t: _block_links(t, percent, most), "a long, b long"), "links")
