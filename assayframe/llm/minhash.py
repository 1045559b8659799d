"""Near-duplicate groups from b-bit MinHash signatures.

A document's set is that of its five-word shingles.  Its minima under 125
permutations make 25 bands of 5 rows; documents that share a band are
candidates.  Two low bits of each minimum, packed, are what remains of a
signature: the share of equal two-bit cells, corrected for chance collisions,
estimates similarity, and only pairs whose estimate reaches the threshold less
six standard deviations are confirmed, exactly, on their full sets.

Documents with equal sets are one class, and only classes are compared, so
copies cost nothing.  A bucket is dealt into blocks of bounded
size.  Inside a block (first round), then, of buckets that still hold several
components, in blocks of like set size (second round), signatures are compared first;
only classes with a likely partner then bring their full sets, and what a block
returns is a forest of confirmed links, never its pairs.  A pair that shares
several bands is compared in the first of them.  So every likely pair in
different components is confirmed on full sets, and no link is lost to a cap.
Groups are found by large-star and small-star steps over the links.

Defined results: null or empty texts have no set and no link; with fewer than
five words the whole sequence is the one shingle; null ids count as larger than
any other; rows that repeat an id are documents of their own; an empty table
gives an empty result; columns that aren't named are not read, so their names
can't clash.  A pair at the
threshold shares no band with probability (1 - s^5)^25, 4.3e-7 at s = 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS, BANDS, ROWS = 5, 25, 5
BITS, CELLS = 2, 128
#: Classes, and shingles in all, that a block of a bucket holds on average at most.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Rows, and bytes of sets, of whole groups that a task holds at least before it works on them.
HELD_ROWS, HELD_BYTES = 4096, 16_000_000
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 6.0
#: Shingles whose permutations are computed together.
STRIDE = 4096
#: Bits of the sieve of ids, as a power of two: half a megabyte.
SIEVE_BITS = 22
#: Digests of sets already sent that a task remembers.
SENT = 50_000
_LARGEST = 2**63 - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_DRAW = np.random.default_rng(20240501)
_FACTORS = _DRAW.integers(0, 2**63, CELLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, CELLS, dtype=np.uint64)
_PLACES = _DRAW.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the distinct five-word shingles, sorted."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b"\x00" + b"\x20".join(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    both = h[:n] * _PLACES[0]
    for k in range(1, WORDS):
        both = both + _mix(h[k : n + k]) * _PLACES[k]
    return np.unique(_mix(both))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(CELLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STRIDE):
        part = hashes[at : at + STRIDE, None]
        out = np.minimum(out, ((part ^ _SHIFTS) * _FACTORS).min(0))
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low two bits of each (mixed) minimum, 32 cells to a word."""
    cells = (_mix(least) & np.uint64(3)).reshape(-1, 32)
    return (cells << np.arange(0, 64, BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


_LOW = np.uint64(0x5555555555555555)


def bar(threshold: float) -> float:
    """The least estimate that a pair at the threshold may have."""
    chance = 1.0 / (1 << BITS)
    match = chance + (1 - chance) * threshold
    return threshold - SLACK * np.sqrt(match * (1 - match) / CELLS) / (1 - chance)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Returns id, n_shingles, digest (of the set), buckets (one for each band) and packed (binary), a row for each row of ``docs``; of a ``row_col`` (a string) also ``key``."""

    also = ["key"] if row_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["id", "n_shingles", "digest", "buckets", "packed", *also]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for raw in batch.column(1):
                    own = shingles(words_of(raw.as_py()))
                    if not len(own):
                        rows.append((0, None, None, None))
                        continue
                    least = minima(own)
                    keys = _mix(least[: BANDS * ROWS].reshape(BANDS, ROWS) * np.uint64(2) + np.uint64(1))
                    band = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + keys[:, k])
                    rows.append((len(own), xxh3_128_digest(own.tobytes()), band.view(np.int64), pack(least).tobytes()))
                marks = [batch.column(2)] if also else []
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)], *marks], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"), *[F.col(row_col).alias(x) for x in also])
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, buckets array<long>, packed binary" + "".join(f", {x} string" for x in also))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of packed signatures, row by row, from counts of unequal cells."""
    d = a ^ b
    differ = np.bitwise_count((d | (d >> np.uint64(1))) & _LOW).sum(1, dtype=np.int64)
    chance = 1.0 / (1 << BITS)
    return ((CELLS - differ) / CELLS - chance) / (1 - chance)


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside consecutive groups of these (small) sizes."""
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(int(size), 1)
        base = starts[sizes == size][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _likely(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of row pairs those to confirm (in other components, of like size, first met in this bucket, estimated near), and the estimates."""
    component, n, side = rows["component"], rows["n"], rows["side"]
    # sizes alone rule out a similarity above their ratio; sides 0 and 2 are the two blocks of a pair of blocks
    ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & ((side[i] == 1) | (side[i] != side[j]))
    i, j = i[ok], j[ok]
    s = estimates(rows["packed"][i], rows["packed"][j])
    good = s >= bar(threshold)
    i, j, s = i[good], j[good], s[good]
    bands = rows["bands"]
    met = bands[i] == bands[j]
    own = bands[i, met.argmax(1)] == rows["bucket"][i]
    return i[own], j[own], s[own]


def _pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside groups, a bounded number at a time."""
    heads = np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(rows["group"])]]))
    small = sizes <= 64
    if small.any():
        at = np.flatnonzero(np.repeat(small, sizes))
        i, j = _within(sizes[small])
        for k in range(0, len(i), 500_000):
            yield at[i[k : k + 500_000]], at[j[k : k + 500_000]]
    for head, size in zip(heads[~small], sizes[~small]):
        for first in range(0, int(size) - 1, 256):
            i = np.repeat(np.arange(first, min(first + 256, size)), size)
            j = np.tile(np.arange(size), len(i) // size)
            yield head + i[j > i], head + j[j > i]


def _forest(rows: dict[str, np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Confirmed links of one group (all its rows with sets) that join what they can, no two in a ring."""
    num, den = threshold
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    codes = [flat[e - n : e] for e, n in zip(ends, sizes)]
    here = np.zeros(int(flat.max()) + 1, bool)
    found = [x for x in (_likely(rows, i, j, num / den) for i, j in _pairs(rows)) if len(x[0])]
    if not found:
        return []
    i, j, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-s, i))
    i, j = i[order], j[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for a, b in zip(cuts, cuts[1:]):
        me, others = int(i[a]), j[a:b].tolist()
        here[codes[me]] = True
        # first the best of each component that is known here, then the rest of those that it didn't join
        best: dict[int, int] = {}
        for k in others:
            best.setdefault(find(int(rows["component"][k])), k)
        for batch in (list(best.values()), others):
            batch = [k for k in batch if find(int(rows["component"][k])) != find(int(rows["component"][me]))]
            if not batch:
                continue
            met = np.add.reduceat(here[np.concatenate([codes[k] for k in batch])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[batch])[:-1]]))
            for k, m in zip(batch, met):
                x, y = find(int(rows["component"][k])), find(int(rows["component"][me]))
                if x != y and den * int(m) >= num * int(sizes[k] + sizes[me] - m):
                    root[x] = y
                    links.append((int(rows["class"][me]), int(rows["class"][k])))
        here[codes[me]] = False
    return links


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches as arrays that hold whole groups: a group cut by a batch's end waits for its rest."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, HELD_ROWS):
            held.append(whole.slice(at, HELD_ROWS))
            if sum(x.num_rows for x in held) < HELD_ROWS and sum(x.nbytes for x in held) < HELD_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = _group_ids(table, names)
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            if cut:
                yield _arrays(table.slice(0, cut), group[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        rest = pa.Table.from_batches(held).combine_chunks()
        if rest.num_rows:
            yield _arrays(rest, _group_ids(rest, names))


def _group_ids(table: pa.Table, names: list[str]) -> np.ndarray:
    columns = [table.column(c).to_numpy() for c in names]
    change = np.zeros(table.num_rows, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _arrays(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
    wide = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64).reshape(table.num_rows, -1)
    bands = np.concatenate([x.flatten().to_numpy() for x in table.column("buckets").chunks]).reshape(table.num_rows, -1)
    out = {"group": group, "packed": wide("packed"), "bands": bands, "n": table.column("n").to_numpy().astype(float)}
    out |= {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "class", "component", "side")}
    if "hashes" in table.column_names:
        out["hashes"] = table.column("hashes").to_pylist()
    return out


GROUP = ["bucket", "i", "j"]
DEALT = "bucket long, i long, j long, class long, component long, side int"


def blocks(members: DataFrame, classes: DataFrame, components: DataFrame, threshold: float, across: bool) -> DataFrame:
    """Members of buckets that hold several components, dealt into blocks (or, across, into pairs of blocks).

    The first round deals a class of a large bucket to one block of it.  For the
    second, classes of a bucket are parted by the size of their sets, in steps of
    the least ratio that a link allows, and a step is cut into blocks.  A class
    meets the blocks of its own step and of the two next to it, no others: sizes
    rule out every further link.  Steps that hold one component alone don't meet.
    """
    placed = members.join(components.hint("merge"), "class").join(classes.select("class", "n").hint("merge"), "class")
    all_of = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all_n")]
    count = F.least(F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all_n") / BLOCK_SHINGLES)), F.col("size")).cast("long")
    open_ = placed.groupBy("bucket").agg(*all_of).where("lo < hi")
    open_ = stored(open_.select(F.col("bucket").alias("open_bucket"), count.alias("blocks")).where("blocks > 1" if across else "blocks > 0"), "mh-open")
    rows = placed.join(open_.hint("merge"), F.col("bucket") == F.col("open_bucket"))
    if not across:
        block = F.pmod(F.xxhash64("class"), F.col("blocks"))
        return rows.select("bucket", block.alias("i"), block.alias("j"), "class", "component", F.lit(1).alias("side"))
    # a little wider than the ratio, so that rounding can't put a link two steps apart
    width = max(-math.log(threshold), 0.01) + 1e-6 if threshold > 0 else math.inf
    rows = stored(rows.select("bucket", "class", "component", "n", F.floor(F.log("n") / width).cast("long").alias("step")), "mh-wide")
    steps = rows.groupBy("bucket", "step").agg(*all_of).select("bucket", F.struct("step", count.alias("blocks"), "lo", "hi").alias("s"))
    steps = stored(steps.groupBy(F.col("bucket").alias("open_bucket")).agg(F.collect_list("s").alias("steps")), "mh-steps")
    told = rows.join(steps.hint("merge"), F.col("bucket") == F.col("open_bucket"))
    told = told.withColumn("own", F.filter("steps", lambda s: s["step"] == F.col("step"))[0])
    number = lambda step, block: step * F.lit(2**32) + block
    meets = lambda s: (F.abs(s["step"] - F.col("step")) <= 1) & (F.least(s["lo"], F.col("own.lo")) < F.greatest(s["hi"], F.col("own.hi")))
    others = F.flatten(F.transform(F.filter("steps", meets), lambda s: F.transform(F.sequence(F.lit(0), s["blocks"] - 1), lambda x: number(s["step"], x))))
    here = number(F.col("step"), F.pmod(F.xxhash64("class"), F.col("own.blocks")))
    spread = told.select("bucket", "class", "component", here.alias("here"), F.explode(others).alias("other"))
    side = F.when(F.col("here") < F.col("other"), 0).when(F.col("here") > F.col("other"), 2).otherwise(1)
    return spread.select("bucket", F.least("here", "other").alias("i"), F.greatest("here", "other").alias("j"), "class", "component", side.alias("side"))


def likely_members(dealt: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``dealt`` whose class has a likely partner in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, GROUP):
            likely = np.zeros(len(rows["class"]), bool)
            for i, j in _pairs(rows):
                i, j, _ = _likely(rows, i, j, threshold)
                likely[i] = likely[j] = True
            at = np.flatnonzero(likely)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][at]) for c in (*GROUP, "class", "component", "side")], [*GROUP, "class", "component", "side"])

    told = dealt.join(classes.select("class", "n", "packed", "buckets").hint("merge"), "class")
    return told.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, DEALT)


def confirmed_links(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) with den * intersection >= num * union, a forest in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, GROUP):
            links: list[tuple[int, int]] = []
            heads = np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1], [True]]))
            for a, b in zip(heads, heads[1:]):
                links += _forest({c: v[a:b] for c, v in rows.items()}, threshold)
            ab = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    told = members.join(classes.select("class", "n", "packed", "buckets").hint("merge"), "class").join(sets.hint("merge"), "class")
    return told.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a long, b long").distinct()


def _bit(key) -> int:
    """An id's bit in the sieve; ids are spread by a multiplication, null has its own."""
    return 0 if key is None else (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 64 - SIEVE_BITS


def class_sets(docs: DataFrame, wanted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """class and hashes of the classes in ``wanted`` (class, digest, id), computed anew from texts.

    No text is shuffled: a sieve of representatives' ids, whose size is fixed,
    goes to every worker, and only sets that pass it meet the wanted digests.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(k) for k in batch.column(0).to_pylist()], pa.int64())], ["bit"])

    spark = docs.sparkSession
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[wanted.select("id").mapInArrow(bits, "bit long").distinct().toArrow().column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        passed, sent = shared.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = {}
                for k, key in enumerate(batch.column(0).to_pylist()):
                    bit = _bit(key)
                    if passed[bit >> 3] >> (7 - (bit & 7)) & 1:
                        own = shingles(words_of(batch.column(1)[k].as_py())).tobytes()
                        digest = xxh3_128_digest(own)
                        # rows without an id pass together: what was sent before needn't go again
                        if digest not in sent:
                            sent.add(digest)
                            out[digest] = own
                if len(sent) > SENT:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], ["digest", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    found = rows.mapInArrow(run, "digest binary, hashes binary")
    named = wanted.select("class", F.col("digest").alias("set_digest")).hint("merge")
    return found.join(named, F.col("digest") == F.col("set_digest")).select("class", "hashes").dropDuplicates(["class"])


def components_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """class and component (the smallest class that links reach) of every class in ``nodes``.

    Large-star and small-star steps in turn: each node's larger, then smaller,
    neighbours are linked to the smallest one, until nothing changes.  Steps use
    grouped minima and joins alone, and each ends in a stored table.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now or not now["n"]:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star-min")
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "star-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "star-min")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        links = stored(small.where("u <> v").distinct(), "star")
    roots = links.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("root"))
    return nodes.select("class").join(roots, F.col("class") == F.col("__u"), "left").select("class", F.coalesce("root", "class").alias("component"))


def near_duplicates(docs: DataFrame, numerator: int = 85, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Returns id, n_shingles, component_id (the smallest id that links reach) and kept, a row for each row of ``docs``.

    With ``row_col``, a column of strings that tells rows apart, also ``key`` (its
    values) and ``first``: true of one row of each group, of those with the
    smallest id the one with the least key.
    """
    threshold, also = numerator / denominator, ["key"] if row_col else []
    signed = signatures(docs, id_col, text_col, row_col).withColumn("order", F.coalesce("id", F.lit(_LARGEST))).withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "mh-signed")
    place = F.struct("order", "key") if row_col else F.col("order")
    # The smallest row number of a set names its class; its signature is that of any of its rows.
    named = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min(place).alias("first"))
    named = stored(named, "mh-classes")
    classes = signed.where("n_shingles > 0").join(named.select("class", "first").hint("merge"), F.col("row") == F.col("class"))
    classes = stored(classes.select("class", "first", "id", "digest", F.col("n_shingles").alias("n"), "buckets", "packed"), "mh-representatives")
    banded = classes.select("class", F.explode("buckets").alias("bucket"))
    shared = stored(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("bucket").alias("shared_bucket")), "mh-shared")
    members = stored(banded.join(shared.hint("merge"), F.col("bucket") == F.col("shared_bucket")).select("class", "bucket"), "mh-members")
    components = stored(classes.select("class", F.col("class").alias("component")), "mh-components")
    links = None
    for across in (False, True):
        dealt = stored(blocks(members, classes, components, threshold, across), "mh-dealt")
        likely = stored(likely_members(dealt, classes, threshold), "mh-likely")
        if likely.isEmpty():
            continue
        wanted = classes.select("class", "digest", "id").join(likely.select("class").distinct().hint("merge"), "class")
        sets = stored(class_sets(docs, stored(wanted, "mh-wanted"), text_col, id_col), "mh-sets")
        found = stored(confirmed_links(likely, classes, sets, (numerator, denominator)), "mh-links")
        links = found if links is None else links.unionByName(found)
        components = stored(components_of(links, classes), "mh-components")
    firsts = classes.select("class", "first").join(components, "class").groupBy("component").agg(F.min("first").alias("least"))
    firsts = stored(firsts, "mh-firsts")
    by_class = stored(components.join(firsts, "component").select("class", "least"), "mh-least")
    by_set = stored(named.join(by_class, "class").select(F.col("digest").alias("set_digest"), "least"), "mh-by-set")
    told = signed.select("id", "order", "n_shingles", "digest", *also).join(by_set.hint("merge"), F.col("digest") == F.col("set_digest"), "left")
    least = F.coalesce("least.order" if row_col else "least", "order")
    return told.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(least == F.lit(_LARGEST), F.lit(None)).otherwise(least).alias("component_id"),
        (F.col("order") == least).alias("kept"),
        *[x for k in also for x in (F.col(k), F.coalesce(place == F.col("least"), F.lit(True)).alias("first"))],
    )
