"""Exact Jaccard join of texts by pivots, regions and triangle-inequality windows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._graph import components
from trackloom.llm._storage import settle
from trackloom.llm._text import NON_SPACE, Words, row_blocks, shingle_sets

_SLOTS, _CHUNK = 1 << 22, 1 << 17
_BITS = 1 << 24
_SEEN = 100_000


def _names(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(column: pa.Array, size: int, clashes: frozenset[int] | None):
    """(row, sorted distinct shingle hashes, name of the set) of every text; the second digest names a set whose first one clashes. Without ``clashes`` the name is both."""
    for row, data, offsets in row_blocks(column, 1 << 18):
        for i, own in enumerate(shingle_sets(Words(data, offsets, NON_SPACE), size)):
            both = _names(own) if len(own) else (0, 0)
            yield row + i, own, both if clashes is None else both[both[0] in clashes]


def _clashes(described: DataFrame, most: int = 100_000) -> frozenset[int]:
    """First digests that several different sets have. Of ten thousand million sets some three are expected to."""
    both = described.where("n > 0").groupBy("sid").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("sid").limit(most + 1).collect()
    if len(both) > most:
        raise RuntimeError("too many sets share a digest")
    return frozenset(r.sid for r in both)


def signature(own: np.ndarray) -> np.ndarray:
    """Parities of the set's members by slot, about two slots a member: a bitmap that adds up to a smaller one's when folded."""
    slots = 64
    while slots < 2 * len(own):
        slots *= 2
    odd = np.bincount((own >> np.uint64(20)) & np.uint64(slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _may_link(sizes: np.ndarray, signatures: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Members with a partner whose size and signature allow a link.

    Parities differ in no more slots than the sets differ in members, and linked sets differ in at
    most (a + b) * (den - num) / (den + num) members, so nothing linked is lost.
    """
    order = np.argsort(sizes, kind="stable")
    found = np.zeros(len(sizes), dtype=bool)
    by_width: dict[int, np.ndarray] = {}

    def folded(width: int) -> np.ndarray:
        if width not in by_width:
            rows = [s.reshape(-1, width) if len(s) >= width else None for s in signatures]
            by_width[width] = np.stack([np.bitwise_xor.reduce(r, axis=0) if r is not None else np.zeros(width, dtype=np.uint64) for r in rows])
        return by_width[width]

    for k, i in enumerate(order):  # i is the smaller one
        rest = order[k + 1 :]
        rest = rest[den * sizes[i] >= num * sizes[rest]]
        if len(rest):
            table = folded(len(signatures[i]))
            apart = np.bitwise_count(table[rest] ^ table[i]).sum(axis=1, dtype=np.int64)
            near = rest[(den + num) * apart <= (den - num) * (sizes[i] + sizes[rest])]
            found[near] = True
            found[i] |= len(near) > 0
    return found


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set and signature of each row; and, once a task, how often each slot of shingles occurs."""

    def run(batches):
        counts = np.zeros(_SLOTS, dtype=np.uint32)
        for batch in batches:
            n, digests, sketch = np.zeros(batch.num_rows, dtype=np.int64), np.zeros((2, batch.num_rows), dtype=np.int64), [b""] * batch.num_rows
            for row, own, names_of in _sets(batch.column("text"), size, None):
                n[row], digests[:, row], sketch[row] = len(own), names_of, signature(own).tobytes()
                np.add.at(counts, own & np.uint64(_SLOTS - 1), 1)
            nothing = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *map(pa.array, digests), pa.array(sketch, pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        used = [k for k in range(_SLOTS // _CHUNK) if counts[k * _CHUNK : (k + 1) * _CHUNK].any()]
        packed = [zlib.compress(counts[k * _CHUNK : (k + 1) * _CHUNK].tobytes(), 1) for k in used]
        nothing = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([*[nothing.cast(pa.int64())] * 4, nothing.cast(pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "n", "sid", "other", "sketch", "chunk", "counts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sid long, other long, sketch binary, chunk int, counts binary")


def _tiers(described: DataFrame) -> np.ndarray:
    """0 for slots of ordinary shingles, and more the commoner a slot's are; a table of fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.int64)
        for packed in table.column("counts"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary()), "sum": pa.array([int(total.sum())])})

    totals = settle(described.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, total binary, sum long"), "slots")
    mean = (totals.agg(F.sum("sum")).first()[0] or 0) / _SLOTS
    usual = mean + 4 * np.sqrt(mean) + 1

    def grade(batches):
        for batch in batches:
            for chunk, total in zip(batch.column("chunk"), batch.column("total"), strict=True):
                counts = np.frombuffer(total.as_py(), dtype=np.int64)
                tier = np.where(counts > usual, 2 * np.log2(np.maximum(counts / usual, 1)) + 1, 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int32()), pa.array([tier.tobytes()], pa.binary())], ["chunk", "tier"])

    tiers = np.zeros(_SLOTS, dtype=np.int8)
    for chunk, tier in totals.mapInArrow(grade, "chunk int, tier binary").collect():  # _SLOTS bytes
        tiers[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(tier, dtype=np.int8)
    return tiers


def _prefix(own: np.ndarray, tiers: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles, rare ones before common ones, of which any linked set must hold one."""
    k = len(own) - -(-num * len(own) // den) + 1
    tier = tiers[own & np.uint64(_SLOTS - 1)]
    return own[:k] if not tier.any() else own[np.argsort(tier, kind="stable")[:k]]


def _regions(docs: DataFrame, size: int, num: int, den: int, tiers, ranges: int, clashes: frozenset[int]) -> DataFrame:
    """(pivot, sid, n): the members of each pivot's region, with the sizes of their sets.

    The shingles of a set's prefix are its nearest points. All sets that hold a point go to the
    region of one of them, the pivot with the least digest, so any linked pair meets in a region;
    holders of a point whose sizes alone rule a link out go to different regions.
    Postings travel as columns of numbers, one row for a range of points.
    """

    def post(batches):
        table, seen = tiers.value, set()
        points, names, sizes, held = [], [], [], 0

        def flush():
            p, s, n = np.concatenate(points), np.concatenate(names), np.concatenate(sizes)
            part = (p & np.uint64(ranges - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            p, s, n, part = p[order], s[order], n[order], part[order]
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            used = [k for k in range(ranges) if cuts[k + 1] > cuts[k]]
            slices = [slice(cuts[k], cuts[k + 1]) for k in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array([c[x].tobytes() for x in slices], pa.binary()) for c in (p, s, n)]], ["range", "points", "sids", "sizes"])

        for batch in batches:
            for _, own, name in _sets(batch.column("text"), size, clashes):
                if not len(own) or name in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                first = _prefix(own, table, num, den)
                points.append(first)
                names.append(np.full(len(first), name, dtype=np.int64))
                sizes.append(np.full(len(first), len(own), dtype=np.int32))
                held += len(first)
                if held >= 500_000:
                    yield flush()
                    points, names, sizes, held = [], [], [], 0
        if points:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        points, sids, sizes = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), dtype=d) for c, d in (("points", np.uint64), ("sids", np.int64), ("sizes", np.int32)))
        order = np.lexsort((sids, sizes, points))
        points, sids, sizes = points[order], sids[order], sizes[order].astype(np.int64)
        fresh = np.ones(len(points), dtype=bool)
        fresh[1:] = (points[1:] != points[:-1]) | (sids[1:] != sids[:-1])
        points, sids, sizes = points[fresh], sids[fresh], sizes[fresh]
        # no set links with one so much larger: a gap in size divides the holders of a point
        starts = np.flatnonzero(np.concatenate([[True], (points[1:] != points[:-1]) | (den * sizes[:-1] < num * sizes[1:])]))
        held = np.diff(np.concatenate([starts, [len(points)]]))
        pivots, shared = np.repeat(np.minimum.reduceat(sids, starts), held), np.repeat(held > 1, held)
        rows = np.unique(np.stack([pivots[shared], sids[shared], sizes[shared]], axis=1), axis=0)
        return pa.table({"pivot": pa.array(rows[:, 0]), "sid": pa.array(rows[:, 1]), "n": pa.array(rows[:, 2])})

    posted = docs.select("text").mapInArrow(post, "range int, points binary, sids binary, sizes binary")
    return posted.groupBy("range").applyInArrow(meet, "pivot long, sid long, n long").distinct()


def _needed_sets(docs: DataFrame, size: int, regions: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """(sid, tokens) of the sets that lie in a region. A bitmap of fixed size keeps the others from being sent."""
    slot = F.pmod("sid", F.lit(_BITS))
    rows = regions.select((slot / 32768).cast("long").alias("bucket"), F.pmod(slot, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(_BITS // 8, dtype=np.uint8)
    for bucket, own in rows:
        bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(own, dtype=np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            names, tokens = [], []
            for _, own, name in _sets(batch.column("text"), size, clashes):
                slot = name % _BITS
                if len(own) and bits[slot >> 3] >> (slot & 7) & 1 and name not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    tokens.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(tokens, pa.binary())], ["sid", "tokens"])

    return docs.select("text").mapInArrow(run, "sid long, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _overlaps(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is num / den at least."""
    x, y = len(a), len(b)
    if min(x, y) * den < num * max(x, y):
        return False
    both = _overlaps(a, b)
    return den * both >= num * (x + y - both)


def join_region(sets: list[np.ndarray], num: int, den: int, far: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that is linked among ``sets``; ``far``: distances to one pivot, if known.

    The rarest shingles within the region are pivots again: the sets that share one meet, the
    smallest is held against the others, and then whatever is still apart is held against each
    other, unless the distances to the region's pivot differ by more than the threshold.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    everything, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(everything, return_inverse=True, return_counts=True)
    order = np.lexsort((counts[inverse], owner))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(order)) - first[owner[order]]
    reach = sizes - -(-num * sizes // den) + 1
    keep = order[(place < reach[owner[order]]) & (counts[inverse[order]] > 1)]
    keep = keep[np.lexsort((sizes[owner[keep]], inverse[keep]))]
    points, owners = inverse[keep], owner[keep]
    starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]])) if len(points) else []
    ends = [*starts[1:], len(points)] if len(points) else []
    links, tried, limit = [], set(), 1 - num / den + 1e-9

    def hold(i: int, j: int) -> None:
        if (i, j) in tried or find(i) == find(j):
            return
        tried.add((i, j))
        if (far is None or abs(far[i] - far[j]) <= limit) and linked(sets[i], sets[j], num, den):
            links.append((i, j))
            parent[find(i)] = find(j)

    for a, b in zip(starts, ends, strict=True):
        group = owners[a:b].tolist()
        if len({find(i) for i in group}) < 2:
            continue
        for j in group[1:]:
            hold(group[0], j)
        if len({find(i) for i in group}) > 1:
            for k, i in enumerate(group):
                for j in group[k + 1 :]:
                    hold(i, j)
    return links


def _distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    both = np.array([_overlaps(pivot, s) for s in sets])
    return 1 - both / (len(pivot) + np.array([len(s) for s in sets]) - both)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, block: int = 256) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs(doc_id, text)``.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text's set holds its distinct
    shingles of ``size`` words, or all its words as one shingle if it has fewer. Two texts link
    when den * intersection >= num * union. Null and empty texts have no shingles and link with
    nothing, their component is their own doc_id. Rows with equal sets (told by 64-bit hashes of
    shingles and digests of sets; digests that clash are looked for and replaced) are one class and are
    compared once; rows with a null doc_id take part, and a component of such rows only is null;
    repeated rows are each returned; no rows give no rows; other columns are not read.

    Any set within the threshold must hold one of a set's first shingles in one global order,
    rare ones first; sets that hold the same one meet in the region of a pivot. Regions above
    ``block`` members are dealt out with a copy of the pivot in each part; the distances to the
    pivot then say which members can still be linked across parts, and only blocks of members
    whose distances differ by no more than the threshold meet again. Links are joined exactly; of
    linked groups a spanning part is kept, not all pairs.
    """
    spark = docs.sparkSession
    described = settle(_describe(docs, size), "shingles")
    total = described.agg(F.sum("n")).first()[0] or 0
    clashes = _clashes(described)
    if clashes:
        described = described.withColumn("sid", F.when(F.col("sid").isin(*clashes), F.col("other")).otherwise(F.col("sid")))
    tiers = spark.sparkContext.broadcast(_tiers(described))
    ranges = 1 << max(10, (total // 2_500_000).bit_length())
    regions = settle(_regions(docs, size, num, den, tiers, ranges, clashes), "regions")
    regions = settle(_sifted(regions, described, num, den, block), "regions")
    edges = components(_links(regions, docs, size, num, den, block, clashes))
    return _classes(described.where("chunk is null").select("doc_id", "n", "sid"), edges)


def _parts(block: int) -> F.Column:
    """Parts of a region, so that none has many more than ``block`` members or a million shingles."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / 1_000_000)).cast("long")


def _counted(regions: DataFrame, block: int) -> DataFrame:
    """``regions`` with the number of their parts, from a written table: a join with a grouping in its own stage could not be split for a large region."""
    return regions.join(settle(regions.groupBy("pivot").agg(_parts(block).alias("parts")), "parts"), "pivot")


def _sifted(regions: DataFrame, described: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Regions without the members that can link with no other of theirs; large ones stay as they are."""
    members = _counted(regions, block)
    sketches = described.where("n > 0").groupBy("sid").agg(F.first("sketch").alias("sketch"))

    def sift(table: pa.Table) -> pa.Table:
        signatures = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("sketch")]
        return table.filter(pa.array(_may_link(table.column("n").to_numpy(), signatures, num, den))).select(["pivot", "sid", "n"])

    small = members.where("parts = 1").join(sketches, "sid").groupBy("pivot").applyInArrow(sift, "pivot long, sid long, n long")
    return small.union(members.where("parts > 1").select("pivot", "sid", "n"))


def _links(regions: DataFrame, docs: DataFrame, size: int, num: int, den: int, block: int, clashes: frozenset[int]) -> DataFrame:
    sets = _needed_sets(docs, size, regions, clashes)
    members = _counted(regions, block).drop("n")
    own = members.where("sid <> pivot").withColumn("part", F.pmod(F.xxhash64("sid", "pivot"), F.col("parts")))
    pivots = members.where("sid = pivot").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = own.unionByName(pivots).join(sets, "sid")

    def within(table: pa.Table) -> pa.Table:
        sids = table.column("sid").to_pylist()
        pivot = table.column("pivot")[0].as_py()
        own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("tokens")]
        far = _distances(own[sids.index(pivot)], own) if pivot in sids else None
        limit = 1 - num / den + 1e-9
        links = [(i, j) for i, j in join_region(own, num, den, far)]
        out = [(sids[i], sids[j], None, None) for i, j in links]
        if table.column("parts")[0].as_py() > 1:
            out += [(pivot, s, float(d), bool(d <= limit)) for s, d in zip(sids, far, strict=True) if s != pivot]
        a, b, distance, near = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "far": pa.array(distance, pa.float64()), "near": pa.array(near, pa.bool_())})

    found = settle(dealt.groupBy("pivot", "part").applyInArrow(within, "a long, b long, far double, near boolean"), "links")
    links = found.where("far is null").select("a", "b")
    members = found.where("far is not null").select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "far", "near")
    return links.union(_across(members, docs, size, num, den, block, clashes)) if members.where("not near").limit(1).count() else links


def _across(members: DataFrame, docs: DataFrame, size: int, num: int, den: int, block: int, clashes: frozenset[int]) -> DataFrame:
    """Links between parts of a large region.

    Members within the threshold of the pivot are connected by it already. What is left are those
    beyond it, and, of the others, those so near the edge that a triangle allows a link.
    """
    limit = 1 - num / den + 1e-9
    edge = members.where("not near").groupBy("pivot").agg(F.min("far").alias("nearest"))
    left = members.join(edge, "pivot").where(F.col("far") >= F.col("nearest") - limit)
    step = limit / 2  # blocks within one shell of distances, met with blocks of the shells in reach
    shell = (F.col("far") / step).cast("int")
    counts = left.withColumn("shell", shell).groupBy("pivot", "shell").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    reach = counts.select("pivot", F.col("shell").alias("other"), F.col("blocks").alias("other_blocks"))
    met = counts.join(reach, "pivot").where(F.abs(F.col("shell") - F.col("other")) <= 3)
    placed = left.withColumn("shell", shell).join(met, ["pivot", "shell"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    placed = placed.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
    mine, other = F.struct("shell", "own"), F.struct(F.col("other").alias("shell"), F.col("theirs").alias("own"))
    keyed = placed.select("pivot", "sid", "far", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high")).distinct()
    keyed = settle(keyed, "blocks")
    sets = _needed_sets(docs, size, keyed, clashes)

    def within(table: pa.Table) -> pa.Table:
        sids = table.column("sid").to_pylist()
        own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("tokens")]
        links = join_region(own, num, den, table.column("far").to_numpy())
        return pa.table({"a": pa.array([sids[i] for i, _ in links], pa.int64()), "b": pa.array([sids[j] for _, j in links], pa.int64())})

    return keyed.join(sets, "sid").groupBy("pivot", "low", "high").applyInArrow(within, "a long, b long")


def _classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, classes.sid == roots.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    names = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")  # so that the join is split for a large class
    named = settle(rooted.join(names, "root").select("sid", "component_id"), "classes")
    full = rows.where("n > 0").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)
