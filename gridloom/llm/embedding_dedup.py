"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells; every
vector is indexed in the cell of its nearest pair of centres.  A query visits
cells in rising order of a lower bound on the distance to anything in them (the
multi-sequence order of the two sorted halves) as far as a radius.  The radius
is the one that reaches the target recall on a brute-force sample of queries
against all rows, with a margin, and never more than the radius at which no
pair can be missed; that radius serves where the samples meet too few links to
tell.  What is met is verified in double precision, and a pair that either end
meets counts for both.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, components, lookup, stage

#: Vectors that codebooks are fitted on, most vectors of a cell and most probes of it in one block, and bytes of crowded cells that are broadcast.
TRAIN_ROWS, BLOCK_ROWS, BROADCAST_BYTES = 20_000, 4_096, 20_000_000
#: Blocks are smaller where there are few vectors: one in BLOCK_SHARE of them, but LEAST_BLOCK at least.
BLOCK_SHARE, LEAST_BLOCK = 200, 256
#: Brute-force queries for the radius: the next number is drawn while fewer links than ENOUGH are met.
PROBE_ROWS, ENOUGH = (256, 1024, 4096), 64
MARGIN = 1.25


def _unit(vectors, width: int, dtype: str):
    """Rows of packed vectors as unit vectors in double precision, padded to a width."""
    import numpy as np

    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        x = np.frombuffer(v, dtype)
        row[: len(x)] = x
    with np.errstate(over="ignore"):
        scale = np.abs(out).max(1, keepdims=True)
        out /= np.where(scale > 0, scale, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _centres(points, k: int, rounds: int = 8):
    import numpy as np

    c = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * points @ c.T).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, points)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def bounds(x, book):
    """For each vector: its nearest centre, and the squared distance it has at least from each centre's cell."""
    import numpy as np

    d = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)
    near = d.argmin(1)
    apart = np.sqrt(np.maximum(((book[near][:, None, :] - book[None]) ** 2).sum(2), 1e-24)) if len(x) * book.size < 4e6 else np.sqrt(np.maximum((book**2).sum(1)[near][:, None] - 2 * book[near] @ book.T + (book**2).sum(1), 1e-24))
    b = np.maximum((d - d[np.arange(len(x)), near][:, None]) / (2 * apart), 0) ** 2
    b[np.arange(len(x)), near] = 0
    return near, b


def multi_sequence(first, second, radius2: float):
    """Cells (i, j) in rising order of first[i] + second[j], as far as radius2."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    heap, cells = [(u[0] + v[0], 0, 0)], []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > radius2:
            break
        cells.append((int(a[i]), int(b[j])))
        if j + 1 < len(v):
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))
    return cells


def _radius2(classes: DataFrame, books, width: int, dtype: str, cosine: float, recall: float) -> float:
    """Squared radius at which sampled queries meet the target share of their true links; the safe one where they have too few."""
    import numpy as np
    import pyarrow as pa

    most, half, bins = 2 - 2 * cosine + 1e-9, width // 2, 200
    for count in PROBE_ROWS if recall < 1 else ():
        sample = classes.orderBy(F.xxhash64("cid", F.lit(7)), "cid").limit(count).select("cid", "grp", "vec").collect()
        if not sample:
            return most
        q, groups, ids = _unit([r.vec for r in sample], width, dtype), np.array([r.grp for r in sample]), np.array([r.cid for r in sample])
        first, second = bounds(q[:, :half], books[0])[1], bounds(q[:, half:], books[1])[1]

        def run(batches, q=q, groups=groups, ids=ids, first=first, second=second):
            counts = np.zeros(bins + 1, np.int64)
            for batch in batches:
                for lo in range(0, len(batch), 1000):
                    part = batch.slice(lo, 1000)
                    x = _unit(part.column(2).to_pylist(), width, dtype)
                    same = groups[:, None] == np.array(part.column(1).to_pylist())[None]
                    i, j = np.nonzero((q @ x.T >= cosine) & same & (ids[:, None] != part.column(0).to_numpy()[None]))
                    if len(i):
                        c1, c2 = bounds(x[j][:, :half], books[0])[0], bounds(x[j][:, half:], books[1])[0]
                        met = first[i, c1] + second[i, c2]
                        counts += np.bincount(np.minimum(np.ceil(met / most * bins), bins).astype(int), minlength=bins + 1)
            yield pa.record_batch([pa.array(range(bins + 1)), pa.array(counts)], ["bin", "n"])

        counts = np.zeros(bins + 1)
        for r in classes.select("cid", "grp", "vec").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            counts[r.bin] = r.n
        if counts.sum() >= ENOUGH:
            at = int(np.searchsorted(np.cumsum(counts), recall * counts.sum() - 1e-9))
            return min(most, max((MARGIN**2) * (at + 1) / bins * most, most / 16))
        if len(sample) < count:
            break
    return most


def _pairs(group_q, group_x, cosine: float, mutual):
    """(ids, links that they gain) and links that span the classes of one block.

    The groups are (ids, weights, unit vectors); mutual tells which of chosen
    vectors of the second group visit the cells of chosen ones of the first.  A
    pair that only the probe meets counts here for both of its ends.
    """
    import numpy as np

    qid, q_weight, q = group_q
    xid, weight, x = group_x
    root, linked, back = np.arange(len(xid)), np.zeros(len(qid), np.int64), np.zeros(len(xid), np.int64)
    first = np.full(len(qid), -1)
    m = (q @ x.T >= cosine) & (qid[:, None] != xid[None])
    rows, columns = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    if not len(rows):
        return qid[rows], linked[rows], qid[rows], qid[rows]
    m = m[rows]
    linked[rows] = m @ weight
    alone = m[:, columns] & ~mutual(rows, columns)
    back[columns] = q_weight[rows] @ alone
    while True:
        old = root.copy()
        low = np.where(m, root[None], len(xid)).min(1)
        np.minimum.at(root, np.nonzero(m)[1], np.repeat(low, m.sum(1)))
        root = root[root]
        if (root == old).all():
            break
    first[rows] = np.where(m, root[None], len(xid)).min(1)
    moved, met = np.flatnonzero(root != np.arange(len(xid))), np.flatnonzero(back)
    return np.r_[qid[rows], xid[met]], np.r_[linked[rows], back[met]], np.r_[qid[rows], xid[moved]], np.r_[xid[first[rows]], xid[root[moved]]]


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, recall: float = 0.999) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept.

    Vectors are compared when their labels are equal and not null and their
    lengths agree; pairs found with at least the given cosine link.  Columns of
    floats are read as such, all others as doubles.  Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing.  Equal vectors are one class that is searched once.  component_id
    is the smallest key reachable, the vector itself included; rows with a null
    key count as vectors, are never the smallest, and are kept.  recall = 1
    visits every cell that could hold a link.  An empty table gives an empty
    result; other columns are not read.
    """
    import numpy as np
    import pyarrow as pa

    element = vectors.schema[vector].dataType.elementType.simpleString()
    dtype, element = ("<f4", "float") if element == "float" else ("<f8", "double")

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch.column(2):
                x = v.as_py()
                ok = x and None not in x
                x = np.array(x, dtype) if ok else None
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.record_batch([*batch.columns[:2], pa.array(out, pa.binary())], ["id", "label", "vec"])

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{element}>").alias("v"))
    rows = rows.mapInArrow(pack, "id bigint, label string, vec binary")
    group = F.concat_ws(":", F.octet_length("vec").cast("string"), "label")
    valid = F.col("vec").isNotNull() & F.col("label").isNotNull()
    rows = stage(rows.withColumn("grp", F.when(valid, group)).withColumn("ckey", F.when(valid, F.sha2(F.concat(F.encode("grp", "UTF-8"), F.lit(b"\0"), "vec"), 256))), "op6-rows")
    classes = rows.where(F.col("ckey").isNotNull()).groupBy("ckey", "grp", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = stage(stage(classes, "op6-classes").withColumn("cid", F.monotonically_increasing_id()), "op6-classes")
    total, width = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not total:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(2, width // np.dtype(dtype).itemsize)
    half = width // 2
    share = min(1.0, 1.1 * TRAIN_ROWS / total)
    train = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("cid"), "cid").limit(TRAIN_ROWS).select("vec").collect()
    points = _unit([r.vec for r in train], width, dtype)
    k = max(1, min(256, len(points), 1 << max(2, round(np.log2(max(1.0, total**0.5 / 7))))))
    books = _centres(points[:, :half], k), _centres(points[:, half:], k)
    radius2 = _radius2(classes, books, width, dtype, cosine, recall)

    def place(batches):
        for batch in batches:
            x = _unit(batch.column(2).to_pylist(), width, dtype)
            (n1, b1), (n2, b2) = bounds(x[:, :half], books[0]), bounds(x[:, half:], books[1])
            at, cell, probe = [], [], []
            for i in range(len(x)):
                cells = multi_sequence(b1[i], b2[i], radius2)
                at += [i] * (len(cells) + 1)
                cell += [int(n1[i]) * k + int(n2[i]), *(a * k + b for a, b in cells)]
                probe += [False, *[True] * len(cells)]
            take = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(cell, pa.int64()), pa.array(probe, pa.bool_())], ["cid", "grp", "vec", "n", "cell", "probe"])

    placed = classes.select("cid", "grp", "vec", "n").mapInArrow(place, "cid bigint, grp string, vec binary, n bigint, cell bigint, probe boolean")
    # crowded cells are split by vectors and by probes; each block of the one meets each block of the other
    room = min(BLOCK_ROWS, max(LEAST_BLOCK, total // BLOCK_SHARE))
    sizes = placed.groupBy("grp", "cell").agg(F.count_if("probe").alias("q"), F.count_if(~F.col("probe")).alias("x")).where((F.col("x") > 0) & (F.greatest("q", "x") > room))
    blocks = [F.greatest(F.lit(1), F.ceil(F.col(c) / room)).cast("int").alias(f"{c}s") for c in ("x", "q")]
    sizes = stage(sizes.select(F.col("grp").alias("_g"), F.col("cell").alias("_c"), *blocks), "op6-cells")
    crowded = sizes.agg(F.sum(F.octet_length("_g") + 40)).first()[0] or 0
    split = F.broadcast(sizes) if crowded <= BROADCAST_BYTES else sizes
    placed = placed.join(split, (F.col("grp") == F.col("_g")) & (F.col("cell") == F.col("_c")), "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("xs", "qs")})
    own, other = (F.when(F.col("probe"), F.col(a)).otherwise(F.col(b)) for a, b in (("qs", "xs"), ("xs", "qs")))
    mine = F.pmod(F.xxhash64("cid"), own)
    placed = placed.select("*", mine.alias("_mine"), F.explode(F.sequence(F.lit(0), other - 1)).alias("_theirs"))
    placed = placed.withColumn("block", F.when(F.col("probe"), F.col("_mine") * F.col("xs") + F.col("_theirs")).otherwise(F.col("_theirs") * F.col("xs") + F.col("_mine")).cast("int"))

    def verify(batches):
        held: list = []

        def flush(table):
            cid, vec, n = table.column("cid").to_numpy(), table.column("vec").to_pylist(), table.column("n").to_numpy()
            probe = table.column("probe").to_numpy(zero_copy_only=False)
            keys = list(zip(table.column("grp").to_pylist(), table.column("cell").to_pylist(), table.column("block").to_pylist(), strict=True))
            unit = _unit(vec, width, dtype)
            edge = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            out = ([], [], [])
            for lo, hi in zip(edge, edge[1:], strict=False):
                p = probe[lo:hi]
                q, x = lo + np.flatnonzero(p), lo + np.flatnonzero(~p)
                if len(q) and len(x):

                    def mutual(rows, columns, q=q, x=x):
                        """Whether vectors visit the cells of probes: chosen probes by chosen vectors."""
                        there, here = unit[q[rows]], unit[x[columns]]
                        one, two = bounds(there[:, :half], books[0])[0], bounds(there[:, half:], books[1])[0]
                        return (bounds(here[:, :half], books[0])[1][:, one] + bounds(here[:, half:], books[1])[1][:, two] <= radius2).T

                    gains, more, u, v = _pairs((cid[q], n[q], unit[q]), (cid[x], n[x], unit[x]), cosine, mutual)
                    out[0].extend([gains, u])
                    out[1].extend([np.full(len(gains), -1), v])
                    out[2].extend([more, np.zeros(len(u), np.int64)])
            return pa.record_batch([pa.array(np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64)) for c in out], ["u", "v", "w"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(len(x) for x in held) < 20_000:
                continue
            table = pa.concat_tables(held).combine_chunks()
            last = [table.column(c)[-1].as_py() for c in ("grp", "cell", "block")]
            cut = len(table)  # the last group may go on
            while cut and [table.column(c)[cut - 1].as_py() for c in ("grp", "cell", "block")] == last:
                cut -= 1
            held = [table.slice(cut)]
            if cut:
                yield flush(table.slice(0, cut).combine_chunks())
        if held:
            yield flush(pa.concat_tables(held).combine_chunks())

    at = ("grp", "cell", "block")
    found = placed.select("cid", "vec", "n", "probe", *at).repartition(*at).sortWithinPartitions(*at, "cid").mapInArrow(verify, "u bigint, v bigint, w bigint")
    found = stage(found, "op6-found")
    linked = found.where("v < 0").groupBy("u").agg(F.sum("w").alias("others"))
    joined = components(found.where("v >= 0").select("u", "v"), "op6-cc")
    named = classes.select("cid", "ckey", "first", "n").join(joined, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = stage(named.join(linked, F.col("cid") == F.col("u"), "left").select("ckey", "n", "root", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "op6-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    named = lookup(named, "root", smallest, "root", F.col("size") >= F.lit(max(1000, total // HOT_KEYS + 1)))
    hot = F.col("n") >= F.lit(max(1000, rows.count() // HOT_KEYS + 1))
    out = lookup(rows.select("id", "ckey"), "ckey", named.select("ckey", "n", "n_links", "component_id"), "ckey", hot)
    root = F.when(F.col("ckey").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), (F.col("id").isNull() | F.col("id").eqNullSafe(root)).alias("kept"))
