"""SimHash near-dedup by the generalised pigeonhole principle.

Two fingerprints that differ in at most d bits agree, in one of m partitions of
the bits, up to that partition's threshold, if the thresholds sum to d - m + 1
(a partition with threshold -1 is never probed).  Correlated bits go into one
partition; thresholds come from a dynamic programme over estimated candidate
counts of all fingerprints.  Buckets are verified bit by bit and give spanning
links, not pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, components, lookup, stage

BITS = 64
#: A bucket beyond this size is split by more bits, once by each of these ways to cut all bits into blocks; what is
#: then together shares most of its bits.  Buckets still beyond it are dealt in parts, and each two parts meet in a task.
BUCKET_ROWS = 20_000
SPLITS = (
    lambda n: [sum(1 << b for b in range(BITS) if b % n == k) for k in range(n)],
    lambda n: [sum(1 << b for b in range(BITS) if b * n // BITS == k) for k in range(n)],
    lambda n: [sum(1 << b for b in range(BITS) if (b * n * n // BITS) % n == k) for k in range(n)],
)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text: XXH64 of its word shingles, repeats included; no words: 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        h = np.fromiter((digest(next(parts), seed) for _ in range(min(n - lo, 1 << 16))), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return sum(1 << b for b in (ones * 2 > n).nonzero()[0].tolist())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())], ["id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def correlated_partitions(together, n: int, m: int) -> list[list[int]]:
    """m groups of bits of near-equal size; each starts with the bit most correlated
    with those left and grows by the bit most correlated with the group.

    together[i][j]: in how many of n fingerprints bits i and j are both set.
    """
    import numpy as np

    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    strong = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = -(-len(left) // (m - g))
        group = [max(left, key=lambda b: (strong[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (strong[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i in -1..len-2 that sum to total at the least cost[i][t_i + 1]."""
    best = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for j, x in enumerate(row):
                if (s := used + j - 1) not in step or c + x < step[s][0]:
                    step[s] = (c + x, [*chosen, j - 1])
        best = step
    return best[total][1]


def plan(fps: DataFrame, distance: int = 3, choices=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds, from counts over all fingerprints."""
    import numpy as np

    def together(batches):
        import pyarrow as pa

        sums, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.record_batch([pa.array([*i.tolist(), -1]), pa.array([*j.tolist(), -1]), pa.array([*sums[i, j].tolist(), float(n)])], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(together, "i bigint, j bigint, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2081 rows
    matrix, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = int(r.n)
        else:
            matrix[r.i, r.j] = matrix[r.j, r.i] = r.n
    options = {m: correlated_partitions(matrix, n, m) for m in choices}
    masks = [(m, k, sum(1 << b for b in group)) for m, groups in options.items() for k, group in enumerate(groups)]
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for m, k, mask in masks]))
    counted = fps.select(values.alias("x")).groupBy("x.m", "x.k", "x.v").count()
    same = {(r.m, r.k): float(r.s) for r in counted.groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("s")).collect()}
    p = np.diag(matrix) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    best = None
    for m, groups in options.items():
        cost = []
        for k, group in enumerate(groups):
            # candidates at distance j relative to those at 0, bits taken as independent; probes at distance j
            spread, near, probes = np.array([1.0]), 0.0, 0
            for b in group:
                spread = np.convolve(spread, [1, differ[b] / (1 - differ[b])])
            row, ways = [0.0], 1
            for j in range(distance + 1):
                near += same.get((m, k), 0.0) * (spread[j] if j < len(spread) else 0.0)
                probes += ways
                row.append(near + 20.0 * max(n, 1) * (probes + (j > 0)))
                ways = ways * (len(group) - j) // (j + 1)
            cost.append(row)
        chosen = allocate(cost, distance - m + 1)
        price = sum(cost[k][t + 1] for k, t in enumerate(chosen))
        if best is None or price < best[0]:
            best = (price, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _probes(group: list[int], threshold: int) -> list[int]:
    """Bit patterns within the threshold of a partition's value."""
    found, last = [0], [(0, -1)]
    for _ in range(threshold):
        last = [(x | 1 << b, i) for x, at in last for i, b in enumerate(group) if i > at]
        found += [x for x, _ in last]
    return found


def links(fps: DataFrame, distance: int = 3, bucket_rows: int = BUCKET_ROWS, choices=(2, 3, 4)) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span every class of those within the distance."""
    entries = []
    for group, threshold in plan(fps, distance, choices):
        mask = sum(1 << b for b in group)
        for flip in _probes(group, threshold):
            entries.append((mask, flip))
    # a probe at threshold t also meets the plain entry of its neighbour, so plain entries stand once
    # the table of probes is one constant: expressions of each fingerprint come after it is exploded
    table = F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(_signed(flip)).alias("flip")) for mask, flip in entries])
    probes = fps.select("fp", F.explode(table).alias("x")).select("fp", "x.*")
    buckets = probes.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("v"), (F.col("flip") != 0).alias("probe"))
    out, rest = None, buckets
    for blocks in SPLITS:
        sizes = rest.groupBy("mask", "v").count().where(F.col("count") > bucket_rows)
        big = stage(sizes.select(F.col("mask").alias("_m"), F.col("v").alias("_v")), "op4-big")
        if not big.take(1):
            break
        # two fingerprints within the distance agree in one of distance + 1 blocks, whatever the bits already fixed
        on = (F.col("mask") == F.col("_m")) & (F.col("v") == F.col("_v"))
        part = verified(rest.join(big, on, "left_anti"), distance)
        out = part if out is None else out.union(part)
        large = stage(rest.join(big, on, "left_semi"), "op4-large")
        large = large.withColumn("block", F.explode(F.array(*[F.lit(_signed(b)) for b in blocks(distance + 1)])))
        new = F.col("fp").bitwiseAND(F.col("block")).bitwiseAND(F.bitwise_not("mask"))
        rest = stage(large.select("fp", F.col("mask").bitwiseOR(F.col("block")).alias("mask"), F.col("v").bitwiseOR(new).alias("v"), "probe"), "op4-split")
    else:
        sizes = rest.groupBy("mask", "v").count().where(F.col("count") > bucket_rows)
        parts = F.ceil(F.col("count") / F.lit(max(1, bucket_rows // 2))).cast("bigint")
        big = stage(sizes.select(F.col("mask").alias("_m"), F.col("v").alias("_v"), parts.alias("_parts")), "op4-big")
        on = (F.col("mask") == F.col("_m")) & (F.col("v") == F.col("_v"))
        large = rest.join(big, on).withColumn("_own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("_parts")))
        large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        pair = F.greatest("_own", "_other") * F.col("_parts") + F.least("_own", "_other")
        out = out.union(verified(large.select("fp", "mask", "v", "probe", pair.alias("part")), distance))
        rest = rest.join(big, on, "left_anti")
    return verified(rest, distance) if out is None else out.union(verified(rest, distance))


def spanning(fp, distance: int):
    """Links (index, index) that span the classes of an array of fingerprints, without forming all pairs."""
    import numpy as np

    u, v = [], []
    left = np.arange(len(fp))
    frontier: list[int] = []
    while len(left):
        if frontier:
            here = frontier.pop()
        else:
            here, left = int(left[0]), left[1:]
        near = np.bitwise_count(fp[left] ^ fp[here]) <= distance
        if near.any():
            found = left[near]
            u += [here] * len(found)
            v += found.tolist()
            frontier += found.tolist()
            left = left[~near]
    return u, v


def verified(buckets: DataFrame, distance: int, small: int = 48) -> DataFrame:
    """Spanning links of each bucket (mask, v) or of each two parts of one (mask, v, part), checked on all bits."""
    names = ("mask", "v", *(["part"] if "part" in buckets.columns else []))

    def flush(keys, fp, probe):
        import numpy as np

        order = np.lexsort((fp, *keys[::-1]))
        keys, fp, probe = [k[order] for k in keys], fp[order].view(np.uint64), probe[order]
        edge = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        size = np.diff(np.r_[edge, len(fp)])
        us, vs = [], []
        for at, n in zip(edge[size > small].tolist(), size[size > small].tolist(), strict=True):
            group = fp[at : at + n]
            u, v = spanning(group, distance)
            us.append(group[u])
            vs.append(group[v])
        at = np.repeat(edge, size)
        end = np.repeat(edge + size, size)
        rows = np.flatnonzero(end - at <= small)
        for d in range(1, small):
            rows = rows[rows + d < end[rows]]
            if not len(rows):
                break
            near = rows[(np.bitwise_count(fp[rows] ^ fp[rows + d]) <= distance) & ~(probe[rows] & probe[rows + d])]
            us.append(fp[near])
            vs.append(fp[near + d])
        u, v = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (us, vs))
        if len(u):
            pairs = np.unique(np.stack([u, v], 1), axis=0)
            return np.ascontiguousarray(pairs[:, 0]).view(np.int64), np.ascontiguousarray(pairs[:, 1]).view(np.int64)
        return u.view(np.int64), v.view(np.int64)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []
        for batch in [*_with_end(batches)]:
            if batch is not None:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + len(names))])
                if sum(len(x[0]) for x in held) < 400_000:
                    continue
            if not held:
                continue
            fp, probe, *keys = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(fp)
            if batch is not None:  # the last bucket may go on
                same = np.all([k == k[-1] for k in keys], axis=0)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [[x[cut:] for x in (fp, probe, *keys)]] if cut < len(fp) else []
            if cut:
                u, v = flush([k[:cut] for k in keys], fp[:cut], probe[:cut])
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = buckets.select("fp", "probe", *names).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _with_end(batches):
    yield from batches
    yield None


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, distance: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits) and component_id.

    Fingerprints link at distance or fewer differing bits; component_id is the
    smallest key reachable, the document itself included (null keys are
    reachable but never the smallest unless nothing else is there).  Null and
    empty texts and texts of white space have fingerprint zero and link like any
    other.  Rows with equal keys are rows of their own.  An empty table gives an
    empty result; other columns are not read.
    """
    prints = stage(fingerprints(docs, text, key, width), "op4-fp")
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "op4-distinct")
    joined = components(links(distinct.select("fp"), distance, bucket_rows), "op4-cc")
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "op4-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    named = lookup(rooted, "root", smallest, "root", F.col("prints") >= F.lit(max(1000, rooted.count() // HOT_KEYS + 1)))
    hot = F.col("n") >= F.lit(max(1000, prints.count() // HOT_KEYS + 1))
    out = lookup(prints, "fp", named.select("fp", "n", "component_id"), "fp", hot)
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """The documents with the smallest key of their group, with all their own columns (rows with a null key stay)."""
    groups = near_copies(docs.select(key, text), text, key, width, distance)
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return inner.join(gone, F.col(f"c{docs.columns.index(key)}") == F.col("gone"), "left_anti").toDF(*docs.columns)
