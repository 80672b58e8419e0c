"""Repeated passages by a logarithmic family of suffix arrays.

Every string of 50 bytes has an anchor: the place in it of the least hash of 16
bytes, the first such place on a tie.  Equal strings have equal anchors, so the
suffixes to sort are those of anchors, one for about 18 bytes: an anchor's
surroundings hold all strings that it stands for.  Arrays of surroundings are
dealt by anchor.  A new array is merge-scanned against the levels that are
there: of equal strings those of larger documents are cut, so the levels hold
each string under one document; levels of one size class are merged.  Surroundings
that differ around one anchor go through a second family, of arrays of their
strings of 50 bytes.

drop_repeats takes a table at once.  What is equal within an Arrow batch is
settled by the batch's own array, only anchors that two documents share are
dealt, and the strings of an anchor with very many surroundings are dealt by
their own hash.  SuffixIndex keeps levels as written tables, for documents that
come batch by batch.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage

ANCHOR = 16
#: Text bytes for each anchor group, shared anchors for each passage group, bytes of each text group,
#: bytes hashed at a time, strings of an array in a task, and surroundings that a task holds before it settles them.
#: What is dealt is a packed row for each two groups that meet, so rows grow with the square of the number of groups:
#: groups are as large as a task's memory allows.
GROUP_BYTES, GROUP_ANCHORS, TEXT_BYTES, PIECE_BYTES, BATCH, HELD = 16_000_000, 240_000, 8_000_000, 1 << 19, 20_000, 320_000
#: Text groups of a task: tasks grow in number, not in size.
TASK_GROUPS = 2
#: Open surroundings whose strings a task holds at once, whole anchors each time.
OPEN = 40_000
#: An anchor with more documents than this, and than one in HOT_SHARE of all anchors, is dealt string by string; there are HOT_SHARE such at most.
HOT_DOCS, HOT_SHARE = 2_000, 1_000_000
_DEALT = "bucket int, kind int, low binary, doc binary, n binary"
_FOUND = "dest bigint, docs binary, a binary"
_PASSAGES = "bucket int, kind int, h binary, doc binary, row binary, start binary, size binary, body binary"
_CUTS = "dest bigint, docs binary, rows binary, start binary, stop binary"


@functools.cache
def _zstd():
    """Functions that compress and decompress, one pair a worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def squeezed(x) -> bytes:
    """An array of integers, compressed byte plane by byte plane."""
    import numpy as np

    x = np.asarray(x, np.int64)
    base, most = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    used = ((most - base).bit_length() + 7) // 8
    planes = (x - base).view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes() if used else b""
    return base.to_bytes(8, "little", signed=True) + len(x).to_bytes(8, "little") + bytes([used]) + (_zstd()[0](planes) if used else b"")


def restored(data: bytes):
    import numpy as np

    base, n, used = int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:16], "little"), data[16]
    if not used:
        return np.full(n, base)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(_zstd()[1](data[17:]), np.uint8).reshape(used, n).T
    return planes.reshape(-1).view(np.int64) + base


def pieces(texts, length: int):
    """Concatenations of whole texts, or of overlapping parts of long ones: (bytes, [(text index, offset in text, first, last + 1)])."""
    parts, spans, size = [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - length + 1), PIECE_BYTES):
            part = t[lo : lo + PIECE_BYTES + length - 1]
            if size + len(part) > 1 << 20:
                yield b"".join(parts), spans
                parts, spans, size = [], [], 0
            spans.append((i, lo, size, size + len(part)))
            parts.append(part)
            size += len(part)
    if spans:
        yield b"".join(parts), spans


def anchored(data: bytes, spans, length: int):
    """Runs of strings with one anchor: arrays (span, first string, last string, hash of the anchor)."""
    import numpy as np

    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    h, width, base = x + np.uint64(1), 1, 0x100000001B3
    while width < ANCHOR:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    m = h & np.uint64(0xFFFFFFFFFFE00000) | np.arange(len(h), dtype=np.uint64)
    wide, have = length - ANCHOR + 1, 1
    while have * 2 <= wide:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < wide:
        m = np.minimum(m[: len(m) - (wide - have)], m[wide - have :])
    at = (m & np.uint64(0x1FFFFF)).astype(np.int64)
    owner = np.full(len(at) + 1, -1, np.int64)
    for k, (_, _, lo, hi) in enumerate(spans):
        owner[lo : hi - length + 1] = k
    owner = owner[: len(at)]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    keep = owner[new] >= 0
    new, last = new[keep], last[keep]
    return owner[new], new, last, h[at[new]]


class SuffixFamily:
    """Suffix arrays in levels of geometric size over strings of one width; a string is in them under one document only."""

    def __init__(self, width: int):
        import numpy as np

        self.dtype, self.levels = np.dtype(f"S{width}"), []  # (sorted strings, document of each, tag of each)

    def add(self, strings, docs, tags):
        """Tags of the strings, of this array or of those before it, that a smaller document holds; they are in no level from here on."""
        import numpy as np

        order = np.argsort(strings, kind="stable")
        strings, docs, tags = strings[order], docs[order], tags[order]
        lost = []
        if len(strings):
            new = np.flatnonzero(np.r_[True, strings[1:] != strings[:-1]])
            least = np.repeat(np.minimum.reduceat(docs, new), np.diff(np.r_[new, len(strings)]))
            lost.append(tags[docs > least])
            keep = docs == least
            strings, docs, tags = strings[keep], docs[keep], tags[keep]
        for k, (level, first, named) in enumerate(self.levels):
            if not len(strings) or not len(level):
                continue
            lo, hi = np.searchsorted(level, strings, "left"), np.searchsorted(level, strings, "right")
            met = hi > lo
            rival = first[np.minimum(lo, len(level) - 1)]
            mine, theirs = met & (rival < docs), met & (rival > docs)
            lost.append(tags[mine])
            if theirs.any():
                gone = np.zeros(len(level) + 1, np.int64)
                np.add.at(gone, lo[theirs], 1)
                np.add.at(gone, hi[theirs], -1)
                out = np.cumsum(gone[:-1]) > 0
                lost.append(named[out])
                self.levels[k] = (level[~out], first[~out], named[~out])
            strings, docs, tags = strings[~mine], docs[~mine], tags[~mine]
        self.levels.append((strings, docs, tags))
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            self._merge()
        return np.concatenate([np.empty(0, np.int64), *lost])

    def _merge(self) -> None:
        import numpy as np

        both = [np.concatenate(x) for x in zip(*self.levels[-2:], strict=True)]
        order = np.argsort(both[0], kind="stable")  # two rising runs
        self.levels[-2:] = [tuple(x[order] for x in both)]

    def all(self):
        """One array of all levels: sorted strings, documents and tags."""
        import numpy as np

        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else (np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64))


def surroundings(data: bytes, start, size, width: int):
    """Strings of size bytes from start on, as an array of one width: padded with zeros and followed by their size."""
    import numpy as np

    padded = np.frombuffer(data + bytes(width), np.uint8)
    body = np.empty((len(start), width + 2), np.uint8)
    body[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    body[:, :width][np.arange(width) >= np.asarray(size)[:, None]] = 0
    body[:, width], body[:, width + 1] = size >> 8, size & 255
    return body.reshape(-1).view(f"S{width + 2}")


def windows(strings, size, length: int):
    """All strings of length bytes of surroundings: (strings, which of them each is from, place in it)."""
    import numpy as np

    counts = size - length + 1
    which = np.repeat(np.arange(len(size)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    wide = strings.dtype.itemsize
    cells = np.ascontiguousarray(strings).view(np.uint8)
    found = np.lib.stride_tricks.sliding_window_view(cells, length)[which * wide + inner] if len(which) else np.empty((0, length), np.uint8)
    return np.ascontiguousarray(found).reshape(-1).view(f"S{length}"), which, inner


def digests(strings):
    """64-bit hashes of strings of one width."""
    import numpy as np

    wide = -(-strings.dtype.itemsize // 8) * 8
    words = np.ascontiguousarray(strings.astype(f"S{wide}")).view(np.uint64).reshape(len(strings), -1)
    h = np.zeros(len(strings), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def runs(keys, start, stop):
    """Maximal runs of the spans of each row of keys, as (keys, start, stop)."""
    import numpy as np

    if not len(start):
        return keys, start, stop
    order = np.lexsort((start, *keys[::-1]))
    keys, start, stop = [k[order] for k in keys], start[order], stop[order]
    group = np.cumsum(np.r_[0, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(group * far + stop)
    new = np.flatnonzero(np.r_[True, (group * far + start)[1:] > reach[:-1]])
    return [k[new] for k in keys], start[new], reach[np.r_[new[1:], len(reach)] - 1] - group[new] * far


def _bytes(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _packed(rows: DataFrame) -> DataFrame:
    """rows with text as compressed UTF-8, for a shuffle."""
    import pyarrow as pa

    at = rows.columns.index("text")

    def run(batches):
        squeeze = _zstd()[0]
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([squeeze(t) for t in _bytes(batch.column(at))], pa.binary())
            yield pa.record_batch(columns, batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'text' else t}" for n, t in rows.dtypes))


def _spread(doc, shift, xor):
    """Number from which a document's text group follows; doc is a column or an array."""
    return xor(xor(shift(doc, 7), shift(doc, 16)), doc)


def _by_group(dests: int, doc, **columns):
    """Rows (dest, packed columns) of arrays of equal length, one for each text group."""
    import numpy as np
    import pandas as pd

    dest = _spread(doc, np.right_shift, np.bitwise_xor) % dests
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    edge = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]])[: len(dest)]
    stop = np.r_[edge[1:], len(dest)][: len(edge)]
    return pd.DataFrame({"dest": dest[edge], **{name: [squeezed(x[order[lo:hi]]) for lo, hi in zip(edge, stop, strict=True)] for name, x in columns.items()}})


def _dealt(rows: DataFrame, packed: DataFrame, dests: int) -> DataFrame:
    """Texts by group, compressed, each group after the rows of packed (dest, binary columns) that are for it."""
    dest = F.pmod(_spread(F.col("doc"), F.shiftright, lambda a, b: a.bitwiseXOR(b)), F.lit(dests).cast("bigint"))
    texts = _packed(rows.select(dest.alias("dest"), F.col("key").isNotNull().alias("keyed"), "doc", "row", "text"))
    texts = texts.select("*", *[F.lit(None).cast("binary").alias(c) for c in packed.columns[1:]])
    both = texts.unionByName(packed, allowMissingColumns=True)
    return both.repartition(int(dests // TASK_GROUPS + 1), "dest").sortWithinPartitions("dest", F.col("text").isNotNull())


def _pieces_of(columns, schema: str):
    """A record batch of columns in the order of a schema string."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, types[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], names)


def _bucket(h, buckets: int):
    """Bucket of an anchor's hash; with its low half it names the anchor."""
    import numpy as np

    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _anchor_groups(docs: DataFrame, length: int, buckets: int, dests: int, hot_docs: int) -> DataFrame:
    """(dest, docs, a): documents and low halves of the hashes of anchors that they share with others, packed by
    text group; and (-1, buckets, low halves) of the anchors with more than hot_docs documents."""
    import numpy as np

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hs, ds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for data, spans in pieces(_bytes(batch.column(1)), length):
                owner, _, _, h = anchored(data, spans, length)
                hs.append(h)
                ds.append(ids[np.array([s[0] for s in spans])[owner]])
            h, d = np.concatenate(hs), np.concatenate(ds)
            if not len(h):
                continue
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            h, d = h[once], d[once]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[new, len(h)])
            many = np.repeat(count, count)
            bucket, low = _bucket(h, buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.zeros(len(h), bool)
            first[new] = True
            last = np.zeros(len(h), bool)
            last[new + count - 1] = True
            many[~first] = 0  # an anchor's documents are told with its first
            rows = ([], [], [], [], [])
            # kind 0 asks, kind 1 tells (first and last document of several), kind 2 is settled here
            several = np.repeat(count > 1, count)
            for kind, chosen in ((0, np.flatnonzero(~several)), (1, np.flatnonzero(several & (first | last))), (2, np.flatnonzero(several))):
                # any bucket passes on what is settled, so that goes to a few
                to = bucket[chosen] if kind < 2 else (ids[0] + d[chosen] % 8) % buckets
                order = np.argsort(to, kind="stable")
                chosen, to = chosen[order], to[order]
                if not len(to):
                    continue
                edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for lo, hi in zip(edge, [*edge[1:], len(to)], strict=True):
                    part = chosen[lo:hi]
                    for column, value in zip(rows, (int(to[lo]), kind, squeezed(low[part]), squeezed(d[part]), squeezed(many[part]) if kind < 2 else b""), strict=True):
                        column.append(value)
            yield _pieces_of(rows, _DEALT)

    def settle(pdf):
        import pandas as pd

        parts = {k: (restored(low), restored(doc)) for k, (low, doc) in enumerate(zip(pdf["low"], pdf["doc"], strict=True))}
        kinds = pdf["kind"].tolist()
        out = [x for k, x in parts.items() if kinds[k] == 2]
        dealt = [k for k in parts if kinds[k] < 2]
        hot = np.empty(0, np.int64)
        if dealt:
            low, doc = (np.concatenate([parts[k][i] for k in dealt]) for i in (0, 1))
            many = np.concatenate([restored(pdf["n"].iloc[k]) for k in dealt])
            ask = np.repeat([kinds[k] == 0 for k in dealt], [len(parts[k][0]) for k in dealt])
            order = np.argsort(low, kind="stable")
            low, doc, many, ask = low[order], doc[order], many[order], ask[order]
            new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            shared = np.repeat(np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new), np.diff(np.r_[new, len(low)])) & ask
            out.append((low[shared], doc[shared]))
            hot = low[new][np.add.reduceat(many, new) > hot_docs]
        low, doc = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
        found = _by_group(dests, doc, docs=doc, a=low)
        if len(hot):
            named = np.full(len(hot), int(pdf["bucket"].iloc[kinds.index(0) if 0 in kinds else kinds.index(1)]))
            found = pd.concat([found, pd.DataFrame({"dest": [-1], "docs": [squeezed(named)], "a": [squeezed(hot)]})])
        return found

    return docs.select("doc", "text").mapInArrow(deal, _DEALT).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(settle, _FOUND)


class _Run:
    """Surroundings gathered in a task, until they are settled by one array and dealt."""

    def __init__(self, length: int):
        self.length, self.width, self.parts, self.n = length, 2 * length - ANCHOR, [], 0

    def take(self, data: bytes, first, last, h, doc, row, start) -> None:
        size = last - first + self.length
        self.parts.append((surroundings(data, first, size, self.width), h, doc, row, start, size))
        self.n += len(h)

    def settled(self):
        """Survivors (strings, hash, document, row, start, size) in order, and the spans (document, row, start, stop) that are cut."""
        import numpy as np

        strings, h, doc, row, start, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        family = SuffixFamily(self.width + 2)
        lost = family.add(strings, doc, np.arange(len(doc)))
        strings, _, kept = family.all()
        return (strings, h[kept], doc[kept], row[kept], start[kept], size[kept]), (doc[lost], row[lost], start[lost], start[lost] + size[lost])


def _dealt_rows(kind: int, bucket, strings, h, doc, row, start, size):
    """Rows of _PASSAGES, one for each bucket."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
    for lo, hi in zip(edge, [*edge[1:], len(bucket)], strict=False):
        part = order[lo:hi]
        body = _zstd()[0](strings[part].tobytes()) if strings is not None else b""
        yield int(bucket[lo]), kind, squeezed(h[part]), squeezed(doc[part]), squeezed(row[part]), squeezed(start[part]), squeezed(size[part]), body


def _dealt_run(run: _Run, buckets: int, hot, named):
    """Rows of _PASSAGES of what a task has gathered: kind 0 are surroundings by anchor, 1 cuts, 2 strings of hot anchors by hash."""
    import numpy as np

    (strings, h, doc, row, start, size), cuts = run.settled()
    is_hot = np.isin(named(h), hot) if len(hot) else np.zeros(len(h), bool)
    cold = ~is_hot
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = [*_dealt_rows(0, _bucket(h[cold], buckets), strings[cold], low[cold], doc[cold], row[cold], start[cold], size[cold])]
    if is_hot.any():
        family, cut = SuffixFamily(run.length), []
        d, r, s = doc[is_hot], row[is_hot], start[is_hot]
        parts, which, inner = windows(strings[is_hot], size[is_hot], run.length)
        lost = family.add(parts, d[which], np.arange(len(which)))
        parts, _, kept = family.all()
        where, nothing = s[which] + inner, np.zeros(len(kept), np.int64)
        out += _dealt_rows(2, (digests(parts) % np.uint64(buckets)).astype(np.int64), parts, nothing, d[which[kept]], r[which[kept]], where[kept], nothing + run.length)
        cut = (d[which[lost]], r[which[lost]], where[lost], where[lost] + run.length)
        cuts = tuple(np.concatenate(x) for x in zip(cuts, cut, strict=True))
    (d, r), lo, hi = runs(list(cuts[:2]), *cuts[2:])
    # any bucket passes cuts on: these stay together in one row
    return out + [*_dealt_rows(1, np.full(len(d), d[0] % buckets if len(d) else 0), None, np.zeros(len(d), np.int64), d, r, lo, hi - lo)]


def _settled(rows, length: int, old=()):
    """Cuts (document, row, start, stop) of the rows of one bucket, and the surroundings that stay: (strings, low half of the hash, size).

    old are levels (strings, low halves, sizes) of documents that come before all others.
    """
    import numpy as np

    width, before = 2 * length - ANCHOR + 2, -(2**63)
    cuts, places, n = [[], [], [], []], [], 0
    bodies, plain = SuffixFamily(width), SuffixFamily(length)

    def cut(doc, row, start, stop) -> None:
        for column, values in zip(cuts, (doc, row, start, stop), strict=True):
            column.append(values)

    for strings, low, size in old:
        bodies.levels.append((strings, np.full(len(strings), before), n + np.arange(len(strings))))
        places.append((low, np.full(len(strings), before), *[np.zeros(len(strings), np.int64)] * 2, size))
        n += len(strings)
    held = {0: [], 2: []}

    def flush(kind: int) -> None:
        nonlocal n
        if not held[kind]:
            return
        strings, *place = (np.concatenate(x) for x in zip(*held[kind], strict=True))
        held[kind] = []
        places.append(tuple(place))
        waiting[kind].append(((bodies, plain)[kind == 2].add(strings, place[1], n + np.arange(len(strings))), kind))
        n += len(strings)

    waiting = {0: [], 2: []}
    for kind, h, doc, row, start, size, body in rows:
        place = [restored(x) for x in (h, doc, row, start, size)]
        if kind == 1:
            cut(place[1], place[2], place[3], place[3] + place[4])
            continue
        wide = width if kind == 0 else length
        strings = np.frombuffer(_zstd()[1](body), np.uint8).view(f"S{wide}")
        held[kind].append((strings, *place))
        if sum(len(x[0]) for x in held[kind]) >= BATCH:
            flush(kind)
    flush(0)
    flush(2)
    low, doc, row, start, size = (np.concatenate(x) for x in zip(*places, strict=True)) if places else [np.empty(0, np.int64)] * 5
    for lost, _ in waiting[0] + waiting[2]:
        cut(doc[lost], row[lost], start[lost], start[lost] + size[lost])
    strings, _, tags = bodies.all()
    # anchors around which surroundings differ
    if len(strings):
        number = np.cumsum(np.r_[0, strings[1:] != strings[:-1]])
        order = np.argsort(low[tags], kind="stable")
        new = np.flatnonzero(np.r_[True, low[tags[order]][1:] != low[tags[order]][:-1]])
        differ = np.minimum.reduceat(number[order], new) != np.maximum.reduceat(number[order], new)
        fresh = np.maximum.reduceat(doc[tags[order]], new) > before
        count = np.diff(np.r_[new, len(order)])
        open_, count = order[np.repeat(differ & fresh, count)], count[differ & fresh]
        # strings of two anchors never match: each run of whole anchors has a family of its own
        for group in np.split(open_, np.cumsum(count)[np.flatnonzero(np.diff(np.cumsum(count) // OPEN))]):
            group = group[np.argsort(doc[tags[group]], kind="stable")]
            family, origin, inside, m = SuffixFamily(length), [], [], 0
            for lo in range(0, len(group), BATCH):
                part = group[lo : lo + BATCH]
                found, which, inner = windows(strings[part], size[tags[part]], length)
                origin.append(tags[part][which])
                inside.append(inner)
                lost = family.add(found, doc[tags[part]][which], m + np.arange(len(which)))
                m += len(which)
                if len(lost):
                    t, i = np.concatenate(origin)[lost], np.concatenate(inside)[lost]
                    cut(doc[t], row[t], start[t] + i, start[t] + i + length)
    spans = [np.concatenate([np.empty(0, np.int64), *x]) for x in cuts]
    new = doc[tags] > before
    return spans, (strings[new], low[tags][new], size[tags][new])


def _known(docs_of, low_of):
    """Sorted (document, low half) pairs of one text group."""
    import numpy as np

    owner, low = (np.concatenate([np.empty(0, np.int64), *map(restored, x)]) for x in (docs_of, low_of))
    order = np.argsort(owner, kind="stable")
    return owner[order], low[order]


def _passage_groups(docs: DataFrame, found: DataFrame, length: int, buckets: int, dests: int, hot) -> DataFrame:
    """(dest, docs, rows, start, stop): spans of bytes to drop, packed by text group; hot names anchors that are dealt by string."""
    import numpy as np

    anchor_buckets, hot = hot

    def named(h):
        return _bucket(h, anchor_buckets) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def deal(batches):
        at, pairs, table, run = None, [], None, _Run(length)
        grow = _zstd()[1]
        for batch in batches:
            ids, rows, texts, known = [], [], [], []
            for dest, doc, row, text, docs_, a in zip(*(batch.column(n).to_pylist() for n in ("dest", "doc", "row", "text", "docs", "a")), strict=True):
                if dest != at:
                    at, pairs, table = dest, [], None
                if text is None:
                    pairs.append((docs_, a))
                    continue
                if table is None:
                    table, pairs = _known(*(zip(*pairs, strict=True) if pairs else ((), ()))), []
                lo, hi = (np.searchsorted(table[0], doc, side) for side in ("left", "right"))
                if lo < hi:
                    for column, value in zip((ids, rows, texts, known), (doc, row, grow(text), np.unique(table[1][lo:hi])), strict=True):
                        column.append(value)
            out = []
            for data, spans in pieces(texts, length):
                owner, first, last, h = anchored(data, spans, length)
                text_of, offset, begin = (np.array([s[k] for s in spans]) for k in (0, 1, 2))
                mine = np.concatenate([i << 32 | known[i] for i in np.unique(text_of).tolist()])
                on = np.flatnonzero(np.isin(text_of[owner] << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64), mine))
                i = text_of[owner[on]]
                start = first[on] - begin[owner[on]] + offset[owner[on]]
                run.take(data, first[on], last[on], h[on], np.array(ids, np.int64)[i], np.array(rows, np.int64)[i], start)
                if run.n >= HELD:
                    out += _dealt_run(run, buckets, hot, named)
            if out:
                yield _pieces_of(list(zip(*out, strict=True)), _PASSAGES)
        if run.n:
            yield _pieces_of(list(zip(*_dealt_run(run, buckets, hot, named), strict=True)), _PASSAGES)

    def settle(pdf):
        (doc, row, lo, hi), _ = _settled(zip(*(pdf[c] for c in ("kind", "h", "doc", "row", "start", "size", "body")), strict=True), length)
        (doc, row), lo, hi = runs([doc, row], lo, hi)
        return _by_group(dests, doc, docs=doc, rows=row, start=lo, stop=hi)

    return _dealt(docs, found, dests).mapInArrow(deal, _PASSAGES).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(settle, _CUTS)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, key, text, row): rows of one key are told apart by a hash of their text."""
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1)).alias("doc"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.groupBy("doc").count().where("count > 1").take(1)
    return rows.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))


def _cut(rows: DataFrame, cuts: DataFrame, dests: int, key: str, key_type) -> DataFrame:
    """The result for rows of which cuts names the spans that go."""
    import pyarrow as pa

    def cut(batches):
        at, spans = None, {}
        grow = _zstd()[1]
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            # of each text group the spans come first, then the documents
            for dest, keyed, doc, row, text, docs_, rows_, start, stop in zip(*(batch.column(n).to_pylist() for n in ("dest", "keyed", "doc", "row", "text", "docs", "rows", "start", "stop")), strict=True):
                if dest != at:
                    at, spans = dest, {}
                if text is None:
                    for d, r, lo, hi in zip(*(restored(x).tolist() for x in (docs_, rows_, start, stop)), strict=True):
                        spans.setdefault((d, r), []).append((lo, hi))
                    continue
                t, kept, end = grow(text), [], 0
                gone = merge(spans.get((doc, row), []))
                for lo, hi in gone:
                    kept.append(t[end:lo])
                    end = hi
                body = b"".join([*kept, t[end:]])
                for column, value in zip(out, (doc, keyed, len(t), len(t) - len(body), len(gone), hashlib.sha256(body).hexdigest(), body), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc", "keyed", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = _dealt(rows, cuts, dests).mapInArrow(cut, "doc bigint, keyed boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("keyed"), F.col("doc").cast(key_type)).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    A byte goes if a string of length bytes that covers it also starts in a
    document with a smaller key, judged on the UTF-8 bytes of the input.  Null
    texts are empty; null keys are larger than all others and equal to each
    other; rows with equal keys are parts of one document and never match each
    other.  An empty table gives an empty result; other columns are not read.
    """
    import numpy as np

    if length < ANCHOR + 4:
        raise ValueError(f"length must be {ANCHOR + 4} at least")
    rows = _rows(docs, text, key)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    dests, buckets = total // TEXT_BYTES + 1, max(1, -(-total // GROUP_BYTES))
    table = stage(_anchor_groups(rows, length, buckets, dests, max(HOT_DOCS, total // HOT_SHARE)), "op7-anchors")
    hot = [restored(r.docs) << 32 | restored(r.a) for r in table.where("dest < 0").collect()]  # HOT_SHARE numbers at most
    hot = np.sort(np.concatenate([np.empty(0, np.int64), *hot]))
    found = table.where("dest >= 0")
    anchors = found.agg(F.sum(F.octet_length("a"))).first()[0] or 0
    cuts = stage(_passage_groups(rows, found, length, max(1, -(-anchors // 3 // GROUP_ANCHORS)), dests, (buckets, hot)), "op7-cuts")
    drop(table)
    return _cut(rows, cuts, dests, key, docs.schema[key].dataType)


_LEVEL = "bucket int, h binary, size binary, body binary"


@dataclass
class SuffixIndex:
    """Levels of suffix arrays over the documents inserted so far, as written tables (bucket, low halves of anchor hashes, sizes, surroundings)."""

    spark: SparkSession
    levels: list[tuple[DataFrame, int]]  # table and strings, largest first
    length: int = 50
    buckets: int = 64

    @classmethod
    def empty(cls, spark: SparkSession, length: int = 50, buckets: int = 64) -> SuffixIndex:
        """buckets is fixed for the index; a task holds one bucket of all levels, so let it grow with the corpus aimed at."""
        if length < ANCHOR + 4:
            raise ValueError(f"length must be {ANCHOR + 4} at least")
        return cls(spark, [], length, buckets)

    def insert(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[SuffixIndex, DataFrame]:
        """The index with the documents added, and the result of drop_repeats for them.

        Documents inserted earlier come before all of these, whatever their keys;
        among these the smaller key does.  Cases are those of drop_repeats.
        """
        import numpy as np
        import pandas as pd

        length, buckets = self.length, self.buckets
        rows = _rows(docs, text, key)
        dests = (docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // TEXT_BYTES + 1

        def deal(batches):
            run, nobody = _Run(length), np.empty(0, np.int64)
            for batch in batches:
                out = []
                ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
                for data, spans in pieces(_bytes(batch.column(2)), length):
                    owner, first, last, h = anchored(data, spans, length)
                    text_of, offset, begin = (np.array([s[k] for s in spans]) for k in (0, 1, 2))
                    run.take(data, first, last, h, ids[text_of[owner]], hashes[text_of[owner]], first - begin[owner] + offset[owner])
                    if run.n >= HELD:
                        out += _dealt_run(run, buckets, nobody, None)
                if out:
                    yield _pieces_of(list(zip(*out, strict=True)), _PASSAGES)
            if run.n:
                yield _pieces_of(list(zip(*_dealt_run(run, buckets, nobody, None), strict=True)), _PASSAGES)

        def settle(new, old):
            levels = []
            for h, size, body in zip(old["h"], old["size"], old["body"], strict=True):
                strings = np.frombuffer(_zstd()[1](body), np.uint8).view(f"S{2 * length - ANCHOR + 2}")
                levels.append((strings, restored(h), restored(size)))
            (doc, row, lo, hi), (strings, low, size) = _settled(zip(*(new[c] for c in ("kind", "h", "doc", "row", "start", "size", "body")), strict=True), length, levels)
            (doc, row), lo, hi = runs([doc, row], lo, hi)
            out = _by_group(dests, doc, docs=doc, rows=row, start=lo, stop=hi)
            if len(strings):
                level = pd.DataFrame({"bucket": [int(new["bucket"].iloc[0])], "h": [squeezed(low)], "size": [squeezed(size)], "body": [_zstd()[0](strings.tobytes())]})
                out = pd.concat([out, level])
            out["dest"], out["bucket"] = (out[c].astype("Int64") if c in out else pd.array([pd.NA] * len(out), "Int64") for c in ("dest", "bucket"))
            return out.reindex(columns=["dest", "docs", "rows", "start", "stop", "bucket", "h", "size", "body"]).astype({c: object for c in ("docs", "rows", "start", "stop", "h", "size", "body")}).where(lambda x: x.notna(), None)

        old = self.spark.createDataFrame([], _LEVEL)
        for level, _ in self.levels:
            old = old.unionByName(level)
        dealt = rows.select("doc", "row", "text").mapInArrow(deal, _PASSAGES)
        found = stage(dealt.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(settle, f"{_CUTS}, bucket bigint, h binary, size binary, body binary"), "op7-insert")
        new = found.where("bucket is not null").select(F.col("bucket").cast("int").alias("bucket"), "h", "size", "body")
        index = SuffixIndex(self.spark, [*self.levels, (new, self._strings(new))], length, buckets)
        while len(index.levels) > 1 and index.levels[-1][1].bit_length() >= index.levels[-2][1].bit_length():
            index._merge()
        return index, _cut(rows, found.where("dest is not null").select("dest", "docs", "rows", "start", "stop"), dests, key, docs.schema[key].dataType)

    @staticmethod
    def _strings(level: DataFrame) -> int:
        counted = level.select(F.conv(F.hex(F.reverse(F.substring("h", 9, 8))), 16, 10).cast("bigint").alias("n"))
        return counted.agg(F.sum("n")).first()[0] or 0

    def _merge(self) -> None:
        """The last two levels become one."""
        import numpy as np

        wide = 2 * self.length - ANCHOR + 2

        def run(pdf):
            import pandas as pd

            strings, low, size = (np.concatenate(x) for x in zip(*((np.frombuffer(_zstd()[1](b), np.uint8).view(f"S{wide}"), restored(h), restored(s)) for h, s, b in zip(pdf["h"], pdf["size"], pdf["body"], strict=True)), strict=True))
            order = np.argsort(strings, kind="stable")  # rising runs
            return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "h": [squeezed(low[order])], "size": [squeezed(size[order])], "body": [_zstd()[0](strings[order].tobytes())]})

        (a, m), (b, n) = self.levels[-2:]
        self.levels[-2:] = [(stage(a.unionByName(b).groupBy("bucket").applyInPandas(run, _LEVEL), "op7-level"), m + n)]
