"""SimHash near-duplicates through a Gray-order hierarchical index.

* Fingerprints: word shingles of the whole lower-cased text (ASCII letters), XXH64 with seed 42, bit set where over half of the
  shingles have it.  Equal fingerprints are one node, however many documents share it.
* Two fingerprints with at most ``max_bits`` differing bits agree on at least one of ``max_bits + 1`` bands of bits (pigeonhole),
  so only members of one (band, value) group are compared.  A group over ``hot`` fingerprints is split again by bands of the bits
  that are still free, until the groups are small or so few bits are free that their number of fingerprints is bounded.
* Within a group: fingerprints in Gray order, where neighbours share most bits.  Runs of ``FAN`` neighbours get an upper node with
  the mask and pattern of the bits that all of them share, runs of upper nodes again, up to the group's root.  A node keeps only the
  bits that its parent doesn't have.  A fingerprint descends from the root, adding the differing bits of each level; a node over
  ``max_bits`` is pruned with all that hangs below it.
* The search of a group leaves a spanning forest of its links instead of all pairs, so a large group of near copies makes a row
  per member.  Components of the links follow on fingerprints, then spread to documents.

A text without words (also null or empty) has fingerprint 0 and is linked like any other.  Repeated rows are documents of their
own with equal fingerprints; null doc_ids are carried along and never become a component id unless all of a component are null.
An empty table gives an empty result.  Other columns are ignored by the query and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadfield.llm.common import row_key, staged
from quadfield.llm.components import components

SEED, WORDS, MAX_BITS = 42, 3, 3
FAN, HOT, LEAST_FREE = 8, 1024, 20
_SLICE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# fingerprints


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text in UTF-8."""
    tokens = (text or b"").translate(_LOWER).split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) < words else list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), _SLICE):
        h = np.fromiter((digest(s, SEED) for s in shingles[i : i + _SLICE]), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit integer."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in b.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return docs.select(F.col("text").cast("binary").alias("__text"), *keep).mapInArrow(run, kinds)


# groups


def bands(free: int, count: int) -> list[int]:
    """Masks that split the set bits of ``free`` into ``count`` runs of nearly equal size."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(fixed, value, fp): fingerprints that agree on the bits of the mask ``fixed``; every close pair is in some group."""
    pending, done, masks = fps.select(F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("value"), "fp"), None, [0]
    while True:
        tagged, deeper = None, []
        for fixed in masks:
            for band in bands(~fixed & (1 << 64) - 1, max_bits + 1):
                now = fixed | band
                deeper.append(now)
                part = pending.filter(F.col("fixed") == _signed(fixed)).select(F.lit(_signed(now)).alias("fixed"), F.col("fp").bitwiseAND(F.lit(_signed(now))).alias("value"), "fp")
                tagged = part if tagged is None else tagged.unionByName(part)
        sizes = tagged.groupBy("fixed", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if 64 - min(m.bit_count() for m in deeper) <= LEAST_FREE:
            settled, pending = tagged, None
        else:
            over = staged(sizes.filter(F.col("n") > hot).select("fixed", "value"))
            if over.isEmpty():
                settled, pending = tagged, None
            else:
                settled = tagged.join(over, ["fixed", "value"], "left_anti")
                pending = staged(tagged.join(over, ["fixed", "value"], "left_semi"))
                masks = [m & (1 << 64) - 1 for (m,) in over.select("fixed").distinct().collect()]  # as many as there are bands
        done = settled if done is None else done.unionByName(settled)
        if pending is None:
            return done


# the index of a batch of groups


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class Index:
    """Upper nodes over fingerprints sorted by (group, Gray rank); level 0 are the fingerprints themselves."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.group, self.fps = group, fps
        full = np.full(len(fps), 2**64 - 1, np.uint64)
        levels = [(full, fps, group, np.arange(len(fps)))]  # mask, pattern, group, first child
        while True:
            mask, pattern, own, _ = levels[-1]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            within = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
            if not within.any():
                break
            head = np.flatnonzero(within % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, head), np.bitwise_and.reduceat(~pattern & mask, head)
            levels.append((ones | zeros, ones, own[head], head))
        self.levels = levels[::-1]

    def links(self, max_bits: int):
        """Yields (i, j) arrays, i < j, of fingerprints of one group within ``max_bits``; every such pair once."""
        root_mask, root_pattern, root_group, _ = self.levels[0]
        root = np.searchsorted(root_group, self.group)
        size = np.bincount(root, minlength=len(root_group))
        query = np.flatnonzero(size[root] > 1)
        cost = np.cumsum(np.minimum(size[root[query]], 4096))
        cuts = np.searchsorted(cost, np.arange(0, cost[-1] if len(cost) else 0, _SLICE * 8))
        for lo, hi in zip(cuts, [*cuts[1:], len(query)]):
            q = query[lo:hi]
            node = root[q]
            seen = np.zeros(len(q), np.int64)
            above = np.zeros(len(q), np.uint64)
            for depth, (mask, pattern, _, _) in enumerate(self.levels):
                seen = seen + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node] & ~above)
                keep = seen <= max_bits
                q, node, seen = q[keep], node[keep], seen[keep]
                if depth + 1 == len(self.levels):
                    break
                heads = self.levels[depth][3]
                ends = np.r_[heads[1:], len(self.levels[depth + 1][0])]
                count = ends[node] - heads[node]
                above = np.repeat(mask[node], count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q, seen, node = np.repeat(q, count), np.repeat(seen, count), np.repeat(heads[node], count) + step
                last = self._last(depth + 1)[node]
                keep = last > q  # pairs in one order only
                q, seen, node, above = q[keep], seen[keep], node[keep], above[keep]
            keep = node > q
            yield q[keep], node[keep]

    def _last(self, depth: int) -> np.ndarray:
        """The last fingerprint below each node of a level."""
        ends = np.arange(1, len(self.levels[depth][0]) + 1)
        for d in range(depth, len(self.levels) - 1):
            ends = np.r_[self.levels[d][3], len(self.levels[d + 1][0])][ends]
        return ends - 1


def _forest(n: int, links) -> np.ndarray:
    """Smallest member of each one's component under the links."""
    label = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _search(max_bits: int):
    def links(group, fps):
        order = np.lexsort((gray_rank(fps), group))
        group, fps = group[order], fps[order]
        root = _forest(len(fps), Index(group, fps).links(max_bits))
        far = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[root[far]].view(np.int64)), pa.array(fps[far].view(np.int64))], names=["a", "b"])

    def run(batches):
        rest: list = []
        held = 0
        for b in batches:
            rest.append(b)
            held += b.num_rows
            if held < _SLICE:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            fixed, value, fp = (t.column(i).to_numpy() for i in range(3))
            new = np.r_[True, (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])]
            cut = np.flatnonzero(new)[-1]
            if cut:  # the last group may go on
                yield links(np.cumsum(new[:cut]), fp[:cut].view(np.uint64))
            rest, held = t.slice(cut).to_batches(), len(fp) - cut
        if held:
            t = pa.Table.from_batches(rest).combine_chunks()
            fixed, value, fp = (t.column(i).to_numpy() for i in range(3))
            new = np.r_[True, (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])]
            yield links(np.cumsum(new), fp.view(np.uint64))

    return run


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within ``max_bits`` of each other, a spanning forest per group."""
    grouped = groups(fps, max_bits, hot).repartition("fixed", "value").sortWithinPartitions("fixed", "value")
    return grouped.mapInArrow(_search(max_bits), "a long, b long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(fp, component_id) for the rows (doc_id, fp): the smallest doc_id that links reach."""
    least = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(close_links(least.select("fp"), max_bits, hot))
    joined = least.join(nodes, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(best, "root").select("fp", "component_id")


def mark(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(with_fingerprints(docs, ["doc_id"], words))
    return prints.join(classes(prints, max_bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; all columns are kept."""
    keyed = docs.withColumn("__key", row_key(docs))
    prints = staged(with_fingerprints(keyed, ["doc_id", "__key"], words))
    found = prints.join(classes(prints, max_bits), "fp")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__k")).distinct()
    stays = keyed.join(gone, keyed.doc_id.eqNullSafe(F.col("__doc")) & (keyed["__key"] == F.col("__k")), "left_anti")
    return stays.drop("__key")
