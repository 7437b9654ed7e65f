"""Substring deduplication by matching the windows of anchored blocks.

This takes the place of relative Lempel-Ziv factoring: no factors are formed.  A factor is parsed from left to right against the
whole corpus, which can't be shared out, and windows that straddle two factors would be missed; here every window is looked up.

A word is removed when a window of ``WINDOW`` consecutive words that covers it also starts earlier (smaller doc_id, or same document
and earlier start).  All documents are reference and input alike:

* Each document is cut into blocks at content-defined anchors: a window's anchor is the smallest hash among its ``GRAM``-word runs,
  the leftmost if equal.  Equal windows have the same anchor at the same place, so an index by anchor finds every copy.
* A block is the run of windows that share an anchor.  The index holds, by anchor hash, the place of the block and a code for each
  of its windows.  Windows are grouped one by one by anchor and code; the earliest place of a window is the reference, all others go.
* Equal blocks of one map task are settled there, so a passage in a third of all documents leaves a row per task and block.
  A first pass counts anchors in ``SLOTS`` hash slots; anchors of slots far above the mean are indexed window by window, so that a
  frequent phrase with many different contexts is spread by its contexts.
* Windows are compared by 112 bits: the 64-bit key of the anchor or window and a 48-bit code by another hash.

Words and hashes are made in pieces of ``PIECE`` words, whatever the length of a text.  Null and empty texts have no words.  Rows
that share a doc_id count as one document: an equal place isn't earlier, so identical repeated rows are treated alike (rows of one
doc_id with different texts are not supported: they would share their spans).  Texts with a null doc_id are neither reference nor
changed.  An empty table gives an empty result; any other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

WINDOW, GRAM = 20, 5
SLOTS, HOT = 1 << 16, 8
PIECE, FLUSH = 1 << 16, 1 << 19
_CODE = 6


class Words(dict):
    """Word -> 64-bit hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + WINDOW + 1
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    down[1:] = np.cumprod(np.full(n - 1, pow(base, -1, 1 << 64), np.uint64))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


class Rolling:
    """Hashes of all runs of k words by a polynomial in an odd base, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.up, self.down = _powers(base)

    def sums(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return _mixed((sums[k:] - sums[:n]) * self.down[:n])


class Blocks:
    """Anchors, keys and codes of texts."""

    def __init__(self):
        self.words, self.one, self.two = Words(), Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)

    def pieces(self, text: bytes | None):
        """Yields (first word, word hashes) of pieces that overlap by a window less one word."""
        words = (text or b"").split()
        for at in range(0, len(words) - WINDOW + 1, PIECE):
            part = words[at : at + PIECE + WINDOW - 1]
            yield at, np.fromiter(map(self.words.__getitem__, part), np.uint64, len(part))

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, key) of each block, and the running sums."""
        sums = self.one.sums(hashes)
        grams = self.one.runs(sums, GRAM)
        view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
        place = view.argmin(axis=1) + np.arange(len(view))
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return first, grams[place[first]], sums


def hot_slots(docs: DataFrame) -> np.ndarray:
    """Flags of the anchor slots that hold over ``HOT`` times the mean and more than ``SLOTS / HOT`` anchors."""
    def run(batches):
        seen, blocks = np.zeros(SLOTS, np.int64), Blocks()
        for b in batches:
            for text in b.column(0):
                for _, h in blocks.pieces(text.as_buffer().to_pybytes() if text.is_valid else None):
                    np.add.at(seen, blocks.anchors(h)[1] % SLOTS, 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["slot", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS, np.int64)
    n[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return np.flatnonzero(n > np.maximum(HOT * n.mean(), SLOTS // HOT)).astype(np.uint64)


def blocks_of(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, doc_id, pos, codes): the index entries; a null key marks windows that are settled as later copies already."""
    def settle(held):
        """Of equal entries of this task the earliest stays, the others are settled."""
        key, doc, pos = (np.concatenate(c) for c in list(zip(*held))[:3])
        code = list(chain.from_iterable(c for *_, c in held))
        codes = np.array(code, object)
        check = np.fromiter((xxhash.xxh64_intdigest(c) for c in code), np.uint64, len(code))
        order = np.lexsort((pos, doc, check, key))
        key, doc, pos, codes, check = key[order], doc[order], pos[order], codes[order], check[order]
        head = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc > doc[start]) | (pos > pos[start])
        twin = ~head & ~later  # a repeated row: no entry of its own
        keep = ~twin
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)[keep], mask=later[keep]), pa.array(doc[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(codes[keep].tolist(), pa.binary())],
            names=["key", "doc_id", "pos", "codes"],
        )

    flags = np.zeros(SLOTS, bool)
    flags[hot.astype(np.int64)] = True

    def run(batches):
        blocks, held, n = Blocks(), [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for at, h in blocks.pieces(text.as_buffer().to_pybytes() if text.is_valid else None):
                    first, key, sums = blocks.anchors(h)
                    code = blocks.two.runs(blocks.two.sums(h), WINDOW)
                    raw = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CODE].tobytes()
                    last = np.r_[first[1:], len(code)]
                    if (single := flags[key % SLOTS]).any():
                        full = blocks.one.runs(sums, WINDOW)
                        each = np.flatnonzero(np.repeat(single, last - first))
                        first, last, key = np.r_[first[~single], each], np.r_[last[~single], each + 1], np.r_[key[~single], full[each]]
                    held.append((key, np.full(len(key), doc, np.int64), first + at, [raw[_CODE * i : _CODE * j] for i, j in zip(first.tolist(), last.tolist())]))
                    n += len(key)
                if n >= FLUSH:
                    yield settle(held)
                    held, n = [], 0
        if held:
            yield settle(held)

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "key long, doc_id long, pos int, codes binary")


def _spans(doc: np.ndarray, pos: np.ndarray, n: np.ndarray):
    """Batch of (doc_id, start, windows), neighbouring runs of windows joined."""
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + n[:-1])][: len(doc)])
    end = np.maximum.reduceat(pos + n, head) if len(head) else pos
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(pos[head].astype(np.int32)), pa.array((end - pos[head]).astype(np.int32))], names=["doc_id", "start", "windows"])


def _later(batches):
    """Windows of the sorted index entries that also are elsewhere, and earlier."""
    def look(t: pa.Table):
        size = np.array([len(c) // _CODE for c in t.column("codes").to_pylist()], np.int64)
        doc, pos = t.column("doc_id").to_numpy(), t.column("pos").to_numpy().astype(np.int64)
        settled = t.column("key").is_null().to_numpy()
        key = t.column("key").fill_null(0).to_numpy()
        raw = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, _CODE)
        code = np.zeros((len(raw), 8), np.uint8)
        code[:, :_CODE] = raw
        code = code.view("<u8").ravel()
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = np.cumsum(new)
        several = np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)[group] > 1
        live = several & ~settled
        at = np.cumsum(size) - size
        row = np.repeat(np.flatnonzero(live), size[live])
        step = np.arange(len(row)) - np.repeat(np.cumsum(size[live]) - size[live], size[live])
        c, d, p, g = code[at[row] + step], doc[row], pos[row] + step, group[row]
        order = np.lexsort((p, d, c, g))
        c, d, p, g = c[order], d[order], p[order], g[order]
        head = np.r_[True, (c[1:] != c[:-1]) | (g[1:] != g[:-1])][: len(c)]
        start = np.flatnonzero(head)[np.cumsum(head) - 1] if len(c) else np.zeros(0, np.int64)
        again = (d > d[start]) | (p > p[start])
        return _spans(np.r_[doc[settled], d[again]], np.r_[pos[settled], p[again]], np.r_[size[settled], np.ones(again.sum(), np.int64)])

    rest, held = [], 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held < FLUSH // 4:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        key = t.column("key").fill_null(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if t.column("key").null_count < t.num_rows else t.num_rows
        cut = max(cut, t.column("key").null_count)
        if cut:  # the last key may go on
            yield look(t.slice(0, cut).combine_chunks())
        rest, held = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield look(pa.Table.from_batches(rest).combine_chunks())


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, windows): runs of consecutive windows, by first word, that are later copies."""
    entries = blocks_of(docs, hot_slots(docs))
    # settled entries have no key: they are dealt out by document
    dealt = entries.repartition(F.coalesce("key", F.xxhash64("doc_id", "pos")))
    return dealt.sortWithinPartitions(F.col("key").asc_nulls_first()).mapInArrow(_later, "doc_id long, start int, windows int")


def _kept(batches):
    for b in batches:
        rows: list[list] = [[], [], []]
        for text, starts, windows in zip(b.column(1), b.column(2), b.column(3)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            gone = np.zeros(len(words), bool)
            if starts.is_valid:
                for s, n in zip(starts.as_py(), windows.as_py()):
                    gone[s : s + n + WINDOW - 1] = True
            kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
            for col, v in zip(rows, (len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    spans = duplicate_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("s"))
    spans = staged(spans.select(F.col("doc_id").alias("__doc"), F.col("s.start").alias("starts"), F.col("s.windows").alias("windows")))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(spans, F.col("doc_id") == F.col("__doc"), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "t", "starts", "windows").mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
