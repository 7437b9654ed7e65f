"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked id pairs.

Byte offsets at which tokens of A and of B both end cut a text into groups; every A token of a group is linked with every B token of it.
The count of an id pair is the number of documents that hold it linked.

* **Texts** are cut at single spaces between other characters: both tokenizers start a token there, whatever surrounds it, so
  a text's tokens, groups and links are those of its chunks in a row.  A task remembers the chunks it meets most (``REMEMBERED`` of them).
* **First pass:** tasks count, for each pair, the documents that hold it, and write sums by pair.
* **Perfect hash:** distinct pairs are dealt into shards by their A id, about ``SHARD_KEYS`` pairs each.  A shard gets a minimal perfect hash:
  bit arrays in levels, a key takes the first place that it has for itself, its number is the rank of that bit.  Keys are kept
  in the order of their numbers, and every look-up compares them.
* **Counts:** sums of the first pass become dense vectors indexed by the hash, a bounded number of sums a vector; vectors are
  added up in a tree of ``FAN`` a node.  The highest count of an A id is found in its shard.
* **Second pass:** documents are aligned again; their distinct pairs travel in packed rows to the shards, and what comes back is two
  numbers a document.  The rows of a shard are dealt to as many tasks as they fill; the shard's vector goes to each of them.

Nothing of a size that grows with the corpus passes the driver; it sees three totals.

Null or empty texts, and texts whose tokens of A or B don't join to a space and the text (U+2581 is one such case), have no tokens: all numbers
are 0 and the digest is ''.  Rows that share a doc_id are separate documents.  A null doc_id is passed through.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

REMEMBERED = 300_000
STEP_CHARS = 1 << 20
SHARD_KEYS = 1 << 18
SUMS_IN_TASK = 1 << 20
PAIRS_IN_TASK = 1 << 21
FAN = 8
#: longer chunks, and groups with more links, are handled one by one
LONG_CHUNK, LARGE_GROUP = 2000, 4096
#: pairs a task gathers before it writes their sums
GATHERED = 1 << 21
CUT = re.compile(r"(?<=\S) (?=\S)")
#: numbers below 2 ** 31 - B_BITS times 2 ** B_BITS: room for any of the vocabularies
B_BITS = 15
PAIR_BITS = 32


def byte_letters() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 characters stand for themselves, others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """A: a byte-level BPE in JSON; B: a sentencepiece model.  Both with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.json = Tokenizer.from_file(a_path)
        self.json.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        known = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.a_bytes = [b""] * (1 + max(model["model"]["vocab"].values()))
        for t, i in known.items():
            self.a_bytes[i] = t
        # merges in the order of ids: the pair merged first is the one with the smaller id, so ids serve as ranks
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        self.ranked = None
        if made == sorted(made):
            self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.pieces.get_piece_size()
        self.b_bytes = [
            b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i)
            else bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i)
            else self.pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(size)
        ]
        if len(self.a_bytes) > 1 << (PAIR_BITS - B_BITS) or size > 1 << B_BITS:
            raise ValueError("a vocabulary is too large for the pair key")
        self.a_len, self.b_len = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.written = np.array([str(i) + s for i in range(max(len(self.a_bytes), size)) for s in ",|;\n"], object)

    def a_ids(self, text: str) -> list[int]:
        if self.ranked is None or len(text) > LONG_CHUNK:
            return self.json.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


class _Names(dict):
    """Numbers of chunks; a new chunk is queued."""

    def __init__(self, owner, plain: bool):
        super().__init__()
        self.owner, self.plain = owner, plain

    def __missing__(self, chunk: str) -> int:
        if self.plain and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            return -1
        k = self.owner.known + len(self.owner.queue)
        self.owner.queue.append(chunk)
        self[chunk] = k
        return k


class Aligned:
    """Chunks met so far: tokens, groups and links of each, as flat arrays."""

    def __init__(self, tokenizers: Tokenizers, remembered: int = REMEMBERED):
        self.t, self.remembered = tokenizers, remembered
        self.clear()

    def clear(self):
        self.known, self.queue = 0, []
        self.plain, self.other = _Names(self, True), _Names(self, False)
        self.sums = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, good
        self.starts, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text = []
        self.uses = np.zeros(0, np.int64)

    def chunks(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        got = np.fromiter(map(self.plain.__getitem__, parts), np.int64, len(parts))
        if got.min() < 0:
            parts = CUT.split(text)
            got = np.fromiter(map(self.other.__getitem__, parts), np.int64, len(parts))
        return got

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Chunk numbers of each text; all of them are then known."""
        if self.known > self.remembered:
            self.forget()
        got = [self.chunks(t) for t in texts]
        if self.queue:
            self.learn()
        return got

    def forget(self):
        """Only the most used chunks stay."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.remembered // 4])
        new = {int(k): i for i, k in enumerate(keep)}
        for names in (self.plain, self.other):
            held = [(c, new[k]) for c, k in names.items() if k in new]
            names.clear()
            names.update(held)
        counts = np.diff(self.starts)[keep]
        at = np.repeat(self.starts[:-1][keep] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.pair, self.times, self.starts = self.pair[at], self.times[at], np.concatenate([[0], np.cumsum(counts)])
        self.sums, self.uses = self.sums[:, keep], self.uses[keep] // 2
        self.text = [self.text[k] for k in keep]
        self.known = len(keep)

    def tokens(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and B of all chunks with their end offsets, the chunks' own ends, and which chunks join to their bytes."""
        t, raw = self.t, [b" " + c.encode() for c in chunks]
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes)
        easy = np.array([bool(c) and len(c) <= LONG_CHUNK and not c[0].isspace() for c in chunks])
        a_lists: list = [None] * len(chunks)
        at = np.flatnonzero(easy)
        if len(at) and t.ranked is not None:
            flat = np.array(t.ranked.encode_ordinary(" " + " ".join(chunks[k] for k in at)), np.int64)
            stops = np.cumsum(t.a_len[flat])
            cut = np.searchsorted(stops, np.cumsum(sizes[at]))
            if (stops[np.minimum(cut, len(stops) - 1)] == np.cumsum(sizes[at])).all():
                for k, x in zip(at, np.split(flat, cut[:-1] + 1)):
                    a_lists[k] = x
        for k in range(len(chunks)):
            if a_lists[k] is None:
                a_lists[k] = np.array(t.a_ids(" " + chunks[k]), np.int64)
        b_lists = t.pieces.encode(chunks, num_threads=1)
        n_a, n_b = (np.array([len(x) for x in lists]) for lists in (a_lists, b_lists))
        a = np.concatenate(a_lists) if len(chunks) else np.zeros(0, np.int64)
        b = np.array([i for x in b_lists for i in x], np.int64)
        whole, good = b"".join(raw), np.ones(len(chunks), bool)
        for ids, lists, table, sides in ((a, a_lists, t.a_bytes, n_a), (b, b_lists, t.b_bytes, n_b)):
            length = np.bincount(np.repeat(np.arange(len(chunks)), sides), weights=(t.a_len if table is t.a_bytes else t.b_len)[ids], minlength=len(chunks))
            good &= length == sizes
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                good &= np.array([b"".join(table[i] for i in x) == w for x, w in zip(lists, raw)])
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        start = ends - sizes
        out = []
        for ids, n, lens in ((a, n_a, t.a_len), (b, n_b, t.b_len)):
            run = np.cumsum(lens[ids])
            before = np.concatenate([[0], run])[np.cumsum(n) - n]
            out.append(run + np.repeat(start - before, n))
        return a, out[0], n_a, b, out[1], n_b, ends, good

    def learn(self):
        chunks, self.queue = self.queue, []
        a, a_end, n_a, b, b_end, n_b, ends, good = self.tokens(chunks)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        ga, gb = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        in_a, in_b = np.bincount(ga, minlength=len(shared)), np.bincount(gb, minlength=len(shared))
        links = in_a * in_b
        home = np.searchsorted(ends, shared)
        n_groups = np.bincount(home, minlength=len(chunks))
        n_links = np.bincount(home, weights=links, minlength=len(chunks)).astype(np.int64)

        small = links[ga] <= LARGE_GROUP
        times_b = np.where(small, in_b[ga], 0)
        first_b = np.cumsum(in_b) - in_b
        total = int(times_b.sum())
        within = np.arange(total) - np.repeat(np.cumsum(times_b) - times_b, times_b)
        pair = (np.repeat(a, times_b) << B_BITS) | b[np.repeat(first_b[ga], times_b) + within]
        owner, times = np.repeat(home[ga], times_b), np.ones(total, np.int64)
        first_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(links > LARGE_GROUP):
            left = Counter(a[first_a[g] : first_a[g] + in_a[g]].tolist())
            right = Counter(b[first_b[g] : first_b[g] + in_b[g]].tolist())
            more = np.array([((x << B_BITS) | y, p * q) for x, p in left.items() for y, q in right.items()], np.int64)
            pair, times = np.concatenate([pair, more[:, 0]]), np.concatenate([times, more[:, 1]])
            owner = np.concatenate([owner, np.full(len(more), home[g])])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(chunks))

        # the groups in writing: every token with what follows it
        both, side = np.concatenate([a, b]), np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        place = np.argsort(np.concatenate([ga, gb]) * 2 + side, kind="stable")
        ids, g, side = both[place], np.concatenate([ga, gb])[place], side[place]
        after = np.full(len(ids), 3)
        if len(ids):
            same = g[1:] == g[:-1]
            after[:-1] = np.where(same & (side[1:] == side[:-1]), 0, np.where(same, 1, np.where(home[g[1:]] == home[g[:-1]], 2, 3)))
        lines = iter("".join(self.t.written[ids * 4 + after]).split("\n"))
        self.text += [next(lines) if n else "" for n in n_groups]

        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, n_groups, n_links, good.astype(np.int64)])], axis=1)
        self.pair, self.times = np.concatenate([self.pair, pair[order]]), np.concatenate([self.times, times[order]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])
        self.known += len(chunks)

    def align(self, texts: list[str], digests: bool) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that are not empty: sums (4, n), digests, and the distinct pairs (text, pair, times), ordered by text and pair."""
        lists = self.numbers(texts)
        sizes = np.array([len(x) for x in lists])
        every = np.concatenate(lists)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.uses += np.bincount(every, minlength=self.known)
        good = np.bincount(text, weights=1 - self.sums[4, every], minlength=len(texts)) == 0
        sums = np.stack([np.bincount(text, weights=self.sums[k, every], minlength=len(texts)) for k in range(4)]).astype(np.int64) * good
        shas = [hashlib.sha256(";".join(map(self.text.__getitem__, x.tolist())).encode()).hexdigest() if ok else "" for x, ok in zip(lists, good)] if digests else []
        on = good[text]
        key, n = np.unique((text[on] << 32) | every[on], return_counts=True)
        chunk, text = key & 0xFFFFFFFF, key >> 32
        counts = self.starts[chunk + 1] - self.starts[chunk]
        at = np.repeat(self.starts[chunk] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        key, times = (np.repeat(text, counts) << PAIR_BITS) | self.pair[at], self.times[at] * np.repeat(n, counts)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times[order], new) if len(key) else times
        key = key[new]
        return sums, shas, key >> PAIR_BITS, key & ((1 << PAIR_BITS) - 1), times


_WORKER: dict = {}


def aligned(a_path: str, b_path: str) -> Aligned:
    """The memory of this worker; later tasks go on with it."""
    key = (a_path, b_path)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Aligned(Tokenizers(a_path, b_path))
    return _WORKER[key]


def _steps(batches, chars: int = STEP_CHARS):
    """(doc_ids, texts) of a bounded number of characters."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            held += len(t) + 64
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def pair_sums(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(task, pair, n): documents of a task that hold a pair linked; a pair may be there several times."""

    def run(batches):
        work, task = aligned(a_path, b_path), TaskContext.get().partitionId()
        keys, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge():
            nonlocal keys, counts, fresh
            if fresh:
                every = np.concatenate([keys, *[x[0] for x in fresh]])
                n = np.concatenate([counts, *[x[1] for x in fresh]])
                order = np.argsort(every)
                every = every[order]
                new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                keys, counts, fresh = every[new], np.add.reduceat(n[order], new), []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), task, np.int32)), pa.array(keys), pa.array(counts)], ["task", "pair", "n"])

        for _, texts in _steps(batches):
            some = [t for t in texts if t]
            if not some:
                continue
            got = np.unique(work.align(some, False)[3], return_counts=True)
            if len(got[0]):
                fresh.append(got)
            if sum(len(x[0]) for x in fresh) > GATHERED // 2:
                merge()
                if len(keys) > GATHERED:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        merge()
        if len(keys):
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "task int, pair long, n long")


# minimal perfect hash

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Pseudo-random places below ``size`` (the finaliser of splitmix64 on a key and a level)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + _ODD[0] * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * _ODD[1]
        z = (z ^ (z >> np.uint64(27))) * _ODD[2]
        return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 .. n-1 for n distinct keys, from the levels' sizes and bits; keys outside the set get some number or -1."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.levels, at, rank = [], 0, 0
        for size in sizes:
            on = np.unpackbits(np.frombuffer(bits, np.uint8, -(-size // 8), at), count=size).astype(bool)
            self.levels.append((size, on, rank + np.cumsum(on) - 1))
            rank += int(on.sum())
            at += -(-size // 8)
        self.size = rank

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = 2 * len(rest) + 8
            at = _places(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            rest = rest[~alone[at]]
        made = cls(sizes, b"".join(bits))
        made.sizes, made.bits = sizes, b"".join(bits)
        return made

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (size, on, rank) in enumerate(self.levels):
            at = _places(keys[left], k, size)
            hit = on[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def _as_ints(column, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_py(), np.int64)


class _Shard:
    """A shard in a task: hash, verified keys and, once summed, counts."""

    def __init__(self, index: pa.Table):
        self.hash = PerfectHash(index.column("sizes")[0].as_py(), index.column("bits")[0].as_py())
        self.keys = _as_ints(index.column("keys"), 0)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        at = self.hash(pairs)
        if len(pairs) and (at.min() < 0 or (self.keys[at] != pairs).any()):
            raise ValueError("a pair is not among the keys of its shard")
        return at


def shard_of(pair: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(pair, B_BITS) * 2654435761, F.lit(shards)).cast("int")


def hashed(pairs: DataFrame) -> DataFrame:
    """(shard, sizes, bits, keys): the perfect hash of each shard of distinct pairs (shard, pair)."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy()
        made = PerfectHash.build(keys)
        ordered = np.zeros(len(keys), np.int64)
        ordered[made(keys)] = keys
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([made.sizes], pa.list_(pa.int64())), "bits": pa.array([made.bits], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})

    return pairs.groupBy("shard").applyInArrow(run, "shard int, sizes array<long>, bits binary, keys binary")


def counted(sums: DataFrame, index: DataFrame, lanes: int) -> DataFrame:
    """(shard, counts): dense vectors of counts, summed in a tree.  ``sums``: shard, task, pair, n."""

    def dense(rows: pa.Table, held: pa.Table) -> pa.Table:
        shard = _Shard(held)
        out = np.zeros(len(shard.keys), np.int64)
        if rows.num_rows:
            np.add.at(out, shard.numbers(rows.column("pair").to_numpy()), rows.column("n").to_numpy())
        return pa.table({"shard": held.column("shard").slice(0, 1), "lane": held.column("lane").slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        out = _as_ints(rows.column("counts"), 0).copy()
        for k in range(1, rows.num_rows):
            out += _as_ints(rows.column("counts"), k)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "lane": rows.column("lane").slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    schema = "shard int, lane int, counts binary"
    spread = sums.withColumn("lane", F.pmod(F.col("task"), F.lit(lanes)).cast("int"))
    copies = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    vectors = spread.groupBy("shard", "lane").cogroup(copies.groupBy("shard", "lane")).applyInArrow(dense, schema)
    while lanes > 1:
        lanes = -(-lanes // FAN)
        vectors = vectors.withColumn("lane", F.expr(f"cast(lane div {FAN} as int)")).groupBy("shard", "lane").applyInArrow(add, schema)
    return vectors.select("shard", "counts")


def packed(docs: DataFrame, shards: int, a_path: str, b_path: str) -> DataFrame:
    """Documents aligned again: rows with an ``id`` for each document, and rows of pairs for the shards.

    Pairs of a step of documents are one row a shard: document rows, pairs and times as packed integers.
    """
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "shard", "step", "n_pairs", "owners", "pairs", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, shard int, step long, n_pairs long, owners binary, pairs binary, times binary"

    def run(batches):
        work, base, step = aligned(a_path, b_path), TaskContext.get().partitionId() << 33, 0
        for ids, texts in _steps(batches):
            rows = base + np.arange(len(ids))
            base, step = base + len(ids), step + 1
            at = np.array([k for k, t in enumerate(texts) if t], np.int64)
            sums, shas = np.zeros((4, len(ids)), np.int64), [""] * len(ids)
            parts = []
            if len(at):
                some, digests, text, pair, times = work.align([texts[k] for k in at], True)
                sums[:, at] = some
                for k, s in zip(at, digests):
                    shas[k] = s
                owner = rows[at[text]]
                shard = ((pair >> B_BITS) * 2654435761) % shards
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in range(shards):
                    on = order[cuts[s] : cuts[s + 1]]
                    if len(on):
                        new = np.flatnonzero(np.concatenate([[True], owner[on][1:] != owner[on][:-1]]))
                        held = np.stack([owner[on][new], np.diff(np.concatenate([new, [len(on)]]))])
                        parts.append((s, (rows[0] << 8) + step, len(on), held.tobytes(), pair[on].astype(np.uint32).tobytes(), times[on].astype(np.uint32).tobytes()))
            n, m = len(ids), len(parts)
            first = [rows, ids, *sums, shas]
            second = list(zip(*parts)) if m else [[]] * 6
            columns = [pa.array([*c, *[None] * m], t) for c, t in zip(first, types[:7])] + [pa.array([*[None] * n, *c], t) for c, t in zip(second, types[7:])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def looked_up(parts: DataFrame, index: DataFrame, salts: int) -> DataFrame:
    """(row, n_best, count_sum) of each document and shard task.  ``index``: shard, sizes, bits, keys, counts."""

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows:
            shard, counts = _Shard(held), _as_ints(held.column("counts"), 0)
            a = shard.keys >> B_BITS
            top = np.zeros(int(a.max()) + 1, np.int64)
            np.maximum.at(top, a, counts)
            best = counts == top[a]
            for k in range(rows.num_rows):
                owner, n = np.frombuffer(rows.column("owners")[k].as_py(), np.int64).reshape(2, -1)
                at = shard.numbers(np.frombuffer(rows.column("pairs")[k].as_py(), np.uint32).astype(np.int64))
                times = np.frombuffer(rows.column("times")[k].as_py(), np.uint32).astype(np.int64)
                first = np.cumsum(n) - n
                out[0].append(owner)
                out[1].append(np.add.reduceat(times * best[at], first))
                out[2].append(np.add.reduceat(times * counts[at], first))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(["row", "n_best", "count_sum"], map(pa.array, flat))))

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("step"), F.lit(salts)).cast("int"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(run, "row long, n_best long, count_sum long")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, shard_keys: int = SHARD_KEYS, sums_in_task: int = SUMS_IN_TASK, pairs_in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    own = vocabularies()
    a_path, b_path = a_path or own[0], b_path or own[1]
    sums = staged(pair_sums(docs, a_path, b_path))
    pairs = staged(sums.select("pair").distinct())
    shards = max(1, -(-pairs.count() // shard_keys))
    index = staged(hashed(pairs.withColumn("shard", shard_of(F.col("pair"), shards))))
    lanes = max(1, -(-sums.count() // (shards * sums_in_task)))
    counts = counted(sums.withColumn("shard", shard_of(F.col("pair"), shards)), index, lanes)
    index = staged(index.join(counts, "shard"))
    rows = staged(packed(docs, shards, a_path, b_path))
    parts = rows.filter(F.col("row").isNull()).select("shard", "step", "n_pairs", "owners", "pairs", "times")
    total = parts.agg(F.sum("n_pairs")).first()[0] or 0
    found = looked_up(parts, index, max(1, -(-total // (shards * pairs_in_task))))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    base = rows.filter(F.col("row").isNotNull()).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return base.join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
