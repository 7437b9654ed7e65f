"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become token ids (plus an end id); only documents longer than a sequence are cut.  Full pieces are sequences of their
own.  All other pieces are dealt into blocks of about ``BLOCK`` pieces by a hash; each block is packed in one task: best fit in
decreasing order, then local search on the bins that aren't full.  It starts from the least filled bin and, as long as the sum
of squared fills grows, moves a piece into another bin's gap, exchanges a piece for a smaller one of another bin, or for two of
them, so that the other bin fills up exactly; bins drain until they are empty.  A block's waste is below a bin or so, and blocks
hold thousands of bins, so packing blocks apart costs little; it is what lets any number of tasks work side by side.

Null and empty texts are the end id alone.  Repeated rows are packed as often as they occur.  Very long texts give many full
pieces and one rest.  An empty table gives an empty result.  Any other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

CAPACITY, END, BLOCK = 2048, 0, 1 << 15
VOCABULARY = "word_bpe_49k.json"
_WORDS = 1 << 18
_PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ ]|[!-&(-/:-@\[-`{-~])+")
_RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
#: White space to Python's ``split`` but not to the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _ranked(path: str):
    """(encoder that merges by rank, id of a lone blank) of a byte-level vocabulary with word ends; (None, -1) if it can't stand for it.

    The end of a word becomes a byte 0 behind it.  Single bytes come first, bytes at a word's end next and merges in their order, so ids
    serve as ranks.
    """
    import tiktoken

    from quadfield.llm.token_alignment import byte_letters

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocab, letters = model.get("end_of_word_suffix"), model["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ends = lambda t: bool(suffix) and t.endswith(suffix)
    stem = lambda t: t[: -len(suffix)] if ends(t) else t
    made = [vocab.get(a + b, -1) for a, b in merges]
    single = [i for t, i in vocab.items() if len(stem(t)) == 1]
    if not suffix or made != sorted(set(made)) or len(single) != 512 or max(single) >= min(made) or len(single) + len(made) != len(vocab):
        return None, -1
    ranks = {bytes(letters[c] for c in stem(t)) + b"\0" * ends(t): i for t, i in vocab.items()}
    if len(ranks) != len(vocab) or any(0 in t[:-1] and len(t) > 2 for t in ranks):
        return None, -1
    return tiktoken.Encoding("words", pat_str="[^ \\x00]+\\x00| ", mergeable_ranks=ranks, special_tokens={}), ranks[b" "]


class WordIds:
    """Token ids of texts as little-endian 32-bit integers.

    The tokenizer works word by word, so words between white space are encoded once and remembered, up to a bound, by what comes
    first.  Words of Latin letters and ASCII marks (whose lower case and normal form go by single characters) fall into runs of
    letters and of marks, which the tokenizer separates in any case; the runs of all new words of a text are merged at once by
    rank.  Other words go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        path = public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary
        self.encoder = Tokenizer.from_file(path)
        self.ranked, self.blank = _ranked(path)
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known."""
        text = " ".join(new)
        plain = new if self.ranked else []
        if "<|" in text or not _PLAIN.fullmatch(text):
            plain = [w for w in plain if _PLAIN.fullmatch(w) and "<|" not in w]
            text = " ".join(plain)
        out = {}
        if plain:
            # each blank gives one id that no run has, so words end there
            ids = np.array(self.ranked.encode_ordinary(_RUN.sub("\\g<0>\0", text.lower())), "<u4")
            cuts = np.flatnonzero(ids == self.blank)
            raw = ids.tobytes()
            out = {w: raw[lo:hi] for w, lo, hi in zip(plain, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)])}
        if len(plain) < len(new):
            out |= {w: self._encode(w) for w in new if w not in out}
        return out

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return self._encode(text)
        words, known = text.split(), self.words
        new = {w for w in words if w not in known}
        if not new:
            return b"".join(map(known.__getitem__, words))
        found = self._encoded(list(new))
        if len(known) + len(found) <= _WORDS:
            known.update(found)
            return b"".join(map(known.__getitem__, words))
        return b"".join([known[w] if w in known else found[w] for w in words])


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> WordIds:
    """One for each worker process, kept from task to task."""
    return WordIds(vocabulary)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ``ids`` (little-endian unsigned 32-bit) of all documents."""
    end, width = np.array([END], "<u4").tobytes(), 4 * capacity
    kinds = "doc_id {}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        encode = _encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for col, v in zip(rows, (doc.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        col.append(v)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, kinds.format(docs.schema["doc_id"].dataType.simpleString()))


# one block


class Bins:
    """Bins by gap, for best fit and exchanges."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.gap: list[int] = []
        self.with_gap: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.gaps = 0  # bit g is set while a bin has gap g

    def _set(self, b: int, gap: int) -> None:
        old = self.gap[b]
        self.with_gap[old].discard(b)
        if not self.with_gap[old]:
            self.gaps &= ~(1 << old)
        self.gap[b] = gap
        self.with_gap[gap].add(b)
        self.gaps |= 1 << gap

    def tightest(self, size: int) -> int:
        """A bin with the smallest gap of at least ``size``, or -1."""
        fits = self.gaps >> size
        return -1 if not fits else next(iter(self.with_gap[size + (fits & -fits).bit_length() - 1]))

    def put(self, item: int, b: int) -> None:
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.gap.append(self.capacity)
        self.items[b].append(item)
        self._set(b, self.gap[b] - self.sizes[item])

    def take(self, item: int, b: int) -> None:
        self.items[b].remove(item)
        self._set(b, self.gap[b] + self.sizes[item])

    def best_fit(self) -> None:
        for item in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            self.put(item, self.tightest(self.sizes[item]))

    def _swap_index(self, bins) -> tuple[dict, dict]:
        """(gap, size) and (gap, size of two) of the bins -> bins; entries may be out of date."""
        single: dict = {}
        double: dict = {}
        for b in bins:
            self._register(b, single, double)
        return single, double

    def _by_size(self, b: int) -> dict[int, list[int]]:
        """Size -> up to two pieces of the bin.  Different sizes add up to the capacity at most, so there are about sqrt(2 * capacity)."""
        own: dict[int, list[int]] = {}
        for i in self.items[b]:
            same = own.setdefault(self.sizes[i], [])
            if len(same) < 2:
                same.append(i)
        return own

    def _register(self, b: int, single: dict, double: dict) -> None:
        """Every size in the bin, and every size of two of its pieces."""
        g, own = self.gap[b], self._by_size(b)
        sizes = list(own)
        sums = set()
        for k, s in enumerate(sizes):
            single.setdefault((g, s), []).append(b)
            sums.update(s + t for t in sizes[k + (len(own[s]) < 2) :])
        for two in sums:
            double.setdefault((g, two), []).append(b)

    def _partner(self, found: dict, a: int, size: int, two: bool):
        """A bin whose gap g and piece(s) of ``size - g`` let the piece in exactly: (bin, pieces), or None."""
        gaps = self.gaps & ~1 & (1 << size) - 1
        while gaps:
            g = gaps.bit_length() - 1
            gaps ^= 1 << g
            candidates = found.get((g, size - g))
            while candidates:
                b = candidates[-1]
                if b != a and self.gap[b] == g:
                    own, wanted = self._by_size(b), size - g
                    if not two and wanted in own:
                        return b, own[wanted][:1]
                    if two:
                        for s, first in own.items():
                            other = own.get(wanted - s, [])
                            if wanted - s != s and other:
                                return b, [first[0], other[0]]
                            if wanted - s == s and len(first) == 2:
                                return b, list(first)
                candidates.pop()
        return None

    def improve(self) -> None:
        """Local search on the bins that aren't full, until no step is left; every step lets the sum of squared fills grow."""
        while True:
            under = sorted((b for b in range(len(self.items)) if self.gap[b] and self.items[b]), key=lambda b: -self.gap[b])
            single, double = self._swap_index(under)
            changed = 0
            for a in under:
                if not self.items[a] or not self.gap[a]:
                    continue
                for item in sorted(self.items[a], key=lambda i: -self.sizes[i]):
                    size = self.sizes[item]
                    own = self.gap[a]
                    self._hide(a)
                    b = self.tightest(size)
                    self._show(a, own)
                    if b >= 0 and self.gap[b] - size < own:  # move
                        self.take(item, a)
                        self.put(item, b)
                        if self.gap[b]:
                            self._register(b, single, double)
                        changed += 1
                        continue
                    swap = self._partner(single, a, size, False) or self._partner(double, a, size, True)
                    if swap is not None:
                        b, back = swap
                        for i in back:
                            self.take(i, b)
                        self.take(item, a)
                        self.put(item, b)
                        for i in back:
                            self.put(i, a)
                        changed += 1
                if self.items[a] and self.gap[a]:
                    self._register(a, single, double)
            if not changed:
                break

    def _hide(self, b: int) -> None:
        g = self.gap[b]
        self.with_gap[g].discard(b)
        if not self.with_gap[g]:
            self.gaps &= ~(1 << g)

    def _show(self, b: int, gap: int) -> None:
        self.with_gap[gap].add(b)
        self.gaps |= 1 << gap


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    bins = Bins([int(s) for s in sizes], capacity)
    bins.best_fit()
    bins.improve()
    place, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for own in bins.items:
        at = 0
        for i in own:
            place[i], offset[i] = n, at
            at += bins.sizes[i]
        n += bool(own)
    return place, offset


def packed(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    rows = staged(rows.withColumn("__uid", F.monotonically_increasing_id()))
    full = rows.filter(F.col("length") == capacity)
    rest = rows.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("__block", F.pmod(F.xxhash64("__uid"), F.lit(blocks)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("__uid", "ascending")])
        place, offset = pack(table.column("length").to_numpy(), capacity)
        # even numbers; odd ones are those of full pieces
        ids = (table.column("__block").to_numpy().astype(np.int64) << 32 | place) << 1
        return table.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    names = [c for c in rest.columns if c not in ("__uid", "__block")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name in names) + ", sequence_id long, offset long"
    filled = rest.groupBy("__block").applyInArrow(run, schema)
    alone = full.select(*names, (F.col("__uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces(docs, capacity, vocabulary), capacity)
