"""Language identification by unigrams marginalised over segmentations.

Each language has a probability for each piece of a fixed public vocabulary.  A word's likelihood is the sum over all ways to cut it
into pieces of the product of their probabilities (forward algorithm); a text's is the product over its words.  The language with the
largest likelihood is predicted, the score is its posterior among the learned languages.

* Words are runs of letters in lower case, with a mark for their beginning; stretches over ``LONG`` characters are cut.
* Pieces are the vocabulary's pieces made of letters; any other character is a piece of its own with a fixed small probability.
* Learning: word counts by language over a bounded sample of about ``SAMPLE`` labelled documents a language, taken by a hash of the
  text; expected piece counts by the forward-backward algorithm, summed by Spark, ``ROUNDS`` times.  The counts have one row for each
  (language, piece), so what reaches the driver is bounded by the vocabulary.

A null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to learn from.  Rows without lang
are not learned from.  Repeated rows are predicted alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, ROUNDS, LONG, SEED = 1500, 3, 24, 23
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK, _ODD, _PRIOR = "▁", 1e-7, 0.05
_LONGEST = 12


def pieces(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Letter pieces of the vocabulary in lower case -> number from 2; 0 stands for no piece, 1 for an unknown character."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
    words = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    words = sorted(w for w in words if len(w) <= _LONGEST and w.removeprefix(_MARK).isalpha() or w == _MARK)
    return {w: k for k, w in enumerate(words, 2)}


def words_of(text: str | None) -> list[str]:
    return [w for w in _LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _stretches(word: str) -> list[str]:
    word = _MARK + word
    return [word[i : i + LONG] for i in range(0, len(word), LONG)]


class Lattice:
    """Piece numbers of all substrings of a batch of stretches of one length."""

    def __init__(self, stretches: list[str], known: dict[str, int]):
        n = len(stretches[0])
        get = known.get
        self.n = n
        self.ids: dict[tuple[int, int], np.ndarray] = {}
        for i in range(n):
            self.ids[i, i + 1] = np.array([get(s[i], 1) for s in stretches])
            for j in range(i + 2, min(n, i + _LONGEST) + 1):
                found = np.array([get(s[i:j], 0) for s in stretches])
                if found.any():
                    self.ids[i, j] = found

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """p: (pieces, languages); the sums over all segmentations of each prefix, (stretches, languages) each."""
        a = [np.ones((len(self.ids[0, 1]), p.shape[1]))]
        for j in range(1, self.n + 1):
            a.append(sum(a[i] * p[self.ids[i, j]] for i in range(max(0, j - _LONGEST), j) if (i, j) in self.ids))
        return a

    def backward(self, p: np.ndarray) -> list[np.ndarray]:
        b = [np.ones((len(self.ids[0, 1]), p.shape[1]))]
        for i in range(self.n - 1, -1, -1):
            b.append(sum(p[self.ids[i, j]] * b[self.n - j] for j in range(i + 1, min(self.n, i + _LONGEST) + 1) if (i, j) in self.ids))
        return b[::-1]


def _by_length(stretches: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, s in enumerate(stretches):
        out.setdefault(len(s), []).append(k)
    return out


def likelihoods(words: list[str], known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language."""
    flat = [(k, s) for k, w in enumerate(words) for s in _stretches(w)]
    out = np.zeros((len(words), p.shape[1]))
    texts = [s for _, s in flat]
    owner = np.array([k for k, _ in flat])
    for own in _by_length(texts).values():
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            np.add.at(out, owner[part], np.log(np.maximum(Lattice([texts[k] for k in part], known).forward(p)[-1], 1e-300)))
    return out


def expected(words: list[str], counts: np.ndarray, known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected number of each piece over the words of one language; p: (pieces,)."""
    flat = [(s, c) for w, c in zip(words, counts) for s in _stretches(w)]
    texts, weight = [s for s, _ in flat], np.array([c for _, c in flat], float)
    out, p = np.zeros(len(p)), p[:, None]
    for own in _by_length(texts).values():
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            grid = Lattice([texts[k] for k in part], known)
            a, b = grid.forward(p), grid.backward(p)
            whole = np.maximum(a[-1], 1e-300)
            for (i, j), ids in grid.ids.items():
                share = (a[i] * p[ids] * b[j] / whole)[:, 0] * weight[part]
                np.add.at(out, ids, share)
    return out


def _normal(counts: np.ndarray) -> np.ndarray:
    """(pieces, languages) probabilities: no piece 0, unknown characters a fixed one."""
    p = counts + _PRIOR
    p[:2] = 0
    p /= p.sum(axis=0, keepdims=True)
    p[1] = _ODD
    return p


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """The learned languages and their piece probabilities (pieces, languages)."""
    own = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(held)
    size = len(pieces(vocabulary)) + 2
    if not langs:
        return [], np.zeros((size, 0))
    draw = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30))
    share = F.lit(1 << 30)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / held[lang]) * (1 << 30)))).otherwise(share)

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    words = own.filter(draw < share).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = staged(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = _normal(np.ones((size, len(langs))))
    for _ in range(ROUNDS):
        def step(batches, p=p):
            known, total = pieces(vocabulary), np.zeros((size, len(langs)))
            for b in batches:
                lang, word, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, name in enumerate(langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    if at:
                        total[:, k] += expected([word[i] for i in at], n[at], known, p[:, k])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], names=["piece", "k", "n"])

        got = words.repartition("word").mapInArrow(step, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((size, len(langs)))
        counts[got.column("piece").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
        p = _normal(counts)
    return langs, p


class Memory:
    """Likelihoods of words under one model; takes what comes first, up to a bound, and lasts from task to task."""

    def __init__(self, known: dict[str, int], p: np.ndarray):
        self.known, self.p = known, p
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, p.shape[1]))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over the words of each text (none of them empty); new words of all texts share their lattices."""
        rows, every = self.rows, [w for words in texts for w in words]
        new = [w for w in dict.fromkeys(every) if w not in rows]
        first, extra = len(rows), {}
        if new:
            more, room = likelihoods(new, self.known, self.p), max(0, _WORDS - first)
            while first + min(room, len(new)) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new[:room])] = more[:room]
            rows.update(zip(new[:room], range(first, first + room)))
            extra = dict(zip(new[room:], range(len(rows), len(rows) + len(new))))
        if extra:
            table = np.concatenate([self.table[: len(rows)], more[room:]])
            at = np.fromiter((rows[w] if w in rows else extra[w] for w in every), np.int64, len(every))
        else:
            table, at = self.table, np.fromiter(map(rows.__getitem__, every), np.int64, len(every))
        sizes = np.array([len(words) for words in texts])
        return np.add.reduceat(table[at], np.cumsum(sizes) - sizes, axis=0)


_WORDS = 1 << 18
_STEP = 1 << 18  # words looked up together
_KEPT: dict = {}


def _memory(vocabulary: str, p: np.ndarray) -> Memory:
    """The worker process's memory for a model; one model at a time."""
    key = (vocabulary, p.shape, zlib.crc32(p.tobytes()))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Memory(pieces(vocabulary), p)
    return _KEPT[key]


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray], vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, lang_pred, score."""
    langs, p = fitted

    def run(batches):
        memory = _memory(vocabulary, p)
        for b in batches:
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            held, at, size = [], [], 0

            def settle():
                total = memory.totals(held)
                post = np.exp(total - total.max(axis=1, keepdims=True))
                score[at] = post.max(axis=1) / post.sum(axis=1)
                for k, best in zip(at, total.argmax(axis=1)):
                    pred[k] = langs[int(best)]
                held.clear()
                at.clear()

            for k, text in enumerate(b.column(1)):
                words = words_of(text.as_py()) if langs else []
                if words:
                    held.append(words)
                    at.append(k)
                    size += len(words)
                if size >= _STEP:
                    settle()
                    size = 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all documents, learned from those that aren't held out."""
    fitted = fit(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return predict(docs, fitted).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
