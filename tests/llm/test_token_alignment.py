import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadfield.llm import token_alignment as ta

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces  ", "tab\tand\nnewline \n next", "\r\n x", "a\x1c b \x1c", "\x00b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "lower ▁ one eighth", "▁", "x▁ y",
    "café ﬁ ￼ 日本語 テスト 🙂🙂 é", " nbsp  x", "a" * 5000, "ab" * 3000 + " end", "=" * 300 + "\n" + " " * 300 + "x", "word " * 3000, "1234567890 " * 50, "don't we'll I've they're", "  line sep", " " * 5000,
    "𝔘𝔫𝔦 \U0010ffff", "\t\t\tindent = [1, 2];\n\t\treturn  None", "end.\n\n \nnew", "ẞ ŉ ǆ Å",
]


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = ta.vocabularies()
    a_tok, b_tok = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    letters = ta.byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_tok.id_to_token(i))

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    docs, holds = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes(i)) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for e in shared:
            p, q = i, j
            while i < len(a) and ends_a[i] <= e:
                i += 1
            while j < len(b) and ends_b[j] <= e:
                j += 1
            groups.append((a[p:i], b[q:j]))
        links = Counter()
        for x, y in groups:
            for u, p in Counter(x).items():
                for v, q in Counter(y).items():
                    links[u, v] += p * q
        holds.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (u, _), n in holds.items():
        best[u] = max(best[u], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", row long, shard string").repartition(5)
    got = sorted((tuple(r) for r in ta.align(df, **how).collect()), key=str)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=str)
    assert got == want


@pytest.fixture(scope="module")
def sample(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    try:
        return [tuple(r) for r in spark.read.parquet(folder).collect()]
    except Exception:  # noqa: BLE001
        pytest.skip("no tables")


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 32, n))
        made = ta.PerfectHash.build(keys)
        assert sorted(made(keys).tolist()) == list(range(len(keys)))
        again = ta.PerfectHash(made.sizes, made.bits)
        assert (again(keys) == made(keys)).all()


def test_keys_are_verified():
    import pyarrow as pa

    keys = np.arange(0, 1000, 2)
    made = ta.PerfectHash.build(keys)
    ordered = np.zeros(500, np.int64)
    ordered[made(keys)] = keys
    shard = ta._Shard(pa.table({"sizes": [made.sizes], "bits": [made.bits], "keys": [ordered.tobytes()]}))
    assert (shard.keys[shard.numbers(keys)] == keys).all()
    with pytest.raises(ValueError):
        shard.numbers(np.array([1, 3, 5]))


def test_odd_texts(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)] + [(0, "a", "en", "s", 1), (0, "a", "en", "s", 1), (None, "a b", None, None, None), (None, None, None, None, None), (77, None, None, None, None)]
    check(spark, rows)


def test_whole_sample_one_shard(spark, sample):
    check(spark, sample)


def test_shards_lanes_and_salts(spark, sample):
    """Small bounds: many shards, a tree of several levels, several tasks a shard."""
    check(spark, sample[:120], shard_keys=500, sums_in_task=40, pairs_in_task=300)


def test_memory_is_cut_back():
    tokens = ta.Tokenizers(*ta.vocabularies())
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{rng.integers(0, 4000)}" for _ in range(200)) + (" \n" if k % 3 == 0 else "") for k in range(60)]
    small, large = ta.Aligned(tokens, remembered=300), ta.Aligned(tokens)
    for k in range(0, 60, 5):
        x, y = small.align(texts[k : k + 5], True), large.align(texts[k : k + 5], True)
        assert all(np.array_equal(p, q) for p, q in zip(x, y))
    assert small.known < large.known


def test_a_third_is_one_text(spark):
    check(spark, [(k, "the same text\nagain" if k % 3 == 0 else f"text number {k}", None, None, None) for k in range(300)], pairs_in_task=50)


def test_nothing(spark):
    assert ta.align(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None, None, None, None), (2, "▁", None, None, None)])
