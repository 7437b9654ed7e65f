"""Operators on documents against brute force, and their results on odd input."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quadfield.llm import exact_dedup, language_id, line_dedup, mixing, packing, pii, quality, simhash_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def prose(seed, n, lines=8):
    rng = np.random.default_rng(seed)
    w = rng.choice(WORDS, n).tolist()
    step = max(1, n // lines)
    return "\n".join(" ".join(w[i : i + step]) for i in range(0, n, step))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, odd white space, empty, null and long texts."""
    base = [prose(k, 60 + 7 * k) for k in range(25)]
    shared = prose(99, 45)
    texts = [*base, base[3], base[3].replace(" ", "  "), base[4] + " end", "", None, " \n\t", "one", "one two", "one two", prose(7, 4000, 300)]
    texts += [f"{prose(200 + k, 30)}\n{shared}\n{prose(300 + k, 30)}" for k in range(12)]
    texts += [base[5].upper(), "Straße ÄÖ " * 30, base[6] + "\n" + base[6]]
    langs, sources = ["en", "de", None, "fr"], ["src0", "src0", "src1", "src2", "web", None]
    return [(k, t, langs[k % 4], sources[k % 6], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


def rows_by_id(df):
    return {r.doc_id: r for r in df.collect()}


# brute force


def collapse(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(docs, corpus):
    got = rows_by_id(exact_dedup.mark(docs))
    groups = {}
    for k, t, *_ in corpus:
        groups.setdefault(collapse(t), []).append(k)
    for k, t, *_ in corpus:
        own = groups[collapse(t)]
        want = (min(own), len(own), k == min(own), hashlib.sha256(collapse(t).encode()).hexdigest())
        assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == want
    assert {r.doc_id for r in exact_dedup.deduplicate(docs).collect()} == {min(g) for g in groups.values()}


def test_exact_directory(docs):
    """Small buckets: local depths differ, every entry is found in its bucket, all keys of a bucket share its prefix."""
    index = exact_dedup.build_index(docs, capacity=3, max_depth=6).collect()
    assert len({r.depth for r in index}) > 1
    for r in index:
        head = (r.key & (1 << 64) - 1) >> 58
        assert head >> 6 - r.depth << 6 - r.depth == r.bucket
    full = {}
    for r in index:
        full.setdefault(r.bucket, []).append(r)
    assert all(len(v) <= 3 or v[0].depth == 6 for v in full.values())


def gone_lines(corpus, least, min_line=line_dedup.MIN_LINE, frequent=line_dedup.FREQUENT):
    """Line numbers that go: in any run of at least ``least`` characters that starts at an earlier place as well, or of a frequent line."""
    places, gone = {}, {}
    count = collections.Counter(x for _, t, *_ in corpus for x in (t or "").split("\n"))
    for k, t, *_ in sorted(corpus):
        ls = (t or "").split("\n")
        full = [i for i, x in enumerate(ls) if x.strip(" ")]
        seq = [ls[i] for i in full]
        for a, line in enumerate(seq):
            if line in places and len(line) >= min_line and count[line] >= frequent:
                gone.setdefault(k, set()).add(full[a])
            for other, s in places.get(line, ()):
                n = 0
                while a + n < len(seq) and s + n < len(other) and other[s + n] == seq[a + n]:
                    n += 1
                if sum(map(len, seq[a : a + n])) >= least:
                    gone.setdefault(k, set()).update(full[a : a + n])
            places.setdefault(line, []).append((seq, a))
    return gone


@pytest.mark.parametrize("least", [20, 100, 400])
def test_lines(docs, corpus, least):
    gone = gone_lines(corpus, least)
    assert gone
    got = rows_by_id(line_dedup.delete_lines(docs, least))
    for k, t, *_ in corpus:
        if t is None:
            assert got[k].text is None and got[k]["__lines_removed"] == 0
            continue
        assert got[k].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ()))
        assert got[k]["__lines_removed"] == len(gone.get(k, ()))


def fingerprint(t, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    import xxhash

    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(ids, prints, bits):
    comp = dict(zip(ids, ids))
    moved = True
    while moved:
        moved = False
        for a, x in zip(ids, prints):
            for b, y in zip(ids, prints):
                if (x ^ y).bit_count() <= bits and comp[b] < comp[a]:
                    comp[a], moved = comp[b], True
    return comp


@pytest.mark.parametrize("bits", [3, 8])
def test_simhash(docs, corpus, bits):
    ids, prints = [k for k, *_ in corpus], [fingerprint(t, 3) for _, t, *_ in corpus]
    comp = smallest_reachable(ids, prints, bits)
    got = rows_by_id(simhash_dedup.mark(docs, max_bits=bits))
    for k, p in zip(ids, prints):
        assert (got[k].fingerprint, got[k].component_id) == (f"{p:016x}", comp[k])
    kept = {r.doc_id for r in simhash_dedup.deduplicate(docs, words=3, max_bits=bits).collect()}
    assert kept == set(comp.values())


def test_simhash_hot_groups(spark):
    """Dense clusters: groups over the limit are split again, and no link between different texts is lost."""
    rng = np.random.default_rng(4)
    prints = []
    for centre in rng.integers(0, 2**63, 3):
        for _ in range(400):
            p = int(centre)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints += [int(x) for x in rng.integers(0, 2**63, 300)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = frame(spark, [(k, p) for k, p in enumerate(signed)], "doc_id long, fp long").repartition(4)
    x = np.array(prints, np.uint64)
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[np.bitwise_count(x ^ v) <= 3].min() for v in x])
        if (new == comp).all():
            break
        comp = new
    for hot in (16, 100_000):
        got = {r.fp: r.component_id for r in simhash_dedup.classes(df, 3, hot).collect()}
        assert [got[p] for p in signed] == comp.tolist()


def test_index_links():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**12, 500).astype(np.uint64) << np.uint64(20))
    group = np.sort(rng.integers(0, 3, len(fps)))
    order = np.lexsort((simhash_dedup.gray_rank(fps), group))
    fps, group = fps[order], group[order]
    got = {(int(i), int(j)) for a, b in simhash_dedup.Index(group, fps).links(3) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want


def removed_words(corpus, n=20):
    seen, out = {}, {}
    for k, t, *_ in sorted(corpus):
        w = (t or "").encode().split()
        flags = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), (k, i)) != (k, i):
                flags[i : i + n] = [True] * n
        out[k] = (len(w), sum(flags), hashlib.sha256(b" ".join(x for x, g in zip(w, flags) if not g)).hexdigest())
    return out


def test_substrings(docs, corpus):
    got = {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in rows_by_id(substring_dedup.digest(docs)).items()}
    want = removed_words(corpus)
    assert got == want and sum(n for _, n, _ in want.values()) > 500


def test_substrings_across_pieces_and_hot_slots(spark, monkeypatch):
    """Texts longer than a piece, and every anchor treated as hot, give the same words."""
    rows = [(k, prose(k % 3, 3000, 20) if k % 2 else " ".join(["same"] * 700), "en", "s", 0) for k in range(8)]
    monkeypatch.setattr(substring_dedup, "PIECE", 512)
    df, want = frame(spark, rows), removed_words(rows)
    blocks = substring_dedup.Blocks()
    assert [len(h) for _, h in blocks.pieces(rows[1][1].encode())][:2] == [531, 531]
    for hot in (np.zeros(0, np.uint64), np.arange(substring_dedup.SLOTS).astype(np.uint64)):
        monkeypatch.setattr(substring_dedup, "hot_slots", lambda _, hot=hot: hot)
        assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in rows_by_id(substring_dedup.digest(df)).items()} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def good(kind, s):
        n = len(re.sub("[^0-9]", "", s))
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 14 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), "phone": 10 <= n <= 15}[kind]

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if good(kind, m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def test_base_spans():
    rng = np.random.default_rng(3)
    bits = ["a", "@", ".", "1", "25", ".", "+", "-", " ", "(", "9", "x.y", "4111111111111111", "@", "0", "%", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(bits, rng.integers(1, 25)))
        assert pii.base_spans(t) == plain_spans(t)
    long = "1" * 200_000 + "a" * 200_000 + "1." * 100_000
    assert isinstance(pii.base_spans(long), list) and isinstance(pii.candidates(long, []), list)


def test_pii(spark):
    rows = [(k, f"{prose(k, 12)} {x}", "en", "s", 0) for k, x in enumerate(
        ["mail a.b@c.example.org now"] * 5 + ["call +1 (523) 555-1055 or 10.0.0.255"] * 5 + ["card 4111 1111 1111 1111"] * 5
        + [f"key AKIA{'ABCDEFGHIJ2345'[i:]}{'QRSTUVWX7654'[: i + 2]} here" for i in range(6)] + ["password=8f3a91c07b2d1e55 ok"] * 5 + ["version 3.0 of 2024"] * 5
    )]
    got = rows_by_id(pii.detect(frame(spark, rows)))
    for k, t, *_ in rows:
        base = plain_spans(t)
        digest = hashlib.sha256(",".join(f"{a}:{s}:{e}" for a, s, e in base).encode()).hexdigest()
        assert got[k].base_sha256 == digest and [got[k][f"n_{x}"] for x in pii.BASE] == [sum(a == x for a, _, _ in base) for x in pii.BASE]
        assert all(f"{a}:{s}:{e}" in got[k].spans.split(",") for a, s, e in base)
    assert all("key:" in got[k].spans for k in range(15, 21)) and all("password:" in got[k].spans for k in range(21, 26))
    assert all(got[k].spans == "" for k in range(26, 31))


def test_pii_reliabilities():
    """Two good labelers and a coin: the estimates follow the good ones."""
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.3
        v = "".join("+" if (rng.random() < p) == y else "-" for p in (0.95, 0.9, 0.5))
        counts[v] = counts.get(v, 0) + 1
    p = pii.reliabilities(counts)
    assert p["++-"] > 0.8 and p["--+"] < 0.2 and pii.reliabilities({}) == {}


def test_packing(docs, corpus):
    rows = packing.pack_documents(docs).collect()
    encode = packing.WordIds()._encode
    want = {}
    for k, t, *_ in corpus:
        ids = encode(t or "") + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(ids), 4 * 2048)):
            part = ids[at : at + 4 * 2048]
            want[k, n] = (at // 4, len(part) // 4, zlib.crc32(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_word_ids():
    """Words put together from runs give what the tokenizer gives for the whole text."""
    rng = np.random.default_rng(1)
    bits = ["a", "B", "é", "É", "ß", "Ü", "÷", "×", "!", ".", "|", "<|endoftext|>", "<|", "'s", "'", " ", "\n", "\x1c", "23", "²", "İ", "́", "日", "_", "```", " ", "don't", "THE!!", "ΑΣ", "𝒳"]
    ids = packing.WordIds()
    for _ in range(4000):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert ids(t) == ids._encode(t)


def test_bins():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 2000):
        sizes = rng.integers(1, 2048, n)
        place, offset = packing.pack(sizes)
        if not n:
            continue
        fill = np.bincount(place, weights=sizes)
        assert fill.max() <= 2048 and (fill > 0).all()
        bins = packing.Bins(sizes.tolist(), 2048)
        bins.best_fit()
        before = sum((2048 - g) ** 2 for g, i in zip(bins.gap, bins.items) if i)
        assert len(fill) <= len(bins.items) and (fill**2).sum() >= before


def test_exchange_empties_a_bin():
    """Best fit leaves three bins of capacity 10; one exchange and a move need two."""
    bins = packing.Bins([6, 3, 5, 4, 2], 10)
    for item, b in ((0, -1), (1, 0), (2, -1), (3, 1), (4, -1)):
        bins.put(item, b)
    bins.improve()
    assert sum(bool(i) for i in bins.items) == 2


def test_mixing(docs, corpus):
    """Budgets are spent by weight, shortages go to siblings first, and prefixes stay within the rest."""
    rows = [r.asDict() for r in mixing.select_epochs(docs, spend=0.8).collect()]
    held = {}
    for k, t, lang, source, _ in corpus:
        m = re.search("([0-9]{1,9})$", source or "")
        leaf = (f"d{int(m[1]) % 3 if m else 0}", lang or "?", source or "?")
        held.setdefault(leaf, {})[k] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = int(sum(sum(v.values()) for v in held.values()) * 8 // 10)
    tables = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS)

    def share(budget, children):
        """children: {name: (weight, room)}; water level by repetition."""
        got, open_ = dict.fromkeys(children, 0), {c for c, (w, room) in children.items() if w and room}
        left = budget
        while open_:
            weight = sum(children[c][0] for c in open_)
            full = {c for c in open_ if left * children[c][0] >= children[c][1] * weight}
            if not full:
                for c in open_:
                    got[c] = left * children[c][0] // weight
                return got
            first = min(full, key=lambda c: children[c][1] / children[c][0])
            got[first] = min(children[first][1], left)
            left -= got[first]
            open_.remove(first)
        return got

    def descend(budget, leaves, depth):
        if depth == 3:
            return {next(iter(leaves)): budget}
        names = sorted({leaf[depth] for leaf in leaves})
        rooms = {n: (tables[depth].get(n, 1), 2 * sum(sum(v.values()) for leaf, v in leaves.items() if leaf[depth] == n)) for n in names}
        out = {}
        for n, b in share(budget, rooms).items():
            out |= descend(b, {leaf: v for leaf, v in leaves.items() if leaf[depth] == n}, depth + 1)
        return out

    want = descend(total, held, 0)
    for leaf, budget in want.items():
        own = [r for r in rows if (r["domain"], r["language"], r["origin"]) == leaf]
        spent, size = sum(r["tokens"] for r in own), sum(held[leaf].values())
        full = budget // size if size else 0
        assert spent <= budget and all(sum(r["epoch"] == e for r in own) == len(held[leaf]) for e in range(full))
        rest = [r["doc_id"] for r in own if r["epoch"] == full]
        order = sorted(held[leaf], key=lambda k: (hashlib.md5(f"{mixing.SEED}:{full}:{k}".encode()).hexdigest(), k))
        upto = np.cumsum([held[leaf][k] for k in order])
        assert set(rest) == {k for k, u in zip(order, upto) if u <= budget - full * size and budget - full * size > 0}


def test_quality(spark):
    """Held-out accuracy on two kinds of texts; probabilities in range; reject and keep."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(400):
        w = rng.choice(WORDS, rng.integers(20, 80)).tolist()
        bad = k % 4 == 0
        rows.append((k, " ".join(x + "$$$" for x in w) if bad else " ".join(w) + ".", "en", "s", 0))
        labels.append((k, 0 if bad else 1, 0))
    docs = frame(spark, [*rows, (1000, None, None, None, None), (1001, "", None, None, 0)])
    labels = frame(spark, labels, "doc_id long, quality int, toxic int")
    got = rows_by_id(quality.predict(docs, labels))
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert np.mean([got[k].predicted == (k % 4 != 0) for k in range(400) if got[k].held_out]) > 0.97
    kept = quality.keep_good(docs, quality.fit(docs, labels, labels.doc_id >= 0))
    assert kept.columns == docs.columns and 295 <= kept.filter("doc_id < 400").count() <= 305


def test_language(spark):
    rng = np.random.default_rng(0)
    stems = {"en": ["the", "thing", "other", "with", "ing", "short"], "de": ["der", "schule", "nicht", "über", "zeit", "kraft"], "fr": ["les", "école", "été", "pour", "avec", "beaux"]}
    rows = [(k, " ".join(rng.choice(stems[lang], 12)), lang, "s", 0) for k in range(150) for lang in [list(stems)[k % 3]]]
    docs = frame(spark, [*rows, (1000, None, "en", None, 0), (1001, "123 !!", "en", None, 0), (1002, "", None, None, 0)])
    got = rows_by_id(language_id.identify(docs))
    assert np.mean([got[k].lang_pred == lang for k, _, lang, *_ in rows if got[k].held_out]) > 0.97
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert rows_by_id(language_id.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")))[0].lang_pred == "und"


def test_segmentations():
    """The forward sums equal the sum over all cuts, and expected counts those of all cuts."""
    known = {"▁": 2, "▁a": 3, "ab": 4, "b": 5, "a": 6, "▁ab": 7}
    p = np.array([0, 1e-7, 0.1, 0.2, 0.15, 0.25, 0.1, 0.2])

    def cuts(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest in cuts(s[k:]):
                    yield [known[s[:k]], *rest]

    word = "abab"
    all_cuts = list(cuts("▁" + word))
    weights = np.array([np.prod(p[c]) for c in all_cuts])
    assert np.isclose(np.exp(language_id.likelihoods([word], known, p[:, None])[0, 0]), weights.sum())
    want = np.zeros(8)
    for c, w in zip(all_cuts, weights / weights.sum()):
        np.add.at(want, c, w)
    assert np.allclose(language_id.expected([word], np.array([1]), known, p), want)


# odd input

OPERATORS = {
    "exact": exact_dedup.mark, "lines": line_dedup.digest, "simhash": simhash_dedup.mark, "substrings": substring_dedup.digest,
    "pii": pii.detect, "packing": packing.pack_documents, "mixing": mixing.digest, "language": language_id.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_rows_repeats_and_clashing_columns(spark, name):
    text = prose(1, 50)
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (2, None, None, None, None), (None, text, "en", "src1", None), (None, None, None, None, None), (3, "", "de", "src0", 0), (4, text + " tail", "en", "src0", 9)]
    wide = ", n long, fp string, key string, pos string, need int, score string, tokens string, kept string, `__key2` int"
    df = frame(spark, [(*r, 1, "x", "x", "x", 1, "x", "x", "x", 1) for r in rows], SCHEMA + wide)
    got = OPERATORS[name](df).collect()
    if name != "mixing":
        assert {r.doc_id for r in got} == {1, 2, 3, 4, None}
    if name not in ("mixing", "packing"):
        assert len(got) == len(rows)
    if name == "exact":
        assert [(r.keep_id, r.group_size) for r in got if r.doc_id == 1] == [(1, 3)] * 2
    if name == "simhash":
        assert [r.component_id for r in got if r.doc_id in (2, 3)] == [2, 2]
    if name == "substrings":
        assert {r.doc_id: r.n_removed for r in got if r.doc_id} == {1: 0, 2: 0, 3: 0, 4: 50}
    if name == "packing":
        assert sum(r.doc_id == 1 for r in got) == 2 and all(r.length == 1 for r in got if r.doc_id in (2, 3))


def test_quality_on_nothing(spark):
    none = frame(spark, [])
    labels = frame(spark, [], "doc_id long, quality int, toxic int")
    assert quality.predict(none, labels).count() == 0
    some = frame(spark, [(1, "text", None, None, 0), (1, "text", None, None, 0), (None, None, None, None, None)])
    assert [r.score for r in quality.predict(some, labels).collect()] == [0.5] * 3
