"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a classifier decides.

Base spans are fixed patterns (e-mail, IPv4 address, card number with check digit, phone number) and always reported.  The method
adds spans of further kinds (keys, passwords, account numbers, ...):

* Candidates: short stretches around digits with a shape that may be personal or secret; those that overlap a base span are left.
* Labelers, each voting +1, 0 or -1: strict pattern, gazetteer of prefixes and country codes, context words before the span, context
  of public numbers (versions, licences), mixture of characters, token boundary, and repetition of characters.
* Vote patterns are counted by Spark over all documents (at most 3 ** 7 patterns); expectation-maximisation on the counts gives each
  labeler's reliability and the probability of each pattern.
* A logistic regression on hashed shapes and context words, trained towards these probabilities on a bounded sample of about
  ``SAMPLE`` candidates, makes the final decision together with the pattern's probability.

Null and empty texts have no spans.  Offsets count code points, ends are exclusive.  Repeated rows give equal rows; other columns
are ignored; an empty table gives an empty result.  All patterns take time linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "key", "national_id", "password", "token")
_ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
SAMPLE, FEATURES, SEED = 20_000, 1 << 12, 5

# base patterns; possessive repeats and look-behinds only spare fruitless restarts
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1
            done = max(done, at)  # a local part can't reach over an @


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)]
    found += [("phone", *s) for s in _phones(text)] if "+" in text else []
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


# candidates

_NEAR = 64
_DIGIT = re.compile(r"[0-9]")
_SHAPES = (
    ("password", re.compile(r"(?i:passwor[dt]|passwd|pwd|passphrase)\s?[=:]\s?[\"']?([^\s\"'=:]{6,64})")),
    ("token", re.compile(r"(?i:token|secret|api[_-]?key|bearer)\s?[=:]?\s?[\"']?([A-Za-z0-9_+/-]{16,96})")),
    ("key", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2,5}[_-]?[A-Z0-9]{12,40}|[a-z]{2,4}_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![A-Za-z0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])")),
)
#: Prefixes of access keys and country codes of account numbers.
_KEY_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "sk_", "pk_", "xoxb", "xoxp")
_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
_CUES = re.compile(r"(?i)passwor[dt]|passwd|pwd|token|secret|key|login|user|account|iban|ssn|social|passport|konto|cuenta|compte")
_PUBLIC = re.compile(r"(?i)version|licen[cs]e|isbn|issn|doi|copyright|figure|table|page|chapter|http|www")


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found: dict[tuple[int, int], str] = {}
    at, size = 0, len(text)
    while m := _DIGIT.search(text, at):
        lo, hi = max(at, m.start() - _NEAR), min(size, m.start() + 2 * _NEAR)
        while hi < min(size, m.start() + 3 * _NEAR) and not text[hi - 1].isspace():
            hi += 1
        window = text[lo:hi]
        reach = m.end()
        for kind, shape in _SHAPES:
            for c in shape.finditer(window):
                s, e = lo + c.start(1), lo + c.end(1)
                if any("0" <= x <= "9" for x in c[1]) and (s, e) not in found:
                    found[s, e] = kind
                    reach = max(reach, e)
        # on to the end of this run of non-blanks, or of what was found
        while reach < size and reach < m.start() + _NEAR and not text[reach].isspace():
            reach += 1
        at = reach
    out: list[tuple[str, int, int]] = []
    for (s, e), kind in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if all(e <= b or s >= t for _, b, t in base) and (not out or s >= out[-1][2]):
            out.append((kind, s, e))
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One character per labeler: ``+``, ``-`` or ``0``."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    strict = {"password": len(span) >= 8 and digits > 0, "token": bool(re.fullmatch(r"[0-9a-f]{32,64}", span)), "key": bool(re.fullmatch(r"[A-Z]{4}[A-Z0-9]{16}", span)), "account": kind == "account" and _iban(span), "national_id": span[:3] not in ("000", "666") and span[0] != "9"}[kind]
    heads = span.startswith(_KEY_HEADS) or kind == "account" and span[:2] in _COUNTRIES
    own = span.replace("-", "").replace(" ", "")
    v = (
        1 if strict else -1,
        1 if heads else (-1 if kind in ("key", "account") else 0),
        1 if _CUES.search(before) else 0,
        -1 if _PUBLIC.search(before) else 0,
        1 if digits >= 3 and letters >= 3 else (0 if kind == "national_id" else -1),
        1 if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()) else -1,
        -1 if len(set(own)) <= 3 else (1 if len(set(own)) >= 8 else 0),
    )
    return "".join("-0+"[x + 1] for x in v)


LABELERS = 7


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features: kind, shape trigrams, context words, length."""
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", text[start:end])))
    left, right = text[max(0, start - 24) : start].lower().split(), text[end : end + 24].lower().split()
    names = [f"k{kind}", f"l{min((end - start) // 8, 9)}", *(f"s{shape[i : i + 3]}" for i in range(len(shape) - 2)), *(f"b{w}" for w in left[-2:]), *(f"a{w}" for w in right[:1])]
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names})


# estimates


def reliabilities(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability that a span with these votes is personal, by EM with labelers independent given the truth."""
    if not counts:
        return {}
    patterns = sorted(counts)
    v = np.array([["-0+".index(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))  # the vote's majority to begin with
    for _ in range(rounds):
        prior = (n @ post + 1) / (n.sum() + 2)
        score = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            yes = np.bincount(v[:, j], n * post, 3) + 1
            no = np.bincount(v[:, j], n * (1 - post), 3) + 1
            score += np.log(yes / yes.sum())[v[:, j]] - np.log(no / no.sum())[v[:, j]]
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    if np.average(((v - 1).sum(axis=1)), weights=n * post + 1e-9) < np.average(((v - 1).sum(axis=1)), weights=n * (1 - post) + 1e-9):
        post = 1 - post  # the class that the votes favour is the personal one
    return dict(zip(patterns, post.tolist()))


def train(x: list[list[int]], y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (last one: bias) towards soft labels, by Adam."""
    w, m, v = (np.zeros(FEATURES + 1) for _ in range(3))
    rng, step = np.random.default_rng(SEED), 0
    for _ in range(8 if x else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            cols = [np.array([*x[k], FEATURES]) for k in part]
            p = np.array([1 / (1 + np.exp(-np.clip(w[c].sum(), -30, 30))) for c in cols])
            g = 1e-5 * w
            for c, e in zip(cols, (p - y[part]) / len(part)):
                g[c] += e
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


# on tables

_FOUND = "base array<string>, kinds array<string>, starts array<int>, ends array<int>, votes array<string>, features array<array<int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each document."""
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                found = candidates(text, base)
                row = ([f"{k}:{s}:{e}" for k, s, e in base], [k for k, _, _ in found], [s for _, s, _ in found], [e for _, _, e in found], [votes(text, *c) for c in found], [features(text, *c) for c in found])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "base", "kinds", "starts", "ends", "votes", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def detect(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    found = staged(scan(docs))
    each = found.select(F.explode(F.arrays_zip("votes", "features", "kinds", "starts")).alias("c"), "doc_id").select("c.*", "doc_id")
    counts = {r.votes: r.n for r in each.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 ** LABELERS rows at most
    truth = reliabilities(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    drawn = each.filter(F.pmod(F.xxhash64("doc_id", "starts", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("votes", "features").orderBy("votes", "features").collect()
    weights = train([list(r.features) for r in drawn], np.array([truth[r.votes] for r in drawn]))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for r in b.select(["base", "kinds", "starts", "ends", "votes", "features"]).to_pylist():
                base = r["base"]
                spans = [(int((p := s.split(":"))[1]), _ORDER[p[0]], int(p[2]), s) for s in base]
                for k, s, e, v, f in zip(r["kinds"], r["starts"], r["ends"], r["votes"], r["features"]):
                    learned = 1 / (1 + np.exp(-np.clip(weights[f].sum() + weights[-1], -30, 30)))
                    if (learned + truth.get(v, 0.0)) / 2 >= threshold:
                        spans.append((s, _ORDER[k], e, f"{k}:{s}:{e}"))
                heads = [s.split(":", 1)[0] for s in base]
                row = (*(heads.count(k) for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(s[3] for s in sorted(spans)))
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
