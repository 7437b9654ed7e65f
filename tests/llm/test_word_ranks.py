"""Words of Latin letters and marks are merged by rank, without the tokenizer itself."""

import json

import numpy as np

from quadfield.llm import packing


def test_plain_words_pass_the_tokenizer_by():
    want = packing.WordIds()
    text = "Straße (THE end)... naïve words, again!! " + " ".join("abcdeinghtrs"[k % 7 : k % 12] for k in range(200))
    ids = packing.WordIds()
    ids.encoder = None
    assert ids(text) == want._encode(text)


def test_every_token_stands_for_itself():
    """So a pair that makes a token, but isn't its merge, never stands side by side: ids serve as ranks."""
    import public_tokenizers

    with open(public_tokenizers.path(packing.VOCABULARY), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        end = token.endswith("</w>")
        parts = list(token.removesuffix("</w>"))
        parts[-1] += "</w>" * end
        while len(parts) > 1:
            best, k = min((rank.get((a, b), len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token]


def test_long_and_odd_runs():
    rng = np.random.default_rng(2)
    ids = packing.WordIds()
    for n in range(300):
        text = " ".join("".join(rng.choice(list("aeinthsroÉß.-="), rng.integers(1, 60))) for _ in range(20)) + " " + "a." [n % 2] * n
        assert ids(text) == ids._encode(text)
