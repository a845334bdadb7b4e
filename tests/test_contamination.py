"""n-grams that documents and items share, by brute force, within the bound of codes and beyond."""

import random
import re
from collections import Counter

from presswarp.operators import similarity as sim


def test_shared_ngrams_both_ways(spark, monkeypatch):
    rng = random.Random(7)
    words = ["a", "b", "c1", "Dé", "e"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "--", "\n"]) for _ in range(n))
    items = [(k, text(rng.randint(0, 20))) for k in range(12)] + [(99, None)]
    docs = [(k, text(rng.randint(0, 60)) + " " + items[k % 12][1]) for k in range(60)] + [(None, items[3][1] * 2), (61, None), (62, "")]
    grams = lambda t: {tuple(w[k : k + 4]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for k in range(len(w) - 3)}
    own = {k: grams(t) for k, t in items}
    want = Counter((d, k, n, round(n / len(own[k]), 9)) for d, t in docs for k in own if (n := len(grams(t) & own[k])))
    frames = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(items, "id bigint, text string")
    for most in (sim.MOST_CODES, 0):
        monkeypatch.setattr(sim, "MOST_CODES", most)
        assert Counter((r.id, r.item, r.shared, round(r.share, 9)) for r in sim.ngram_contamination(*frames, 4).collect()) == want
    assert want and sim.ngram_contamination(frames[0], frames[1].limit(0), 4).count() == 0 and sim.ngram_contamination(frames[0].limit(0), frames[1], 4).count() == 0
