"""Character n-grams of long runs of letters."""

from collections import Counter

import numpy as np
import pytest

from fieldroll.llm import common, langid, toxicity


@pytest.mark.parametrize("block", [5, 17, 64, 1 << 20])
def test_every_gram_once(block):
    words = ["ab", "", "x" * 70 + "yz", "été漢字🙂" * 40, "c"]
    single = {}
    for n, w in ((n, f"<{w}>") for w in words for n in (2, 3, 4)):
        for k in range(len(w) - n + 1):
            single.setdefault(w[k : k + n], len(single))
    parts = list(common.gram_blocks(words, 2, 4, 1 << 30, block))
    got = Counter(zip(np.concatenate([p[1] for p in parts]).tolist(), np.concatenate([p[0] for p in parts]).tolist()))
    count = Counter((i, f"<{w}>"[k : k + n]) for i, w in enumerate(words) for n in (2, 3, 4) for k in range(len(w) + 3 - n))
    assert sum(got.values()) == sum(count.values())
    for i in range(len(words)):
        assert sorted(n for (w, _), n in got.items() if w == i) == sorted(n for (w, _), n in count.items() if w == i)


def test_ends_of_long_runs_are_scored():
    model = toxicity.Classifier.fitted([["kind"], ["vile"], ["nice"], ["vile", "text"]], [0, 1, 0, 1])
    plain, hidden = model.words(["a" * 200, "a" * 200 + "vile"])
    assert hidden > plain
    grams = {lang: Counter(common.word_grams([text], 1, langid.ORDER, langid.BUCKETS)[0].tolist()) for lang, text in (("aa", "abcabc"), ("xx", "xyzxyz"))}
    scorer = langid.Scorer(langid.Model.of_counts([(lang, g, n) for lang, own in grams.items() for g, n in own.items()]))
    assert scorer.predict(["abc" * 22 + "xyz" * 400])[0] == ["xx"]
