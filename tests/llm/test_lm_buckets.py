"""Language-model scores against a brute-force interpolated model, where the top context's bucket was never learned."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lm_scoring


def test_unlearned_buckets_take_the_nearest_weights():
    low, high = (0.5, 0.3, 0.2), (0.8, 0.1, 0.1)
    got = lm_scoring.bucket_weights({2: low, 5: high}, 7, (0.0, 0.9, 0.1))
    assert [tuple(x) for x in got[1:]] == [low] * 4 + [high] * 3
    assert got[0].tolist() == pytest.approx([0.0, 0.6, 0.4])  # nothing was seen, so no bigram
    assert lm_scoring.bucket_weights({}, 1, (0.0, 0.9, 0.1)).tolist() == [[0.0, 0.9, 0.1]] * 2


def test_scores_when_the_top_count_is_just_above_a_power_of_two(spark):
    """"hot" is seen 1,040 times in all and fewer than 1,024 times outside the held-out tenth."""
    rng = random.Random(4)
    texts = {i: [w for _ in range(8) for w in ("hot", f"w{int(20 * rng.random() ** 2)}")] for i in range(130)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    held = {r[0] for r in df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("tune")), F.lit(10)) == 0).select("doc_id").collect()}

    def counts(ids):
        words, pairs = collections.Counter(), collections.Counter()
        for i in ids:
            line = [*texts[i], None]
            words.update(line)
            words["begin"] += 1
            pairs.update(zip(["begin", *line], line))
        starts = words.pop("begin")
        return words, pairs, lambda c: starts if c == "begin" else words[c]

    def estimates(model, context, word):
        words, pairs, seen = model
        n = seen(context)
        return 1 + int(math.log2(n)) if n else 0, pairs[context, word] / n if n else 0.0, words[word] / words.total()

    main, every = counts(set(texts) - held), counts(texts)
    assert main[0]["hot"] < 1024 <= every[0]["hot"] == 1040
    cells = collections.Counter()
    for i in held:
        line = [*texts[i], None]
        for context, word in zip(["begin", *line], line):
            k, *p = estimates(main, context, word)
            cells[k, *(int(lm_scoring._level(np.array([x]))[0]) for x in p)] += 1
    weights = lm_scoring.learn_weights(np.array([(*c, n) for c, n in cells.items()]), 1 / (len(main[0]) + 1))
    assert 11 not in weights and 10 in weights and weights[10][0] > 0.1
    for r in lm_scoring.score(df, F.lit(True)).collect():
        line, want = [*texts[r.doc_id], None], 0.0
        for context, word in zip(["begin", *line], line):
            k, p2, p1 = estimates(every, context, word)
            w = weights[max(b for b in weights if b <= k)]
            want += math.log10(w[0] * p2 + w[1] * p1 + w[2] / (len(every[0]) + 1))
        assert r.score == pytest.approx(want, rel=1e-9)
