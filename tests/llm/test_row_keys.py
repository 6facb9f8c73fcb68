"""The pipeline's stages on rows whose ids are null or repeated."""

import collections
import random

import pytest

import corpus_pipeline
from gridloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_gives_each_row_its_own_words(spark):
    """Every word of a text names its row, so that each emitted word shows where it came from."""
    rng = random.Random(12)
    ids = [*range(30), *[None] * 20, *[7] * 20]
    texts = [" ".join(f"r{i}w{k}" for k in range(rng.randrange(40, 400))) for i in range(len(ids))]
    rows = [(d, t, "en", ("a", "b", None)[i % 3], len(t)) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[40]] * 3 + [rows[5]] * 3  # equal rows, without and with an id
    copies = collections.Counter(r[1] for r in rows)
    got = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    at = {t: i for i, t in enumerate(texts)}
    limit = {f"r{i}": 3 * copies[t] for t, i in at.items()}
    words, times = collections.Counter(), collections.Counter()
    for r in got:
        own = {w.split("w")[0] for w in r.text.split()}
        assert len(own) == 1  # of one row
        i = int(own.pop()[1:])
        assert (r.doc_id, r.source) == (ids[i], rows[i][3])
        words[r.source] += len(r.text.split())
        times.update(r.text.split())
    assert all(n <= limit[w.split("w")[0]] for w, n in times.items())
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("a", "b", None)]
    for s, target in zip(("a", "b", None), mixing.fill_targets(sizes, [1, 2, 3]), strict=True):
        assert abs(words[s] - target) <= mixing.BLOCK
    assert sum(r.doc_id is None for r in got) > 20


def test_mixing_by_id_refuses_ids_that_tell_no_rows_apart(spark):
    for ids in ([1, None], [1, 1]):
        docs = spark.createDataFrame([(i, "a b c", "en", "s", 5) for i in ids], SCHEMA)
        with pytest.raises(ValueError, match="row key"):
            mixing.mixed_texts(docs, mixing.mix(docs))


def left(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_stage_keeps_one_row_a_group(spark):
    ids = [(5, "A"), (9, "A"), (5, "B"), (None, "A"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (None, "E"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ids], SCHEMA).repartition(3)
    got = left(corpus_pipeline.exact_stage(spark, docs, ""))
    blank = [k for k in got if not k[1]]
    assert len(blank) == 1 and got.pop(blank[0]) == 1
    assert got == {(9, "A"): 1, (5, "B"): 1, (None, "C"): 1, (7, "D"): 1, (None, "E"): 1}


def test_near_stage_keeps_one_row_a_class(spark):
    rng = random.Random(5)
    base = [" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(300)) for k in "abcdef"]
    a, b, c, d, e, f = base
    rows = [(3, a), (4, a + " more"), (4, b), (None, a + " other"), (None, c), (None, c + " x"), (None, c), (6, d), (6, d + " x"), (None, e), (4, f), (4, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = left(corpus_pipeline.near_stage(spark, docs, ""))
    assert collections.Counter((i, t[0]) for i, t in got.elements()) == {(3, "a"): 1, (4, "b"): 1, (None, "c"): 1, (6, "d"): 1, (None, "e"): 1, (4, "f"): 1}
    assert got[3, a] == 1
