"""The corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _shared, byte_bpe, exact_dedup, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sharding, url_filter
from gridloom.llm._hashing import text_buffers, word_hashes
from gridloom.llm._shared import keyed
from gridloom.llm.queries import bpe_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = prose(rng, 300)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    texts += [base] * 7
    for k in range(12):  # near copies, further and further away
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += ["", "", None, None, " \n\t ", "one", "one two", "A B C " * 40, "x " * 30_000 + "end", "ÀÉ ñ ß\u00a0z\u3000y \x1cq", "a\nb\na\n\na", "#$ | ok <b>", "!!!", "very" * 5_000]
    out = [(i, t, (None, "en", "fr", "de")[i % 4], (None, "", "s1", "s2", "s1")[i % 5], None) for i, t in enumerate(texts)]
    out.append((0, texts[0], "en", "s1", None))  # a repeated row, but for its source
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ("words", "sha", "kept", "part", "size", "src", "row", "node", "n", "label", "block", "ids", "x", "role", "carried")
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"extra {c}") for c in clash}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# quality rules


def test_rules_against_brute_force(docs, rows):
    got = by_id(quality_rules.quality_filter(docs))
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if triples[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed) and r.kept == (r.rejected_by is None and not r.base_failed)


def test_rule_order_changes_nothing(docs):
    rules = quality_rules.default_rules()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    verdicts = [{(r.doc_id, r.rejected_by is None) for r in quality_rules.cascade(texts, order).select("doc_id", "rejected_by").collect()} for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]
    brief = {(r.doc_id, r.kept) for r in quality_rules.quality_filter(docs, complete=False).collect()}
    assert brief == verdicts[0] == {(r.doc_id, r.kept) for r in quality_rules.quality_filter(docs).collect()}
    ordered = quality_rules.order_rules(docs, rules)
    assert {x[0].name for x in ordered} == {r.name for r in rules}
    assert all(0 <= s <= 1 and c > 0 for _, s, c in ordered)
    assert [x[0].name for x in quality_rules.order_rules(docs, rules)] == [x[0].name for x in ordered]


def test_rejected_rows_pay_for_nothing(spark):
    """A layer that raises an error is never reached for rows that an earlier rule rejects."""
    docs = spark.createDataFrame([(1, "a"), (2, "b " * 60)], "doc_id long, text string")
    trap = quality_rules.Layer(lambda: F.when(F.length("text") < 9, F.raise_error(F.lit("paid"))).otherwise(F.lit(0)).cast("long"), (), 1e6)
    quality_rules.LAYERS["trap"] = trap
    try:
        short = next(r for r in quality_rules.default_rules() if r.name == "too_short")
        rules = [short, quality_rules.Rule("trap", F.col("trap") > 0, ("trap",))]
        texts = docs.select("doc_id", "text")
        got = {r.doc_id: r.rejected_by for r in quality_rules.cascade(texts, rules).select("doc_id", "rejected_by").collect()}
        assert got == {1: "too_short", 2: None}
        with pytest.raises(Exception, match="paid"):
            quality_rules.cascade(texts, rules[::-1]).select("rejected_by").collect()
    finally:
        del quality_rules.LAYERS["trap"]


def test_rules_on_nothing(empty):
    assert quality_rules.quality_filter(empty).count() == 0


# exact dedup


def test_exact_against_brute_force(docs, rows):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        g = groups[text_of[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()


def test_exact_edges(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, 1, True), (4, 2, False), (4, 2, True)]


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    f = byte_free = exact_dedup.CuckooFilter(2048)
    assert all(f.insert(k) for k in keys) and all(k in f for k in keys)
    assert sum(rng.getrandbits(64) in f for _ in range(20_000)) < 60
    assert all(f.delete(k) for k in keys[:1500]) and all(k in f for k in keys[1500:]) and byte_free.size == 1500


def test_digest_index_grows_and_forgets():
    index = exact_dedup.DigestIndex(buckets=2)
    keys = [(hashlib.sha256(bytes([i % 256, i // 256])).digest(), i) for i in range(2000)]
    for k in keys:
        assert index.get(k) is None
        index.put(k, k[1])
    assert index.resizes > 0 and len(index) == 2000 and all(index.get(k) == k[1] for k in keys)
    assert index.get((keys[0][0], -1)) is None  # same digest, other content
    assert index.delete(keys[5]) and not index.delete(keys[5]) and index.get(keys[5]) is None and len(index) == 1999


# near dedup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def grams(text):
    words, _ = word_hashes(*text_buffers(pa.array([text])))
    return near_dedup.label_occurrences(near_dedup.shingles(words))


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 12, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert near_dedup.common_length(a, b, 100) == lcs(a.tolist(), b.tolist())
        a = near_dedup.label_occurrences(rng.integers(0, 99, 40).astype(np.uint64))
        b = np.delete(a, rng.integers(0, len(a), 3))
        both = len(a) + len(b)
        assert near_dedup.alike(a, b) == (9 * lcs(a.tolist(), b.tolist()) >= 4 * both)


def test_near_against_brute_force(docs, rows):
    text_of = {r[0]: r[1] or "" for r in rows}
    texts = sorted(set(text_of.values()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    h = [grams(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.alike(h[i], h[j]):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i, t in text_of.items():
        members[find(texts.index(t))].append(i)
    counts = collections.Counter(r[0] for r in rows)
    want = {i: (min(g), sum(counts[k] for k in g)) for g in members.values() for i in g}
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == want
    assert max(r.class_size for r in got) >= 10
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_work_on_one_family_grows_in_line(spark, monkeypatch):
    """Texts with one to three changed words: most are like some others, many like none. Rows of the last round are counted."""
    counts = []
    last = near_dedup.last_round

    def counted(rest, texts, single):
        lone = F.when(F.col("label") != F.col("main"), F.ceil(F.col("size") / near_dedup.BLOCK)).otherwise(0)
        counts.append(rest.agg(F.coalesce(F.sum(F.ceil((F.col("others") + 1) / (near_dedup.BLOCK // 2)) + lone), F.lit(0))).first()[0])
        return last(rest, texts, single)

    monkeypatch.setattr(near_dedup, "last_round", counted)
    for n in (700, 2100):
        rng = random.Random(1)
        base, rows = [f"w{rng.randrange(3000)}" for _ in range(80)], []
        for i in range(n):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(80)] = f"w{rng.randrange(3000)}"
            rows.append((i, " ".join(words)))
        got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.count() == n
        assert counts[-1] <= 24 * n  # no more rows than the texts have sketches


def test_chains_across_one_bucket_are_found(spark):
    """Copies of copies: neighbours are alike, far ones are not, and all of them are one class."""
    rng = random.Random(9)
    words = prose(rng, 240, 5000).split()
    chain = []
    for k in range(30):
        words = list(words)
        for j in range(3):
            words[(k * 7 + j * 80) % 240] = f"c{k}-{j}"
        chain.append((k, " ".join(words)))
    assert not near_dedup.alike(grams(chain[0][1]), grams(chain[-1][1]))
    got = near_dedup.near_dedup(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {30}


def test_near_on_nothing(spark, empty):
    assert near_dedup.near_dedup(empty).count() == 0
    got = near_dedup.near_dedup(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.class_id), r.class_size) for r in got) == [("3", 1), ("None", 2), ("None", 2)]


# sharding


def test_sharding(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text_of = {r[0]: (r[1] or "").encode() for r in rows}
    places, load = collections.defaultdict(list), collections.Counter()
    slot_load = collections.Counter()
    for r in got:
        assert (r.size, r.text_crc32) == (len(text_of[r.doc_id]) + 1, zlib.crc32(text_of[r.doc_id]))
        assert r.vslot == int(hashlib.md5(f"{r.doc_id}:{r.text_crc32}".encode()).hexdigest()[:3], 16)
        places[r["shard"]].append(r.slot)
        load[r["shard"]] += r.size
        slot_load[r["shard"], r.vslot] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    full, least = max(load, key=load.get), min(load, key=load.get)
    assert all(n >= load[full] - load[least] for (s, _), n in slot_load.items() if s == full)


def test_map_versions(spark, empty):
    rng = random.Random(2)
    load = [rng.randrange(1000) for _ in range(sharding.SLOTS)]
    maps = sharding.SlotMaps(spark, 16)
    maps.rebalance(load)
    again = sharding.rebalance(maps.versions[-1], load, 16)
    assert again == maps.versions[-1]  # nothing moves without need
    grown = sharding.rebalance(maps.versions[-1], load, 17)
    moved = sum(a != b for a, b in zip(maps.versions[-1], grown, strict=True))
    assert set(grown) == set(range(17)) and moved < sharding.SLOTS / 8
    assert maps.version == 2 and maps.tables[0].count() == sharding.SLOTS
    assert sharding.shard(empty).count() == 0
    again = sharding.SlotMaps.reopen(spark, maps.path)
    assert (again.version, again.versions, again.shards) == (2, maps.versions, 16)
    again.rebalance(load, 17)
    assert again.version == 3 and again.versions[-1] == grown
    with pytest.raises(Exception, match="exist"):  # the other one does not know of version 3
        maps.rebalance(load)


def test_balancing_goes_on_until_no_move_helps():
    """Far more moves than slots were once allowed for: one shard starts with everything."""
    rng = random.Random(5)
    load = [rng.randrange(1, 1000) for _ in range(sharding.SLOTS)]
    out = sharding.rebalance([0] * sharding.SLOTS, load, 16)
    total = collections.Counter()
    for s, k in enumerate(out):
        total[k] += load[s]
    gap = max(total.values()) - min(total.values())
    full = max(total, key=total.get)
    assert len(total) == 16 and all(load[s] >= gap for s, k in enumerate(out) if k == full)


def test_slots_of_one_repeated_row_are_gapless(spark):
    got = sharding.shard(spark.createDataFrame([(7, "same")] * 500 + [(None, None)] * 50, "doc_id long, text string").repartition(6), 4).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r["shard"]].append(r.slot)
    assert len(got) == 550 and all(sorted(p) == list(range(len(p))) for p in places.values())


# byte-level BPE


def test_bpe_against_tiktoken(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe_vocabulary()
    ranks = byte_bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text_of = {r[0]: r[1] or "" for r in rows}
    encoded = byte_bpe.encode(docs, path, pattern)
    for r in encoded.collect():
        assert list(r.ids) == other.encode_ordinary(text_of[r.doc_id])
    for r in byte_bpe.decode(encoded, path, pattern).collect():
        assert bytes(r.bytes) == text_of[r.doc_id].encode()
    for r in byte_bpe.round_trip(docs, path, pattern).collect():
        assert r.lossless and r.n_tokens == len(other.encode_ordinary(text_of[r.doc_id]))
    bpe = byte_bpe.tokenizer(path, pattern)
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t'  sтé1a.bst\u3000\x1c\xa0!-\U0001f600") for _ in range(rng.randrange(25)))
        assert bpe.encode(text) == other.encode_ordinary(text)


def test_small_memos_change_no_ids_and_stay_bounded():
    path, pattern = bpe_vocabulary()
    ranks = byte_bpe.load_ranks(path)
    plain, small = byte_bpe.ByteBPE(ranks, pattern), byte_bpe.ByteBPE(ranks, pattern, memo=4)
    rng = random.Random(5)
    words = ["".join(rng.choice("abté,'") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["x" * 100]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(20))
        assert small.encode(text) == plain.encode(text)
        assert small.decode(small.encode(text)) == text.encode()
        for memo, limit in ((small.words, 4), (small.memo, 2)):
            assert len(memo) <= limit and len(memo.older) <= limit
            assert all(len(piece) <= byte_bpe.MEMO_CHARS for piece in (*memo, *memo.older))


def test_minimal_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = byte_bpe.MinimalPerfectHash(keys, range(5000))
    assert all(h.get(k) == i for i, k in enumerate(keys)) and sorted(h.values) == list(range(5000))
    assert all(h.get(b"x" + k) is None for k in keys) and byte_bpe.MinimalPerfectHash([], []).get(b"") is None


# mixing


def test_mixing(docs, rows, empty):
    docs = keyed(docs, "key", "mixing-test")
    mixed = mixing.mix(docs, block=8, row="key").persist()
    got = mixed.collect()
    assert len(got) == len(rows)
    assert sorted(map(str, mixing.mix(docs, block=8, row="key").collect())) == sorted(map(str, got))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.source_size, r.target)
    names = sorted(k for k in size if k is not None) + [None]
    want = mixing.fill_targets([size[k] for k in names], [1, 2, 3, 1][: len(names)])
    for name, t in zip(names, want, strict=True):
        assert target[name] == (size[name], pytest.approx(t)) and abs(taken[name] - t) <= 8
    assert sum(want) == pytest.approx(sum(size.values()))
    text_of = {r[0]: r[1] or "" for r in rows}
    cut = by_id(mixing.mixed_texts(docs, mixed, 8, row="key"))
    every = by_id(mixed)
    for i, own in every.items():  # two rows have the id 0
        parts = [WORD.findall(x.text) for x in cut[i]]
        assert sum(map(len, parts)) == sum(r.taken for r in own)
        words = collections.Counter(WORD.findall(text_of[i]))
        assert all(not collections.Counter(p) - words for p in parts)
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_their_limit():
    assert mixing.fill_targets([10, 1000, 0], [100.0, 1.0, 5.0]) == [30.0, 980.0, 0.0]
    assert mixing.fill_targets([], []) == []
    n = np.array([1, 2, 3, 64, 65, 1000])
    for k in n:
        at = mixing.permute(np.arange(k), np.full(k, k), np.full(k, 77))
        assert sorted(at.tolist()) == list(range(k))
    for quotas in ([5, 0, 700, 33], [3 * 10**9, 7, 10**11 + 1], [0, 0], [1]):
        counts = mixing.draw_counts(quotas, 8, 1)
        assert counts.sum(axis=0).tolist() == quotas and (counts >= 0).all()
    assert mixing.apportion(2, [0, 3, 3]) == [0, 1, 1] and mixing.apportion(3, [0, 3, 3]) == [0, 2, 1]
    assert sum(mixing.apportion(5, [0, 0, 10**9, 10**9])) == 5 and mixing.apportion(4, [1, 3]) == [1, 3] and mixing.apportion(0, [0]) == [0]


def test_slots_of_a_large_mix_spread_over_tasks(spark, docs):
    laid = mixing.layout(docs)
    sources = mixing.plan(laid, block=1)
    slots = mixing.draw_slots(laid, sources, shards=4)
    counts = [len(p) for p in slots.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list("p")).toPandas()["collect_list(p)"]]
    assert sum(counts) == sources["quota"].sum() and len(counts) > 1


# URL filter


def test_long_hosts_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "é" * 50 if i else None) for i in range(20)], "i long, host string")
    hinted = lambda df: "strategy=broadcast" in rows.join(df, "i")._jdf.queryExecution().toString()
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 1900)
    assert hinted(_shared.few(rows, "host"))
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 1899)
    assert not hinted(_shared.few(rows, "host")) and hinted(_shared.few(rows)) and hinted(_shared.few(rows.limit(0), "host"))


def test_urls(spark):
    pages = [(i, f"https://Spam.Bad.com/p{i}?q=/x#y") for i in range(40)] + [(100 + i, f"http://good.org/p{i}") for i in range(40)]
    pages += [(200, None), (201, "no scheme"), (202, "x://"), (203, "HTTP://A.example.ORG/es/1"), (204, "a://b.com#/fr/"), (205, "a://éÉ.com/fr/?")]
    labels = [(i, 0, 1) for i in range(30)] + [(100 + i, 1, 0) for i in range(30)] + [(5, None, None), (0, 1, 0)]
    rules = (url_filter.UrlRule("allow", "org", "/"), url_filter.UrlRule("block", "example.org", "/es/"), url_filter.UrlRule("allow", "com", "/fr/"))
    frame, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(frame, marks, rules).collect()}
    assert len(got) == len(pages)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("spam.bad.com", "/p0", None, "block") and got[39].verdict == "block"
    assert (got[100].rule, got[100].verdict) == ("org/", "allow")
    assert (got[203].host, got[203].rule, got[203].verdict) == ("a.example.org", "example.org/es/", "block")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (200, 201, 202))
    assert (got[204].path, got[204].rule) == ("", None) and (got[205].host, got[205].rule) == ("éÉ.com", "com/fr/")
    rates = {r.host: r for r in url_filter.reputation(frame.select("page_id", F.lit("h").alias("host")), marks).collect()}
    assert rates["h"].bound < rates["h"].rate < 1
    clash = frame.withColumns({c: F.lit("extra") for c in ("host", "path", "rule", "n", "k", "rate", "bound", "domain")})
    again = url_filter.judge(clash, marks.withColumns({c: F.lit("extra") for c in ("bad", "page_id", "host")}), rules).collect()
    assert {r.page_id: tuple(r) for r in again} == {i: tuple(r) for i, r in got.items()}
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.com",), ("com",), ("",)], "host string")
    parts = {r[0]: (r[1], r[2]) for r in hosts.select("host", *url_filter.domain_and_suffix(F.col("host"))).collect()}
    assert parts == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", "")}
    none = url_filter.judge(frame, marks.limit(0), rules)
    assert {r.verdict for r in none.collect() if r.rule is None} == {"allow"}
    assert url_filter.judge(frame.limit(0), marks, rules).count() == 0


# language ID


def test_every_part_of_a_text_is_learned_from(spark):
    rng = random.Random(8)
    tails = ["tail" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(40)]
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) + " " + " ".join(tails)
    rows = [(i, long if i == 3 else f"kurz {i}", "de") for i in range(6)] + [(9, "same text", "en")] * 300
    content = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sum(f" {t} ".encode() in content["de"] for t in tails) >= 39  # a piece may end within a word
    assert content["en"] == b" same text "  # a repeated row counts once


def test_close_languages_are_rejected_and_ties_go_to_the_first(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(50))) for i in range(20)]
    same = " alpha beta gamma delta epsilon".encode() * 40
    df = spark.createDataFrame(texts + texts[:3], "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "lang": F.lit(None)})
    got = language_id.identify(df, {"zz": same, "aa": same, "mm": " etwas ganz anderes".encode() * 40}).collect()
    assert len(got) == 23 and {(r.lang_pred, r.margin, r.rejected) for r in got} == {("aa", 0.0, True)}
    clear = language_id.identify(df, {"aa": same, "mm": " etwas ganz anderes".encode() * 40}).collect()
    assert {(r.lang_pred, r.rejected) for r in clear} == {("aa", False)} and all(r.margin > 0.01 for r in clear)


@pytest.mark.parametrize("n", [1, 3, 4095, 4096, 4097, 10_000])
def test_a_ring_holds_every_byte(n):
    body = bytes(i % 251 for i in range(n))
    blocks = language_id.ring(body)
    assert all(len(x) == language_id.RING for x in blocks) and b"".join(blocks)[:n] == body and len(blocks) == -(-n // language_id.RING)


def test_long_words_of_repeating_structure_differ():
    for n in (64, 1024, 2048, 4096):  # Thue-Morse strings, which a sum of powers modulo 2**64 confuses
        a = "".join("ab"[i.bit_count() % 2] for i in range(n))
        pair = [a, a.translate(str.maketrans("ab", "ba")), a.upper()]
        exact, _ = word_hashes(*text_buffers(pa.array(pair)))
        lower, _ = word_hashes(*text_buffers(pa.array(pair)), lower=True)
        assert len(set(exact.tolist())) == 3 and lower[0] == lower[2] != lower[1]


def test_languages(spark, empty):
    rng = random.Random(8)
    words = {"en": "the of and ing tion that with house water".split(), "fr": "le la des été où eau très maison".split(), "de": "der die und nicht straße über haus".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(3, 60))), k) for i, k in enumerate(["en", "fr", "de"] * 60)]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "123 !?", None), (903, "straße " * 20_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    content = language_id.train(df, F.col("doc_id") % 3 != 5)
    assert sorted(content) == ["de", "en", "fr"] and all(len(c) < 300_000 for c in content.values())
    got = {r.doc_id: r for r in language_id.identify(df, content).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 175
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.train(empty, F.lit(True)) == {} and language_id.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}


# language-model scoring


@pytest.mark.parametrize("block", [500, 10**6])
def test_scores_against_brute_force(docs, rows, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", block)
    learn = lambda i: i % 7 != 2
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text_of = {r[0]: [*WORD.findall((r[1] or "").translate(lower)), None] for r in rows}
    c = collections.Counter(w for r in rows if learn(r[0]) for w in text_of[r[0]])
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(docs, F.col("doc_id") % 7 != 2).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        words = text_of[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_model_is_a_distribution():
    cells = np.array([[3, 5, 9, 100], [3, 0, 12, 50], [4, 0, 0, 7]])
    weights = lm_scoring.learn_weights(cells, 1e-4)
    assert set(weights) == {3, 4} and all(sum(w) == pytest.approx(1) and min(w) > 0 for w in weights.values())
    assert weights[4][2] > 0.9  # nothing seen before: all on the uniform part
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (lm_scoring._unpack_sorted(lm_scoring._pack_sorted(x)) == x).all()
    for top in (3, 300, 70_000):
        assert (lm_scoring._unpack(lm_scoring._pack(np.arange(top))) == np.arange(top)).all()


def test_scores_without_training(docs, empty):
    got = lm_scoring.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9 for r in got)
    assert lm_scoring.score(empty, F.lit(True)).count() == 0


# quality classifier


def test_classifier(spark, docs, rows, empty):
    rng = random.Random(6)
    texts = [(i, prose(rng, 80) if i % 3 else " | ".join(prose(rng, 1) for _ in range(60)), int(i % 3 > 0)) for i in range(240)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    stats = quality_classifier.document_statistics(df)
    model = quality_classifier.fit(stats, df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in quality_classifier.classify(stats, model).collect()}
    held = [(i, q) for i, _, q in texts if i % 4 == 2]
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.95
    awkward = quality_classifier.classify(quality_classifier.document_statistics(docs), model).collect()
    assert len(awkward) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in awkward)
    bare = quality_classifier.fit(stats, df, F.lit(False))
    assert {r.score for r in quality_classifier.classify(stats, bare).collect()} == {0.5}
    assert quality_classifier.document_statistics(empty).count() == 0


def test_discriminant_against_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + c for c in (0.0, 1.5)]
    model = quality_classifier.Discriminant(np.array([400.0, 400.0]), np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]))
    cov = [f @ f.T for f in model.factors]
    z = rng.normal(size=(5, 3))
    for p, s in zip(z, model.score(z), strict=True):
        d = [-0.5 * ((p - model.means[c]) @ np.linalg.inv(cov[c]) @ (p - model.means[c]) + np.log(np.linalg.det(cov[c]))) for c in (0, 1)]
        assert s == pytest.approx(1 / (1 + math.exp(-(d[1] - d[0]) / quality_classifier.TEMPERATURE)), rel=1e-6)
