"""Quality rules as a short-circuit cascade, in native DataFrame expressions only.

Each rule is a predicate over statistics of the text. Statistics are layers: a column is computed for a row only while
no rule has rejected it, and a layer that no remaining rule needs is never computed for it. The order comes from a
sample: of the rules left, the next is the one that rejects most of the sample's rows still alive for each unit of
work, where work is what the layers it needs and no earlier rule has paid for do to those rows, in nanoseconds by
the fixed prices of ``Layer.price``. Neither a clock nor the cluster's load has a say, so the order, and with it
``rejected_by``, is the same at every run. The order changes the time only: a document is kept when no rule rejects
it, in any order.

``complete`` asks for the base statistics of every document, rejected or not, which is what a report needs; without
it (the pipeline's filter) the cascade pays for what it has to know and no more.

Defined edge cases: a null or empty text has no words and fails ``too_short``; an empty table gives an
empty result; columns of the input that clash with the computed names are carried in a struct of their own
(``carry``) or not read; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import SPACE, SPACE_CLASS

_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Layer:
    """A column, the columns it is made of, and its price in nanoseconds for each byte of the text."""

    value: Callable[[], Column]
    needs: tuple[str, ...]
    price: float


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("long")


def _words() -> Column:
    trimmed = F.btrim(F.col("text"), F.lit(_BLANKS))
    return F.when(F.octet_length(trimmed) > 0, F.split(trimmed, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))


def _windows() -> Column:
    at = lambda i: F.get("hashes", i)
    three = F.transform(F.sequence(F.lit(0), F.size("hashes") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    return F.when(F.size("hashes") >= 3, three).otherwise(F.array().cast("array<bigint>"))


def _ranked() -> Column:
    """Windows with their places, equal ones together; null where all are different, as in most texts."""
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size("windows") > F.size(F.array_distinct("windows")), ranked)


def _repeated() -> Column:
    """Places of the windows found twice or more, in order."""
    like = lambda p, k: F.coalesce(p["h"] == F.get("ranked", k)["h"], F.lit(False))
    again = F.filter("ranked", lambda p, k: like(p, k - 1) | like(p, k + 1))
    return F.when(F.col("ranked").isNotNull(), F.sort_array(F.transform(again, lambda p: p["i"])))


def _covered() -> Column:
    """Words in repeated windows: three for each, less what it shares with the one before."""
    steps = F.transform("repeated", lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get("repeated", k - 1), F.lit(3))))
    return F.when(F.col("repeated").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))


LAYERS: dict[str, Layer] = {
    "words": Layer(_words, (), 45.0),
    "n_words": Layer(lambda: F.size("words").cast("long"), ("words",), 0.0),
    "word_chars": Layer(lambda: F.char_length(F.array_join("words", "")).cast("long"), ("words",), 10.0),
    "n_symbols": Layer(lambda: _count(SYMBOLS), (), 17.0),
    "exclamations": Layer(lambda: _count("!"), (), 16.0),
    "capital_pairs": Layer(lambda: _count(r"\p{Lu}\p{Lu}"), (), 18.0),
    "letter_words": Layer(lambda: _count(rf"[^{SPACE_CLASS}]*\p{{L}}[^{SPACE_CLASS}]*"), (), 48.0),
    "lines": Layer(lambda: F.filter(F.split("text", "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(_BLANKS))) > 0), (), 12.0),
    "n_lines": Layer(lambda: F.size("lines").cast("long"), ("lines",), 0.0),
    "n_dup_lines": Layer(lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), ("lines",), 4.0),
    "hashes": Layer(lambda: F.transform("words", lambda w: F.xxhash64(w)), ("words",), 12.0),
    "windows": Layer(_windows, ("hashes",), 35.0),
    "ranked": Layer(_ranked, ("windows",), 35.0),
    "repeated": Layer(_repeated, ("ranked",), 15.0),
    "n_repeat_words": Layer(_covered, ("repeated",), 5.0),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a Column over the layers in ``needs``; it must not be null."""

    name: str
    rejects: Column
    needs: tuple[str, ...]


def default_rules() -> list[Rule]:
    """Production rules. Limits are ratios, so they hold at every text length."""
    n = F.col("n_words")
    return [
        Rule("too_short", n < 50, ("n_words",)),
        Rule("repeats", F.col("n_repeat_words") * 100 > n * 50, ("n_words", "n_repeat_words")),
        Rule("symbols", F.col("n_symbols") * 10 > n, ("n_words", "n_symbols")),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.col("n_lines"), ("n_lines", "n_dup_lines")),
        Rule("word_length", (F.col("word_chars") < n * 3) | (F.col("word_chars") > n * 12), ("n_words", "word_chars")),
        Rule("exclamations", F.col("exclamations") * 5 > n, ("n_words", "exclamations")),
        Rule("shouting", F.col("capital_pairs") * 2 > n, ("n_words", "capital_pairs")),
        Rule("no_letters", F.col("letter_words") * 10 < n * 8, ("n_words", "letter_words")),
    ]


def _missing(needs: tuple[str, ...], laid: set[str]) -> list[str]:
    """Layers that are needed and not there yet, each after what it is made of."""
    out: list[str] = []
    for name in needs:
        for x in (*_missing(LAYERS[name].needs, laid | set(out)), name):
            if x not in laid and x not in out:
                out.append(x)
    return out


def _lay(df: DataFrame, needs: tuple[str, ...], laid: set[str], alive: Column | None = None) -> DataFrame:
    """Adds the missing layers; null for rows that are not alive, whose values are then not computed."""
    for name in _missing(needs, laid):
        value = LAYERS[name].value()
        df = df.withColumn(name, value if alive is None else F.when(alive, value))
        laid.add(name)
    return df


def _texts(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*(carry or (doc_id,))).alias("carried"))


def base_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id and the BASE statistics. Everything stays inside the row, so nothing is shuffled."""
    return _lay(_texts(docs, doc_id, text, ()), BASE, set()).select("doc_id", *BASE)


def order_rules(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text", sample_rows: int = 1000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """The rules in the order they run in, as (rule, share of the rows alive that it rejects, nanoseconds a row alive).

    At most ``sample_rows`` rows are looked at, one in ten of the first partitions with so many, or all rows of a small
    table; from each only its length and the rules' verdicts come to the driver. They decide the order alone, never a
    verdict.
    """
    texts = _texts(docs, doc_id, text, ())

    def look(rows: DataFrame) -> list:
        seen = _lay(rows, tuple(x for r in rules for x in r.needs), set())
        return seen.select(F.octet_length("text").alias("bytes"), *(r.rejects.alias(r.name) for r in rules)).take(sample_rows)

    alive = look(texts.sample(0.1, seed=seed))
    if len(alive) < sample_rows // 4:
        alive = look(texts)
    left, laid, out = list(rules), set(), []
    while left:
        mean = sum(r["bytes"] for r in alive) / max(len(alive), 1)
        found = []
        for rule in left:
            hits = sum(r[rule.name] for r in alive) / max(len(alive), 1)
            cost = mean * sum(LAYERS[x].price for x in _missing(rule.needs, laid)) + 1.0  # a nanosecond for the comparison
            found.append((-(hits + 1e-6) / cost, rule.name, rule, hits, cost))
        _, _, rule, hits, cost = min(found, key=lambda x: x[:2])
        out.append((rule, hits, cost))
        left.remove(rule)
        laid.update(_missing(rule.needs, laid))
        alive = [r for r in alive if not r[rule.name]]
    return out


def cascade(texts: DataFrame, rules: list[Rule], laid: set[str] | None = None) -> DataFrame:
    """Adds ``rejected_by``: the first rule in the given order that rejects, else null. ``laid``: layers that are there already."""
    laid = set() if laid is None else set(laid)
    df = texts.withColumn("rejected_by", F.lit(None).cast("string"))
    alive = F.col("rejected_by").isNull()
    for rule in rules:
        df = _lay(df, rule.needs, laid, alive)
        df = df.withColumn("rejected_by", F.when(alive, F.when(rule.rejects, F.lit(rule.name))).otherwise(F.col("rejected_by")))
    # The partition number is never negative. An expression that is not deterministic keeps later filters above
    # this projection; below it they would be rewritten into many copies of the layers' expressions.
    return df.withColumn("rejected_by", F.when(F.spark_partition_id() >= 0, F.col("rejected_by")))


def quality_filter(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000, carry: tuple[str, ...] = (), complete: bool = True
) -> DataFrame:
    """One row a document: doc_id, the BASE statistics and base_failed if ``complete``, rejected_by, kept, and carried if ``carry``."""
    rules = default_rules() if rules is None else rules
    ordered = [x[0] for x in order_rules(docs, rules, doc_id, text, sample_rows)]
    texts, laid = _texts(docs, doc_id, text, carry), set()
    if complete:
        texts = _lay(texts, BASE, laid)
    out = cascade(texts, ordered, laid)
    passed = F.col("rejected_by").isNull()
    if complete:
        failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
        out, passed = out.withColumn("base_failed", failed), passed & ~F.col("base_failed")
    kept = out.withColumn("kept", passed)
    return kept.select("doc_id", *(("carried",) if carry else ()), *((*BASE, "base_failed") if complete else ()), "rejected_by", "kept")
