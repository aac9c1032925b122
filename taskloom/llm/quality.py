"""Quality rules as a bitmask ledger (operator 8), native expressions only.

`ledger` evaluates every rule once a document and keeps the measurements and one long of failure bits (bit k: rule
k failed).  A policy is a versioned mask over those bits: `apply_policy` is one bitwise AND, so changing a policy
never reads a text again.  `ablation` counts documents by failure bits (at most 2**rules groups, summed on the map
side) and derives each policy's and each rule's effect from that table by bitwise operations.

The repeated-word count finds 5-word windows that occur twice within one document by sorting (hash, position) pairs
inside the row, so nothing is exploded or shuffled; documents whose windows are all distinct skip the sort.

Rows: a null text has no words, no lines and fails `few_words`; null ids are kept as they are; repeated rows each
get a row; an empty table gives no row; extra columns are left out of the ledger, and only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.sources.tables import bounded

from .common import WORD, let, stored

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"

#: Rule k sets bit k if its condition on the measurements holds.  The first two are the base; the others are the method's.
RULES = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] > 25 * m["n_words"]) | (2 * m["word_chars"] < 3 * m["n_words"])),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
)
BASE_BITS = 0b11
#: version -> mask of the rules that reject.
POLICIES: dict[str, int] = {"base": BASE_BITS, "v1": 0b11111, "no_symbols": 0b10111}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of that many words whose sequence occurs twice or more, the first one included."""
    last = F.size(words) - (window - 1)
    grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
        step = lambda a, p: F.struct((a["n"] + p + window - F.greatest(a["upto"], p)).alias("n"), (p + window).alias("upto"))
        return F.aggregate(starts, state, step, lambda a: a["n"])

    def starts(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["g"] == x["g"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    pairs = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("g"), i.cast("long").alias("i"))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(pairs(g), lambda p: covered(starts(p)))))


def measurements(text: Column) -> Column:
    """struct of MEASURES, each as long."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    parts = F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("s"))
    return let(parts, lambda p: F.struct(*(x.cast("long").alias(n) for n, x in zip(MEASURES, (p["w"]["n"], p["w"]["chars"], p["s"], p["l"]["n"], p["l"]["again"], p["w"]["repeats"])))))


def ledger(docs: DataFrame, rules=RULES, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, MEASURES, fail_bits; with carry also _row, the whole input row.

    All of it is one expression, so that a filter on its bits, which Spark moves below the projection, computes it once."""

    def entry(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for k, (_, failed) in enumerate(rules):
            bits = bits.bitwiseOR(F.when(failed(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*(m[n].alias(n) for n in MEASURES), bits.alias("fail_bits"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), let(measurements(text), entry).alias("_entry"), *own)
    return rows.select("doc_id", "_entry.*", *(["_row"] if carry else []))


def apply_policy(rows: DataFrame, mask: int) -> DataFrame:
    """Adds kept: no rule of the mask failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(rows: DataFrame, policies: dict[str, int] = POLICIES, rules=RULES) -> DataFrame:
    """A row a policy and rule of it: documents, rejected by the policy, failed by the rule, failed by the rule
    alone (kept if it were left out)."""
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for v, m in policies.items() for k, (name, _) in enumerate(rules) if m >> k & 1]
    # a row for each pattern of bits, not for each document
    table = counts.select("fail_bits", "n", F.explode(F.array(*pairs)).alias("p")).select("fail_bits", "n", "p.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))
    return table.groupBy("policy", "rule", "bit").agg(F.sum("n").alias("n_docs"), total(hit != 0).alias("n_rejected"), total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(hit == F.col("bit")).alias("n_only"))


def judged(entries: DataFrame, version: str, policies: dict[str, int] = POLICIES) -> DataFrame:
    """A stored ledger under all policies: kept (by `version`), kept_<other version>, and n_alike: of a document that one rule alone
    rejects, how many that rule alone rejects (from the ablation); the ledger is all that is read."""
    rows = apply_policy(entries, policies[version])
    others = {f"kept_{v}": F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == 0 for v, m in policies.items() if v != version}
    alone = stored(ablation(entries, policies).where(F.col("policy") == version).select(F.col("bit").alias("_bit"), F.col("n_only").alias("n_alike")), "ablation")
    hit = F.col("fail_bits").bitwiseAND(F.lit(policies[version]).cast("long"))
    return rows.withColumns(others).join(bounded(alone), hit == F.col("_bit"), "left").drop("_bit")
