"""Secret scan behind a trigram inverted index (operator 2), native expressions only on the data path.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived (on the driver, from the
parsed pattern): a text that matches the rule satisfies the query.  `build_index` writes postings for the trigrams
that the queries name: per trigram and block of 64 consecutive ids one long of bits.  `candidates` intersects and unites those
bit blocks as the queries say; only candidate documents are verified with the regular expression, and a rule whose
query is empty (no mandatory trigram, like the hex rule) is verified on every document.

A match's position is the sum of the lengths of what split() leaves before it and the earlier matches, so no
Python runs; finding positions takes time in the square of one document's number of matches, with a small factor.

Rows: a null text is empty; a null id has no posting, so all rules are verified on it; rows that repeat an id share
their posting bits, which can only add candidates; repeated rows each get a row; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """kind, pattern (in the subset that Java, RE2 and Python read alike), the group whose length is judged, its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
RULES: tuple[Rule, ...] = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # as [0-9a-f]+ with a least length: a run is taken whole
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)
BASE_KINDS = 3
MOST_STRINGS = 64

Query = "bool | str | tuple"  # True: any text; a trigram; ("and" | "or", parts)


def _join(kind: str, parts: list) -> object:
    """The conjunction or disjunction of queries, simplified."""
    neutral = kind == "and"
    if kind == "or" and True in parts:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not neutral))
    if kind == "or":  # A or (A and B) is A
        sets = {p: trigrams_of(p) for p in parts if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1])}
        parts = [p for p in parts if not (p in sets and any(s < sets[p] for s in sets.values()))]
    return (kind, tuple(parts)) if len(parts) > 1 else parts[0] if parts else neutral


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else True for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings that the items can match, lower-cased, or None if too many; what any match satisfies)."""
    exact: set[str] | None = {""}
    whole, held, found = True, {""}, []
    for op, arg in items:
        name, strings, query = str(op), None, True
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            chars = {chr(a).lower() for o, a in arg if str(o) == "LITERAL"}
            if len(chars) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
                strings = chars
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = True if strings else _join("or", [_of_strings(s) if s is not None else q for s, q in parts])
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            strings, query = _walk(arg[2])
            query = _of_strings(strings) if strings is not None else query
            if arg[:2] != (1, 1):
                strings = None
        elif name == "MAX_REPEAT" and arg[1] == 1:
            inner, _ = _walk(arg[2])
            strings = None if inner is None else inner | {""}
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        found.append(_of_strings(held))
        if strings is not None:
            whole, held = False, set(strings)
        else:
            whole, held = False, {""}
            found.append(query)
    if whole:
        exact = held
        return exact, _of_strings(held)
    return None, _join("and", [*found, _of_strings(held)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a pattern: True if it has no mandatory trigram."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def build_index(docs: DataFrame, trigrams: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings: trigram, block (id div 64), bits (bit id mod 64); written sorted by trigram, so a query reads only its own."""
    if not trigrams:
        return docs.sparkSession.createDataFrame([], "trigram string, block long, bits long")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.shiftright(F.col(id_col).cast("long"), 6).alias("block"), F.expr("shiftleft(1L, cast(pmod(cast(`%s` as bigint), 64) as int))" % id_col.replace("`", "``")).alias("bit"), F.lower(text_col).alias("low"))
    has = [F.bit_or(F.when(F.contains("low", F.lit(t)), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"t{k}") for k, t in enumerate(trigrams)]
    blocks = rows.groupBy("block").agg(*has)
    pairs = F.array(*(F.struct(F.lit(t).alias("trigram"), F.col(f"t{k}").alias("bits")) for k, t in enumerate(trigrams)))
    postings = blocks.select("block", F.explode(F.filter(pairs, lambda p: p["bits"] != 0)).alias("p")).select("p.trigram", "block", "p.bits")
    return stored(postings.sortWithinPartitions("trigram", "block"), "trigram-index")


def candidates(index: DataFrame, queries: list[object]) -> DataFrame:
    """Ids with at least one satisfied query: doc_id, rule_bits (bit k: query k holds; a query without trigrams sets none)."""
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    place = {t: f"t{k}" for k, t in enumerate(wanted)}
    zero = F.lit(0).cast("long")
    blocks = index.where(F.col("trigram").isin(wanted)).groupBy("block").agg(*(F.bit_or(F.when(F.col("trigram") == t, F.col("bits")).otherwise(zero)).alias(c) for t, c in place.items()))

    def bits(query) -> Column:
        if isinstance(query, str):
            return F.col(place[query])
        first, *rest = map(bits, query[1])
        for x in rest:
            first = first.bitwiseAND(x) if query[0] == "and" else first.bitwiseOR(x)
        return first

    blocks = blocks.select("block", F.array(*(zero if q is True else bits(q) for q in queries)).alias("masks"))
    ids = blocks.where(F.exists("masks", lambda m: m != 0)).select("block", "masks", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    rule_bits = F.lit(0).cast("long")
    for r in range(len(queries)):
        at = F.expr(f"(shiftrightunsigned(masks[{r}], k) & 1L)")
        rule_bits = rule_bits.bitwiseOR(F.shiftleft(at, r))
    return ids.select((F.col("block") * 64 + F.col("k")).alias("doc_id"), rule_bits.alias("rule_bits")).where("rule_bits <> 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches that are long enough, in code points, end exclusive."""
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    pattern = F.lit(rule.pattern)
    gaps, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(judged, F.length).alias("own"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        new = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["n"]).alias("end")))
        return F.struct((begin + x["n"]).alias("at"), F.when(x["own"] >= rule.least, F.concat(a["out"], new)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.filter(lengths, lambda x: x["n"].isNotNull()), start, step, lambda a: a["out"])


def scan(docs: DataFrame, rules=RULES, *, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column `out` (it replaces one of that name): array<struct<start, kind, end>> of all rules, by start, then kind."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = build_index(docs, sorted(set().union(*map(trigrams_of, queries))), id_col=id_col, text_col=text_col)
    # stored, so that its size is known when the join is planned: broadcast if it is small, else a sort-merge join
    found = stored(candidates(index, queries).select(F.col("doc_id").alias("_secret_id"), F.col("rule_bits").alias("_secret_bits")), "secret-candidates")
    rows = docs.join(found, F.col(id_col).cast("long") == F.col("_secret_id"), "left")
    bits = F.when(F.col(id_col).isNull(), F.lit(-1).cast("long")).otherwise(F.coalesce("_secret_bits", F.lit(0).cast("long")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = [F.when((F.lit(True) if q is True else bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0) & text.rlike(r.pattern), spans_of(text, r, k)).otherwise(none) for k, (r, q) in enumerate(zip(rules, queries))]
    return rows.withColumn(out, F.sort_array(F.concat(*parts))).drop("_secret_id", "_secret_bits")


def written(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with each span, overlapping ones as one, replaced by the mark."""

    def step(a, s):
        piece = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        inside = s["start"] < a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, let(spans, lambda s: F.aggregate(s, start, step, done))).otherwise(text)
