"""One query an operator over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, near_dedup, pieces, quality, secrets, substring_dedup, token_output, url_filter, warc
from .common import stored

#: The public tokenizer files; a parameter of the operators.  Executors have the package that holds them, too.
PIECES, WORDS = map(public_tokenizers.path, ("piece_bpe_32k.model", "word_bpe_49k.json"))
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE_KINDS)
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{secrets.RULES[k].kind}") for k in range(secrets.BASE_KINDS)),
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /<source>/<language>/<id div 1000>/<id>."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), PIECES, keep_ids=False, memo=1_500_000)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_output.write_ids(table(spark, sf_dir, "documents"), WORDS, end_id=END_ID)
    return token_output.read_ids(written)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(stored(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger"), "v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE_BITS).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", "kept_base", "kept_no_symbols", "n_alike")


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(*warc.write_archive(table(spark, sf_dir, "pages")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_license_scan, op4_sentencepiece, op5_decontamination, op6_minhash_near_dedup, op7_token_output, op8_quality_rules, op9_warc_archive, op10_url_filter)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _spans_sql() -> str:
    """All spans of all rules: doc_id, kind, k, s, e; a match begins after the pieces and matches before it."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, '{r.kind}' as kind, {k} as k, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as g, string_split_regex(t, '{p}') as gaps, {r.least} as least from d where regexp_matches(t, '{p}')""")
    return f"""d as (select doc_id, coalesce(text, '') as t from documents),
    f as ({' union all '.join(parts)}),
    x as (select doc_id, kind, k, unnest(range(1, len(m) + 1)) as i, m, g, gaps, least from f),
    y as (select doc_id, kind, k, length(g[i]) as own, least, length(m[i]) as n, list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) as s from x),
    sp as (select doc_id, kind, k, cast(s as bigint) as s, cast(s + n as bigint) as e from y where own >= least)"""


def _licenses_sql() -> str:
    terms = ", ".join(f"({k}, '{name}', '{t}', {c})" for k, name, t, c in licenses.template_terms())
    return f"""
    with tt(template, license, term, c) as (values {terms}), voc as (select distinct term from tt),
    d as (select doc_id, coalesce(text, '') as t, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || cast(floor(doc_id / 1000) as bigint) as dir from documents),
    x as (select doc_id, unnest(string_split(regexp_replace(t, '([.;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) as u from d),
    u as (select distinct doc_id, trim(u) as unit from x where regexp_matches(u, '{licenses.MARKERS}')),
    du as (select unit, count(*) as files from u group by unit), w as (select unit, files, regexp_extract_all(lower(unit), '{licenses.TOKEN}') as ws from du),
    te as (select unit, files, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from w),
    f as (select unit, files, term, count(*) as tf from te where term in (select term from voc) group by all),
    idf as (select voc.term, ln((1 + (select coalesce(sum(files), 0) from du)) / (1 + coalesce(df, 0))::double) + 1 as idf from voc left join (select term, sum(files) as df from f group by term) using (term)),
    a as (select unit, term, tf * idf as w from f join idf using (term)), b as (select template, license, term, c * idf as v from tt join idf using (term)),
    s as (select unit, license, round(sum(w * v) / (any_value(nv) * any_value(nw)), 6) as score from a join b using (term) join (select template, sqrt(sum(v * v)) as nv from b group by template) using (template)
        join (select unit, sqrt(sum(w * w)) as nw from a group by unit) using (unit) group by unit, template, license),
    k as (select unit, min({{'m': -score, 'l': license}}) as m from s where score >= {licenses.LEAST} group by unit),
    h as (select doc_id, min(m) as m, sum(len(string_split_regex(unit, '\\s+'))) as own from u join k using (unit) group by doc_id),
    o as (select doc_id, dir, dir || '/' || doc_id as path, m.l as license, -m.m as score, own >= {licenses.SHARE} * len(regexp_extract_all(t, '\\S+')) as speaks from d left join h using (doc_id)),
    sp as (select dir as licensed_dir, min({{'m': -score, 'p': path, 'l': license}}).l as up from o where speaks group by dir),
    n as (select dir, arg_max(licensed_dir, length(licensed_dir)) as ld, arg_max(up, length(licensed_dir)) as up from (select distinct dir from o) join sp on dir = licensed_dir or starts_with(dir, licensed_dir || '/') group by dir)
    select doc_id, path, coalesce(license, up) as license, score, case when license is not null then 'own' when up is not null then 'inherited' else 'none' end as origin, case when license is null then ld end as licensed_dir from o left join n using (dir)"""


def _decontamination_sql() -> str:
    """Passages by length class, BM25 shares and n-grams of the halves, all by lists and joins."""
    d, words = decontaminate, "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
    grams = lambda ws, k: f"list_distinct(list_transform(range(1, len({ws}) - {k} + 2), lambda i: array_to_string({ws}[i:i + {k} - 1], ' ')))"
    share = lambda h, k: f"case when len({h}) = 0 then 1.0 else len(list_intersect({grams(h, k)}, {grams('ps', k)}))::double / len({grams(h, k)}) end"
    return f"""
    with i as (select item_id, {words} as ws from benchmark), it as (select item_id, ws, len(ws) as n, greatest({d.LEAST_WINDOW}, cast(2 ** ceil(log2(len(ws))) as bigint)) as c from i where len(ws) > 0),
    m as (select avg(n) as mean from it), d as (select doc_id, {words} as ws from documents), nd as (select count(*) as n_docs from d),
    tf as (select item_id, n, c, term, count(*) as k from (select item_id, n, c, unnest(ws) as term from it) group by all),
    df as (select term, count(*) as df from (select unnest(list_distinct(ws)) as term from d) semi join tf using (term) group by term),
    own as (select item_id, c, term, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * k * ({d.K1} + 1) / (k + {d.K1} * (1 - {d.B} + {d.B} * n / mean)) as x from tf left join df using (term), m, nd),
    im as (select item_id, c, term, x / sum(x) over (partition by item_id) as x from own),
    p as (select doc_id, c, unnest(range(0, greatest(1, len(ws) - c), c)) as s, ws from d, (select distinct c from it)), q as (select doc_id, c, s, ws[s + 1:s + 2 * c] as ps from p),
    w as (select doc_id, c, s, unnest(list_distinct(ps)) as term from q),
    r as (select doc_id, item_id, c, s, round(sum(x), 6) as score from w join im using (c, term) group by all having round(sum(x), 6) >= {d.THRESHOLD}),
    h as (select r.doc_id, r.item_id, r.s, score, ps, it.ws[1:(n + 1) // 2] as a, it.ws[(n + 1) // 2 + 1:] as b from r join q using (doc_id, c, s) join it using (item_id)),
    v as (select doc_id, item_id, s, score, {share('a', 'least(3, len(a))')} as qo, {share('b', 'least(3, len(b))')} as ao from h)
    select doc_id, item_id, score, round(qo, 6) as question_overlap, round(ao, 6) as answer_overlap, cast(s as bigint) as passage_start from v
    where qo >= {d.OVERLAP} and ao >= {d.OVERLAP} qualify row_number() over (partition by doc_id, item_id order by score desc, s) = 1"""


ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": _decontamination_sql(),
    "op3_license_scan": _licenses_sql(),
    "op1_substring_dedup": f"""
    with w as (select doc_id, {_WORDS} as ws from documents),
    p as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
    g as (select doc_id, i, array_to_string(ws[i:i+49], ' ') as win from p),
    m as (select win, min(doc_id) as first from g group by win),
    b as (select distinct g.doc_id, g.i from g join m using (win) where m.first < g.doc_id),
    c as (select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as gone from b group by doc_id),
    k as (select w.doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
        list_filter(ws, lambda x, j: not list_contains(coalesce(gone, []), j)) as kept from w left join c using (doc_id))
    select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    "op2_secret_scan": f"""
    with {_spans_sql()},
    a as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
        coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {secrets.BASE_KINDS}), '') as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from sp group by doc_id)
    select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join a using (doc_id)""",
    "op6_minhash_near_dedup": """
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) as sh from w),
    n as (select doc_id, len(sh) as n, sh from s),
    u as (select doc_id, n, unnest(sh) as g from n),
    o as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
    l as (select a, b from o where 100 * c >= 85 * (na + nb - c)),
    e as (select a, b from l union all select b, a from l),
    r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
    k as (select a, min(b) as m from r group by a)
    select n.doc_id, cast(n as bigint) as n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) as component_id, n.doc_id <= coalesce(m, n.doc_id) as kept from n left join k on k.a = n.doc_id""",
    "op8_quality_rules": f"""
    with w as (select doc_id, coalesce(text, '') as t, {_WORDS} as ws from documents),
    g as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) >= 5),
    h as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as win from g),
    d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from h) where c >= 2),
    r as (select doc_id, len(list_distinct(flatten(list(range(i, i + 5))))) as n_repeat_words from d group by doc_id),
    m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (doc_id)),
    f as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines from m),
    b as (select *, (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end) + (case when word_chars > 25 * n_words or 2 * word_chars < 3 * n_words then 4 else 0 end)
        + (case when 10 * n_symbols > 3 * n_words then 8 else 0 end) + (case when 10 * n_dup_lines > 3 * n_lines then 16 else 0 end) as fail_bits from f)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
        cast(n_repeat_words as bigint) as n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, cast(fail_bits as bigint) as fail_bits,
        fail_bits & {quality.POLICIES["base"]} = 0 as kept_base, fail_bits & {quality.POLICIES["no_symbols"]} = 0 as kept_no_symbols,
        case when bit_count(cast(fail_bits as bigint)) = 1 then count(*) over (partition by fail_bits) end as n_alike from b""",
    "op9_warc_archive": """
    with p as (select page_id, encode(coalesce(html, '')) as b from pages),
    q as (select page_id, octet_length(b) as n, sha256(b) as d, min(page_id) over (partition by sha256(b)) as first from p)
    select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
        case when n >= 100 and first < page_id then first end as refers_to from q""",
    "op10_url_filter": f"""
    with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
    v as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
    r(kind, rule, h, p) as (values {', '.join(f"('{k}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for k, r in url_filter.RULES)}),
    b(h) as (values {', '.join(f"('{h}')" for h in url_filter.BLOCK_HOSTS)}),
    f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(kind, length(rule)) as kind from v join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
    l as (select page_id, min(h) as listed from v join b on host = h or ends_with(host, '.' || h) group by page_id)
    select page_id, host, path, rule, coalesce(kind, case when listed is null then 'allow' else 'block' end) as verdict, case when rule is null then listed end as listed from v left join f using (page_id) left join l using (page_id)""",
}
