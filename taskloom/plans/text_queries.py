"""Text and hash functions (F1-F30, P2, P6, P14, P15, T11-T13, U2) over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions import hashing, parse
from taskloom.functions import text as tx
from taskloom.operators import qa
from taskloom.plans import base
from taskloom.plans.base import FRAMES, REAL
from taskloom.plans.registry import query

#: Events as texts of many forms.
_TEXTS = """tx as (select event_id, case event_id % 6 when 0 then 'It is <progress>' || value || '%</progress>, so.' when 1 then 'about ' || value || ' of it' when 2 then '<PROGRESS> ' || printf('%.5f', value / 1000) || ' </PROGRESS>'
    when 3 then '<progress>none</progress> but ' || value || '%' when 4 then 'no number' else '<progress>-' || value || '</progress>' end as t, value from events)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, m = F.col("value").cast("string"), F.col("event_id") % 6
    t = F.when(m == 0, F.concat(F.lit("It is <progress>"), v, F.lit("%</progress>, so."))).when(m == 1, F.concat(F.lit("about "), v, F.lit(" of it"))).when(m == 2, F.concat(F.lit("<PROGRESS> "), F.format_string("%.5f", F.col("value") / 1000), F.lit(" </PROGRESS>")))
    t = t.when(m == 3, F.concat(F.lit("<progress>none</progress> but "), v, F.lit("%"))).when(m == 4, "no number").otherwise(F.concat(F.lit("<progress>-"), v, F.lit("</progress>")))
    return base.table(spark, sf_dir, "events").select("event_id", t.alias("t"), "value")


_NUM = r"([-+]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+))(%?)"


def _parse(part: str) -> str:
    n = f"try_cast(nullif(regexp_extract({part}, '{_NUM}', 1), '') as double)"
    return f"(case when regexp_extract({part}, '{_NUM}', 2) = '%' then {n} when {n} <= 1 then {n} * 100 else {n} end)"


@query(f"with {_TEXTS} select event_id, round(coalesce({_parse('regexp_extract(t, ' + chr(39) + '(?is)<progress>(.*?)</progress>' + chr(39) + ', 1)')}, {_parse('t')}), 6) as p from tx")
def f1_progress_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("event_id", F.round(tx.progress_value(F.col("t")), 6).alias("p"))


_TAG = r"(?i)<progress>\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*%?\s*</progress>"


@query(rf"with {_TEXTS} select event_id, case when regexp_matches(t, '{_TAG}') then greatest(0.0::double, least(100.0::double, cast(regexp_extract(t, '{_TAG}', 1) as double))) end as p from tx")
def f2_strict_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("event_id", tx.strict_progress(F.col("t")).alias("p"))


@query(r"""with g as (select conv_id, list({'r': role, 'v': case when turn % 2 = 1 then '<progress>' || turn || '.5%</progress>' else text end} order by turn) as turns from conversations group by conv_id),
    f as (select conv_id, list_filter(turns, lambda t: t.r <> 'human' and regexp_matches(t.v, '(?is)<progress>(.*?)</progress>'))[1].v as v from g)
    select conv_id, coalesce(try_cast(trim(replace(regexp_extract(v, '(?is)<progress>(.*?)</progress>', 1), '%', '')) as double), -1.0) as p from f""")
def f3_training_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "conversations")
    v = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<progress>"), F.col("turn").cast("string"), F.lit(".5%</progress>"))).otherwise(F.col("text"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), v.alias("value")))).alias("t"))
    return turns.select("conv_id", tx.training_progress(F.transform("t", lambda x: F.struct(x["from"], x["value"]))).alias("p"))


@query(r"""with d as (select doc_id, text || chr(10) || 'Therefore it ends.' || chr(10) || 'A step. It is <progress>5%</progress> now. More.' as t from documents),
    c as (select doc_id, regexp_replace(trim(t), '(?i)[^.\n]*<progress>\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*%?\s*</progress>[^.\n]*\.?', '', 'g') as t from d)
    select doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '(?i)^(therefore|thus|hence|so)\b')), chr(10))) as h from c""")
def f4_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    t = F.concat(F.col("text"), F.lit("\nTherefore it ends.\nA step. It is <progress>5%</progress> now. More."))
    return d.select("doc_id", F.md5(tx.reasoning_text(t)).alias("h"))


@query(rf"""select doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(replace(lower('1. ' || text), chr(13), chr(10)), '\b[0-9]+\.\s*', '', 'g'), '[.\n;]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')) as h from documents""")
def f5_split_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.array_join(tx.split_actions(F.concat(F.lit("1. "), F.col("text"))), "|")).alias("h"))


@query(rf"""select doc_id, md5(array_to_string(list_transform(list_filter(list_transform(string_split('2. ' || text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: case when regexp_matches(x, '^[0-9]') then regexp_replace(x, '^[^.]*\.\s*', '') else x end), '|')) as h from documents""")
def f6_plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.array_join(tx.plan_lines(F.concat(F.lit("2. "), F.col("text"))), "|")).alias("h"))


@query(f"with s as (select doc_id, array_to_string(string_split(text, '. ')[1:3], '. ') as t from documents) select doc_id, md5(case when ends_with(t, '.') then t else t || '.' end) as h from s")
def f7_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.first_sentences(F.col("text"))).alias("h"))


@query("select event_id, case when event_id % 2 = 0 then 'go on ' || event_id else 'plain ' || event_id end as t, event_id % 3 = 0 as done, case when event_id % 4 = 0 then 'box ' || event_id else 'k ' || event_id end as boxed, 'ok ' || event_id as spoken, case event_id % 3 when 0 then 'ok ' || event_id when 1 then 'reasoning</think> ok ' || event_id || '</think>x' else 'ok ' || event_id end as cleaned from events")
def f8_f9_f13_f14_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = i.cast("string")
    cot = F.when(i % 2 == 0, F.concat(F.lit("think cot: go on "), s)).otherwise(F.concat(F.lit("plain "), s))
    verdict = F.when(i % 3 == 0, "YES, it is").otherwise("no")
    box = F.when(i % 4 == 0, F.concat(F.lit("<|begin_of_box|> box "), s, F.lit(" <|end_of_box|>"))).otherwise(F.concat(F.lit("k "), s))
    think = F.when(i % 3 == 0, F.concat(F.lit("<think>a\nb</think> ok "), s)).when(i % 3 == 1, F.concat(F.lit("reasoning</think> ok "), s, F.lit("</think>x"))).otherwise(F.concat(F.lit(" ok "), s, F.lit("\n")))
    e = base.table(spark, sf_dir, "events")
    return e.select("event_id", tx.after_marker(cot).alias("t"), tx.done_verdict(verdict).alias("done"), tx.boxed(box).alias("boxed"), tx.after_thinking(think).alias("spoken"), tx.without_thinking(think).alias("cleaned"))


@query(f"select doc_id, trim(string_split(text, '.')[2]) as reason from documents")
def f10_finish_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", tx.finish_reason(F.col("text")).alias("reason"))


@query("select event_id, case when event_id % 8 = 0 then 'progress' when event_id % 8 in (2, 7) then 'planning' else 'segmentation' end as kind from events")
def f17_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag, a strict list, a plan, the empty list, and lists with a fence, a trailing comma and no end; a list of numbers is a plan."""
    m = F.col("event_id") % 8
    t = F.when(m == 0, "<progress>5%</progress>").when(m == 1, '[{"action_description": "a", "start_frame": 1}]').when(m == 2, "1. open it").when(m == 3, "[]")
    t = t.when(m == 4, '```json\n[{"a": 1}]\n```').when(m == 5, '[{"a": 1},]').when(m == 6, "[{'d': 'the man's cup', 's': 1}, {'d': 'it").otherwise("[1, 2]")
    return base.table(spark, sf_dir, "events").select("event_id", tx.task_type(t).alias("kind"))


@query(r"select doc_id, md5(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')) as h from documents")
def f18_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.printable(F.col("text"))).alias("h"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(f"select doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ({_STOP})), ' ')) as h from documents")
def f19_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tx.content_words(F.col("text")), " ")).alias("h"))


@query(f"""with {FRAMES}, a as (select episode, list(distinct sub_task) as xs from fr group by episode), s as (select episode, list_sort(xs) as xs from a)
    select episode, 'Do ' || episode || ': ' || array_to_string(list_transform(xs, lambda x, i: i || '. ' || x), chr(10)) as prompt, printf('r/%06d.jpg', episode) as image, printf('r/%06d_%06d.mp4', episode, episode + 7) as clip, array_to_string(list_transform(range(0, episode % 5), lambda i: '<' || i || '.0 seconds>'), '') as marks from s""")
def f20_f21_f22_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base.frames(spark, sf_dir).groupBy("episode").agg(F.sort_array(F.collect_set("sub_task")).alias("xs"))
    e = F.col("episode")
    return a.select("episode", tx.filled("Do {e}: {list}", e=e, list=tx.numbered(F.col("xs"))).alias("prompt"), tx.image_path(F.lit("r"), e).alias("image"), tx.clip_path(F.lit("r"), e, e + 7).alias("clip"), F.array_join(tx.timestamp_marks(e % 5), "").alias("marks"))


#: hf(c_custkey, h): the folded hash of the texts s of {source}; a crc32 by table, then the product in two halves.
_FOLDED = """with recursive b as ({source}), t as (select range as i from range(256)), z(i, v, n) as (select i, i, 0 from t union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, n + 1 from z where n < 8),
    l as (select i, v from z where n = 8), r(c_custkey, s, k, x) as (select c_custkey, s, 1, 4294967295::bigint from b union all select r.c_custkey, s, k + 1, xor(r.x >> 8, l.v) from r join l on l.i = (xor(r.x, ascii(substr(s, k, 1))::bigint) & 255) where k <= length(s)),
    c as (select c_custkey, xor(x, 4294967295::bigint) as x from r where k = length(s) + 1), f as (select c_custkey, xor(x, x >> 16)::hugeint as x from c),
    p as (select c_custkey, (((x * (11400714819323198485::hugeint // 4294967296)) % 4294967296) * 4294967296 + x * (11400714819323198485::hugeint % 4294967296)) % 18446744073709551616::hugeint as p from f),
    hf as (select c_custkey, cast((p // 4294967296) * 4294967296::hugeint + xor((p // 4294967296)::bigint, (p % 4294967296)::bigint)::hugeint as varchar) as h from p)"""


@query(_FOLDED.format(source="select c_custkey, c_name as s from customer") + " select * from hf")
def f23_folded_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "customer").select("c_custkey", hashing.folded_hash(F.col("c_name")).cast("string").alias("h"))


@query("select doc_id, substr(sha256(text || '(640, 480)'), 1, 40) as h from documents")
def f24_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.encode("text", "UTF-8"), F.lit("(640, 480)")).alias("h"))


@query(_FOLDED.format(source="select c_custkey, case when c_custkey % 2 = 0 then 'episode_' || lpad(c_custkey::varchar, 6, '0') || '.plan.jsonl' else c_name end as s from customer") + """
    select c_custkey, cast(case when c_custkey % 2 = 0 then (c_custkey // 10) % 7 % 4 else cast(h as hugeint) % 4 end as bigint) as shard from hf""")
def f25_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an episode's index and a suffix, and names without one."""
    named = F.concat(F.lit("episode_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".plan.jsonl"))
    name = F.when(F.col("c_custkey") % 2 == 0, named).otherwise(F.col("c_name"))
    return base.table(spark, sf_dir, "customer").select("c_custkey", hashing.shard_of(name, name, 4, 7).cast("long").alias("shard"))


@query(f"with {FRAMES} select episode, frame_id from fr where (episode // 10) % 3 = 1")
def p2_shard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.frames(spark, sf_dir).where(F.pmod(hashing.shard_token(F.col("episode")), F.lit(3)) == 1).select("episode", "frame_id")


@query("select p_partkey, regexp_replace(regexp_replace(p_name, '\\s+', '_', 'g'), '[^A-Za-z0-9_]', '_', 'g') as tag, list_transform([1, 3, 5], lambda i: 80 + (('0x' || substr(md5(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))), i, 2))::integer // 2))::varchar as color from part")
def f26_f29_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.label_color(F.col("p_name"))
    return base.table(spark, sf_dir, "part").select("p_partkey", tx.safe_tag(F.col("p_name")).alias("tag"), F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")).alias("color"))


@query("""with r as (select p_partkey, p_retailprice / 5.0::double as raw from part), q as (select p_partkey, raw, power(10.0::double, floor(log10(raw))) as pw from r)
    select p_partkey, pw * case when raw / pw <= 1 then 1.0 when raw / pw <= 2 then 2.0 when raw / pw <= 5 then 5.0 else 10.0 end as step from q""")
def f28_nice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "part").select("p_partkey", tx.nice_step(F.col("p_retailprice"), 5).alias("step"))


@query("select event_id, case event_id % 3 when 0 then 'Locate these objects: ' || event_type || '.' when 1 then 'Locate all objects that matter for the task: ' || event_type || '.' else 'Locate all objects that can be handled.' end as prompt from events")
def f30_grounding_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    return base.table(spark, sf_dir, "events").select("event_id", tx.grounding_prompt(F.when(m == 1, F.col("event_type")), F.when(m == 0, F.array("event_type"))).alias("prompt"))


@query(f"with {FRAMES} select episode, frame_id, sub_task from fr where {REAL.format('sub_task')}")
def p6_real_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.operators.sequence import is_real

    return base.frames(spark, sf_dir).where(is_real(F.col("sub_task"))).select("episode", "frame_id", "sub_task")


@query("select page_id, case when page_id % 2 = 0 then '/abs/' || page_id else '/root/data/p/' || page_id end as path from pages")
def p14_absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), i)).otherwise(F.concat(F.lit("p/"), i))
    return base.table(spark, sf_dir, "pages").select("page_id", F.get(qa.absolute_paths(F.array(p), "/root/data"), F.lit(0)).alias("path"))


@query("select conv_id, turn, case when turn % 3 = 0 then null else 'text:look|image:a.jpg|text:' || trim(replace(text, chr(10), ' ')) end as m from conversations where role = 'user'")
def p15_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "conversations").where("role = 'user'")
    media = F.when(F.col("turn") % 3 == 0, F.array(F.lit("a.jpg"), F.lit("b.jpg"))).otherwise(F.array(F.lit("a.jpg")))
    m = qa.messages(F.concat(F.lit(" look <image>"), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), media)
    return c.select("conv_id", "turn", F.when(m.isNotNull(), F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["type"], x["value"])), "|")).alias("m"))


@query("""select doc_id, 'user text=look image=a' || doc_id || ' text=and video=v text=at ' || doc_id || ' image=b|assistant text= yes <image> |user video=w' as said from documents""")
def p15_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with roles, images and videos; marks in an answer stay text."""
    s = F.col("doc_id").cast("string")
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    talk = F.array(turn("human", F.concat(F.lit("look <image>\n and <video>at "), s, F.lit(" <image>"))), turn("gpt", F.lit(" yes <image> ")), turn("human", F.lit("<video>\n")))
    m = qa.chat_messages(talk, F.array(F.concat(F.lit("a"), s), F.lit("b")), F.array(F.lit("v"), F.lit("w")))
    said = F.transform(m, lambda x: F.concat(x["role"], F.lit(" "), F.array_join(F.transform(x["content"], lambda c: F.concat(c["type"], F.lit("="), c["value"])), " ")))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.array_join(said, "|").alias("said"))


@query(r"""select conv_id, cast(21 + sum(len(regexp_extract_all(text, '\S+'))) + 36 as bigint) as tokens, cast(sum(len(regexp_extract_all(text, '\S+'))) + 128 as bigint) as length, cast(-sum(len(regexp_extract_all(text, '\S+'))) as bigint) as modal from conversations group by conv_id""")
def t11_t13_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("c"), F.collect_list(tx.word_count(F.col("text")).cast("long")).alias("n"))
    grids = F.expr("array(array(1L, 12L, 12L))")
    return g.select("conv_id", qa.token_total(F.col("n"), grids).alias("tokens"), qa.word_length(F.col("c"), F.lit(True)).cast("long").alias("length"), qa.modality_length(F.col("c"), F.lit(False)).cast("long").alias("modal"))


@query("""with n as (select o_orderkey, cast(30 + o_orderkey % 400 as integer) as total from orders), m as (select *, least(greatest(cast(round_even(total / 30.0::double / 2.0, 0) as integer), 1), 6) as k from n)
    select o_orderkey, array_to_string(case when k = 1 then [0] else list_sort(list_distinct(list_transform(range(0, k), lambda i: cast(floor(i * ((total - 1) / (k - 1)::double) + 1e-9) as integer)))) end, ',') as idx from m""")
def t12_video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = (F.lit(30) + F.col("o_orderkey") % 400).cast("int")
    idx = F.array_sort(qa.video_frames(total, F.lit(30.0), interval=2.0, least=1, most=6))
    return base.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(idx, lambda x: x.cast("string")), ",").alias("idx"))


@query("select event_id, 'so <progress>' || printf('%.2f', 100.0 / (1.0 + exp(-(value - 245) / 50))) || '%</progress>' as t from events")
def u2_value_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").select("event_id", tx.rewrite_progress(F.lit("so <progress>3</progress>"), (F.col("value") - 245) / 50).alias("t"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case l_partkey % 4 when 0 then 'cup' when 1 then 'cup' when 2 then 'object' end as label, case when l_partkey % 4 < 3 then l_quantity + 6.0 end as total, l_partkey % 4 < 2 as parsed from lineitem")
def f11_f12_answer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q = F.col("l_partkey") % 4, F.col("l_quantity").cast("int").cast("string")
    body = F.concat(F.lit("[1, 2, 3, "), q, F.lit("]"))
    t = F.when(m == 0, F.concat(F.lit('Here:\n```json\n[{"bbox_2d": '), body, F.lit(', "label": "cup"}] // it\n```')))
    t = t.when(m == 1, F.concat(F.lit('I see [{"name": "cup", "box": '), body, F.lit("}] there"))).when(m == 2, F.concat(F.lit("a cup at ((1, 2, 3, "), q, F.lit(")) maybe"))).otherwise("nothing")
    rows = base.table(spark, sf_dir, "lineitem").withColumn("t", t).withColumn("a", parse.answer_boxes(F.col("t")))
    box = F.get("a.boxes", F.lit(0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", box["label"].alias("label"), F.aggregate(box["bbox_2d"], F.lit(0.0), lambda s, x: s + x).alias("total"), "a.parsed")


@query("select event_id, case when event_id % 3 = 2 then 10 + event_id % 5 end as c, case when event_id % 3 = 2 then 20 end as s, event_id % 3 = 2 as valid from events")
def f15_mapped_sub_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    sub = lambda c, s: F.concat(F.lit('Sure: {"task": "t", "subtasks": [{"name": "a", "start_frame": '), s, F.lit(', "complete_frame": '), c, F.lit("}]}"))
    t = F.when(i % 3 == 0, "no json").when(i % 3 == 1, sub(F.lit("99"), F.lit("-1"))).otherwise(sub((i % 5).cast("string"), F.lit("10")))
    rows = base.table(spark, sf_dir, "events").select("event_id", parse.mapped_sub_tasks(t, F.sequence(F.lit(10), F.lit(20))).alias("r"))
    first = F.get("r.results.subtasks", F.lit(0))
    return rows.select("event_id", first["complete_frame"].cast("long").alias("c"), first["start_frame"].cast("long").alias("s"), "r.valid")


@query("select event_id, case event_id % 3 when 0 then '1,2' when 1 then '0' else '' end as idx from events")
def f16_index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    t = F.when(m == 0, "[[1, 2]]").when(m == 1, "Drop these: [0, 7, -1]").otherwise("none of them")
    rows = base.table(spark, sf_dir, "events").withColumn("t", t).withColumn("n", F.lit(3))
    rows = rows.withColumn("ids", parse.answer_indices(F.col("t"), F.col("n")))
    return rows.select("event_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("idx"))
