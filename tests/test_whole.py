"""Queries over the whole of their tables: rows that a cut in the query would leave out.

Some registered SQL has the cut, too; here the rows are held against that SQL without it."""

import duckdb
import pytest

from taskloom.plans import registry
from tests.oracle import same


def _held(spark, tmp_path, name, cuts, **tables):
    """Rows of the query over the tables (SQL by name) that equal those of its SQL without the cuts."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    sql = registry.oracle_sql()[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    return same(registry.queries()[name](spark, str(tmp_path)), con, sql)


#: 700 events of the users 0, 7, .. 343: chunks 0 to 6.
EVENTS = """select i as event_id, timestamp '2024-01-01' + to_minutes(cast(i * 37 % 700 as integer)) as ts, cast(i % 50 * 7 as bigint) as user_id,
    ['view', 'click', 'error'][i % 3 + 1] as event_type, i % 97 + 0.5 as value, '{"k": ' || i % 100 || '}' as props from range(700) t(i)"""


def test_frames_of_all_chunks(spark, tmp_path):
    assert _held(spark, tmp_path, "s2_s5_frames", [" where episode < 150"], events=EVENTS) == 700


#: 90 boxes of 30 orders in two episodes, up to 28 frames apart.
BOXED = """select cast(i // 3 * 2 + 20 as bigint) as l_orderkey, cast(i % 3 + 1 as integer) as l_linenumber, cast(i * 7 % 40 as bigint) as l_partkey, cast(i % 5 as bigint) as l_suppkey,
    cast(i * 13 % 20 as double) + 31 as l_quantity, cast(i // 3 % 3 as double) / 100 as l_discount, cast(i // 3 % 2 as double) / 50 as l_tax from range(90) t(i)"""


def test_boxes_matched_over_whole_episodes(spark, tmp_path):
    cuts = [" where episode % 10 = 3", " and b.frame_id - a.frame_id <= 10"]
    assert _held(spark, tmp_path, "j11_matched_boxes", cuts, lineitem=BOXED) > 0
    rows = registry.queries()["j11_matched_boxes"](spark, str(tmp_path))
    assert rows.where("f2 - f1 > 10").count() > 0 and rows.select("episode").distinct().count() == 2


def test_ranges_of_all_episodes(spark, tmp_path):
    assert _held(spark, tmp_path, "w2_episode_range", [" where episode % 3 = 0"], events=EVENTS) == 50


def test_log_of_all_events(spark, tmp_path):
    events = EVENTS.replace("range(700)", "range(2300)")
    assert _held(spark, tmp_path, "s8_eval_log", [" where event_id < 300"], events=events) == 2300


#: Documents of four languages and one without; marks, numbers and letters outside ASCII.
DOCUMENTS = r"""select i as doc_id, l as lang, t as text from (values
    (1, 'en', 'The cat sat. It slept. 3. Then it ran; away. End'), (2, 'fr', 'Été à la forêt. 2. L''œuvre est là;
ça va. Où? Fin.'), (3, 'de', 'ÄPFEL und Öl. 12. Straße; Füße.
Dritter Satz. Ende'),
    (4, 'es', '¿Qué? El niño. 1. Mañana;
7. Acción. Último'), (5, null, 'Plain text. No language; 5. of its own. More'), (6, 'de', '  
4. Zeile

Über. '), (7, 'fr', 'sans point')) v(i, l, t)"""


@pytest.mark.parametrize("name", ["f5_split_actions", "f6_plan_lines", "f7_first_sentences", "f10_finish_reason", "f19_content_words"])
def test_texts_of_all_languages(spark, tmp_path, name):
    documents = DOCUMENTS.replace("\\n", "' || chr(10) || '")
    assert _held(spark, tmp_path, name, [" where lang = 'en'"], documents=documents) == 7
