"""Alert rules over nested situations, prompts, answers and labelled sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as rules
from ..operators.asof import last_wins
from ..sources.tables import SITUATION_SQL, situation, table, uav_name
from .base import Plans

plans = Plans()
_NEAR = "list_min(list_transform(nearby, lambda x, i: {'min_sep_m': x.min_sep_m, 'i': i, 'id': x.id}))"
_FLAGS = f"""n AS (SELECT *, {_NEAR} AS best FROM situation),
a AS (SELECT *, len(list_filter(zones, lambda z: z.inside_zone = 1 OR z.over_limit_alt = 1)) > 0 AS a1,
  len(list_filter(nearby, lambda x: x.route_intersect = 1)) > 0 AND best.min_sep_m < 50 AS a2, battery_pct < 20 AS a3 FROM n)"""


@plans(f"WITH {SITUATION_SQL}, {_FLAGS} SELECT sample_id, a1::INT AS \"A1\", a2::INT AS \"A2\", a3::INT AS \"A3\", (NOT (a1 OR a2 OR a3))::INT AS \"A4\" FROM a")
def alerts(spark, sf_dir):
    flags = rules.alerts(F.col("nearby"), F.col("zones"), F.col("battery_pct"))
    return situation(spark, sf_dir).select("sample_id", *(v.alias(k) for k, v in flags.items()))


@plans(f"WITH {SITUATION_SQL}, {_FLAGS} SELECT sample_id, best.id AS nearest_uav_id, best.min_sep_m AS nearest_sep_m FROM a")
def nearest_argmin(spark, sf_dir):
    best = rules.nearest(F.col("nearby"))
    return situation(spark, sf_dir).select("sample_id", best["id"].alias("nearest_uav_id"), best["min_sep_m"].alias("nearest_sep_m"))


@plans(f"""WITH {SITUATION_SQL}, {_FLAGS} SELECT sample_id, uav_id || ' battery=' || battery_pct || '%' || chr(10) || 'nearest=' || best.id || ' at ' || best.min_sep_m || 'm' || chr(10)
  || 'nearby (' || len(nearby) || '):' || chr(10) || array_to_string(list_transform(nearby, lambda x: '- ' || x.id || ' sep=' || x.min_sep_m || 'm route=' || x.route_intersect), chr(10)) || chr(10)
  || 'zones (' || len(zones) || '):' || chr(10) || array_to_string(list_transform(zones, lambda z: '- ' || z.zone_id || ' inside=' || z.inside_zone || ' over=' || z.over_limit_alt), chr(10)) AS prompt FROM a""")
def prompt_render(spark, sf_dir):
    text = rules.prompt(F.col("uav_id"), F.col("battery_pct"), F.col("nearby"), F.col("zones"))
    return situation(spark, sf_dir).select("sample_id", text.alias("prompt"))


_TEXT = plans.sql["prompt_render"].split(" SELECT sample_id, ", 1)[1].split(" AS prompt")[0]


@plans(f"""WITH {SITUATION_SQL}, {_FLAGS} SELECT sample_id, {_TEXT} || chr(10) || printf('at %.5f, %.5f, %dm, %dm/s', 45e0 + battery_pct / 1000e0, 5e0 - len(zones) / 63e0, 80 + len(nearby), 10 + len(zones)) || chr(10)
  || printf('route=%d low=%d critical=%d separation=50m', (len(list_filter(nearby, lambda x: x.route_intersect = 1)) > 0)::INT, (battery_pct < 20)::INT, (battery_pct < 15)::INT) AS prompt FROM a""")
def prompt_with_place(spark, sf_dir):
    rows = situation(spark, sf_dir)
    place = F.struct((45.0 + F.col("battery_pct") / 1000.0).alias("lat"), (5.0 - F.size("zones") / 63.0).alias("lon"), (80 + F.size("nearby")).alias("alt_m"), (10 + F.size("zones")).alias("speed_mps"))
    return rows.select("sample_id", rules.prompt(F.col("uav_id"), F.col("battery_pct"), F.col("nearby"), F.col("zones"), place).alias("prompt"))


_ANSWER = """answers AS (SELECT o_orderkey AS sample_id, 'UAV' || lpad(o_custkey::VARCHAR, 5, '0') AS uav_id,
  CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '返航' WHEN 2 THEN 'UAV00000，请返航' || chr(10) || '理由:x' WHEN 3 THEN 'UAV' || lpad(o_custkey::VARCHAR, 5, '0') || '，请返航' || chr(10) || 'because'
    WHEN 4 THEN 'UAV' || lpad(o_custkey::VARCHAR, 5, '0') || '，请飞' || chr(10) || '理由:x'
    ELSE chr(10) || ' UAV' || lpad(o_custkey::VARCHAR, 5, '0') || '，请悬停 ' || chr(13) || chr(10) || chr(10) || '理由: ' || repeat('低', o_orderkey % 90) END AS answer FROM orders)"""
_CHECK = """lines AS (SELECT *, list_filter(list_transform(string_split_regex(answer, '\\r\\n|\\n|\\r'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM answers),
said AS (SELECT *, regexp_extract(l[1], '^([A-Za-z0-9_]+)，请(悬停|原地降落|返航|正常飞行)$', 1) AS id, trim(substr(l[2], 4)) AS reason FROM lines)"""
_VERDICT = "CASE WHEN answer IS NULL THEN 'empty' WHEN len(l) <> 2 THEN 'not_two_lines' WHEN id = '' THEN 'bad_first_line' WHEN id <> uav_id THEN 'uav_id_mismatch' WHEN NOT starts_with(l[2], '理由:') THEN 'bad_reason_prefix' {long} ELSE 'ok' END"


def _answers(spark, sf_dir):
    uav = uav_name(F.col("o_custkey"))
    key = F.col("o_orderkey") % 8
    good = F.concat(F.lit("\n "), uav, F.lit("，请悬停 \r\n\n理由: "), F.repeat(F.lit("低"), (F.col("o_orderkey") % 90).cast("int")))
    text = F.when(key == 1, "返航").when(key == 2, "UAV00000，请返航\n理由:x").when(key == 3, F.concat(uav, F.lit("，请返航\nbecause"))).when(key == 4, F.concat(uav, F.lit("，请飞\n理由:x"))).when(key > 4, good)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), uav.alias("uav_id"), text.alias("answer"))


@plans(f"WITH {_ANSWER}, {_CHECK} SELECT sample_id, {_VERDICT.format(long='WHEN length(reason) > 50 THEN ' + chr(39) + 'reason_too_long' + chr(39))} AS strict, {_VERDICT.format(long='')} AS label FROM said")
def answer_validate(spark, sf_dir):
    uav, answer = F.col("uav_id"), F.col("answer")
    return _answers(spark, sf_dir).select("sample_id", rules.check_answer(uav, answer).alias("strict"), rules.check_answer(uav, answer, long_reasons=True).alias("label"))


@plans(f"""WITH {_ANSWER}, {_CHECK}, v AS (SELECT {_VERDICT.format(long='')} AS label, length(coalesce(answer, '')) AS said FROM said)
  SELECT label, count(*) AS calls, sum(40 + said)::BIGINT AS total_tokens FROM v GROUP BY label""")
def token_accounting(spark, sf_dir):
    """What calls cost, by what came of them: sums that tasks make first."""
    used = 40 + F.char_length(F.coalesce("answer", F.lit("")))
    rows = _answers(spark, sf_dir).select(rules.check_answer(F.col("uav_id"), F.col("answer"), long_reasons=True).alias("label"), used.alias("used"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("calls"), F.sum("used").alias("total_tokens"))


@plans("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@plans("""SELECT d.doc_id, to_json([{'role': 'user', 'content': d.lang || ' ' || d.source}, {'role': 'assistant', 'content': CASE l.toxic WHEN 1 THEN 'toxic' ELSE 'clean' END}])::VARCHAR AS messages
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def sft_join(spark, sf_dir):
    kept = table(spark, sf_dir, "labels").where("quality = 1")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(said("user", F.concat_ws(" ", "lang", "source")), said("assistant", F.when(F.col("toxic") == 1, "toxic").otherwise("clean")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(kept, "doc_id").select("doc_id", F.to_json(messages).alias("messages"))


@plans("SELECT count(*) AS n, count(*) FILTER (l.quality = 1) AS kept, count(*) FILTER (l.quality = 0) AS dropped, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def sft_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("kept"), F.count_if(F.col("quality") == 0).alias("dropped"), F.count_if(F.col("quality").isNull()).alias("missing"))


@plans("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def lastwins_dedupe(spark, sf_dir):
    return last_wins(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")
