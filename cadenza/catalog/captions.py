"""Caption and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import query
from cadenza.operators import captions as cp

D = vw.DUCK
S = vw.SHARED

HEADS = "|".join(cp.DOMAINS)


def domain_sql(d: str) -> str:
    rest = f"regexp_extract(clean, '(?is){d}\\s*\\n(.+)', 1)"
    cut = f"CASE WHEN regexp_matches({rest}, '(?is)^.+?\\n(?:{HEADS})') THEN regexp_extract({rest}, '(?is)^(.+?)\\n(?:{HEADS})', 1) ELSE {rest} END"
    return f"CASE WHEN {rest} <> '' THEN trim(regexp_replace({cut}, '\\s+', ' ', 'g')) END AS {d.replace(' ', '_')}"


D["parsed_captions"] = f"SELECT file, motion, response, {', '.join(domain_sql(d) for d in cp.DOMAINS)} FROM (SELECT *, replace(response, '*', '') AS clean FROM {{captions}})"
KEYS = [d.replace(" ", "_") for d in cp.DOMAINS]


@query("parse_domains", f"SELECT file, motion, {', '.join(KEYS)} FROM {{parsed_captions}}")
def parse_domains(v):
    return v.captions.select("file", "motion", cp.parse_domains(F.col("response")).alias("m")).select("file", "motion", "m.*")


@query("missing_domains", f"""
    SELECT file, motion, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT contains(lower(response), '**{d}**') THEN '{d}' END" for d in cp.DOMAINS)}], lambda h: h IS NOT NULL), '|') AS missing FROM {{captions}}""")
def missing_domains(v):
    return v.captions.select("file", "motion", F.array_join(cp.missing_headings(F.col("response")), "|").alias("missing"))


S["attempts"] = """
    SELECT file, motion, 1 AS attempt, text AS response FROM {captions}
    UNION ALL SELECT file, motion, 2, response FROM {captions} UNION ALL SELECT file, motion, 3, text || '!' FROM {captions}"""


@query("pick_valid_attempt", f"""
    WITH m AS (SELECT *, list_filter([{', '.join(f"CASE WHEN NOT contains(lower(response), '**{d}**') THEN '{d}' END" for d in cp.DOMAINS)}], lambda h: h IS NOT NULL) AS missing FROM {{attempts}})
    SELECT file, motion, coalesce(arg_min(response, attempt) FILTER (len(missing) = 0),
           '[警告] 经过' || max(attempt) || '次尝试仍缺少域: [''' || array_to_string(arg_max(missing, attempt), ''', ''') || ''']' || chr(10) || chr(10) || arg_max(response, attempt)) AS response,
           CAST(count(*) FILTER (len(missing) = 0) > 0 AS BIGINT) AS valid FROM m GROUP BY ALL""")
def pick_valid_attempt(v):
    return cp.pick_attempt(v.attempts, ["file", "motion"], "attempt", "response").withColumn("valid", F.col("valid").cast("bigint"))


@query("all_or_nothing_group", f"""
    WITH g AS (SELECT file, motion, list_filter([{', '.join(f"CASE WHEN {k} IS NULL THEN '{d}' END" for k, d in zip(KEYS, cp.DOMAINS, strict=True))}], lambda h: h IS NOT NULL) AS gaps FROM {{parsed_captions}})
    SELECT file, CAST(bool_and(len(gaps) = 0) AS BIGINT) AS accepted, CASE WHEN bool_and(len(gaps) = 0) THEN count(*) ELSE 0 END AS captions,
           coalesce('motion ' || min(motion) FILTER (len(gaps) > 0) || ' lacks: ' || array_to_string(arg_min(gaps, motion) FILTER (len(gaps) > 0), ', '), '') AS reason FROM g GROUP BY file""")
def all_or_nothing_group(v):
    good, rejected = cp.caption_ingest(v.captions, "file", "motion", "response")
    kept = good.groupBy("file").agg(F.lit(1).alias("accepted"), F.count(F.lit(1)).alias("captions"), F.lit("").alias("reason"))
    return kept.unionByName(rejected.select("file", F.lit(0).alias("accepted"), F.lit(0).cast("bigint").alias("captions"), "reason"))


S["cue_lists"] = "SELECT conv_id AS file, turn AS motion, text, turn % 4 AS frames FROM {conversations}"


@query("format_pose_cues", """
    WITH c AS (SELECT file, motion, frames, string_split(text, '.') AS cues FROM {cue_lists}),
         e AS (SELECT file, motion, frames, i, i // 2 + 1 AS n, cues[i + 1] AS c FROM (SELECT *, unnest(range(len(cues))) AS i FROM c))
    SELECT file, motion, string_agg(CASE
        WHEN i % 2 = 0 AND frames > n - 1 THEN '* **Pose ' || n || ' (sampled at frame ' || (n - 1) * 5 || '):** ' || c
        WHEN i % 2 = 0 THEN '* **Pose ' || n || ':** ' || c
        WHEN frames > n THEN '* **Trans ' || n || ' (from frame ' || (n - 1) * 5 || ' to ' || n * 5 || '):** ' || c
        ELSE '* **Trans ' || n || ':** ' || c END, chr(10) ORDER BY i) AS text FROM e GROUP BY ALL""")
def format_pose_cues(v):
    frames = F.when(F.col("frames") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("frames") - 1, F.lit(0)).cast("int")), lambda i: i * 5)).otherwise(F.array().cast("array<int>"))
    return v.cue_lists.select("file", "motion", cp.format_cues(F.split("text", r"\."), frames).alias("text"))


@query("prompt_insert", """
    SELECT file, motion, CASE WHEN cue = '' THEN base WHEN contains(base, '**Your Answer**')
        THEN split_part(base, '**Your Answer**', 1) || cue || chr(10) || '---' || chr(10) || chr(10) || '**Your Answer**' || split_part(base, '**Your Answer**', 2)
        ELSE base || cue || chr(10) || '---' || chr(10) || chr(10) || '**Your Answer**' END AS prompt
    FROM (SELECT file, motion, CASE WHEN motion % 3 = 0 THEN '' ELSE text END AS cue,
                 CASE WHEN file % 2 = 0 THEN 'Describe.' ELSE 'Describe: **Your Answer** here **Your Answer** cut' END AS base FROM {cue_lists})""")
def prompt_insert(v):
    base = F.when(F.col("file") % 2 == 0, "Describe.").otherwise("Describe: **Your Answer** here **Your Answer** cut")
    cue = F.when(F.col("motion") % 3 == 0, "").otherwise(F.col("text"))
    return v.cue_lists.select("file", "motion", cp.insert_cues(base, cue).alias("prompt"))
