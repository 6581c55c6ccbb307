"""Curation queries: typed records, gates, scores, fusion, order, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_even as he
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query, rounded
from cadenza.config import CurationConfig
from cadenza.functions import texts as tx
from cadenza.operators import curation as cur
from cadenza.operators import keywords as kw
from cadenza.plans import curation as plan

# word lists that occur in the given documents
CFG = CurationConfig(
    whitelist=("thth", "mente", "nder"),
    blacklist=("license", "schsch"),
    audio_boost=("ingth", "ción"),
    audio_penalty=("eaueau", "keitkei"),
    genres={"alpha": ("onon", "edwh"), "beta": ("zu", "heit"), "gamma": ("quequ", "ciónci"), "delta": ("reth",)},
    min_view_count=50,
)
WHITE = sorted({*CFG.whitelist, *[w for g in CFG.genres.values() for w in g]})

D = vw.DUCK


def hits(words, low="low"):
    tests = ", ".join(f"CASE WHEN contains({low}, '{w.lower()}') THEN '{w}' END" for w in words)
    return f"list_filter([{tests}], lambda h: h IS NOT NULL)"


def first_n(hit, n):
    return f"array_to_string({hit}[1:{n}], ', ')"


def any_hit(words):
    return "(" + " OR ".join(f"contains(low, '{w.lower()}')" for w in words) + ")"


D["items"] = "SELECT *, lower(title || ' ' || lang || ' ' || source) AS low FROM {candidates}"
D["hits"] = f"""
    SELECT pos, bvid, title, lang, source, search_query, duration_sec, view_count, publish_ts,
           {hits(WHITE)} AS white, {hits(sorted(CFG.blacklist))} AS black,
           {hits(CFG.audio_boost)} AS boost, {hits(CFG.audio_penalty)} AS penalty,
           list_filter([{", ".join(f"CASE WHEN {any_hit(CFG.genres[g])} THEN '{g}' END" for g in sorted(CFG.genres))}], lambda h: h IS NOT NULL) AS genres,
           {hits(sorted(w for g in CFG.genres.values() for w in g))} AS words
    FROM {{items}}"""
D["judged"] = f"""
    SELECT pos, bvid, title, lang, source, search_query, duration_sec, view_count, publish_ts,
           early IS NULL AND NOT late AS pass,
           CASE WHEN early IS NULL AND NOT late THEN {he('''(
                CASE WHEN len(white) > 0 THEN least(1.0, len(white) / 3.0) ELSE 0.1 END * 0.4
                + least(1.0, len(genres) * 0.5) * 0.35
                + CASE WHEN len(boost) > 0 THEN least(1.0, 0.7 + 0.3 * len(boost)) ELSE 0.5 END * 0.25)
                / (0.4 + 0.35 + 0.25)''')} ELSE 0.0 END AS score,
           CASE WHEN early IS NULL THEN genres ELSE [] END AS genres,
           CASE WHEN early IS NULL THEN words ELSE [] END AS words,
           early, late, white, boost, penalty
    FROM (SELECT *, CASE WHEN duration_sec < 30 THEN 'REJECT:duration_too_short(' || CAST(CAST(duration_sec AS BIGINT) AS VARCHAR) || 's < 30s)'
                         WHEN duration_sec > 300 THEN 'REJECT:duration_too_long(' || CAST(CAST(duration_sec AS BIGINT) AS VARCHAR) || 's > 300s)'
                         WHEN view_count < 50 THEN 'REJECT:view_count_too_low(' || CAST(view_count AS VARCHAR) || ' < 50)'
                         WHEN len(black) > 0 THEN 'REJECT:blacklist_hit(' || {first_n('black', 5)} || ')' END AS early,
                 len(penalty) > 0 AS late
          FROM {{hits}})"""
D["unique_passed"] = """
    SELECT * FROM {judged} WHERE pass QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY pos) = 1"""
D["pstats"] = """
    SELECT clip, count(*) AS n_frames, avg(CASE WHEN person_count >= 1 THEN 1.0 ELSE 0.0 END) AS valid_ratio,
           avg(CASE WHEN person_count = 1 THEN 1.0 ELSE 0.0 END) AS single_ratio,
           avg(CASE WHEN person_count >= 2 THEN 1.0 ELSE 0.0 END) AS crowded_ratio,
           coalesce(avg(CASE WHEN person_count >= 1 THEN area END), 0.0) AS avg_area
    FROM {detections} GROUP BY clip"""
D["mscore"] = f"""
    SELECT clip, CASE WHEN count(*) >= 5 THEN {he("0.7 * least(1.0, avg(step) / 0.06) + 0.3 * least(1.0, stddev_pop(area) / 0.05)")} END AS motion_score
    FROM (SELECT clip, area, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS step
          FROM {{detections}} WHERE person_count = 1 WINDOW w AS (PARTITION BY clip ORDER BY frame))
    GROUP BY clip"""
D["media_keys"] = "SELECT DISTINCT pos % 300 AS clip FROM {candidates}"
D["solo"] = f"""
    SELECT clip, {he("valid_ratio")} AS valid_ratio, {he("single_ratio")} AS single_ratio,
           {he("crowded_ratio")} AS crowded_ratio, {he("avg_area")} AS avg_area, motion_score,
           CASE WHEN n_frames IS NULL THEN 0.0 WHEN valid_ratio < 0.9 THEN 0.05
                WHEN crowded_ratio > 0.1 THEN greatest(0.0, 0.4 - (crowded_ratio - 0.1) * 1.5) ELSE good END AS solo_score,
           CASE WHEN n_frames IS NULL OR valid_ratio < 0.9 THEN 'no_person' WHEN crowded_ratio > 0.1 THEN 'likely_multi'
                WHEN good >= 0.75 THEN 'likely_solo' WHEN good >= 0.45 THEN 'uncertain' ELSE 'likely_multi' END AS solo_label
    FROM (SELECT *, {he('''CASE WHEN motion_score IS NOT NULL THEN least(1.0, avg_area / 0.2) * 0.5 + motion_score * 0.5
                               ELSE least(1.0, avg_area / 0.2) END''')} AS good
          FROM {{media_keys}} LEFT JOIN {{pstats}} USING (clip) LEFT JOIN {{mscore}} USING (clip))"""
D["fused"] = f"""
    SELECT *, CASE
        WHEN solo_label = 'likely_multi' AND final_score < 0.3 THEN 'drop'
        WHEN solo_label = 'no_person' AND au < 0.3 THEN 'drop'
        WHEN audio_label = 'speech_heavy' AND so > 0.75 THEN 'review'
        WHEN solo_label = 'uncertain' AND au >= 0.6 AND final_score >= 0.3 THEN 'review'
        WHEN NOT vision_checked AND metadata_score > 0.6 THEN 'review'
        WHEN final_score >= 0.65 AND audio_checked AND coalesce(speech, 0.0) > 0.35 THEN 'review'
        WHEN final_score >= 0.65 THEN 'keep' WHEN final_score >= 0.3 THEN 'review' ELSE 'drop' END AS rec
    FROM (SELECT *, {he("(so * 0.55 + au * 0.3 + metadata_score * 0.15) / (0.55 + 0.3 + 0.15)")} AS final_score
          FROM (SELECT u.pos, u.bvid, u.search_query, u.duration_sec, u.pass, u.score AS metadata_score, u.genres,
                       s.clip IS NOT NULL AS vision_checked, a.clip IS NOT NULL AS audio_checked,
                       CASE WHEN s.clip IS NOT NULL THEN s.solo_score ELSE 0.5 END AS so,
                       CASE WHEN a.clip IS NOT NULL THEN a.audio_score ELSE 0.5 END AS au,
                       coalesce(s.solo_label, '') AS solo_label, coalesce(a.audio_label, '') AS audio_label, a.speech
                FROM {{unique_passed}} u
                LEFT JOIN (SELECT * FROM {{solo}} WHERE valid_ratio IS NOT NULL) s ON s.clip = u.pos % 300
                LEFT JOIN {{audio_judged}} a ON a.clip = u.pos % 300))"""


# ---- Spark side ------------------------------------------------------------------------
def items(v):
    return v.candidates.withColumn("tags", F.array("lang", "source"))


def judged(v):
    return cur.metadata_gate(items(v), CFG)


def unique(v):
    kept = ["search_query", "duration_sec", "metadata_filter_pass", "metadata_score", "matched_genres"]
    return plan.unique_passed(items(v), CFG, columns=kept)


def media_keys(v):
    return v.candidates.select((F.col("pos") % 300).alias("clip")).distinct()


def fused(v):
    from cadenza.catalog.audio import audio_judged

    solo = cur.solo_score(v.detections.select("clip").distinct(), v.detections, "clip", CFG)
    records = unique(v).withColumn("clip", F.col("pos") % 300)
    return plan.score_and_fuse(records, solo, audio_judged(v), "clip", CFG)


JOINED = lambda c: F.array_join(c, "|")


@query("raw_item_normalize", f"""
    SELECT bvid, CAST(aid AS VARCHAR) AS aid, regexp_replace(title, '<[^>]+>', '', 'g') AS title,
           CASE WHEN list_bool_and(list_transform(p, lambda e: e IS NOT NULL)) THEN CAST(CASE len(p)
                WHEN 2 THEN p[1] * 60 + p[2] WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] ELSE p[-1] END AS DOUBLE) ELSE 0.0 END AS duration_sec,
           CAST(pubdate AS BIGINT) AS publish_ts,
           coalesce(TRY_CAST(replace(play, ',', '') AS BIGINT), 0) AS view_count,
           CASE WHEN pic <> '' AND NOT starts_with(pic, 'http') THEN 'https:' || pic ELSE pic END AS cover_url,
           coalesce(TRY_CAST(typeid AS BIGINT), 0) AS tid,
           array_to_string(list_filter(list_transform(string_split(tag, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
           author AS search_query
    FROM (SELECT *, list_transform(string_split(trim(duration), ':'), lambda e: TRY_CAST(trim(e) AS BIGINT)) AS p FROM {{raw_items}})""")
def raw_item_normalize(v):
    out = cur.normalize_items(v.raw_items, F.col("author"))
    return out.select("bvid", "aid", "title", "duration_sec", "publish_ts", "view_count", "cover_url", "tid",
                      JOINED("tags").alias("tags"), "search_query")


@query("parse_duration", """
    SELECT bvid, duration,
           CASE WHEN list_bool_and(list_transform(p, lambda e: e IS NOT NULL)) THEN CAST(CASE len(p)
                WHEN 2 THEN p[1] * 60 + p[2] WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] ELSE p[-1] END AS DOUBLE) ELSE 0.0 END AS seconds
    FROM (SELECT *, list_transform(string_split(trim(duration), ':'), lambda e: TRY_CAST(trim(e) AS BIGINT)) AS p FROM {raw_items})""")
def parse_duration(v):
    return v.raw_items.select("bvid", "duration", tx.duration_seconds(F.col("duration")).alias("seconds"))


@query("strip_markup", """
    SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS body FROM {pages}""")
def strip_markup(v):
    return v.pages.select("page_id", tx.strip_markup(F.col("html")).alias("body"))


@query("normalize_title", """
    SELECT pos, lower(trim(regexp_replace(translate(title, 'ＡｂＣ！　', 'AbC! '), '\\s+', ' ', 'g'))) AS title
    FROM (SELECT pos, '　Ａ' || title || '　 Ｃ！ ' AS title FROM {candidates})""")
def normalize_title(v):
    wide = F.concat(F.lit("　Ａ"), "title", F.lit("　 Ｃ！ "))
    return v.candidates.select("pos", tx.normalize_title(wide).alias("title"))


@query("publish_time_iso", """
    SELECT bvid, CASE WHEN pubdate > 0 THEN strftime(make_timestamp(pubdate * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS publish_time
    FROM {raw_items}""")
def publish_time_iso(v):
    return v.raw_items.select("bvid", tx.publish_time_iso(F.col("pubdate")).alias("publish_time"))


@query("keyword_hits", f"""
    SELECT pos, array_to_string({hits(WHITE)}, '|') AS hits, len({hits(WHITE)}) AS n FROM {{items}}""")
def keyword_hits(v):
    low = F.lower(F.concat_ws(" ", "title", "lang", "source"))
    base = v.candidates.select("pos", low.alias("low"))
    h = base.select("pos", tx.keyword_hits(F.col("low"), WHITE).alias("h"))
    return h.select("pos", JOINED("h").alias("hits"), F.size("h").alias("n"))


@query("duration_view_gate", """
    SELECT pos, pass, early AS reason FROM {judged} WHERE early LIKE 'REJECT:dur%' OR early LIKE 'REJECT:view%'""")
def duration_view_gate(v):
    reason = F.get("metadata_filter_reasons", F.lit(0))
    out = judged(v).select("pos", F.col("metadata_filter_pass").alias("pass"), reason.alias("reason"))
    return out.filter(F.col("reason").like("REJECT:dur%") | F.col("reason").like("REJECT:view%"))


@query("blacklist_gate", "SELECT pos, early AS reason FROM {judged} WHERE early LIKE 'REJECT:black%'")
def blacklist_gate(v):
    reason = F.get("metadata_filter_reasons", F.lit(0))
    return judged(v).select("pos", reason.alias("reason")).filter(F.col("reason").like("REJECT:black%"))


@query("whitelist_score", f"""
    SELECT pos, CASE WHEN len(white) > 0 THEN 'PASS:whitelist_hit(' || {first_n('white', 5)} || ')' ELSE 'WARN:no_whitelist_keyword_hit' END AS reason
    FROM {{judged}} WHERE early IS NULL""")
def whitelist_score(v):
    reason = F.get("metadata_filter_reasons", F.lit(0))
    out = judged(v).filter(F.size("metadata_filter_reasons") > 1)
    return out.select("pos", reason.alias("reason"))


@query("genre_match", "SELECT pos, array_to_string(genres, '|') AS genres, array_to_string(words, '|') AS words FROM {judged}")
def genre_match(v):
    return judged(v).select("pos", JOINED("matched_genres").alias("genres"), JOINED("matched_keywords").alias("words"))


@query("audio_keyword_gate", f"""
    SELECT pos, CASE WHEN late THEN 'REJECT:audio_penalty_hit(' || {first_n('penalty', 3)} || ')'
                     ELSE 'AUDIO_BOOST:' || {first_n('boost', 3)} END AS reason
    FROM {{judged}} WHERE early IS NULL AND (late OR len(boost) > 0)""")
def audio_keyword_gate(v):
    reason = F.get("metadata_filter_reasons", F.lit(2))
    out = judged(v).filter(F.size("metadata_filter_reasons") > 1).select("pos", reason.alias("reason"))
    return out.filter(F.startswith("reason", F.lit("REJECT:audio")) | F.startswith("reason", F.lit("AUDIO_BOOST")))


@query("metadata_score", "SELECT pos, CAST(pass AS BIGINT) AS pass, score AS metadata_score FROM {judged}")
def metadata_score(v):
    return judged(v).select("pos", F.col("metadata_filter_pass").cast("bigint").alias("pass"), "metadata_score")


@query("first_n_hits", f"SELECT pos, {first_n('white', 5)} AS five, {first_n('white', 3)} AS three FROM {{hits}}")
def first_n_hits(v):
    low = F.lower(F.concat_ws(" ", "title", "lang", "source"))
    h = v.candidates.select("pos", low.alias("low")).select("pos", tx.keyword_hits(F.col("low"), WHITE).alias("h"))
    return h.select("pos", tx.first_n(F.col("h"), 5).alias("five"), tx.first_n(F.col("h"), 3).alias("three"))


@query("pass_reject_partition", """
    SELECT CAST(pass AS BIGINT) AS pass, count(*) AS n, sum(duration_sec) / 3600 AS hours FROM {judged} GROUP BY pass""")
def pass_reject_partition(v):
    return judged(v).groupBy(F.col("metadata_filter_pass").cast("bigint").alias("pass")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("duration_sec") / 3600).alias("hours")
    )


@query("exact_dedup_first", """
    SELECT bvid, min(pos) AS pos, count(*) - 1 AS removed FROM {candidates} GROUP BY bvid""")
def exact_dedup_first(v):
    kept = cur.first_per_key(v.candidates.select("bvid", "pos"), "bvid", "pos")
    return kept.join(cur.duplicate_map(v.candidates, "bvid"), "bvid", "left").select(
        "bvid", "pos", F.coalesce("removed", F.lit(0)).alias("removed")
    )


@query("person_stats", f"""
    SELECT clip, n_frames, {he('valid_ratio')} AS valid_ratio, {he('single_ratio')} AS single_ratio,
           {he('crowded_ratio')} AS crowded_ratio, {he('avg_area')} AS avg_area FROM {{pstats}}""")
def person_stats(v):
    s = cur.person_stats(v.detections, "clip")
    return s.withColumns({c: tx.python_round(F.col(c), 4) for c in ("valid_ratio", "single_ratio", "crowded_ratio", "avg_area")})


@query("motion_score", "SELECT clip, motion_score FROM {mscore}")
def motion_score(v):
    return cur.motion_score(v.detections, "clip")


@query("solo_score", f"""
    SELECT clip, valid_ratio, single_ratio, crowded_ratio, avg_area, motion_score, {hu('solo_score')} AS solo_score, solo_label FROM {{solo}}""")
def solo_score(v):
    return rounded(cur.solo_score(media_keys(v), v.detections, "clip", CFG), "solo_score")


@query("fusion_score", "SELECT bvid, final_score FROM {fused}")
def fusion_score(v):
    return fused(v).select("bvid", "final_score")


@query("fusion_rules", "SELECT bvid, solo_label, audio_label, rec FROM {fused}")
def fusion_rules(v):
    return fused(v).select("bvid", "solo_label", "audio_label", F.col("final_recommendation").alias("rec"))


@query("rank_by_final_score", """
    SELECT bvid, final_score, row_number() OVER (ORDER BY final_score DESC, pos) AS rank FROM {fused}""")
def rank_by_final_score(v):
    return cur.rank_by_score(fused(v), "final_score", "pos").select("bvid", "final_score", "rank")


@query("query_summary", """
    SELECT CASE WHEN coalesce(search_query, '') = '' THEN 'unknown' ELSE search_query END AS search_query, count(*) AS total,
           count(*) FILTER (pass) AS metadata_passed, count(*) FILTER (rec = 'keep') AS keep,
           count(*) FILTER (rec = 'review') AS review, count(*) FILTER (rec = 'drop') AS drop
    FROM {fused} GROUP BY 1""")
def query_summary(v):
    return cur.query_summary(fused(v))


@query("genre_coverage", """
    SELECT genre, count(*) AS total_matched, count(*) FILTER (rec = 'keep') AS keep, count(*) FILTER (rec = 'review') AS review
    FROM (SELECT unnest(genres) AS genre, rec FROM {fused}) GROUP BY genre""")
def genre_coverage(v):
    return cur.genre_coverage(fused(v))


@query("duration_summary", f"""
    SELECT split, count(r.rec) AS count, {he('coalesce(sum(greatest(0.0, duration_sec)), 0.0)', 2)} AS total_duration_sec,
           {he('coalesce(sum(greatest(0.0, duration_sec)), 0.0) / 3600.0')} AS total_duration_hours,
           {he('coalesce(avg(greatest(0.0, duration_sec)), 0.0)', 2)} AS avg_duration_sec,
           {he('coalesce(avg(greatest(0.0, duration_sec)), 0.0) / 60.0', 2)} AS avg_duration_min
    FROM (VALUES ('all'), ('keep'), ('review'), ('drop')) s(split)
    LEFT JOIN {{fused}} r ON s.split = 'all' OR s.split = r.rec GROUP BY split""")
def duration_summary(v):
    return cur.duration_summary(fused(v))


@query("status_counts", f"""
    SELECT status, n, {he('100.0 * sum(ok) OVER () / sum(n) OVER ()', 1)} AS pass_rate
    FROM (SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS ok FROM {{orders}} GROUP BY 1)""")
def status_counts(v):
    return cur.status_counts(v.orders, F.col("o_orderstatus"), F.col("o_orderstatus") != "O")


@query("running_total_cutoff", """
    SELECT bvid, pos, running_total FROM (
        SELECT bvid, pos, duration_sec, sum(duration_sec) OVER (ORDER BY pos) AS running_total
        FROM (SELECT * FROM {candidates} QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY pos) = 1))
    WHERE running_total - duration_sec < 72000""")
def running_total_cutoff(v):
    records = v.candidates.select("bvid", "pos", "duration_sec")
    out = cur.running_total_cutoff(records, "bvid", "pos", "duration_sec", 5.0 * 4.0 * 3600)
    return out.select("bvid", "pos", "running_total")


@query("fetch_selection", """
    SELECT bvid FROM {fused} LEFT JOIN {labels} ON doc_id = pos WHERE rec IN ('keep', 'review') AND final_score >= 0.35 AND doc_id IS NULL""")
def fetch_selection(v):
    import dataclasses

    cfg = dataclasses.replace(CFG, download_review=True, download_min_fusion_score=0.35)
    local = v.labels.select(F.col("doc_id").alias("pos"), F.lit("present").alias("local_path"))
    return cur.fetch_selection(fused(v).join(local, "pos", "left"), cfg).select("bvid")


@query("keyword_automaton", f"""
    SELECT pos, array_to_string({hits(WHITE)}, '|') AS white, array_to_string({hits(sorted(CFG.blacklist))}, '|') AS black,
           array_to_string({hits(CFG.audio_boost)}, '|') AS boost, array_to_string({hits(CFG.audio_penalty)}, '|') AS penalty FROM {{items}}""")
def keyword_automaton(v):
    lists = {"white": WHITE, "black": sorted(CFG.blacklist), "boost": CFG.audio_boost, "penalty": CFG.audio_penalty}
    found = v.candidates.select("pos", kw.listed_hits(F.lower(F.concat_ws(" ", "title", "lang", "source")), lists).alias("h"))
    return found.select("pos", *[JOINED(f"h.{n}").alias(n) for n in lists])
