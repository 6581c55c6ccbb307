"""Song documents, training records and generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query
from cadenza.operators import selection
from cadenza.operators import captions as cp

D = vw.DUCK
S = vw.SHARED

LINE = "'Segment ' || n || ': ' || printf('%.2f', start_sec) || ' - ' || printf('%.2f', end_sec)"
# trims every kind of white space at both ends
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


@query("segmentation_text", f"SELECT song, string_agg({LINE}, chr(10) ORDER BY n) AS text FROM {{song_sections}} GROUP BY song")
def segmentation_text(v):
    line = cp.segmentation_line(F.col("n"), F.col("start_sec"), F.col("end_sec"))
    return cp.ordered_text(v.song_sections, ["song"], "n", line, "text", "\n")


@query("movement_tag_text", "SELECT song, string_agg('Movement ' || n || ': ' || text || '. ' || chr(10), '' ORDER BY n) AS text FROM {song_sections} GROUP BY song")
def movement_tag_text(v):
    line = F.concat(F.lit("Movement "), F.col("n").cast("string"), F.lit(": "), "text", F.lit(". \n"))
    return cp.ordered_text(v.song_sections, ["song"], "n", line, "text", "")


ADVICE = ("As a choreographer preparing movement for this music, I will consider the musical style, rhythmic feel, and mood (as implied by the key), "
          "as well as the musical development indicated by the chord progression, when arranging motion and transitions.")


@query("sentence_summary_text", f"""
    WITH m AS (SELECT song, min(start_sec) AS s, max(end_sec) AS e, string_agg('***Movement ' || n || '***: ' || printf('%.2f', start_sec) || ' - ' || printf('%.2f', end_sec) || chr(10)
               || 'simple tag: ' || text || chr(10) || 'torso: ' || chr(10) || chr(10), '' ORDER BY n) AS movements, min(text) AS synthesis FROM {{song_sections}} GROUP BY song)
    SELECT song, 'This is a Break-style music segment lasting ' || printf('%.2f', e - s) || ' seconds, in key C, with chord progression C-G, and tempo '
           || CASE WHEN song % 3 = 0 THEN 'None' ELSE CAST(80 + song AS VARCHAR) END || ' BPM. {ADVICE}' || chr(10) || chr(10) || 'High-level movement synthesis:' || chr(10) || synthesis
           || chr(10) || chr(10) || 'Specific movement instructions for the model:' || chr(10) || chr(10) || movements AS summary FROM m""")
def sentence_summary_text(v):
    block = cp.movement_block(F.col("n"), F.col("start_sec"), F.col("end_sec"), {"simple tag": F.col("text"), "torso": F.lit(None).cast("string")})
    s = v.song_sections
    texts = cp.ordered_text(s, ["song"], "n", block, "movements", "")
    span = s.groupBy("song").agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("e"), F.min("text").alias("synthesis"))
    bpm = F.when(F.col("song") % 3 != 0, F.col("song") + 80)
    out = cp.sentence_summary(F.lit("Break"), F.col("s"), F.col("e"), F.lit("C"), F.lit("C-G"), bpm, F.col("synthesis"), F.col("movements"))
    return texts.join(span, "song").select("song", out.alias("summary"))


STRICT = "(?s)High-level movement synthesis:\\s*(.*?)\\s*Specific movement instructions for the model"
D["sections"] = f"""
    SELECT song, string_agg(CASE WHEN regexp_matches(sentence_summary, '{STRICT}') THEN {LINE} || '.' || chr(10) || {STRIP(f"regexp_extract(sentence_summary, '{STRICT}', 1)")} || chr(10) ELSE '' END, '' ORDER BY n) AS sections
    FROM {{sentences}} GROUP BY song"""
D["song_docs"] = """
    SELECT song, chr(10) || '## Overall Musical Characteristics' || chr(10) || chr(10) || 'mood ' || song || chr(10) || chr(10) || chr(10) || '## Musical Structure and Segment Relationships'
           || chr(10) || chr(10) || 'parts' || chr(10) || chr(10) || chr(10) || '## Choreographic Perspective and Design Intent' || chr(10) || chr(10) || 'intent' || chr(10) || chr(10) || chr(10)
           || '## Segment-Level Choreographic Summaries' || chr(10) || chr(10) || sections || chr(10) AS summary FROM {sections}"""


def song_docs(v):
    texts = cp.section_texts(v.sentences, "song", "n")
    mood = F.concat(F.lit("mood "), F.col("song").cast("string"))
    return texts.select("song", cp.song_summary(mood, F.lit("parts"), F.lit("intent"), F.col("sections")).alias("summary"))


@query("song_summary_text", "SELECT song, summary FROM {song_docs}")
def song_summary_text(v):
    return song_docs(v)


@query("extract_synthesis", f"""
    SELECT song, n, {STRIP(f"regexp_extract(cut, '(?is)High-level movement synthesis:(.*)', 1)")} AS synthesis
    FROM (SELECT song, n, CASE WHEN regexp_matches(sentence_summary, '(?i)Specific movement instructions') THEN regexp_extract(sentence_summary, '(?is)^(.*?)Specific movement instructions', 1) ELSE sentence_summary END AS cut FROM {{sentences}})""")
def extract_synthesis(v):
    return v.sentences.select("song", "n", cp.extract_synthesis(F.col("sentence_summary")).alias("synthesis"))


D["seg_responses"] = f"""
    WITH c AS (SELECT song, n, regexp_extract(sentence_summary, '(?is)^(.*?)High-level movement synthesis:', 1) AS head,
                      CASE WHEN contains(sentence_summary, 'Specific movement instructions') THEN regexp_extract(sentence_summary, '(?is)Specific movement instructions for the model:(.*)', 1) END AS answer FROM {{sentences}})
    SELECT song, n, CASE WHEN answer IS NOT NULL THEN '<think>' || chr(10) || {STRIP('head')} || chr(10) || 'Hence, the final answer is:' || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || {STRIP('answer')} || chr(10) || '</answer>'
           ELSE '<think>' || chr(10) || {STRIP('head')} || chr(10) || '</think>' END AS response FROM c"""
D["song_responses"] = f"""
    SELECT song, '<think>' || chr(10) || {STRIP("split_part(summary, '## Segment-Level Choreographic Summaries', 1)")} || chr(10) || 'Hence, the final answer is:' || chr(10) || '</think>' || chr(10)
           || '<answer>' || chr(10) || {STRIP("split_part(summary, '## Segment-Level Choreographic Summaries', 2)")} || chr(10) || '</answer>' AS response FROM {{song_docs}}"""


@query("assistant_response", """
    SELECT 'segment' AS kind, song, n, response FROM {seg_responses} UNION ALL SELECT 'song', song, 0, response FROM {song_responses}""")
def assistant_response(v):
    seg = v.sentences.select(F.lit("segment").alias("kind"), "song", "n", cp.segment_response(F.col("sentence_summary")).alias("response"))
    song = song_docs(v).select(F.lit("song").alias("kind"), "song", F.lit(0).cast("bigint").alias("n"), cp.song_response(F.col("summary")).alias("response"))
    return seg.unionByName(song)


@query("strip_reasoning", f"SELECT song, n, {STRIP('''regexp_replace(response, '(?s)<think>.*?</think>\\s*', '', 'g')''')} AS response FROM {{seg_responses}}")
def strip_reasoning(v):
    return v.sentences.select("song", "n", cp.strip_reasoning(cp.segment_response(F.col("sentence_summary"))).alias("response"))


TEMPLATE = "The audio is the background music for a {genre}-style dance.\nIt is divided into several segments:\n{segmentation}\nFollow it."


@query("conversation_record", f"""
    WITH s AS (SELECT song, string_agg({LINE}, chr(10) ORDER BY n) AS segmentation FROM {{song_sections}} GROUP BY song)
    SELECT r.song, '[user:text=' || 'The audio is the background music for a Break-style dance.' || chr(10) || 'It is divided into several segments:' || chr(10) || segmentation || chr(10) || 'Follow it.'
           || '][user:audio=audio/' || r.song || '.mp3][assistant:text=' || response || ']' AS record FROM {{song_responses}} r JOIN s USING (song)""")
def conversation_record(v):
    line = cp.segmentation_line(F.col("n"), F.col("start_sec"), F.col("end_sec"))
    seg = cp.ordered_text(v.song_sections, ["song"], "n", line, "segmentation", "\n")
    user = cp.fill_template(TEMPLATE, genre=F.lit("Break"), segmentation=F.col("segmentation"))
    audio = F.concat(F.lit("audio/"), F.col("song").cast("string"), F.lit(".mp3"))
    records = song_docs(v).join(seg, "song").select("song", cp.conversation(user, audio, cp.song_response(F.col("summary"))).alias("c"))
    shown = F.flatten(F.transform("c", lambda t: F.transform(t["content"], lambda p: F.concat(
        F.lit("["), t["role"], F.lit(":"), p["type"], F.lit("="), F.coalesce(p["text"], p["path"]), F.lit("]")))))
    return records.select("song", F.array_join(shown, "").alias("record"))


S["song_moves"] = """
    SELECT conv_id AS song, 20 * turn AS start_frame, 20 * turn + 20 AS end_frame, text AS tag, CASE WHEN role = 'user' THEN text END AS torso FROM {conversations}"""


@query("onestage_response", """
    SELECT song, '<answer>' || chr(10) || string_agg('* **Movement ' || i || ' (' || printf('%.2f', start_frame / 30.0) || ' - ' || printf('%.2f', end_frame / 30.0) || '):**' || chr(10)
           || chr(10) || '  **simple tag**: ' || tag || chr(10) || '  **torso**: ' || coalesce(torso, 'N/A') || chr(10), chr(10) ORDER BY i) || chr(10) || '</answer>' AS response
    FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY start_frame) AS i FROM {song_moves}) GROUP BY song""")
def onestage_response(v):
    return cp.onestage_response(v.song_moves, "song", "start_frame", "end_frame", {"simple tag": "tag", "torso": "torso"})


@query("nest_segments", """
    SELECT clip, string_agg(bar || ':' || segs, ';' ORDER BY bar) AS nested, count(*) AS bars FROM (
        SELECT clip, motion // 3 AS bar, string_agg(start_frame || '-' || end_frame, ',' ORDER BY motion) AS segs FROM {segments} GROUP BY ALL) GROUP BY clip""")
def nest_segments(v):
    rows = v.segments.withColumn("bar", F.floor(F.col("motion") / 3).cast("bigint"))
    nested = cp.nest_segments(rows, "clip", "bar", "motion", ["motion", "start_frame", "end_frame"])
    show = F.transform("segments", lambda b: F.concat(b["bar"].cast("string"), F.lit(":"), F.array_join(
        F.transform(b["sentence"], lambda s: F.concat(s["start_frame"].cast("string"), F.lit("-"), s["end_frame"].cast("string"))), ",")))
    return nested.select("clip", F.array_join(show, ";").alias("nested"), F.size("segments").alias("bars"))


@query("clip_key", "SELECT song, n, 'song' || song || '_' || printf('%.2f', start_sec) || '_' || printf('%.2f', end_sec) AS clip_key FROM {song_sections}")
def clip_key(v):
    stem = F.concat(F.lit("song"), F.col("song").cast("string"))
    return v.song_sections.select("song", "n", cp.clip_key(stem, F.col("start_sec"), F.col("end_sec")).alias("clip_key"))


@query("dataset_concat", """
    SELECT kind, song, n, start_sec, response FROM (
        SELECT 'segment' AS kind, song, n, start_sec, text AS response FROM {song_sections}
        UNION ALL SELECT 'song', song, NULL, NULL, response FROM {song_responses})""")
def dataset_concat(v):
    songs = song_docs(v).select("song", cp.song_response(F.col("summary")).alias("response"))
    segs = v.song_sections.select("song", "n", "start_sec", F.col("text").alias("response"))
    return cp.dataset_concat(songs, segs).select("kind", "song", "n", "start_sec", "response")


# ---- generated text --------------------------------------------------------------------
D["answers"] = f"""
    SELECT song, turn, {STRIP(f'''regexp_replace({STRIP("CASE WHEN regexp_matches(output, '(?is)<answer>.*</answer>') THEN regexp_extract(output, '(?is)<answer>(.*?)</answer>', 1) ELSE output END")}, '(?i)</?think>|</?answer>', '', 'g')''')} AS answer FROM {{generated}}"""


@query("extract_answer", "SELECT song, turn, answer FROM {answers}")
def extract_answer(v):
    return v.generated.select("song", "turn", cp.extract_answer(F.col("output")).alias("answer"))


HEAD = "(?i)segment\\s+\\d+(?::\\s*[\\d.]+\\s*-\\s*[\\d.]+)?"
D["song_parts"] = f"""
    WITH a AS (SELECT song, turn, answer, regexp_extract_all(answer, '{HEAD}') AS heads, string_split_regex(answer, '{HEAD}') AS bodies FROM {{answers}})
    SELECT song, turn, i - 1 AS part, CASE WHEN len(heads) = 0 THEN 1 ELSE CAST(regexp_extract(heads[i], '(?i)segment\\s+(\\d+)', 1) AS BIGINT) END AS n,
           CASE WHEN len(heads) = 0 THEN {STRIP('answer')} ELSE regexp_replace({STRIP('bodies[i + 1]')}, '^[:：\\-\\s]+', '') END AS choreography
    FROM (SELECT *, unnest(range(1, greatest(len(heads), 1) + 1)) AS i FROM a)"""


def song_parts(v):
    a = v.generated.select("song", "turn", cp.extract_answer(F.col("output")).alias("answer"))
    keyed = a.withColumn("_key", F.struct("song", "turn"))
    return cp.parse_song_segments(keyed, "_key", "answer").select("_key.*", "part", "n", "choreography")


@query("parse_song_segments", "SELECT song, turn, part, n, choreography FROM {song_parts}")
def parse_song_segments(v):
    return song_parts(v)


@query("segment_number_join", f"""
    SELECT p.song, p.turn, p.part, {hu('s.start_sec')} AS start_sec, {hu('s.end_sec')} AS end_sec, p.choreography FROM {{song_parts}} p JOIN {{song_sections}} s ON s.song = p.song AND s.n = p.n""")
def segment_number_join(v):
    times = v.song_sections.select("song", "n", "start_sec", "end_sec")
    return selection.segment_times(song_parts(v), times, "song", "n").select("song", "turn", "part", "start_sec", "end_sec", "choreography")


@query("format_segments", f"""
    SELECT song, string_agg('Segment ' || n || ': ' || printf('%.2f', start_sec) || ' - ' || printf('%.2f', end_sec) || chr(10)
           || CASE WHEN {STRIP('t')} = '' THEN 'The choreography continues with matching dynamics.' WHEN regexp_matches({STRIP('t')}, '[.!?]$') THEN {STRIP('t')} ELSE {STRIP('t')} || '.' END, chr(10) || chr(10) ORDER BY n) AS output
    FROM (SELECT *, CASE WHEN n = 2 THEN '  ' WHEN n = 3 THEN rtrim(text, '.') ELSE text || chr(10) END AS t FROM {{song_sections}}) GROUP BY song""")
def format_segments(v):
    text = F.when(F.col("n") == 2, "  ").when(F.col("n") == 3, F.rtrim("text", F.lit("."))).otherwise(F.concat("text", F.lit("\n")))
    rows = v.song_sections.select("song", (F.col("n") - 1).alias("pos"), "start_sec", "end_sec", text.alias("choreography"))
    return cp.format_segments(rows, "song", "pos")


@query("generation_sufficient", """
    WITH w AS (SELECT g.song, g.turn, count(*) AS want FROM {generated} g JOIN {song_sections} s ON s.song = g.song GROUP BY ALL),
         g AS (SELECT song, turn, count(*) AS got, count(*) FILTER (trim(choreography) = '') AS blank FROM {song_parts} GROUP BY ALL)
    SELECT song || '/' || turn AS song, CAST(coalesce(got = want AND blank = 0, FALSE) AS BIGINT) AS sufficient FROM w LEFT JOIN g USING (song, turn)""")
def generation_sufficient(v):
    named = F.concat_ws("/", F.col("song").cast("string"), F.col("turn").cast("string")).alias("song")
    expected = v.generated.select("song", "turn").join(v.song_sections.select("song", "n"), "song").select(named, "n")
    out = cp.generation_sufficient(song_parts(v).select(named, "choreography"), expected, "song")
    return out.withColumn("sufficient", F.col("sufficient").cast("bigint"))


TRAIN = "(?i)\\*\\s+\\*{2,3}Movement\\s+\\d+\\s*\\(\\d+\\.?\\d*\\s*[-–—]\\s*\\d+\\.?\\d*\\)\\s*:{1,3}\\*{0,3}"
COMPACT = "(?i)\\*{2,3}Movement\\s*\\d+\\*{2,3}:\\s*\\d+\\.?\\d*\\s*[-–—]\\s*\\d+\\.?\\d*"
PART = lambda h: f"CASE WHEN regexp_matches(body, '(?i)\\*\\*{h}\\*\\*:\\s*[^\\n*]+') THEN trim(regexp_extract(body, '(?i)\\*\\*{h}\\*\\*:\\s*([^\\n*]+)', 1)) END"
D["movements"] = f"""
    WITH t AS (SELECT song, turn, CASE WHEN regexp_matches(answer, '{TRAIN}') THEN regexp_extract_all(answer, '{TRAIN}') ELSE regexp_extract_all(answer, '{COMPACT}') END AS heads,
                      CASE WHEN regexp_matches(answer, '{TRAIN}') THEN string_split_regex(answer, '{TRAIN}') ELSE string_split_regex(answer, '{COMPACT}') END AS bodies FROM {{movement_texts}}),
         e AS (SELECT song, turn, i - 1 AS movement, regexp_extract_all(heads[i], '\\d+\\.?\\d*') AS nums, bodies[i + 1] AS body FROM (SELECT *, unnest(range(1, len(heads) + 1)) AS i FROM t)),
         p AS (SELECT song, turn, movement, CAST(nums[2] AS DOUBLE) AS start_sec, CAST(nums[3] AS DOUBLE) AS end_sec, {PART('simple tag')} AS simple_tag, {PART('whole body')} AS whole_body,
                      {PART('upper body')} AS upper_body, {PART('lower body')} AS lower_body, {PART('torso')} AS torso FROM e)
    SELECT *, CAST(round_even(start_sec * 30, 0) AS BIGINT) AS start_frame, CAST(round_even(end_sec * 30, 0) AS BIGINT) AS end_frame FROM p
    WHERE simple_tag IS NOT NULL AND whole_body IS NOT NULL AND upper_body IS NOT NULL AND lower_body IS NOT NULL AND torso IS NOT NULL"""


def movements(v):
    keyed = v.movement_texts.withColumn("_key", F.struct("song", "turn"))
    return cp.parse_movements(keyed, ["_key"], "answer").select("_key.*", "movement", "start_sec", "end_sec", "start_frame", "end_frame", *cp.BODY_PARTS)


@query("parse_movements", "SELECT song, turn, movement, start_sec, end_sec, start_frame, end_frame FROM {movements}")
def parse_movements(v):
    return movements(v).select("song", "turn", "movement", "start_sec", "end_sec", "start_frame", "end_frame")


@query("body_part_extract", "SELECT song, turn, movement, simple_tag, whole_body, upper_body, lower_body, torso FROM {movements}")
def body_part_extract(v):
    return movements(v).select("song", "turn", "movement", *cp.BODY_PARTS)


# ---- text features ---------------------------------------------------------------------
@query("flatten_text_domains", """
    WITH r AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn, role, text FROM {conversations})
    SELECT doc, idx, 'whole_body' AS domain, text, 10 * turn AS start_frame FROM r
    UNION ALL SELECT doc, idx, 'upper_body', role, 10 * turn FROM r UNION ALL SELECT doc, idx, 'torso', '', 10 * turn FROM r""")
def flatten_text_domains(v):
    whole = F.when(F.col("conv_id") % 2 == 0, "whole").otherwise("whole_body")
    upper = F.when(F.col("conv_id") % 2 == 0, "upper_half_body").otherwise("upper_body")
    seg = F.struct((F.col("turn") * 10).alias("start_frame"), (F.col("turn") * 10 + 10).alias("end_frame"),
                   F.create_map(whole, F.col("text"), upper, F.col("role"), F.lit("torso"), F.lit(None).cast("string"), F.lit("other"), F.lit("x")).alias("modifier"))
    # the nested document is the input format: one conversation is one document
    docs = v.conversations.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", seg.alias("seg"))), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("_rows"))
    flat = F.transform("_rows", lambda r: r["seg"])
    even = F.col("doc") % 2 == 0
    nested = docs.select(
        "doc", F.when(even, F.transform("_rows", lambda r: F.struct(F.array(r["seg"]).alias("sentence")))).alias("segments"),
        F.when(~even, flat).alias("merged_segments"))
    texts, meta = cp.flatten_domains(nested, "doc")
    return texts.join(meta, ["doc", "idx"]).select("doc", "idx", "domain", "text", "start_frame")


S["samples"] = """
    SELECT CAST(floor(vec_id / 8) AS BIGINT) AS batch, vec_id, 'upper_body' AS domain, CASE WHEN label < 9 THEN embedding END AS vec FROM {embeddings}
    UNION ALL SELECT CAST(floor(vec_id / 8) AS BIGINT), vec_id, 'torso', embedding FROM {embeddings}
    UNION ALL SELECT CAST(floor(vec_id / 8) AS BIGINT), vec_id, 'simple_tag', embedding FROM {embeddings}"""


@query("modality_mask", """
    SELECT batch, domain, count(*) AS samples, count(vec) FILTER (domain <> 'simple_tag') AS present,
           CASE WHEN count(vec) FILTER (domain <> 'simple_tag') = 0 THEN 'off' WHEN count(vec) FILTER (domain <> 'simple_tag') = count(*) THEN 'on' ELSE 'mixed' END AS status
    FROM {samples} GROUP BY ALL""")
def modality_mask(v):
    return cp.modality_status(v.samples, "batch", "domain", "vec", disabled=["simple_tag"])


@query("text_vectors", """
    SELECT d.doc_id, CAST(trim(t) <> '' AS BIGINT) AS has_text, i AS dim, CASE WHEN trim(t) = '' THEN 0.0 ELSE CAST(e.embedding[i + 1] AS DOUBLE) END AS value
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS t FROM {documents}) d JOIN {embeddings} e ON e.vec_id = d.doc_id, range(0, 64) r(i)""")
def text_vectors(v):
    texts = v.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("t"))
    known = v.embeddings.select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    held = texts.join(known.select("doc_id"), "doc_id", "left_semi")
    out = cp.text_vectors(held, known, ["doc_id"], "t", "vec", 64)
    return out.select("doc_id", (F.trim("t") != "").cast("bigint").alias("has_text"), F.posexplode("vec").alias("dim", "value"))
