"""Caption, prompt and generated-text jobs on tables of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.texts import python_round
from cadenza.sources.scratch import by_merge

# --- fixed values: text domains and headings ------------------------------------------------
DOMAINS = ("whole body", "lower half body", "upper half body", "torso", "simple tag")
BODY_PARTS = {
    "simple_tag": "simple tag", "whole_body": "whole body", "upper_body": "upper body", "lower_body": "lower body",
    "torso": "torso",
}
ANSWER_MARK = "**Your Answer**"
MAX_MOVEMENTS = 7
WARNING = ("[警告] 经过", "次尝试仍缺少域: ")
STOCK_SENTENCE = "The choreography continues with matching dynamics."
# --- end of fixed values ------------------------------------------------------------------


# ---- assembling ------------------------------------------------------------------------
def interleave(a: DataFrame, b: DataFrame, keys: Sequence[str], items: str) -> DataFrame:
    """``a0, b0, a1, b1, ...`` until both lists end."""
    joined = a.select(*keys, F.col(items).alias("_a")).join(by_merge(b.select(*keys, F.col(items).alias("_b"))), list(keys))
    mixed = F.array_compact(F.flatten(F.zip_with("_a", "_b", lambda x, y: F.array(x, y))))
    return joined.select(*keys, mixed.alias(items))


def annotation_lookup(segments: DataFrame, extra: DataFrame, responses: DataFrame, keys: Sequence[str], cues: str, response: str) -> DataFrame:
    """Segments with their cue list (empty when missing) and response (an error text when missing)."""
    out = segments.join(by_merge(extra.select(*keys, cues)), list(keys), "left").join(
        by_merge(responses.select(*keys, response)), list(keys), "left")
    return out.select(
        *segments.columns,
        F.coalesce(cues, F.array().cast("array<string>")).alias(cues),
        F.coalesce(response, F.lit("Error: No response")).alias(response),
    )


def document_validity(parts: DataFrame, key: str, required: Sequence[str], sentence: str) -> DataFrame:
    """A document is valid if all required fields are set and every segment has its sentence array."""
    ok = F.col(sentence).isNotNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return parts.groupBy(key).agg(F.bool_and(ok).alias("valid"), F.count(F.lit(1)).alias("parts"))


# ---- responses to domains --------------------------------------------------------------
def missing_headings(response: Column, domains: Sequence[str] = DOMAINS) -> Column:
    """Domains whose ``**heading**`` the response does not contain."""
    low = F.lower(response)
    return F.array_compact(F.array(*[F.when(~F.contains(low, F.lit(f"**{d}**")), F.lit(d)) for d in domains]))


def pick_attempt(attempts: DataFrame, keys: Sequence[str], attempt: str, response: str, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """First attempt with all domains, else the last one behind a warning."""
    marked = attempts.withColumn("_missing", missing_headings(F.col(response), domains))
    valid = F.when(F.size("_missing") == 0, F.col(attempt))
    picked = marked.groupBy(*keys).agg(
        F.min_by(response, valid).alias("_good"),
        F.max_by(F.struct(response, "_missing", attempt), attempt).alias("_last"),
    )
    listed = F.concat(F.lit("['"), F.array_join("_last._missing", "', '"), F.lit("']"))
    warning = F.concat(
        F.lit(WARNING[0]), F.col(f"_last.{attempt}").cast("string"), F.lit(WARNING[1]), listed,
        F.lit("\n\n"), F.col(f"_last.{response}"),
    )
    return picked.select(*keys, F.coalesce("_good", warning).alias(response), F.col("_good").isNotNull().alias("valid"))


def parse_domains(response: Column, domains: Sequence[str] = DOMAINS) -> Column:
    """``struct`` of domain texts; a domain without heading line and text is null."""
    clean = F.replace(response, F.lit("*"), F.lit(""))
    heads = "|".join(domains)

    def one(d: str) -> Column:
        body = F.regexp_extract(clean, rf"(?is){d}\s*\n(.+?)(?=\n(?:{heads})|\z)", 1)
        found = F.regexp_like(clean, F.lit(rf"(?is){d}\s*\n.+?(?:\n(?:{heads})|\z)"))
        text = F.trim(F.regexp_replace(body, r"\s+", " "))
        return F.when(found, text).alias(d.replace(" ", "_"))

    return F.struct(*[one(d) for d in domains])


def judged_captions(captions: DataFrame, order: str, response: str, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Captions with their domains as ``modifier`` and a ``_reason`` where one is missing."""
    keys = [d.replace(" ", "_") for d in domains]
    parsed = captions.withColumn("modifier", parse_domains(F.col(response), domains))
    gaps = F.array_compact(F.array(*[F.when(F.col(f"modifier.{k}").isNull(), F.lit(d)) for k, d in zip(keys, domains, strict=True)]))
    blank = F.coalesce(F.col(response), F.lit("")) == ""
    reason = F.when(blank, F.format_string("motion %d has no modifier", order)).when(
        F.size(gaps) > 0, F.concat(F.lit("motion "), F.col(order).cast("string"), F.lit(" lacks: "), F.array_join(gaps, ", "))
    )
    return parsed.withColumn("_reason", reason)


def good_and_rejected(judged: DataFrame, file: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Judged captions of files without a reason, and the other files with that of their first caption that has one.

    Per-file verdicts are one small aggregate joined back, so a large file is never gathered.
    """
    verdict = judged.groupBy(file).agg(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col(order))).alias("reason"))
    rejected = verdict.filter("reason IS NOT NULL")
    good = judged.join(rejected.select(file), file, "left_anti").drop("_reason")
    return good, rejected


def caption_ingest(captions: DataFrame, file: str, order: str, response: str, domains: Sequence[str] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """Parsed captions, and the files rejected because any of their captions lacks a domain."""
    return good_and_rejected(judged_captions(captions, order, response, domains), file, order)


# ---- prompts ---------------------------------------------------------------------------
def format_cues(cues: Column, key_frames: Column) -> Column:
    """Alternating pose and transition lines, with frames where known; both arrays may be empty."""

    def line(c: Column, i: Column) -> Column:
        n = F.floor(i / 2) + 1
        num = n.cast("string")
        at = lambda j: F.get(key_frames, j.cast("int")).cast("string")
        pose = F.when(
            F.size(key_frames) > n - 1,
            F.concat(F.lit("* **Pose "), num, F.lit(" (sampled at frame "), at(n - 1), F.lit("):** "), c),
        ).otherwise(F.concat(F.lit("* **Pose "), num, F.lit(":** "), c))
        trans = F.when(
            F.size(key_frames) > n,
            F.concat(F.lit("* **Trans "), num, F.lit(" (from frame "), at(n - 1), F.lit(" to "), at(n), F.lit("):** "), c),
        ).otherwise(F.concat(F.lit("* **Trans "), num, F.lit(":** "), c))
        return F.when(i % 2 == 0, pose).otherwise(trans)

    return F.array_join(F.transform(cues, line), "\n")


def insert_cues(base: Column, section: Column) -> Column:
    """Put the cue section before the answer mark (text after a second mark is cut), or append it."""
    mark = F.lit(ANSWER_MARK)
    tail = F.concat(F.lit("\n---\n\n"), mark)
    rest = F.split_part(base, mark, F.lit(2))
    return (
        F.when(F.coalesce(section, F.lit("")) == "", base)
        .when(F.contains(base, mark), F.concat(F.split_part(base, mark, F.lit(1)), section, tail, rest))
        .otherwise(F.concat(base, section, tail))
    )


# ---- summaries of songs ----------------------------------------------------------------
def ordered_text(rows: DataFrame, keys: Sequence[str], order: str, text: Column, out: str, sep: str) -> DataFrame:
    """Texts of a group joined in order (a group is the segments of one song or bar)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["t"]), sep).alias(out))


def seconds(value: Column) -> Column:
    """Two decimals of the exact binary value, ties to even."""
    return F.format_string("%.2f", python_round(value, 2))


def segmentation_line(n: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("Segment "), n.cast("string"), F.lit(": "), seconds(start), F.lit(" - "), seconds(end))


def movement_block(n: Column, start: Column, end: Column, modifier: dict[str, Column]) -> Column:
    head = F.concat(F.lit("***Movement "), n.cast("string"), F.lit("***: "), seconds(start), F.lit(" - "), seconds(end), F.lit("\n"))
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit("")), F.lit("\n")) for k, c in modifier.items()]
    return F.concat(head, *lines, F.lit("\n"))


def sentence_summary(genre: Column, start: Column, end: Column, key: Column, chords: Column, bpm: Column, synthesis: Column, movements: Column) -> Column:
    return F.concat(
        F.lit("This is a "), genre, F.lit("-style music segment lasting "), seconds(end - start), F.lit(" seconds, in key "), key,
        F.lit(", with chord progression "), chords, F.lit(", and tempo "), F.coalesce(bpm.cast("string"), F.lit("None")), F.lit(" BPM. "),
        F.lit(
            "As a choreographer preparing movement for this music, I will consider the musical style, rhythmic feel, and mood "
            "(as implied by the key), as well as the musical development indicated by the chord progression, when arranging "
            "motion and transitions."
        ),
        F.lit("\n\nHigh-level movement synthesis:\n"), synthesis,
        F.lit("\n\nSpecific movement instructions for the model:\n\n"), movements,
    )


def extract_synthesis(summary: Column) -> Column:
    """Text between the synthesis and the instruction marker (or the end); empty without the first."""
    return F.trim(
        F.regexp_replace(F.regexp_extract(summary, r"(?is)High-level movement synthesis:(.*?)(?=Specific movement instructions|\z)", 1), r"^\s+|\s+\z", "")
    )


def segment_response(summary: Column) -> Column:
    """Think / answer form of a segment summary; without instructions all of it is thinking."""
    thinking = F.regexp_replace(summary, r"(?is)High-level movement synthesis:.*?(?=Specific movement instructions|\z)", "")
    mark = r"(?is)Specific movement instructions for the model:(.*)\z"
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    answer = strip(F.regexp_extract(thinking, mark, 1))
    before = strip(F.regexp_replace(thinking, mark, ""))
    return F.when(
        F.regexp_like(thinking, F.lit(mark)),
        F.concat(F.lit("<think>\n"), before, F.lit("\nHence, the final answer is:\n</think>\n<answer>\n"), answer, F.lit("\n</answer>")),
    ).otherwise(F.concat(F.lit("<think>\n"), strip(thinking), F.lit("\n</think>")))


SONG_MARK = "## Segment-Level Choreographic Summaries"


def song_response(summary: Column) -> Column:
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    at = F.instr(summary, SONG_MARK)
    before = F.substr(summary, F.lit(1), at - 1)
    after = F.substr(summary, at + len(SONG_MARK))
    return F.concat(
        F.lit("<think>\n"), strip(before), F.lit("\nHence, the final answer is:\n</think>\n<answer>\n"), strip(after), F.lit("\n</answer>")
    )


def strip_reasoning(response: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(response, r"(?s)<think>.*?</think>\s*", ""), r"^\s+|\s+\z", "")


def clip_key(stem: Column, start: Column, end: Column) -> Column:
    return F.concat(stem, F.lit("_"), seconds(start), F.lit("_"), seconds(end))


def conversation(user: Column, audio: Column, assistant: Column) -> Column:
    """Two-turn record: user text and audio, assistant text."""
    none = F.lit(None).cast("string")
    part = lambda kind, text, path: F.struct(F.lit(kind).alias("type"), text.alias("text"), path.alias("path"))
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    return F.array(turn("user", part("text", user, none), part("audio", none, audio)), turn("assistant", part("text", assistant, none)))


# ---- generated text --------------------------------------------------------------------
def extract_answer(text: Column) -> Column:
    """Body of the answer tag, else the whole text; stray tags removed."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    tag = r"(?is)<answer>\s*(.*?)\s*</answer>"
    body = F.when(F.regexp_like(text, F.lit(tag)), F.regexp_extract(text, tag, 1)).otherwise(text)
    return strip(F.regexp_replace(strip(body), r"(?i)</?think>|</?answer>", ""))


def body_part(text: Column, heading: str) -> Column:
    """Text behind ``**heading**:`` up to a line end or star; null when absent."""
    pattern = rf"(?i)\*\*{heading}\*\*:\s*([^\n*]+)"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.trim(F.regexp_extract(text, pattern, 1)))


TRAINING_HEAD = r"\*\s+\*{2,3}Movement\s+\d+\s*\(\d+\.?\d*\s*[-–—]\s*\d+\.?\d*\)\s*:{1,3}\*{0,3}"
COMPACT_HEAD = r"\*{2,3}Movement\s*\d+\*{2,3}:\s*\d+\.?\d*\s*[-–—]\s*\d+\.?\d*"


def parse_movements(texts: DataFrame, keys: Sequence[str], text: str, limit: int | None = None) -> DataFrame:
    """Complete movements of generated texts, one row each: times, 30 fps frames, five body parts.

    The training header form wins over the compact one.  With ``limit`` (``MAX_MOVEMENTS`` for the
    usual prompt) only that many headers count, the last one's body runs to the end of the text, and
    ``cut`` tells how many were left out.  Movements missing a body part are skipped.
    """
    chosen = F.when(F.regexp_like(text, F.lit(f"(?i){TRAINING_HEAD}")), F.lit(f"(?i)({TRAINING_HEAD})")).otherwise(
        F.lit(f"(?i)({COMPACT_HEAD})")
    )
    heads = F.regexp_extract_all(F.col(text), chosen, F.lit(1))
    # n headers cut the text into n + 1 parts; part i + 1 belongs to header i; the last kept part takes the rest
    bodies = F.split(F.col(text), chosen) if limit is None else F.split(F.col(text), chosen, limit + 1)
    pieces = F.zip_with(heads, F.slice(bodies, 2, F.greatest(F.size(heads), F.lit(1))), lambda h, b: F.struct(h.alias("head"), b.alias("body")))
    kept = pieces if limit is None else F.slice(pieces, 1, limit)
    cut = F.lit(0) if limit is None else F.greatest(F.size(heads) - limit, F.lit(0))
    rows = texts.select(*keys, cut.cast("bigint").alias("cut"), F.posexplode(kept).alias("movement", "_p"))
    number = lambda i: F.get(F.regexp_extract_all("_p.head", F.lit(r"(\d+\.?\d*)"), F.lit(1)), F.lit(i)).cast("double")
    parts = {name: body_part(F.col("_p.body"), h) for name, h in BODY_PARTS.items()}
    out = rows.select(
        *keys, F.col("movement").cast("bigint").alias("movement"), "cut",
        number(1).alias("start_sec"), number(2).alias("end_sec"), *[c.alias(n) for n, c in parts.items()],
    ).withColumns({"start_frame": F.bround(F.col("start_sec") * 30, 0).cast("bigint"), "end_frame": F.bround(F.col("end_sec") * 30, 0).cast("bigint")})
    return out.dropna(subset=list(BODY_PARTS))


SEGMENT_HEAD = r"Segment\s+\d+(?::\s*[\d.]+\s*-\s*[\d.]+)?"


def parse_song_segments(texts: DataFrame, song: str, text: str) -> DataFrame:
    """Text between ``Segment n`` headers; a text without headers belongs to segment 1."""
    pattern = F.lit(f"(?i)({SEGMENT_HEAD})")
    heads = F.regexp_extract_all(F.col(text), pattern, F.lit(1))
    bodies = F.split(F.col(text), f"(?i){SEGMENT_HEAD}")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    pieces = F.zip_with(heads, F.slice(bodies, 2, F.greatest(F.size(heads), F.lit(1))), lambda h, b: F.struct(h.alias("head"), b.alias("body")))
    whole = F.array(F.struct(F.lit("Segment 1").alias("head"), F.col(text).alias("body")))
    rows = texts.select(song, F.size(heads).alias("_n"), F.posexplode(F.when(F.size(heads) > 0, pieces).otherwise(whole)).alias("part", "_p"))
    cleaned = F.when(F.col("_n") > 0, F.regexp_replace(strip(F.col("_p.body")), r"^[:：\-\s]+", "")).otherwise(strip(F.col("_p.body")))
    return rows.select(
        song, F.col("part").cast("bigint").alias("part"),
        F.regexp_extract("_p.head", r"(?i)Segment\s+(\d+)", 1).cast("bigint").alias("n"), cleaned.alias("choreography"),
    )


def ensure_sentence(text: Column) -> Column:
    clean = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return F.when(clean == "", STOCK_SENTENCE).when(F.regexp_like(clean, F.lit(r"[.!?]\s*\z")), clean).otherwise(F.concat(clean, F.lit(".")))


def format_segments(segments: DataFrame, song: str, order: str) -> DataFrame:
    """Numbered blocks ``Segment i: a - b`` with a complete sentence each, blank line between.

    ``segments`` has dense positions ``order`` from 0.
    """
    block = F.concat(segmentation_line(F.col(order) + 1, F.col("start_sec"), F.col("end_sec")), F.lit("\n"), ensure_sentence(F.col("choreography")))
    return ordered_text(segments, [song], order, block, "output", "\n\n")


def generation_sufficient(parsed: DataFrame, expected: DataFrame, song: str) -> DataFrame:
    """Whether each expected song got exactly its segments, none blank."""
    want = expected.groupBy(song).agg(F.count(F.lit(1)).alias("_want"))
    blank = F.trim(F.coalesce("choreography", F.lit(""))) == ""
    got = parsed.groupBy(song).agg(F.count(F.lit(1)).alias("_got"), F.count_if(blank).alias("_blank"))
    ok = (F.col("_got") == F.col("_want")) & (F.col("_blank") == 0)
    return want.join(got, song, "left").select(song, F.coalesce(ok, F.lit(False)).alias("sufficient"))


# ---- song documents and training records -----------------------------------------------
def nest_segments(segments: DataFrame, song: str, bar: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Segments as an ordered array per bar, bars as an ordered array per song.

    The nested document is the output format; a bar holds a few segments and a song its bars.
    """
    item = F.struct(order, *[f for f in fields if f != order])
    bars = segments.groupBy(song, bar).agg(F.array_sort(F.collect_list(item)).alias("sentence"))
    return bars.groupBy(song).agg(F.array_sort(F.collect_list(F.struct(bar, "sentence"))).alias("segments"))


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` in a prompt template by columns."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), col)
    return out


def onestage_response(movements: DataFrame, song: str, start: str, end: str, parts: dict[str, str], fps: float = 30.0) -> DataFrame:
    """All movements of a song renumbered in time order as one answer; missing texts are ``N/A``."""
    from cadenza.operators import sequence as seq

    numbered = seq.dense_position(movements, [song], seq.chunk_index(start), [start, end], "_no", start=1)
    lines = [F.concat(F.lit(f"\n  **{label}**: "), F.coalesce(F.col(c), F.lit("N/A"))) for label, c in parts.items()]
    block = F.concat(
        F.lit("* **Movement "), F.col("_no").cast("string"), F.lit(" ("), seconds(F.col(start) / fps), F.lit(" - "),
        seconds(F.col(end) / fps), F.lit("):**\n"), *lines, F.lit("\n"),
    )
    texts = ordered_text(numbered, [song], "_no", block, "_text", "\n")
    return texts.select(song, F.concat(F.lit("<answer>\n"), "_text", F.lit("\n</answer>")).alias("response"))


def song_summary(overall: Column, structure: Column, intent: Column, sections: Column) -> Column:
    """Song-level document text from its four parts."""
    return F.concat(
        F.lit("\n## Overall Musical Characteristics\n\n"), overall,
        F.lit("\n\n\n## Musical Structure and Segment Relationships\n\n"), structure,
        F.lit("\n\n\n## Choreographic Perspective and Design Intent\n\n"), intent,
        F.lit("\n\n\n" + SONG_MARK + "\n\n"), sections, F.lit("\n"),
    )


def section_texts(sentences: DataFrame, song: str, order: str) -> DataFrame:
    """Per song: ``Segment i: a - b.`` and the synthesis of each sentence that has both markers."""
    summary = F.col("sentence_summary")
    strict = r"(?s)High-level movement synthesis:\s*(.*?)(?=\s*Specific movement instructions for the model)"
    has = F.regexp_like(summary, F.lit(strict))
    body = F.trim(F.regexp_replace(F.regexp_extract(summary, strict, 1), r"^\s+|\s+\z", ""))
    line = F.concat(segmentation_line(F.col(order), F.col("start_sec"), F.col("end_sec")), F.lit(".\n"), body, F.lit("\n"))
    return ordered_text(sentences.withColumn("_line", F.when(has, line).otherwise("")), [song], order, F.col("_line"), "sections", "")


# fixed values: names of the text domains in the different document layouts
DOMAIN_ALIASES = {
    "whole": "whole_body", "whole_body": "whole_body", "upper_half_body": "upper_body", "upper_body": "upper_body",
    "lower_half_body": "lower_body", "lower_body": "lower_body", "torso": "torso", "simple_tag": "simple_tag",
}


def flatten_domains(documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two document layouts to ``(key, idx, domain, text)`` rows and ``(key, idx, start, end)``.

    ``segments`` holds sentences with segments, ``merged_segments`` segments directly; a document
    has one of them.  A modifier is a map from domain name to text.
    """
    flat = F.coalesce(F.flatten(F.transform("segments", lambda s: s["sentence"])), F.col("merged_segments"))
    rows = documents.select(key, F.posexplode(flat).alias("idx", "seg"))
    meta = rows.select(key, "idx", "seg.start_frame", "seg.end_frame")
    alias = F.create_map(*[F.lit(x) for pair in DOMAIN_ALIASES.items() for x in pair])
    texts = rows.select(key, "idx", F.explode("seg.modifier").alias("_d", "text"))
    named = texts.select(key, "idx", alias[F.col("_d")].alias("domain"), F.coalesce("text", F.lit("")).alias("text"))
    return named.filter(F.col("domain").isNotNull()), meta


def modality_status(samples: DataFrame, batch: str, domain: str, vector: str, disabled: Sequence[str] = ()) -> DataFrame:
    """Per batch and domain ``off``, ``on`` or ``mixed`` (some samples without it: a data error)."""
    held = F.when(~F.col(domain).isin(*disabled) if disabled else F.lit(True), F.col(vector))
    counts = samples.groupBy(batch, domain).agg(F.count(F.lit(1)).alias("samples"), F.count(held).alias("present"))
    status = F.when(F.col("present") == 0, "off").when(F.col("present") == F.col("samples"), "on").otherwise("mixed")
    return counts.select(batch, domain, "samples", "present", status.alias("status"))


def text_vectors(texts: DataFrame, vectors: DataFrame, keys: Sequence[str], text: str, vector: str, dims: int) -> DataFrame:
    """Vectors per text; an empty text gets the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dims)
    return texts.join(vectors.select(*keys, vector), list(keys), "left").withColumn(
        vector, F.when(F.trim(text) == "", zero).otherwise(F.col(vector))
    )


def dataset_concat(songs: DataFrame, segments: DataFrame) -> DataFrame:
    """Song rows and segment rows as one training set; columns one side lacks are null."""
    return songs.withColumn("kind", F.lit("song")).unionByName(segments.withColumn("kind", F.lit("segment")), allowMissingColumns=True)
