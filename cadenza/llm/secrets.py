"""Secret scanning with linking of multipart credentials, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table
from cadenza.sources.scratch import checkpointed

#: Parts of one credential lie at most so many code points apart.
SCOPE = 300

_WORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_LOGIN = "([Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])"
_IS = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = f"{_WORD}{_IS}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Weak candidates: reported only beside their complements.
KEY = "[A-Za-z0-9+/]{40,}"
LOGIN = f"{_LOGIN}{_IS}([A-Za-z0-9@._-]{{3,}})"
ENDPOINT = "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.:@_-]+"

#: Kinds in the order of equal starts.
BASE = ("assign", "access", "hex")
WEAK = ("key", "login", "endpoint")
_RANK = {kind: i for i, kind in enumerate(BASE + WEAK)}
_NONE = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


#: Spans are worked through in blocks of so many, as an array that grows by one entry is copied at each step.
BLOCK = 256
_MIXED = "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _by_blocks(items: Column, first, past, inside) -> Column:
    """The lists ``inside(block, state before it)`` of consecutive blocks of ``items``, flattened.

    ``past(state, item)`` moves the state ``first`` over an item.  The time is that of the items times the size of a block.
    """
    def lists(blocks: Column) -> Column:
        moved = F.aggregate(blocks, F.struct(first.alias("at"), F.array(first).alias("all")), lambda acc, b: _bound(
            F.aggregate(b, acc["at"], past), lambda at: F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))))
        return _bound(moved["all"], lambda states: F.flatten(F.transform(blocks, lambda b, i: inside(b, F.get(states, i)))))

    def cut(every: Column) -> Column:
        starts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return _bound(F.transform(starts, lambda at: F.slice(every, at, F.lit(BLOCK))), lists)

    return _bound(items, cut)


def _found(text: Column, pattern: str, kind: str, value: int | None = None, least: int = 0) -> Column:
    """Spans of all matches from left to right; with ``value``, matches whose group is shorter than ``least`` drop out.

    Each piece is what lies before a match and the match; ``\\G`` ties a piece to the end of the one before,
    so a text is read once.  A ``key`` must hold small and capital letters and digits.
    """
    whole = F.lit(f"(?s)\\G(.*?)({pattern})")
    parts = [F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))]
    names = "gh"
    if value:
        parts.append(F.regexp_extract_all(text, whole, F.lit(2 + value)))
        names = "ghv"
    keep = lambda p: F.length(p["v"]) >= least if value else p["h"].rlike(_MIXED) if kind == "key" else F.lit(True)
    pieces = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)]), lambda p: F.struct(
        F.length(p["g"]).cast("bigint").alias("g"), F.length(p["h"]).cast("bigint").alias("h"), keep(p).alias("keep")))
    none = F.array().cast(_NONE)

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), lambda acc, p: F.struct(
            (acc["at"] + p["g"] + p["h"]).alias("at"),
            F.when(~p["keep"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["g"]).alias("start"), F.lit(_RANK[kind]).alias("rank"), (acc["at"] + p["g"] + p["h"]).alias("end"), F.lit(kind).alias("kind")
            )))).alias("out"),
        ))["out"]

    return _by_blocks(pieces, F.lit(0).cast("bigint"), lambda at, p: at + p["g"] + p["h"], spans)


def _has(kind: str) -> Column:
    """A cheap necessary condition for a span of the kind; long runs are tried only where a run begins."""
    t = F.col("_t")
    if kind == "access":
        return t.contains("AKIA")
    if kind in ("hex", "key"):
        run, least = ("[0-9a-f]", 32) if kind == "hex" else ("[A-Za-z0-9+/]", 40)
        return t.rlike(f"(?<!{run}){run}{{{least}}}")
    if kind == "endpoint":
        return t.contains("://")
    word = _WORD if kind == "assign" else _LOGIN
    return (t.contains("=") | t.contains(":")) & t.rlike(f"{word}[\"']?\\x20*[:=]")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans", scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with one more column: all spans of a text, sorted by start, then kind; any column ``out`` is replaced.

    ``keep`` names the columns to return beside the spans, all by default; a text that is not kept is not shuffled.

    Base kinds (assignments, access identifiers, long hexadecimal runs) are always reported.  Weak candidates
    are linked: a ``key`` (40 or more base64 characters of mixed classes) needs an access identifier or login
    within ``scope`` code points, a ``login`` needs a key or an assigned secret, an ``endpoint`` needs an
    identifier and a secret.  The links are interval joins over distinct texts: both sides are dealt by text and
    stretch of ``scope`` code points, and a candidate stops at its first partner, so neither copies of a
    text nor crowded stretches make pairs.  Null and empty texts have no span; rows that repeat stay.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    nothing = F.array().cast(_NONE)
    found = {"assign": (ASSIGN, "assign", 2, 8), "access": (ACCESS, "access"), "hex": (HEX, "hex"),
             "key": (KEY, "key"), "login": (LOGIN, "login"), "endpoint": (ENDPOINT, "endpoint")}
    kinds = [F.when(_has(kind), _found(F.col("_t"), *how)).otherwise(nothing).alias(f"_{kind}") for kind, how in found.items()]
    rest = [c for c in (docs.columns if keep is None else keep) if c != out]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), value.alias("_t"))
    row = row.select("_row", "_t", *kinds)
    row = row.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    identifiers, secrets = F.concat("_access", "_login"), F.concat("_key", "_assign")
    # a text is looked at again only if parts that can complement each other occur in it at all
    linkable = (F.size(F.concat("_key", "_login", "_endpoint")) > 0) & (F.size(identifiers) > 0) & (F.size(secrets) > 0)
    row = row.select("_row", "_base", F.when(linkable, F.sha2("_t", 256)).alias("_text"),
                     F.when(linkable, F.concat("_key", "_login", "_endpoint", "_access", "_assign")).alias("_parts"))
    # one row for each distinct text with such parts, and one for all others; stored, as the joins read it often
    distinct = checkpointed(row.groupBy("_text").agg(F.first("_parts").alias("_parts"))).filter("_text IS NOT NULL")
    parts = distinct.select("_text", F.explode("_parts").alias("p")).select("_text", "p", F.floor(F.col("p.start") / scope).alias("_at"))

    def beside(weak: DataFrame, *partners: str) -> DataFrame:
        other = parts.filter(F.col("p.kind").isin(*partners)).select(
            F.col("_text").alias("_t2"), F.col("p").alias("q"),
            F.explode(F.sequence(F.floor(F.col("p.start") / scope) - 1, F.floor(F.col("p.end") / scope) + 1)).alias("_b"))
        close = (F.col("q.start") <= F.col("p.end") + scope) & (F.col("p.start") <= F.col("q.end") + scope) & (F.col("q") != F.col("p"))
        # a long candidate is met at each stretch it covers
        spread = weak.withColumn("_b1", F.explode(F.sequence(F.col("_at"), F.floor(F.col("p.end") / scope))))
        return spread.join(other, (F.col("_text") == F.col("_t2")) & (F.col("_b1") == F.col("_b")) & close, "left_semi").drop("_b1").distinct()

    weak = lambda kind: parts.filter(F.col("p.kind") == kind)
    linked = (
        beside(weak("key"), "access", "login")
        .unionByName(beside(weak("login"), "key", "assign"))
        .unionByName(beside(beside(weak("endpoint"), "access", "login"), "key", "assign"))
        .groupBy("_text").agg(F.collect_set("p").alias("_linked"))
    )
    # rows without weak parts get keys of their own, so that they do not meet in one task
    keyed = row.withColumn("_join", F.coalesce("_text", F.xxhash64("_row").cast("string")))
    joined = keyed.join(linked.withColumnRenamed("_text", "_join"), "_join", "left")
    every = F.array_sort(F.concat(F.col("_base"), F.coalesce(F.col("_linked"), nothing)))
    return joined.select("_row.*", every.alias(out))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]", scope: int = SCOPE, length: str | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; overlapping spans share one.

    A column ``length``, if there is one, becomes the length of a changed text.  Other rows stay as they are.
    """
    name = "_spans"
    while name in docs.columns:
        name += "_"
    found = find_spans(docs, text, name, scope)
    spans, whole = F.col(name), F.col(f"`{text}`")
    bigint = lambda n: F.lit(n).cast("bigint")
    furthest = lambda at, s: F.greatest(at, s["end"])
    cut = lambda of, at, to: F.substr(of, (at + 1).cast("int"), (to - at).cast("int"))

    def between(block: Column, first: Column) -> Column:
        """What lies between the spans of a block, each time with the mask; only the block's stretch of the text is cut."""
        def pieces(stretch: Column) -> Column:
            return F.aggregate(block, F.struct(first.alias("at"), F.array().cast("array<string>").alias("out")), lambda acc, s: F.struct(
                furthest(acc["at"], s).alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                    F.concat(acc["out"], F.array(F.concat(cut(stretch, acc["at"] - first, s["start"] - first), F.lit(mask))))).alias("out"),
            ))["out"]

        return _bound(cut(whole, first, F.aggregate(block, first, furthest)), pieces)

    kept = F.array_join(_by_blocks(spans, bigint(0), furthest, between), "")
    whole = F.concat(kept, F.substr(whole, (F.aggregate(spans, bigint(0), furthest) + 1).cast("int")))
    hit = F.size(spans) > 0
    changed = found.withColumn(text, F.when(hit, whole).otherwise(F.col(f"`{text}`")))
    if length in docs.columns:
        changed = changed.withColumn(length, F.when(hit, F.length(F.col(f"`{text}`")).cast(dict(docs.dtypes)[length])).otherwise(F.col(f"`{length}`")))
    return changed.select(*[f"`{c}`" for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base_spans(F.col("spans"))), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def _sql_spans(pattern: str, kind: str, value: int | None = None, least: int = 0) -> str:
    whole = f"(?s)(.*?)({pattern})".replace("'", "''")
    part = lambda group: f"[length(x) FOR x IN regexp_extract_all(text, '{whole}', {group})]"
    keep = f" AND v[i] >= {least}" if value else ""
    chosen = f", {part(2 + value)} AS v" if value else ""
    return f"""(SELECT doc_id, '{kind}' AS kind, {_RANK[kind]} AS rank,
        unnest([{{'s': coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(h[1:i - 1]), 0), 'n': h[i]}} FOR i IN range(1, len(g) + 1) IF h[i] > 0{keep}]) AS p
        FROM (SELECT doc_id, {part(1)} AS g, {part(2)} AS h{chosen} FROM docs))"""


OP5_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS (
    {' UNION ALL '.join(_sql_spans(*a) for a in (
        (ASSIGN, 'assign', 2, 8), (ACCESS, 'access'), (HEX, 'hex'), (KEY, 'key'), (LOGIN, 'login'), (ENDPOINT, 'endpoint')))}
), parts AS (
    SELECT doc_id, kind, rank, CAST(p.s AS BIGINT) AS s, CAST(p.s + p.n AS BIGINT) AS e
    FROM every JOIN docs USING (doc_id)
    WHERE kind <> 'key' OR (regexp_matches(substr(text, CAST(p.s AS BIGINT) + 1, p.n), '[a-z]')
        AND regexp_matches(substr(text, CAST(p.s AS BIGINT) + 1, p.n), '[A-Z]') AND regexp_matches(substr(text, CAST(p.s AS BIGINT) + 1, p.n), '[0-9]'))
), near AS (
    SELECT a.doc_id, a.kind, a.s, a.e, max(b.kind IN ('access', 'login')) AS named, max(b.kind IN ('key', 'assign')) AS secret
    FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND b.s <= a.e + {SCOPE} AND a.s <= b.e + {SCOPE} AND (a.kind, a.s) <> (b.kind, b.s)
    WHERE a.kind IN ('key', 'login', 'endpoint') GROUP BY ALL
), kept AS (
    SELECT * FROM parts WHERE kind IN ('assign', 'access', 'hex')
    UNION ALL
    SELECT p.* FROM parts p JOIN near n ON p.doc_id = n.doc_id AND p.kind = n.kind AND p.s = n.s
    WHERE (p.kind = 'key' AND named) OR (p.kind = 'login' AND secret) OR (p.kind = 'endpoint' AND named AND secret)
), listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
    FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""
