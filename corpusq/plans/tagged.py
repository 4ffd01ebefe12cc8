"""Queries: tags and fields read from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, tag, verify
from ..sources import adapters as A
from .base import Plan
from .ranked import LEVELS, REGIONS, _TAGS
from .searched import _CONTENT
from .verified import SUFFIX

plan = Plan()


def _docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@plan.query("tags", f"SELECT doc_id, {_TAGS('text', REGIONS)} AS tags, {_TAGS('text', REGIONS)}[1] AS first_tag FROM documents")
def tags(spark, sf_dir):
    return tag.tagged(_docs(spark, sf_dir), REGIONS).select("doc_id", "tags", "first_tag")


_DIM = {"north": ["n1", "both"], "south": ["both", "s1"], "west": ["w1"]}
_DIM_SQL = "flatten(list_transform(t, lambda x: CASE x WHEN 'north' THEN ['n1', 'both'] WHEN 'south' THEN ['both', 's1'] ELSE ['w1'] END))"


@plan.query("checklists", f"WITH t AS (SELECT doc_id, {_TAGS('text', REGIONS)} AS t FROM documents), d AS (SELECT doc_id, list_concat({_DIM_SQL}, ['all']) AS l FROM t), u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS o FROM d) SELECT doc_id, CASE WHEN list_contains(o, 'w1') THEN list_concat(o, ['Extra!']) ELSE list_concat(o, ['W-1', 'Extra!']) END AS checklist FROM u")
def checklists(spark, sf_dir):
    extra = F.array(F.lit("W-1"), F.lit("Extra!"))
    # "W-1" is plainly "w 1", which is another theme than "w1" unless the dimension is spelled so
    named = {k: [x.replace("w1", "w 1") for x in v] for k, v in _DIM.items()}
    d = tag.tagged(_docs(spark, sf_dir), REGIONS)
    return d.select("doc_id", F.transform(tag.checklist(F.col("tags"), named, ["all"], extra), lambda x: F.when(x == "w 1", "w1").otherwise(x)).alias("checklist"))


_AXES = {"first": {"triggers": ["stth"], "variants": LEVELS}, "second": {"triggers": ["ou"], "variants": REGIONS}}


@plan.query(
    "ambiguity",
    f"WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS query, substr(text, length(text) // 2 + 1) AS found FROM documents) SELECT doc_id, CASE WHEN contains(lower(query), 'stth') OR len({_TAGS('found', LEVELS)}) >= 2 THEN 'first' WHEN contains(lower(query), 'ou') OR len({_TAGS('found', REGIONS)}) >= 2 THEN 'second' END AS axis FROM d",
)
def ambiguity(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", "substr(text, 1, length(text) div 2) AS query", "substr(text, length(text) div 2 + 1) AS found")
    return tag.ambiguity(d, _AXES).select("doc_id", "axis")


_NOTES = "CASE event_id % 5 WHEN 0 THEN concat('A ', user_id, '-year-old right-handed woman with left pain, left weakness and right numbness at C5-6 and C6') WHEN 1 THEN 'He has T10 and S1 trouble, midline' WHEN 2 THEN concat('Male, ', user_id, ' yo, L5/S1, bilateral, right') WHEN 3 THEN 'she was seen' ELSE 'no facts' END"


@plan.query(
    "intake",
    "WITH e AS (SELECT event_id, event_id % 5 AS k, user_id AS u FROM events) SELECT event_id, CAST(CASE WHEN k IN (0, 2) AND u > 0 AND u < 130 THEN u END AS INT) AS age, CASE k WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE '' END AS sex, CASE k WHEN 0 THEN 'left' WHEN 1 THEN 'midline' WHEN 2 THEN 'bilateral' ELSE '' END AS laterality, CASE k WHEN 0 THEN 'C5-6' WHEN 1 THEN 'T10' WHEN 2 THEN 'L5-S1' ELSE '' END AS level FROM e",
)
def intake(spark, sf_dir):
    return tag.intake(A.table(spark, sf_dir, "events").selectExpr("event_id", f"{_NOTES} AS text")).select("event_id", "age", "sex", "laterality", "level")


@plan.query("fields_floored", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'floor' END AS side, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS age FROM events")
def fields_floored(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    given = e.selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '' END AS side", "CASE WHEN event_id % 4 = 0 THEN cast(user_id AS string) END AS age")
    floor = e.selectExpr("event_id", "'floor' AS side", "CASE WHEN event_id % 2 = 0 THEN user_id END AS age")
    return tag.floored(given, floor, "event_id", ["side", "age"])


@plan.query("records_coerced", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE '' END AS side, CASE WHEN event_id % 2 = 0 THEN ['a', 'b c'] ELSE ['x'] END AS history, CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS INT) END AS age FROM events")
def records_coerced(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN ' LEFT ' WHEN 1 THEN 'l' WHEN 2 THEN 'right' ELSE 'up' END AS side", "CASE WHEN event_id % 2 = 0 THEN 'a; b c,' ELSE 'x' END AS history", "CASE WHEN event_id % 3 > 0 THEN cast(user_id AS string) ELSE 'n/a' END AS age")
    return tag.coerced(e, {"side": {"left": "left", "l": "left", "right": "right"}}, ["history"], ["age"])


@plan.query("topics", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN concat(event_type, ' of ', user_id) ELSE 'none' END AS topic, CASE event_id % 3 WHEN 0 THEN ['c'] WHEN 1 THEN []::VARCHAR[] ELSE ['a', 'c'] END AS missing FROM events")
def topics(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 < 2 THEN event_type ELSE ' ' END AS a", "CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('of  ', user_id) ELSE ' ' END AS b", "CASE WHEN event_id % 3 = 1 THEN 'of' END AS d")
    e = e.withColumn("c", F.when(F.col("event_id") % 3 == 1, F.lit("x"))).withColumn("a_blank", F.nullif(F.trim("a"), F.lit("")))
    return e.select("event_id", tag.topic(["a", "b"], "none").alias("topic"), F.transform(tag.missing(["a_blank", "c"], 3), lambda x: F.replace(x, F.lit("a_blank"), F.lit("a"))).alias("missing"))


@plan.query("profiles", f"WITH d AS (SELECT doc_id, {_TAGS('substr(text, 1, length(text) // 2)', REGIONS)}[1] AS a, {_TAGS('substr(text, length(text) // 2 + 1)', REGIONS)}[1] AS b FROM documents) SELECT doc_id, coalesce(a, b, 'generic') AS profile FROM d")
def profiles(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", "substr(text, 1, length(text) div 2) AS a", "substr(text, length(text) div 2 + 1) AS b")
    return d.select("doc_id", tag.profile(["a", "b"], REGIONS).alias("profile"))


@plan.query("tokenised", f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tokens, len({_CONTENT.format('text')}) AS content, len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) >= 6 AND regexp_matches(t, '{SUFFIX}')))) AS entities FROM documents")
def tokenised(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.tokens("text")).alias("tokens"), F.size(T.content_tokens("text")).alias("content"), F.size(verify.entities(F.col("text"), SUFFIX)).alias("entities"))


_QSTOP = ", ".join(f"'{w}'" for w in tag.QUESTION_STOP)


@plan.query(
    "coverage_gaps",
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, text AS q, substr(text, length(text) // 2 + 1) AS a FROM conversations), l AS (SELECT id, lower(a) AS a, string_split(regexp_replace(lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g')), '\\s+(?:and|vs\\.?|versus|or)\\s+|,', chr(1), 'g'), chr(1)) AS l FROM c),
    k AS (SELECT id, a, list_transform(l, lambda x: list_filter(regexp_extract_all(x, '[a-z0-9-]+'), lambda t: length(t) > 2 AND t NOT IN ({_QSTOP}))) AS t FROM l),
    g AS (SELECT id, a, list_transform(t, lambda x: list_filter(x, lambda y: length(y) = list_max(list_transform(x, lambda z: length(z))))[1]) AS keys FROM k)
    SELECT id, list_filter(keys, lambda x: x IS NOT NULL AND NOT contains(a, x)) AS gaps FROM g""",
)
def coverage_gaps(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text AS q", "substr(text, length(text) div 2 + 1) AS a")
    return c.select("id", tag.coverage_gaps("q", "a").alias("gaps"))


# Turns as dense lines: their sentences as questions, as numbered steps, as clauses, or as they are.
_DENSE = "conv_id * 1000 + turn AS id, CASE conv_id % 4 WHEN 0 THEN replace(text, '. ', '? ') WHEN 1 THEN concat('(1) ', replace(text, '. ', '; (2) ')) WHEN 2 THEN replace(text, '. ', ';') ELSE text END AS t"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@plan.query(
    "compound_split",
    f"""WITH c0 AS (SELECT {_DENSE} FROM conversations), c AS (SELECT id, {_STRIP.format('t')} AS t FROM c0),
    k AS (SELECT *, length(t) - length(replace(t, '?', '')) AS q, len(regexp_extract_all(t, '\\([0-9]+\\)')) AS s, length(t) - length(replace(t, ';', '')) AS c, string_split_regex(t, '[.]\\s+') AS p FROM c),
    l AS (SELECT *, list_filter(list_transform(p, lambda x, i: {_STRIP.format("concat(x, CASE WHEN i < len(p) THEN '.' ELSE '' END)")}), lambda x: length(x) > 15) AS long FROM k),
    o AS (SELECT id, CASE WHEN q >= 2 THEN list_transform(list_filter(list_transform(string_split(t, '?'), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), lambda x: concat(x, '?'))
      WHEN s >= 2 THEN list_filter(list_transform(string_split_regex(t, '\\([0-9]+\\)'), lambda x: regexp_replace(x, '^[ ;,.]+|[ ;,.]+$', '', 'g')), lambda x: x <> '')
      WHEN c >= 2 THEN list_filter(list_transform(string_split(t, ';'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') WHEN length(t) > 180 AND len(long) >= 3 THEN long ELSE [] END AS parts FROM l)
    SELECT id, CAST(len(parts) AS INT) AS n, md5(array_to_string(parts, '|')) AS parts_md5 FROM o""",
)
def compound_split(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").selectExpr(*A._split(_DENSE)).withColumn("parts", tag.split_compound("t"))
    return c.select("id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|").cast("binary")).alias("parts_md5"))


_ANSWER = "conv_id * 1000 + turn AS id, CASE conv_id % 4 WHEN 0 THEN concat(' Not  Found', CASE WHEN turn % 2 = 0 THEN '. ' ELSE '' END) WHEN 1 THEN concat('Not found. ', text) ELSE regexp_replace(text, CASE WHEN turn % 3 = 0 THEN '.' ELSE 'zzz' END, ' '{g}) END AS answer"


@plan.query("refusals", f"WITH a AS (SELECT {_ANSWER.replace('{g}', ", 'g'")} FROM conversations) SELECT id, lower(regexp_replace(trim(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g')), '[.]$', '')) IN ('', 'not found') AS refused FROM a")
def refusals(spark, sf_dir):
    """Answers that are the refusal, begin with it, are turns, or are blank."""
    return A.table(spark, sf_dir, "conversations").selectExpr(*A._split(_ANSWER.replace("{g}", ""))).select("id", tag.is_refusal("answer", "not found.").alias("refused"))


@plan.query("replies_parsed", "SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 3 > 0 THEN role END AS label, CASE WHEN conv_id % 3 > 0 THEN length(text)::INT END AS n, CASE WHEN conv_id % 3 > 0 THEN md5(text) END AS said_md5 FROM conversations")
def replies_parsed(spark, sf_dir):
    """Replies with JSON of a turn, in a fence or between sentences, or without any."""
    json = "to_json(named_struct('label', role, 'n', length(text), 'said', text))"
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", f"CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(10), '```json', chr(10), {json}, chr(10), '```') ELSE concat(text, ' ', {json}, ' ', text) END AS reply")
    return tag.replies(c, "label string, n int, said string").select("id", "parsed.label", "parsed.n", F.md5(F.col("parsed.said").cast("binary")).alias("said_md5"))


@plan.query("lines_parsed", "SELECT conv_id * 1000 + turn AS id, CASE WHEN contains(text, '. ') THEN [concat('L', turn), concat('T', conv_id % 3)] ELSE [concat('L', turn)] END AS refs, role AS kind, md5(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS said_md5 FROM conversations")
def lines_parsed(spark, sf_dir):
    """Marks in a turn, and its role and text as fields."""
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "concat('[L', turn, '] ', replace(text, '. ', concat(' [T', conv_id % 3, ']. ')), ' [9] [L', turn, ']') AS r", "concat('Kind: ', role, ' ', chr(10), 'a line without a field', chr(10), ' SAID :', replace(text, chr(10), ' '), chr(10), 'kind: later') AS f")
    return c.select("id", tag.refs("r").alias("refs"), tag.fields("f").alias("m")).select("id", "refs", F.col("m")["kind"].alias("kind"), F.md5(F.col("m")["said"].cast("binary")).alias("said_md5"))


@plan.query("cards_coerced", "SELECT conv_id * 1000 + turn AS id, turn % 5 BETWEEN 1 AND 3 AND conv_id % 6 > 0 AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' AS kept FROM conversations")
def cards_coerced(spark, sf_dir):
    """Turns as cards of five places, of which three are known; some are blank."""
    c = A.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "turn % 5 AS slot", "CASE WHEN conv_id % 6 = 0 THEN regexp_replace(text, '[^ ]', '') ELSE text END AS question")
    ok, rest = tag.coerced_cards(c, spark.range(1, 4).withColumnRenamed("id", "slot"), ["slot"])
    return ok.withColumn("kept", F.lit(True)).unionByName(rest.withColumn("kept", F.lit(False))).select("id", "kept")


@plan.query("sections_backfilled", "WITH c AS (SELECT user_id % 30 AS board, event_type AS section, 'own' AS origin FROM events WHERE user_id % 4 = 0), s AS (SELECT DISTINCT user_id % 30 AS board, event_type AS section, 'scaffold' AS origin FROM events) SELECT board, section, origin, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT s.* FROM s ANTI JOIN c USING (board, section)) GROUP BY ALL")
def sections_backfilled(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").selectExpr("user_id", "user_id % 30 AS board", "event_type AS section")
    own = e.where("user_id % 4 = 0").select("board", "section", F.lit("own").alias("origin"))
    scaffold = e.select("board", "section", F.lit("scaffold").alias("origin")).distinct()
    return tag.backfilled(own, scaffold, ["board", "section"]).groupBy("board", "section", "origin").agg(F.count(F.lit(1)).alias("n"))


@plan.query("cards_pruned", f"WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS text, substr(text, length(text) // 2 + 1) AS topic FROM documents) SELECT doc_id FROM d WHERE len(list_filter({_TAGS('text', REGIONS)}, lambda x: NOT list_contains({_TAGS('topic', REGIONS)}, x))) = 0")
def cards_pruned(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", "substr(text, 1, length(text) div 2) AS text", "substr(text, length(text) div 2 + 1) AS topic")
    return tag.pruned(d, REGIONS).select("doc_id")


_LINED = "doc_id, replace(text, '. ', CASE doc_id % 3 WHEN 0 THEN concat('?', chr(10), '   ') WHEN 1 THEN concat('.', chr(10)) ELSE concat('?', chr(10)) END) AS t"


@plan.query(
    "declarative_lines",
    f"""WITH d AS (SELECT {_LINED} FROM documents), l AS (SELECT doc_id, string_split(coalesce(t, ''), chr(10)) AS l FROM d)
    SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: NOT ends_with({_STRIP.format('x')}, '?') AND NOT (regexp_matches(x, '^\\s{{2,}}\\S') AND i > 1 AND ends_with({_STRIP.format('l[i - 1]')}, '?'))), chr(10))) AS said_md5 FROM l""",
)
def declarative_lines(spark, sf_dir):
    """Documents whose sentences are questions, with or without reasons below them, or statements, one a line."""
    d = A.table(spark, sf_dir, "documents").selectExpr(*A._split(_LINED))
    return d.select("doc_id", F.md5(evaluate.declarative("t").cast("binary")).alias("said_md5"))


@plan.query("slugs", "SELECT doc_id, md5(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug_md5, CASE WHEN doc_id % 2 = 0 THEN concat_ws(' ', nullif(regexp_replace(lang, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(source, '^\\s+|\\s+$', '', 'g'), ''), 'focus') END AS query FROM documents")
def slugs(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", "source", "CASE WHEN doc_id % 2 = 0 THEN 'plan' ELSE 'intro' END AS section")
    return d.select("doc_id", F.md5(tag.slug("text").cast("binary")).alias("slug_md5"), tag.search_text(["lang", "source"], {"plan": "focus"}).alias("query"))
