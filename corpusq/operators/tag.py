"""Tags and fields read from text. Lexicons are parameters: {tag: [terms]}, or a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEVEL_RANGE = r"\b([clts])([0-9]{1,2})\s*[-–]\s*([clts]?)([0-9]{1,2})\b"
LEVEL = r"\b([clts][0-9]{1,2})\b"


def tagged(rows: DataFrame, lexicon: dict[str, list[str]], text: str = "text") -> DataFrame:
    """X1. tags: all that occur; first_tag: the first of them, or null."""
    return rows.withColumn("tags", T.tags(text, lexicon)).withColumn("first_tag", F.try_element_at("tags", F.lit(1)))


def checklist(tags: Column, dimensions: dict[str, list[str]], always: list[str], extra: Column | None = None) -> Column:
    """X2. The dimensions of the tags, in their order, each once, then those that hold always, then new extra themes."""
    m = F.create_map(*[x for k, v in dimensions.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    out = F.array_union(F.flatten(F.transform(tags, lambda t: F.coalesce(F.try_element_at(m, t), F.array().cast("array<string>")))), F.array(*[F.lit(a) for a in always]))
    if extra is None:
        return out
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    have = F.transform(out, plain)
    return F.concat(out, F.filter(extra, lambda e: ~F.array_contains(have, plain(e))))


def ambiguity(questions: DataFrame, axes: dict[str, dict]) -> DataFrame:
    """X3. (query_id, query, found): the first axis of which a trigger stands in the question, or two variants in the texts
    found. axes: {name: {"triggers": [...], "variants": {variant: [terms]}}}."""
    hits = []
    for name, a in axes.items():
        trigger = F.size(T.tags("query", {"t": a["triggers"]})) > 0
        named = F.size(T.tags("found", a["variants"])) >= 2
        hits.append(F.when(trigger | named, F.lit(name)))
    return questions.withColumn("axis", F.coalesce(*hits)).withColumn("tripped", F.col("axis").isNotNull())


def levels(text) -> Column:
    """X4. Level codes such as c5: both ends of ranges, the second with the first's letter if it has none, and single ones."""
    low = F.lower(F.coalesce(T.col(text), F.lit("")))
    parts = [F.regexp_extract_all(low, F.lit(LEVEL_RANGE), F.lit(i)) for i in range(1, 5)]
    ends = F.transform(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), lambda r: F.array(F.concat(r["p0"], r["p1"]), F.concat(F.coalesce(F.nullif(r["p2"], F.lit("")), r["p0"]), r["p3"])))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(ends), F.regexp_extract_all(low, F.lit(LEVEL)))))


def intake(cases: DataFrame, text: str = "text") -> DataFrame:
    """X5. age (over 0, under 130), sex (nouns, then pronouns), laterality (the most frequent, of those the first; handedness
    does not count) and level (a range before a single one)."""
    t = F.coalesce(F.col(text), F.lit(""))
    age = F.expr(f"try_cast(nullif(regexp_extract(coalesce({text}, ''), '(?i)\\\\b([0-9]{{1,3}})[- ]?(?:year|yr|y/?o)', 1), '') as int)")
    sex = F.when(t.rlike(r"(?i)\b(female|woman|girl|lady)\b"), "F").when(t.rlike(r"(?i)\b(male|man|boy|gentleman)\b"), "M").when(t.rlike(r"(?i)\b(she|her|hers)\b"), "F").when(t.rlike(r"(?i)\b(he|him|his)\b"), "M").otherwise("")
    sides = F.regexp_extract_all(F.lower(F.regexp_replace(t, r"(?i)\b(?:left|right)[\s-]?handed\b", " ")), F.lit(r"\b(bilateral|midline|left|right)\b"))
    best = F.array_max(F.transform(sides, lambda s, i: F.struct(F.size(F.filter(sides, lambda x: x == s)).alias("n"), (-i).alias("i"), s.alias("s"))))
    found = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b([CTLS][0-9]{1,2}\s*[-–/]\s*[CTLS]?[0-9]{1,2}|[CTLS][0-9]{1,2})\b")), lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, r"[–/]", "-"), r"\s+", "")))
    ranged = F.filter(found, lambda x: F.contains(x, F.lit("-")))
    return cases.withColumn("age", F.when((age > 0) & (age < 130), age)).withColumn("sex", sex).withColumn("laterality", F.coalesce(best["s"], F.lit(""))).withColumn("level", F.coalesce(F.try_element_at(ranged, F.lit(1)), F.try_element_at(found, F.lit(1)), F.lit("")))


def floored(given: DataFrame, floor: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """X6. Blank fields filled from another table."""
    own = floor.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    blank = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    return given.join(own, key, "left").select(*[c for c in given.columns if c not in fields], *[F.coalesce(blank(f), F.col(f"_{f}").cast("string")).alias(f) for f in fields])


def coerced(rows: DataFrame, enums: dict[str, dict[str, str]], lists: list[str] = (), ints: list[str] = ()) -> DataFrame:
    """X7. Enum fields to their canonical value ("" if unknown), scalars to lists, integers if they are."""
    out = rows
    for f, values in enums.items():
        m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        out = out.withColumn(f, F.coalesce(F.try_element_at(m, F.lower(T.trimmed(F.coalesce(f, F.lit(""))))), F.lit("")))
    for f in lists:
        out = out.withColumn(f, F.filter(F.transform(F.split(F.coalesce(f, F.lit("")), r"[;,]"), T.trimmed), lambda x: x != ""))
    for f in ints:
        out = out.withColumn(f, F.expr(f"try_cast({f} as int)"))
    return out


def topic(parts: list[str], fallback: str = "") -> Column:
    """X8. The distinct parts that are not blank, joined."""
    some = F.array_distinct(F.array_compact(F.array(*[F.nullif(T.collapsed(F.col(p).cast("string")), F.lit("")) for p in parts])))
    return F.coalesce(F.nullif(F.array_join(some, " "), F.lit("")), F.lit(fallback))


def missing(fields: list[str], most: int = 3) -> Column:
    """X8. The first blank fields."""
    return F.slice(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields])), 1, most)


def profile(texts: list[str], lexicon: dict[str, list[str]], default: str = "generic") -> Column:
    """X9. The first tag of the first text that has one."""
    return F.coalesce(*[F.try_element_at(T.tags(t, lexicon), F.lit(1)) for t in texts], F.lit(default))


#: X15. Words of questions that no limb is about. Fixed values.
QUESTION_STOP = ["compare", "comparison", "what", "which", "how", "is", "are", "the", "for", "of", "a", "an", "and", "or", "vs", "versus", "do", "does", "between", "with", "in", "on", "to", "difference", "when", "why", "who", "that", "this", "should", "can", "role"]


def coverage_gaps(question, answer) -> Column:
    """X15. A question's limbs (between and, or, vs, versus and commas) whose longest term the answer lacks."""
    limbs = F.split(F.lower(T.trimmed(F.coalesce(T.col(question), F.lit("")))), r"\s+(?:and|vs\.?|versus|or)\s+|,")

    def key(limb):
        toks = F.filter(F.regexp_extract_all(limb, F.lit("([a-z0-9-]+)")), lambda t: ~t.isin(QUESTION_STOP) & (F.length(t) > 2))
        return F.array_max(F.transform(toks, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]

    low = F.lower(F.coalesce(T.col(answer), F.lit("")))
    return F.filter(F.transform(limbs, key), lambda k: k.isNotNull() & ~F.contains(low, k))


def split_compound(text) -> Column:
    """X16. A dense line's parts: two questions or more, steps (1) (2), three clauses by semicolon, or, past 180 letters, three
    sentences of over 15; else nothing."""
    t = T.trimmed(F.coalesce(T.col(text), F.lit("")))
    some = lambda a: F.filter(F.transform(a, T.trimmed), lambda x: x != "")
    questions = F.transform(some(F.split(t, r"\?")), lambda x: F.concat(x, F.lit("?")))
    steps = F.filter(F.transform(F.split(t, r"\([0-9]+\)"), lambda x: F.regexp_replace(x, r"^[ ;,.]+|[ ;,.]+$", "")), lambda x: x != "")
    long = F.filter(F.transform(F.split(t, r"(?<=[.])\s+"), T.trimmed), lambda x: F.length(x) > 15)
    none = F.array().cast("array<string>")
    return (
        F.when(F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit(""))) >= 2, questions)
        .when(F.regexp_count(t, F.lit(r"\([0-9]+\)")) >= 2, steps)
        .when(F.length(t) - F.length(F.replace(t, F.lit(";"), F.lit(""))) >= 2, some(F.split(t, ";")))
        .when((F.length(t) > 180) & (F.size(long) >= 3), long)
        .otherwise(none)
    )


def is_refusal(answer, refusal: str) -> Column:
    """X17. The whole answer is the refusal, up to case, white space and a full stop; so is an empty one."""
    plain = lambda c: F.lower(F.regexp_replace(T.collapsed(c), r"\.$", ""))
    return plain(answer).isin("", refusal.strip().rstrip(".").lower())


def replies(rows: DataFrame, schema: str, text: str = "reply") -> DataFrame:
    """X18. The outermost {...} of a model's reply, parsed; null if there is none or it does not parse."""
    body = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    return rows.withColumn("parsed", F.from_json(body, schema))


def refs(text, pattern: str = r"\[([TL][0-9]+)\]") -> Column:
    """X19. The reference marks of a line, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(T.col(text), F.lit("")), F.lit(pattern)))


def fields(text, pair: str = r"\n", sep: str = ":") -> Column:
    """X19. Lines "key: value" as a map, keys lowered."""
    pairs = F.filter(F.transform(F.split(F.coalesce(T.col(text), F.lit("")), pair), lambda x: F.struct(F.lower(T.trimmed(F.substring_index(x, sep, 1))).alias("key"), T.trimmed(F.substring(x, F.instr(x, sep) + 1, F.length(x))).alias("value"), F.contains(x, F.lit(sep)).alias("ok"))), lambda p: p["ok"] & (p["key"] != ""))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def coerced_cards(cards: DataFrame, vocabulary: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """X20. The cards whose place is in the vocabulary and whose question is not blank, and the rest."""
    ok = cards.where(T.trimmed(F.coalesce("question", F.lit(""))) != "").join(vocabulary.select(*keys).distinct(), keys, "left_semi")
    blank = cards.where(T.trimmed(F.coalesce("question", F.lit(""))) == "")
    return ok, blank.unionByName(cards.where(T.trimmed(F.coalesce("question", F.lit(""))) != "").join(vocabulary.select(*keys).distinct(), keys, "left_anti"))


def backfilled(cards: DataFrame, scaffold: DataFrame, keys: list[str]) -> DataFrame:
    """X21. The cards, and those of the scaffold for each section that has none."""
    return cards.unionByName(scaffold.join(cards.select(*keys).distinct(), keys, "left_anti"))


def pruned(cards: DataFrame, lexicon: dict[str, list[str]], topic_text: str = "topic", card_text: str = "text") -> DataFrame:
    """X22. Without cards that name a region when their topic names none of that region."""
    foreign = F.size(F.array_except(T.tags(card_text, lexicon), T.tags(topic_text, lexicon))) > 0
    return cards.where(~foreign)


def search_text(field_names: list[str], focus: dict[str, str], section: str = "section") -> Column:
    """X26. A section's search text: the semantic fields and the section's focus; null for sections without one."""
    m = F.create_map(*[F.lit(x) for kv in focus.items() for x in kv])
    token = F.try_element_at(m, F.col(section))
    return F.when(token.isNotNull(), F.nullif(F.concat_ws(" ", *[F.nullif(T.trimmed(F.col(f).cast("string")), F.lit("")) for f in field_names], token), F.lit("")))


def slug(text) -> Column:
    """X25. Lowered, with single hyphens between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(T.col(text), F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
