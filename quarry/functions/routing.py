"""Query routing as pure column expressions over (query, username)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_substring(query: Column, words: list[str]) -> Column:
    """At least one word occurs anywhere in the query (substring test)."""
    test = F.contains(query, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(query, F.lit(word))
    return test


def substring_hits(query: Column, words: list[str]) -> Column:
    """How many of the words occur in the query."""
    return F.size(F.filter(_list(words), lambda w: F.contains(query, w)))


def has_any_word(query: Column, words: list[str]) -> Column:
    """Variant of :func:`any_substring` that only accepts whole words."""
    quoted = "|".join(f"\\Q{w}\\E" for w in words)
    return F.rlike(query, F.lit(f"(?<![\\p{{L}}\\p{{N}}])(?:{quoted})(?![\\p{{L}}\\p{{N}}])"))


def whole_word_hits(query: Column, words: list[str]) -> Column:
    """Variant of :func:`substring_hits` that only counts whole words."""
    total = F.lit(0)
    for word in words:
        total = total + has_any_word(query, [word]).cast("int")
    return total


def tokens(query: Column) -> Column:
    return F.split(F.lower(query), "[^\\p{L}\\p{N}]+")


def search_terms(query: Column, username: Column) -> Column:
    """Content words of a query in first-seen order; "my" adds the user's name without digits."""
    words = tokens(query)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fv.SEARCH_STOPWORDS))
    owner = F.regexp_replace(F.coalesce(username, F.lit("")), "\\p{Nd}", "")
    owned = F.array_contains(words, "my") & (F.length(owner) > 1)
    return F.array_distinct(F.when(owned, F.array_append(kept, owner)).otherwise(kept))


def metrics(query: Column) -> Column:
    q = F.lower(query)
    found = F.flatten(
        F.array(*[F.when(any_substring(q, words), _list(names)).otherwise(_list([])) for names, words in fv.METRIC_WORDS])
    )
    return F.when(F.size(found) > 0, found).otherwise(_list(["all"]))


def system_sections(query: Column) -> Column:
    q = F.lower(query)
    found = F.array_compact(F.array(*[F.when(any_substring(q, words), name) for name, words in fv.SECTION_WORDS]))
    return F.when(F.size(found) > 0, found).otherwise(_list(["all"]))


def route(
    df: DataFrame, query: str = "query", username: str = "username", whole_words: bool = False
) -> DataFrame:
    """Add the routing decision of every query.

    New columns: tool, intent, target, search_terms, metrics, tools,
    combine_strategy.  The keyword counts are computed once in a first
    projection, the ordered rule chain reads them in a second one.  Words match
    anywhere in the query unless ``whole_words`` is set.
    """
    text = F.lower(F.col(query))
    has_any, keyword_hits = (has_any_word, whole_word_hits) if whole_words else (any_substring, substring_hits)
    tests = {
        "casual": has_any(text, fv.CASUAL_WORDS) & ~has_any(text, fv.CASUAL_FILE_SUFFIXES),
        "see": has_any(text, fv.SEE_WORDS),
        "memory": has_any(text, fv.MEMORY_WORDS),
        "multi": has_any(text, fv.MULTI_PATTERNS),
        "system": keyword_hits(text, fv.SYSTEM_WORDS),
        "file": keyword_hits(text, fv.FILE_WORDS),
        "web": has_any(text, fv.WEB_WORDS),
        "disk": has_any(text, fv.DISK_WORDS),
        "unsure": has_any(text, fv.AMBIGUOUS_WORDS),
        "read": has_any(text, fv.READ_WORDS),
        "open": has_any(text, fv.OPEN_WORDS),
    }
    signals = df.withColumn("_s", F.struct(*[test.alias(name) for name, test in tests.items()]))
    s = {name: F.col(f"_s.{name}") for name in tests}
    files = s["file"]
    rule = (
        F.when(s["casual"], "casual")
        .when(s["see"], "see")
        .when(s["memory"] & (files == 0), "memory")
        .when(s["multi"], "multi")
        .when((s["system"] > 0) & (s["system"] > files), "system")
        .when(s["web"], F.when(files == 0, "web").otherwise("mixed"))
        .when(s["disk"], "disk")
        .when((files > 1) & ~s["unsure"], F.when(s["read"], "read").when(s["open"], "open").otherwise("find"))
        .when(s["unsure"] | (files == 1), "multi")
        .otherwise("default")
    )
    decided = signals.withColumn("_rule", rule).drop("_s")
    r = F.col("_rule")
    with_terms = r.isin("read", "open", "find", "default")
    return decided.select(
        *[F.col(c) for c in df.columns],
        F.when(r == "casual", "conversation").when(r == "see", "see").when(r == "multi", "multi_query")
        .when(r == "web", "web_query").otherwise("local_query").alias("tool"),
        F.when(r == "memory", "recall").when(r.isin("system", "disk"), "analyze").when(r == "web", "search")
        .when(r.isin("read", "open"), r).when(r.isin("mixed", "find", "default"), "find").alias("intent"),
        F.when(r.isin("memory", "system", "disk"), r)
        .when(r.isin("read", "open", "find", "mixed", "default"), "files").alias("target"),
        F.when(with_terms, search_terms(F.col(query), F.col(username))).otherwise(_list([])).alias("search_terms"),
        F.when(r == "system", metrics(F.col(query))).otherwise(_list([])).alias("metrics"),
        F.when(r == "multi", _list(fv.MULTI_TOOLS)).otherwise(_list([])).alias("tools"),
        F.when(r == "multi", "parallel").alias("combine_strategy"),
    )


def route_fallback(query: Column) -> Column:
    """Second router: whole-word patterns, local files when nothing matches."""
    q = F.lower(query)

    def hit(pattern: str) -> Column:
        return F.rlike(q, F.lit(pattern))

    return (
        F.when(hit(fv.FALLBACK_LOCAL) | hit(fv.FALLBACK_SYSTEM) | hit(fv.FALLBACK_MEMORY), "local_query")
        .when(hit(fv.FALLBACK_WEB) & ~hit(fv.FALLBACK_NOT_WEB), "web_query")
        .when(hit(fv.FALLBACK_CHAT), "conversation")
        .otherwise("local_query")
    )


def normalize_tool(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fv.TOOL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(name))), F.lit("no_tool"))


def smart_defaults(query: Column, tool: Column, file_types: Column, location: Column, date_range: Column) -> Column:
    """struct(file_types, location, date_range) with gaps filled from the wording of the query."""
    q = F.lower(query)
    applies = tool.isin(fv.SMART_DEFAULT_TOOLS)
    hinted = F.array_distinct(F.flatten(
        F.array(*[F.when(any_substring(q, words), _list(names)).otherwise(_list([])) for names, words in fv.FILE_TYPE_HINTS])
    ))
    given = F.coalesce(F.size(file_types) > 0, F.lit(False))
    types = F.when(given | ~applies, F.coalesce(file_types, _list([]))).otherwise(hinted)
    no_types = F.size(types) == 0
    place = None
    for name, words in fv.LOCATION_HINTS:
        test = any_substring(q, words)
        if name == "documents":
            test = test & no_types
        place = F.when(test, name) if place is None else place.when(test, name)
    when = None
    for name, words in fv.DATE_RANGE_HINTS:
        when = F.when(any_substring(q, words), name) if when is None else when.when(any_substring(q, words), name)
    return F.struct(
        types.alias("file_types"),
        F.when(applies, F.coalesce(F.nullif(location, F.lit("")), place)).otherwise(location).alias("location"),
        F.when(applies, F.coalesce(F.nullif(date_range, F.lit("")), when)).otherwise(date_range).alias("date_range"),
    )


def photo_keywords(query: Column, variant: str = "client") -> Column:
    """Photo search words: longer than two characters and not a filler word."""
    stop = fv.PHOTO_STOPWORDS_CLIENT if variant == "client" else fv.PHOTO_STOPWORDS_SERVER
    return F.filter(
        F.split(F.lower(query), "\\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop)
    )


def embedding_query(query: Column, terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(query)
