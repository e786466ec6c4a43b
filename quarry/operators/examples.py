"""Question-answering rows turned into training examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry import fixed_values as fv
from quarry.functions import templates as M
from quarry.functions import text as T
from quarry.operators.ordering import seeded_choice, seeded_hash, take_quota, top_k, with_successor
from quarry.session import materialize

PROMPTS, CHUNKS = len(fv.PROMPT_FORMATS), len(fv.CHUNK_FORMATS)


def _example(df: DataFrame, prompt: Column, answer: Column, source: Column | str, layer: int) -> DataFrame:
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(
        "id", prompt.alias("input"), answer.alias("output"), source.alias("source"), F.lit(layer).alias("layer")
    )


def cap_per_source(examples: DataFrame, cap: int, seed: str | int = 42, by: str = "source") -> DataFrame:
    """At most ``cap`` rows per source, chosen by seeded hash."""
    keyed = examples.withColumn("_k", seeded_hash(seed, F.col("id")))
    return take_quota(keyed, [by], "_k", cap, ["id"]).drop("_k")


def extractive_layer(qa: DataFrame) -> DataFrame:
    """``qa``: id, context, question, answers.  Answerable rows, formats rotated by id."""
    rows = qa.filter(F.size("answers") > 0)
    chunk = M.render_chunk(M.rotate(F.col("id"), CHUNKS), F.lit(1), F.lit("document"), F.col("context"))
    prompt = M.render_example(
        M.rotate(F.col("id"), PROMPTS), F.col("question"), chunk, F.col("context"),
        F.concat(F.lit("content="), "context"),
    )
    return _example(rows, prompt, F.get("answers", F.lit(0)), "squad_v2", 1)


def multi_hop_layer(rows: DataFrame) -> DataFrame:
    """``rows``: id, titles, sentences, question, answer.  The first three titled paragraphs as numbered chunks."""
    parts = F.slice(F.arrays_zip(F.col("titles").alias("title"), F.col("sentences").alias("body")), 1, 3)
    chunks = F.array_join(
        F.transform(parts, lambda c, i: M.render_chunk(
            M.rotate(i, CHUNKS), i + 1, c["title"], F.array_join(c["body"], " ")
        )),
        "\n",
    )
    staged = rows.withColumn("_chunks", chunks)
    joined = F.col("_chunks")
    prompt = M.render_example(M.rotate(F.col("id"), PROMPTS), F.col("question"), joined, joined, joined)
    return _example(staged, prompt, F.col("answer"), "hotpotqa", 2)


def numeric_layer(rows: DataFrame) -> DataFrame:
    """``rows``: id, passage, question, spans.  First span is the answer."""
    kept = rows.filter(F.size("spans") > 0)
    chunk = M.render_chunk(M.rotate(F.col("id"), CHUNKS), F.lit(1), F.lit("document"), F.col("passage"))
    prompt = M.render_example(
        M.rotate(F.col("id"), PROMPTS), F.col("question"), chunk, F.col("passage"),
        F.concat(F.lit("passage="), "passage"),
    )
    return _example(kept, prompt, F.get("spans", F.lit(0)), "drop", 2)


def conversational_layer(rows: DataFrame) -> DataFrame:
    """``rows``: id, story, questions, answers.  One turn per story, rotated by id."""
    kept = rows.filter((F.size("questions") > 0) & (F.size("answers") > 0))
    turn = F.pmod(F.col("id"), F.size("questions")).cast("int")
    chunk = M.render_chunk(M.rotate(F.col("id"), CHUNKS), F.lit(1), F.lit("story"), F.col("story"))
    prompt = M.render_example(
        M.rotate(F.col("id"), PROMPTS), F.get("questions", turn), chunk, F.col("story"),
        F.concat(F.lit("story="), "story"),
    )
    return _example(kept, prompt, F.get("answers", turn), "coqa", 2)


def format_layer(qa: DataFrame) -> DataFrame:
    """Every answerable row in all prompt formats."""
    rows = qa.filter(F.size("answers") > 0).select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(PROMPTS)])).alias("_f")
    )
    kind = F.col("_f")
    chunk = M.render_chunk(M.rotate(kind, CHUNKS), F.lit(1), F.lit("document"), F.col("context"))
    prompt = M.render_example(
        kind, F.col("question"), chunk, F.col("context"), F.concat(F.lit("content="), "context")
    )
    source = F.concat(F.lit("format_variance_"), kind.cast("string"))
    return _example(rows, prompt, F.get("answers", F.lit(0)), source, 3)


def flatten_squad(nested: DataFrame) -> DataFrame:
    """data[] to paragraphs[] to qas[]: id, context, question, answers, is_impossible."""
    articles = nested.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    return articles.select("p.context", F.explode("p.qas").alias("q")).select(
        "q.id", "context", "q.question",
        F.transform("q.answers", lambda a: a["text"]).alias("answers"), "q.is_impossible",
    )


# ------------------------------------------------------------------ difficulty


def difficulty(context: Column, answers: Column, impossible: Column) -> Column:
    marks = F.length(context) - F.length(F.translate(context, ".!?", ""))
    words = F.size(F.filter(F.split(F.get(answers, F.lit(0)), "\\s+"), lambda w: w != ""))
    size = F.length(context)
    return (
        F.when(impossible | (F.size(answers) < 1), "hard")
        .when(((marks <= 2) & (words <= 3)) | (size < 150), "easy")
        .when((marks <= 5) | (size < 400), "medium")
        .otherwise("hard")
    )


def context_partners(contexts: DataFrame, seed: str | int) -> DataFrame:
    """Every distinct context with the next one in a seeded cyclic order: (context_key, partner_key).

    Partners always differ, however often a context is repeated; a context that
    is the only one has none.
    """
    distinct = contexts.select("context_key").distinct().withColumn("_h", seeded_hash(seed, F.col("context_key")))
    linked = with_successor(
        distinct, [], ["_h", "context_key"], F.substring("_h", 1, 3), ["context_key"], cyclic=True
    )
    pairs = linked.select("context_key", F.col("successor.context_key").alias("partner_key"))
    return pairs.filter(F.col("context_key") != F.col("partner_key"))


def keyed_contexts(qa: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with context_key, one row per distinct context, cut to ``limit`` characters before it is moved)."""
    rows = qa.withColumn("context_key", F.md5("context"))
    body = F.col("context") if limit is None else F.substring("context", 1, limit)
    return rows, rows.groupBy("context_key").agg(F.any_value(body).alias("context"))


def partner_texts(contexts: DataFrame, seed: str | int, limit: int | None = None) -> DataFrame:
    """Per distinct context the texts of the next two contexts: (context_key, first, second); null where there is none."""
    link = context_partners(contexts, seed)
    body = F.col("context") if limit is None else F.substring("context", 1, limit)
    text = contexts.select(F.col("context_key").alias("_k"), body.alias("_t"))
    second = link.select(F.col("context_key").alias("partner_key"), F.col("partner_key").alias("second_key"))
    chained = link.join(second, "partner_key", "left")
    return (
        chained.join(text.toDF("partner_key", "first"), "partner_key")
        .join(text.toDF("second_key", "second"), "second_key", "left")
        .select("context_key", "first", "second")
    )


def negative_pairs(qa: DataFrame, seed: str | int = "negative") -> DataFrame:
    """Every question with the context of another example: id, question, context, wrong_context."""
    rows, contexts = keyed_contexts(qa)
    link = context_partners(contexts, seed)
    text = contexts.toDF("partner_key", "wrong_context")  # the questions go to the texts, which are not moved again
    return rows.join(link, "context_key").join(text, "partner_key").select("id", "question", "context", "wrong_context")


def attach_distractors(qa: DataFrame, contexts: DataFrame | None = None, seed: str | int = "distractor") -> DataFrame:
    """Add ``chunks``: the context and one or two other contexts, half of the rows in another order.

    All rows stay; a row whose context is the only one has no chunk but its own.

    ``contexts`` (context_key, context) is where the other contexts come from,
    by default the rows themselves. Rows whose contexts are cut bring the
    ``context_key`` of the whole ones.
    """
    c = fv.DIFFICULTY_CHARS
    key = F.col("context_key") if "context_key" in qa.columns else F.md5("context")
    rows = qa.withColumns({"context_key": key, "_head": F.substring("context", 1, c["hard"])})
    if contexts is None:
        contexts = keyed_contexts(qa, c["distractor"])[1]
    rows = rows.join(partner_texts(contexts, seed, c["distractor"]), "context_key", "left")
    two = seeded_choice(f"{seed}-count", F.col("id"), 2) == 1
    mixed = seeded_choice(f"{seed}-order", F.col("id"), 2) == 1
    head = F.concat(F.lit("[1] document.txt: "), F.col("_head"))
    other = F.concat(F.lit("[2] other_file.txt: "), F.col("first"))
    third = F.concat(F.lit("[3] other_file.txt: "), F.col("second"))
    parts = F.array_compact(F.when(two, F.array(head, other, third)).otherwise(F.array(head, other)))
    by_hash = F.transform(
        F.array_sort(F.transform(parts, lambda t, i: F.struct(
            seeded_hash(f"{seed}-place", F.col("id"), i).alias("h"), t.alias("t"),
        ))),
        lambda s: s["t"],
    )
    return rows.withColumn("chunks", F.array_join(F.when(mixed, by_hash).otherwise(parts), "\n")).drop(
        "context_key", "_head", "first", "second"
    )


def _prompt(context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col("question"))


def curriculum(qa: DataFrame, total: int, seed: str | int = 42) -> DataFrame:
    """Examples by difficulty with fixed shares; refusals take their share out of the hard part.

    ``qa``: id (unique), context, question, answers, is_impossible.
    Output: id, kind, difficulty, input, output.
    """
    c, share = fv.DIFFICULTY_CHARS, fv.DIFFICULTY_SHARES
    negatives = int(total * fv.NEGATIVE_SHARE)
    quota = {"easy": int(total * share["easy"]), "medium": int(total * share["medium"])}
    quota["hard"] = int(total * share["hard"]) - negatives
    keys = materialize(
        qa.select(
            "id", F.md5("context").alias("context_key"),
            difficulty(F.col("context"), F.col("answers"), F.col("is_impossible")).alias("difficulty"),
            seeded_hash(seed, F.col("id")).alias("_k"),
        ),
        "keys",
    )
    contexts = context_heads(qa)
    limit = F.lit(0)
    for name, n in quota.items():
        limit = F.when(F.col("difficulty") == name, n).otherwise(limit)
    chosen = take_quota(keys, ["difficulty"], "_k", limit, ["id"]).select("id", "difficulty")
    longest = max(c["easy"], c["medium"], c["hard"])  # no format shows more of a row's own context
    heads = qa.select("id", "question", "answers", "is_impossible", F.md5("context").alias("context_key"), F.substring("context", 1, longest).alias("context"))
    taken = heads.join(chosen, "id")
    answer = F.get("answers", F.lit(0))
    plain = taken.filter(F.col("difficulty") != "hard").select(
        "id", F.lit("positive").alias("kind"), "difficulty",
        _prompt(
            F.when(F.col("difficulty") == "easy", F.substring("context", 1, c["easy"])).otherwise(
                F.concat(F.lit("[1] document.txt: "), F.substring("context", 1, c["medium"]))
            )
        ).alias("input"),
        answer.alias("output"),
    )
    hard = attach_distractors(taken.filter(F.col("difficulty") == "hard"), contexts).select(
        "id", F.lit("positive").alias("kind"), "difficulty", _prompt(F.col("chunks")).alias("input"),
        F.when(F.col("is_impossible") | (F.size("answers") < 1), fv.REFUSAL).otherwise(answer).alias("output"),
    )
    return plain.unionByName(hard).unionByName(refusals_from(qa, keys, contexts, negatives, seed))


def context_heads(qa: DataFrame) -> DataFrame:
    """Distinct contexts, written once: of other contexts the formats show no more than their first characters."""
    longest = max(fv.DIFFICULTY_CHARS["negative"], fv.DIFFICULTY_CHARS["distractor"])
    heads = qa.select(F.md5("context").alias("context_key"), F.substring("context", 1, longest).alias("context"))
    return materialize(heads.distinct(), "contexts")


def refusals_from(qa: DataFrame, keys: DataFrame, contexts: DataFrame, n: int, seed: str | int) -> DataFrame:
    """``n`` questions with the context of another example, half of them with one more unrelated chunk.

    ``keys``: id, context_key of all rows.
    """
    c = fv.DIFFICULTY_CHARS
    order = keys.select("id", "context_key", seeded_hash(f"{seed}-negative", F.col("id")).alias("_n"))
    picked = take_quota(order, [], "_n", n, ["id"]).drop("_n")
    asked = qa.select("id", "question").join(picked, "id")
    asked = asked.join(partner_texts(contexts, "negative", c["negative"]), "context_key")
    first = F.concat(F.lit("[1] unrelated.txt: "), F.col("first"))
    second = F.concat(F.lit("\n[2] another.txt: "), F.substring("second", 1, c["distractor"]))
    more = seeded_choice("negative-more", F.col("id"), 2) == 1
    return asked.select(
        "id", F.lit("negative").alias("kind"), F.lit("hard").alias("difficulty"),
        _prompt(F.concat(first, F.coalesce(F.when(more, second), F.lit("")))).alias("input"), F.lit(fv.REFUSAL).alias("output"),
    )


# ------------------------------------------------------------------- polarity


def with_polarity(examples: DataFrame) -> DataFrame:
    return examples.withColumn("polarity", F.when(T.is_refusal(F.col("output")), "negative").otherwise("positive"))


def budget_sample(examples: DataFrame, total: int, seed: str | int = 42) -> DataFrame:
    """Three quarters positive, one quarter negative of ``total``, as far as there are rows."""
    keyed = with_polarity(examples).withColumn("_k", seeded_hash(seed, F.col("id")))
    quota = F.when(F.col("polarity") == "positive", int(total * fv.POSITIVE_SHARE)).otherwise(
        int(total * fv.REFUSAL_SHARE)
    )
    return take_quota(keyed, ["polarity"], "_k", quota, ["id"]).drop("_k")


def rewrite(examples: DataFrame, rewriter) -> DataFrame:
    """Apply a text rewriting plug-in; short or failed results keep the original answer.

    ``rewriter``: a column expression or pandas UDF over (input, output) that
    returns null on failure.
    """
    new = examples.withColumn("_new", rewriter(F.col("input"), F.col("output")))
    bad = F.coalesce(F.length("_new") < fv.MIN_REWRITE_CHARS, F.lit(True))
    return new.withColumns(
        {
            "original_extractive": F.col("output"),
            "fell_back": bad,
            "output": F.when(bad, F.col("output")).otherwise(F.col("_new")),
        }
    ).drop("_new")


def rewrite_batches(examples: DataFrame, open_rewriter: Callable, seen: Observation | None = None, batch_rows: int = 64, attempts: int = 3) -> DataFrame:
    """As :func:`rewrite` with a plug-in that takes whole batches, for example a model.

    ``open_rewriter()`` is called once per task and gives a function of a list of (input, output) that returns a list of
    texts or nulls. A batch for which it raises is tried again ``attempts`` times and then in halves, so an example that
    fails for good takes no other with it; it keeps its answer and is ``failed``. With ``seen`` the numbers of rows,
    fallbacks and failures are observed while the result is written.
    """
    fields = [f for f in examples.schema.fields if f.name not in ("original_extractive", "fell_back", "failed")]
    schema = ST.StructType([*fields, ST.StructField("_new", ST.StringType()), ST.StructField("failed", ST.BooleanType())])

    def run(batches):
        rewriter = open_rewriter()

        def tried(rows: list[tuple]) -> list[tuple]:
            for _ in range(attempts if len(rows) > 1 else attempts + 1):
                try:
                    new = rewriter(rows)
                    if len(new) != len(rows):
                        raise ValueError(f"{len(rows)} examples in, {len(new)} out")
                    return [(text, False) for text in new]
                except Exception:  # whatever a plug-in raises
                    continue
            if len(rows) == 1:
                return [(None, True)]
            half = len(rows) // 2
            return tried(rows[:half]) + tried(rows[half:])

        for pdf in batches:
            rows = list(zip(pdf["input"], pdf["output"]))
            done = [r for i in range(0, len(rows), batch_rows) for r in tried(rows[i:i + batch_rows])]
            yield pdf[[f.name for f in fields]].assign(_new=[d[0] for d in done], failed=[d[1] for d in done])

    out = rewrite(examples.mapInPandas(run, schema), lambda *_: F.col("_new"))
    if seen is None:
        return out
    return out.observe(seen, F.count("*").alias("rows"), F.count_if("fell_back").alias("fell_back"), F.count_if("failed").alias("failed"))


# ------------------------------------------------------------------ reporting


def layer_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("layer", "source").agg(F.count("*").alias("n"))


def dataset_size(examples: DataFrame, by: list[str]) -> DataFrame:
    line = F.octet_length(F.to_json(F.struct("input", "output", "source", "layer"))) + 1
    return examples.groupBy(*by).agg(F.count("*").alias("n"), F.sum(line).alias("bytes"))


def preview(examples: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    return top_k(examples, by, [F.asc("id"), F.asc(F.md5("input"))], n)


def curriculum_hash(seed: str | int = 42) -> Column:
    """The place of an example inside its layer."""
    return seeded_hash(seed, F.col("layer"), F.col("source"), F.col("id"))


def curriculum_order(examples: DataFrame, seed: str | int = 42, partitions: int | None = None) -> DataFrame:
    """Layers in order, shuffled inside each; a range partitioning on (layer, hash) splits hot layers."""
    keyed = examples.withColumn("_h", curriculum_hash(seed))
    ranged = keyed.repartitionByRange(*([partitions] if partitions else []), "layer", "_h")
    return ranged.sortWithinPartitions("layer", "_h")


def phase_plan(counts: DataFrame, phases: DataFrame) -> DataFrame:
    """Rows per training phase; phases whose part was not written are reported as missing.

    ``counts``: part, n; ``phases``: phase, name, part, description.
    """
    return phases.join(counts, "part", "left").withColumns(
        {"missing": F.col("n").isNull(), "n": F.coalesce("n", F.lit(0).cast("bigint"))}
    )


def score_predictions(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Success per case: refusals by their mark, others by containing the expected text."""
    refused = T.is_refusal(F.col("prediction"))
    contained = F.contains(F.lower("prediction"), F.lower("expected"))
    return cases.join(predictions, "id").withColumn(
        "success", F.when(F.col("type") == "refusal", refused).otherwise(contained)
    )


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("type").agg(
        F.count_if("success").alias("correct"), F.count("*").alias("total"),
        F.avg(F.col("success").cast("int")).alias("accuracy"),
    )
