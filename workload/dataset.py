"""Training examples from documents and conversations."""

from __future__ import annotations

import contextlib

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import templates as M
from quarry.functions import text as T
from quarry.operators import examples as X
from quarry.operators import generators as G
from quarry.operators.ordering import seeded_hash
from quarry.plans import dataset as D
from quarry.session import discard, materialize, new_folder
from quarry.sources import tables as ST
from workload import bindings as B
from workload.registry import query, sql_list, sql_text


def s_fill(template, **slots):
    pieces = M._SLOT.split(template)
    parts = [sql_text(p).replace("\n", "' || chr(10) || '") if i % 2 == 0 else slots[p] for i, p in enumerate(pieces) if i % 2 or p]
    return " || ".join(parts)


def s_chunk(kind, idx, source, content):
    return f"CASE {kind} " + " ".join(
        f"WHEN {i} THEN {s_fill(t, idx=f'({idx})::VARCHAR', source=source, content=content)}"
        for i, t in enumerate(fv.CHUNK_FORMATS)
    ) + " END"


def s_example(kind, question, chunks, plain, kv, bullet=None, limit=500):
    escaped = f"""replace({plain}, '"', '\\"')"""
    escaped = f"substring({escaped}, 1, {limit})" if limit else escaped
    slots = dict(chunks=chunks, bullet=bullet or plain, kv=kv, escaped=escaped, messy=plain, question=question)
    return f"CASE {kind} " + " ".join(
        f"WHEN {i} THEN {s_fill(t, **slots)}" for i, t in enumerate(fv.PROMPT_FORMATS)
    ) + " END"


def s_layer(source_label, kv, chunk_kind="id % 5", kind="id % 8"):
    """SQL for a prompt over columns id, context, question."""
    chunk = "(" + s_chunk(chunk_kind, "1", f"'{source_label}'", "context") + ")"
    return s_example(kind, "question", chunk, "context", f"'{kv}=' || context")


def digests(examples, *more):
    return examples.select(
        "id", *more, F.md5("input").alias("input_md5"), F.length("input").alias("n"), F.md5("output").alias("output_md5"),
        "source", "layer",
    )


def s_digest(source, layer):
    return (f"md5(input) AS input_md5, length(input)::INTEGER AS n, md5(output) AS output_md5, {source} AS source, "
            f"{layer}::INTEGER AS layer")


@query("render_chunk", "WITH k AS (SELECT * FROM documents, (SELECT unnest(range(0, 5)) AS kind)) SELECT doc_id, kind::INTEGER AS kind, "
       f"md5({s_chunk('kind', 'doc_id % 3 + 1', 'source', 'text')}) AS chunk_md5 FROM k")
def render_chunk(t):
    kinds = t.documents.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kind"))
    chunk = M.render_chunk(F.col("kind"), F.pmod("doc_id", F.lit(3)) + 1, F.col("source"), F.col("text"))
    return kinds.select("doc_id", "kind", F.md5(chunk).alias("chunk_md5"))


@query("render_example", f"""
WITH {B.QA}, k AS (SELECT qa.*, kind FROM qa, (SELECT unnest(range(0, 8)) AS kind))
SELECT id, kind::INTEGER AS kind, md5({s_example('kind', 'question', "('[1] x: ' || context)", 'context', "'k=' || context")})
  AS prompt_md5 FROM k""")
def render_example(t):
    rows = B.qa(t).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("kind"))
    prompt = M.render_example(
        F.col("kind"), F.col("question"), F.concat(F.lit("[1] x: "), "context"), F.col("context"),
        F.concat(F.lit("k="), "context"),
    )
    return rows.select("id", "kind", F.md5(prompt).alias("prompt_md5"))


_L1 = f"l1 AS (SELECT id, {s_layer('document', 'content')} AS input, answer AS output FROM qa WHERE NOT is_impossible)"


@query("extractive_layer", f"WITH {B.QA}, {_L1} SELECT id, {s_digest(sql_text('squad_v2'), 1)} FROM l1")
def extractive_layer(t):
    return digests(X.extractive_layer(B.qa(t)))


def multi_hop(rows):
    """Every document's lines as sentences, with its language and source as further titled paragraphs."""
    body = F.split("context", "\n")
    return rows.select(
        "id", F.array(F.lit("Alpha"), F.lit("Beta"), F.lit("Gamma"), F.lit("Delta")).alias("titles"),
        F.array(body, F.array("question"), F.slice(body, 1, 2), F.array(F.lit("unused"))).alias("sentences"), "question",
        F.coalesce(F.get("answers", F.lit(0)), F.lit("none")).alias("answer"),
    )


_L2 = f"""hop AS (SELECT id, question, coalesce(answer, 'none') AS output, string_split(context, chr(10)) AS b FROM qa),
joined AS (SELECT id, question, output, {' || chr(10) || '.join('(' + s_chunk(str(i % 5), str(i + 1), f"'{title}'", body) + ')' for i, (title, body) in enumerate([('Alpha', "array_to_string(b, ' ')"), ('Beta', 'question'), ('Gamma', "array_to_string(b[1:2], ' ')")]))} AS c FROM hop),
l2 AS (SELECT id, output, {s_example('id % 8', 'question', 'c', 'c', 'c')} AS input FROM joined)"""


@query("multi_hop_layer", f"WITH {B.QA}, {_L2} SELECT id, {s_digest(sql_text('hotpotqa'), 2)} FROM l2")
def multi_hop_layer(t):
    return digests(X.multi_hop_layer(multi_hop(B.qa(t))))


def numeric(rows):
    return rows.select(
        "id", F.col("context").alias("passage"), "question",
        F.transform("answers", lambda a: F.length(a).cast("string")).alias("spans"),
    )


_L2N = f"""l2n AS (SELECT id, {s_layer('document', 'passage')} AS input, length(answer)::VARCHAR AS output FROM qa
  WHERE NOT is_impossible)"""


@query("numeric_layer", f"WITH {B.QA}, {_L2N} SELECT id, {s_digest(sql_text('drop'), 2)} FROM l2n")
def numeric_layer(t):
    return digests(X.numeric_layer(numeric(B.qa(t))))


def stories(t):
    """Every document as the story of one conversation, with all its question-answer turns."""
    asked, n = B.numbered_pairs(t)
    turns = asked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("qs"))
    told = t.documents.select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(n)).alias("k"), F.col("text").alias("story"))
    return told.join(turns, "k").select(
        "id", "story", F.transform("qs", lambda q: q["question"]).alias("questions"), F.transform("qs", lambda q: q["answer"]).alias("answers"),
    )


_L2C = f"""turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM numbered),
picked AS (SELECT d.doc_id AS id, d.text AS context, question, answer AS output FROM turns
  JOIN documents d ON turns.k = d.doc_id % (SELECT count(DISTINCT conv_id) FROM pairs) WHERE i = d.doc_id % n_turns),
l2c AS (SELECT id, output, {s_layer('story', 'story')} AS input FROM picked)"""


@query("conversational_layer", f"WITH {B.NUMBERED}, {_L2C} SELECT id, {s_digest(sql_text('coqa'), 2)} FROM l2c")
def conversational_layer(t):
    return digests(X.conversational_layer(stories(t)))


_L3 = f"""l3 AS (SELECT id, kind, {s_layer('document', 'content', 'kind % 5', 'kind')} AS input, answer AS output
  FROM qa, (SELECT unnest(range(0, 8)) AS kind) WHERE NOT is_impossible)"""


@query("format_layer", f"WITH {B.QA}, {_L3} SELECT id, {s_digest('''('format_variance_' || kind)''', 3)} FROM l3")
def format_layer(t):
    return digests(X.format_layer(B.qa(t)))


# ------------------------------------------------------------------- generated


def s_choice(salt, n):
    return f"(('0x' || substring(md5({sql_text(salt + ':')} || id), 1, 8))::BIGINT % {n})"


def s_pick(salt, values):
    return f"{sql_list(values)}[{s_choice(salt, len(values))} + 1]"


def seeds(t):
    return t.documents.select(F.col("doc_id").alias("id"))


def _domain_sql():
    cols = list(zip(*fv.SYSTEM_SPECS))
    names = ["cpu", "cores", "ram", "ram_free", "disk", "disk_free"]
    spec = ", ".join(f"{sql_list([str(v) for v in c])}[si + 1] AS {n}" for n, c in zip(names, cols))
    people = ", ".join(
        f"{sql_list(c)}[pi + 1] AS {n}" for n, c in zip(["job", "company", "lang", "city", "interests"], zip(*fv.PEOPLE))
    )
    questions = "[" + ", ".join(sql_list([q for q, _ in f[2]]) for f in fv.SAMPLE_FILES) + "][fi + 1]"
    answers = "[" + ", ".join(sql_list([a for _, a in f[2]]) for f in fv.SAMPLE_FILES) + "][fi + 1]"
    req = [fv.GAME_REQUIREMENTS[1], fv.GAME_REQUIREMENTS[1], fv.GAME_REQUIREMENTS[0]]
    kind = "n % 5"

    def chunk(idx, source, content):
        return "(" + s_chunk(kind, idx, source, content) + ")"

    line = "'CPU: ' || cpu || ', RAM: ' || ram"
    who = "'Favorite language: ' || lang || '. Lives in ' || city || '.'"
    machine = "'RAM: ' || ram || '. GPU: ' || cpu || '. Free disk: ' || disk_free || '.'"
    mixed = f"{chunk('1', 'fname', 'fcontent')} || chr(10) || {chunk('2', sql_text('system'), line)} || chr(10) || {chunk('3', sql_text('memory'), who)}"
    compared = f"{chunk('1', sql_text('system'), machine)} || chr(10) || {chunk('2', sql_text('web'), 'req')}"
    sys_q = sql_list(["How much RAM do I have?", "How many CPU cores?", "What CPU do I have?", "How much free disk space?",
                      "How much free RAM?", "Why is my computer slow?"])
    mem_q = sql_list(["What's my favorite programming language?", "Where do I live?", "What's my job?", "Where do I work?",
                      "What are my interests?"])
    mix_q = sql_list(["What's my favorite language?", "How much RAM do I have?", "What programming languages am I good at?"])
    return f"""s0 AS (SELECT doc_id AS id, doc_id % 5 AS family, doc_id // 5 AS n FROM documents),
s1 AS (SELECT *, {s_choice('spec', 5)} AS si, {s_choice('person', 3)} AS pi, {s_choice('file', 5)} AS fi FROM s0),
s2 AS (SELECT *, {spec}, {people}, {sql_list([f[0] for f in fv.SAMPLE_FILES])}[fi + 1] AS fname,
  {sql_list([f[1] for f in fv.SAMPLE_FILES])}[fi + 1] AS fcontent, {questions} AS fq, {answers} AS fa,
  {s_pick('requirement', req)} AS req FROM s1),
s3 AS (SELECT *, CASE {s_choice('system-format', 3)}
  WHEN 0 THEN 'CPU: ' || cpu || ', ' || cores || ' cores. RAM: ' || ram || ' total, ' || ram_free || ' free. Disk: ' || disk || ', ' || disk_free || ' free.'
  WHEN 1 THEN 'System specs - ' || cpu || ' (' || cores || 'c), Memory: ' || ram || ' (' || ram_free || ' available), Storage: ' || disk
  ELSE 'cpu=' || cpu || chr(10) || 'cores=' || cores || chr(10) || 'ram=' || ram || chr(10) || 'ram_free=' || ram_free || chr(10) || 'disk=' || disk_free || ' free' END AS sys,
  'Works as a ' || job || ' at ' || company || '. Favorite programming language is ' || lang || '. Lives in ' || city ||
  '. Interested in ' || interests || '.' AS mem,
  CASE WHEN replace(ram_free, 'GB', '')::INT <= 2 THEN 6 ELSE 5 END AS nq FROM s2),
s4 AS (SELECT *, ('0x' || substring(md5('system-qa:' || id), 1, 8))::BIGINT % nq + 1 AS sq, {s_choice('memory-qa', 5)} + 1 AS mq,
  {s_choice('mixed-qa', 3)} + 1 AS xq, ('0x' || substring(md5('file-qa:' || id), 1, 8))::BIGINT % len(fq) + 1 AS kq FROM s3),
s5 AS (SELECT *, CASE family WHEN 0 THEN {chunk('1', sql_text('system'), 'sys')} WHEN 1 THEN {chunk('1', 'fname', 'fcontent')}
    WHEN 2 THEN {chunk('1', sql_text('memory'), 'mem')} WHEN 3 THEN {mixed} ELSE {compared} END AS c,
  CASE family WHEN 0 THEN {sys_q}[sq] WHEN 1 THEN fq[kq] WHEN 2 THEN {mem_q}[mq] WHEN 3 THEN {mix_q}[xq]
    ELSE 'Can I run this game?' END AS question,
  CASE family WHEN 0 THEN [ram, cores, cpu, disk_free, ram_free, 'Only ' || ram_free || ' RAM free'][sq] WHEN 1 THEN fa[kq]
    WHEN 2 THEN [lang, city, job, company, interests][mq]
    WHEN 3 THEN [lang, ram, CASE WHEN contains(fname, 'resume') THEN 'Python, JavaScript, TypeScript, Go' ELSE lang END][xq]
    ELSE CASE WHEN replace(ram, 'GB', '')::INT >= 16 THEN 'Yes, meets minimum RAM requirement'
      ELSE 'No, need 16GB RAM but only have ' || ram END END AS output FROM s4),
s6 AS (SELECT *, CASE family WHEN 0 THEN sys WHEN 1 THEN fcontent WHEN 2 THEN mem ELSE c END AS plain,
  CASE family WHEN 1 THEN fname || '=' || fcontent WHEN 0 THEN sys WHEN 2 THEN mem ELSE c END AS kv,
  CASE family WHEN 3 THEN replace(c, '[', '• ') WHEN 0 THEN sys WHEN 1 THEN fcontent WHEN 2 THEN mem ELSE c END AS bullet FROM s5),
l4 AS (SELECT id, output, 'domain_' || ['system', 'file', 'memory', 'mixed', 'comparison'][family + 1] AS source,
  {s_example('n % 8', 'question', 'c', 'plain', 'kv', 'bullet', None)} AS input FROM s6)"""


@query("domain_layer", f"WITH {_domain_sql()} SELECT id, {s_digest('source', 4)} FROM l4")
def domain_layer(t):
    return digests(G.domain_examples(seeds(t)))


def _refusal_sql():
    pools = {"system": fv.REFUSAL_SYSTEM_CONTEXTS, "memory": fv.REFUSAL_MEMORY_CONTEXTS,
             "file": fv.REFUSAL_FILE_CONTEXTS, "web": fv.REFUSAL_WEB_CONTEXTS}
    wrong = fv.WRONG_DOMAIN_QUESTIONS
    contents = "[" + ", ".join(s_pick(f"wrong-{i}", pools[p]) for i, (p, _, _) in enumerate(wrong)) + "]"
    w, p = f"[{s_choice('wrong', 7)} + 1]", f"[{s_choice('partial', 5)} + 1]"
    scope = pools["system"] + pools["memory"] + pools["file"]

    def three(a, b, c):
        return f"CASE family WHEN 'wrong_domain' THEN {a} WHEN 'out_of_scope' THEN {b} ELSE {c} END"

    return f"""r0 AS (SELECT doc_id AS id, CASE WHEN doc_id % 100 < 40 THEN 'wrong_domain' WHEN doc_id % 100 < 75 THEN
  'out_of_scope' ELSE 'partial_match' END AS family FROM documents),
r1 AS (SELECT id, family, {s_choice('refusal-format', 8)} AS f,
  {three(contents + w, s_pick('scope-content', scope), sql_list([x[0] for x in fv.PARTIAL_MATCHES]) + p)} AS content,
  {three(sql_list([x[1] for x in wrong]) + w, s_pick('scope-source', fv.OUT_OF_SCOPE_SOURCES), sql_list([x[1] for x in fv.PARTIAL_MATCHES]) + p)} AS src,
  {three(sql_list([x[2] for x in wrong]) + w, s_pick('scope-question', fv.OUT_OF_SCOPE_QUESTIONS), sql_list([x[2] for x in fv.PARTIAL_MATCHES]) + p)} AS question
  FROM r0),
l5 AS (SELECT id, 'negative_' || family AS source, {sql_text(fv.REFUSAL)} AS output,
  {s_example('f', 'question', '(' + s_chunk('f % 5', '1', 'src', 'content') + ')', 'content', "src || '=' || content", None, None)}
  AS input FROM r1)"""


@query("refusal_layer", f"WITH {_refusal_sql()} SELECT id, {s_digest('source', 5)} FROM l5")
def refusal_layer(t):
    return digests(G.refusal_examples(seeds(t)))


@query("synthetic_set", f"""
WITH s AS (SELECT doc_id AS id FROM documents), p AS (SELECT id, {s_pick('entity', fv.SYNTHETIC_ENTITIES)} AS e,
  {s_pick('action', fv.SYNTHETIC_ACTIONS)} AS a, {s_pick('object', fv.SYNTHETIC_OBJECTS)} AS o,
  {s_pick('noise', fv.SYNTHETIC_NOISE)} AS noise, {s_choice('who', 2)} = 0 AS who, {s_choice('order', 2)} = 1 AS nf,
  id % 3 = 2 AND {s_choice('refused', 10)} = 0 AS refused FROM s),
q AS (SELECT *, e || ' ' || a || ' ' || o || '.' AS fact FROM p)
SELECT id, ['easy', 'medium', 'hard'][id % 3 + 1] AS difficulty, 'Context:' || chr(10) || CASE WHEN id % 3 = 0 THEN fact
  WHEN id % 3 = 1 THEN '[1] log.txt: ' || fact || ' Additional details here.' WHEN refused THEN '[1] noise.txt: ' || noise
  WHEN nf THEN '[2] noise.txt: ' || noise || chr(10) || '[1] log.txt: ' || fact
  ELSE '[1] log.txt: ' || fact || chr(10) || '[2] noise.txt: ' || noise END || chr(10) || chr(10) || 'Question: ' ||
  CASE WHEN who THEN 'Who ' || a || ' ' || o || '?' ELSE 'Where/What did ' || e || ' ' || a || '?' END AS input,
  CASE WHEN refused THEN {sql_text(fv.REFUSAL)} WHEN who THEN e ELSE o END AS output FROM q""")
def synthetic_set(t):
    return G.synthetic_examples(seeds(t))


# ---------------------------------------------------------------- mixing, shares


def layers_of(qa, told, t):
    return D.all_layers(qa, multi_hop(qa), numeric(qa), told, seeds(t))


def all_layers(t):
    return layers_of(B.qa(t), stories(t), t)


@contextlib.contextmanager
def written_layers(t):
    """All layers over rows that are joined once and written, for jobs that go over them several times."""
    qa, told = materialize(B.qa(t), "qa"), materialize(stories(t), "stories")
    try:
        yield layers_of(qa, told, t)
    finally:
        discard(qa, told)


_ALL = f"""{B.QA}, {_L1}, {_L2}, {_L2N}, {_L2C}, {_L3}, {_domain_sql()}, {_refusal_sql()}, every AS (
  SELECT id, input, output, 'squad_v2' AS source, 1 AS layer FROM l1
  UNION ALL SELECT id, input, output, 'hotpotqa', 2 FROM l2 UNION ALL SELECT id, input, output, 'drop', 2 FROM l2n
  UNION ALL SELECT id, input, output, 'coqa', 2 FROM l2c
  UNION ALL SELECT id, input, output, 'format_variance_' || kind, 3 FROM l3
  UNION ALL SELECT id, input, output, source, 4 FROM l4 UNION ALL SELECT id, input, output, source, 5 FROM l5)"""


@query("combine_layers", f"WITH {_ALL} SELECT id, source, layer, md5(input) AS input_md5, md5(output) AS output_md5 FROM every")
def combine_layers(t):
    return all_layers(t).select("id", "source", "layer", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


@query("layer_counts", f"WITH {_ALL} SELECT layer, source, count(*) AS n FROM every GROUP BY 1, 2")
def layer_counts(t):
    return X.layer_counts(all_layers(t))


@query("dataset_files", f"""
WITH {_ALL} SELECT layer, source, count(*) AS n, sum(strlen(input) + strlen(output))::BIGINT AS bytes FROM every GROUP BY 1, 2""")
def dataset_files(t):
    """The whole set written as JSON lines by layer in curriculum order and read back."""
    folder = new_folder(t.spark, "dataset")
    with written_layers(t) as examples:
        D.build(examples, folder)
    return ST.read_examples(t.spark, folder).groupBy("layer", "source").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("input") + F.octet_length("output")).alias("bytes")
    )


@query("dataset_size", """
SELECT source, count(*) AS n, sum(strlen(to_json({'input': text, 'output': lang, 'source': source, 'layer': 1})) + 1)::BIGINT AS bytes
FROM documents GROUP BY 1""")
def dataset_size(t):
    rows = t.documents.select(F.col("text").alias("input"), F.col("lang").alias("output"), "source", F.lit(1).alias("layer"))
    return X.dataset_size(rows, ["source"])


_H = "md5('{seed}:' || {ids})"


@query("cap_per_source", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r
FROM documents) WHERE r <= (SELECT count(*) // (2 * count(DISTINCT source)) FROM documents)""")
def cap_per_source(t):
    """At most half of the average source."""
    rows = t.documents.withColumn("id", F.col("doc_id"))
    n, sources = rows.agg(F.count("*"), F.count_distinct("source")).first()
    return X.cap_per_source(rows, n // (2 * sources)).select("doc_id", "source")


@query("cap_layers", f"""
WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY layer, CASE WHEN layer = 2 THEN source ELSE '' END
  ORDER BY md5('42:' || source || ':' || id), source, id) AS r FROM every),
s AS (SELECT {{{", ".join(f"'s{k}': floor(count(*) * 0.5::DOUBLE * {v} / {sum(fv.LAYER_SIZES.values())})::BIGINT" for k, v in fv.LAYER_SIZES.items())}}} AS s FROM every)
SELECT id, source, layer, md5(input) AS input_md5 FROM r, s
WHERE r <= CASE layer WHEN 1 THEN s.s1 WHEN 2 THEN s.s2 // 3 WHEN 3 THEN s.s3 WHEN 4 THEN s.s4 ELSE s.s5 END""")
def cap_layers(t):
    """The layers in the proportions of the recipe, half of all examples."""
    return D.cap_layers(all_layers(t), share=0.5).select("id", "source", "layer", F.md5("input").alias("input_md5"))


@query("seeded_shuffle", """
SELECT doc_id, substring(md5('7:' || doc_id), 1, 12) AS h, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS position
FROM documents""")
def seeded_shuffle(t):
    from quarry.operators.ordering import shuffle_rows

    shuffled = B.with_position(shuffle_rows(t.documents.select("doc_id"), 7, "doc_id"))
    return shuffled.select("doc_id", F.substring(seeded_hash(7, F.col("doc_id")), 1, 12).alias("h"), "position")


@query("curriculum_order", """
WITH keyed AS (SELECT doc_id AS id, CASE WHEN n_chars < 1000 THEN 1 ELSE 2 END AS layer,
  md5('42:' || CASE WHEN n_chars < 1000 THEN 1 ELSE 2 END || ':' || source || ':' || doc_id) AS h FROM documents)
SELECT id, layer, substring(h, 1, 8) AS h, row_number() OVER (ORDER BY layer, h) - 1 AS position FROM keyed""")
def curriculum_order(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "source", F.when(F.col("n_chars") < 1000, 1).otherwise(2).alias("layer"))
    ordered = B.with_position(X.curriculum_order(rows))
    return ordered.select("id", "layer", F.substring("_h", 1, 8).alias("h"), "position")


_MARKS = "(length(context) - length(translate(context, '.!?', '')))"
_WORDS = "len(list_filter(string_split_regex(answer, '[\\s\\x0b]+'), lambda w: w <> ''))"
_DIFF = f"""diff AS (SELECT *, CASE WHEN is_impossible THEN 'hard' WHEN ({_MARKS} <= 2 AND {_WORDS} <= 3) OR length(context) < 150
  THEN 'easy' WHEN {_MARKS} <= 5 OR length(context) < 400 THEN 'medium' ELSE 'hard' END AS difficulty FROM qa)"""


@query("difficulty", f"WITH {B.QA}, {_DIFF} SELECT id, difficulty FROM diff")
def difficulty(t):
    rows = B.qa(t)
    return rows.select("id", X.difficulty(F.col("context"), F.col("answers"), F.col("is_impossible")).alias("difficulty"))


@query("difficulty_histogram", f"WITH {B.QA}, {_DIFF} SELECT difficulty, count(*) AS n FROM diff GROUP BY 1")
def difficulty_histogram(t):
    return difficulty(t).groupBy("difficulty").agg(F.count("*").alias("n"))


def s_partners(seed, name):
    return f"""{name}0 AS (SELECT DISTINCT md5(context) AS k, context FROM qa), {name}1 AS (SELECT k, context,
  md5('{seed}:' || k) AS h FROM {name}0), {name} AS (SELECT k,
  coalesce(lead(context, 1) OVER w, first_value(context) OVER w) AS p1,
  coalesce(lead(context, 2) OVER w, CASE WHEN lead(k, 1) OVER w IS NULL THEN nth_value(context, 2) OVER v ELSE
    first_value(context) OVER v END) AS p2 FROM {name}1
  WINDOW w AS (ORDER BY h, k), v AS (ORDER BY h, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("negative_pairs", f"""
WITH {B.QA}, {s_partners('negative', 'np')} SELECT id, md5(question) AS question_md5, md5(p1) AS wrong_md5
FROM qa JOIN np ON np.k = md5(context)""")
def negative_pairs(t):
    return X.negative_pairs(B.qa(t)).select("id", F.md5("question").alias("question_md5"), F.md5("wrong_context").alias("wrong_md5"))


def s_distract(rows):
    place = lambda i: f"md5('distractor-place:' || id || ':{i}')"
    return f"""{s_partners('distractor', 'dp')}, parts AS (SELECT r.*, [{{'h': {place(0)}, 't': '[1] document.txt: ' ||
  substring(context, 1, 500)}}, {{'h': {place(1)}, 't': '[2] other_file.txt: ' || substring(p1, 1, 200)}}] || CASE WHEN
  {s_choice('distractor-count', 2)} = 1 THEN [{{'h': {place(2)}, 't': '[3] other_file.txt: ' || substring(p2, 1, 200)}}] ELSE [] END
  AS ps, {s_choice('distractor-order', 2)} = 1 AS mixed FROM {rows} r JOIN dp ON dp.k = md5(context)),
chunked AS (SELECT *, array_to_string(list_transform(CASE WHEN mixed THEN list_sort(ps) ELSE ps END, lambda p: p.t), chr(10))
  AS chunks FROM parts)"""


@query("attach_distractors", f"WITH {B.QA}, {s_distract('qa')} SELECT id, md5(chunks) AS chunks_md5 FROM chunked")
def attach_distractors(t):
    return X.attach_distractors(B.qa(t)).select("id", F.md5("chunks").alias("chunks_md5"))


@query("curriculum", f"""
WITH {B.QA}, {_DIFF}, size AS (SELECT count(*) // 10 AS n FROM qa), quota AS (SELECT floor(n * {fv.NEGATIVE_SHARE}::DOUBLE)::BIGINT AS negative,
  floor(n * {fv.DIFFICULTY_SHARES['easy']}::DOUBLE)::BIGINT AS easy, floor(n * {fv.DIFFICULTY_SHARES['medium']}::DOUBLE)::BIGINT AS medium,
  floor(n * {fv.DIFFICULTY_SHARES['hard']}::DOUBLE)::BIGINT - floor(n * {fv.NEGATIVE_SHARE}::DOUBLE)::BIGINT AS hard FROM size),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY md5('42:' || id), id)
  AS r FROM diff), quota WHERE r <= CASE difficulty WHEN 'easy' THEN easy WHEN 'medium' THEN medium ELSE hard END),
hardr AS (SELECT * FROM taken WHERE difficulty = 'hard'), {s_distract('hardr')}, {s_partners('negative', 'np')},
neg AS (SELECT qa.*, np.p1, np.p2 FROM (SELECT *, row_number() OVER (ORDER BY md5('42-negative:' || id), id) AS r FROM qa) qa
  JOIN np ON np.k = md5(context) WHERE r <= (SELECT negative FROM quota)),
o AS (SELECT id, 'positive' AS kind, difficulty, CASE difficulty WHEN 'easy' THEN substring(context, 1, 300)
    ELSE '[1] document.txt: ' || substring(context, 1, 500) END AS c, question, answer AS output FROM taken WHERE difficulty <> 'hard'
  UNION ALL SELECT id, 'positive', 'hard', chunks, question, coalesce(answer, {sql_text(fv.REFUSAL)}) FROM chunked
  UNION ALL SELECT id, 'negative', 'hard', '[1] unrelated.txt: ' || substring(p1, 1, 400) || CASE WHEN
    {s_choice('negative-more', 2)} = 1 THEN chr(10) || '[2] another.txt: ' || substring(p2, 1, 200) ELSE '' END, question,
    {sql_text(fv.REFUSAL)} FROM neg)
SELECT id, kind, difficulty, md5('Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || question) AS input_md5,
  md5(output) AS output_md5 FROM o""")
def curriculum(t):
    """A tenth of all rows, in the shares of the recipe."""
    return X.curriculum(B.qa(t), B.qa(t).count() // 10).select(
        "id", "kind", "difficulty", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")
    )


def _mixed(t):
    """Extractive examples and refusals under one id."""
    return X.extractive_layer(B.qa(t)).unionByName(
        G.refusal_examples(seeds(t)).withColumn("id", -F.col("id") - 1)
    )


_MIXED = f"""{B.QA}, {_L1}, {_refusal_sql()}, mixed AS (SELECT id, input, output FROM l1
  UNION ALL SELECT -id - 1, input, output FROM l5)"""


@query("polarity_split", f"""
WITH {_MIXED} SELECT CASE WHEN contains(lower(output), 'not found') THEN 'negative' ELSE 'positive' END AS polarity, count(*) AS n
FROM mixed GROUP BY 1""")
def polarity_split(t):
    return X.with_polarity(_mixed(t)).groupBy("polarity").agg(F.count("*").alias("n"))


@query("budget_sample", f"""
WITH {_MIXED}, p AS (SELECT id, CASE WHEN contains(lower(output), 'not found') THEN 'negative' ELSE 'positive' END AS polarity
  FROM mixed), r AS (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY md5('42:' || id), id) AS r FROM p)
SELECT id, polarity FROM r, (SELECT count(*) // 2 AS n FROM mixed)
WHERE r <= CASE polarity WHEN 'positive' THEN floor(n * {fv.POSITIVE_SHARE}::DOUBLE) ELSE floor(n * {fv.REFUSAL_SHARE}::DOUBLE) END""")
def budget_sample(t):
    """Half of all examples, in the shares of the recipe."""
    return X.budget_sample(_mixed(t), _mixed(t).count() // 2).select("id", "polarity")


@query("rewrite_answers", f"""
WITH {B.QA}, {_L1}, w AS (SELECT id, output, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'no' ELSE 'It is ' || output END AS n
  FROM l1) SELECT id, md5(CASE WHEN n IS NULL OR length(n) < 5 THEN output ELSE n END) AS output_md5,
  n IS NULL OR length(n) < 5 AS fell_back FROM w""")
def rewrite_answers(t):
    kind = F.pmod("id", F.lit(5))

    def rewriter(_, answer):
        return F.when(kind == 0, None).when(kind == 1, "no").otherwise(F.concat(F.lit("It is "), answer))

    return X.rewrite(X.extractive_layer(B.qa(t)), rewriter).select("id", F.md5("output").alias("output_md5"), "fell_back")


@query("rewrite_batches", f"""
WITH {B.QA}, {_L1}, w AS (SELECT id, output, length(output) % 7 = 0 AS failed, CASE WHEN length(output) % 7 > 1 THEN 'It is ' || output END AS n FROM l1),
r AS (SELECT *, n IS NULL OR length(n) < 5 AS fell_back FROM w)
SELECT id, md5(CASE WHEN fell_back THEN output ELSE n END) AS output_md5, fell_back, failed,
  count(*) OVER () AS n_rows, count(*) FILTER (fell_back) OVER () AS n_fell_back, count(*) FILTER (failed) OVER () AS n_failed FROM r""")
def rewrite_batches(t):
    """A plug-in that fails on the batches that hold an answer of a bad length; counts observed while the result is written."""
    def open_rewriter():
        def rewriter(rows):
            if any(len(answer) % 7 == 0 for _, answer in rows):
                raise ValueError("a bad answer")
            return [None if len(answer) % 7 == 1 else "It is " + answer for _, answer in rows]

        return rewriter

    seen = Observation()
    out = materialize(X.rewrite_batches(X.extractive_layer(B.qa(t)), open_rewriter, seen, attempts=1), "rewritten")
    counts = {f"n_{k}": F.lit(seen.get[k]).cast("bigint") for k in ("rows", "fell_back", "failed")}
    return out.select("id", F.md5("output").alias("output_md5"), "fell_back", "failed").withColumns(counts)


@query("is_refusal", "SELECT conv_id, turn, contains(lower(text), 'not found') AS refused FROM conversations")
def is_refusal(t):
    return t.conversations.select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refused"))


@query("preview_examples", f"""
WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY layer, source ORDER BY id, md5(input)) AS r FROM every)
SELECT layer, source, id, r::INTEGER AS rank FROM r WHERE r <= 3""")
def preview_examples(t):
    return X.preview(all_layers(t), ["layer", "source"], 3).select("layer", "source", "id", "rank")


_POLARITY = "CASE WHEN contains(lower(output), 'not found') THEN 'polarity=negative' ELSE 'polarity=positive' END"


@query("phase_plan", f"""
WITH {_ALL}, c AS (SELECT 'layer=' || layer AS part, count(*) AS n FROM every GROUP BY 1
  UNION ALL SELECT {_POLARITY}, count(*) FROM every GROUP BY 1),
p AS (SELECT unnest([1, 2, 3, 4]) AS phase, unnest({sql_list([p[2] for p in fv.PHASES])}) AS part)
SELECT phase::INTEGER AS phase, part, coalesce(n, 0) AS n, n IS NULL AS missing FROM p LEFT JOIN c USING (part)""")
def phase_plan(t):
    """Counts of the written layers and of the two outputs by polarity."""
    folder = new_folder(t.spark, "dataset")
    with written_layers(t) as examples:
        D.build(examples, folder)
        polarities = D.write_polarities(examples, new_folder(t.spark, "polarities"))
    written = ST.read_examples(t.spark, folder)
    layers = written.groupBy(F.concat(F.lit("layer="), F.col("layer").cast("string")).alias("part")).agg(F.count("*").alias("n"))
    phases = t.spark.createDataFrame(fv.PHASES, "phase int, name string, part string, description string")
    return X.phase_plan(layers.unionByName(polarities.select("part", "n")), phases).select("phase", "part", "n", "missing")


@query("polarity_outputs", f"""
WITH {_ALL} SELECT {_POLARITY} AS part, layer, count(*) AS n, sum(strlen(input) + strlen(output))::BIGINT AS bytes FROM every GROUP BY 1, 2""")
def polarity_outputs(t):
    """All examples written as two outputs by polarity and read back; the counts observed while writing agree."""
    folder = new_folder(t.spark, "polarities")
    counts = D.write_polarities(all_layers(t), folder)
    back = t.spark.read.schema("input string, output string, source string, layer int, polarity string").json(folder)
    part = F.concat(F.lit("polarity="), "polarity").alias("part")
    found = back.groupBy(part, "layer").agg(F.count("*").alias("n"), F.sum(F.octet_length("input") + F.octet_length("output")).alias("bytes"))
    return found.join(counts.select("part"), "part", "left_semi")


@query("squad_flatten", """
SELECT conv_id || '-' || turn AS id, md5('story ' || conv_id) AS context_md5, text AS question, role AS answer,
  role = 'system' AS is_impossible FROM conversations""")
def squad_flatten(t):
    """Conversations nested to articles, written as files of one JSON value over many lines, read and flattened."""
    item = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("question"), F.array(F.struct(F.col("role").alias("text"))).alias("answers"),
        (F.col("role") == "system").alias("is_impossible"),
    )
    paragraphs = t.conversations.groupBy("conv_id").agg(F.collect_list(item).alias("qas")).select(
        F.array(F.struct(
            F.lit("t").alias("title"),
            F.array(F.struct(F.concat(F.lit("story "), F.col("conv_id").cast("string")).alias("context"), "qas")).alias("paragraphs"),
        )).alias("data"), F.pmod("conv_id", F.lit(16)).alias("file")
    )
    folder = new_folder(t.spark, "nested")
    articles = paragraphs.groupBy("file").agg(F.flatten(F.collect_list("data")).alias("data")).drop("file")
    articles.write.option("maxRecordsPerFile", 1).option("pretty", "true").json(folder)
    nested = ST.read_nested_qa(t.spark, folder)
    return X.flatten_squad(nested).select(
        "id", F.md5("context").alias("context_md5"), "question", F.get("answers", F.lit(0)).alias("answer"), "is_impossible"
    )


@query("json_lines", """
SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, 0::BIGINT AS n_corrupt FROM documents GROUP BY 1""")
def json_lines(t):
    folder = new_folder(t.spark, "lines")
    rows = t.documents.select(
        F.col("text").alias("input"), F.col("lang").alias("output"), "source", F.pmod("doc_id", F.lit(3)).cast("int").alias("layer")
    )
    ST.write_examples(rows, folder)
    back = ST.read_examples(t.spark, folder)
    return back.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("input")).alias("bytes"), F.count("_corrupt_record").alias("n_corrupt")
    )


_CASES = """cases AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'refusal' WHEN doc_id % 2 = 0 THEN 'extraction' ELSE 'reasoning'
  END AS type, CASE WHEN quality = 0 THEN 'Not found in provided context.' ELSE lang END AS expected FROM labels JOIN documents USING (doc_id)),
preds AS (SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN 'It was NOT FOUND anywhere' ELSE 'The language is ' || upper(lang) END
  AS prediction FROM documents), scored AS (SELECT id, type, CASE WHEN type = 'refusal' THEN contains(lower(prediction), 'not found')
  ELSE contains(lower(prediction), lower(expected)) END AS success FROM cases JOIN preds USING (id))"""


def cases(t):
    rows = t.labels.join(t.documents, "doc_id")
    bad = F.col("quality") == 0
    return rows.select(
        F.col("doc_id").alias("id"),
        F.when(bad, "refusal").when(F.col("doc_id") % 2 == 0, "extraction").otherwise("reasoning").alias("type"),
        F.when(bad, fv.REFUSAL).otherwise(F.col("lang")).alias("expected"),
    )


def predictions(t):
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("n_chars") % 3 == 0, "It was NOT FOUND anywhere")
        .otherwise(F.concat(F.lit("The language is "), F.upper("lang"))).alias("prediction"),
    )


@query("score_predictions", f"WITH {_CASES} SELECT id, type, success FROM scored")
def score_predictions(t):
    return X.score_predictions(cases(t), predictions(t)).select("id", "type", "success")


@query("accuracy_by_category", f"""
WITH {_CASES} SELECT type, count(*) FILTER (success) AS correct, count(*) AS total, round(avg(success::INT), 6) AS accuracy
FROM scored GROUP BY 1""")
def accuracy_by_category(t):
    out = X.accuracy(X.score_predictions(cases(t), predictions(t)))
    return out.withColumn("accuracy", F.round("accuracy", 6))
