"""Every registered query over the whole of the smallest scale: the columns of its contract and a row for every input row."""

import duckdb
import pytest

from quarry.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ("embeddings", "vec_id", "vec_id n_links component_id kept"),
    "op2": ("documents", "doc_id", "doc_id n_lines n_dropped kept_sha256"),
    "op3": ("pages", "page_id", "page_id payload_bytes payload_digest record_type refers_to"),
    "op4": ("documents", "doc_id", "doc_id n_words n_hit n_items items_sha256 contaminated"),
    "op5": ("documents", "doc_id", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    "op6": ("documents", "doc_id", "doc_id start n_tokens ids_crc32"),
    "op7": ("documents", "doc_id", "doc_id held_out score predicted"),
    "op8": ("documents", "doc_id", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op9": ("documents", "doc_id", "doc_id held_out lang_pred score"),
    "op10": ("documents", "doc_id", "doc_id n_shingles component_id"),
    "op11": ("pages", "page_id", "page_id host path rule verdict"),
    "op12": ("documents", "doc_id", "doc_id leaf subroot root proof_sha256 folded_root verified"),
    "op13": ("documents", "doc_id", "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256"),
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_a_row_for_every_input_row(spark, name):
    table, key, columns = COLUMNS[name.split("_")[0]]
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(columns.split()) <= set(df.columns)
    got = df.collect()
    ids = duckdb.sql(f"SELECT {key} FROM '{FOLDER}/{table}.parquet'").fetchall()
    assert sorted(r[key] for r in got) == sorted(i for i, in ids)
    if name.startswith("op5"):
        assert all(r.score > r.base_score or r.n_tokens < 3 for r in got if not r.held_out)
    if name.startswith("op12"):
        assert len({r.root for r in got}) == 1 and 0 < sum(r.verified for r in got) < len(got)


def test_items_of_leaks_are_those_found_word_by_word(spark):
    """The digest of the leaked items against a plain search of every window in every document."""
    import hashlib
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    windows = {}
    for item, text in duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall():
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    expected = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    items |= found
                    hit |= set(range(i, i + n))
        expected[doc] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.QUERIES["op4_decontaminate"](spark, FOLDER).collect()}
    assert got == expected and any(v[-1] for v in got.values())
