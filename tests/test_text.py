from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from tests.conftest import rows


def windows(text, size, overlap):
    """Restatement: start at 0, step on, stop when only overlap is left; blank windows do not count."""
    starts = [0]
    while len(text) > size and starts[-1] + size - overlap < len(text) - overlap:
        starts.append(starts[-1] + size - overlap)
    pieces = [text[s : s + size].strip() for s in starts]
    return [p for p in pieces if p]


def chunks(spark, texts, size=1000, overlap=200):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(rows(df.select("i", T.chunk_array(F.col("t"), size, overlap))))
    return [got[i] for i in range(len(texts))]


def test_boundary_lengths(spark):
    lengths = [0, 1, 199, 200, 201, 999, 1000, 1001, 1199, 1200, 1800, 1801, 2000]
    got = chunks(spark, ["x" * n for n in lengths])
    assert [len(g) for g in got] == [0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3]


def test_blank_windows_close_up(spark):
    text = "a" * 800 + " " * 1400 + "b" * 900
    assert chunks(spark, [" \n\t ", text]) == [[], windows(text, 1000, 200)]


def test_text_longer_than_several_blocks(spark):
    text = "".join(chr(97 + i % 26) if i % 11 else " é" for i in range(150_000))
    assert chunks(spark, [text])[0] == windows(text, 1000, 200)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n é😀", max_size=400), min_size=1, max_size=20), st.integers(2, 60), st.data())
def test_any_text(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    assert chunks(spark, texts, size, overlap) == [windows(t, size, overlap) for t in texts]


def test_strip_takes_unicode_blanks(spark):
    df = spark.createDataFrame([(" 　 a b\x1c\n",)], "t string")
    assert rows(df.select(T.strip(F.col("t")))) == [("a b",)]


def test_bad_bytes_are_replaced(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff\xfe end\nsecond"),)], "c binary")
    text = T.decode_utf8(F.col("c"))
    got, first = rows(df.select(text, T.first_line(text)))[0]
    assert got == "ok �� end\nsecond" and first == "ok �� end"


def test_memory_tags(spark):
    texts = ["none", "<memory> one </memory> x <memory>two\nlines</memory>", "<memory>  </memory>", "<memory>open"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select(T.memory_tags(F.col("t")), T.strip_memory_tags(F.col("t"))))
    assert got == [([], "none"), (["one", "two\nlines"], "x"), ([], ""), ([], "<memory>open")]


def test_title_prompt_and_preview(spark):
    df = spark.createDataFrame([("x" * 151, " ", ".txt"), ("short", "ctx", ".exe")], "p string, c string, e string")
    got = rows(df.select(
        T.chat_title(F.col("p")), T.answer_prompt(F.col("c"), F.lit("q?")), T.read_preview(F.repeat("p", F.lit(40)), F.col("e"))
    ))
    assert got[0][0] == "x" * 150 + "..." and got[0][1] == "q?" and got[0][2].truncated and len(got[0][2].text) == 4000
    assert got[1][:2] == ("short", "Context: ctx\n\nQuestion: q?") and got[1][2] is None
