import random

import numpy as np
import psutil
import pyarrow as pa
from pyspark.sql import types as T

from quarry.llm import common, spans


def _megabytes():
    return psutil.Process().memory_info().rss / 1e6


class _Frame:
    """A table that gives what it is asked to run, to be run by the test itself."""

    schema = T.StructType([T.StructField("text", T.StringType())])
    columns = ["text"]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def _work(part):
    return [pa.array([1] * part.num_rows, pa.int64())]


def test_released_memory_goes_back_to_the_system():
    common.release()
    before = _megabytes()
    common.held("blocks", lambda: [np.ones(8000) for _ in range(4000)])  # 256 MB in blocks too small to be mapped
    pins = [np.ones(100) for _ in range(4000)]
    common._HELD["blocks"] += [np.ones(8000) for _ in range(10)]
    last = np.ones(8000)
    assert _megabytes() > before + 200
    common.release()
    assert _megabytes() < before + 60 and len(pins) == 4000 and len(last) == 8000


def test_operators_release_what_others_held(spark):
    fields = [T.StructField("n", T.LongType())]
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c"])], ["text"])
    for holds in (True, False):
        common.held("another operator", lambda: "its memory")
        out = list(common.append(_Frame(), "text", fields, _work, holds=holds)(iter([batch])))
        assert sum(b.num_rows for b in out) == 2 and bool(common._HELD) == holds
    common.release()


def test_hashes_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(8)
    raw = " ".join("".join(rng.choice("abcXYZé") for _ in range(rng.choice([1, 3, 9, 400]))) for _ in range(3000)).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = spans.words(data, np.array([0, len(raw)]), spans.NOT_BLANK)
    expected = spans.hashes(data, s, e)
    for piece in (64, 5000, 1 << 20):
        monkeypatch.setattr(spans, "_PIECE", piece)
        assert (spans.hashes(data, s, e) == expected).all()
