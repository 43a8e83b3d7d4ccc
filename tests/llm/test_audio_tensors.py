import glob
import json

import numpy as np
import pyarrow.parquet as pq

from millrace.llm import audio
from millrace.session import shared_dir

TEXTS = ["", None, "a", "word " * 3_000, "é\n" * 999, "loud \x00quiet " * 40_000, "x" * 64]


def test_features_come_from_stored_tensors(spark):
    rows = [(k % 5, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    got = audio.digests(audio.store(spark.createDataFrame(rows, "doc_id long, text string")), "written").collect()
    want = [(k, audio.describe(audio.analyse(audio.payload(t)))) for k, t in rows]
    assert sorted((r["doc_id"], r["feature"]) for r in got) == sorted(want)
    files = glob.glob(shared_dir(spark).removeprefix("file://") + "/written-*/*.parquet")
    clips = [c for f in files for c in pq.read_table(f).to_pylist()]
    assert len(clips) == len(rows)
    for c in clips:
        own = np.concatenate([b["log_mel"] for b in c["blocks"]])
        f = next(f for f in (audio.analyse(audio.payload(t)) for k, t in rows if k == c["doc_id"]) if f.tensors.size == own.size and np.allclose(f.tensors.ravel(), own, atol=1e-4))
        assert np.array_equal(f.blocks, [[b["start_s"], b["end_s"]] for b in c["blocks"]]) and np.array_equal(f.spans.ravel(), c["spans"])
    fields = json.loads(pq.read_schema(files[0]).metadata[b"org.apache.spark.sql.parquet.row.metadata"])["fields"]
    inner = next(x for x in fields if x["name"] == "blocks")["type"]["elementType"]["fields"]
    assert next(x for x in inner if x["name"] == "log_mel")["metadata"]["shape"] == [audio.BLOCK, audio.MELS]


def test_slices_and_shape(spark, monkeypatch):
    assert audio._runs(np.array([], np.int64)) == []
    ranges = audio._runs(np.array([1, 3_999_999, 5, 9_000_000, 1, 1]))
    assert [k for a, b in ranges for k in range(a, b)] == list(range(6)) and len(ranges) > 1
    blocks = audio.tensors(audio.store(spark.createDataFrame([(1, "word " * 3_000)], "doc_id long, text string")))
    assert blocks.schema["log_mel"].metadata["shape"] == [audio.BLOCK, audio.MELS] and blocks.count() > 1
