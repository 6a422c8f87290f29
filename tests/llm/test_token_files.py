import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from habitnet.llm import token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, odd, none, tmp_path):
    t = Tokenizer.from_file(PATH)
    want = sorted(
        ((-1 if r["doc_id"] is None else r["doc_id"]), t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in odd.collect()
    )
    out = str(tmp_path / "tokens")
    token_files.write(odd, out, PATH, 2)
    got = sorted(token_files.digests(spark, out).collect(), key=lambda r: r["start"])
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got] == [d for d, _ in want]  # ascending ids, nulls first
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, len(i), crc(i)) for d, i in want)
    empty = str(tmp_path / "empty")
    token_files.write(none, empty, PATH, 2)
    assert token_files.digests(spark, empty).count() == 0


def test_layout(spark, docs, tmp_path):
    out = str(tmp_path / "tokens")
    token_files.write(docs([(i, f"some words {i} " * 50, "", "", 0, 0, "") for i in range(900)]).coalesce(1), out, PATH, 2)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{out}/*.parquet")]
    columns = {f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i) for f in files for i in range(f.metadata.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings or "DELTA_BINARY_PACKED" in columns["first_in_file"].encodings
    assert all(c.has_offset_index for c in columns.values())
