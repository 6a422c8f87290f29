import corpus_pipeline
import public_tokenizers
import pytest
from tests.llm.conftest import PROSE
from tests.llm.test_line_dedup import plain
from tokenizers import Tokenizer

BENCH = "A benchmark question asks which of the four rivers named below is the longest one in the whole of the country."


@pytest.fixture
def tables(spark, tmp_path):
    unlike = lambda i: "\n".join(f"{w}{i} " * 0 + " ".join(f"{w}{i}x{k}" for k in range(12)) + "." for w in ("north", "south"))
    rows = [(i, unlike(i), "en", "s", 0) for i in range(12)]
    rows += [(20, rows[3][1] + "\n" + PROSE, "en", "s", 0), (21, rows[3][1], "en", "s", 0)]  # lines repeat those of 3
    rows += [(30, PROSE.replace("mill", "barn") + " " + BENCH, "en", "s", 0), (31, "too short", "en", "s", 0), (32, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values() if name != "simhash_near_dedup")
    assert set(kept["quality_rules"]) == {*range(12), 20, 21, 30}
    gone = plain([(i, r["text"]) for i, r in sorted(kept["quality_rules"].items())])
    assert gone[21] == [0, 1] and 21 not in kept["line_dedup"] and kept["line_dedup"][20]["text"] == PROSE
    assert set(kept["benchmark_decontamination"]) == {*range(12), 20}


def test_run(spark, tables):
    pieces = corpus_pipeline.run(spark, tables[0]).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert tokens[20] == len(t.encode(PROSE).ids) + 1 and sum(r["length"] for r in pieces) == sum(tokens.values())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def through(spark, docs, sf_dir):
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, sf_dir)
        assert name == "packing" or docs.columns == before
        kept.append([tuple(r) for r in docs.collect()])
    return kept


def test_odd_rows_and_empty_table(spark, tables, odd, none):
    """Nulls, empty texts, repeated rows, a long text, extra columns of clashing names; then no rows at all."""
    sf_dir, _ = tables
    quality, lines, near, clean, pieces = through(spark, odd, sf_dir)
    ids = lambda rows: sorted((-1 if r[0] is None else r[0]) for r in rows)
    assert ids(quality) == [-1, 4, 4, 4, 5]  # without words, or with too few: rejected
    assert ids(lines) == [-1, 4, 5]  # the copies of the first text lose every line; one has a line of its own
    assert ids(near) == ids(clean) == [-1, 4, 5] and {r[0] for r in pieces} == {None, 4, 5}
    assert next(r for r in clean if r[0] is None)[2:4] == (None, None)  # other columns keep their values
    assert all(rows == [] for rows in through(spark, none, sf_dir))
