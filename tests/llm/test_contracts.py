"""The registered queries themselves on a small folder: columns, types and one row a document."""

import pytest

from sparkrag.llm.queries import QUERIES

COLUMNS = {
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_query(spark, tmp_path, name):
    rows = [(1, "one two three four five six seven " * 40), (2, None), (3, ""), (4, "one two three four five six seven " * 40)]
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    done = QUERIES[name](spark, str(tmp_path))
    types = dict(done.dtypes)
    assert {c: types.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    assert {r["doc_id"] for r in done.select("doc_id").collect()} == {1, 2, 3, 4}
