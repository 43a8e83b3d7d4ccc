"""The latest version among lines of the same number; repeated postings."""

import pyarrow as pa
import pyarrow.parquet as pq

from millrace.plans import decisions, more


def test_first_line_of_the_table_counts_among_equal_numbers(spark, tmp_path):
    n, folder = 20_000, tmp_path / "lineitem.parquet"
    folder.mkdir()
    for part, some in ((0, range(500)), (1, range(500, n))):  # the larger file is read first
        rows = pa.table({"l_orderkey": [k % 500 for k in some], "l_linenumber": [3 if part == 0 else k // 500 % 4 for k in some], "l_partkey": [k * 7919 % n for k in some]})
        pq.write_table(rows, folder / f"part-{part}.parquet", row_group_size=1_000)
    found = {r["l_orderkey"]: (r["l_linenumber"], r["l_partkey"], r["versions"]) for r in more.win01_latest_version(spark, str(tmp_path)).collect()}
    assert found == {k: (3, k * 7919 % n, 40) for k in range(500)}


def test_every_posting_is_judged_by_its_company_and_place_too(spark, tmp_path):
    text = ["Cook\nat sea", "Cook\nat sea", "Cook\nin town", "Judge", None]
    ids = [1, 37, 2, 3, 4]  # 1 and 37 have the same company and place, 2 another
    docs = pa.table({"doc_id": ids, "text": text, "lang": ["en"] * 5, "source": [f"web{k}" for k in ids], "n_chars": [0] * 5})
    pq.write_table(docs, tmp_path / "documents.parquet")
    rows = {r["id"]: (r["duplicate_of"], r["copy_of"]) for r in decisions.ded02_duplicates(spark, str(tmp_path)).collect()}
    assert rows == {1: (None, None), 37: ("web1", "web1"), 2: (None, "web1"), 3: (None, None), 4: (None, None)}
