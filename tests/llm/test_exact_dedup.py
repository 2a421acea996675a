import hashlib
import re

from ledgerline.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, digest string, run int, id long, n long"


def plain(rows):
    """keep_id and size of each normalised text, by hand."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    return {t: (min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0], len(g)) for t, g in groups.items()}


def rows_of():
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(
        ["a b", "ab", "a  b", None, "", " \t\r\n\x0b\x0c", "é\u00a0x", "éx", "z" * 300_000, "z" * 299_999 + " z", "ab", "AB"] * 3)]
    return rows + [(1, "ab", "x", 1, 2, 3), (None, "a b", "x", 1, 2, 3), (None, "only null id", "y", 1, 2, 3)]


def test_duplicates_against_plain_version(spark):
    rows = rows_of()
    want = plain(rows)
    for partitions, bits in ((1, 4), (7, 1), (9, 2)):
        got = X.duplicates(spark.createDataFrame(rows, SCHEMA).repartition(partitions), bits=bits).collect()
        assert len(got) == len(rows)
        by_text = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        assert {(r.text_sha256, r.keep_id, r.group_size) for r in got} == {(k, *v) for k, v in by_text.items()}
        assert sum(r.kept for r in got) == len(want)


def test_dropping_keeps_columns_and_one_row_of_repeats(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = X.drop_duplicates(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((k is None, k or 0) for k, _ in plain(rows).values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.duplicates(df).count() == 0 and X.drop_duplicates(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    plan = X.duplicates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
