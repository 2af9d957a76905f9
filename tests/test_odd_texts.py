"""Queries on odd texts against their SQL: accented letters beside a word, line ends, blanks, folded letters."""

import duckdb
import pytest

from palimpsest import plans

TEXTS = [
    "sèle quié", "é le, qui", "the that", "le\nqui dans", "LE à éQUI", "la qui withé", "le qui danſ", "le qui éWith", "the_that le-that", "", None,
    "éund x", "not éund x", "xundé", "und", "not one two three und", "don’t und", "not a b und x undß", "und 한und글",
    "a?\n", "a? \t", "a? ", "a? ", " who", "\x0bwhat is", " \f\nwhy é", "noté", "éno", "nowé “x”", "İs it İ", "K now", "whoé", "last́", "한글 next?",
]


@pytest.mark.parametrize("name", ["flt_identity_suppressed", "fn_unnegated", "qry_analysis"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rows = [(k, k % 3, "user", x) for k, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
    assert got.count()
