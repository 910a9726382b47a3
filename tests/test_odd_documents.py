"""Queries of documents against their SQL, over texts that the driver's small tables lack."""

import duckdb
import pytest

from probity.plans import registry

TEXTS = [
    None, "", " ", "\n\t", ".", "a", "One. Two. Three.", " One. Two.  ", "One.\u3000Two.\u2003Three.\u00a0", "\u3000One. Two. Three\u3000", "\u0085One. Two.", "One. Two. \u2028 Three", "One\x00. Two\x00. Three.",
    "\u00a0. Two.\u00a0", "\x1cOne. Two. \x1f", "One. One. One.", "Therefore, so. However it was; for example this.", "\U0001f600. \U0001f600\U0001f600. b", "\x0bOne. Two. \x0b", "One. Two. \u2028", "One. Two. Three \x85", *("ab. " + "c" * k + ". " + "d" * (155 - k) + "." for k in range(0, 150, 7)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def assert_agrees_with_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    theirs = con.sql(registry.ORACLE_SQL[name])
    assert sorted(map(tuple, registry.QUERIES[name](spark, folder).select(*theirs.columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_evidence_is_removed_from_odd_texts_as_sql_does(spark, folder):
    assert_agrees_with_sql(spark, folder, "degradation_remove_evidence")


def test_claims_are_put_into_odd_texts_as_sql_does(spark, folder):
    assert_agrees_with_sql(spark, folder, "degradation_unsupported_assertion")


def test_odd_texts_get_every_variant_as_sql_has_them(spark, folder):
    assert_agrees_with_sql(spark, folder, "generate_all")
