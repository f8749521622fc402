"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from compare import difference

import __spark_entry__ as entry
from tidemark.operators.text import TRAITS
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.SQL:
        assert difference(df, catalogue.SQL[name], duck) == ""
    else:
        VALUES[name](df.toPandas())


def traits_of_texts(rows):
    assert set(rows["trait"]) <= set(TRAITS) and not rows.duplicated(["doc_id", "trait"]).any() and (rows["evidence"].str.len() > 3).all()


def coverage_of_traits(rows):
    assert set(rows["trait"]) <= {*TRAITS, "none"} and rows["texts"].min() > 0 and rows["trait"].is_unique


def models(rows):
    assert list(rows["model"]) == ["ridge", "boosted"] and rows["rows"].nunique() == 1 and rows["rows"].iat[0] > 0
    assert rows["mape"].between(0.01, 200).all() and (rows["rmse"] > 0).all() and (rows["r2"] < 1).all()


def bands(rows):
    assert rows["suburb_id"].is_unique and len(rows) and set(rows["confidence"]) <= {"high", "medium", "low"}
    assert (rows.loc[rows["confidence"] == "high", "residual_pct"].abs() < 10).all() and (rows.loc[rows["confidence"] == "medium", "residual_pct"].abs().between(10, 25)).all()


#: What queries without SQL are held to.
VALUES = {"text_traits": traits_of_texts, "trait_coverage": coverage_of_traits, "agreement_model": models, "agreement_bands": bands}


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
