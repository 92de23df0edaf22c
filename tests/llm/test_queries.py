"""The registered queries: agreement with SQL, stable results, and what is learned."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from promptloom.llm import queries
from tests.compare import oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    expected_names, expected = oracle_rows(SF_DIR, queries.ORACLES[name])
    assert names == expected_names
    assert rows == expected


def test_all_operators_and_the_pipeline_are_registered():
    numbers = Counter(int(m[1]) for name in contract.queries() if (m := re.match(r"op(\d+)_", name)))
    assert numbers == Counter(range(1, 14))
    assert "pipeline" in contract.queries()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op3_language_id"](spark, SF_DIR).join(docs, "doc_id").where("held_out")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 30 and right / total > 0.95


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = queries.QUERIES["op10_toxicity"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in found if r["toxic"]]
    clean = [r["score"] for r in found if not r["toxic"]]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.8
    assert sum(r["predicted"] == r["toxic"] for r in found) / len(found) > 0.9
