"""The queries that SQL can express against another engine."""

import pytest

from geoaccord.llm import queries
from geoaccord.llm.oracles import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), ORACLE_SQL[name])


def test_quality_against_labels(spark, sf):
    """The verdicts on a thousand documents against the labels of some: good ones stay, bad ones go."""
    folder = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    kept = queries.op1_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["share"] for r in kept.selectExpr("quality", "int(kept) as k").groupBy("quality").agg({"k": "avg"}).toDF("quality", "share").collect()}
    assert share[1] >= 0.9 and share[0] <= 0.05
