import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casegrain.llm import entities


def fake(links):
    def step(c, whole, phases):
        return links(c.select("cluster")).where("to IS NOT NULL AND to != cluster")

    return step


@pytest.mark.parametrize(
    "names,links",
    [
        (9, lambda c: c.withColumn("to", F.lag("cluster").over(Window.orderBy("cluster")))),
        (3, lambda c: c.withColumn("to", F.coalesce(F.lead("cluster").over(Window.orderBy("cluster")), F.min("cluster").over(Window.partitionBy())))),
    ],
    ids=["chain longer than 18 rounds", "ring"],
)
def test_rounds_go_on_until_nothing_merges(spark, monkeypatch, names, links):
    monkeypatch.setattr(entities, "_links", fake(links))
    df = spark.createDataFrame([("judge", f"{w} Rao") for w in "Anil Bimal Chetan Dinesh Eshan Farid Gopal Hari Ishan".split()[:names]], "kind string, name string")
    assert entities.resolve(df).select("cluster").distinct().count() == 1
