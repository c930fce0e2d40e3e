import uuid

from pyspark.sql import functions as F

from corvid.catalog import Catalog
from corvid.operators import browse
from corvid.operators.pages import RangePages
from corvid.session import shared_folder
from corvid.sources.registry import Tables


def test_pages_are_those_of_the_whole_order_and_read_their_ranges(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("int")
    spark.range(6000).select(key.alias("k"), "id").repartitionByRange(6, "k").write.parquet(at := f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}")
    rows = spark.read.parquet(at)
    own = RangePages(rows, ["k", "id"], range_rows=300)
    want = [tuple(r) for r in rows.orderBy("k", "id").collect()]
    assert len(own) == 6000 and len(own.ranges) > 8 and own.ranges[0][:2] == (None, None)
    for begin, end in ((0, 5), (70, 100), (-3, 2), (118, 125), (2500, 2600), (5990, 7000), (6000, 6010), (50, 40), (0, 6000)):
        assert [tuple(r) for r in own.page(begin, end).collect()] == want[max(begin, 0) : max(end, 0)], (begin, end)
    assert len(own.holding(2500, 2600)) <= 2
    plan = own.page(4000, 4010)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan and "LessThanOrEqual(k," in plan
    assert len(RangePages(rows.limit(0), ["k"])) == 0 and RangePages(rows.limit(0), ["k"]).page(0, 5).collect() == []


def test_engine_pages_through_a_source(spark):
    rows = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "id int, name string")
    source = Tables("postgres://db", {"people": lambda s: rows}, {"people": ["id"]}, max_read_rows=40)
    own = Catalog(spark, f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}", buckets=2)
    own.sync("postgres://db", source)
    engine = own.engine(["postgres://db"], {"postgres://db": source})
    uri = "postgres://db/people/rows.jsonl"
    assert [r.content for r in engine.cat(uri, lines="4:6").collect()] == ['{"id":3,"name":"name 3"}', '{"id":4,"name":"name 4"}']
    assert engine.cat(uri, lines="39:60").count() == 2 and engine.cat(uri, locator='{"id":7}').first().content == '{"id":7,"name":"name 7"}'
    assert browse.page(rows, ["id"], 3, 5).count() == 2
