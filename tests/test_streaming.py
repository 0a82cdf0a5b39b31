import random

from pathweave.streaming import ReachableStream

from test_relation import closed_by_search


def test_closure_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    batches = [{(rng.randrange(15), rng.randrange(15)) for _ in range(6)} for _ in range(3)]
    source = tmp_path / "in"
    reach = ReachableStream(spark, str(tmp_path / "reach"))
    seen = set()
    for batch in batches:
        spark.createDataFrame(sorted(batch), "s long, o long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("s long, o long").parquet(str(source))
        query = reach.start(stream)
        query.awaitTermination(120)
        query.stop()
        seen |= batch
        rows = [tuple(r) for r in reach.pairs().collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == closed_by_search(seen)


def test_a_batch_may_be_tried_again(spark, tmp_path):
    reach = ReachableStream(spark, str(tmp_path))
    edges = lambda pairs: spark.createDataFrame(pairs, "s long, o long")
    reach.add(edges([(1, 2)]), 0)
    for _ in range(2):
        reach.add(edges([(2, 3), (3, 1), (1, 2)]), 1)
    assert {tuple(r) for r in reach.pairs().collect()} == closed_by_search({(1, 2), (2, 3), (3, 1)})
