from dqspark.llm.common import ARROW_BYTES, small_batches, store

from .helpers import frame

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stored_frames_bound_arrow_batches_by_bytes(spark):
    before = spark.conf.get(KEY)
    small_batches(spark)  # also where the session sets nothing
    try:
        spark.conf.set(KEY, "64m")
        kept = store(frame(spark, [(1, "a"), (2, None)]), "bounded")
        assert spark.conf.get(KEY) == str(ARROW_BYTES) and kept.count() == 2
        spark.conf.set(KEY, "1000")
        small_batches(spark)
        assert spark.conf.get(KEY) == "1000"
        big = frame(spark, [(i, "x" * 900) for i in range(50)]).repartition(1)

        def sizes(batches):
            for b in batches:
                yield b.slice(0, 1)

        assert big.mapInArrow(sizes, big.schema).count() > 10
    finally:
        spark.conf.set(KEY, before)
