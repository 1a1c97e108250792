from quarry.session import scratch_path, shared_dir, shuffle_partitions, size_shuffle


def test_shared_folder_and_fresh_paths(spark):
    d = shared_dir(spark)
    assert d and d == shared_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(d)


def test_size_shuffle_raises_initial_partitions_only(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffle(spark, 30 * (1 << 40)) == 30 * 8192
        assert spark.conf.get(key) == str(30 * 8192)
        assert shuffle_partitions(spark) == 30 * 8192
        # small shuffles never go below the session's shuffle partitions
        assert size_shuffle(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key)
    assert shuffle_partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
