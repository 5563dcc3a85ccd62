from marlstone.operators.relations import _containing


def test_keys_of_more_lengths_than_1024(spark):
    local = spark.createDataFrame([(f"s{n}", 0, "a" * n) for n in range(1, 1101)], "l_slug string, l_pos int, l_key string")
    foreign = spark.createDataFrame([("f", 0, "a" * 1100)], "f_slug string, f_pos int, f_key string")
    assert _containing(local, foreign).count() == 1100
