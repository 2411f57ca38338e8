"""Clips are dealt to all tasks."""

from tidemark.plans import q_signal

SF = "/root/testdata/sf0.001"


def test_clips_of_a_small_table_are_dealt_to_all_tasks(spark):
    for rows in (q_signal._audio(spark, SF), q_signal._sounds(spark, SF)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
