"""A band value that many texts share leaves none of their links out."""

from pyspark.sql import functions as F

from senseloom.llm import nearcopies
from senseloom.llm.components import components


def test_texts_that_share_a_frequent_band_alone_are_linked(spark):
    # Every text has one value in band 0 and a value of its own in band 1; every three texts have equal further bits, others are far away.
    rows = [(i, [(1 << (i // 3)) * 0x11, ((1 << 30) - 1) * (i // 3 % 7) << (i // 3)], [5, 1000 + i]) for i in range(60)]
    signed = spark.createDataFrame(rows, "text_hash long, near array<long>, keys array<long>")
    for hot in (100, 10):
        found = components(nearcopies.candidate_links(signed, 60, 2, 0, hot_rows=hot)).groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("nodes")).collect()
        assert sorted(r["nodes"] for r in found) == [[3 * g, 3 * g + 1, 3 * g + 2] for g in range(20)]
