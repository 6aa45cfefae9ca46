"""Files of the rounds of components."""

from rolecast.llm import components


def test_small_rounds_of_components_are_single_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, label, write=components.written: made.append(write(df, label)) or made[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 3], "a long, b long")
        found = {r.node: r.component for r in components.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {k: k // 3 * 3 + 1 if k % 3 else k - 2 for k in range(1, 301)}
    assert made and all(len(x.inputFiles()) == 1 for x in made)
