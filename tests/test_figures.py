"""Figures kept by changes against a recompute of the whole table."""

import random

from labelforge.sources import published
from labelforge.streaming import figures

IMAGE = "struct<kind:string,cents:long>"


def batches(seed, n=5, size=60):
    """Batches of new, changed and deleted rows, and the table after each."""
    rng, rows, out = random.Random(seed), {}, []
    for _ in range(n):
        changes = []
        for _ in range(size):
            key = rng.randrange(40)
            after = None if key in rows and rng.random() < 0.3 else (rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(1000)]))
            changes.append((rows.get(key), after))
            rows.pop(key, None) if after is None else rows.update({key: after})
        out.append((changes, list(rows.values())))
    return out


def table(df):
    return {(r.kind, r.n, r.cents) for r in df.collect()}


def whole(spark, rows):
    return table(figures.figures(spark.createDataFrame(rows, "kind string, cents long"), ["kind"]))


def test_five_batches_and_a_repeat(spark, tmp_path, monkeypatch):
    root, step = f"file://{tmp_path}/figures", figures.keep(f"file://{tmp_path}/figures", ["kind"])
    for number, (changes, rows) in enumerate(batches(1)):
        df = spark.createDataFrame([*changes, (None, None)], f"before {IMAGE}, after {IMAGE}")
        if number == 2:
            # The writer stops after the tables, before the manifest: nothing of the batch is seen.
            with monkeypatch.context() as m:
                m.setattr(published, "publish", lambda tables, root: tables["figures"].write.parquet(f"{root}/figures/version=3"))
                step(df, number)
            assert table(published.published(spark, root, "figures")) == before
        step(df, number)
        step(df, number)
        before = table(published.published(spark, root, "figures"))
        assert before == whole(spark, rows)
    step(df.limit(0), 9)
    assert table(published.published(spark, root, "figures")) == before


def test_as_a_stream(spark, tmp_path):
    given = batches(2, n=4)
    for number, (changes, _) in enumerate(given):
        spark.createDataFrame(changes, f"before {IMAGE}, after {IMAGE}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"before {IMAGE}, after {IMAGE}").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/out"
    q = stream.writeStream.foreachBatch(figures.keep(root, ["kind"])).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert published.current(spark, root) == 4 and table(published.published(spark, root, "figures")) == whole(spark, given[-1][1])
