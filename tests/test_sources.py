"""Arrays by ranges, the two-phase sink, and logs that resume."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import arrays, logs


def rows_of(spark, folder, **options):
    spark.dataSource.register(arrays.NpySource)
    found = spark.read.format("npy").options(**options).load(str(folder))
    return found, sorted(((r.name, r.position, tuple(r.shape), tuple(r["values"])) for r in found.collect()))


def test_arrays_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    given = {"a": rng.normal(size=(50, 3, 4)), "b": np.arange(6, dtype=np.uint8).reshape(3, 2), "f": np.asfortranarray(rng.normal(size=(5, 2))), "none": np.zeros((0, 3)), "line": np.arange(7.0)}
    (tmp_path / "sub").mkdir()
    for name, value in given.items():
        np.save(tmp_path / (f"sub/{name}.npy" if name == "b" else f"{name}.npy"), value)
    np.save(tmp_path / "scalar.npy", np.float64(3))
    np.savez(tmp_path / "z.npz", x=given["a"], y=given["line"])
    np.savez_compressed(tmp_path / "c.npz", x=given["a"])
    (tmp_path / "_hidden").mkdir()
    np.save(tmp_path / "_hidden/h.npy", given["a"])
    (tmp_path / "note.txt").write_text("no array")
    named = {"a": "a", "sub/b": "b", "f": "f", "line": "line", "z/x": "a", "z/y": "line", "c/x": "a"}
    expected = sorted((n, i, given[k].shape, tuple(np.asarray(v, dtype=float).ravel().tolist())) for n, k in named.items() for i, v in enumerate(given[k]))
    few, got = rows_of(spark, tmp_path)
    many, again = rows_of(spark, tmp_path, splitBytes=200)
    assert got == again == expected and many.rdd.getNumPartitions() > few.rdd.getNumPartitions() + 40


def test_objects_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        rows_of(spark, tmp_path)


def test_written_arrays_come_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    spark.dataSource.register(arrays.NpySource)
    rows = spark.range(0, 200).select(F.col("id").alias("position"), F.array(*(F.col("id") * k + 0.5 for k in range(3))).alias("values")).repartition(5)
    rows.write.format("npy").mode("append").save(folder)
    assert sorted((r.position, tuple(r["values"])) for r in arrays.written_rows(spark, folder).collect()) == [(i, (0.5, i + 0.5, 2 * i + 0.5)) for i in range(200)]
    states = {r.name: (r.rows, r.state) for r in arrays.against_manifest(spark, folder).collect()}
    assert len(states) == 5 and sum(n for n, _ in states.values()) == 200 and {s for _, s in states.values()} == {"whole"}
    rows.withColumn("position", F.col("position") + 200).write.format("npy").mode("append").save(folder)
    assert arrays.written_rows(spark, folder).count() == 400
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 11 and len(json.loads((tmp_path / "out/manifest.json").read_text())["files"]) == 10
    first, second = names[1], names[2]
    assert names[0] == "manifest.json"
    (tmp_path / "out" / first).write_bytes(b"other")
    (tmp_path / "out" / second).rename(tmp_path / "out/new.npz")
    states = {r.name: r.state for r in arrays.against_manifest(spark, folder).collect()}
    assert (states[first[:-4]], states[second[:-4]], states["new"]) == ("changed", "missing", "unlisted")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(arrays.NpySource)
    bad = spark.range(0, 100).select(F.col("id").alias("position"), F.when(F.col("id") == 77, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("values")).repartition(4)
    with pytest.raises(Exception, match="one length|different lengths"):
        bad.write.format("npy").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    for wrong in (bad.withColumnRenamed("position", "p"), bad.withColumn("values", F.lit(None).cast("array<double>"))):
        with pytest.raises(Exception):
            wrong.write.format("npy").mode("append").save(str(tmp_path / "out"))


def test_a_stopped_run_goes_on(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "log"), ["k"])
    rows = spark.range(0, 95).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def solve(own, fail_at=None):
        def run(frames):
            for frame in frames:
                for k in frame["k"]:
                    if k == fail_at:
                        raise RuntimeError("stopped")
                    seen.add(1)
                yield frame.assign(y=frame["x"] + 1)

        return own.mapInPandas(run, "k long, x long, y long")

    assert log.read() is None and log.run(rows, 20, solve, most=2) == ["batch-000000", "batch-000001"]
    with pytest.raises(Exception, match="stopped"):
        log.run(rows, 20, lambda own: solve(own, 65))
    assert sorted(log.committed()) == ["batch-000000", "batch-000001", "batch-000002"] and log.read().count() == 60
    before = seen.value
    assert log.run(rows, 20, solve) == ["batch-000003", "batch-000004"] and seen.value - before == 35
    assert sorted((r.k, r.y) for r in log.read().collect()) == [(i, 2 * i + 1) for i in range(95)]
    assert log.run(rows, 20, solve) == [] and log.pending(rows).count() == 0
    #: Rows that come later are batches of their own; keys that are there already are left out.
    more = rows.unionByName(spark.range(90, 110).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")))
    log.append("late", solve(log.pending(more)))
    assert sorted(r.k for r in log.read().collect()) == list(range(110)) and not log.append("late", rows)
    with pytest.raises(ValueError):
        log.append("a=b", rows)


def test_an_attempt_without_a_commit_is_not_read(spark, tmp_path):
    log = logs.Log(spark, str(tmp_path / "log"), ["k"])
    rows = spark.range(3).withColumnRenamed("id", "k")
    rows.write.parquet(str(tmp_path / "log/batches/batch-000000-lost"))
    assert log.read() is None and log.run(rows, 10, lambda own: own) == ["batch-000000"] and log.read().count() == 3
    assert log.run(rows.limit(0), 10, lambda own: own) == []
