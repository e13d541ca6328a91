"""Sources, sinks and streams."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.sources import frames
from tessera.streaming import live


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, x double")
    frames.write_csv(df, f"{tmp_path}/x.csv")
    frames.write_csv(df, f"{tmp_path}/x.csv", append=True)
    got = frames.csv(spark, f"{tmp_path}/x.csv", "k string, x double").collect()
    assert sorted((r.k, r.x) for r in got if r.k == "a") == [("a", 1.5)] * 2 and all(r.x is None for r in got if r.k == "b")


def test_two_header_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",,Y,CVTS,X,X\nfid,iid,height,age,a,b\n1,1,170,30,0,2\n2,2,180,,1,\n")
    df, roles = frames.two_header_csv(spark, str(tmp_path / "d.csv"))
    assert roles["Y"] == ["height"] and roles["X"] == ["a", "b"]
    assert sorted((r.iid, r.height, r.age, r.b) for r in df.collect()) == [("1", 170.0, 30.0, 2.0), ("2", 180.0, None, None)]


def test_models_and_runs(spark, tmp_path):
    model = {"beta": np.arange(6.0).reshape(2, 3), "name": "ridge", "inner": {"alpha": 0.1, "flags": [True, None]}}
    frames.save_model(spark, f"{tmp_path}/m", model)
    got = frames.load_model(spark, f"{tmp_path}/m")
    assert np.array_equal(got["beta"], model["beta"]) and got["inner"] == model["inner"] and got["name"] == "ridge"
    for n, p in (("one", 70.5), ("two", 90.0)):
        frames.write_run(spark, f"{tmp_path}/runs/{n}", {"precision": p})
    assert [r.run for r in frames.runs(spark, f"{tmp_path}/runs").collect()] == ["two", "one"]


def test_compute_once(spark, tmp_path):
    calls = []
    make = lambda: (calls.append(1), spark.range(3))[1]
    assert frames.compute_once(spark, f"{tmp_path}/c", make).count() == frames.compute_once(spark, f"{tmp_path}/c", make).count() == 3 and calls == [1]


def test_bed(spark, tmp_path):
    d = np.random.default_rng(0).integers(-1, 3, (7, 10))
    frames.write_bed(f"{tmp_path}/g", [f"s{i}" for i in range(10)], [f"v{i}" for i in range(7)], d)
    spark.dataSource.register(frames.BedSource)
    g = spark.read.format("bed").option("path", f"{tmp_path}/g").option("block", "3").load()
    got = {(r["sample"], r.variant): r.dosage for r in g.collect()}
    assert got == {(f"s{j}", f"v{i}"): (int(d[i, j]) if d[i, j] >= 0 else -9) for i in range(7) for j in range(10)}
    assert frames.wide_genotypes(g, ["v1", "v3"]).columns == ["sample", "v1", "v3"]


def test_ranges(spark):
    pos = spark.createDataFrame([("1", 5), ("1", 50), ("X", 5)], "chrom string, pos long")
    assert [(r.chrom, r.pos) for r in frames.variants_in(spark, pos, ["chr1_1-10"]).select("chrom", "pos").collect()] == [("1", 5)]
    e = frames.exon_ranges(spark.createDataFrame([("[1-5, 9-12]",)], "cds string"), "cds").collect()
    assert [(r.start, r.end) for r in e] == [(1, 5), (9, 12)]


def test_stream_folds_equal_batch(spark, tmp_path):
    spark.range(100).withColumn("k", F.concat(F.lit("s"), "id")).write.parquet(f"{tmp_path}/in")
    s = live.filtered(live.folded(spark.readStream.schema("id long, k string").parquet(f"{tmp_path}/in"), "k"), {"id": [(10, ">=")]})
    q = s.writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = folds.hashed_folds(spark.read.parquet(f"{tmp_path}/in"), "k").where("id >= 10")
    assert sorted(map(tuple, spark.table("folded").select("id", "fold").collect())) == sorted(map(tuple, batch.select("id", "fold").collect()))


def test_windowed_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "a", float(i)) for i in range(6)]
    spark.createDataFrame(rows, "t string, g string, v double").select(F.to_timestamp("t").alias("t"), "g", "v").write.parquet(f"{tmp_path}/w")
    s = live.windowed_mean(spark.readStream.schema("t timestamp, g string, v double").parquet(f"{tmp_path}/w"), "t", "v", ["g"], "2 minutes", "1 minute")
    q = s.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.mean) for r in spark.table("win").collect()) == [(2, 0.5), (2, 2.5), (2, 4.5)]
