import numpy as np
import pytest

from quillon.streaming.clusters import OnlineKMeans, windowed_contingency


def test_centres_follow_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.5, (60, 2)), rng.normal(6, 0.5, (60, 2))])
    for part in range(3):
        rows = [(k, x[k].tolist()) for k in range(part, 120, 3)]
        spark.createDataFrame(rows, "id long, features array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("id long, features array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    online = OnlineKMeans(spark, f"{tmp_path}/state", [[1.0, 1.0], [5.0, 5.0]])
    online.follow(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert online.weights.tolist() == [60, 60] and online.batch == 2
    assert np.allclose(online.centres, [x[:60].mean(0), x[60:].mean(0)])
    # a batch that comes again counts once, and a new query goes on from the state
    online.update(spark.createDataFrame([(0, [0.0, 0.0])], "id long, features array<double>"), 2)
    again = OnlineKMeans(spark, f"{tmp_path}/state")
    assert np.allclose(again.centres, online.centres) and again.batch == 2
    labels = again.model.predict(spark.createDataFrame([(0, [0.1, 0.0]), (1, [6.0, 6.0])], "id long, features array<double>"))
    assert [r["cluster"] for r in labels.orderBy("id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        OnlineKMeans(spark, f"{tmp_path}/none")


def test_contingency_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", 0, 0), ("2024-01-01 00:50:00", 0, 0), ("2024-01-01 01:10:00", 1, 0), ("2024-01-01 01:20:00", 1, 1)]
    spark.createDataFrame(rows, "t string, a int, b int").selectExpr("cast(t as timestamp) as t", "a", "b").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, a int, b int").parquet(f"{tmp_path}/in")
    counts = windowed_contingency(stream, "t", "a", "b")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((str(r["start"]), r["true"], r["pred"], r["n"]) for r in spark.table("windows").collect())
    assert got == [("2024-01-01 00:00:00", 0, 0, 2), ("2024-01-01 01:00:00", 1, 0, 1), ("2024-01-01 01:00:00", 1, 1, 1)]
