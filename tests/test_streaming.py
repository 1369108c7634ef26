from stackmeter.operators import frames
from stackmeter.streaming import slices

from . import scan


def test_streamed_projection_equals_batch(spark, tmp_path):
    placed = scan.objects(3)
    rows = [(s, z, scan.HEIGHT, scan.WIDTH, scan.frame(placed, z, seed=z + 50 * s).reshape(-1).tolist()) for s in (0, 1) for z in range(6)]
    for n, part in enumerate((rows[6:9] + rows[3:6], rows[9:] + rows[:3])):  # out of order
        spark.createDataFrame(part, frames.FRAME).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(frames.FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = slices.projected(stream).writeStream.outputMode("update").format("memory").queryName("edf_stream").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.stack: r for r in spark.table("edf_stream").collect() if r.n_slices == 6}
    want = {r.stack: r for r in frames.focus_stacked(spark.createDataFrame(rows, frames.FRAME)).collect()}
    assert set(got) == set(want) == {0, 1}
    assert all(got[s].best_z == want[s].best_z and got[s].edf == want[s].edf for s in want)
