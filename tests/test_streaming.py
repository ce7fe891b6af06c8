import shutil

import numpy as np
import pytest
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import functions as F

from tidepool.plans import clustream as cl
from tidepool.plans import denstream as de
from tidepool.plans import dstream, streamkm
from tidepool.session import cut_lineage
from tidepool.sources import readers
from tidepool.sources.store import KeyedTable, ModelStore, load_model
from tidepool.operators import snapshots
from tidepool.streaming import jobs, keyed
from tidepool.streaming.metrics import BatchMeter, PhaseTimer, throughput
from tidepool.streaming.runner import late_counts, restore

RNG = np.random.default_rng(21)
X = np.concatenate([RNG.normal(size=(120, 2)) * 0.2 + c for c in ([0, 0], [4, 4], [8, 0])])
T = np.tile(np.arange(120) // 30, 3)


@pytest.fixture
def folder(tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    for b in range(4):
        (lines / f"part{b}.txt").write_text("".join(
            f"{t}/{x[0]!r},{x[1]!r}\n".replace("np.float64(", "").replace(")", "") for x, t in zip(X, T) if t == b))
    return tmp_path


def stream(spark, folder):
    return readers.timed_points(readers.text_stream(spark, str(folder / "in")))


def start(spark):
    rows = [(i, c) for i, c in enumerate([[0.0, 0.0], [4.0, 4.0], [8.0, 0.0], [2.0, 2.0], [6.0, 2.0]])]
    return cl._model(spark.createDataFrame(rows, "mc_id long, centre array<double>"))


def test_clustream_job_versions_and_restart(spark, folder):
    store = ModelStore(spark, f"file://{folder}/store", keep=2)
    params = cl.CluStreamParams(q=5, m=5, horizon=1e9)
    timer, seen = PhaseTimer(), []
    args = (params, start(spark), store, f"file://{folder}/ckpt")
    jobs.run_clustream(stream(spark, folder), *args, timer=timer, watch=lambda s, b, i: seen.append((i, s.rows)),
                       pyramid=(f"file://{folder}/snaps", 2, 2)).awaitTermination()
    assert [i for i, _ in seen] == [0, 1, 2, 3] and seen[-1][1] == 360
    assert store.versions() == [3, 4] and {"load", "update", "watch"} <= timer.seconds.keys()
    state = restore(store, cl.Clustering)
    assert state.clock == 3 and state.model.agg(F.sum("n")).first()[0] == pytest.approx(365)
    before = sorted(map(tuple, state.model.select("mc_id", "n").collect()))
    # Nothing new: no batch.  A further file: the run goes on from the stored version.
    jobs.run_clustream(stream(spark, folder), *args).awaitTermination()
    assert store.versions() == [3, 4]
    (folder / "in" / "part4.txt").write_text("9/0.0,0.0\n")
    jobs.run_clustream(stream(spark, folder), *args).awaitTermination()
    after = restore(store, cl.Clustering)
    assert after.batches == 5 and after.clock == 9
    assert after.model.agg(F.sum("n")).first()[0] == pytest.approx(366) and before


def test_batches_equal_plain_steps(spark, folder):
    """The stream and a loop of steps over the same batches give the same model."""
    store = ModelStore(spark, f"file://{folder}/store")
    params = cl.CluStreamParams(q=5, m=5, horizon=2.0)
    jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c").awaitTermination()
    state = cl.Clustering(start(spark))
    pts = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(X, T)], "x array<double>, t long")
    order = [int(r["t"]) for r in spark.read.text(str(folder / "in")).select(
        F.input_file_name().alias("f"), F.split("value", "/")[0].cast("int").alias("t")).distinct().orderBy("f").collect()]
    for b in order:
        state = cl.step(state, pts.filter(F.col("t") == b), params)
    got = {r["mc_id"]: r["n"] for r in restore(store, cl.Clustering).model.collect()}
    assert sum(got.values()) == pytest.approx(state.model.agg(F.sum("n")).first()[0])


def test_a_replayed_batch_is_not_applied_twice(spark, folder):
    store = ModelStore(spark, f"file://{folder}/store", keep=10)
    params = cl.CluStreamParams(q=5, m=5, horizon=1e9)
    jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c1").awaitTermination()
    total = restore(store, cl.Clustering).model.agg(F.sum("n")).first()[0]
    # The last batch was folded, but its offset was not committed: it comes again.
    for name in ("3", ".3.crc"):
        (folder / "c1" / "commits" / name).unlink()
    jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c1").awaitTermination()
    assert restore(store, cl.Clustering).model.agg(F.sum("n")).first()[0] == total and store.versions() == [1, 2, 3, 4]


def test_a_store_belongs_to_one_checkpoint(spark, folder):
    store = ModelStore(spark, f"file://{folder}/store")
    params = cl.CluStreamParams(q=5, m=5, horizon=1e9)
    jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c1").awaitTermination()
    with pytest.raises(ValueError, match="checkpoint"):
        jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c2")
    # The checkpoint's own folder was lost: its batches start again, on a store that is further on.
    shutil.rmtree(folder / "c1")
    with pytest.raises(StreamingQueryException, match="do not belong together"):
        jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c1").awaitTermination()


def test_clustream_from_its_own_first_batch(spark, folder):
    store = ModelStore(spark, f"file://{folder}/store")
    params = cl.CluStreamParams.per_record(4)
    jobs.run_clustream(stream(spark, folder), params, jobs.clustream_from_buffer(params, 60), store,
                       f"file://{folder}/c").awaitTermination()
    assert restore(store, cl.Clustering).model.count() == 4


def test_record_job_from_its_own_first_batch(spark, folder):
    store = ModelStore(spark, f"file://{folder}/store")
    params = cl.CluStreamParams.per_record(4, horizon=1e9)
    jobs.run_clustream_records(stream(spark, folder), params, jobs.clustream_from_buffer(params, 60), store,
                               f"file://{folder}/c").awaitTermination()
    state = restore(store, cl.Clustering)
    total = state.model.agg(F.sum("n"), F.count("*")).first()
    assert state.rows == 360 and tuple(total) == (364.0, 4)


def test_lineage_ids_are_pruned_between_snapshots(spark, folder):
    snaps = f"file://{folder}/snaps"
    sizes = {}
    for every in (1, 10 ** 9):
        store = ModelStore(spark, f"file://{folder}/store{every}")
        params = cl.CluStreamParams(q=5, m=5, horizon=1e9, t_factor=0.2)
        jobs.run_clustream(stream(spark, folder), params, start(spark), store, f"file://{folder}/c{every}", prune_every=every,
                           pyramid=(snaps + str(every), 2, 2)).awaitTermination()
        sizes[every] = restore(store, cl.Clustering).model.agg(F.sum(F.size("ids")), F.sum("n")).first()
    assert sizes[1][1] == sizes[10 ** 9][1] and sizes[1][0] < sizes[10 ** 9][0]
    for horizon in (1, 2, 3):
        got, want = (sorted((r["n"], r["lst"]) for r in snapshots.horizon_query(spark, snaps + str(e), 4, horizon).collect()) for e in sizes)
        assert got == want


@pytest.mark.parametrize("late,rows,dropped", [(None, 366, 0), (("t", 1.0), 364, 2)])
def test_late_rows_with_and_without_a_bound(spark, folder, late, rows, dropped):
    for b, text in ((4, "1/0.0,0.0\n1/4.0,4.0\n2/0.0,0.0\n"), (5, "9/0.0,0.0\n2/4.0,4.0\n"), (6, "8/0.0,0.0\n")):
        (folder / "in" / f"part{b}.txt").write_text(text)
    store, ckpt = ModelStore(spark, f"file://{folder}/store"), f"file://{folder}/ckpt"
    params = cl.CluStreamParams(q=5, m=5, horizon=1e9)
    # Times 0 to 3 come first; then 1, 1 and 2, where 2 is the oldest allowed; then 9 with a 2 that is late to it alone; then 8.
    files = sorted((folder / "in").iterdir())
    for f in files:
        f.rename(folder / f.name)
    for b, f in enumerate(files):
        shutil.copy(folder / f.name, folder / "in" / f.name)
        jobs.run_clustream(stream(spark, folder), params, start(spark), store, ckpt, late=late).awaitTermination()
    state = restore(store, cl.Clustering)
    assert state.rows == rows and state.batches == 7
    assert late_counts(store)["late_rows"] == dropped
    assert late_counts(store)["late_clock"] == (9.0 if late else None)


def test_other_jobs(spark, folder):
    pts = readers.vectors_from_text(spark, str(folder / "in")).limit(0)
    assert pts.columns == ["x"]
    sample = spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>")
    jobs.build_denstream_model(sample, f"file://{folder}/den", eps=0.3, mu=5)
    jobs.build_clustream_model(sample, 3, f"file://{folder}/clu")
    assert load_model(spark, f"file://{folder}/clu").count() == 3
    den = ModelStore(spark, f"file://{folder}/s1")
    jobs.run_denstream(stream(spark, folder), de.DenStreamParams(eps=0.6, mu=10, beta=0.3, lam=0.1),
                       load_model(spark, f"file://{folder}/den"), den, f"file://{folder}/c1").awaitTermination()
    model = restore(den, de.DecayingState).model
    assert model.filter("kind = 'p'").count() == 3
    assert de.final_clusters(model, 0.6, 10, d=2).count() == 3
    grid = ModelStore(spark, f"file://{folder}/s2")
    jobs.run_dstream(stream(spark, folder), dstream.DStreamParams(gaps=(1.0, 1.0), lam=0.9, cm=3.0, cl=0.5), grid,
                     f"file://{folder}/c2").awaitTermination()
    state = restore(grid, dstream.GridState)
    assert state.tick == 4 and dstream.clusters_of(state.model).select("cluster_id").distinct().count() >= 3
    assert dstream.micro_clusters_of(state.model, dstream.DStreamParams(gaps=(1.0, 1.0))).count() >= 3
    tree = ModelStore(spark, f"file://{folder}/s3")
    jobs.run_clustree(stream(spark, folder), 0.5, 0.01, tree, f"file://{folder}/c3").awaitTermination()
    assert restore(tree, de.DecayingState).model.count() >= 3
    km = ModelStore(spark, f"file://{folder}/s4")
    p = streamkm.StreamKMParams(k=3, size=40, window=400)
    jobs.run_streamkm(stream(spark, folder), p, km, f"file://{folder}/c4").awaitTermination()
    buckets = restore(km, streamkm.BucketState).model
    assert buckets.agg(F.sum("weight")).first()[0] == pytest.approx(360)
    final = streamkm.final_clusters(buckets, p)
    assert jobs.score_sse(sample, final).first()["n"] == 360
    sk = ModelStore(spark, f"file://{folder}/s5")
    jobs.run_streaming_kmeans(stream(spark, folder), 3, 2, 0.5, sk, f"file://{folder}/c5").awaitTermination()
    assert sk.latest() == 4


def test_metrics_word_count_and_probe(spark, folder):
    meter = BatchMeter()
    spark.streams.addListener(meter)
    jobs.batch_probe(stream(spark, folder), f"file://{folder}/probe", f"file://{folder}/c").awaitTermination()
    got = sorted((r["batch_id"], r["n_rows"]) for r in spark.read.parquet(f"{folder}/probe").collect())
    assert got == [(i, 90) for i in range(4)]
    import time

    for _ in range(50):
        if meter.table(spark).filter("n_rows > 0").count() == 4:
            break
        time.sleep(0.2)
    spark.streams.removeListener(meter)
    report = throughput(meter.table(spark), steady_rows=90).first()
    assert report["records"] == 360 and report["batches"] == 4
    assert report["max_throughput"] >= report["min_throughput"] > 0 and report["steady_throughput"] > 0
    words = folder / "words"
    words.mkdir()
    (words / "a.txt").write_text("a b a\n")
    (words / "b.txt").write_text("b c\n")
    table = KeyedTable(spark, f"file://{folder}/counts", "word", fold=2)

    def count():
        jobs.running_word_count(readers.text_stream(spark, str(words)), table, f"file://{folder}/wc").awaitTermination()
        return {r["word"]: r["n"] for r in table.read().collect()}

    assert count() == {"a": 2, "b": 2, "c": 1}
    for i, text in enumerate(("c d", "a", "e a", "b")):
        (words / f"more{i}.txt").write_text(text)
        count()
    want = {"a": 4, "b": 3, "c": 2, "d": 1, "e": 1}
    assert count() == want and len(table._folders("base")) == 1
    base = table._folders("base")[0]
    for batch in (0, base):  # a replay of a batch changes nothing
        table.upsert(spark.createDataFrame([("a", 1)], "word string, n long"), batch)
    last = max([base, *table._folders("batch")])
    if last > base:
        again = spark.read.parquet(f"{folder}/counts/batch={last}").drop("_batch")
        table.upsert(cut_lineage(again), last)
    assert {r["word"]: r["n"] for r in table.read().collect()} == want


def test_streaming_assignment_of_final_clusters(spark, folder):
    from tidepool.operators.evaluate import assign_final

    clusters = spark.createDataFrame([(i, c) for i, c in enumerate([[0.0, 0.0], [4.0, 4.0], [8.0, 0.0]])], "cluster_id long, centre array<double>")
    out = assign_final(stream(spark, folder), clusters)
    assert out.isStreaming
    out.select("cluster_id").writeStream.format("memory").queryName("final").trigger(availableNow=True).start().awaitTermination()
    assert {r["cluster_id"]: r["count"] for r in spark.table("final").groupBy("cluster_id").count().collect()} == {0: 120, 1: 120, 2: 120}


def test_keyed_models_and_their_merge(spark, folder):
    params = cl.CluStreamParams(q=4, m=5, horizon=1e9)
    keyed_rows = stream(spark, folder).withColumn("key", (F.col("t") % 2).cast("long"))
    out = keyed.keyed_clustream(keyed_rows, "key", params)
    # A processing-time timeout asks for batches without data for ever; end with the data instead.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = out.writeStream.outputMode("update").format("memory").queryName("keyed").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = spark.table("keyed").groupBy("key", "mc_id").agg(F.max_by(F.struct("n", "ls", "ss", "lst", "sst"), "n").alias("m"))
    rows = last.select("key", "mc_id", "m.*")
    assert {r["key"] for r in rows.collect()} == {0, 1}
    merged = keyed.merge_models(rows, 4)
    n, k = merged.agg(F.sum("n"), F.count("*")).first()
    assert k <= 4 and n == pytest.approx(rows.agg(F.sum("n")).first()[0])
    assert keyed.random_key(spark.range(100), 4).select("key").distinct().count() == 4


def test_kafka_reader_is_a_plain_reader(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.kafka_lines(spark, "localhost:1", "points")
