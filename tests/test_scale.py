"""Global order, closures, split sources, exact mappings and state with timers, against plain Python."""

import io
import itertools
import random
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.operators import datadir, intervals, prefix
from timbral.sources import binary, ranges
from timbral.streaming import windows

# --- global order -------------------------------------------------------------------------------


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_positions_sums_and_runs_over_many_ranges(many_ranges):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), rng.choice([None, rng.randrange(20)]), rng.random()) for i in rng.sample(range(1000), 300)]
    df = many_ranges.createDataFrame(rows, "k long, kind string, n int, x double").repartition(5)
    ordered = sorted(rows)
    assert [r["k"] for r in prefix.numbered(df, "k").orderBy("at").collect()] == [r[0] for r in ordered]
    assert {r["at"] for r in prefix.numbered(df, "k").collect()} == set(range(300))
    sums = [0, *itertools.accumulate(r[2] or 0 for r in ordered)]
    assert [r["before"] for r in prefix.running_before(df, "n", "k").orderBy("k").collect()] == sums[:-1]
    floats = [0.0, *itertools.accumulate(r[3] for r in ordered)]
    assert np.allclose([r["before"] for r in prefix.running_before(df, "x", "k").orderBy("k").collect()], floats[:-1])
    before = [None] + [r[1] for r in ordered[:-1]]
    assert [r["p"] for r in prefix.with_previous(df, {"kind": "p"}, "k").orderBy("k").collect()] == before
    runs = list(itertools.accumulate((int(a != b) for a, b in zip(before[1:], [r[1] for r in ordered[1:]])), initial=0))
    assert [r["run"] for r in prefix.islands(df, ["kind"], "k").orderBy("k").collect()] == runs


def test_order_of_odd_tables(many_ranges):
    empty = many_ranges.createDataFrame([], "k long, kind string")
    assert prefix.numbered(empty, "k").count() == 0 and prefix.islands(empty, ["kind"], "k").count() == 0 and prefix.running_before(empty, "k", "k").count() == 0
    nulls = many_ranges.createDataFrame([(None, None), (None, None), (1, None), (2, "a")], "k long, kind string")
    assert [r["run"] for r in prefix.islands(nulls, ["kind"], "k").orderBy("run").collect()] == [0, 1, 2, 2]
    same = many_ranges.createDataFrame([(7, "a")] * 500, "k long, kind string")
    assert {r["at"] for r in prefix.numbered(same, "k").collect()} == set(range(500))


def test_no_window_without_a_partition(spark):
    df = spark.createDataFrame([(i, f"s{i % 7}", i * 0.5) for i in range(60)], "utt long, spk string, dur double")
    for made in (datadir.dense_ids(df, "spk"), datadir.groups_up_to(df, "spk", 20, "1"), datadir.calibration_trials(df, (1.0, 9.0), 10.0, 3, "1")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    store = spark.createDataFrame([(f"n{i}", bytearray([i])) for i in range(5)], "key string, data binary")
    picked = binary.pick_random(store, df, "utt", "s").collect()
    assert len(picked) == 60 and {r["blob_key"] for r in picked} == {f"n{i}" for i in range(5)}


# --- closure ------------------------------------------------------------------------------------


def brute_closure(tables, keys):
    now = {n: set(rows) for n, (_, rows) in tables.items()}
    while True:
        before = {n: len(r) for n, r in now.items()}
        for key in keys:
            have = [(n, c.index(key)) for n, (c, _) in tables.items() if key in c]
            common = set.intersection(*({r[i] for r in now[n]} for n, i in have)) - {None}
            for n, i in have:
                now[n] = {r for r in now[n] if r[i] in common}
        if before == {n: len(r) for n, r in now.items()}:
            return now


def test_closure_equals_brute_force_and_cascades(spark):
    rng = random.Random(6)
    pick = lambda n: rng.choice([None, *range(n)]) if rng.random() < 0.05 else rng.randrange(n)
    for seed in range(1):
        tables = {
            "utt2spk": (("utt", "spk"), {(u, pick(25)) for u in range(90)}), "segments": (("utt", "rec"), {(u, pick(40)) for u in range(85)}),
            "speakers": (("spk",), {(s,) for s in range(22)}), "wav": (("rec",), {(r,) for r in rng.sample(range(40), 36)}), "enroll": (("spk", "rec"), {(pick(25), pick(40)) for _ in range(70)}),
        }
        frames = {n: spark.createDataFrame(sorted(rows, key=str), ", ".join(f"{c} long" for c in cols)) for n, (cols, rows) in tables.items()}
        got = {n: {tuple(r) for r in t.collect()} for n, t in datadir.closed(frames).items()}
        assert got == brute_closure(tables, ("utt", "spk", "rec"))
    chain = {"a": spark.createDataFrame([(i, i) for i in range(4)], "utt long, spk long"), "b": spark.createDataFrame([(i, i + 1) for i in range(4)], "spk long, utt long"), "c": spark.createDataFrame([(i,) for i in range(1, 4)], "utt long")}
    assert all(t.count() == 0 for t in datadir.closed(chain).values())  # each round takes one more link


# --- split sources ------------------------------------------------------------------------------


def whole(n):
    return b"\4" + struct.pack("<i", n)


def sparse_vector(v):
    at = np.flatnonzero(v)
    return b"SV " + whole(len(v)) + whole(len(at)) + b"".join(whole(int(i)) + b"\4" + struct.pack("<f", v[i]) for i in at)


def test_all_kinds_of_records(spark, tmp_path):
    v, m = np.array([0.0, 1.5, 0.0, -2.0]), np.array([[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]])
    head = struct.pack("<ffii", 0.0, 65535.0, 2, 3)
    marks = np.array([[0, 64, 192, 255]] * 3, "<u2").tobytes()  # each byte stands for itself
    records = {
        "fv": b"FV " + whole(4) + v.astype("<f4").tobytes(), "dv": b"DV " + whole(4) + v.astype("<f8").tobytes(), "sv": sparse_vector(v),
        "fm": b"FM " + whole(2) + whole(3) + m.astype("<f4").tobytes(), "dm": b"DM " + whole(2) + whole(3) + m.astype("<f8").tobytes(), "sm": b"SM " + whole(2) + b"".join(sparse_vector(r) for r in m),
        "cm": b"CM " + head + marks + np.array([[0, 3], [64, 100], [192, 255]], "u1").tobytes(), "cm2": b"CM2 " + head + (m * 100).astype("<u2").tobytes(), "cm3": b"CM3 " + struct.pack("<ffii", 1.0, 255.0, 2, 3) + m.astype("u1").tobytes(),
    }
    (tmp_path / "x.ark").write_bytes(b"".join(k.encode() + b" \0B" + r for k, r in records.items()))
    index = ranges.headers(spark, str(tmp_path / "x.ark"))
    assert [(r["key"], r["kind"]) for r in index.orderBy("offset").collect()] == [(k, k.upper()) for k in records]
    vectors = {r["utt"]: r["emb"] for r in ranges.read_records(index.where("key IN ('fv', 'dv', 'sv')")).collect()}
    assert all(np.allclose(x, v) for x in vectors.values()) and len(vectors) == 3
    matrices = {r["utt"]: np.array(r["feat"]) for r in ranges.read_records(index.where("key LIKE '%m%'"), matrix=True).collect()}
    want = {"fm": m, "dm": m, "sm": m, "cm2": m * 100, "cm3": m + 1, "cm": np.array([[0, 64, 192], [3, 100, 255]])}
    assert matrices.keys() == want.keys() and all(np.allclose(matrices[k], want[k]) for k in want)


def test_archives_are_read_in_more_tasks_than_files(spark, tmp_path):
    rows = [(f"u{i}", [float(i)] * 50) for i in range(400)]
    folder = str(tmp_path / "arks")
    index = ranges.write_archives(spark.createDataFrame(rows, "utt string, emb array<double>").repartition(2), folder)
    lines = [f"{r['key']} {r['path']}:{r['offset']}" for r in index.collect()]  # writes once
    back = ranges.read_archives(spark, folder, split=5000)
    assert back.rdd.getNumPartitions() > 10 and {r["utt"]: r["emb"] for r in back.collect()} == dict(rows)
    only = ranges.read_archives(spark, folder, keys=spark.createDataFrame([("u7",), ("u9",), ("no",)], "k string"), split=5000)
    assert sorted(r["utt"] for r in only.collect()) == ["u7", "u9"]
    entries = spark.createDataFrame([line.split(" ", 1) for line in lines], "key string, value string")
    assert {r["utt"]: r["emb"] for r in ranges.read_records(ranges.index_entries(entries)).collect()} == dict(rows)
    names = ranges.headers(spark, folder).select("key")  # columns can be left out
    assert names.count() == 400
    spark.dataSource.register(ranges.HeaderSource)
    assert spark.read.format("timbral_headers").schema("key string").load(folder).columns == ["key"]


def test_a_cut_archive_keeps_its_whole_records(spark, tmp_path):
    data = binary.archive_record("a", np.ones(4)) + binary.archive_record("b", np.ones(4))
    for cut in (3, 12, 20):
        (tmp_path / f"x{cut}.ark").write_bytes(data[:-cut])
    assert [r["utt"] for r in ranges.read_archives(spark, str(tmp_path)).collect()] == ["a"] * 3


def tar_bytes(members, **kw):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **kw) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_shards_give_each_run_once(spark, tmp_path, form):
    nested = tar_bytes([("inner.txt", b"not a member")])
    long = "d" * 90 + "/" + "f" * 60 if form != tarfile.USTAR_FORMAT else "d" * 90 + "/f"
    members = [("a.wav", nested), ("a.spk", b"1"), ("b.wav", b"x" * 3000), ("a.wav", b"again"), ("noext", b"?"), (f"{long}.wav", b"long"), ("c.d.wav", b""), ("c.d.spk", b"2"), ("c.d.spk", b"3")]
    (tmp_path / "s0.tar").write_bytes(tar_bytes(members, format=form))
    (tmp_path / "s1.tar").write_bytes(tar_bytes([("a.wav", b"other file")], format=form))
    found = ranges.read_shards(spark, str(tmp_path), split=1000)
    got = [(r["key"], {k: bytes(v) for k, v in r["members"].items()}) for r in found.orderBy("run").collect()]
    assert got == [("a", {"wav": nested, "spk": b"1"}), ("b", {"wav": b"x" * 3000}), ("a", {"wav": b"again"}), (long, {"wav": b"long"}), ("c.d", {"wav": b"", "spk": b"3"}), ("a", {"wav": b"other file"})]
    spk = ranges.read_shards(spark, str(tmp_path), ["spk"]).collect()
    assert sorted((r["key"], bytes(r["members"]["spk"])) for r in spk) == [("a", b"1"), ("c.d", b"3")]


def test_a_broken_last_member(spark, tmp_path):
    data = tar_bytes([("a.wav", b"1" * 600), ("a.spk", b"s"), ("b.spk", b"t"), ("b.wav", b"2" * 5000)])
    (tmp_path / "s.tar").write_bytes(data[: data.index(b"2" * 600) + 700])
    got = {r["key"]: set(r["members"]) for r in ranges.read_shards(spark, str(tmp_path)).collect()}
    assert got == {"a": {"wav", "spk"}, "b": {"spk"}}
    assert {r["key"] for r in ranges.read_shards(spark, str(tmp_path), last="drop").collect()} == {"a"}
    at = data.index(b"b.wav")
    (tmp_path / "s.tar").write_bytes(data[: at + 120] + b"junkjunk" + data[at + 128 :])
    got = {r["key"]: set(r["members"]) for r in ranges.read_shards(spark, str(tmp_path)).collect()}
    assert got == {"a": {"wav", "spk"}, "b": {"spk"}}


# --- label mapping ------------------------------------------------------------------------------


def test_assignments_equal_permutations():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        gain = rng.integers(0, 5, (n, m)).astype(float) if rng.random() < 0.5 else rng.random((n, m))
        at = intervals.best_assignment(gain)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(at.tolist())) == n and gain[np.arange(n), at].sum() == pytest.approx(best)


def test_mapping_of_many_labels_is_exact():
    weights = {("r1", "h1"): 10.0, ("r2", "h1"): 9.0, ("r1", "h2"): 9.0} | {(f"x{i}", f"y{i}"): 1.0 for i in range(7)}
    assert sum(weights.get((r, h), 0.0) for h, r in intervals.best_mapping(weights).items()) == 25.0
    assert intervals.best_mapping({}) == {} and intervals.best_mapping({("a", "x"): 1.0, ("b", "x"): 2.0}) == {"x": "b"}


def test_error_of_more_than_eight_speakers(spark):
    turns = [("u", float(i), float(i + 1), f"s{i % 12}") for i in range(60)]
    ref = spark.createDataFrame(turns, "utt string, begin double, end double, label string")
    hyp = ref.withColumn("label", F.concat(F.lit("other "), "label"))
    assert intervals.diarization_error(ref, hyp, collar=0.0).first()["der"] == pytest.approx(0.0)


# --- state with timers --------------------------------------------------------------------------


def run_stream(spark, tmp_path, df, name, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}_in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}_in"))
    q = df(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.lastProgress
    return spark.table(name).collect()


def test_speech_ends_with_its_timer_whatever_the_batches(spark, tmp_path):
    windows.use_timers(spark)
    rng = random.Random(8)
    schema = "utt string, frame long, p double, ts timestamp"
    level = {u: [min(1.0, max(0.0, x)) for x in itertools.accumulate((rng.uniform(-0.4, 0.4) for _ in range(120)), lambda a, b: min(1.0, max(0.0, a + b)), initial=0.5)] for u in "abc"}
    from datetime import datetime, timedelta, timezone

    at = lambda ms: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
    rows = {u: [(u, i, p, at(96 * i)) for i, p in enumerate(ps)] for u, ps in level.items()}
    cuts = [0, 1, 50, 121]
    parts = [sum((rows[u][a:b] for u in "abc"), []) for a, b in zip(cuts, cuts[1:])] + [[("z", 0, 0.0, at(10_000_000))]]
    got = run_stream(spark, tmp_path, lambda s: windows.speech_stream(s, idle_ms=5000), "timed", parts, schema)
    want = sorted((u, a, b) for u in "abc" for a, b in intervals.hysteresis(level[u]))
    assert len(want) > 5
    assert np.allclose([r[1:] for r in sorted(map(tuple, got))], [w[1:] for w in want]) and [r[0] for r in sorted(map(tuple, got))] == [w[0] for w in want]
    batch = spark.createDataFrame(sum(rows.values(), []), schema)
    assert np.allclose(sorted(tuple(r)[1:] for r in windows.speech_stream(batch).collect()), sorted(w[1:] for w in want))


def test_the_state_of_a_day_of_speech_is_six_numbers():
    p = windows._Stretches("utt", windows.Speech(), None)
    import pandas as pd

    state = p.start()
    for day in range(10):
        frames = pd.DataFrame({"frame": range(day * 90_000, (day + 1) * 90_000), "p": [0.9] * 90_000})
        state, made = p.take(state, frames)
        assert made == [] and len(state) == 6 and all(isinstance(x, (int, float)) for x in state)
    assert p.end(state) == [(0.0, 900_000 * 0.096)]


def test_chunks_end_with_their_timer(spark, tmp_path):
    windows.use_timers(spark)
    from datetime import datetime, timedelta, timezone

    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    parts = [[("u", i, [float(i)] * 3, at(i)) for i in part] for part in ((0, 1), (2, 3, 4))] + [[("z", 0, [1.0], at(1000))]]
    got = run_stream(spark, tmp_path, lambda s: windows.chunk_stream(s, 4, idle_ms=60_000), "chunked", parts, "utt string, at long, samples array<double>, ts timestamp")
    mine = sorted((r for r in got if r["utt"] == "u"), key=lambda r: r["chunk"])
    assert [x for r in mine for x in r["samples"]] == [float(i) for i in range(5) for _ in range(3)] + [0.0]
