"""Named queries on global order, closures, split sources, exact label mapping and state with timers. Importing this adds them to the catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import datadir, intervals, prefix
from ..scratch import pinned, shared_folder
from ..sources import binary, ranges
from ..streaming import windows
from .catalogue import E_SQL, NORM, V_SQL, _spans, _sql, _vectors, query, r, table

# --- global order -------------------------------------------------------------------------------


@query("SELECT doc_id AS utt, row_number() OVER (ORDER BY source, n_chars, doc_id) - 1 AS at FROM documents")
def global_positions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"), "n_chars")
    return prefix.numbered(d, "spk", "n_chars", "utt").select("utt", "at")


@query("SELECT o_orderkey, coalesce(sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders")
def running_totals(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("n"))
    return prefix.running_before(rows, "n", "o_orderdate", "o_orderkey").select("o_orderkey", "before")


@query("""WITH b AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM b)
SELECT run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS least FROM g GROUP BY run, event_type""")
def neighbour_runs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return prefix.islands(e, ["event_type"], "ts", "event_id").groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


# --- closure over utterances, speakers and recordings -------------------------------------------

#: Name, key columns, and rows of the tables of the closure.
CLOSURE = {
    "utt2spk": (("utt", "spk"), "SELECT o_orderkey AS utt, o_custkey AS spk FROM orders"),
    "segments": (("utt", "rec"), "SELECT l_orderkey AS utt, l_partkey AS rec FROM lineitem WHERE l_linenumber = 1"),
    "durations": (("utt",), "SELECT l_orderkey AS utt FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 20"),
    "speakers": (("spk",), "SELECT c_custkey AS spk FROM customer WHERE c_acctbal > -500"),
    "sessions": (("spk", "rec"), "SELECT DISTINCT o_custkey AS spk, l_partkey AS rec FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2"),
    "recordings": (("rec",), "SELECT p_partkey AS rec FROM part WHERE p_size > 3"),
}


def _closure_sql(rounds: int = 9) -> str:
    """The rounds of the fixpoint written out; a round more changes nothing on the tables this is compared on."""
    steps = [f"{name}_0 AS MATERIALIZED ({sql})" for name, (_, sql) in CLOSURE.items()]
    now = dict.fromkeys(CLOSURE, 0)
    for _ in range(rounds):
        for key in ("utt", "spk", "rec"):
            holders = [n for n, (keys, _) in CLOSURE.items() if key in keys]
            before = dict(now)
            for name in holders:
                now[name] += 1
                tests = " AND ".join(f"{key} IN (SELECT {key} FROM {other}_{before[other]})" for other in holders if other != name)
                steps.append(f"{name}_{now[name]} AS MATERIALIZED (SELECT * FROM {name}_{before[name]} WHERE {tests})")
    parts = " UNION ALL ".join(f"SELECT '{n}' AS name, {', '.join(k + '::BIGINT AS ' + k if k in keys else '-1::BIGINT AS ' + k for k in ('utt', 'spk', 'rec'))} FROM {n}_{now[n]}" for n, (keys, _) in CLOSURE.items())
    return f"WITH {', '.join(steps)} {parts}"


def _closure_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    lineitem, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    utt, rec, spk = F.col("l_orderkey").alias("utt"), F.col("l_partkey").alias("rec"), F.col("o_custkey").alias("spk")
    first_two = lineitem.where("l_linenumber <= 2").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "utt2spk": orders.select(F.col("o_orderkey").alias("utt"), spk), "segments": lineitem.where("l_linenumber = 1").select(utt, rec),
        "durations": lineitem.groupBy(utt).agg(F.sum("l_quantity").alias("q")).where("q > 20").select("utt"), "speakers": table(spark, sf, "customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("spk")),
        "sessions": first_two.select(spk, rec).distinct(), "recordings": table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("rec")),
    }


@query(_closure_sql())
def fix_data_dir_closure(spark, sf):
    """All rows that stay, by table; -1 stands for a level that a table lacks."""
    fixed = datadir.closed(_closure_tables(spark, sf))
    one = lambda name, t: t.select(F.lit(name).alias("name"), *(F.col(k).cast("long") if k in t.columns else F.lit(-1).cast("long").alias(k) for k in ("utt", "spk", "rec")))
    parts = [one(name, t) for name, t in fixed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- split sources ------------------------------------------------------------------------------


def _archives(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The vectors as archives in the shared folder, and their index."""
    folder = shared_folder(spark)
    return folder, pinned(ranges.write_archives(_vectors(spark, sf).select("utt", "emb").repartition(4, "utt"), folder))


@query(f"WITH {E_SQL} SELECT utt, unnest(range(0, len(emb)))::INT AS pos, round(unnest(list_transform(emb, lambda x: x::FLOAT::DOUBLE)), 6) AS x FROM e")
def archive_scan(spark, sf):
    """Vectors written as archives and read back by their headers, in small ranges."""
    folder, _ = _archives(spark, sf)
    back = ranges.read_archives(spark, folder, ending=".ark", split=1 << 20)
    return back.select(F.col("utt").cast("long").alias("utt"), F.posexplode("emb").alias("pos", "x")).withColumn("x", r("x", 6))


@query(f"WITH {E_SQL} SELECT utt, round({NORM.format('emb')}, 5) AS magnitude FROM e WHERE utt IN (SELECT doc_id FROM labels)")
def archive_by_keys(spark, sf):
    """Only the records of listed keys, by the lines of an index."""
    _, index = _archives(spark, sf)
    lines = index.select("key", F.concat_ws(":", "path", F.col("offset").cast("string")).alias("value"))
    wanted = datadir.filter_ids(ranges.index_entries(lines), table(spark, sf, "labels").select(F.col("doc_id").cast("string")), "key")
    return ranges.read_records(wanted).select(F.col("utt").cast("long").alias("utt"), r(vec.norm(F.col("emb"))).alias("magnitude"))


def _write_files(df: DataFrame, folder: str) -> int:
    """Writes rows ``(name, content)`` as files; a row that is written again gives the same file."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inside = ranges._filesystem(f"{folder}/{name}")
                system.create_dir(inside.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inside) as sink:
                    sink.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return df.select("name", "content").mapInArrow(run, "name string").count()


@query("SELECT doc_id::VARCHAR AS key, source AS spk, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS digest FROM documents")
def shard_scan(spark, sf):
    """Documents packed into tar shards, written, and read back in groups, by byte ranges."""
    folder = shared_folder(spark)
    text, spk = F.coalesce("text", F.lit("")).cast("binary"), F.col("source").cast("binary")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.create_map(F.lit("txt"), text, F.lit("spk"), spk).alias("members"))
    shards = binary.pack_shards(rows, 250).select(F.format_string("shard-%06d.tar", "shard").alias("name"), "content")
    _write_files(shards, folder)
    found = ranges.read_shards(spark, folder, ["txt", "spk"], split=1 << 20)
    return found.select("key", F.col("members")["spk"].cast("string").alias("spk"), F.length(F.col("members")["txt"]).cast("long").alias("n_bytes"), F.sha2(F.col("members")["txt"], 256).alias("digest"))


# --- exact label mapping ------------------------------------------------------------------------

#: Turns, then spans between boundaries outside the collar, then all one-to-one mappings of the labels of a recording by recursion.
DER_SQL = f"""WITH RECURSIVE {V_SQL}, n AS (SELECT *, lag(e) OVER o AS pe, lag(label) OVER o AS pl, lead(b) OVER o AS nb, lead(label) OVER o AS nl FROM v WINDOW o AS (PARTITION BY utt ORDER BY b, e, label, event_id)),
m AS (SELECT *, CASE WHEN pe IS NULL OR b > pe OR label <> pl THEN 1 ELSE 0 END AS f, CASE WHEN pe IS NULL OR b > pe THEN b ELSE (b + pe) / 2 END AS tb, CASE WHEN nb <= e AND nl <> label THEN (nb + e) / 2 ELSE e END AS te FROM n),
g AS (SELECT *, sum(f) OVER (PARTITION BY utt ORDER BY b, e, label, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m),
ref AS MATERIALIZED (SELECT utt, min(label) AS label, arg_min(tb, (b, e, event_id)) AS b, arg_max(te, (b, e, event_id)) AS e FROM g GROUP BY utt, g),
hyp AS MATERIALIZED (SELECT utt, upper(label) AS label, b + 5 AS b, e + 5 AS e FROM ref),
edge AS MATERIALIZED (SELECT DISTINCT utt, x FROM (SELECT utt, unnest([b, e]) AS x FROM ref)),
mark AS (SELECT DISTINCT utt, t FROM (SELECT utt, unnest([x, x - 0.25::DOUBLE, x + 0.25::DOUBLE]) AS t FROM edge UNION ALL SELECT utt, unnest([b, e]) FROM hyp)),
span AS MATERIALIZED (SELECT * FROM (SELECT utt, t, lead(t) OVER (PARTITION BY utt ORDER BY t) AS u FROM mark) s WHERE u IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge q WHERE q.utt = s.utt AND x - 0.25::DOUBLE <= t AND u <= x + 0.25::DOUBLE)),
rl AS MATERIALIZED (SELECT DISTINCT s.utt, t, u, label AS r FROM span s JOIN ref ON ref.utt = s.utt AND b <= t AND u <= e),
hl AS MATERIALIZED (SELECT DISTINCT s.utt, t, u, label AS h FROM span s JOIN hyp ON hyp.utt = s.utt AND b <= t AND u <= e),
size AS (SELECT s.utt, u - t AS d, coalesce(a.n, 0) AS nr, coalesce(c.n, 0) AS nh FROM span s LEFT JOIN (SELECT utt, t, count(*) AS n FROM rl GROUP BY utt, t) a USING (utt, t) LEFT JOIN (SELECT utt, t, count(*) AS n FROM hl GROUP BY utt, t) c USING (utt, t)),
tot AS (SELECT utt, sum(d * nr) AS scored, sum(d * greatest(nr - nh, 0)) AS miss, sum(d * greatest(nh - nr, 0)) AS alarm, sum(d * least(nr, nh)) AS shared FROM size GROUP BY utt),
w AS (SELECT utt, r, h, sum(u - t) AS w FROM rl JOIN hl USING (utt, t, u) GROUP BY utt, r, h),
ri AS (SELECT utt, r, row_number() OVER (PARTITION BY utt ORDER BY r) AS i FROM (SELECT DISTINCT utt, r FROM w)),
hi AS (SELECT utt, h, row_number() OVER (PARTITION BY utt ORDER BY h) - 1 AS j FROM (SELECT DISTINCT utt, h FROM w)),
gain AS MATERIALIZED (SELECT utt, i, j, coalesce(w, 0) AS w FROM ri JOIN hi USING (utt) LEFT JOIN w USING (utt, r, h)),
walk AS (SELECT utt, 0::BIGINT AS i, 0::BIGINT AS used, 0::DOUBLE AS total FROM (SELECT DISTINCT utt FROM w)
  UNION ALL SELECT utt, walk.i + 1, CASE WHEN k.skip THEN used ELSE used | (1::BIGINT << j) END, total + CASE WHEN k.skip THEN 0 ELSE w END
  FROM walk JOIN gain USING (utt), (SELECT unnest([true, false]) AS skip) k WHERE gain.i = walk.i + 1 AND (CASE WHEN k.skip THEN j = 0 ELSE used & (1::BIGINT << j) = 0 END)),
best AS (SELECT utt, max(total) AS ok FROM walk GROUP BY utt)
SELECT utt, round(scored, 3) AS scored, round(miss, 3) AS miss, round(alarm, 3) AS false_alarm, round(greatest(shared - coalesce(ok, 0), 0), 3) AS confusion,
  round(CASE WHEN scored > 0 THEN (miss + alarm + greatest(shared - coalesce(ok, 0), 0)) / scored ELSE 0 END, 6) AS der FROM tot LEFT JOIN best USING (utt)"""


@query(DER_SQL)
def diarization_error_exact(spark, sf):
    first = intervals.merge_turns(_spans(spark, sf), order=("event_id",)).select("utt", F.col("turn_begin").alias("begin"), F.col("turn_end").alias("end"), "label")
    shifted = first.select("utt", (F.col("begin") + 5).alias("begin"), (F.col("end") + 5).alias("end"), F.upper("label").alias("label"))
    der = intervals.diarization_error(first, shifted, slot=3600.0)
    return der.select("utt", *(r(c, 3).alias(c) for c in ("scored", "miss", "false_alarm", "confusion")), r("der", 6).alias("der"))


# --- state with timers --------------------------------------------------------------------------


@query(_sql["vad_hysteresis"])
def speech_with_timers(spark, sf):
    """Frames as a stream in which no row is marked last: each key ends with its timer, once a row of another key has moved the watermark."""
    windows.use_timers(spark)
    e = table(spark, sf, "events").select(F.col("user_id").alias("utt"), "event_id", (F.col("value") / 100).alias("p"))
    place = F.row_number().over(prefix.Window.partitionBy("utt").orderBy("event_id")) - 1
    frames = e.withColumn("frame", place.cast("long")).withColumn("ts", F.timestamp_millis(1_700_000_000_000 + F.col("frame") * 96)).select("utt", "frame", "p", "ts")
    later = spark.range(1).select(F.lit(-1).cast("long").alias("utt"), F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("p"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"))
    source, spans, progress = (shared_folder(spark) for _ in range(3))
    frames.unionByName(later).write.parquet(source)
    stream = spark.readStream.schema(frames.schema).parquet(source)
    run = windows.speech_stream(stream, idle_ms=1000, threshold=0.36).writeStream.format("parquet").option("path", spans).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema("utt long, begin double, end double").parquet(spans)
    return found.withColumns({"begin": r("begin"), "end": r("end")})
