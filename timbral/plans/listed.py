"""Named queries on lists that name waves and features, archives of sub-segments, tables with a header, calibration factors. Importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import datadir, frames, scoring
from ..scratch import shared_folder
from ..sources import lists, ranges, text_tables
from .catalogue import CENTROIDS_SQL, E_SQL, LONG_SQL, NORM, _vectors, query, r, table

RATE = 16000
VAD = [["0.1", "0.5"], ["0.9", "1.2"]]


@query("""WITH x AS (SELECT vec_id // 400 AS rec, (vec_id % 400) * 64 + unnest(range(0, len(embedding))) AS spot, trunc(unnest(embedding)::DOUBLE * 10000)::BIGINT AS x FROM embeddings),
k AS (SELECT rec, x, row_number() OVER (PARTITION BY rec ORDER BY spot) - 1 AS pos FROM x WHERE (spot >= 1600 AND spot < 8000) OR (spot >= 14400 AND spot < 19200))
SELECT rec, count(*) AS n, sum(x)::BIGINT AS total, sum(x * pos)::BIGINT AS weighted FROM k GROUP BY rec""")
def raw_list_scan(spark, sf):
    """Waves of 400 vectors each, written to files and a list, read back and cut by spans of speech."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 400).alias("rec"), "vec_id", vec.times(F.col("embedding"), 10000.0).alias("x"))
    waves = rows.groupBy("rec").agg(F.flatten(F.array_sort(F.collect_list(F.struct("vec_id", "x")))["x"]).alias("samples"))
    spans = F.array(*(F.array(*map(F.lit, s)) for s in VAD))
    written = lists.write_waves(waves, f"{folder}/waves", RATE, "rec").select(F.col("utt").alias("key"), F.lit("-").alias("spk"), F.col("path").alias("wav"), spans.alias("vad"))
    text_tables.write_json_list(written, f"{folder}/list")
    back = lists.with_waves(lists.read_list_lines(spark, f"{folder}/list", on_bad="drop"))
    long = back.select(F.col("key").cast("long").alias("rec"), F.posexplode("samples").alias("pos", "x")).withColumn("x", F.col("x").cast("long"))
    return long.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("pos")).alias("weighted"))


@query(f"WITH {E_SQL} SELECT utt, spk, unnest(range(0, 64))::INT AS pos, round(unnest(list_transform(emb, lambda x: x::FLOAT::DOUBLE)), 6) AS x FROM e")
def feature_list_scan(spark, sf):
    """Matrices of eight frames, written to archives and a list of places, read back by the list."""
    folder = shared_folder(spark)
    v = _vectors(spark, sf).select("utt", "spk", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("emb", t * 8 + 1, 8)).alias("feat"))
    index = ranges.write_archives(v, f"{folder}/feats", "feat").select(F.col("key").cast("long").alias("utt"), F.concat_ws(":", "path", F.col("offset").cast("string")).alias("feat"))
    text_tables.write_json_list(index.join(v.select("utt", "spk"), "utt").select(F.col("utt").cast("string").alias("key"), F.col("spk").cast("string").alias("spk"), "feat"), f"{folder}/list")
    back = lists.with_features(lists.read_list_lines(spark, f"{folder}/list"))
    return back.select(F.col("key").cast("long").alias("utt"), F.col("spk").cast("long").alias("spk"), F.posexplode(F.flatten("feat")).alias("pos", "x")).withColumn("x", r("x", 6))


@query("""SELECT 'rec-' || vec_id // 100 AS rec, (vec_id % 100)::INT AS place, round((vec_id % 100) * 0.75::DOUBLE, 3) AS begin, round((vec_id % 100) * 0.75::DOUBLE + 1.5::DOUBLE, 3) AS end,
round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS magnitude FROM embeddings""")
def piece_vectors_scan(spark, sf):
    """Vectors of sub-segments, written to archives in the order of their recordings; their order in the archive comes back."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("rec-"), F.floor(F.col("vec_id") / 100).cast("string"), F.lit("-00000000-00100000")).alias("seg"), (F.col("vec_id") % 100 * 75).alias("begin"), "vec_id", F.col("embedding").alias("emb"))
    named = rows.withColumn("end", F.col("begin") + 150).select(frames.piece_id().alias("utt"), "vec_id", "emb").repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("utt", "emb")
    ranges.write_archives(named, folder).count()
    back = lists.read_pieces(spark, folder, ".ark")
    # a recording may be cut between two archives: what stands first in the order of places need not come first in time
    order = F.array_sort(F.collect_list(F.struct("path", "offset", "begin", "end", "emb")))
    runs = back.groupBy("rec", "path").agg(order.alias("rows"))
    placed = runs.select("rec", F.posexplode("rows").alias("at", "row")).select("rec", "at", "row.*")
    first = placed.where("at = 0").select("rec", "path", F.round(F.col("begin") / 0.75).cast("int").alias("first"))
    out = placed.join(first, ["rec", "path"]).withColumn("place", (F.col("first") + F.col("at")).cast("int"))
    return out.select("rec", "place", r("begin", 3).alias("begin"), r("end", 3).alias("end"), r(vec.norm(F.col("emb")), 4).alias("magnitude"))


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def header_table_scan(spark, sf):
    """A table with a header line, written and read back under a condition."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(folder)
    return lists.read_tsv(spark, folder, F.col("segment") != "BUILDING")


@query(f"""WITH {E_SQL}, {LONG_SQL}, {CENTROIDS_SQL}, st AS (SELECT utt, avg(s) AS mean, stddev_pop(s) AS std FROM cs GROUP BY utt),
d AS (SELECT utt, emb, mean, std, {NORM.format('emb')} AS mag, least(n_chars / 1000.0::DOUBLE, 2.0::DOUBLE) AS dur FROM e JOIN st USING (utt) JOIN documents ON doc_id = utt),
t AS (SELECT a.utt AS enroll, b.utt AS test, 0.5::DOUBLE * ((s - a.mean) / a.std + (s - b.mean) / b.std) AS norm_score, a.mag AS m1, b.mag AS m2, a.mean AS c1, b.mean AS c2, a.dur AS d1, b.dur AS d2
 FROM d a JOIN d b ON b.utt = a.utt + 1, LATERAL (SELECT list_dot_product(a.emb, b.emb) / (a.mag * b.mag) AS s))
SELECT enroll, test, round(norm_score, 4) AS norm_score, {', '.join(f'round(least({x}1, {x}2), 5) AS {n}_min, round(greatest({x}1, {x}2), 5) AS {n}_max, round(abs({x}1 - {x}2), 5) AS {n}_diff' for x, n in (('d', 'dur'), ('m', 'mag'), ('c', 'mean')))},
round(greatest(d1, d2) / least(d1, d2), 4) AS dur_ratio, round(greatest(m1, m2) / least(m1, m2), 4) AS mag_ratio FROM t""")
def calibration_factors(spark, sf):
    """Normalised scores of neighbours by id, with the factors of quality that calibration takes (ratios of cohort means, which may be near 0, are left out)."""
    v = _vectors(spark, sf).select("utt", "emb")
    cohort = scoring.mean_vector(_vectors(spark, sf), "emb", "spk").select(F.col("spk").alias("name"), F.col("mean").alias("emb"))
    trials = v.select(F.col("utt").alias("enroll"), (F.col("utt") + 1).alias("test")).join(v.select(F.col("utt").alias("test")), "test", "left_semi")
    scored = scoring.with_magnitudes(scoring.normalised(scoring.cosine_scores(trials, v), scoring.cohort_stats(v, cohort, None)), v)
    durations = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), (F.col("n_chars") / 1000.0).alias("dur"))
    out = scoring.calibration_factors(scored, durations)
    names = [f"{n}_{f}" for n in ("dur", "mag", "mean") for f in ("min", "max", "diff")]
    return out.select("enroll", "test", r("norm_score", 4).alias("norm_score"), *(r(n).alias(n) for n in names), r("dur_ratio", 4).alias("dur_ratio"), r("mag_ratio", 4).alias("mag_ratio"))


@query(f"""WITH {E_SQL}, b AS (SELECT utt, list_transform(emb, lambda x: x * least((1 - 1e-5::DOUBLE) / sqrt(4.0::DOUBLE) / greatest({NORM.format('emb')}, 1e-5::DOUBLE), 1)) AS v FROM e)
SELECT utt, round({NORM.format('v')}, 6) AS magnitude, round(v[1], 6) AS first FROM b""")
def ball_projection(spark, sf):
    return _vectors(spark, sf).select("utt", vec.to_ball(F.col("emb"), 4.0).alias("v")).select("utt", r(vec.norm(F.col("v")), 6).alias("magnitude"), r(F.col("v")[0], 6).alias("first"))


@query("""WITH u AS (SELECT o_orderkey AS utt, o_custkey AS spk FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2))
SELECT 'utt2spk' AS name, utt, spk FROM u UNION ALL SELECT 'segments', l_orderkey, -1 FROM lineitem WHERE l_linenumber = 2 AND l_orderkey IN (SELECT utt FROM u)""")
def cut_to_speakers(spark, sf):
    """A data directory cut to a list of speakers; -1 stands for a level that a table lacks."""
    utts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("utt"), F.col("o_custkey").alias("spk"))
    segments = table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("utt"), F.col("l_partkey").alias("rec"))
    keep = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("spk"))
    out = datadir.cut_to({"utt2spk": utts, "segments": segments}, keep)
    one = out["utt2spk"].select(F.lit("utt2spk").alias("name"), F.col("utt").cast("long").alias("utt"), F.col("spk").cast("long").alias("spk"))
    return one.unionByName(out["segments"].select(F.lit("segments").alias("name"), F.col("utt").cast("long").alias("utt"), F.lit(-1).cast("long").alias("spk")))
