"""Named queries that send tables through readers and writers, and waves and matrices through the signal operators. Importing this adds them to the catalogue."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import datadir, intervals, scoring, signal
from ..operators.prefix import numbered
from ..scratch import pinned, shared_folder
from ..sources import binary, lists, text_tables
from .catalogue import E_SQL, _vectors, query, r, table

X_SQL = f"{E_SQL}, x AS (SELECT utt, unnest(range(0, len(emb))) AS j, unnest(emb) AS x FROM e)"


def _turns(spark, sf):
    begin = (F.col("event_id") % 86400).cast("double")
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("utt"), begin.alias("begin"), (begin + F.floor("value")).alias("end"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"))


# --- text files: written from a table, read back --------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS key, c_name || ' ' || c_mktsegment AS value FROM customer")
def scp_scan(spark, sf):
    folder = shared_folder(spark)
    c = table(spark, sf, "customer")
    text_tables.write_lines(c, folder, F.col("c_custkey").cast("string"), F.lit(""), "c_name", F.lit("\t"), "c_mktsegment", F.lit(""))
    return text_tables.read_scp(spark, folder)


@query("SELECT c_name AS name FROM customer")
def list_scan(spark, sf):
    folder = shared_folder(spark)
    text_tables.write_lines(table(spark, sf, "customer"), folder, F.lit(""), "c_name", F.lit(""))
    return text_tables.read_list(spark, folder, "name")


@query("SELECT o_orderkey::BIGINT AS utt, round(o_totalprice::DOUBLE, 5) AS price, o_orderstatus AS status FROM orders")
def table_scan(spark, sf):
    folder = shared_folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    text_tables.write_lines(o, folder, "o_orderkey", "price", "o_orderstatus", separator="\t")
    return text_tables.read_table(spark, folder, "utt long, price double, status string").withColumn("price", r("price"))


@query("SELECT o_custkey::VARCHAR AS spk, count(*) AS n, min(o_orderkey)::VARCHAR AS first FROM orders GROUP BY o_custkey")
def member_map_scan(spark, sf):
    folder = shared_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("spk"), F.col("o_orderkey").alias("utt"))
    text_tables.write_lines(datadir.invert(o, "utt", "spk", "utt", "utts"), folder, "spk", F.array_join(F.transform("utts", lambda x: x.cast("string")), " "))
    back = text_tables.read_map(spark, folder)
    return back.select(F.col("key").alias("spk"), F.size("members").cast("long").alias("n"), F.col("members")[0].alias("first"))


@query("SELECT event_id, user_id::VARCHAR AS utt, 1::INT AS channel, (event_id % 86400)::DOUBLE AS begin, (event_id % 86400 + floor(value))::DOUBLE AS end FROM events")
def rttm_scan(spark, sf):
    folder = shared_folder(spark)
    text_tables.write_lines(_turns(spark, sf), folder, intervals.rttm_line())
    back = text_tables.read_rttm(spark, folder)
    return back.select(F.expr("substring(label, 2)").cast("long").alias("event_id"), "utt", "channel", r("begin", 3).alias("begin"), r("end", 3).alias("end"))


@query("SELECT event_id, printf('%s-%08d-%08d', user_id::VARCHAR, (event_id % 86400) * 1000, ((event_id % 86400) + floor(value)::BIGINT) * 1000) AS seg, (event_id % 86400)::DOUBLE AS begin FROM events")
def segments_scan(spark, sf):
    """Segments of turns; the number of the turn travels in the id of its utterance."""
    folder = shared_folder(spark)
    turns = _turns(spark, sf).withColumn("seg", intervals.segment_id(F.col("utt"), F.col("begin"), F.col("end")))
    text_tables.write_lines(turns, folder, "seg", F.concat_ws("-", "utt", "label"), "begin", "end")
    back = text_tables.read_segments(spark, folder)
    return back.select(F.regexp_extract("utt", "e([0-9]+)$", 1).cast("long").alias("event_id"), "seg", "begin")


@query(f"WITH {E_SQL} SELECT len(emb)::BIGINT AS n, round(emb[1], 5) AS first, round(emb[64], 5) AS last FROM e")
def vector_text_scan(spark, sf):
    folder = shared_folder(spark)
    text_tables.write_lines(_vectors(spark, sf), folder, F.array_join(F.transform("emb", lambda x: x.cast("string")), " "))
    emb = F.col("emb")
    return text_tables.read_vectors(spark, folder).select(F.size(emb).cast("long").alias("n"), r(emb[0]).alias("first"), r(F.element_at(emb, -1)).alias("last"))


@query("SELECT 'part=' || o_custkey % 20 AS folder, sum(len(o_orderkey::VARCHAR) + 1)::BIGINT AS n_bytes FROM orders GROUP BY 1")
def directory_scan(spark, sf):
    """Folders of files with an id a line: their names and sizes, without a look at the contents."""
    folder = shared_folder(spark)
    ids = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("part"), F.col("o_orderkey").cast("string").alias("value"))
    ids.repartition("part").write.partitionBy("part").text(folder)
    return text_tables.scan_directory(spark, folder, "*.txt", depth=2).groupBy(F.substring_index("key", "/", 1).alias("folder")).agg(F.sum("length").alias("n_bytes"))


@query("SELECT vec_id // 400 AS rec, round(sum(len(embedding)) / 16000.0::DOUBLE, 6) AS duration FROM embeddings GROUP BY 1")
def wave_durations(spark, sf):
    """Waves of 400 vectors each, written to files, found in their folder and decoded."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 400).alias("rec"), "vec_id", vec.times(F.col("embedding"), 10000.0).alias("x"))
    waves = rows.groupBy("rec").agg(F.flatten(F.array_sort(F.collect_list(F.struct("vec_id", "x")))["x"]).alias("samples"))
    index = pinned(lists.write_waves(waves, folder, 16000, "rec").select(F.col("utt").cast("long").alias("rec"), F.substring_index("path", "/", -1).alias("name")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "content")
    return binary.decode_waves(files.join(index, "name").select("rec", "content")).select("rec", r("duration", 6).alias("duration"))


# --- order, choice, shares ------------------------------------------------------------------------


@query("SELECT doc_id AS utt, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|3'), doc_id) - 1 AS at FROM documents")
def shuffled_epoch(spark, sf):
    rows = datadir.shuffled(table(spark, sf, "documents").select(F.col("doc_id").alias("utt")), "utt", "3").withColumn("place", F.monotonically_increasing_id())
    return numbered(rows, "place", out="at").select("utt", F.col("at").cast("long").alias("at"))


@query("SELECT doc_id AS utt, 1::BIGINT AS n FROM documents")
def shares_of_workers(spark, sf):
    """How many of five workers hold each row."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"))
    shares = [datadir.share_of(d, "utt", rank, 5, "1") for rank in range(5)]
    return datadir.combine([{"utts": s} for s in shares])["utts"].groupBy("utt").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS utt, true AS own FROM documents")
def random_blobs(spark, sf):
    """A blob for each document, of the store of pages; own: it is the blob of the key that it came with."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.col("html").cast("binary").alias("data"))
    picked = binary.pick_random(pages, table(spark, sf, "documents").select(F.col("doc_id").alias("utt")), "utt", "noise")
    truth = table(spark, sf, "pages").select(F.col("page_id").alias("blob_key"), F.md5(F.coalesce("html", F.lit(""))).alias("want"))
    return picked.join(truth, "blob_key").select("utt", (F.md5(F.coalesce("data", F.lit(b""))) == F.col("want")).alias("own"))


@query("SELECT doc_id AS utt, least(n, 200)::BIGINT AS n FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL) WHERE n >= 20")
def length_bounds(spark, sf):
    """Rows of 20 words or more, those above 200 cut to a chunk of 200."""
    words = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("utt"), F.split("text", " ").alias("samples"))
    return signal.length_between(words, 20, 200).select("utt", F.size("samples").cast("long").alias("n"))


@query("SELECT vec_id AS utt, 6::BIGINT AS n_local, 2::BIGINT AS n_wide, 8::BIGINT AS n_whole FROM embeddings")
def crops(spark, sf):
    """Six short and two wide chunks of each vector; n_whole counts those that are runs of its own values."""
    made = signal.multi_crop(F.col("emb"), F.col("utt"), 6, 16, 2, 40)
    rows = _vectors(spark, sf).withColumn("c", made)
    chunks = F.concat("c.local_chunks", "c.global_chunks")
    spots = F.sequence(F.lit(1), F.size("emb"))
    is_run = lambda c: F.exists(spots, lambda s: F.slice("emb", s, F.size(c)) == c)
    return rows.select("utt", F.size("c.local_chunks").cast("long").alias("n_local"), F.size("c.global_chunks").cast("long").alias("n_wide"), F.size(F.filter(chunks, is_run)).cast("long").alias("n_whole"))


# --- waves and matrices ---------------------------------------------------------------------------


@query(f"""WITH {X_SQL}, k AS (SELECT m, j, (1 + 2 * sum(cos(2 * pi() * f * (m / 32.0::DOUBLE - j / 64.0::DOUBLE))) + cos(pi() * j / 2) * cos(pi() * m)) / 64 AS h
FROM range(0, 32) a(m), range(0, 64) b(j), range(1, 16) c(f) GROUP BY m, j)
SELECT utt, m::INT AS pos, round(sum(x * h), 5) AS x FROM x JOIN k USING (j) GROUP BY utt, m""")
def resampled(spark, sf):
    """Vectors as signals at 8,000 samples a second, brought to 4,000."""
    rows = _vectors(spark, sf).select("utt", F.col("emb").alias("samples"), F.lit(8000).alias("sample_rate"))
    return signal.at_rate(rows, 4000).select("utt", F.posexplode("samples").alias("pos", "x")).withColumn("x", r("x"))


IMPULSE = [1.0, 0.5, -0.25]


@query(f"""WITH {X_SQL}, h AS (SELECT unnest(range(0, 3)) AS i, unnest([1.0::DOUBLE, 0.5, -0.25]) / sqrt(1.3125::DOUBLE) AS h)
SELECT utt, (j + i)::INT AS pos, round(sum(x * h), 5) AS x FROM x, h WHERE j + i < 64 GROUP BY utt, j + i""")
def reverberated(spark, sf):
    rows = _vectors(spark, sf).select("utt", F.col("emb").alias("samples"))
    return signal.map_samples(rows, lambda x: signal.reverberated(x, np.array(IMPULSE))).select("utt", F.posexplode("samples").alias("pos", "x")).withColumn("x", r("x"))


MEL = "1127 * ln(1 + ({0}) / 700.0::DOUBLE)"


@query(f"""WITH {X_SQL}, f AS (SELECT utt, t, j - 10 * t AS i, 1000 * x - avg(1000 * x) OVER (PARTITION BY utt, t) AS x FROM x, range(0, 4) a(t) WHERE j >= 10 * t AND j < 10 * t + 25),
p AS (SELECT utt, t, i, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY utt, t ORDER BY i), x)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 24)) AS x FROM f),
s AS (SELECT utt, t, k, sum(x * cos(2 * pi() * k * i / 32)) ** 2 + sum(x * sin(2 * pi() * k * i / 32)) ** 2 AS power FROM p, range(0, 16) a(k) GROUP BY utt, t, k),
g AS (SELECT b, {MEL.format('20')} + b * ({MEL.format('500')} - {MEL.format('20')}) / 7 AS l, ({MEL.format('500')} - {MEL.format('20')}) / 7 AS w FROM range(0, 6) a(b)),
m AS (SELECT b, k, greatest(0, least(({MEL.format('k * 1000 / 32.0::DOUBLE')} - l) / w, (l + 2 * w - {MEL.format('k * 1000 / 32.0::DOUBLE')}) / w)) AS weight FROM g, range(0, 16) a(k))
SELECT utt, t::INT AS frame, b::INT AS bin, round(ln(greatest(sum(power * weight), {float(np.finfo(np.float32).eps)!r}::DOUBLE)), 4) AS energy FROM s JOIN m USING (k) GROUP BY utt, t, b""")
def mel_energies(spark, sf):
    """Log mel energies of vectors as signals at 1,000 samples a second: four frames of 25 samples, six bins."""
    waves = _vectors(spark, sf).select("utt", vec.times(F.col("emb"), 1000.0).alias("samples"))
    frames = signal.fbank_features(waves, rate=1000, bins=6).select("utt", F.posexplode("feat").alias("frame", "bins"))
    return frames.select("utt", "frame", F.posexplode("bins").alias("bin", "energy")).withColumn("energy", r("energy", 4))


@query(f"WITH {E_SQL} SELECT utt, (48::BIGINT) AS n, round(list_sum(list_concat(emb[5:20], emb[33:64])), 5) AS total, round(emb[33], 5) AS seam FROM e")
def speech_only(spark, sf):
    """The samples of two spans of speech of each vector, a signal at 16 samples a second."""
    span = lambda b, e: F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end"))
    cut = _vectors(spark, sf).select("utt", signal.voiced(F.col("emb"), F.array(span(0.25, 1.25), span(2.0, 4.0)), 16).alias("v"))
    return cut.select("utt", F.size("v").cast("long").alias("n"), r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"), r(F.col("v")[16]).alias("seam"))


@query(f"""WITH {E_SQL}, c AS (SELECT utt, emb, k, f FROM e, range(0, 3) a(k), range(0, 3) b(f))
SELECT utt, k::INT AS chunk, f::INT AS frame, round(list_sum(emb[8 * ((3 * k + f) % 8) + 1 : 8 * ((3 * k + f) % 8) + 8]), 5) AS total FROM c""")
def filled_chunks(spark, sf):
    """Matrices of eight frames in chunks of three; the last is filled up from the beginning."""
    feat = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("emb", t * 8 + 1, 8))
    rows = _vectors(spark, sf).select("utt", feat.alias("feat")).select("utt", F.posexplode(signal.feature_chunks(F.col("feat"), 3)).alias("chunk", "c"))
    return rows.select("utt", "chunk", F.posexplode("c").alias("frame", "v")).select("utt", "chunk", "frame", r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {E_SQL} SELECT a.utt, 128::BIGINT AS n, round(a.emb[64], 5) AS before, round(b.emb[1], 5) AS after FROM e a JOIN e b ON b.utt = a.utt + 1""")
def joined_waves(spark, sf):
    """Each vector and the next one by id as parts of one signal."""
    v = _vectors(spark, sf).select("utt", F.col("emb").alias("samples"))
    pieces = v.join(v.select((F.col("utt") - 1).alias("utt")), "utt").select("utt", F.array("utt", F.col("utt") + 1).alias("parts"))
    out = intervals.concatenated(pieces, v)
    return out.select("utt", F.size("samples").cast("long").alias("n"), r(F.col("samples")[63]).alias("before"), r(F.col("samples")[64]).alias("after"))


def mean_and_peak():
    """A function of a matrix, as a model would be: the mean of each bin, and the largest value."""
    return lambda x: np.append(x.mean(0), x.max())


@query(f"WITH {X_SQL} SELECT utt, (j % 8)::INT AS pos, round(avg(x), 5) AS x FROM x GROUP BY utt, j % 8 UNION ALL SELECT utt, 8, round(max(x), 5) FROM x GROUP BY utt")
def extracted_vectors(spark, sf):
    """Batches of matrices through a function that each worker makes once."""
    feat = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("emb", t * 8 + 1, 8))
    out = signal.embed(_vectors(spark, sf).select("utt", feat.alias("feat")), mean_and_peak)
    return out.select("utt", F.posexplode("emb").alias("pos", "x")).withColumn("x", r("x"))


# --- calibration and scales -----------------------------------------------------------------------


@query("SELECT 0.0::DOUBLE AS by_bias, 0.0::DOUBLE AS by_quantity, 0.0::DOUBLE AS by_discount, true AS better FROM (SELECT count(*) FROM lineitem)")
def trained_calibration(spark, sf):
    """The derivatives of the class-balanced loss at the trained weights, taken from the whole table, which are 0 at its minimum; better: it is below the loss without features."""
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity").cast("double") / 50).alias("a"), (F.col("l_discount").cast("double") * 10).alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("target"))
    weights, bias = scoring.train_calibration(rows, ["a", "b"])
    scored = scoring.linear_calibration(rows, weights, bias, "s").withColumn("p", 1 / (1 + F.exp(-F.col("s"))))
    per_class = lambda e: (F.avg(F.when(F.col("target") == 1, e)) + F.avg(F.when(F.col("target") == 0, e))) / 2
    gap = F.col("p") - F.col("target")
    loss = per_class(F.log1p(F.exp(F.when(F.col("target") == 1, -F.col("s")).otherwise(F.col("s")))))
    return scored.agg(r(per_class(gap), 4).alias("by_bias"), r(per_class(gap * F.col("a")), 4).alias("by_quantity"), r(per_class(gap * F.col("b")), 4).alias("by_discount"), (loss <= math.log(2) + 1e-9).alias("better"))


@query("SELECT l_orderkey, l_linenumber, round(1127 * ln(1 + l_quantity::DOUBLE * 100 / 700), 5) AS natural, round(2595 * log10(1 + l_quantity::DOUBLE * 100 / 700), 5) AS decimal, round(l_quantity::DOUBLE * 100, 5) AS back FROM lineitem")
def mel_of_quantities(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * 100).alias("hz"))
    return rows.select("l_orderkey", "l_linenumber", r(vec.mel(F.col("hz"))).alias("natural"), r(vec.mel(F.col("hz"), "decimal")).alias("decimal"), r(vec.inverse_mel(vec.mel(F.col("hz"), "decimal"), "decimal")).alias("back"))
