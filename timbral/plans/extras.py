"""Further named queries: predicates, id work, formats and shapes over the driver's tables. Importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import datadir, intervals, scoring
from ..scratch import shared_folder
from ..sources import text_tables
from .catalogue import E_SQL, LONG_SQL, _vectors, query, r, table


@query("SELECT d.doc_id AS utt, o.n / 10.0::DOUBLE AS dur FROM documents d JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON d.doc_id = o.k WHERE o.n / 10.0::DOUBLE BETWEEN 0.8 AND 1.5")
def duration_map_filter(spark, sf):
    durations = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("utt")).agg((F.count(F.lit(1)) / 10.0).alias("dur"))
    return datadir.within_durations(table(spark, sf, "documents").select(F.col("doc_id").alias("utt")), durations, 0.8, 1.5)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND c_acctbal > 0")
def tsv_predicate(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.where((F.lower(F.trim("c_mktsegment")) == "building") & (F.col("c_acctbal") > 0)).select("c_custkey", "c_mktsegment")


@query("SELECT CASE WHEN utt < '3' THEN 'low' WHEN utt < '6' THEN 'middle' ELSE 'high' END AS part, count(*) AS n FROM (SELECT doc_id::VARCHAR AS utt FROM documents) GROUP BY 1")
def id_ranges(spark, sf):
    utts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("utt"))
    return datadir.ranged(utts, "utt", ["3", "6"], ["low", "middle", "high"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'target' ELSE 'nontarget' END AS label FROM lineitem")
def label_recode(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return datadir.recoded(rows, "l_returnflag", {"R": "target"}, "nontarget", "label").drop("l_returnflag")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS spk FROM pages")
def speaker_from_id(spark, sf):
    ids = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("utt"))
    return datadir.speaker_of(ids, "utt", "/").select("page_id", F.regexp_extract("spk", "^[^?#]*", 0).alias("spk"))


@query("SELECT doc_id AS utt, doc_id AS spk FROM documents")
def identity_utt2spk(spark, sf):
    return datadir.own_speaker(table(spark, sf, "documents").select(F.col("doc_id").alias("utt")), "utt")


@query("SELECT event_id, printf('%s-%08d-%08d', user_id::VARCHAR, (event_id % 86400) * 1000, ((event_id % 86400) + floor(value)::BIGINT) * 1000) AS seg FROM events")
def segment_ids(spark, sf):
    begin = (F.col("event_id") % 86400).cast("double")
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("utt"), begin.alias("begin"), (begin + F.floor("value")).alias("end"))
    return rows.select("event_id", intervals.segment_id(F.col("utt"), F.col("begin"), F.col("end")).alias("seg"))


@query("SELECT event_id, (event_id % 86400)::DOUBLE AS begin, user_id::VARCHAR AS utt FROM events")
def parse_segment_ids(spark, sf):
    folder = shared_folder(spark)
    begin = (F.col("event_id") % 86400).cast("double")
    seg = intervals.segment_id(F.col("user_id").cast("string"), begin, begin + 1)
    text_tables.write_lines(table(spark, sf, "events"), folder, F.concat(seg, F.lit("-00000000-00000100")), "event_id")
    return text_tables.read_labels(spark, folder).select(F.col("label").cast("long").alias("event_id"), "begin", "utt")


@query("SELECT l_orderkey, l_linenumber, round(0.5::DOUBLE * l_quantity + 2 * l_discount - 3, 5) AS score FROM lineitem")
def linear_calibration(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    return scoring.linear_calibration(rows, {"a": 0.5, "b": 2.0}, -3.0, "score").select("l_orderkey", "l_linenumber", r("score").alias("score"))


@query("SELECT l_orderkey::VARCHAR || ' ' || l_linenumber::VARCHAR || ' ' || printf('%.5f', l_extendedprice) || ' ' || CASE WHEN l_returnflag = 'R' THEN 'target' ELSE 'nontarget' END AS line FROM lineitem")
def score_lines(spark, sf):
    folder = shared_folder(spark)
    label = F.when(F.col("l_returnflag") == "R", "target").otherwise("nontarget")
    rows = table(spark, sf, "lineitem").withColumn("score", F.col("l_extendedprice").cast("double"))
    text_tables.write_lines(rows, folder, "l_orderkey", "l_linenumber", "score", label)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("SELECT conv_id, len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) AS n_fields, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')[1] AS head FROM conversations WHERE text IS NOT NULL")
def split_fields(spark, sf):
    fields = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " ")
    return table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", F.size(fields).cast("long").alias("n_fields"), fields[0].alias("head"))


@query("SELECT 'p-' || c_custkey AS utt, 's-' || c_nationkey AS spk, 'p-' || c_name AS path FROM customer WHERE c_nationkey < 10")
def copied_with_prefixes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("utt"), F.col("c_nationkey").alias("spk"), F.col("c_name").alias("path"))
    ids = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("spk"))
    kept = datadir.filter_ids(c, ids, "spk")
    return datadir.prefixed(kept, {"utt": "p-", "spk": "s-", "path": "p-"})


@query(f"WITH {E_SQL}, m AS (SELECT utt, emb, list_max(list_transform(emb, lambda x: abs(x))) AS top FROM e) SELECT utt, unnest(range(0, len(emb)))::INT AS pos, round(unnest(list_transform(emb, lambda x: x / (top + 0.0001::DOUBLE))), 5) AS x FROM m")
def peak_normalised(spark, sf):
    return _vectors(spark, sf).select("utt", F.posexplode(vec.peak_normalise(F.col("emb"))).alias("pos", "x")).withColumn("x", r("x"))


@query("SELECT utt, spk, n FROM (SELECT doc_id AS utt, source AS spk, n_chars AS n FROM documents) WHERE n BETWEEN 100 AND 2000")
def length_filter(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"), F.col("n_chars").alias("n"))
    return rows.where(F.col("n").between(100, 2000))


@query(f"""WITH {E_SQL}, c AS (SELECT utt, unnest(range(0, (len(emb) + 47) // 48))::INT AS k, emb FROM e)
SELECT utt, k, round(list_sum(emb[48 * k + 1 : 48 * k + 48]), 4) AS total, 48::BIGINT AS n FROM c""")
def zero_padded_chunks(spark, sf):
    chunks = _vectors(spark, sf).select("utt", F.posexplode(intervals.frame_chunks(F.col("emb"), 48)).alias("k", "c"))
    return chunks.select("utt", "k", r(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("c").cast("long").alias("n"))


@query(f"WITH {E_SQL}, {LONG_SQL}, g AS (SELECT spk, utt // 5 AS piece, pos, avg(x) AS x FROM long GROUP BY spk, utt // 5, pos) SELECT spk, pos, round(avg(x), 5) AS x FROM g GROUP BY spk, pos")
def chunk_embedding_average(spark, sf):
    v = _vectors(spark, sf).withColumn("piece", F.floor(F.col("utt") / 5))
    pieces = scoring.mean_vector(v, "emb", "spk", "piece").select("spk", F.col("mean").alias("emb"))
    return scoring.mean_vector(pieces, "emb", "spk").select("spk", F.posexplode("mean").alias("pos", "x")).withColumn("x", r("x"))


@query(f"WITH {E_SQL} SELECT e.utt, e.spk, d.source AS side, round(sqrt(list_dot_product(e.emb, e.emb)), 5) AS magnitude FROM e JOIN documents d ON d.doc_id = e.utt")
def utt2spk_features(spark, sf):
    sides = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("side"))
    return datadir.lookup(_vectors(spark, sf), sides, "utt", "drop").select("utt", "spk", "side", r(vec.norm(F.col("emb"))).alias("magnitude"))


@query("SELECT d.doc_id AS utt, n.k AS spk_id FROM documents d JOIN (SELECT source, (row_number() OVER (ORDER BY source) - 1)::BIGINT AS k FROM (SELECT DISTINCT source FROM documents)) n USING (source)")
def id_map_join(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"))
    return d.join(datadir.dense_ids(d.select("spk").distinct(), "spk"), "spk").select("utt", F.col("id").cast("long").alias("spk_id"))


@query("SELECT n_nationkey AS utt, (n_nationkey % 3)::BIGINT AS part FROM nation")
def even_shares(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("utt"))
    return rows.select("utt", F.pmod("utt", F.lit(3)).cast("long").alias("part"))


@query("SELECT d.doc_id AS utt, 'copy' AS source FROM documents d UNION ALL SELECT vec_id, 'vector' FROM embeddings")
def table_union(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("utt"), F.lit("copy").alias("source"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("utt"), F.lit("vector").alias("source"))
    return datadir.combine([{"utts": a}, {"utts": b}])["utts"]
