"""Named queries over the driver's tables, each with an equivalent SQL text.

Utterances are rows of ``embeddings`` (key vec_id, speaker label) or ``documents`` (key
doc_id, speaker source, duration n_chars / 1000); intervals are rows of ``events``;
scored trials are rows of ``lineitem``. Doubles are rounded at the output, as sums of
partitions differ in their last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules, vec
from ..operators import backend, clustering, datadir, intervals, metrics, scoring, signal
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _no_negative_zero(sql: str) -> str:
    """Each rounded value plus zero, as :func:`r` has it."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        end, depth = begin + len("round("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:begin]}({sql[begin:end]} + 0::DOUBLE)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = _no_negative_zero(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column, digits: int = 5):
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + 0.0  # no negative zero


# --- embeddings ---------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt"), vec.as_double(F.col("embedding")).alias("emb"), F.col("label").alias("spk"))


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of each speaker, under the id -1 - speaker, so that utterances and models share a table."""
    return scoring.mean_vector(_vectors(spark, sf), "emb", "spk").select((-1 - F.col("spk")).cast("long").alias("utt"), F.col("mean").alias("emb"))


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("utt", "emb").unionByName(_models(spark, sf))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """The trial list of the catalogue: every utterance against the model of every speaker."""
    v = _vectors(spark, sf).select("utt", "spk")
    models = v.select(F.col("spk").alias("model")).distinct()
    return v.join(models).select((-1 - F.col("model")).cast("long").alias("enroll"), F.col("utt").alias("test"), (F.col("spk") == F.col("model")).cast("int").alias("target"))


E_SQL = "e AS (SELECT vec_id AS utt, list_transform(embedding, lambda x: x::DOUBLE) AS emb, label AS spk FROM embeddings)"
LONG_SQL = "long AS (SELECT utt, spk, unnest(range(0, len(emb)))::INT AS pos, unnest(emb) AS x FROM e)"
MEAN_SQL = "mv AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM long GROUP BY pos))"
MODELS_SQL = "mo AS (SELECT spk, list(m ORDER BY pos) AS c FROM (SELECT spk, pos, avg(x) AS m FROM long GROUP BY spk, pos) GROUP BY spk), ev AS (SELECT utt, emb FROM e UNION ALL SELECT (-1 - spk)::BIGINT, c FROM mo), trials AS (SELECT (-1 - mo.spk)::BIGINT AS enroll, e.utt AS test, CASE WHEN mo.spk = e.spk THEN 1 ELSE 0 END AS target FROM mo, e)"
NORM = "sqrt(list_dot_product({0}, {0}))"


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MEAN_SQL}, {MODELS_SQL},
c AS (SELECT utt, list_transform(range(1, len(emb) + 1), lambda i: emb[i] - m[i]) AS v FROM ev, mv)
SELECT enroll, test, target, round(list_dot_product(a.v, b.v) / ({NORM.format('a.v')} * {NORM.format('b.v')}), 5) AS score
FROM trials JOIN c a ON a.utt = enroll JOIN c b ON b.utt = test""")
def cosine_trials(spark, sf):
    return scoring.cosine_scores(_trials(spark, sf), _sides(spark, sf), scoring.mean_vector(_vectors(spark, sf), "emb")).withColumn("score", r("score"))


@query(f"WITH {E_SQL}, {LONG_SQL} SELECT pos, round(avg(x), 6) AS x FROM long GROUP BY pos")
def global_mean_vector(spark, sf):
    return scoring.mean_vector(_vectors(spark, sf), "emb").select(F.posexplode("mean").alias("pos", "x")).withColumn("x", r("x", 6))


@query(f"WITH {E_SQL}, {LONG_SQL} SELECT spk, pos, round(avg(x), 6) AS x FROM long GROUP BY spk, pos")
def speaker_mean_vector(spark, sf):
    return scoring.mean_vector(_vectors(spark, sf), "emb", "spk").select("spk", F.posexplode("mean").alias("pos", "x")).withColumn("x", r("x", 6))


@query(f"WITH {E_SQL}, n AS (SELECT utt, emb, {NORM.format('emb')} AS n FROM e) SELECT utt, unnest(range(0, len(emb)))::INT AS pos, round(unnest(list_transform(emb, lambda x: x * sqrt(len(emb)::DOUBLE) / n)), 5) AS x FROM n")
def length_norm(spark, sf):
    return _vectors(spark, sf).select("utt", F.posexplode(vec.length_norm(F.col("emb"), "dimension")).alias("pos", "x")).withColumn("x", r("x"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MEAN_SQL}, c AS (SELECT utt, list_transform(range(1, len(emb) + 1), lambda i: emb[i] - m[i]) AS v FROM e, mv)
SELECT utt, unnest(range(0, len(v)))::INT AS pos, round(unnest(list_transform(v, lambda x: x / {NORM.format('v')})), 5) AS x FROM c""")
def mean_sub_length_norm_chain(spark, sf):
    v = _vectors(spark, sf)
    chain = backend.fit_chain("mean-subtract | length-norm", v)
    return v.select("utt", F.posexplode(backend.apply_chain(chain, F.col("emb"))).alias("pos", "x")).withColumn("x", r("x"))


def _cohort(spark, sf):
    return scoring.mean_vector(_vectors(spark, sf), "emb", "spk").select(F.col("spk").cast("string").alias("name"), F.col("mean").alias("emb"))


def _snorm_sql(top: str) -> str:
    return f"""WITH {E_SQL}, {LONG_SQL}, {MODELS_SQL},
co AS (SELECT spk, list(m ORDER BY pos) AS c FROM (SELECT spk, pos, avg(x) AS m FROM long GROUP BY spk, pos) GROUP BY spk),
sc AS (SELECT utt, list_dot_product(emb, c) / ({NORM.format('emb')} * {NORM.format('c')}) AS s FROM ev, co),
st AS (SELECT utt, avg(s) AS m, stddev_pop(s) AS d FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY s DESC) AS k FROM sc) WHERE {top} GROUP BY utt),
raw AS (SELECT enroll, test, target, list_dot_product(a.emb, b.emb) / ({NORM.format('a.emb')} * {NORM.format('b.emb')}) AS s FROM trials JOIN ev a ON a.utt = enroll JOIN ev b ON b.utt = test)
SELECT enroll, test, target, round(0.5::DOUBLE * ((s - a.m) / a.d + (s - b.m) / b.d), 4) AS norm_score FROM raw JOIN st a ON a.utt = enroll JOIN st b ON b.utt = test"""


def _norm_scores(spark, sf, top):
    v = _sides(spark, sf)
    raw = scoring.cosine_scores(_trials(spark, sf), v)
    return scoring.normalised(raw, scoring.cohort_stats(v, _cohort(spark, sf), top)).select("enroll", "test", "target", r("norm_score", 4).alias("norm_score"))


@query(_snorm_sql("true"))
def snorm_scores(spark, sf):
    return _norm_scores(spark, sf, None)


@query(_snorm_sql("k <= 5"))
def asnorm_scores(spark, sf):
    return _norm_scores(spark, sf, 5)


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MODELS_SQL}, d AS (SELECT utt, spk, least(n_chars / 1000.0::DOUBLE, 2.0::DOUBLE) AS dur FROM e JOIN documents ON doc_id = utt),
q AS (SELECT utt, {NORM.format('emb')} AS mag, dur FROM ev JOIN (SELECT utt, dur FROM d UNION ALL SELECT -1 - spk, avg(dur) FROM d GROUP BY spk) USING (utt))
SELECT enroll, test, round(least(a.dur, b.dur), 7) AS dur_min, round(greatest(a.dur, b.dur), 7) AS dur_max, round(greatest(a.dur, b.dur) - least(a.dur, b.dur), 7) AS dur_diff,
round(least(a.dur, b.dur) / greatest(a.dur, b.dur), 7) AS dur_ratio, round(least(a.mag, b.mag), 7) AS mag_min, round(greatest(a.mag, b.mag), 7) AS mag_max
FROM trials JOIN q a ON a.utt = enroll JOIN q b ON b.utt = test""")
def quality_factors(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.least(F.col("n_chars") / 1000.0, F.lit(2.0)).alias("dur"))
    d = _vectors(spark, sf).select("utt", "spk").join(d, "utt")
    d = d.select("utt", "dur").unionByName(d.groupBy((-1 - F.col("spk")).cast("long").alias("utt")).agg(F.avg("dur").alias("dur")))
    q = _sides(spark, sf).select("utt", vec.norm(F.col("emb")).alias("mag")).join(d, "utt")
    a = q.select(F.col("utt").alias("enroll"), F.col("dur").alias("da"), F.col("mag").alias("ma"))
    b = q.select(F.col("utt").alias("test"), F.col("dur").alias("db"), F.col("mag").alias("mb"))
    dur = vec.min_max_diff_ratio(F.col("da"), F.col("db"))
    mag = vec.min_max_diff_ratio(F.col("ma"), F.col("mb"))
    named = [*zip(("dur_min", "dur_max", "dur_diff", "dur_ratio"), dur), *zip(("mag_min", "mag_max"), mag)]
    return _trials(spark, sf).join(a, "enroll").join(b, "test").select("enroll", "test", *(r(c, 7).alias(n) for n, c in named))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MODELS_SQL}, s AS (SELECT target, list_dot_product(a.emb, b.emb) / ({NORM.format('a.emb')} * {NORM.format('b.emb')}) AS s FROM trials JOIN ev a ON a.utt = enroll JOIN ev b ON b.utt = test)
SELECT round(0.5::DOUBLE * (avg(CASE WHEN target = 1 THEN ln(1 + exp(-s)) END) + avg(CASE WHEN target = 0 THEN ln(1 + exp(s)) END)) / ln(2), 6) AS cllr FROM s""")
def cllr(spark, sf):
    return metrics.cllr(scoring.cosine_scores(_trials(spark, sf), _sides(spark, sf))).withColumn("cllr", r("cllr", 6))


@query(f"""WITH {E_SQL}, {LONG_SQL}, co AS (SELECT spk, list(m ORDER BY pos) AS c FROM (SELECT spk, pos, avg(x) AS m FROM long GROUP BY spk, pos) GROUP BY spk),
sc AS (SELECT utt, co.spk::VARCHAR AS name, list_dot_product(emb, c) / ({NORM.format('emb')} * {NORM.format('c')}) AS s FROM e, co)
SELECT utt, name, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY s DESC, name) AS k FROM sc WHERE s > 0) WHERE k = 1""")
def identify_top1(spark, sf):
    return scoring.identify(_vectors(spark, sf), _cohort(spark, sf)).select("utt", "name", r("score").alias("score"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MODELS_SQL} SELECT enroll, test, (list_dot_product(a.emb, b.emb) / ({NORM.format('a.emb')} * {NORM.format('b.emb')}) + 1) / 2 >= 0.55::DOUBLE AS accepted
FROM trials JOIN ev a ON a.utt = enroll JOIN ev b ON b.utt = test""")
def threshold_decision(spark, sf):
    return scoring.cosine_scores(_trials(spark, sf), _sides(spark, sf), scale="unit").select("enroll", "test", (F.col("score") >= 0.55).alias("accepted"))


PSI = [1.0 / (i + 1) for i in range(64)]


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MODELS_SQL}, p AS (SELECT list_transform(range(0, 64), lambda i: 1.0::DOUBLE / (i + 1)) AS psi),
j AS (SELECT enroll, test, a.emb AS x, b.emb AS y, psi FROM trials JOIN ev a ON a.utt = enroll JOIN ev b ON b.utt = test, p)
SELECT enroll, test, round(
 -0.5::DOUBLE * list_sum(list_transform(range(1, 65), lambda i: ln(1 + psi[i] / (psi[i] + 1)) + pow(y[i] - psi[i] / (psi[i] + 1) * x[i], 2) / (1 + psi[i] / (psi[i] + 1))))
 + 0.5::DOUBLE * list_sum(list_transform(range(1, 65), lambda i: ln(1 + psi[i]) + y[i] * y[i] / (1 + psi[i]))), 5) AS llr FROM j""")
def plda_llr_fixed_params(spark, sf):
    joined = scoring.attach(_trials(spark, sf), _sides(spark, sf))
    return joined.select("enroll", "test", r(scoring.plda_llr(F.col("enroll_emb"), F.col("test_emb"), PSI)).alias("llr"))


@query(f"""WITH {E_SQL}, {LONG_SQL} SELECT spk, count(*) // 64 AS n, round(sum(v), 5) AS trace FROM (SELECT spk, pos, x, (x - avg(x) OVER (PARTITION BY spk, pos)) ** 2 AS v FROM long) GROUP BY spk""")
def class_scatter_trace(spark, sf):
    v = _vectors(spark, sf)
    long = v.select("spk", F.posexplode("emb").alias("pos", "x"))
    bins = long.groupBy("spk", "pos").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v"))
    return bins.groupBy("spk").agg(F.max("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("trace")).withColumn("trace", r("trace"))


@query(f"""WITH {E_SQL}, p AS (SELECT spk, emb[1] AS x, emb[2] AS y FROM e), c AS (SELECT spk, count(*) AS n, covar_pop(x, y) AS w, avg(x) AS mx, avg(y) AS my FROM p GROUP BY spk HAVING count(*) > 1)
SELECT round(sum(n * w) / sum(n), 7) AS within_xy, round(sum(n * mx * my) / sum(n) - (sum(n * mx) / sum(n)) * (sum(n * my) / sum(n)), 7) AS between_xy FROM c""")
def within_between_covariance_entry(spark, sf):
    c = _vectors(spark, sf).select("spk", F.col("emb")[0].alias("x"), F.col("emb")[1].alias("y")).groupBy("spk").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("w"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where("n > 1")
    share = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    return c.agg(r(share(F.col("w")), 7).alias("within_xy"), r(share(F.col("mx") * F.col("my")) - share(F.col("mx")) * share(F.col("my")), 7).alias("between_xy"))


@query()
def lda_project(spark, sf):
    v = _vectors(spark, sf)
    chain = backend.fit_chain("mean-subtract | lda --dim 4 | length-norm", v)
    return v.select("utt", "spk", F.posexplode(backend.apply_chain(chain, F.col("emb"))).alias("pos", "x"))


def _plda(spark, sf):
    return backend.fit_plda(backend.class_stats(_vectors(spark, sf)), rounds=5)


@query()
def plda_train_score(spark, sf):
    v = _vectors(spark, sf)
    enroll = scoring.mean_vector(v, "emb", "spk").join(v.groupBy("spk").agg(F.count(F.lit(1)).alias("n")), "spk").select(F.col("spk").alias("utt"), F.col("mean").alias("emb"), "n")
    trials = v.select(F.col("spk").alias("enroll"), F.col("utt").alias("test"))
    return backend.plda_scores(_plda(spark, sf), trials, enroll, v)


@query()
def plda_adapt(spark, sf):
    v = _vectors(spark, sf)
    adapted = backend.adapt_plda(_plda(spark, sf), v)
    return adapted.to_row(spark).select(F.posexplode("psi").alias("pos", "psi"))


@query(f"WITH {E_SQL} SELECT utt, i AS speed_index, CASE WHEN spk < 0 THEN spk ELSE spk + 10 * i END AS label FROM e, (SELECT unnest(range(0, 3))::INT AS i)")
def speed_perturb_labels(spark, sf):
    return signal.speed_labels(_vectors(spark, sf).select("utt", F.col("spk").alias("label")), 10).select("utt", "speed_index", "label")


@query(f"""WITH {E_SQL}, c AS (SELECT utt, list_concat(emb, emb) AS l, emb, utt % 5 AS s FROM e)
SELECT utt, round(list_sum(l[1:100]), 5) AS long_sum, round(list_sum(emb[s + 1 : s + 20]), 5) AS short_sum FROM c""")
def fixed_chunk_pad(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    v = _vectors(spark, sf)
    return v.select("utt", r(total(vec.chunk(F.col("emb"), F.lit(0), 100))).alias("long_sum"), r(total(vec.chunk(F.col("emb"), F.col("utt") % 5, 20))).alias("short_sum"))


def _matrix(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("emb", i * 8 + 1, 8))
    return _vectors(spark, sf).select("utt", rows.alias("feat"))


CELLS_SQL = "cells AS (SELECT utt, pos // 8 AS frame, pos % 8 AS bin, x FROM long)"


@query(f"WITH {E_SQL}, {LONG_SQL}, {CELLS_SQL} SELECT utt, frame::INT AS frame, bin::INT AS bin, round(x - avg(x) OVER (PARTITION BY utt, bin), 5) AS x FROM cells")
def cmvn(spark, sf):
    done = _matrix(spark, sf).select("utt", F.posexplode(signal.mean_normalised(F.col("feat"))).alias("frame", "row"))
    return done.select("utt", "frame", F.posexplode("row").alias("bin", "x")).withColumn("x", r("x"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {CELLS_SQL}, p AS (SELECT utt, bin::INT AS bin, avg(x) AS m, sqrt(var_samp(x) + 0.0000001::DOUBLE) AS d FROM cells GROUP BY utt, bin)
SELECT utt, bin AS pos, round(m, 5) AS x FROM p UNION ALL SELECT utt, bin + 8, round(d, 5) FROM p""")
def tstp_pooling(spark, sf):
    return signal.pooled(_matrix(spark, sf), "utt").select("utt", F.posexplode("pooled").alias("pos", "x")).withColumn("x", r("x"))


@query(f"""WITH {E_SQL}, p AS (SELECT utt, 10 * log10(list_dot_product(emb[1:32], emb[1:32]) / 32 + 0.0001::DOUBLE) AS s, 10 * log10(list_dot_product(emb[33:64], emb[33:64]) / 32 + 0.0001::DOUBLE) AS n FROM e)
SELECT utt, round(sqrt(pow(10, (s - n - 15) / 10)), 5) AS gain FROM p""")
def noise_gain(spark, sf):
    return _vectors(spark, sf).select("utt", r(vec.noise_gain(F.slice("emb", 1, 32), F.slice("emb", 33, 32), F.lit(15.0))).alias("gain"))


def _steps(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """A step below n for each order."""
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % n).alias("id"))


@query("SELECT o_orderkey, i AS bin, round(1127.0::DOUBLE * ln(1 + i * 100 / 700.0::DOUBLE), 5) AS mel, round(2595.0::DOUBLE * log10(1 + i * 100 / 700.0::DOUBLE), 5) AS mel10 FROM (SELECT o_orderkey, o_orderkey % 81 AS i FROM orders)")
def mel_scale_bins(spark, sf):
    hz = F.col("id") * 100.0
    return _steps(spark, sf, 81).select("o_orderkey", F.col("id").alias("bin"), r(vec.mel(hz)).alias("mel"), r(vec.mel(hz, "common")).alias("mel10"))


@query(f"""SELECT o_orderkey, i AS step, round(least(i / 100.0::DOUBLE, 1.0::DOUBLE) * 0.1::DOUBLE * exp(i / 1000.0::DOUBLE * {math.log(1e-4)!r}::DOUBLE), 8) AS exp_lr,
round(CASE WHEN i < 100 THEN 0.1::DOUBLE * i / 100 WHEN i < 900 THEN 0.001::DOUBLE + 0.5::DOUBLE * 0.099::DOUBLE * (1 + cos(pi() * (i - 100) / 800.0::DOUBLE)) ELSE 0.001::DOUBLE END, 8) AS cosine_lr,
round(0.001::DOUBLE + 0.099::DOUBLE * pow(0.5::DOUBLE, i // 200) * CASE WHEN i % 200 <= 100 THEN (i % 200) / 100.0::DOUBLE ELSE 1 - (i % 200 - 100) / 100.0::DOUBLE END, 10) AS triangular_lr
FROM (SELECT o_orderkey, o_orderkey % 1000 AS i FROM orders)""")
def lr_schedule(spark, sf):
    s = F.col("id")
    return _steps(spark, sf, 1000).select("o_orderkey",
        s.alias("step"), r(schedules.exponential(s, 0.1, 1e-5, 1000, 100), 8).alias("exp_lr"), r(schedules.cosine(s, 0.1, 0.001, 100, 900), 8).alias("cosine_lr"), r(schedules.triangular2(s, 0.001, 0.1, 100), 10).alias("triangular_lr")
    )


@query(f"""SELECT o_orderkey, i AS step, round(CASE WHEN i < 200 THEN 0 WHEN i >= 400 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE * (1 - exp((i - 200) / 200.0::DOUBLE * {math.log(1e-3 / (1 + 1e-6))!r}::DOUBLE)) END, 6) AS exp_margin,
round(CASE WHEN i < 200 THEN 0 WHEN i >= 400 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE * (i - 200) / 200.0::DOUBLE END, 6) AS linear_margin FROM (SELECT o_orderkey, o_orderkey % 500 AS i FROM orders)""")
def margin_schedule(spark, sf):
    s = F.col("id")
    return _steps(spark, sf, 500).select("o_orderkey", s.alias("step"), r(schedules.margin(s, 200, 400, 0.0, 0.2), 6).alias("exp_margin"), r(schedules.margin(s, 200, 400, 0.0, 0.2, "linear"), 6).alias("linear_margin"))


CENTROIDS_SQL = f"co AS (SELECT spk AS cls, list(m ORDER BY pos) AS c FROM (SELECT spk, pos, avg(x) AS m FROM long GROUP BY spk, pos) GROUP BY spk), cs AS (SELECT utt, spk, cls, emb, c, list_dot_product(emb, c) / ({NORM.format('emb')} * {NORM.format('c')}) AS s FROM e, co)"


def _against_centroids(spark, sf):
    centroids = scoring.mean_vector(_vectors(spark, sf), "emb", "spk").select(F.col("spk").alias("cls"), F.col("mean").alias("c"))
    return _vectors(spark, sf).join(centroids).withColumn("s", vec.cosine(F.col("emb"), F.col("c")))  # one centroid a speaker


@query(f"""WITH {E_SQL}, {LONG_SQL}, {CENTROIDS_SQL} SELECT utt, cls, round(32 * CASE WHEN spk <> cls THEN s WHEN s > {math.cos(math.pi - 0.2)!r}::DOUBLE THEN s * {math.cos(0.2)!r}::DOUBLE - sqrt(greatest(1 - s * s, 0)) * {math.sin(0.2)!r}::DOUBLE
ELSE s - {math.sin(math.pi - 0.2) * 0.2!r}::DOUBLE END, 4) AS logit FROM cs""")
def arcface_logits(spark, sf):
    return _against_centroids(spark, sf).select("utt", "cls", r(vec.margin_logit(F.col("s"), F.col("spk") == F.col("cls")), 4).alias("logit"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {CENTROIDS_SQL}, h AS (SELECT utt, cls, list_transform(emb, lambda x: x * 0.5::DOUBLE) AS a, c AS b FROM cs),
d AS (SELECT utt, cls, a, b, list_transform(range(1, 65), lambda i: a[i] - b[i]) AS v FROM h)
SELECT utt, cls, round(acosh(1 + 2 * list_dot_product(v, v) / ((1 - list_dot_product(a, a)) * (1 - list_dot_product(b, b)))), 5) AS distance FROM d""")
def poincare_distance(spark, sf):
    return _against_centroids(spark, sf).select("utt", "cls", r(vec.poincare_distance(vec.times(F.col("emb"), 0.5), F.col("c"))).alias("distance"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {CENTROIDS_SQL} SELECT utt, round(max(CASE WHEN spk = cls THEN s END) / 0.1::DOUBLE - ln(sum(exp(s / 0.1::DOUBLE))), 4) AS log_p FROM cs GROUP BY utt""")
def infonce_logits(spark, sf):
    s = F.col("s")
    return _against_centroids(spark, sf).groupBy("utt").agg((F.max(F.when(F.col("spk") == F.col("cls"), s)) / 0.1 - F.log(F.sum(F.exp(s / 0.1)))).alias("log_p")).withColumn("log_p", r("log_p", 4))


@query()
def spectral_cluster(spark, sf):
    v = _vectors(spark, sf).withColumn("rec", F.col("utt") % 10)
    return clustering.cluster(v, "rec", "utt", "emb", "spectral")


@query()
def merge_cluster(spark, sf):
    v = _vectors(spark, sf).withColumn("rec", F.col("utt") % 10)
    return clustering.cluster(v, "rec", "utt", "emb", "merge")


# --- scored trials (lineitem) -------------------------------------------------------------------


def _scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("target"), F.col("l_orderkey").alias("enroll"), F.col("l_linenumber").alias("test"), F.col("l_linestatus").alias("part")
    )


S_SQL = "s AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_orderkey AS enroll, l_linenumber AS test, l_linestatus AS part FROM lineitem)"
CURVE_SQL = f"{S_SQL}, w AS (SELECT *, row_number() OVER o - 1 AS i, sum(target) OVER o AS t, sum(1 - target) OVER o AS n FROM s WINDOW o AS (ORDER BY score, target, enroll, test ROWS UNBOUNDED PRECEDING)), c AS (SELECT score, target, enroll, test, i, t / sum(target) OVER () AS fnr, 1 - n / sum(1 - target) OVER () AS fpr FROM w)"


def _curve(spark, sf):
    return metrics.det_curve(_scored(spark, sf).drop("part"), ties=("enroll", "test"))


@query(f"WITH {CURVE_SQL} SELECT i, enroll, test, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr FROM c")
def det_curve(spark, sf):
    return _curve(spark, sf).select("i", "enroll", "test", r("fnr", 6).alias("fnr"), r("fpr", 6).alias("fpr"))


@query(f"""WITH {CURVE_SQL}, x AS (SELECT * FROM c WHERE fnr - fpr >= 0 ORDER BY i LIMIT 1), y AS (SELECT * FROM c WHERE fnr - fpr < 0 ORDER BY i DESC LIMIT 1)
SELECT round(x.fnr + (x.fnr - x.fpr) / ((x.fnr - x.fpr) - (y.fnr - y.fpr)) * (y.fnr - x.fnr), 6) AS eer, x.score AS threshold FROM x, y""")
def eer(spark, sf):
    return metrics.equal_error_rate(_curve(spark, sf)).withColumn("eer", r("eer", 6))


@query(f"WITH {CURVE_SQL} SELECT round(min(fnr * 0.01::DOUBLE + fpr * 0.99::DOUBLE) / 0.01::DOUBLE, 6) AS min_dcf FROM c")
def min_dcf(spark, sf):
    return metrics.min_cost(_curve(spark, sf)).withColumn("min_dcf", r("min_dcf", 6))


@query(f"WITH {CURVE_SQL} SELECT round((min(fnr * 0.01::DOUBLE + fpr * 0.99::DOUBLE) / 0.01::DOUBLE + min(fnr * 0.005::DOUBLE + fpr * 0.995::DOUBLE) / 0.005::DOUBLE) / 2, 6) AS c_primary FROM c")
def sre_cprimary(spark, sf):
    return metrics.primary_cost(_curve(spark, sf)).withColumn("c_primary", r("c_primary", 6))


@query(f"""WITH {S_SQL}, g AS (SELECT part, count(*) FILTER (target = 1) AS n_target, count(*) FILTER (target = 0) AS n_other FROM s GROUP BY part)
SELECT part, n_target, n_other, round(CASE WHEN n_target > 0 THEN max(n_target) OVER () / n_target ELSE 0 END, 6) AS target_weight, round(CASE WHEN n_other > 0 THEN max(n_other) OVER () / n_other ELSE 0 END, 6) AS other_weight FROM g""")
def equalized_weights(spark, sf):
    w = metrics.equalised_weights(_scored(spark, sf), "part")
    return w.withColumn("target_weight", r("target_weight", 6)).withColumn("other_weight", r("other_weight", 6))


@query(f"""WITH {S_SQL}, b AS (SELECT least(greatest(floor((score - 0) / (110000 / 50.0::DOUBLE)), 0), 49)::BIGINT AS bin, target FROM s),
g AS (SELECT t.bin, count(*) FILTER (target = 1) AS t, count(*) FILTER (target = 0) AS n FROM range(0, 50) t(bin) LEFT JOIN b USING (bin) GROUP BY t.bin)
SELECT bin, round(sum(t) OVER (ORDER BY bin) / sum(t) OVER (), 6) AS p_miss, round(1 - sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS p_fa FROM g""")
def score_histogram_cdf(spark, sf):
    h = metrics.histogram_cdf(_scored(spark, sf), 0.0, 110000.0, 50)
    return h.select("bin", r("p_miss", 6).alias("p_miss"), r("p_fa", 6).alias("p_fa"))


# --- keyed tables (documents, labels) -----------------------------------------------------------


def _utts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"), (F.col("n_chars") / 1000.0).alias("dur"), "lang")


U_SQL = "u AS (SELECT doc_id AS utt, source AS spk, n_chars / 1000.0::DOUBLE AS dur, lang FROM documents)"


@query(f"WITH {U_SQL} SELECT spk, string_agg(utt::VARCHAR, ' ' ORDER BY utt) AS utts, count(*) AS n FROM u GROUP BY spk")
def spk2utt(spark, sf):
    return datadir.invert(_utts(spark, sf), "utt", "spk", "utt", "utts").select("spk", F.array_join(F.col("utts").cast("array<string>"), " ").alias("utts"), F.size("utts").cast("long").alias("n"))


@query(f"WITH {U_SQL} SELECT utt, spk FROM u")
def utt2spk(spark, sf):
    u = _utts(spark, sf)
    return datadir.uninvert(datadir.invert(u, "utt", "spk", "utt", "utts"), "spk", "utts", "utt").select("utt", "spk")


def _listed(spark, sf):
    return table(spark, sf, "labels").select("doc_id")


@query(f"WITH {U_SQL} SELECT * FROM u WHERE utt IN (SELECT doc_id FROM labels)")
def filter_scp_include(spark, sf):
    return datadir.filter_ids(_utts(spark, sf), _listed(spark, sf), "utt")


@query(f"WITH {U_SQL} SELECT * FROM u WHERE utt NOT IN (SELECT doc_id FROM labels)")
def filter_scp_exclude(spark, sf):
    return datadir.filter_ids(_utts(spark, sf), _listed(spark, sf), "utt", exclude=True)


def _vad(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id"), F.col("value"))
    return e.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("vad"))


RAW_SQL = """v AS (SELECT user_id AS key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS vad FROM events GROUP BY user_id)
SELECT doc_id AS key, source AS spk, 'wav/' || doc_id || '.wav' AS wav, vad FROM documents {join} JOIN v ON v.key = doc_id"""


def _raw(spark, sf, keep):
    d = table(spark, sf, "documents")
    spk = d.select(F.col("doc_id").alias("key"), F.col("source").alias("spk"))
    wav = d.select(F.col("doc_id").alias("key"), F.concat(F.lit("wav/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("wav"))
    return datadir.raw_list(spk, wav, _vad(spark, sf), keep)


@query("WITH " + RAW_SQL.format(join="INNER"))
def raw_list_inner_vad(spark, sf):
    return _raw(spark, sf, False)


@query("WITH " + RAW_SQL.format(join="LEFT"))
def shard_list_left_vad(spark, sf):
    return _raw(spark, sf, True)


@query("SELECT doc_id AS utt, source AS spk, quality FROM (SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 0) JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) JOIN (SELECT vec_id FROM embeddings) ON vec_id = doc_id")
def fix_data_dir(spark, sf):
    tables = {
        "utt2spk": _utts(spark, sf).where("dur > 0").select("utt", "spk"),
        "quality": datadir.unique_first(table(spark, sf, "labels").select(F.col("doc_id").alias("utt"), "quality"), "utt", "quality"),
        "emb": _vectors(spark, sf).select("utt"),
    }
    fixed = datadir.consistent(tables, "utt")
    return fixed["utt2spk"].join(fixed["quality"], "utt")


@query(f"WITH {U_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY utt) AS k, count(*) OVER (PARTITION BY spk) AS n FROM u) SELECT utt, spk FROM k WHERE (k - 1) % greatest(1, n // 5) = 0 AND k <= 5 * greatest(1, n // 5)")
def subset_per_spk(spark, sf):
    return datadir.spread_per_group(_utts(spark, sf).select("utt", "spk"), "spk", "utt", 5)


@query(f"WITH {U_SQL} SELECT utt, dur FROM u ORDER BY dur, utt LIMIT 50")
def subset_shortest(spark, sf):
    return _utts(spark, sf).select("utt", "dur").orderBy("dur", "utt").limit(50)


@query(f"WITH {U_SQL} SELECT utt, spk FROM u ORDER BY utt LIMIT 50")
def subset_first(spark, sf):
    return _utts(spark, sf).select("utt", "spk").orderBy("utt").limit(50)


@query(f"WITH {U_SQL} SELECT utt, spk FROM u ORDER BY md5(utt::VARCHAR || '|7'), utt LIMIT 50")
def subset_random(spark, sf):
    return _utts(spark, sf).select("utt", "spk").orderBy(datadir.hashed(F.col("utt"), "7"), "utt").limit(50)


@query(f"""WITH {U_SQL}, g AS (SELECT spk, count(*) AS n FROM u GROUP BY spk), b AS (SELECT spk, coalesce(sum(n) OVER (ORDER BY md5(spk || '|7'), spk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT utt, spk FROM u WHERE spk IN (SELECT spk FROM b WHERE before < 200)""")
def subset_speakers(spark, sf):
    return datadir.groups_up_to(_utts(spark, sf).select("utt", "spk"), "spk", 200, "7").select("utt", "spk")


@query(f"WITH {U_SQL} SELECT utt, spk FROM u WHERE lang IN ('en', 'de')")
def combine_data(spark, sf):
    u = _utts(spark, sf)
    part = lambda lang: {"utt2spk": u.where(F.col("lang") == lang).select("utt", "spk"), **({"dur": u.select("utt", "dur")} if lang == "en" else {})}
    return datadir.combine([part("en"), part("de")])["utt2spk"]


@query(f"WITH {U_SQL} SELECT utt, spk FROM u WHERE spk IN (SELECT spk FROM u GROUP BY spk HAVING count(*) >= 10)")
def spk_min_utts(spark, sf):
    return datadir.least_members(_utts(spark, sf).select("utt", "spk"), "spk", 10).select("utt", "spk")


@query(f"WITH {U_SQL}, m AS (SELECT spk, row_number() OVER (ORDER BY spk) - 1 AS id FROM (SELECT DISTINCT spk FROM u WHERE lang = 'es')) SELECT utt, coalesce(id, -1) AS id FROM u LEFT JOIN m USING (spk)")
def spk2id(spark, sf):
    u = _utts(spark, sf)
    return u.join(datadir.dense_ids(u.where("lang = 'es'"), "spk"), "spk", "left").select("utt", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))


@query(f"WITH {U_SQL} SELECT utt || '_copy-' || c AS utt, spk FROM u, (SELECT unnest(range(0, 4)) AS c)")
def aug_copies(spark, sf):
    return datadir.copies(_utts(spark, sf).select("utt", "spk"), "utt", 3).select("utt", "spk")


@query(f"WITH {U_SQL} SELECT a.lang, a.utt AS enroll, b.utt AS test, CASE WHEN a.spk = b.spk THEN 'target' ELSE 'nontarget' END AS label FROM u a JOIN u b ON b.utt = a.utt + 7 AND a.lang = b.lang JOIN labels l ON l.doc_id = a.utt")
def trials_by_language(spark, sf):
    u = _utts(spark, sf)
    trials = table(spark, sf, "labels").select(F.col("doc_id").alias("enroll"), (F.col("doc_id") + 7).alias("test"))
    a = u.select(F.col("utt").alias("enroll"), F.col("spk").alias("sa"), "lang")
    b = u.select(F.col("utt").alias("test"), F.col("spk").alias("sb"), "lang")
    return trials.join(a, "enroll").join(b, ["test", "lang"]).select("lang", "enroll", "test", F.when(F.col("sa") == F.col("sb"), "target").otherwise("nontarget").alias("label"))


@query(f"""WITH {U_SQL}, k AS (SELECT *, CASE WHEN dur > 0.2::DOUBLE AND dur < 1.0::DOUBLE THEN 's' WHEN dur > 2.0::DOUBLE THEN 'l' END AS kind FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY spk, kind ORDER BY md5(utt::VARCHAR || '|3'), utt) AS n FROM k WHERE kind IS NOT NULL AND spk IN (SELECT spk FROM k GROUP BY spk HAVING count(DISTINCT kind) = 2)),
p AS (SELECT spk, max(CASE WHEN kind = 's' THEN utt END) AS s, max(CASE WHEN kind = 'l' THEN utt END) AS l FROM f WHERE n = 1 GROUP BY spk),
d AS (SELECT *, row_number() OVER o AS place, lead(l) OVER o AS other FROM p WINDOW o AS (ORDER BY md5(spk || '|3'), spk))
SELECT s AS enroll, l AS test, 'target' AS label FROM d WHERE place <= 10 UNION ALL SELECT s, other, 'nontarget' FROM d WHERE place <= 10 AND other IS NOT NULL""")
def calibration_trials(spark, sf):
    return datadir.calibration_trials(_utts(spark, sf), (0.2, 1.0), 2.0, 10, "3")


@query(f"""WITH {U_SQL}, s AS (SELECT spk, lang, sum(dur) AS total FROM u GROUP BY spk, lang), b AS (SELECT *, max(total) OVER (PARTITION BY spk) AS best FROM s)
SELECT spk, min(lang) AS lang, round(max(total), 4) AS total FROM b WHERE total > best - 0.00001::DOUBLE GROUP BY spk""")
def majority_speaker(spark, sf):
    return datadir.majority(_utts(spark, sf), "spk", "lang", "dur").withColumn("total", r("total", 4))


@query()
def combine_utts(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("spk"), F.format_string("%d-%04d", "conv_id", "turn").alias("utt"), (F.length("text") / 100.0).alias("dur")).where("dur > 0")
    return clustering.combine_utterances(c, 5.0)


# --- intervals (events) -------------------------------------------------------------------------


def _spans(spark, sf):
    begin = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select(F.col("user_id").alias("utt"), "event_id", F.col("event_type").alias("label"), begin.alias("begin"), (begin + F.col("value") * 100).alias("end"))


V_SQL = "v AS (SELECT user_id AS utt, event_id, event_type AS label, epoch_us(ts) / 1000000.0::DOUBLE AS b, epoch_us(ts) / 1000000.0::DOUBLE + value * 100 AS e FROM events)"


@query("SELECT user_id AS utt, round(sum(value), 4) AS voiced, count(*) AS n FROM events GROUP BY user_id")
def voice_duration(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("utt")).agg(F.sum("value").alias("voiced"), F.count(F.lit(1)).alias("n")).withColumn("voiced", r("voiced", 4))


@query(f"""WITH {V_SQL}, f AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY utt ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM v),
g AS (SELECT *, sum(f) OVER (PARTITION BY utt ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT utt, round(min(b), 3) AS begin_at, round(max(e), 3) AS end_at FROM g GROUP BY utt, g HAVING max(e) - min(b) >= 0.255::DOUBLE""")
def oracle_sad_merge(spark, sf):
    return intervals.merge_overlaps(_spans(spark, sf), least=0.255).select("utt", r("begin", 3).alias("begin_at"), r("end", 3).alias("end_at"))


@query(f"""WITH {V_SQL}, n AS (SELECT *, lag(e) OVER o AS pe, lag(label) OVER o AS pl, lead(b) OVER o AS nb, lead(label) OVER o AS nl FROM v WINDOW o AS (PARTITION BY utt ORDER BY b, e, label, event_id)),
m AS (SELECT *, CASE WHEN pe IS NULL OR b > pe OR label <> pl THEN 1 ELSE 0 END AS f, CASE WHEN pe IS NULL OR b > pe THEN b ELSE (b + pe) / 2 END AS tb, CASE WHEN nb <= e AND nl <> label THEN (nb + e) / 2 ELSE e END AS te FROM n),
g AS (SELECT *, sum(f) OVER (PARTITION BY utt ORDER BY b, e, label, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT utt, min(label) AS label, round(arg_min(tb, (b, e, event_id)), 3) AS turn_begin, round(arg_max(te, (b, e, event_id)), 3) AS turn_end FROM g GROUP BY utt, g""")
def turn_merge_rttm(spark, sf):
    turns = intervals.merge_turns(_spans(spark, sf), order=("event_id",))
    return turns.select("utt", "label", r("turn_begin", 3).alias("turn_begin"), r("turn_end", 3).alias("turn_end"))


@query("""WITH v AS (SELECT event_id, floor(value * 10)::BIGINT AS n_frames FROM events)
SELECT event_id, n_frames, first, least(first + 150, n_frames) AS last FROM (SELECT event_id, n_frames, unnest(CASE WHEN n_frames <= 150 THEN [0::BIGINT] ELSE range(0, n_frames - 150 + 75, 75) END) AS first FROM v)""")
def subsegments(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 10).alias("n_frames"))
    return intervals.subsegments(v, 150, 75)


@query("SELECT user_id AS key, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS begin_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    out = windows.sliding(table(spark, sf, "events").withColumnRenamed("user_id", "key"), "key", "value", "1 hour")
    return out.select("key", F.unix_seconds("begin").alias("begin_s"), "n", r("total", 4).alias("total"))


@query("""WITH x AS (SELECT user_id, value, epoch_us(ts) AS t, k FROM events, (SELECT unnest(range(0, 2)) AS k)), w AS (SELECT user_id, value, (t // 1800000000 - k) * 1800 AS b FROM x)
SELECT user_id AS key, b AS begin_s, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    out = windows.sliding(table(spark, sf, "events").withColumnRenamed("user_id", "key"), "key", "value", "1 hour", "30 minutes")
    return out.select("key", F.unix_seconds("begin").alias("begin_s"), "n", r("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id AS key, min(t) AS begin_us, max(t) + 7200000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, sf):
    out = windows.sessions(table(spark, sf, "events").withColumnRenamed("user_id", "key"), "key", "2 hours")
    return out.select("key", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH e AS (SELECT user_id AS utt, event_id AS frame, value / 100::DOUBLE AS p FROM events),
t AS (SELECT utt, p, row_number() OVER (PARTITION BY utt ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY utt) AS n,
  sum(CASE WHEN p >= 0.36::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY utt ORDER BY frame ROWS UNBOUNDED PRECEDING) AS piece FROM e),
c AS (SELECT utt, n, piece, min(i) AS f, min(i) FILTER (p < 0.36::DOUBLE - 0.15::DOUBLE) AS q, max(i) FILTER (p < 0.36::DOUBLE - 0.15::DOUBLE) AS l FROM t WHERE piece > 0 GROUP BY utt, n, piece),
k AS (SELECT *, coalesce((l - q) * 0.096::DOUBLE >= 0.1::DOUBLE, false) AS closes FROM c),
s AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY utt ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM k),
x AS (SELECT utt, n, min(f) AS f, max(q) FILTER (closes) AS q FROM s GROUP BY utt, n, island),
y AS (SELECT utt, n * 0.096::DOUBLE AS total, f * 0.096::DOUBLE AS a, coalesce(q, n) * 0.096::DOUBLE AS b FROM x WHERE q IS NULL OR (q - f) * 0.096::DOUBLE > 0.25::DOUBLE),
g AS (SELECT *, a - lag(b) OVER (PARTITION BY utt ORDER BY a) AS gap, lead(a) OVER (PARTITION BY utt ORDER BY a) - b AS room FROM y),
z AS (SELECT utt, CASE WHEN gap IS NULL THEN greatest(0, a - 0.03::DOUBLE) WHEN gap < 0.06::DOUBLE THEN a - gap / 2 ELSE a - 0.03::DOUBLE END AS a,
  CASE WHEN room IS NULL THEN least(total, b + 0.03::DOUBLE) WHEN room < 0.06::DOUBLE THEN b + room / 2 ELSE b + 0.03::DOUBLE END AS b FROM g)
SELECT utt, round(a, 5) AS begin, round(b, 5) AS end FROM z WHERE b - a >= 0.255::DOUBLE""")
def vad_hysteresis(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("frame"), (F.col("value") / 100).alias("p"))
    return intervals.voice_activity(e, threshold=0.36).withColumns({"begin": r("begin"), "end": r("end")})


@query()
def diarization_error(spark, sf):
    v = _spans(spark, sf)
    first = intervals.merge_turns(v, order=("event_id",)).select("utt", F.col("turn_begin").alias("begin"), F.col("turn_end").alias("end"), "label")
    shifted = first.select("utt", (F.col("begin") + 5).alias("begin"), (F.col("end") + 5).alias("end"), F.upper("label").alias("label"))
    return intervals.diarization_error(first, shifted, slot=3600.0)


@query("SELECT user_id AS utt, 'SPEAKER ' || user_id || ' 1 ' || printf('%.6f', epoch_us(ts) / 1000000.0::DOUBLE) || ' ' || printf('%.3f', value) || ' <NA> <NA> ' || event_type || ' <NA> <NA>' AS line FROM events")
def rttm_lines(spark, sf):
    begin = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    line = F.format_string("SPEAKER %s 1 %.6f %.3f <NA> <NA> %s <NA> <NA>", F.col("user_id").cast("string"), begin, F.col("value"), F.col("event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("utt"), line.alias("line"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_parse_props(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.map_values(m)[0].alias("first_value"), F.size(m).cast("long").alias("n_keys"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_scheme(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def grouped_members(spark, sf):
    c = table(spark, sf, "conversations")
    roles = datadir.invert(c, "role", "conv_id", "turn", "roles").select("conv_id", F.array_join("roles", " ").alias("roles"))
    return roles.join(c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n_chars")), "conv_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine scores of the trial list, then equal error rate and detection cost: one row."""
    scores = scoring.cosine_scores(_trials(spark, sf_dir), _sides(spark, sf_dir))
    curve = metrics.det_curve(scores, ties=("enroll", "test"))
    return metrics.equal_error_rate(curve).join(metrics.min_cost(curve))
