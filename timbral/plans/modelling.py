"""Named queries on keyed draws, margins over classes, frames of sub-segments and model files. Importing this adds them to the catalogue."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import draws, vec
from ..operators import augment, backend, frames, margins, scoring
from ..scratch import shared_folder
from ..sources import models
from .catalogue import E_SQL, LONG_SQL, MEAN_SQL, NORM, PSI, _vectors, query, r, table

# --- keyed draws --------------------------------------------------------------------------------


def _draw_sql(key: str, draw: str | int, seed: str = "7") -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '|{seed}|' || ({draw})::VARCHAR), 1, 12))::BIGINT / {1 << 48}::DOUBLE)"


@query(f"SELECT doc_id AS utt, floor({_draw_sql('doc_id', 0)} * 3)::INT AS speed_index, [1.0::DOUBLE, 0.9::DOUBLE, 1.1::DOUBLE][floor({_draw_sql('doc_id', 0)} * 3)::INT + 1] AS speed, n_chars + 1000 * floor({_draw_sql('doc_id', 0)} * 3)::INT AS label FROM documents")
def drawn_speeds(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("n_chars").alias("label"))
    return augment.drawn_speed(d, "utt", "7", 1000).select("utt", "speed_index", "speed", "label")


NOISE_SQL = f"""k AS (SELECT o_orderkey AS utt, CASE WHEN {_draw_sql('o_orderkey', 1)} >= 0.6::DOUBLE THEN 'none' WHEN {_draw_sql('o_orderkey', 2)} < 0.5::DOUBLE THEN 'reverb' ELSE 'noise' END AS augment, {_draw_sql('o_orderkey', 3)} AS u, {_draw_sql('o_orderkey', 4)} AS v FROM orders),
names AS (SELECT 'noise' AS augment, (['noise', 'speech', 'music', 'babble'])[(p_size % 4)::INT + 1] || '-' || p_partkey AS source FROM part UNION ALL SELECT 'reverb', 'room-' || s_suppkey FROM supplier),
placed AS (SELECT *, row_number() OVER (PARTITION BY augment ORDER BY source) - 1 AS place, count(*) OVER (PARTITION BY augment) AS n FROM names),
sizes AS (SELECT augment, count(*) AS n FROM names GROUP BY augment),
c AS (SELECT utt, k.augment, v, floor(u * n)::BIGINT AS place FROM k LEFT JOIN sizes USING (augment)),
met AS (SELECT utt, c.augment, source, v FROM c LEFT JOIN placed p ON p.augment = c.augment AND p.place = c.place)
SELECT utt, augment, source, CASE WHEN augment = 'noise' THEN round(CASE WHEN source LIKE 'speech%' THEN 10 + v * 20 WHEN source LIKE 'music%' THEN 5 + v * 10 ELSE v * 15 END, 6) END AS snr_db FROM met"""


@query(f"WITH {NOISE_SQL}")
def drawn_noises(spark, sf):
    kinds = F.array(*map(F.lit, ("noise", "speech", "music", "babble")))
    noises = table(spark, sf, "part").select(F.concat(F.element_at(kinds, (F.col("p_size") % 4).cast("int") + 1), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"))
    rooms = table(spark, sf, "supplier").select(F.concat(F.lit("room-"), F.col("s_suppkey").cast("string")).alias("name"))
    utts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("utt"))
    return augment.drawn_noise(utts, noises, rooms, "utt", "7").select("utt", "augment", "source", r("snr_db", 6).alias("snr_db"))


def _span_sql(draw: int, size: int, most: int) -> str:
    first = f"floor({_draw_sql('utt', draw)} * {size})"
    return f"{first} AS a{draw}, least({first} + 1 + floor({_draw_sql('utt', draw + 1)} * {most}), {size}) AS z{draw}"


@query(f"""WITH {E_SQL}, {LONG_SQL}, s AS (SELECT utt, {_draw_sql('utt', 5)} < 0.6::DOUBLE AS masked, {_span_sql(6, 8, 3)}, {_span_sql(10, 8, 3)}, {_span_sql(8, 8, 2)} FROM e)
SELECT utt, pos, round(CASE WHEN masked AND ((pos // 8 >= a6 AND pos // 8 < z6) OR (pos // 8 >= a10 AND pos // 8 < z10) OR (pos % 8 >= a8 AND pos % 8 < z8)) THEN 0 ELSE x END, 5) AS x FROM long JOIN s USING (utt)""")
def masked_features(spark, sf):
    """Vectors as eight frames of eight bins, with two masks in time and one in frequency."""
    v = _vectors(spark, sf).select("utt", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("emb", t * 8 + 1, 8)).alias("feat"))
    out = augment.masked(v, "utt", "7", time_masks=2, bin_masks=1, most_frames=3, most_bins=2)
    return out.select("utt", F.posexplode(F.flatten("feat")).alias("pos", "x")).withColumn("x", r("x"))


# --- margins over classes -----------------------------------------------------------------------

# Two centres a class: the means of its vectors with even and with odd ids.
SUB_SQL = f"""sub AS (SELECT spk AS cls, odd, list(m ORDER BY pos) AS c FROM (SELECT spk, utt % 2 AS odd, pos, avg(x) AS m FROM long GROUP BY ALL) GROUP BY spk, odd),
cs AS (SELECT utt, spk, cls, max(list_dot_product(emb, c) / ({NORM.format('emb')} * {NORM.format('c')})) AS s FROM e, sub GROUP BY utt, spk, cls)"""


def _sub_centres(spark, sf):
    v = _vectors(spark, sf).withColumn("part", F.col("spk") * 2 + F.col("utt") % 2)
    return scoring.mean_vector(v, "emb", "part").select(F.floor(F.col("part") / 2).alias("cls"), F.col("mean").alias("emb"))


def _samples(spark, sf):
    return _vectors(spark, sf).select("utt", F.col("spk").alias("cls"), "emb")


_M, _LOW = 0.2, 0.06
_RAISED = f"CASE WHEN s > {math.cos(math.pi - _M)!r}::DOUBLE THEN s * {math.cos(_M)!r}::DOUBLE - sqrt(greatest(1 - s * s, 0)) * {math.sin(_M)!r}::DOUBLE ELSE s - {1 + math.cos(math.pi - _M)!r}::DOUBLE END"
_LOWERED = f"(s * {math.cos(_LOW)!r}::DOUBLE + sqrt(greatest(1 - s * s, 0)) * {math.sin(_LOW)!r}::DOUBLE)"


@query(f"""WITH {E_SQL}, {LONG_SQL}, {SUB_SQL},
ranked AS (SELECT *, spk = cls AS mine, row_number() OVER (PARTITION BY utt, spk = cls ORDER BY s DESC, cls) AS n FROM cs),
l AS (SELECT utt, mine, n, 32 * CASE WHEN mine THEN {_RAISED} WHEN n <= 5 THEN {_LOWERED} ELSE s END AS logit FROM ranked)
SELECT utt, round(max(CASE WHEN mine THEN logit END), 4) AS own_logit, round(sum(CASE WHEN NOT mine AND n <= 5 THEN logit END), 4) AS hard_logits, count(*) AS n_classes, round(ln(sum(exp(logit - 32))) + 32 - max(CASE WHEN mine THEN logit END), 4) AS loss FROM l GROUP BY utt""")
def hardest_margin(spark, sf):
    out = margins.hardest_margin(_samples(spark, sf), _sub_centres(spark, sf))
    hard = F.aggregate("hard", F.lit(0.0), lambda s, h: s + h["logit"])
    return out.select("utt", r("own_logit", 4).alias("own_logit"), r(hard, 4).alias("hard_logits"), "n_classes", r("loss", 4).alias("loss"))


@query(f"""WITH {E_SQL}, {LONG_SQL}, {SUB_SQL}, g AS (SELECT utt, spk = cls AS mine, s, 2 * pow((s + 1) / 2, 3) - 1 AS g FROM cs)
SELECT utt, round(max(CASE WHEN mine THEN 32 * (s - 0.2::DOUBLE) END), 4) AS own_logit, round(sum(CASE WHEN mine THEN 0.7::DOUBLE * ln(1 + exp(-32 * (g - 0.2::DOUBLE))) ELSE 0.3::DOUBLE * ln(1 + exp(32 * (g + 0.2::DOUBLE))) END), 4) AS loss FROM g GROUP BY utt""")
def pairwise_binary_loss(spark, sf):
    return margins.pairwise_binary(_samples(spark, sf), _sub_centres(spark, sf)).select("utt", r("own_logit", 4).alias("own_logit"), r("loss", 4).alias("loss"))


# --- frames of sub-segments ---------------------------------------------------------------------

# A recording has 400 vectors as its frames, and three segments: short, of one piece and of many.
FRAMES_SQL = f"""f AS (SELECT vec_id // 400 AS rec, vec_id % 400 AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS cells FROM embeddings),
n AS (SELECT rec, max(frame) + 1 AS n FROM f GROUP BY rec),
seg AS (SELECT rec * 3 AS seg, rec, 0 AS origin, n // 16 AS len FROM n UNION ALL SELECT rec * 3 + 1, rec, n // 16, n // 3 - n // 16 FROM n UNION ALL SELECT rec * 3 + 2, rec, n // 3, n - n // 3 FROM n),
pieces AS (SELECT *, unnest(CASE WHEN len <= 150 THEN [0] ELSE range(0, len - 150 + 75, 75) END)::BIGINT AS b FROM seg WHERE len > 0),
ends AS (SELECT *, least(b + 150, len) AS z FROM pieces),
places AS (SELECT *, unnest(range(0, 150)) AS p FROM ends),
long AS (SELECT seg, origin, len, b, z, p, unnest(range(0, len(cells)))::INT AS bin, unnest(cells) AS x FROM places JOIN f ON f.rec = places.rec AND f.frame = origin + b + p % (z - b))"""
PIECE_SQL = "SELECT seg, b AS first, z AS last, bin, round(sum((p + 1) * (x - {0})), 3) AS weighted, round(max(CASE WHEN p = 149 THEN x - {0} END), 5) AS at_end FROM {1} GROUP BY seg, b, z, bin"


def _pieces(spark, sf, normalise):
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 400).alias("rec"), (F.col("vec_id") % 400).alias("frame"), F.col("embedding").alias("cells"))
    n = rows.groupBy("rec").agg((F.max("frame") + 1).alias("n"))
    a, b = F.floor(F.col("n") / 16), F.floor(F.col("n") / 3)
    cuts = F.array(*(F.struct((F.col("rec") * 3 + i).alias("seg"), first.alias("first"), count.alias("n_frames")) for i, (first, count) in enumerate(((F.lit(0).cast("long"), a), (a, b - a), (b, F.col("n") - b)))))
    segments = n.select("rec", F.explode(cuts).alias("s")).select("rec", "s.*")
    pieces = frames.piece_frames(segments, frames.blocks_of_rows(rows), normalise=normalise)
    long = pieces.select("seg", F.col("begin").alias("first"), F.col("end").alias("last"), F.posexplode("feat").alias("p", "cells")).select("seg", "first", "last", "p", F.posexplode("cells").alias("bin", "x"))
    sums = long.groupBy("seg", "first", "last", "bin").agg(F.sum((F.col("p") + 1) * F.col("x")).alias("weighted"), F.max(F.when(F.col("p") == 149, F.col("x"))).alias("at_end"))
    return sums.select("seg", "first", "last", "bin", r("weighted", 3).alias("weighted"), r("at_end").alias("at_end"))


@query(f"WITH {FRAMES_SQL}, m AS (SELECT *, avg(x) OVER (PARTITION BY seg, b, bin) AS m FROM long) {PIECE_SQL.format('m', 'm')}")
def pieces_normalised_after(spark, sf):
    """Frames of sub-segments, less the mean of each filled piece."""
    return _pieces(spark, sf, "piece")


@query(f"""WITH {FRAMES_SQL}, whole AS (SELECT seg, unnest(range(0, len(cells)))::INT AS bin, unnest(cells) AS x FROM seg JOIN f ON f.rec = seg.rec AND frame >= origin AND frame < origin + seg.len),
means AS (SELECT seg, bin, avg(x) AS m FROM whole GROUP BY seg, bin), m AS (SELECT long.*, m FROM long JOIN means USING (seg, bin)) {PIECE_SQL.format('m', 'm')}""")
def pieces_normalised_before(spark, sf):
    """Frames of sub-segments, less the mean of the whole segment."""
    return _pieces(spark, sf, "segment")


# --- model files --------------------------------------------------------------------------------


@query(f"""WITH {E_SQL}, {LONG_SQL}, {MEAN_SQL}, a AS (SELECT utt, list_transform(range(1, 65), lambda i: emb[i] - m[i]) AS v FROM e, mv),
b AS (SELECT utt, list_transform(v, lambda x: x / {NORM.format('v')}) AS w FROM a),
m2 AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(0, 64))::INT AS pos, unnest(w) AS x FROM b) GROUP BY pos))
SELECT utt, unnest(range(0, 64))::INT AS pos, round(unnest(list_transform(range(1, 65), lambda i: w[i] - m[i])), 5) AS x FROM b, m2""")
def chain_replaced(spark, sf):
    """A chain that is saved and loaded, and whose last link is replaced by one fitted behind the others."""
    v, path = _vectors(spark, sf), f"{shared_folder(spark)}/chain"
    models.save_chain(spark, backend.fit_chain("mean-subtract | length-norm | length-norm", v), path)
    links = models.replaced_link(models.load_chain(spark, path), 2, "mean-subtract", v)
    return backend.chained(v.select("utt", "emb"), links).select("utt", F.posexplode("emb").alias("pos", "x")).withColumn("x", r("x"))


# Neighbours by id are the trials; the transform turns the order of the coordinates around and scales them.
@query(f"""WITH {E_SQL}, {LONG_SQL}, {MEAN_SQL}, t AS (SELECT utt, spk, list_transform(range(1, 65), lambda i: (emb[65 - i] - m[65 - i]) * (1 + i / 64.0::DOUBLE)) AS z FROM e, mv),
p AS (SELECT list_transform(range(0, 64), lambda i: 1.0::DOUBLE / (i + 1)) AS psi),
n AS (SELECT utt, list_transform(z, lambda x: x * sqrt(64 / list_sum(list_transform(range(1, 65), lambda i: z[i] * z[i] / (psi[i] + 1))))) AS z FROM t, p),
j AS (SELECT a.utt AS enroll, b.utt AS test, a.z AS x, b.z AS y, psi FROM n a JOIN n b ON b.utt = a.utt + 1, p),
s AS (SELECT enroll, test, -0.5::DOUBLE * list_sum(list_transform(range(1, 65), lambda i: ln(1 + psi[i] / (psi[i] + 1)) + pow(y[i] - psi[i] / (psi[i] + 1) * x[i], 2) / (1 + psi[i] / (psi[i] + 1))))
 + 0.5::DOUBLE * list_sum(list_transform(range(1, 65), lambda i: ln(1 + psi[i]) + y[i] * y[i] / (1 + psi[i]))) AS s FROM j)
SELECT enroll, test, round(s, 4) AS from_binary, round(s, 4) AS from_text FROM s""")
def plda_from_files(spark, sf):
    """Likelihood ratios by a model that is written as a binary and as a text file, and read back."""
    v, folder = _vectors(spark, sf), shared_folder(spark)
    n, total, _ = backend.moments(v)
    plda = backend.Plda(total / n, np.diag(1 + np.arange(1, 65) / 64)[:, ::-1], np.array(PSI))
    trials = v.select(F.col("utt").alias("enroll"), (F.col("utt") + 1).alias("test")).join(v.select(F.col("utt").alias("test")), "test", "left_semi")
    enroll, test = v.select("utt", "emb", F.lit(1).alias("n")), v.select("utt", "emb")
    out = trials
    for name, binary in (("from_binary", True), ("from_text", False)):
        models.write_plda(plda, f"{folder}/{name}", binary)
        scored = backend.plda_scores(models.read_plda(spark, f"{folder}/{name}"), trials, enroll, test)
        out = out.join(scored.select("enroll", "test", r("score", 4).alias(name)), ["enroll", "test"])
    return out.select("enroll", "test", "from_binary", "from_text")
