"""Queries over token rows, losses, batches, samples and rollouts, with the SQL that gives the same rows.

Tokens come from `events` as in the other catalogue; ids of texts are the lengths of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions import tensors
from turnwise.operators import batches, frames, losses, metrics, rollouts, sampling
from turnwise.plans.registry import query, r6
from turnwise.sources import files
from turnwise.sources.tables import table

_TOKENS = "t AS (SELECT event_id, user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value AS score, (value - 50) / 100 AS a, -ln(1 + abs(value)) AS new, -ln(1.5 + abs(value)) AS old, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask FROM events)"


def tokens(s: SparkSession, d: str) -> DataFrame:
    """event_id, uid, pos, score, advantage, new, old, mask."""
    e = table(s, d, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", F.col("user_id").alias("uid"), "pos", F.col("value").alias("score"), ((F.col("value") - 50) / 100).alias("advantage"), (-F.log(1 + F.abs("value"))).alias("new"), (-F.log(1.5 + F.abs("value"))).alias("old"), (F.col("event_type") != "error").cast("int").alias("mask"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


# ---- losses ------------------------------------------------------------------------------------------------------

_R = "exp(new - old)"


@query(
    "gspo_loss",
    f"""WITH {_TOKENS}, r AS (SELECT *, exp(least(sum((new - old) * mask) OVER (PARTITION BY uid) / greatest(sum(mask) OVER (PARTITION BY uid), 1), 10)) AS r FROM t), l AS (SELECT *, -a * r AS p, -a * greatest(least(r, 1.2), 0.8) AS h FROM r), p AS (SELECT uid, sum(greatest(p, h) * mask) / sum(mask) AS x FROM l GROUP BY uid)
    SELECT round((SELECT avg(x) FROM p), 6) AS loss, round(sum((h > p)::INT * mask) / sum(mask), 6) AS clip_share, round(sum((old - new) * mask) / sum(mask), 6) AS kl FROM l""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("gspo")(tokens(s, d)))


@query("gpg_loss", f"WITH {_TOKENS} SELECT round(sum(-new * a * mask) / sum(mask), 6) AS loss FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("gpg")(tokens(s, d)))


@query(
    "gmpo_loss",
    f"""WITH {_TOKENS}, w AS (SELECT *, new - old AS g, greatest(least(new - old, 0.2), -0.2) AS h FROM t), p AS (SELECT uid, -(sum(a * mask) / sum(mask)) * exp(sum(sign(a) * least(sign(a) * g, sign(a) * h) * mask) / sum(mask)) AS x FROM w GROUP BY uid)
    SELECT round((SELECT avg(x) FROM p), 6) AS loss, round(sum((g <> h AND a > 0)::INT * mask) / sum(mask), 6) AS clip_share, round(sum((g <> h AND a < 0)::INT * mask) / sum(mask), 6) AS lower_share, round(sum(-g * mask) / sum(mask), 6) AS kl FROM w""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("geo_mean")(tokens(s, d)))


_COV = "c AS (SELECT *, CASE WHEN mask > 0 THEN (new - sum(new * mask) OVER () / (sum(mask) OVER () + 1e-8)) * (a - sum(a * mask) OVER () / (sum(mask) OVER () + 1e-8)) END AS cov FROM t)"


@query(
    "clip_cov_loss",
    f"""WITH {_TOKENS}, {_COV}, l AS (SELECT *, -a * {_R} AS p, -a * greatest(least({_R}, 1.2), 0.8) AS h FROM c), o AS (SELECT *, CASE WHEN mask > 0 AND NOT h > p AND cov > -0.5 AND cov < 0.5 THEN md5('0-' || event_id) END AS draw FROM l),
    k AS (SELECT max(draw) AS edge FROM (SELECT draw FROM o WHERE draw IS NOT NULL ORDER BY draw LIMIT (SELECT greatest(1, floor(0.01 * sum(mask))::BIGINT) FROM t))), f AS (SELECT o.*, coalesce(draw <= edge, false) AS off FROM o, k)
    SELECT round(sum(CASE WHEN off THEN 0 ELSE greatest(p, h) END * mask) / sum(mask), 6) AS loss, round(sum(off::INT * mask) / sum(mask), 6) AS clip_share, round(sum((old - new) * mask) / sum(mask), 6) AS kl FROM f""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("clip_cov")(tokens(s, d), share=0.01, bounds=(-0.5, 0.5)))


@query(
    "kl_cov_loss",
    f"""WITH {_TOKENS}, {_COV}, k AS (SELECT min(cov) AS edge FROM (SELECT cov FROM c WHERE cov IS NOT NULL ORDER BY cov DESC LIMIT (SELECT greatest(1, floor(0.01 * sum(mask))::BIGINT) FROM t)))
    SELECT round(sum((-a * {_R} + CASE WHEN cov >= edge THEN abs(new - old) ELSE 0 END) * mask) / sum(mask), 6) AS loss, round(sum(abs(new - old) * mask) / sum(mask), 6) AS kl FROM c, k""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("kl_cov")(tokens(s, d), share=0.01))


@query(
    "vanilla_loss",
    f"""WITH {_TOKENS}, l AS (SELECT *, -a * {_R} AS p, -a * greatest(least({_R}, 1.2), 0.8) AS h FROM t), x AS (SELECT *, CASE WHEN a < 0 THEN least(-a * 3, greatest(p, h)) ELSE greatest(p, h) END AS loss FROM l)
    SELECT round(sum(loss * mask) / sum(mask), 6) AS loss, round(sum((h > p)::INT * mask) / sum(mask), 6) AS clip_share, round(sum((old - new) * mask) / sum(mask), 6) AS kl, round(sum((greatest(p, h) > -a * 3 AND a < 0)::INT * mask) / sum(mask), 6) AS lower_share FROM x""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.loss_named("vanilla")(tokens(s, d)))


@query("loss_norm", f"WITH {_TOKENS}, p AS (SELECT uid, sum(a * mask) AS s, count(*) AS n FROM t GROUP BY uid) SELECT round(sum(s) / max(n), 6) AS loss FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.aggregate_loss(tokens(s, d), "advantage", "mask", "uid", "seq-mean-token-sum-norm"))


@query("value_loss_mean", f"WITH {_TOKENS}, h AS (SELECT *, greatest(least(new, old + 0.5), old - 0.5) AS h FROM t) SELECT round(sum(0.5 * greatest((new - a) * (new - a), (h - a) * (h - a)) * mask) / sum(mask), 6) AS loss, round(sum(((h - a) * (h - a) > (new - a) * (new - a))::INT * mask) / sum(mask), 6) AS clip_share FROM h")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.value_loss_of(tokens(s, d), "new", "old", "advantage", "uid", "mask"))


@query("kl_rewards", f"WITH {_TOKENS} SELECT event_id, round(score - 0.2 * (new - old) * mask, 6) AS reward, round((SELECT avg(x) FROM (SELECT sum((new - old) * mask) / sum(mask) AS x FROM t GROUP BY uid)), 6) AS kl FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    out, metrics = losses.with_kl_penalty(tokens(s, d), losses.kl_control("adaptive", 0.2, 0.1))
    return out.select("event_id", r6("reward").alias("reward"), F.round(F.lit(metrics["reward_kl_penalty"]), 6).alias("kl"))


@query(
    "token_weights",
    f"""WITH {_TOKENS}, w AS (SELECT *, exp(greatest(least(new - old, 20), -20)) AS raw, max(CASE WHEN mask > 0 AND new - old < ln(1.005) THEN 1 ELSE 0 END) OVER (PARTITION BY uid) = 1 AS vetoed FROM t)
    SELECT event_id, round(CASE WHEN vetoed OR mask = 0 THEN 0 WHEN raw BETWEEN 1 / 1.01 AND 1.01 THEN raw ELSE 0 END, 6)::DOUBLE AS weight, raw BETWEEN 1 / 1.01 AND 1.01 AND NOT vetoed AS kept, vetoed FROM w""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return losses.importance_weights(tokens(s, d), "new", "old", "uid", "token", 1.01, mode="mask", mask="mask", veto=1.005).select("event_id", r6("weight").alias("weight"), "kept", "vetoed")


@query(
    "weight_metrics",
    f"""WITH {_TOKENS}, w AS (SELECT uid, mask, {_R} AS raw, greatest(least({_R}, 1.01), 1 / 1.01) AS h, (mask > 0 AND new - old < ln(1.0045)) AS bad FROM t),
    p AS (SELECT uid, sum(mask) AS n, sum(raw * mask) AS w, max(raw) FILTER (WHERE mask > 0) AS hi, min(raw) FILTER (WHERE mask > 0) AS lo, sum(h * mask) AS h, sum(h * h * mask) AS hh, sum((raw > 1.01)::INT * mask) AS above, sum((raw < 1 / 1.01)::INT * mask) AS below, max(bad::INT) AS veto, sum(bad::INT) AS bad, sum(raw * mask) / sum(mask) AS m FROM w GROUP BY uid)
    SELECT round(sum(w) / sum(n), 6) AS weight_mean, round(max(hi), 6) AS weight_max, round(min(lo), 6) AS weight_min, round(sqrt(greatest(sum(hh) / sum(n) - (sum(h) / sum(n)) ** 2, 0)), 6) AS weight_std, round((sum(h) / sum(n)) ** 2 * sum(n) / sum(hh), 6) AS effective_share, round(sum(above) / sum(n), 6) AS share_high, round(sum(below) / sum(n), 6) AS share_low,
      round(avg(veto), 6) AS vetoed_rows, round(sum(bad) / sum(n), 6) AS vetoed_tokens, round(avg(m), 6) AS row_mean, round(stddev_samp(m), 6) AS row_std, round(max(m), 6) AS row_max, round(min(m), 6) AS row_min, round(max(abs(m - 1)), 6) AS row_deviation, round(avg((m > 1.01)::INT), 6) AS row_share_high, round(avg((m < 1 / 1.01)::INT), 6) AS row_share_low FROM p""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.weight_metrics(tokens(s, d), "new", "old", "uid", "mask", 1.01, veto=1.0045))


# ---- logits ------------------------------------------------------------------------------------------------------


def logits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


_LOGITS = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE len(embedding) > 0), z AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS z FROM x)"


@query("logit_entropy", f"WITH {_LOGITS} SELECT vec_id, round(z - list_sum(list_transform(x, lambda v: v * exp(v - z))), 6) AS entropy, round(x[label + 1] - z, 6) AS logprob FROM z")
def _(s: SparkSession, d: str) -> DataFrame:
    return logits(s, d).select("vec_id", r6(tensors.entropy(F.col("x"))).alias("entropy"), r6(tensors.label_logprob(F.col("x"), F.col("label"))).alias("logprob"))


@query("entropy_loss", f"WITH {_LOGITS} SELECT round(avg(z - list_sum(list_transform(x, lambda v: v * exp(v - z)))), 6) AS loss FROM z")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.entropy_loss(logits(s, d).withColumn("mask", F.lit(1)), "x", "vec_id"))


@query("nucleus", f"WITH {_LOGITS}, r AS (SELECT vec_id, i, exp(v - z) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM (SELECT vec_id, z, unnest(x) AS v, unnest(range(len(x))) AS i FROM z)), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) - p AS before FROM r WHERE k <= 20) SELECT vec_id, count(*) AS n, sum(i)::BIGINT AS places FROM c WHERE before < 0.3 GROUP BY vec_id")
def _(s: SparkSession, d: str) -> DataFrame:
    kept = logits(s, d).select("vec_id", F.explode(tensors.nucleus(F.col("x"), 20, 0.3)).alias("i"))
    return kept.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


# ---- padding and training rows -----------------------------------------------------------------------------------


def ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))


_IDS = "i AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::INT) AS ids FROM documents WHERE text IS NOT NULL)"


@query("padded_rows", f"WITH {_IDS} SELECT doc_id, array_to_string(list_concat(list_transform(range(greatest(32 - len(ids), 0)), lambda x: -1), ids), ',') AS left_padded, array_to_string(list_concat(ids[1:16], ids[greatest(17, len(ids) - 15):], list_transform(range(greatest(32 - len(ids), 0)), lambda x: -1)), ',') AS middle FROM i")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.col("ids")
    ones = F.transform(x, lambda _: F.lit(1))
    said = lambda c: F.array_join(c.cast("array<string>"), ",")
    return ids(s, d).select("doc_id", said(tensors.padded(x, 32, -1, True)).alias("left_padded"), said(tensors.fitted(x, ones, 32, -1, False, "middle")["ids"]).alias("middle"))


@query("left_truncated", f"WITH {_IDS} SELECT doc_id, list_sum(ids[greatest(1, len(ids) - 23):])::BIGINT AS kept, len(list_filter(ids, lambda x: x > 3)) AS unpadded FROM i")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.col("ids")
    kept = F.aggregate(tensors.left_truncated(x, 32, 8), F.lit(0), lambda a, v: a + v).cast("long")
    return ids(s, d).select("doc_id", kept.alias("kept"), F.size(tensors.without_padding(x, F.transform(x, lambda v: (v > 3).cast("int")))).cast("long").alias("unpadded"))


@query(
    "supervised_rows",
    f"""WITH {_IDS}, r AS (SELECT doc_id, ids[1:len(ids) // 2] AS p, ids AS x, least(len(ids), 64) AS n, len(ids) // 2 AS np FROM i), c AS (SELECT doc_id, unnest(range(64)) AS k, np, n FROM r)
    SELECT doc_id, sum(CASE WHEN k >= n OR (np > 1 AND k < np - 1) OR k = n - 1 THEN 0 ELSE 1 END)::BIGINT AS learned, min(n) AS valid FROM c GROUP BY doc_id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.size("ids") / 2).cast("int")
    empty = F.array().cast("array<int>")
    row = tensors.supervised_row(F.when(half > 0, F.slice("ids", F.lit(1), half)).otherwise(empty), F.slice("ids", half + 1, F.size("ids")), 64, -1, "right")
    both = ids(s, d).select("doc_id", row.alias("r"))
    return both.select("doc_id", tensors.total(F.col("r.loss_mask")).cast("long").alias("learned"), tensors.total(F.col("r.mask")).cast("long").alias("valid"))


_TURNS = "turns AS (SELECT cid, unnest(curr_messages) AS m, unnest(range(len(curr_messages))) AS pos FROM dialogues)"


@query("dialogue_rows", f"WITH {_TURNS}, i AS (SELECT cid, m.role AS role, len(string_split(coalesce(m.content, ''), ' ')) AS n FROM turns) SELECT cid, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END)::BIGINT AS learned FROM i GROUP BY cid")
def _(s: SparkSession, d: str) -> DataFrame:
    m = F.transform("curr_messages", lambda m: F.struct(m["role"].alias("role"), F.transform(F.split(F.coalesce(m["content"], F.lit("")), " "), lambda w: F.length(w)).alias("ids"), F.lit(None).cast("int").alias("loss_mask")))
    row = table(s, d, "dialogues").where("size(curr_messages) > 0").select("cid", tensors.dialogue_row(m, 2).alias("r"))
    return row.select("cid", F.size("r.ids").cast("long").alias("tokens"), tensors.total(F.col("r.loss_mask")).cast("long").alias("learned"))


@query("preference_rows", f"WITH {_IDS}, p AS (SELECT doc_id, ids, lead(ids) OVER (ORDER BY doc_id) AS other FROM i) SELECT doc_id, least(len(ids), 24) AS chosen, least(len(other), 24) AS rejected, 24 AS width FROM p WHERE other IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    pos = batches.numbered(ids(s, d), "doc_id")
    both = frames.beside(pos, pos.select((F.col("pos") - 1).alias("pos"), F.col("ids").alias("other")))
    pair = both.select("doc_id", tensors.preference_pair(F.col("ids"), F.col("other"), 24, 0).alias("p"))
    valid = lambda k: tensors.total(F.get("p", F.lit(k))["mask"]).cast("long")
    return pair.select("doc_id", valid(0).alias("chosen"), valid(1).alias("rejected"), F.size(F.get("p", F.lit(1))["ids"]).alias("width"))


@query("packed_places", f"WITH {_IDS} SELECT doc_id, array_to_string(list_prepend(0, list_transform(range(1, least(len(ids), 40) + 1), lambda k: list_sum(ids[1:k])::INT)), ',') AS starts, least(len(ids), 40) - 1 AS last_place FROM i")
def _(s: SparkSession, d: str) -> DataFrame:
    first = F.slice("ids", 1, 40)
    places = tensors.position_ids(F.transform(first, lambda _: F.lit(1)))
    return ids(s, d).select("doc_id", F.array_join(tensors.running_lengths(first).cast("array<string>"), ",").alias("starts"), F.element_at(places, -1).cast("long").alias("last_place"))


@query("token_differences", f"WITH {_IDS}, p AS (SELECT doc_id, ids, list_reverse(ids) AS r FROM i) SELECT doc_id, len(list_filter(range(1, len(ids) + 1), lambda k: ids[k] <> r[k] AND ids[k] > 2)) AS n FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.col("ids")
    return ids(s, d).select("doc_id", tensors.mismatched(x, F.reverse(x), F.transform(x, lambda v: (v > 2).cast("int"))).cast("long").alias("n"))


@query(
    "rate_schedules",
    """WITH e AS (SELECT event_id AS k FROM events) SELECT k AS event_id, round(CASE WHEN k < 100 THEN 0.1 + 0.9 * k / 100 ELSE greatest(0.2, cos(pi() * (k - 100) / 4900.0) * 0.4 + 0.6) END, 6) AS cosine, round(least(k / 100.0, 1), 6)::DOUBLE AS constant,
    round(CASE WHEN k < 100 THEN k / 100.0 WHEN k < 2550 THEN 1 WHEN k < 5000 THEN 0.1 + 0.9 * greatest(0, 0.5 * (1 + cos(pi() * (k - 2550) / 2450.0))) ELSE 0.1 END, 6)::DOUBLE AS stable FROM e""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(s, d, "events").select("event_id", r6(tensors.cosine_rate(k, 100, 5000, 0.2, 0.5, 0.1)).alias("cosine"), r6(tensors.constant_rate(k, 100)).cast("double").alias("constant"), r6(tensors.stable_rate(k, 100, 5000, 0.5, 0.1)).cast("double").alias("stable"))


# ---- batches -----------------------------------------------------------------------------------------------------


def orders(s: SparkSession, d: str) -> DataFrame:
    return batches.numbered(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


_ORDERS = "n AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS k FROM orders)"


@query("sliced_rows", f"WITH {_ORDERS} SELECT o_orderkey, pos FROM n WHERE pos >= 10 AND pos < 9000 AND (pos - 10) % 7 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.sliced(orders(s, d), 10, 9000, 7).select("o_orderkey", "pos")


@query("masked_rows", f"WITH {_ORDERS} SELECT o_orderkey, pos FROM n WHERE o_totalprice > 200000")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = orders(s, d)
    return frames.rows_where(rows, rows.select("pos", (F.col("o_totalprice") > 200000).alias("keep"))).select("o_orderkey", "pos")


@query("reordered_rows", f"WITH {_ORDERS} SELECT o_orderkey, k - 1 - pos AS pos, pos AS back FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = orders(s, d).select("o_orderkey", "pos")
    order = rows.select("pos", (F.lit(rows.count()) - 1 - F.col("pos")).alias("place"))
    back = frames.inverse(order).withColumnRenamed("place", "back")
    return frames.beside(frames.reordered(rows, order), back)


@query("generation_split", "SELECT o_orderkey AS uid, o_totalprice, o_custkey FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("uid"), "o_totalprice", F.col("o_custkey").alias("data_source"))
    gen, rest = frames.split_for_generation(rows)
    popped, left = frames.pop_columns(frames.rename_columns(rest, ["data_source"], ["o_custkey"]), "o_custkey", key="uid")
    return gen.join(popped.hint("merge"), "uid").join(left.hint("merge"), "uid")


@query("concatenated_rows", "SELECT part, o_orderkey FROM (SELECT 0 AS part, o_orderkey FROM orders UNION ALL SELECT 1, c_custkey FROM customer)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows, meta = frames.concatenated(table(s, d, "orders").select("o_orderkey"), table(s, d, "customer").select(F.col("c_custkey").alias("o_orderkey")), meta=({"metrics": 1, "t": 2}, {"metrics": [3], "t": 2}))
    assert meta == {"metrics": [1, 3], "t": 2}
    return rows.select("part", "o_orderkey")


@query("folded_rows", f"WITH {_ORDERS} SELECT pos // 10 AS pos, string_agg(o_custkey::VARCHAR, ',' ORDER BY pos) AS customers FROM n GROUP BY pos // 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.folded(orders(s, d), 10, "o_custkey").select("pos", F.array_join(F.col("o_custkey").cast("array<string>"), ",").alias("customers"))


@query("unfolded_rows", f"WITH {_ORDERS} SELECT pos, o_custkey FROM n WHERE pos < k - k % 10")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = orders(s, d)
    whole = frames.folded(rows.where(F.col("pos") < rows.count() // 10 * 10), 10, "o_custkey")
    chunks = frames.unfolded_chunks(whole, 5, "o_custkey")
    return frames.unfolded(chunks, "o_custkey")


@query("padded_with_last", f"WITH {_ORDERS} SELECT pos, o_orderkey FROM n UNION ALL SELECT k + i, o_orderkey FROM n, range(3) r(i) WHERE pos = k - 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.padded_with(orders(s, d).select("pos", "o_orderkey"), 3, "last")


@query("mini_batches", f"WITH {_ORDERS}, e AS (SELECT e, n.* FROM n, range(2) r(e)), p AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY ('0x' || substr(md5('9-' || e || '-' || pos), 1, 8))::BIGINT, pos) - 1 AS place FROM e) SELECT e AS epoch, place // 64 AS batch, o_orderkey FROM p WHERE place // 64 < k // 64")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.mini_batches(orders(s, d), 64, 2, 9, drop_last=True).select(F.col("epoch").cast("long").alias("epoch"), "batch", "o_orderkey")


@query("equal_chunks", f"WITH {_ORDERS} SELECT pos // ((k - k % 4) // 4) AS chunk, count(*) AS n, min(o_orderkey) AS first FROM n WHERE pos < k - k % 4 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = orders(s, d)
    return frames.chunked(rows.where(F.col("pos") < rows.count() // 4 * 4), 4).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("merged_metrics", "SELECT 'x/' || event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("step"))
    m = frames.merged_metrics(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), prefix="x/")
    return m.select("name", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("same_rows", "SELECT true AS same, false AS other")
def _(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "nation")
    return s.createDataFrame([(frames.same_rows(a, a.repartition(3)), frames.same_rows(a, a.limit(3)))], "same boolean, other boolean")


@query("flattened_columns", "SELECT name, parameters.type AS \"parameters/type\" FROM tool_catalog")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.flattened(table(s, d, "tool_catalog").select("name", F.struct("parameters.type").alias("parameters")))


@query("greedy_parts")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", "n_chars")
    rows = [(r["doc_id"], r["n_chars"]) for r in docs.orderBy("doc_id").limit(512).collect()]  # one mini batch
    parts = batches.greedy([n for _, n in rows], 8, False)
    return s.createDataFrame([(rows[i][0], p) for p, part in enumerate(parts) for i in part], "doc_id long, part int")


@query("balanced_ranks")
def _(s: SparkSession, d: str) -> DataFrame:
    pos = batches.numbered(table(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", "n_chars"), "doc_id")
    whole = pos.where(F.col("pos") < pos.count() // 64 * 64).withColumn("mini", F.floor(F.col("pos") / 64))
    return batches.balanced_ranks(whole, "mini", "doc_id", "n_chars", 8)


# ---- sampling ----------------------------------------------------------------------------------------------------


_DASH = " || '-' || "


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5({_DASH.join(parts)}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "resampled_rows",
    f"""WITH w AS (SELECT event_id, greatest(power(abs(value), 2.0) + 1e-8, 1e-8) AS w FROM events), c AS (SELECT *, sum(w) OVER (ORDER BY event_id) - w AS lo, sum(w) OVER () AS total, count(*) OVER () AS n FROM w),
    u AS (SELECT range AS draw, {_u("'3'", 'range')} AS u FROM range((SELECT count(*) FROM events))), p AS (SELECT draw, u * (SELECT max(total) FROM c) AS at FROM u) SELECT draw, event_id FROM p ASOF JOIN c ON p.at >= c.lo""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.resampled(table(s, d, "events"), "event_id", "value")


@query("resample_weights", "SELECT event_id, round(CASE WHEN value = (SELECT max(value) FROM events) OR value = (SELECT min(value) FROM events) THEN 1 ELSE 0 END + 1e-8, 9)::DOUBLE AS max_min, round(CASE WHEN value = (SELECT max(value) FROM events) THEN 0.4 ELSE 0.1 END + 1e-8, 9)::DOUBLE AS max_random FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    edges = e.agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    w = lambda m: F.round(sampling.resample_weights(F.col("value"), m, high=F.col("hi"), low=F.col("lo")), 9).alias(m)
    return e.crossJoin(F.broadcast(edges)).select("event_id", w("max_min"), w("max_random"))


@query("uniform_draws", f"WITH p AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k, count(*) OVER () AS n FROM tool_catalog), u AS (SELECT range AS draw, {_u("'11'", 'range')} AS u FROM range(1000)) SELECT draw, name FROM u JOIN p ON floor(u * n)::BIGINT = k")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.uniform_draws(table(s, d, "tool_catalog").select("name"), "name", 1000)


@query("interleaved_descending", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) - 1 AS pos, count(*) OVER () AS k FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, CASE WHEN pos % 2 = 0 THEN (k + 1) // 2 - 1 - pos // 2 ELSE (k + 1) // 2 + (pos - 1) // 2 END AS place FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.interleaved_descending(table(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "place")


@query("sampled_heads", "(SELECT 'head' AS kind, doc_id FROM documents ORDER BY doc_id LIMIT 40) UNION ALL (SELECT 'random', doc_id FROM documents ORDER BY substr(md5('42-' || doc_id), 1, 8), doc_id LIMIT 40) UNION ALL SELECT 'all', doc_id FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id")
    parts = [sampling.sample_of(docs, "doc_id", n, shuffle).select(F.lit(kind).alias("kind"), "doc_id") for kind, n, shuffle in (("head", 40, False), ("random", 40, True), ("all", -1, False))]
    return parts[0].union(parts[1]).union(parts[2])


@query("logged_samples", "SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY substr(md5('42-' || text), 1, 8), text, doc_id LIMIT 30")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.logged_samples(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text", "doc_id", 30).select("doc_id")


@query("sampler_orders", "SELECT doc_id, doc_id::DOUBLE AS sequential, n_chars::DOUBLE AS curriculum FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    one = frames.ordered_for(docs, key="doc_id").withColumnRenamed("order", "sequential")
    return frames.ordered_for(one, "curriculum", key="doc_id", weight="n_chars").select("doc_id", "sequential", F.col("order").alias("curriculum"))


# ---- rollouts ----------------------------------------------------------------------------------------------------


@query("rollout_ordinals", "WITH n AS (SELECT *, coalesce((event_type IS DISTINCT FROM lag(event_type) OVER w)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS rollout FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return rollouts.ordinals(e, "event_type", "at", "user_id").select("event_id", F.col("rollout").cast("long").alias("rollout"))


def rollout_rows(s: SparkSession, d: str) -> DataFrame:
    """uid, score, reward, length, prompt_length, mask and times of a user's day."""
    e = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("score"), F.count_if(F.col("event_type") != "error").alias("length"), F.count("*").alias("prompt_length"), F.max("value").alias("generation"), F.min("value").alias("calls"), F.min("event_id").alias("key"))
    return e.withColumn("reward", F.col("score") / 2)


_ROLLOUTS = "r AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS score, sum(value) / 2 AS reward, count(*) FILTER (WHERE event_type <> 'error') AS length, count(*) AS prompt_length, max(value) AS generation, min(value) AS calls, min(event_id) AS key FROM events GROUP BY 1, 2)"


def _three(name: str, c: str, where: str = "") -> str:
    w = f" FILTER (WHERE {where})" if where else ""
    return f"round(avg({c}){w}, 5) AS {name}_mean, round(max({c}){w}, 5)::DOUBLE AS {name}_max, round(min({c}){w}, 5)::DOUBLE AS {name}_min"


@query(
    "data_metrics",
    f"WITH {_ROLLOUTS} SELECT {_three('score', 'score', 'length > 0')}, {_three('reward', 'reward', 'length > 0')}, {_three('length', 'length')}, round(avg((length = 5)::INT), 5) AS length_clip, {_three('live_length', 'length', 'length > 0')}, round(avg((length = 5)::INT) FILTER (WHERE length > 0), 5) AS live_length_clip, round(avg((length = 0)::INT), 5) AS aborted, {_three('prompt', 'prompt_length')}, round(avg((prompt_length = 6)::INT), 5) AS prompt_clip FROM r",
)
def _(s: SparkSession, d: str) -> DataFrame:
    m = rollouts.data_metrics(rollout_rows(s, d), 5, 6)
    return m.select(*[F.round(F.col(c).cast("double"), 5).alias(c) for c in m.columns])


@query(
    "token_metrics",
    f"WITH {_TOKENS}, v AS (SELECT * FROM t WHERE mask > 0) SELECT {', '.join(f'round(avg({x}), 5) AS {n}_mean, round(max({x}), 5) AS {n}_max, round(min({x}), 5) AS {n}_min' for n, x in (('advantage', 'a'), ('score', 'score'), ('new', 'new')))}, round(1 - var_samp(score - new) / (var_samp(score) + 1e-5), 5) AS explained_variance FROM v",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(rollouts.token_metrics(tokens(s, d), "advantage", "score", "new"), 5)


@query("stage_timings", f"WITH {_ROLLOUTS}, s AS (SELECT sum(prompt_length) AS p, sum(length) AS l FROM r) SELECT stage, seconds::DOUBLE AS seconds, round(CASE WHEN stage = 'gen' THEN seconds * 1000 / l WHEN stage = 'adv' THEN seconds * 1000 / (p + l) END, 6)::DOUBLE AS ms_per_token FROM (VALUES ('gen', 2.5), ('adv', 1.5), ('step', 9.0)) v(stage, seconds), s")
def _(s: SparkSession, d: str) -> DataFrame:
    stages = s.createDataFrame([("gen", 2.5), ("adv", 1.5), ("step", 9.0)], "stage string, seconds double")
    return rollouts.timings(rollout_rows(s, d), stages).withColumn("ms_per_token", r6("ms_per_token"))


@query("throughput", f"WITH {_ROLLOUTS} SELECT sum(length)::BIGINT AS tokens, 4.0::DOUBLE AS seconds, (sum(length) / (4.0 * 8))::DOUBLE AS per_device FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    return rollouts.throughput(rollout_rows(s, d), 4.0, 8, "length").withColumn("per_device", F.col("per_device").cast("double"))


@query("loop_times", f"WITH {_ROLLOUTS} SELECT min(generation) AS generation_min, max(generation) AS generation_max, round(avg(generation), 5) AS generation_mean, min(calls) AS calls_min, max(calls) AS calls_max, round(avg(calls), 5) AS calls_mean, (SELECT key FROM r ORDER BY generation + calls DESC, key LIMIT 1) AS slowest FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(rollouts.loop_times(rollout_rows(s, d)).withColumn("slowest", F.col("slowest.key")), 5)


@query("placed_scores", f"WITH {_TOKENS}, n AS (SELECT uid, sum(mask) AS n, min(score) AS s, count(*) AS k FROM t GROUP BY uid) SELECT uid, n::BIGINT AS place, round(s, 6) AS score, k - 1 AS zeros FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    g = tokens(s, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("x"), F.min("score").alias("score"))
    rows = rollouts.assembled(g.select("uid", F.reverse(F.array_sort(F.transform("x", lambda x: x["mask"]))).alias("mask"), "score"))
    return rows.select("uid", F.array_position("token_scores", F.col("score")).alias("place"), r6(F.array_max("token_scores")).alias("score"), F.size(F.filter("token_scores", lambda x: x == 0)).cast("long").alias("zeros"))


@query("metric_sections", "WITH m AS (SELECT event_type AS source, CASE WHEN event_type = 'click' THEN 'acc' ELSE v END AS variable, n FROM (SELECT DISTINCT event_type FROM events), (VALUES ('reward'), ('other')) x(v), (VALUES ('mean@2'), ('best@4/mean'), ('std@4')) y(n)) SELECT source, variable, n AS metric, CASE WHEN variable IN ('acc', 'reward') AND n = 'best@4/mean' THEN 'val-core' ELSE 'val-aux' END AS section FROM m")
def _(s: SparkSession, d: str) -> DataFrame:
    kinds = table(s, d, "events").select(F.col("event_type").alias("source")).distinct()
    rows = kinds.select("source", F.explode(F.array(F.lit("reward"), F.lit("other"))).alias("v")).select("source", F.when(F.col("source") == "click", "acc").otherwise(F.col("v")).alias("variable"), F.explode(F.array(*map(F.lit, ("mean@2", "best@4/mean", "std@4")))).alias("metric"))
    return rollouts.core_or_auxiliary(rows).select("source", "variable", "metric", "section")


@query(
    "settled_answers",
    """WITH a AS (SELECT user_id, date_trunc('day', ts) AS day, list(event_type ORDER BY ts, event_id)[1:3] AS x FROM events GROUP BY 1, 2), c AS (SELECT *, list_filter(x, lambda e: e <> 'error') AS u FROM a)
    SELECT user_id, day, CASE WHEN len(x) < 2 THEN 0 WHEN len(x) = 2 THEN CASE WHEN len(u) = 0 THEN 1 WHEN len(u) = 1 THEN 0 WHEN u[1] = u[2] THEN 1 ELSE 0 END WHEN len(u) < 2 THEN 1 WHEN u[1] = u[2] OR u[1] = u[3] OR u[2] = u[3] THEN 1 ELSE -1 END AS verdict FROM c""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    usage = lambda k: F.when(k != "error", F.array(F.struct(k.alias("name"), F.lit("{}").alias("parameters"))))
    answers = F.transform(F.slice("x", 1, 3), lambda x: F.struct(x["event_type"].alias("content"), usage(x["event_type"]).alias("tool_usage")))
    return e.select("user_id", "day", rollouts.settled_answer(answers, F.lit(0))["verdict"].alias("verdict"))


@query("retry_budget", "SELECT cid FROM dialogues WHERE coalesce(wrong_turn_count, 0) <= 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return rollouts.within_budget(table(s, d, "dialogues"), most=1).select("cid")


@query("judge_summary", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS errors, count(*) FILTER (WHERE value > 20 AND value <= 50) AS agreed, round(count(*) FILTER (WHERE value > 20 AND value <= 50) / nullif(count(*) FILTER (WHERE value > 20), 0), 6) AS rate FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    from turnwise.operators import votes

    e = table(s, d, "events").select("event_type", (F.col("value") > 20).alias("called"), (F.col("value") > 50).alias("wrong"), ((F.col("value") > 20) & (F.col("value") <= 50)).alias("consensus"))
    return votes.judge_summary(e, "event_type").withColumn("rate", r6("rate"))


@query("canonical_labels", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    from turnwise.operators import votes

    return votes.canonical_labels(table(s, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "label")


@query("random_days", "SELECT cid, true AS within, true AS weekday FROM dialogues")
def _(s: SparkSession, d: str) -> DataFrame:
    r = rollouts.random_days(table(s, d, "dialogues").select("cid"), "cid")
    return r.select("cid", (F.year("day") == 2023).alias("within"), (F.split("english", ", ")[1] == F.date_format("day", "EEEE")).alias("weekday"))


@query("positional_pairs", f"WITH {_ORDERS}, c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT pos, o_orderkey, c_custkey FROM n JOIN c USING (pos) WHERE pos IN (1, 5, 9)")
def _(s: SparkSession, d: str) -> DataFrame:
    right = batches.numbered(table(s, d, "customer").select("c_custkey"), "c_custkey")
    return files.side_by_side(orders(s, d).select("pos", "o_orderkey"), right, only=(1, 5, 9))


@query("group_moments", "SELECT user_id, CASE WHEN count(*) = 1 THEN 0 ELSE round(avg(value), 6) END::DOUBLE AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(value), 1e-6)) END, 6)::DOUBLE AS std, count(*) AS n FROM events GROUP BY user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.group_moments(table(s, d, "events"), "user_id", "value"))


@query("all_reduced", f"WITH {_TOKENS} SELECT round(avg(score), 5) AS mean, round(max(score), 5) AS high, round(min(score), 5) AS low, round(stddev_pop(score), 5) AS std, round(sum(score * mask) / sum(mask), 5) AS masked FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    t = tokens(s, d)
    return rounded(metrics.all_reduced(t, "score").crossJoin(metrics.masked_reduced(t, "score", "mask").withColumnRenamed("mean", "masked")), 5)


@query("repeated_with_responses", "SELECT o_orderkey, k AS sample, o_custkey + k AS response FROM orders, range(2) r(k)")
def _(s: SparkSession, d: str) -> DataFrame:
    prompts = table(s, d, "orders").select("o_orderkey", "o_custkey")
    answers = batches.repeat(prompts, 2).select("o_orderkey", F.col("copy").cast("long").alias("sample"), (F.col("o_custkey") + F.col("copy")).alias("response"))
    both, _conflicts = batches.union_columns(batches.repeat(prompts.select("o_orderkey"), 2).select(F.struct("o_orderkey", F.col("copy").cast("long").alias("sample")).alias("key")), answers.select(F.struct("o_orderkey", "sample").alias("key"), "response"), "key")
    return both.select("key.o_orderkey", "key.sample", "response")
