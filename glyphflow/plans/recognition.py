"""Queries over class posteriors, typography, scores and latency, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.functions import text
from glyphflow.operators import correct, ctc
from glyphflow.plans import reports
from glyphflow.plans.fixtures import FRAMES, OCR_PAIRS, frames, ocr_pairs, table

VIEWS = f"""{FRAMES},
best AS (
  SELECT roi_id, t, first(cls ORDER BY v DESC, cls) AS label, max(v) AS score FROM frames GROUP BY roi_id, t),
lagged AS (SELECT *, label <> 0 AND label <> lag(label, 1, -1) OVER (PARTITION BY roi_id ORDER BY t) AS starts FROM best),
runs AS (SELECT *, (sum(starts::INT) OVER (PARTITION BY roi_id ORDER BY t) - 1)::INT AS cell FROM lagged),
tokens AS (SELECT roi_id, cell, label, score FROM runs WHERE starts),
collapsed AS (
  SELECT roi_id, coalesce(string_agg(label::VARCHAR, ',' ORDER BY cell), '') AS ids, count(label)::BIGINT AS n, coalesce(avg(score), 0) AS confidence
  FROM (SELECT DISTINCT roi_id FROM frames) LEFT JOIN tokens USING (roi_id) GROUP BY roi_id)"""
CELLS = f"""{VIEWS},
peaks AS (
  SELECT roi_id, cell, label, first(t ORDER BY score DESC, t) AS peak_t, max(score) AS peak FROM runs WHERE label <> 0 GROUP BY ALL),
bounds AS (
  SELECT *, coalesce((lag(peak_t) OVER w + peak_t) // 2 + 1, 0) AS low, coalesce((peak_t + lead(peak_t) OVER w) // 2, 2147483647) AS high
  FROM peaks WINDOW w AS (PARTITION BY roi_id ORDER BY cell)),
owned AS (SELECT f.*, b.cell, b.label FROM frames f JOIN bounds b ON f.roi_id = b.roi_id AND f.t BETWEEN b.low AND b.high),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY roi_id, cell ORDER BY p DESC, cls) AS rank
  FROM (SELECT roi_id, cell, cls, max(v) AS p FROM owned WHERE cls <> 0 GROUP BY ALL))"""


def _ids(column: str = "token_ids"):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",")


def _views(spark, sf_dir):
    """The regions, and as a second view of each those of the next one."""
    a = ctc.collapsed(frames(spark, sf_dir))
    return a, a.withColumn("roi_id", F.col("roi_id") - 1)


def ctc_collapse(spark, sf_dir):
    return ctc.collapsed(frames(spark, sf_dir)).select("roi_id", _ids().alias("token_ids"), "token_count", F.round("confidence", 6).alias("confidence"))


def ctc_peaks(spark, sf_dir):
    return ctc.peaks(frames(spark, sf_dir)).select("roi_id", "cell", "label", "peak_t", F.round("peak", 6).alias("peak"), "low", "high")


def ctc_cells_top(spark, sf_dir):
    return ctc.candidates(frames(spark, sf_dir), 4).select("roi_id", "cell", "cls", F.round("p", 6).alias("p"), "rank")


def ctc_margins(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return ctc.evidence(frames(spark, sf_dir)).select("roi_id", "cell", "label", r("margin"), r("log_margin"), "keep_rank", r("blank_max"), r("blank_mean"))


def ctc_posterior(spark, sf_dir):
    return ctc.posterior(frames(spark, sf_dir)).select("roi_id", "t", "cls", F.round("v", 9).alias("v"))


def gate_consistency(spark, sf_dir):
    return ctc.consistent(*_views(spark, sf_dir), thresholds=(0.05, 0.08, 0.10, 0.12, 0.14, 0.15))


def hallucination_rate(spark, sf_dir):
    a, b = _views(spark, sf_dir)
    scaled = lambda d: d.withColumn("confidence", 0.7 + 2 * F.col("confidence"))
    return ctc.hallucination(scaled(a), scaled(b), prior=0.3).select("roi_id", F.round("rate", 9).alias("rate"))


_CUBE = ", ".join(f"({s}, {c}, {n}, {t}, {o})" for s, c, n, t, o in ctc.calibration())


def gate_supplement(spark, sf_dir):
    regions = ctc.collapsed(frames(spark, sf_dir)).select("*", (F.col("roi_id") % 2 == 1).alias("supplemental"), (F.col("roi_id") % 7 == 0).alias("fallback"), (F.col("confidence") * 0.8).alias("area_ratio"), (F.col("roi_id") % 90).cast("double").alias("distance"))
    return ctc.supplement_gate(regions, allowed=[1, 2, 3, 4, 5, 6], confidence=0.14).select("roi_id", "accepted")


def packed_positions(spark, sf_dir):
    cells = ctc.peaks(frames(spark, sf_dir)).select(F.shiftright("roi_id", 3).alias("image_id"), F.col("roi_id").alias("roi"), "cell")
    r = lambda c: F.round(c, 9).alias(c)
    return ctc.placed(cells).select("image_id", "roi", "cell", F.col("position").cast("long").alias("position"), "starts", r("ahead"), r("behind"), r("length"), "is_first", "is_last")


def _scored(spark, sf_dir):
    cells = ctc.candidates(frames(spark, sf_dir), 16)
    keep = ctc.peaks(frames(spark, sf_dir)).select("roi_id", "cell", F.col("label").alias("keep"))
    rows = cells.join(keep, ["roi_id", "cell"])
    score = correct.candidate_score(F.col("cls") * 0.5 + F.col("cell") * 0.25, F.log(F.greatest("p", F.lit(1e-6))), 4, 0.1, F.col("rank") * -0.125, F.col("cls") == F.col("keep"), 0.5)
    return rows.select(F.col("roi_id").alias("block"), "cell", "keep", "cls", correct.rounded(score, 6).alias("score"), (F.col("cls") != 7).alias("can"))


def _decided(spark, sf_dir):
    return correct.replacements(_scored(spark, sf_dir), 1.0, digits=6)


_SCORED = f"""{CELLS},
scored AS (
  SELECT r.roi_id AS block, r.cell, b.label AS keep, r.cls, r.cls <> 7 AS can,
    round((r.cls * 0.5::DOUBLE + r.cell * 0.25::DOUBLE) / 2 + exp(0.1::DOUBLE) * ln(greatest(p, 1e-6::DOUBLE)) + rank * -0.125::DOUBLE + CASE WHEN r.cls = b.label THEN 0.5::DOUBLE ELSE 0 END, 6) AS score
  FROM ranked r JOIN bounds b ON r.roi_id = b.roi_id AND r.cell = b.cell WHERE rank <= 16),
kept AS (SELECT block, cell, score, can FROM scored WHERE cls = keep),
others AS (SELECT block, cell, first(cls ORDER BY score DESC, cls) AS best, max(score) AS score, first(can ORDER BY score DESC, cls) AS can FROM scored WHERE cls <> keep GROUP BY ALL),
decided AS (
  SELECT c.block, c.cell, c.keep, o.best, round(o.score - k.score, 6) AS margin,
    coalesce(round(o.score - k.score, 6) > 1.0 AND k.can AND o.can AND count(*) OVER (PARTITION BY c.block) <= 64, FALSE) AS replaced
  FROM (SELECT DISTINCT block, cell, keep FROM scored) c LEFT JOIN kept k ON c.block = k.block AND c.cell = k.cell LEFT JOIN others o ON c.block = o.block AND c.cell = o.cell)"""


def replace_decision(spark, sf_dir):
    return _decided(spark, sf_dir)


def assembled_blocks(spark, sf_dir):
    return correct.assembled(_decided(spark, sf_dir)).select("block", _ids().alias("token_ids"), "token_count", "edited")


def offline_correction(spark, sf_dir):
    """Blocks whose kept classes all are candidates, corrected at 1, with the proposals above 0.5."""
    scored = _scored(spark, sf_dir)
    whole = scored.groupBy("block", "cell").agg(F.bool_or(F.col("cls") == F.col("keep")).alias("has")).groupBy("block").agg(F.bool_and("has").alias("has")).where("has")
    out = correct.offline(scored.join(whole.select("block"), "block", "left_semi"), 1.0, 0.5)
    told = F.array_join(F.transform("proposals", lambda z: F.concat_ws(":", z["cell"], z["best"], F.round(z["margin"] * 1000).cast("long"))), ",")
    return out.select("block", _ids().alias("token_ids"), F.col("edits").cast("long").alias("edits"), F.col("cells").cast("long").alias("cells"), told.alias("proposals"))


def family_decision(spark, sf_dir):
    """Replacements by thresholds of the kept character's family, classes 1 to 7 standing for "aあア漢1%b"."""
    char = F.substring(F.lit("aあア漢1%b"), F.col("keep"), F.lit(1))
    limits = correct.by_family(char, {"latin": 0.5, "hiragana": 0.75, "katakana": 1.0, "han": 1.25, "digit": 1.5}, 5.0)
    return correct.replacements(_scored(spark, sf_dir), limits).select("block", "cell", "replaced")


def edited_block_count(spark, sf_dir):
    return correct.edited_blocks(correct.assembled(_decided(spark, sf_dir)))


def option_sets(spark, sf_dir):
    """What each cell's character may be, classes 1 to 7 standing for "aあー漢1%b"; two of each three cells are asked about."""
    char = lambda i: F.substring(F.lit("aあー漢1%b"), i, F.lit(1))
    cells = _scored(spark, sf_dir).groupBy("block", "cell", "keep").agg(F.transform(F.array_sort(F.collect_set("cls")), lambda c: c).alias("ids"))
    sets = correct.options(char(F.col("keep")), F.transform("ids", char))
    asked = correct.masked(F.col("ids"), F.array(F.lit(0), F.lit(2)), 9)
    return cells.select("block", "cell", F.array_join(F.array_sort(sets), "").alias("options"), F.array_join(F.transform(asked, lambda i: i.cast("string")), ",").alias("asked"))


def scattered_results(spark, sf_dir):
    """Every slot of an image of eight, with the results of those regions whose number isn't a multiple of three."""
    done = ctc.collapsed(frames(spark, sf_dir)).select(F.shiftright("roi_id", 3).alias("image_id"), (F.col("roi_id") % 8).alias("slot"), "roi_id", "token_ids", "confidence")
    out = ctc.scattered(done.select("image_id", "slot"), done.where("roi_id % 3 <> 0").drop("roi_id"))
    return out.select("image_id", "slot", _ids().alias("token_ids"), F.round("confidence", 6).alias("confidence"), "valid")


def suspicious_cells(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return correct.suspicious(decided).select("block", "cell", "margin", "rank")


def verifier_decision(spark, sf_dir):
    rows = _decided(spark, sf_dir).where("margin is not null")
    rows = rows.select("block", "cell", "replaced", F.col("margin").alias("normal"), (F.col("margin") / 2).alias("masked"), F.lit(0.25).alias("l0"), (F.col("margin") / 4).alias("l1"), F.col("margin").alias("l2"))
    return correct.verified(rows).select("block", "cell", F.round("blended", 9).alias("blended"), F.round("log_odds", 9).alias("log_odds"), "decided")


def editable_characters(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", "n", correct.editable(F.col("ch")).alias("editable"), correct.family(F.col("ch")).alias("family"))


def decoded_tokens(spark, sf_dir):
    rows = ctc.collapsed(frames(spark, sf_dir))
    chars = F.array(*map(F.lit, "abcdefg"))
    zero = F.transform("token_ids", lambda i: i - 1)
    return rows.select("roi_id", correct.decoded(zero, F.least("token_count", F.lit(5)).cast("int"), chars).alias("text"), F.array_join(F.transform(correct.model_input(F.col("token_ids"), 8), lambda i: i.cast("string")), ",").alias("model_input"))


def norm_adapter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.adapted(F.concat("text", F.lit(" ... ．．．． .. ．"), F.repeat(F.lit("."), (F.col("doc_id") % 9).cast("int")))).alias("adapted"))


_SPECIAL = "!!?・・・・・・・ーー ..〜〜〜『x』"


def norm_key(spark, sf_dir):
    """Keys of ASCII texts with marks inserted, natively."""
    shown = F.translate(F.regexp_replace("text", "[^ -~]", "?"), ".,;", "!?~")
    return table(spark, sf_dir, "documents").select("doc_id", text.shown(text.key(F.concat(shown, F.lit(_SPECIAL), F.repeat(F.lit("."), (F.col("doc_id") % 9).cast("int"))), ascii_only=True)).alias("display"))


def norm_folded(spark, sf_dir):
    """Keys of whole texts through the grapheme step."""
    return table(spark, sf_dir, "documents").select("doc_id", text.key(F.col("text")).alias("key"))


# Sources and what they are shown as.
VECTORS = {"!!?": "!?", "!!??": "!?", "!??": "!?", "??!": "?!", "!!!": "!!", "????": "??", "!": "!", "?": "?", "・・": "・・", "・・・": "・・・", "・・・・・・": "・・・", "・・・・・・・": "・・・・・・", "ー": "ー", "ーーー": "ーー", "〜": "〜", "〜〜〜": "〜〜"}


def norm_punct_vectors(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in VECTORS], "source string")
    return rows.select("source", text.display(F.col("source")).alias("display"), (text.key(text.key(F.col("source"))) == text.key(F.col("source"))).alias("idempotent"))


def _score(spark, sf_dir, subset=None):
    pairs = ocr_pairs(spark, sf_dir)
    if subset:
        pairs = pairs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id")).distinct(), "sample_id", "left_semi")
    key = lambda c: text.key(F.col(c), ascii_only=True)
    return reports.score(pairs, key("reference"), key("prediction")).withColumns({c: F.round(c, 9) for c in ("em", "cer")})


def em_cer_all(spark, sf_dir):
    return _score(spark, sf_dir)


def em_cer_heldout(spark, sf_dir):
    return _score(spark, sf_dir, "labels")


def em_cer_populations(spark, sf_dir):
    """All pairs and the labelled ones, in one pass."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.lit(True).alias("known")).distinct()
    key = lambda c: text.key(F.col(c), ascii_only=True)
    out = reports.score_both(ocr_pairs(spark, sf_dir).join(known, "sample_id", "left"), key("reference"), key("prediction"), F.col("known"))
    return out.withColumns({c: F.round(c, 9) for c in ("em", "cer")})


def em_cer_unfolded(spark, sf_dir):
    pairs = ocr_pairs(spark, sf_dir)
    return reports.score(reports.predictions(pairs, text.key), F.col("normalized_reference"), F.col("normalized_prediction"))


def oracle_distance(spark, sf_dir):
    """The least distance of each prediction to a lattice that may repeat or drop its first character."""
    pairs = ocr_pairs(spark, sf_dir)
    first = F.substring("prediction", 1, 1)
    sets = F.array(F.array(first, F.concat(first, first), F.lit("")), F.array(F.expr("substring(prediction, 2)")))
    return pairs.select("sample_id", text.lattice(sets, F.col("reference")).alias("distance"))


def _latency(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id"), "event_type", F.col("value").alias("ms"), (F.col("user_id") % 80 + 1).alias("n"))


_LATENCY = "events_ms AS (SELECT event_id, event_type, value AS ms, user_id % 80 + 1 AS n FROM events)"


def latency_buckets(spark, sf_dir):
    out = reports.by_length(_latency(spark, sf_dir), F.col("ms"), F.col("n"))
    return out.select("place", "bucket", "samples", *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p90_ms", "p95_ms", "p99_ms")))


def latency_slope(spark, sf_dir):
    return reports.trend(_latency(spark, sf_dir), F.col("ms"), F.col("n")).select(*(F.round(c, 8).alias(c) for c in ("slope", "correlation", "median_ms")))


def p90_reference(spark, sf_dir):
    return reports.nearest_p90(_latency(spark, sf_dir), "ms", "event_type")


def throughput(spark, sf_dir):
    batches = _latency(spark, sf_dir).groupBy(F.expr("event_id div 64").alias("batch")).agg(F.sum(F.abs("ms")).alias("ms"), F.count("*").alias("items"), F.max("event_type").alias("prediction"))
    return reports.speed(batches, F.col("ms"), F.col("items"), F.col("prediction")).withColumns({c: F.round(c, 6) for c in ("batch_mean_ms", "batch_p50_ms", "batch_p90_ms", "per_item_ms", "items_per_second")})


def latency_pairs(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return reports.matched(left, right, "o_custkey", "c_custkey", "c_acctbal")


def parameter_report(spark, sf_dir):
    """Values of embeddings: all, those of labelled vectors, and those above zero."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.agg(F.sum(F.size("embedding")).cast("long").alias("total"), F.sum(F.when(F.col("label") > 0, F.size("embedding")).otherwise(0)).cast("long").alias("labelled"), F.sum(F.size(F.filter("embedding", lambda v: v > 0))).cast("long").alias("positive"))


def seeded_sample(spark, sf_dir):
    return reports.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 500)


_KEYED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(replace({0}, ' ', '')), '\.{{7,}}', '······', 'g'), '\.{{3,6}}', '···', 'g'), '~{{2,}}', '~~', 'g'), '!+\?[!?]*', '!?', 'g'), '\?+![!?]*', '?!', 'g'), '!{{2,}}', '!!', 'g'), '\?{{2,}}', '??', 'g'), '~', '〜', 'g')"""
_K = lambda c: _KEYED.format(c)
_SCORE = f"""SELECT count(*)::BIGINT AS samples, count(*) FILTER (r = p)::BIGINT AS exact_matches, sum(levenshtein(r, p))::BIGINT AS edit_distance,
  sum(length(r))::BIGINT AS reference_characters, round(count(*) FILTER (r = p) / count(*), 9) AS em, round(sum(levenshtein(r, p)) / sum(length(r)), 9) AS cer
FROM (SELECT replace({_K('reference')}, '〜', '~') AS r, replace({_K('prediction')}, '〜', '~') AS p, sample_id FROM pairs)"""

QUERIES = {f.__name__: f for f in (ctc_collapse, ctc_peaks, ctc_cells_top, ctc_margins, ctc_posterior, gate_consistency, hallucination_rate, gate_supplement, packed_positions, replace_decision, assembled_blocks, offline_correction, family_decision, edited_block_count, option_sets, scattered_results, suspicious_cells, verifier_decision, editable_characters, decoded_tokens, norm_adapter, norm_key, norm_folded, norm_punct_vectors, em_cer_all, em_cer_heldout, em_cer_populations, em_cer_unfolded, oracle_distance, latency_buckets, latency_slope, p90_reference, throughput, latency_pairs, parameter_report, seeded_sample)}

_BUCKET = "CASE WHEN n <= 1 THEN '01' WHEN n <= 2 THEN '02' WHEN n <= 4 THEN '03-04' WHEN n <= 8 THEN '05-08' WHEN n <= 16 THEN '09-16' WHEN n <= 32 THEN '17-32' WHEN n <= 64 THEN '33-64' ELSE '65+' END"
_THRESHOLDS = "[0.05, 0.08, 0.10, 0.12, 0.14, 0.15]"

ORACLE_SQL = {
    "ctc_collapse": f"WITH {VIEWS} SELECT roi_id, ids AS token_ids, n AS token_count, round(confidence, 6) AS confidence FROM collapsed",
    "ctc_peaks": f"WITH {CELLS} SELECT roi_id, cell, label, peak_t, round(peak, 6) AS peak, low::INT AS low, high::INT AS high FROM bounds",
    "ctc_cells_top": f"WITH {CELLS} SELECT roi_id, cell, cls, round(p, 6) AS p, rank::INT AS rank FROM ranked WHERE rank <= 4",
    "ctc_margins": f"""WITH {CELLS},
b AS (SELECT roi_id, cell, label, max(v) AS blank_max, avg(v) AS blank_mean FROM owned WHERE cls = 0 GROUP BY ALL),
o AS (SELECT roi_id, cell, max(p) FILTER (rank = 1) AS one, max(p) FILTER (rank = 2) AS two FROM ranked GROUP BY ALL),
m AS (SELECT roi_id, cell, one - two AS margin, ln(greatest(one, 1e-30::DOUBLE)) - ln(greatest(two, 1e-30::DOUBLE)) AS log_margin FROM o)
SELECT b.roi_id, b.cell, b.label, round(margin, 6) AS margin, round(log_margin, 6) AS log_margin, coalesce(r.rank, 0)::INT AS keep_rank, round(blank_max, 6) AS blank_max, round(blank_mean, 6) AS blank_mean
FROM b JOIN m ON b.roi_id = m.roi_id AND b.cell = m.cell LEFT JOIN ranked r ON b.roi_id = r.roi_id AND b.cell = r.cell AND r.cls = b.label""",
    "ctc_posterior": f"""WITH {FRAMES}, e AS (SELECT *, exp(v - max(v) OVER w) AS s FROM frames WINDOW w AS (PARTITION BY roi_id, t)),
o AS (SELECT bool_or(low < 0 OR abs(total - 1) > 1e-3) AS off FROM (SELECT min(v) AS low, sum(v) AS total FROM frames GROUP BY roi_id, t))
SELECT roi_id, t, cls, round(CASE WHEN off THEN s / sum(s) OVER (PARTITION BY roi_id, t) ELSE v END, 9) AS v FROM e, o""",
    "gate_consistency": f"""WITH {VIEWS} SELECT a.roi_id, a.ids = b.ids AND a.n BETWEEN 1 AND 6 AND least(a.confidence, b.confidence) >= {_THRESHOLDS}[least(greatest(a.n, 1), 6)] AS accepted
FROM collapsed a JOIN collapsed b ON b.roi_id = a.roi_id + 1""",
    "hallucination_rate": f"""WITH {VIEWS}, cube(same, c, l, text_n, other_n) AS (VALUES {_CUBE}),
v AS (SELECT a.roi_id, a.n, a.ids = b.ids AS same, 0.7 + 2 * least(a.confidence, b.confidence) AS conf FROM collapsed a JOIN collapsed b ON b.roi_id = a.roi_id + 1),
k AS (SELECT *, (conf >= 0.80)::INT + (conf >= 0.95)::INT + (conf >= 0.995)::INT AS c, (n >= 2)::INT + (n >= 3)::INT + (n >= 5)::INT AS l FROM v),
z AS (SELECT k.roi_id, k.n, ((other_n + 1) / (1333 + 32)::DOUBLE) / ((text_n + 1) / (91 + 32)::DOUBLE) * 0.3::DOUBLE AS o FROM k JOIN cube USING (same, c, l))
SELECT roi_id, round(CASE WHEN n = 0 THEN 0 ELSE o / (o + 0.7::DOUBLE) END, 9) AS rate FROM z""",
    "gate_supplement": f"""WITH {VIEWS} SELECT roi_id, CASE WHEN roi_id % 7 = 0 THEN n > 0 ELSE roi_id % 2 = 0 OR
  (n > 0 AND NOT contains(ids, '7') AND confidence >= 0.14 AND confidence * 0.8::DOUBLE >= 0.075 AND roi_id % 90 <= 50) END AS accepted FROM collapsed""",
    "packed_positions": f"""WITH {CELLS}, c AS (SELECT roi_id >> 3 AS image_id, roi_id AS roi, cell FROM bounds),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY roi, cell) - 1 AS position, cell = 0 AS starts, count(*) OVER (PARTITION BY image_id) AS n FROM c)
SELECT image_id, roi, cell, position::BIGINT AS position, starts, round(position / n, 9) AS ahead, round((n - 1 - position) / n, 9) AS behind, round(ln(1 + n) / ln(129), 9) AS length,
  position = 0 AS is_first, position = n - 1 AS is_last FROM r""",
    "replace_decision": f"WITH {_SCORED} SELECT block, cell, keep, best, margin, replaced FROM decided",
    "assembled_blocks": f"""WITH {_SCORED} SELECT block, string_agg((CASE WHEN replaced THEN best ELSE keep END)::VARCHAR, ',' ORDER BY cell) AS token_ids, count(*)::BIGINT AS token_count, bool_or(replaced) AS edited
FROM decided GROUP BY block""",
    "offline_correction": f"""WITH {_SCORED}, whole AS (
  SELECT block FROM (SELECT c.block, c.cell, k.score FROM (SELECT DISTINCT block, cell FROM scored) c LEFT JOIN kept k ON c.block = k.block AND c.cell = k.cell) GROUP BY block HAVING count(*) = count(score)),
m AS (
  SELECT c.block, c.cell, c.keep, o.best, round(o.score - k.score, 5) AS margin, coalesce(o.score - k.score > 1.0, FALSE) AS take
  FROM (SELECT DISTINCT block, cell, keep FROM scored) c JOIN kept k ON c.block = k.block AND c.cell = k.cell LEFT JOIN others o ON c.block = o.block AND c.cell = o.cell WHERE c.block IN (SELECT block FROM whole))
SELECT block, string_agg((CASE WHEN take THEN best ELSE keep END)::VARCHAR, ',' ORDER BY cell) AS token_ids, count(*) FILTER (take)::BIGINT AS edits, count(*)::BIGINT AS cells,
  coalesce(string_agg(cell || ':' || best || ':' || round(margin * 1000, 0)::BIGINT, ',' ORDER BY cell) FILTER (margin > 0.5), '') AS proposals FROM m GROUP BY block""",
    "family_decision": f"""WITH {_SCORED}
SELECT c.block, c.cell, coalesce(o.score - k.score > [0.5, 0.75, 1.0, 1.25, 1.5, 5.0, 0.5][c.keep] AND k.can AND o.can AND count(*) OVER (PARTITION BY c.block) <= 64, FALSE) AS replaced
FROM (SELECT DISTINCT block, cell, keep FROM scored) c LEFT JOIN kept k ON c.block = k.block AND c.cell = k.cell LEFT JOIN others o ON c.block = o.block AND c.cell = o.cell""",
    "edited_block_count": f"""WITH {_SCORED} SELECT count(*)::BIGINT AS blocks, count(*) FILTER (edited)::BIGINT AS edited_blocks FROM (SELECT block, bool_or(replaced) AS edited FROM decided GROUP BY block)""",
    "option_sets": f"""WITH {_SCORED}, c AS (SELECT block, cell, keep, list_sort(list(DISTINCT cls)) AS ids FROM scored GROUP BY ALL),
z AS (SELECT *, ['a', 'あ', 'ー', '漢', '1', '%', 'b'] AS chars, [TRUE, TRUE, FALSE, TRUE, TRUE, FALSE, TRUE] AS fit FROM c)
SELECT block, cell, CASE WHEN fit[keep] THEN array_to_string(list_sort(list_distinct(list_concat([chars[keep]], list_transform(list_filter(ids, lambda i: fit[i]), lambda i: chars[i])))), '') ELSE chars[keep] END AS options,
  array_to_string(list_transform(ids, lambda i, p: CASE WHEN p IN (1, 3) THEN 9 ELSE i END), ',') AS asked FROM z""",
    "scattered_results": f"""WITH {VIEWS} SELECT roi_id >> 3 AS image_id, roi_id % 8 AS slot, CASE WHEN roi_id % 3 <> 0 THEN ids ELSE '' END AS token_ids,
  round(CASE WHEN roi_id % 3 <> 0 THEN confidence ELSE 0 END, 6) AS confidence, roi_id % 3 <> 0 AS valid FROM collapsed""",
    "suspicious_cells": f"""WITH {_SCORED} SELECT block, cell, margin, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY margin DESC, cell) AS rank FROM decided WHERE margin IS NOT NULL) WHERE rank <= 3""",
    "verifier_decision": f"""WITH {_SCORED}, z AS (
  SELECT block, cell, replaced, margin * 1.3::DOUBLE AS blended, margin - ln(exp(0.25::DOUBLE) + exp(margin / 4)) AS log_odds FROM decided WHERE margin IS NOT NULL)
SELECT block, cell, round(blended, 9) AS blended, round(log_odds, 9) AS log_odds, CASE WHEN replaced THEN log_odds >= -1.764 ELSE log_odds > 1.596 END AS decided FROM z""",
    "editable_characters": r"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT ch, count(*)::BIGINT AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT ch, n, regexp_matches(ch, '^[\p{L}\p{N}]$') AND ch NOT IN ('ー', '〜', '～', '〰') AS editable,
  CASE WHEN regexp_matches(ch, '^\p{Nd}') THEN 'digit' WHEN regexp_matches(ch, '^\p{Latin}') THEN 'latin' ELSE 'other' END AS family FROM g""",
    "decoded_tokens": f"""WITH {VIEWS}, i AS (SELECT roi_id, CASE WHEN n = 0 THEN [] ELSE list_transform(string_split(ids, ','), lambda x: x::INT) END AS ids FROM collapsed)
SELECT roi_id, array_to_string(list_transform(ids[1:5], lambda x: substr('abcdefg', x, 1)), '') AS text,
  array_to_string(list_concat(list_concat([6808], ids[1:8]), list_concat([6809], list_transform(range(len(ids), 8), lambda x: 6807))), ',') AS model_input FROM i""",
    "norm_adapter": r"""WITH z AS (
  SELECT doc_id, regexp_replace(text || ' ... ．．．． .. ．' || repeat('.', (doc_id % 9)::INT), '[ 　\t\r\n]', '', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '\.{3,}|．{3,}|\.{1,2}|．{1,2}|[^.．]+'), lambda u: CASE WHEN regexp_matches(u, '^(\.{3,}|．{3,})$') THEN repeat('・', length(u)) ELSE u END), '') AS adapted FROM z""",
    "latency_buckets": f"""WITH {_LATENCY}, b AS (SELECT ms, {_BUCKET} AS bucket FROM events_ms)
SELECT list_position(['01', '02', '03-04', '05-08', '09-16', '17-32', '33-64', '65+'], bucket)::BIGINT AS place, bucket, count(*)::BIGINT AS samples, round(avg(ms), 6) AS mean_ms,
  round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.9), 6) AS p90_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms FROM b GROUP BY bucket""",
    "latency_slope": f"WITH {_LATENCY} SELECT round(regr_slope(ms, n) FILTER (n BETWEEN 1 AND 64), 8) AS slope, round(corr(n, ms), 8) AS correlation, round(median(ms), 8) AS median_ms FROM events_ms",
    "p90_reference": f"WITH {_LATENCY} SELECT event_type, list_sort(list(ms))[greatest(1, floor(0.9 * count(*))::BIGINT)] AS p90 FROM events_ms GROUP BY event_type",
    "throughput": f"""WITH {_LATENCY}, b AS (SELECT event_id // 64 AS batch, sum(abs(ms)) AS ms, count(*) AS items FROM events_ms GROUP BY 1)
SELECT round(avg(ms), 6) AS batch_mean_ms, round(median(ms), 6) AS batch_p50_ms, round(list_sort(list(ms))[greatest(1, floor(0.9 * count(*))::BIGINT)], 6) AS batch_p90_ms,
  round(sum(ms) / sum(items), 6) AS per_item_ms, round(sum(items) * 1000.0 / sum(ms), 6) AS items_per_second, count(*)::BIGINT AS nonempty_predictions FROM b""",
    "latency_pairs": "SELECT o_orderkey, o_custkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "parameter_report": """SELECT sum(len(embedding))::BIGINT AS total, sum(CASE WHEN label > 0 THEN len(embedding) ELSE 0 END)::BIGINT AS labelled,
  sum(len(list_filter(embedding, lambda v: v > 0)))::BIGINT AS positive FROM embeddings""",
    "norm_key": r"""WITH z AS (
  SELECT doc_id, translate(regexp_replace(text, '[^ -~]', '?', 'g'), '.,;', '!?~') || '!!?・・・・・・・ーー ..〜〜〜『x』' || repeat('.', (doc_id % 9)::INT) AS t FROM documents),
a AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(t, ' ', ''), '\.{3,}|\.{1,2}|[^.]+'), lambda u: CASE WHEN regexp_matches(u, '^\.{3,}$') THEN repeat('・', length(u)) ELSE u END), '') AS t FROM z),
m AS (SELECT doc_id, regexp_replace(regexp_replace(translate(t, '~『』', '〜「」'), 'ー{2,}', 'ーー', 'g'), '〜{2,}', '〜〜', 'g') AS t FROM a),
x AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!+\?[!?]*', '!?', 'g'), '\?+![!?]*', '?!', 'g'), '!{2,}', '!!', 'g'), '\?{2,}', '??', 'g') AS t FROM m)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '・{7,}', '@@@@@@', 'g'), '・{3,6}', '・・・', 'g'), '@@@@@@', '・・・・・・', 'g') AS display FROM x""".replace("@", chr(0xE000)),
    "norm_punct_vectors": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', TRUE)" for k, v in VECTORS.items()) + ") AS t(source, display, idempotent)",
    "em_cer_all": f"WITH {OCR_PAIRS} {_SCORE}",
    "em_cer_populations": f"""WITH {OCR_PAIRS}, a AS ({_SCORE}), b AS ({_SCORE} WHERE sample_id IN (SELECT doc_id FROM labels))
SELECT 'all' AS population, * FROM a UNION ALL SELECT 'subset', * FROM b""",
    "em_cer_heldout": f"WITH {OCR_PAIRS} {_SCORE} WHERE sample_id IN (SELECT doc_id FROM labels)",
}
