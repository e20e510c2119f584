"""Replacing recognised characters by candidates: scores, thresholds, assembly. A neural model only supplies vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Special ids of the model's input, and marks that are never edited.
BOS, EOS, PAD = 6808, 6809, 6807
MARKS = "ー〜～〰"


def editable(char: Column, single: bool = True) -> Column:
    """Whether a character is a letter or a number and no lengthening mark; single asks for one code point."""
    fit = char.rlike(r"^[\p{L}\p{N}]") & ~F.substring(char, 1, 1).isin(list(MARKS))
    return fit & (F.length(char) == 1) if single else fit


def family(char: Column) -> Column:
    """hiragana, katakana, han, digit, latin or other."""
    code = F.ascii(char)
    within = lambda *pairs: F.expr("false") if not pairs else _any(code.between(a, b) for a, b in pairs)
    return (
        F.when(within((0x3040, 0x309F)), "hiragana")
        .when(within((0x30A0, 0x30FF), (0xFF66, 0xFF9F)), "katakana")
        .when(within((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)), "han")
        .when(char.rlike(r"^\p{Nd}"), "digit")
        .when(char.rlike(r"^\p{IsLatin}"), "latin")
        .otherwise("other")
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def model_input(ids: Column, window: int = 64) -> Column:
    """BOS, at most window ids, EOS, padded to window + 2."""
    cut = F.slice(ids, 1, window)
    row = F.concat(F.array(F.lit(BOS)), cut, F.array(F.lit(EOS)))
    return F.concat(row, F.array_repeat(F.lit(PAD), F.lit(window + 2) - F.size(row)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def candidate_score(similarity: Column, log_p: Column, size: int, scale: float, rank_bias: Column, keep: Column, keep_bias: float) -> Column:
    """similarity over the root of size, plus the scaled log-probability, a bias by rank and one for the kept character."""
    return similarity / F.sqrt(F.lit(float(size))) + F.least(F.exp(F.lit(scale)), F.lit(10.0)) * log_p + rank_bias + F.when(keep, keep_bias).otherwise(0.0)


def rounded(value: Column, digits: int) -> Column:
    """The whole number nearest to the scaled value, scaled back, as SQL engines have it.

    F.round() goes by the decimal digits instead: where a 5 follows, an error of the last bit turns one up and the other down.
    """
    return F.round(value * 10.0**digits) / 10.0**digits


def options(source: Column, candidates: Column) -> Column:
    """The characters a cell may hold: its own and, if that is a letter or a number, the candidates (an array) that are."""
    return F.when(editable(source), F.array_distinct(F.concat(F.array(source), F.filter(candidates, lambda c: editable(c))))).otherwise(F.array(source))


def masked(ids: Column, places: Column, mask: int) -> Column:
    """ids with a mask at the places (an array, from 0) that a verifier asks about."""
    return F.transform(ids, lambda i, place: F.when(F.array_contains(places, place), F.lit(mask)).otherwise(i))


def offline(scored: DataFrame, threshold: float = 2.0, floor: float = 2.0) -> DataFrame:
    """block, token_ids, edits, cells and proposals (cell, best, margin of each cell whose margin exceeds the floor) of scored
    rows: the best other class replaces the kept one if it leads by more than the threshold, editable or not.

    A cell whose kept class isn't among its candidates raises an error when it is read; one without another class stays.
    """
    kept = F.max(F.when(F.col("cls") == F.col("keep"), F.col("score")))
    other = F.max(F.when(F.col("cls") != F.col("keep"), F.struct("score", (-F.col("cls")).alias("cls"))))
    cells = scored.groupBy("block", "cell", "keep").agg(kept.alias("k"), other.alias("o"))
    known = F.when(F.col("k").isNull(), F.raise_error(F.lit("the kept class is no candidate of its cell")).cast("double")).otherwise(F.col("k"))
    cells = cells.select("block", "cell", "keep", (-F.col("o.cls")).alias("best"), (F.col("o.score") - known).alias("margin"))
    cells = cells.withColumn("take", F.coalesce(F.col("margin") > threshold, F.lit(False)))
    row = F.struct("cell", F.when(F.col("take"), F.col("best")).otherwise(F.col("keep")).alias("id"), "best", rounded(F.col("margin"), 5).alias("margin"))
    rows = cells.groupBy("block").agg(F.array_sort(F.collect_list(row)).alias("z"), F.count_if("take").alias("edits"), F.count("*").alias("cells"))
    proposals = F.transform(F.filter("z", lambda z: z["margin"] > floor), lambda z: F.struct(z["cell"].alias("cell"), z["best"].alias("best"), z["margin"].alias("margin")))
    return rows.select("block", F.transform("z", lambda z: z["id"]).alias("token_ids"), "edits", "cells", proposals.alias("proposals"))


def replacements(scored: DataFrame, threshold: float | Column = 2.0, most: int = 64, digits: int | None = None) -> DataFrame:
    """block, cell, keep, best, margin and replaced of each cell of scored rows (block, cell, cls, keep (the cell's class), score, can (editable class)).

    The best other class replaces the kept one if it leads by more than the threshold and both are editable; a block of
    more than most cells is left as it is.  The threshold may be an expression over block, cell and keep (by_family()).
    Margins are rounded to digits before they are compared, if given.
    """
    kept = F.max(F.when(F.col("cls") == F.col("keep"), F.struct("score", "can")))
    other = F.max(F.when(F.col("cls") != F.col("keep"), F.struct("score", (-F.col("cls")).alias("cls"), "can")))
    cells = scored.groupBy("block", "cell", "keep").agg(kept.alias("k"), other.alias("o"))
    sized = cells.withColumn("n", F.count("*").over(Window.partitionBy("block")))
    margin = F.col("o.score") - F.col("k.score")
    margin = margin if digits is None else rounded(margin, digits)
    replaced = F.coalesce((margin > threshold) & F.col("k.can") & F.col("o.can") & (F.col("n") <= most), F.lit(False))
    return sized.select("block", "cell", "keep", (-F.col("o.cls")).alias("best"), margin.alias("margin"), replaced.alias("replaced"))


def by_family(char: Column, thresholds: dict[str, float], otherwise: float = 2.0) -> Column:
    """The threshold of a character's family."""
    out = F.lit(otherwise)
    for name, value in thresholds.items():
        out = F.when(family(char) == name, F.lit(value)).otherwise(out)
    return out


def edited_blocks(blocks: DataFrame) -> DataFrame:
    """blocks and edited_blocks: how many of assembled() there are, and how many are edited."""
    return blocks.agg(F.count("*").alias("blocks"), F.count_if("edited").alias("edited_blocks"))


def assembled(decided: DataFrame, most: int = 320) -> DataFrame:
    """block, token_ids (replaced where decided, at most most), token_count, edited of each block."""
    final = F.when(F.col("replaced"), F.col("best")).otherwise(F.col("keep"))
    rows = decided.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("cell", final.alias("id")))).alias("z"), F.bool_or("replaced").alias("edited"))
    ids = F.slice(F.transform("z", lambda z: z["id"]), 1, most)
    return rows.select("block", ids.alias("token_ids"), F.size(ids).cast("long").alias("token_count"), "edited")


def suspicious(decided: DataFrame, most: int = 3) -> DataFrame:
    """The cells of largest margin of each block; without a margin none."""
    order = Window.partitionBy("block").orderBy(F.desc("margin"), "cell")
    return decided.where(F.col("margin").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def verified(rows: DataFrame, weight: float = 0.6, veto: float = -1.764, add: float = 1.596) -> DataFrame:
    """rows (replaced, normal, masked, l0, l1, l2) with blended, log_odds and decided: a veto keeps, an addition replaces."""
    top = F.greatest("l0", "l1")
    odds = F.col("l2") - (top + F.log(F.exp(F.col("l0") - top) + F.exp(F.col("l1") - top)))
    out = rows.withColumn("blended", F.col("normal") + weight * F.col("masked")).withColumn("log_odds", odds)
    return out.withColumn("decided", F.when(F.col("replaced"), F.col("log_odds") >= veto).otherwise(F.col("log_odds") > add))


def decoded(ids: Column, count: Column, chars: Column) -> Column:
    """The text of the first count ids; chars lists the dictionary without blank, and id 0 is its first."""
    return F.array_join(F.transform(F.slice(ids, F.lit(1), count), lambda i: F.element_at(chars, F.least(i + 1, F.size(chars)))), "")
