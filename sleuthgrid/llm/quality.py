"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is the counts of a metric's values in buckets of a relative width of at most 1/32, for one
language and source: sketches merge by adding counts, and hold at most some hundred buckets each.
A threshold is the upper quartile plus REACH times the interquartile range, or times the metric's
least spread where that is wider. It is worked out from a group's own sketch, and from this merged with its
language's at a weight of WEIGHT rows; the higher one counts, so that a group's clean rows are never
judged by others, however few they are, and a small group's chance values weigh little. No size switches
anything. The thresholds are joined to the rows by language and source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .words import Words, buffers, chunks

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Metrics (each in thousandths) and the least spread that counts.
METRICS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 35),
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", 1500),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 170),
}
WEIGHT, REACH = 100, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated_words(w: Words, width: int = 5) -> np.ndarray:
    """Of each text the number of words in windows that are found twice or more in it."""
    at = w.windows(width)
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.maximum(w.counts() - width + 1, 0))
    path = w.prefix(width, at)
    order = np.lexsort((path, doc))
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (path[order[1:]] == path[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    edge[twice] += 1
    np.subtract.at(edge, twice + width, 1)
    return _sums(np.cumsum(edge)[:-1] > 0, w.offsets)


def _features(text: Column) -> Column:
    return F.arrow_udf(_count_features, "struct<" + ",".join(f"{c}:long" for c in FEATURES) + ">")(text)


def _count_features(column: pa.Array) -> pa.Array:
    data, offsets = buffers(column)
    parts = []
    for lo, hi in chunks(offsets):
        d, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        w = Words(d, off)
        lines, dups = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        raw = d.tobytes()
        for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = [x for x in raw[s:e].split(b"\n") if x.strip()]
            lines[i], dups[i] = len(own), len(own) - len(set(own))
        chars = ~_SPACE[d] & ((d & 0xC0) != 0x80)
        parts.append(np.stack([w.counts(), _sums(chars, off), _sums(_SYMBOL[d], off), lines, dups, repeated_words(w)]))
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((len(FEATURES), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in whole], FEATURES)


def _bucket(x: str) -> str:
    """The number with all but its six leading binary digits cleared."""
    return f"shiftleft(shiftright({x}, greatest(length(bin({x})) - 6, 0)), greatest(length(bin({x})) - 6, 0))"


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, threshold) from rows with lang, source and the features."""
    long = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).cast("long").alias("x")) for m, (e, _) in METRICS.items()))).alias("m"))
    sketch = long.select("lang", "source", "m.metric", F.expr(_bucket("m.x")).alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    sketch = materialize(sketch, "quality-sketch")

    keys = ["lang", "source", "metric"]
    spread = F.element_at(F.create_map(*(F.lit(x) for m, (_, least) in METRICS.items() for x in (m, least))), F.col("metric"))

    def limits(counts: DataFrame) -> DataFrame:
        """Of each group the threshold, from rows of keys, bucket and n."""
        by = Window.partitionBy(*keys)
        at = counts.select("*", F.sum("n").over(by).alias("all"), F.sum("n").over(by.orderBy("bucket")).alias("upto"))
        quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
        found = at.groupBy(*keys).agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
        return found.select(*keys, (F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q1"), spread)).cast("long").alias("threshold"))

    lang = sketch.groupBy(F.col("lang").alias("of_lang"), F.col("metric").alias("of_metric"), F.col("bucket").alias("of_bucket")).agg(F.sum("n").alias("of_n"))
    total = lang.groupBy("of_lang", "of_metric").agg(F.sum("of_n").alias("total"))
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("metric") == F.col("of_metric"))
    # whole numbers: own counts times the language's rows, the language's counts times WEIGHT
    own = sketch.join(total, same).select(*keys, "bucket", (F.col("n").cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)")).cast("decimal(30,0)").alias("n"))
    others = sketch.select(*keys).distinct().join(lang, same).select(*keys, F.col("of_bucket").alias("bucket"), (WEIGHT * F.col("of_n")).cast("decimal(30,0)").alias("n"))
    merged = own.unionByName(others).groupBy(*keys, "bucket").agg(F.sum("n").cast("decimal(30,0)").alias("n"))
    return limits(sketch).unionByName(limits(merged)).groupBy(*keys).agg(F.max("threshold").alias("threshold"))


def judge_quality(docs: DataFrame, *, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all of them, by default) with the struct column `quality`: the features, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows. kept: not
    base_failed and no metric over its language's and source's threshold.

    Texts are read once: what is carried is written to the shared folder beside its features, which the
    sketches and the verdicts then read. Null or empty text: no words, so base_failed. Null lang or source is a
    group of its own. A table without one of these columns counts as if it were null there. Further columns stay
    as they are; repeated rows are each judged and counted; an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "quality"]
    own = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(None).alias("none"))
    rows = materialize(docs.select(carried.alias("row"), *own, _features(F.col("text").cast("string")).alias("quality")), "quality-features")
    limits = thresholds(rows.select("lang", "source", "quality.*")).groupBy("lang", "source")
    limits = limits.agg(F.map_from_entries(F.collect_list(F.struct("metric", "threshold"))).alias("limits"))  # three entries
    judged = rows.join(limits, rows["lang"].eqNullSafe(limits["lang"]) & rows["source"].eqNullSafe(limits["source"]), "left")
    failed = F.expr("quality.n_words < 10 or 100 * quality.n_repeat_words > 20 * quality.n_words")
    within = F.lit(True)
    for metric, (value, _) in METRICS.items():
        for c in FEATURES:
            value = value.replace(c, f"quality.{c}")
        within &= F.expr(value).cast("long") <= F.element_at("limits", F.lit(metric))
    verdict = F.struct("quality.*", failed.alias("base_failed"), (~failed & within).alias("kept"))
    return judged.select(*(F.col(f"row.`{c}`") for c in carry), verdict.alias("quality"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep."""
    return judge_quality(docs.withColumnRenamed("quality", "_quality")).where("quality.kept").drop("quality").withColumnRenamed("_quality", "quality")
