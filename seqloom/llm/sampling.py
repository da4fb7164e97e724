"""A bounded sample of labelled rows for a classifier, the same for the same rows, however they are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def labelled(rows: DataFrame, label: str, text: str, key: str, per_label: int) -> list[tuple]:
    """Up to per_label distinct rows (label, text) of each label, those of the smallest hash of key and text.

    Nulls in label or text take no part. A count per label comes first; then only rows under the hash bound that leaves
    about per_label of them are made distinct and reach the driver, where the excess goes. Neither repeated rows nor the
    many texts of one key make the sample larger."""
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(key).cast("string").alias("k")).where("label is not null and text is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("k", "text"), F.lit(_SPAN)))
    counts = rows.groupBy("label").count().collect()
    if not counts:
        return []
    share = {n: int(min(1.0, (per_label + 4 * per_label**0.5) / n) * _SPAN) for _, n in counts}
    bounds = rows.sparkSession.createDataFrame([(x, share[n]) for x, n in counts], f"of {rows.schema['label'].dataType.simpleString()}, room long")
    some = rows.join(F.broadcast(bounds), F.col("label") == F.col("of")).where("h < room").select("label", "h", "k", "text").distinct()
    out, taken = [], {}
    for r in sorted(some.collect(), key=lambda r: (str(r["label"]), r["h"], r["k"] or "", r["text"])):
        if taken.setdefault(r["label"], 0) < per_label:
            taken[r["label"]] += 1
            out.append((r["label"], r["text"]))
    return out
