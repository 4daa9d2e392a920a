"""Line dedup: remove lines that stand on many sites, in DataFrame functions only.

Method: distinct-site spread.  Each line hash has a HyperLogLog sketch of the
sites it stands on; sketches merge by aggregation, partial before the shuffle.
A line whose estimate is well over ``min_sites`` is boilerplate, one well under
is not, and lines near the threshold (within ``BAND``) get exact distinct counts.
Equal texts count for one site, that of the smallest id, so a document that was
copied to many sites is no boilerplate; the document join removes copies.

A boilerplate line stays in the document with the smallest id that has it and
goes from all others, so no content is lost.  Lines are compared without white
space at their ends; blank lines stay.

Joins broadcast sides of up to ``SMALL`` rows.  Beyond it they are shuffled, and a
line or text of more than ``HOT`` rows is dealt over several tasks.

Lines and texts are told apart by 64-bit hashes.

Edge cases: a null text stays null and has no lines; a null site counts as no
site; repeated rows are treated alike; documents with a null id never keep a
boilerplate line as its first; blank lines and ties of ids and sites change
nothing; a text of any length counts whole; an empty table gives no rows; further
columns pass through, but one named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import free

from ._store import saved

BLANK = " \t\n\x0b\f\r"
LG_K = 12
#: Relative half-width around the threshold where the sketch is not trusted: over five standard errors of 2**12 registers.
BAND = 0.1
#: Rows of 16 bytes or so up to which a side is broadcast; beyond it joins are shuffled.
SMALL = 1_000_000
#: Rows of a line or a text that meet in one task.
HOT = 50_000


def _trimmed(line):
    return F.trim(line, F.lit(BLANK))


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows (h, th) of each line hash and text hash, rows (h, n, first_id) of boilerplate lines in n texts)."""
    line = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("th"), F.col(key).alias("id"), F.col(site).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), _trimmed))).alias("line"))
    line = line.filter("line <> ''").groupBy(F.xxhash64("line").alias("h"), "th").agg(F.min("id").alias("id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "site"))).alias("s"), F.max("site").alias("any_site"))
    line = saved(line.select("h", "th", "id", F.when(F.col("s").isNotNull(), F.col("s.site")).otherwise(F.col("any_site")).alias("site")), "lines")
    sketch = line.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("first_id"))
    # as many texts as sites are needed at least; that bounds the lines looked at from above
    wide = saved(sketch.filter((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - BAND))), "spread")
    near = wide.filter(F.col("sites") <= min_sites * (1 + BAND)).select("h", "n")
    exact = _meet(line, near, "h", near.count(), near, spread="th").groupBy("h", "site").agg(F.min("id").alias("first_id")).groupBy("h").agg(F.count("site").alias("sites"), F.min("first_id").alias("first_id"))
    exact = exact.filter(F.col("sites") >= min_sites).join(near, "h")
    chosen = wide.filter(F.col("sites") > min_sites * (1 + BAND)).select("h", "n", "first_id").unionByName(exact.select("h", "n", "first_id"))
    return line.select("h", "th"), saved(chosen, "boilerplate")


def _meet(rows: DataFrame, side: DataFrame, on: str, size: int, counts: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` of ``size`` rows; ``counts`` tells in ``n`` how many rows a key has, and ``spread`` is hashed to deal those of a hot key."""
    side = side.drop("n")
    if size <= SMALL:
        return rows.join(F.broadcast(side), on, how)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # no more than SMALL keys can have more rows than this
    most = max(HOT, total // SMALL)
    hot = saved(counts.filter(F.col("n") > most).select(on, F.ceil(F.col("n") / F.lit(most)).cast("long").alias("n_salts")), "hot")
    if hot.isEmpty():
        return rows.join(side, on, how)
    salts, salt = free(rows, "_salts"), free(rows, "_salt")
    hot = F.broadcast(hot.withColumnRenamed("n_salts", salts))
    rows = rows.join(hot, on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.col(salts)), F.lit(0).cast("long"))).drop(salts)
    side = side.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salts), F.lit(1).cast("long")) - 1))).drop(salts)
    return rows.join(side, [on, salt], how).drop(salt)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, removed: str = "n_removed", lines: str = "n_lines") -> DataFrame:
    """The documents with the other lines of ``text`` only, and columns with the numbers of lines and of removed ones."""
    line, chosen = boilerplate(docs, key, text, site, min_sites)
    th, flags, kept, lot = (free(docs, c) for c in ("_th", "_flags", "_kept", "_lot"))
    flagged = saved(_meet(line, chosen, "h", chosen.count(), chosen, spread="th").groupBy(F.col("th").alias(th)).agg(F.collect_list(F.struct("h", "first_id")).alias(flags)), "flagged")
    rows = flagged.agg(F.sum(F.size(flags))).first()[0] or 0
    names = [c for c in docs.columns if c == text or c.lower() not in (removed.lower(), lines.lower())]
    all_lines = F.split(F.col(text), "\n")

    def stays(x):
        h = F.xxhash64(_trimmed(x))
        return ~F.exists(flags, lambda f: (f["h"] == h) & ~f["first_id"].eqNullSafe(F.col(key)))

    out, h = docs.withColumn(lot, F.xxhash64(key, site)), F.xxhash64(text)
    # a text without lines is never flagged, so in a shuffle such rows need not meet
    out = out.withColumn(th, h if rows <= SMALL else F.when(F.trim(text, F.lit(BLANK)) != "", h).otherwise(F.col(lot)))
    out = _meet(out, flagged, th, rows, out.groupBy(th).agg(F.count("*").alias("n")), spread=lot, how="left")
    out = out.withColumn(kept, F.when(F.col(flags).isNull(), all_lines).otherwise(F.filter(all_lines, stays)))
    new = {text: F.when(F.col(flags).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))}
    return out.select(
        *[new.get(c, F.col(f"`{c}`")).alias(c) for c in names],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias(lines),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias(removed),
    )
