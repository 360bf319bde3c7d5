"""Line dedup by site-relative frequency, in DataFrame functions.

Per host: the pages that have a line, divided by the host's pages. A line over RATIO that at least MIN_PAGES pages have
is boilerplate there and is dropped from all of that host's pages. The counts are keyed by host and line hash and summed
before the shuffle, so a hot host or a very common line is no hot key. Each count meets its host's total before anything is
gathered, so only boilerplate is: a host can't have more than (lines a page) / RATIO such lines. Their hashes go to each
host as one array, and texts are rewritten in place without being exploded again.

Lines are split at newlines; lines without a word are layout and always stay. Null texts stay null, empty ones empty;
a null host is a host of its own. Repeated rows count as pages of their own. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, join_ids, let, shared_root

RATIO = 0.03
MIN_PAGES = 3
#: Line hashes, over all hosts, up to which the hosts' arrays are broadcast (8 bytes each); beyond, they are joined by
#: shuffle, each array sent to PARTS parts of its host's pages, so that a hot host is no hot key.
HASHES, PARTS = 1_000_000, 64
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n")


def _has_word(line):
    return line.rlike(NOT_BLANK)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """For each host the hashes of its boilerplate lines: tf_host, tf_lines."""
    pages = docs.select(F.col(host).alias("tf_host"), F.xxhash64(F.col(host), F.col(host).isNull()).alias("tf_site"), F.col(text).alias("tf_text"))
    totals = pages.groupBy("tf_site").agg(F.count("*").alias("total"))
    per_page = F.array_distinct(F.transform(F.filter(_lines(F.col("tf_text")), _has_word), lambda x: F.xxhash64(x)))
    counts = pages.select("tf_host", "tf_site", F.explode(per_page).alias("line")).groupBy("tf_host", "tf_site", "line").agg(F.count("*").alias("n"))
    frequent = join_ids(counts.where(F.col("n") >= min_pages), totals, "tf_site", "inner").where(F.col("n") > ratio * F.col("total"))
    return frequent.groupBy("tf_host").agg(F.collect_list("line").alias("tf_lines"))


def with_dedup(docs: DataFrame, name: str = "lines", host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with one more column, a struct of: n_lines (with a word), n_dropped, clean (the text that stays). If docs has a
    column of that name, the new one gets an underscore more."""
    shared_root(docs.sparkSession)
    name = fresh(docs, name)
    found = boilerplate(docs, host, text, ratio, min_pages)
    key, bad = fresh(docs, "tf_key"), fresh(docs, "tf_bad")
    side = found.select(F.xxhash64("tf_host", F.col("tf_host").isNull()).alias(key), F.col("tf_lines").alias(bad)).checkpoint()
    few = (side.agg(F.sum(F.size(bad))).first()[0] or 0) <= HASHES
    joined = docs.withColumn(key, F.xxhash64(F.col(host), F.col(host).isNull()))
    if few:
        joined = joined.join(F.broadcast(side), key, "left")
    else:
        part = fresh(joined, "tf_part")
        side = side.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = joined.withColumn(part, F.pmod(F.xxhash64(F.col(text)), F.lit(PARTS)).cast("int")).join(side.hint("merge"), [key, part], "left").drop(part)

    def split_up(lines):
        return let(
            F.when(F.size(F.coalesce(bad_col, none)) == 0, lines).otherwise(F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(bad_col, F.xxhash64(x))))),
            lambda rest: F.struct(F.size(F.filter(lines, _has_word)).cast("long").alias("n_lines"), (F.size(lines) - F.size(rest)).cast("long").alias("n_dropped"), F.array_join(rest, "\n").alias("clean")),
        )

    bad_col, none = F.col(bad), F.array().cast("array<bigint>")
    empty = F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("clean"))
    return joined.withColumn(name, F.when(F.col(text).isNull(), empty).otherwise(let(_lines(F.col(text)), split_up))).drop(key, bad)


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs with boilerplate lines cut out of the text, and n_chars (if there) brought up to date."""
    name = fresh(docs, "tf_dedup")
    out = with_dedup(docs, name, host, text).withColumn(text, F.col(name)["clean"]).drop(name)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
