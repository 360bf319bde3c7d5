"""Quality rules: length and repetition rules, then an n-gram log-likelihood ratio, all in DataFrame functions.

Words and word pairs are hashed into BUCKETS cells. Two multinomials are counted over those cells: one over the trusted
texts (documents that `labels` marks with quality 1; labels that are held out for tests aren't read) and one over all
documents. A text's score is the sum over its
n-grams of log(trusted share / raw share), divided by their number; it is kept from THRESHOLD on. Shares are smoothed by
one and the logarithms are whole millionths, so that every sum is exact and the verdict the same in any order.

Null and empty texts have no word: all counts are 0 and base_failed is true. Rows are never dropped or merged; repeated
rows get equal results. Without labels the ratio is 0 everywhere. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, held_out, join_ids, let, words_of

BUCKETS = 10_000
#: Mean log-likelihood ratio per n-gram from which a text is kept.
THRESHOLD = -0.06
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOL, NOT_BLANK = r"[#*$%&|<>]", r"[^\x20\x09-\x0D]"
MICRO = 1_000_000


def _cells(hashes: Column) -> Column:
    """The cells of a text's words and of its word pairs, from the words' hashes."""
    pairs = F.transform(F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(BUCKETS)))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS))), pairs)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _repeated(hashes: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more.

    Most texts have no such window, which their distinct hashes tell. Otherwise windows are sorted by their hash, all 64 bits
    of it, and then their place; equal ones are neighbours. The places found are sorted again and the windows' union is
    summed up.
    """

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def places(w):
        return let(
            F.sort_array(F.transform(w, lambda k, i: F.struct(k.alias("k"), i.alias("at")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(x["k"] == F.get(s, i + 1)["k"], F.lit(False)) | F.when(i > 0, x["k"] == F.get(s, i - 1)["k"]).otherwise(False),
                    ),
                    lambda x: x["at"].cast("long"),
                )
            ),
        )

    def union(w):
        return F.aggregate(
            places(w),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(hashes) < 4, none).otherwise(let(windows(hashes), lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), none).otherwise(union(w))))


def ratio_table(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """For each cell the log ratio of the trusted and the raw share in millionths: BUCKETS numbers, however large docs is."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("tf_id")).distinct().withColumn("tf_trusted", F.lit(1))
    rows = join_ids(docs.select(F.col(doc_id).alias("tf_id"), F.col(text).alias("tf_text")), trusted, "tf_id", "left")
    cells = rows.select(F.explode(let(_hashes(words_of(F.col("tf_text"))), _cells)).alias("cell"), "tf_trusted")
    counts = {r["cell"]: (r["raw"], r["trusted"]) for r in cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count("tf_trusted").alias("trusted")).collect()}
    raw, good = (sum(x[k] for x in counts.values()) for k in (0, 1))
    if not good:
        return [0] * BUCKETS
    ratio = lambda r, t: math.log((t + 1) / (good + BUCKETS)) - math.log((r + 1) / (raw + BUCKETS))
    return [round(MICRO * ratio(*counts.get(k, (0, 0)))) for k in range(BUCKETS)]


def rule_columns(text: Column, table: list[int], threshold: float = THRESHOLD) -> Column:
    """A struct of all counts, the score and the verdicts for a text column."""
    whole = F.coalesce(text, F.lit(""))
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    inner = let(
        words_of(text),
        lambda w: let(
            _hashes(w),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated(h).alias("n_repeat_words"),
                F.aggregate(_cells(h), F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(F.get(ratios, c.cast("int")), F.lit(0).cast("long"))).alias("ratio_sum"),
                F.greatest(2 * F.size(h).cast("long") - 1, F.lit(1).cast("long")).alias("n_grams"),
            ),
        ),
    )
    symbols = F.size(F.split(whole, SYMBOL)) - 1
    dup_lines = let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_BLANK)), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))

    def verdict(x):
        failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
        return F.struct(
            x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), (x["ratio_sum"] / (x["n_grams"] * MICRO)).alias("score"),
            (~failed & (x["ratio_sum"] >= F.lit(int(threshold * MICRO)).cast("long") * x["n_grams"])).alias("kept"),
        )

    return let(inner, verdict)


def with_rules(docs: DataFrame, labels: DataFrame, name: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one more column, a struct of the rules' results. If docs has a column of that name, the new one gets an
    underscore more."""
    return docs.withColumn(fresh(docs, name), rule_columns(F.col(text), ratio_table(docs, labels, doc_id, text), threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    name = fresh(docs, "tf_quality")
    return with_rules(docs, labels, name).where(F.col(name)["kept"]).drop(name)


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base rules alone, which need no corpus counts."""
    out = docs.select(F.col(key), rule_columns(F.col(text), [0] * BUCKETS).alias("tf_r"))
    return out.select(key, *(f"tf_r.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))
