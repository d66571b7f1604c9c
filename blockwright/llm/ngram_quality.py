"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

DataFrame functions only. Two passes over the texts:

1. every word and every pair of neighbouring words is hashed into ``BUCKETS`` buckets; their counts in
   the raw corpus (all documents) and in the trusted target (documents whose label says quality 1)
   give two multinomials, smoothed so that a bucket's ratio is that of the target's count to the
   count that its share of the corpus lets expect, both with a pseudo-count;
2. each document scores the mean of log(target / raw) over its n-grams, and is kept if the base rules
   hold and the score reaches ``THRESHOLD``.

The ratio table has ``2 * BUCKETS`` rows whatever the corpus holds, which is what bounds its broadcast.
The words of a document are exploded and summed again inside its own partition (a row id is the key, so
the partial aggregate leaves one row per document before the exchange).

Texts are shuffled only if their key may be a trusted one (by a map of bits of a fixed size).

Defined results: a null or empty text has no words, counts of 0 and fails the base rules; rows that repeat
(also with the same or a null doc_id) are each scored; a score equal to the threshold is kept; a text of any
length is scored whole; extra columns are ignored; an empty table or a table without trusted documents gives
ratios of 0, so that the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm.labelled import maybe_labelled, never_labelled
from blockwright.session import shared_folder

BUCKETS = 1 << 16
#: Pseudo-count of a bucket, of the target and of what the corpus lets expect: rare n-grams say little.
PSEUDO = 20.0
#: Least mean log ratio of a kept document.
THRESHOLD = -0.1
MIN_WORDS = 50
#: Largest share, in hundredths, of words in repeated 3-word windows.
MAX_REPEAT = 50

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _repeat_hits(s: Column, w: Column) -> Column:
    """Ascending start positions of the 3-word windows that occur twice or more.

    ``s``: (hash, position) of each window in order, so that equal windows are neighbours; the words themselves are
    compared before a window counts.
    """

    def same(a: Column, b: Column) -> Column:
        hit = a["h"] == b["h"]
        for k in range(3):
            hit = hit & (F.get(w, a["p"] + k) == F.get(w, b["p"] + k))
        return hit

    def repeated(x: Column, j: Column) -> Column:
        return F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))

    return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["p"]))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _w (words) and the base rules' columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col("_w")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    hits = F.col("_hits")
    covered = F.aggregate(F.transform(hits, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(hits, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return (
        docs.withColumn("_w", words(t))
        .withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_s", F.sort_array(windows))
        .withColumn("_hits", _repeat_hits(F.col("_s"), w))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
        .drop("_lines", "_s", "_hits")
    )


def _ngrams(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each word: ``keep``, _u (the word's bucket), _b (its pair's bucket, null at the last word)."""
    out = df.select(*keep, "_w", F.posexplode("_w").alias("_p", "_x"))
    nxt = F.get(F.col("_w"), F.col("_p") + 1)
    return out.select(
        *keep,
        F.pmod(F.xxhash64("_x"), F.lit(BUCKETS)).alias("_u"),
        F.when(nxt.isNotNull(), F.pmod(F.xxhash64(F.col("_x"), nxt), F.lit(BUCKETS)) + BUCKETS).alias("_b"),
    )


def ratio_table(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(bucket, llr): log of the target's over the corpus's smoothed share, words in the first half, pairs in the second.

    ``trusted``: a column ``key`` with the documents of the target; repeats and nulls in it do nothing.
    """
    shared_folder(docs.sparkSession)
    good = trusted.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    texts = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # only texts that may be trusted meet the keys that are; all others are counted where they lie
    met = maybe_labelled(texts, good, "_k").join(good.withColumn("_good", F.lit(1)).hint("shuffle_hash"), "_k", "left")
    both = met.select("_t", F.coalesce("_good", F.lit(0)).cast("long").alias("_in")).unionByName(never_labelled(texts, good, "_k").select("_t", F.lit(0).cast("long").alias("_in")))
    n = _ngrams(both.select(words(F.col("_t")).alias("_w"), "_in"), ["_in"])
    counts = (
        n.select("_in", F.explode(F.array("_u", "_b")).alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_in").alias("target"))
        .checkpoint()
    )
    half = F.col("bucket") >= BUCKETS
    totals = {r["h"]: (r["raw"], r["target"]) for r in counts.groupBy(half.alias("h")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}

    def total(i: int) -> Column:
        return F.when(half, F.lit(float(totals.get(True, (0, 0))[i]))).otherwise(F.lit(float(totals.get(False, (0, 0))[i])))

    if not any(t for _, t in totals.values()):
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    expected = F.col("raw") * total(1) / F.greatest(total(0), F.lit(1.0))
    return counts.select("bucket", F.log((F.col("target") + F.lit(PSEUDO)) / (expected + F.lit(PSEUDO))).alias("llr"))


def _verdicts(docs: DataFrame, ratios: DataFrame, text: str, carry: list[str], threshold: float) -> DataFrame:
    """``carry``, the base columns, base_failed, score and kept of every row."""
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = base_columns(docs.select(*carry, F.col(text).alias("_t")), "_t").drop("_t")
    base = base.withColumn("_row", F.monotonically_increasing_id())
    # an empty array still gives a row, so that documents without words stay
    base = base.withColumn("_w", F.when(F.size("_w") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("_w")))
    g = _ngrams(base, ["_row", *carry, *cols])
    g = g.join(ratios.select(F.col("bucket").alias("_u"), F.col("llr").alias("_lu")), "_u", "left")
    g = g.join(ratios.select(F.col("bucket").alias("_b"), F.col("llr").alias("_lb")), "_b", "left")
    s = g.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (*carry, *cols)],
        F.sum(F.coalesce("_lu", F.lit(0.0)) + F.coalesce("_lb", F.lit(0.0))).alias("_sum"),
    )
    score = F.col("_sum") / F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return s.select(*carry, *cols, F.round(score, 9).alias("score")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: key, base columns, base_failed, score (mean log ratio), kept."""
    ratios = F.broadcast(ratio_table(docs, trusted, text, key))  # at most 2 * BUCKETS rows
    return _verdicts(docs, ratios, text, [key], threshold)


def keep(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns. Rows are told apart by key and text."""
    ratios = F.broadcast(ratio_table(docs, trusted, text, key))
    named = docs.withColumn("_id", F.xxhash64(key, text))
    good = _verdicts(named, ratios, text, ["_id"], threshold).where("kept").select("_id").distinct()
    return named.join(good.hint("shuffle_hash"), "_id", "left_semi").drop("_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query over all documents; the target is what ``labels`` marks as quality 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules(docs, good).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
