"""Quality rules with adaptive thresholds per language and source.

Everything runs as DataFrame expressions. Each text becomes a few counts in one
pass; KLL quantile sketches of their ratios, which merge across partitions,
give every (language, source) group its own fences; a join brings the fences
back to the rows.

A metric fails above ``q75 + SPREADS * (q75 - q25) + margin`` of its group (mean
word length also below the mirrored fence), so a group loses its outliers, not a
fixed share of its rows, and a group of like rows loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import settle

#: Items a sketch keeps per level; a group of fewer rows has exact quantiles.
SKETCH_SIZE = 800
#: Quartile distances beyond a quartile that still pass.
SPREADS = 4.0
#: Width added to the fences of each metric, for groups whose quartiles coincide.
MARGINS = {"symbol_share": 0.05, "repeat_share": 0.15, "dup_line_share": 0.15, "mean_word": 2.0}
#: Base rule: at least so many words, and at most half of them in repeated windows.
MIN_WORDS = 50

#: Bits of a packed long that hold a position.
POSITION_BITS = 24

_BLANK = r"[\x20\x09-\x0D]"


def split_words(text: Column) -> Column:
    """Words of a text; an empty array where it has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_BLANK}+"))


def _covered(places: Column) -> Column:
    """Words covered by the 3-word windows that start at ``places`` (ascending)."""
    return F.aggregate(
        places,
        F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("bigint"), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _ends(pairs: Column, width: int) -> Column:
    """Both halves of packed position pairs, distinct and ascending."""
    low = (1 << width) - 1
    both = F.concat(
        F.transform(pairs, lambda x: F.shiftright(x, width)), F.transform(pairs, lambda x: x.bitwiseAND(F.lit(low)))
    )
    return F.sort_array(F.array_distinct(both))


def _same_neighbours(ordered: Column, same, place, width: int) -> Column:
    """Packed positions of neighbours in ``ordered`` for which ``same`` holds."""
    pairs = F.zip_with(
        ordered,
        F.slice(ordered, 2, F.size(ordered)),
        lambda a, b: F.when(same(a, b), F.shiftleft(place(a), width).bitwiseOR(place(b))),
    )
    return F.filter(pairs, lambda x: x.isNotNull())


def with_repeats(grams: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``_grams``, the window hashes (null: fewer than 3 words).

    Sorting puts equal windows side by side. Hash and position are packed in one
    long, the hash cut to 40 bits, because longs sort several times faster than
    pairs. Where the cut makes different hashes look equal, or a text has 2^24
    windows, whole (hash, position) pairs are sorted instead, so the count is exact.
    """
    kept = [c for c in grams.columns if c != "_grams"]
    top, low = ~((1 << POSITION_BITS) - 1), (1 << POSITION_BITS) - 1
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    some = grams.select(*kept, F.when(repeated, F.col("_grams")).alias("_grams"))
    packed = F.sort_array(F.transform("_grams", lambda h, p: h.bitwiseAND(F.lit(top)).bitwiseOR(p.cast("bigint"))))
    ordered = some.select(*kept, "_grams", packed.alias("_packed"))
    hits = _same_neighbours(
        F.col("_packed"),
        lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.lit(top)) == 0,
        lambda x: x.bitwiseAND(F.lit(low)),
        POSITION_BITS,
    )
    found = ordered.select(*kept, "_grams", hits.alias("_hits"), F.size("_packed").alias("_n"))
    mixed = (F.col("_n") > low) | F.exists(
        "_hits",
        lambda x: F.get("_grams", F.shiftright(x, POSITION_BITS).cast("int")) != F.get("_grams", x.bitwiseAND(F.lit(low)).cast("int")),
    )
    pairs = F.sort_array(F.transform("_grams", lambda h, p: F.struct(h.alias("h"), p.cast("bigint").alias("p"))))
    exact = found.select(
        *kept, "_hits", mixed.alias("_mixed"), F.when(mixed, pairs).alias("_pairs"),
    )
    slow = _same_neighbours(F.col("_pairs"), lambda a, b: a["h"] == b["h"], lambda x: x["p"], 31)
    count = F.when(F.col("_mixed"), _covered(_ends(slow, 31))).when(
        F.size("_hits") > 0, _covered(_ends(F.col("_hits"), POSITION_BITS))
    )
    return exact.select(*kept, F.coalesce(count, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text.

    Null and empty texts count zero everywhere. Other columns are dropped, so
    columns of the same names as the counts do not matter.
    """
    base = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_t"))
    worded = base.select("doc_id", "lang", "source", "_t", split_words(F.col("_t")).alias("_w"))
    n = F.size("_w")
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = worded.select(
        "doc_id", "lang", "source", n.cast("bigint").alias("n_words"), F.array_join("_w", "").alias("_joined"),
        lines.alias("_lines"), grams.alias("_grams"),
    )
    return with_repeats(counted.select(
        "doc_id", "lang", "source", "n_words", "_grams",
        F.char_length("_joined").cast("bigint").alias("word_chars"),
        F.regexp_count("_joined", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
    ))


def metrics(counts: DataFrame) -> DataFrame:
    """The ratios the fences are drawn on; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "mean_word": share("word_chars", "n_words"),
        }
    )


def fences(measured: DataFrame) -> DataFrame:
    """Per (lang, source): lower and upper fence of every metric, from one sketch each."""
    worded = measured.filter("n_words > 0")
    sketched = worded.groupBy("lang", "source").agg(
        *[F.kll_sketch_agg_double(m, F.lit(SKETCH_SIZE)).alias(m) for m in MARGINS]
    )
    at = lambda m, q: F.kll_sketch_get_quantile_double(m, F.lit(q))
    cut = []
    for m, margin in MARGINS.items():
        reach = SPREADS * (at(m, 0.75) - at(m, 0.25)) + margin
        cut += [(at(m, 0.25) - reach).alias(f"{m}_low"), (at(m, 0.75) + reach).alias(f"{m}_high")]
    return sketched.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *cut)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, the base rule and the verdict of the adaptive rules for every document.

    Null languages and sources form groups of their own. An empty table gives an
    empty result. Repeated rows are judged each for itself. The counts are
    written to shared storage once, because fences and verdicts both read them.
    """
    measured = metrics(settle(text_counts(docs), "rule-counts"))
    joined = measured.join(
        fences(measured),
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    outside = [F.col(m) > F.col(f"{m}_high") for m in MARGINS] + [F.col("mean_word") < F.col("mean_word_low")]
    fails = outside[0]
    for x in outside[1:]:
        fails = fails | x
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.coalesce(fails, F.lit(False))).alias("kept"),
    )
