"""Quality rules: a threshold table compiled into Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "en": "the of and to in a is that for it as was with be by on not he his but are this from or have an they which",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
    "fr": "de la le et les des en un une du que dans qui par pour au sur pas plus est se ne ce il",
}

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: (metric, least, most); None: no bound. A text is kept when each metric is within its bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.50),
    ("repeat_word_share", None, 0.50),
]


def compiled(thresholds: list[tuple[str, float | None, float | None]], metrics: dict[str, Column]) -> Column:
    """The threshold table as one boolean Column over the metrics it names."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if name not in metrics:
            raise ValueError(f"no such metric: {name}")
        if least is not None:
            out = out & (metrics[name] >= F.lit(least))
        if most is not None:
            out = out & (metrics[name] <= F.lit(most))
    return out


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' ids with the raw counts that the rules need. A null text has no words; each input row gives one row.

    Repeated 3-word windows are found in two steps: 33 bits of each window's hash and its place, as one long, are sorted, which leaves few
    places; those are then compared word for word.
    """
    d = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select(id_col, "t", F.array_remove(F.split("t", SPACES), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    lower = {w for words in STOP_WORDS.values() for w in words.split()}
    stops = sorted(lower | {w.capitalize() for w in lower})
    n = F.size("w")
    d = d.select(
        id_col,
        "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        F.when(
            n >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.shiftleft(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), 31).bitwiseOR(i.cast("long")),
                )
            ),
        ).alias("s"),
    )
    rest = [c for c in d.columns if c not in ("s", "w")]
    place = lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")
    alike = F.zip_with(
        F.slice("s", 1, F.size("s") - 1),
        F.slice("s", 2, F.size("s") - 1),
        lambda a, b: F.when(F.shiftright(a, 31) == F.shiftright(b, 31), F.array(place(a), place(b))).otherwise(F.array().cast("array<int>")),
    )
    d = d.select(*rest, "w", F.when(F.size("s") > 1, F.array_distinct(F.flatten(alike))).alias("c"))
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    d = d.select(*rest, F.when(F.size("c") > 1, F.sort_array(F.transform("c", lambda i: F.struct(window(i).alias("g"), i.alias("i"))))).alias("s"))
    equal = F.zip_with(
        F.slice("s", 1, F.size("s") - 1),
        F.slice("s", 2, F.size("s") - 1),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    d = d.select(*rest, F.when(F.size("s") > 1, F.sort_array(F.array_distinct(F.flatten(equal)))).alias("p"))
    # windows at p, p' > p cover min(3, p' - p) words before p' begins, the last one 3
    covered = F.aggregate(
        F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(F.lit(3), b - a)),
        F.lit(3),
        lambda x, y: x + y,
    )
    return d.select(*rest, F.when(F.size("p") > 1, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def quality_rules(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each input row: counts, base_failed, and kept by the threshold table.

    Null and empty texts have no words, fail the base rule and are not kept. Repeated rows give repeated
    results; other columns are not read. Only Columns are used, without a shuffle, so a hot source or a very long text
    needs no special care.
    """
    m = measured(docs, text, id_col)
    least_one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    metrics = {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / least_one("n_words"),
        "symbols_per_word": F.col("n_symbols") / least_one("n_words"),
        "stop_word_share": F.col("n_stop_words") / least_one("n_words"),
        "dup_line_share": F.col("n_dup_lines") / least_one("n_lines"),
        "repeat_word_share": F.col("n_repeat_words") / least_one("n_words"),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = compiled(THRESHOLDS if thresholds is None else thresholds, metrics)
    return m.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"))
