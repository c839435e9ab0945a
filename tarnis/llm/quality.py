"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, its measurement is kept.

Policies are versioned sets of bits. Applying one, or asking what each rule of it alone decides, needs no text: only
the ledger, grouped by its bit sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import WORD_SPACE, fresh

NO_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A named test of the measurements; true means that the text fails it. Texts without words fail no ratio."""

    name: str
    fails: Callable[[], Column]


def _ratio(part: str, whole: str, above: float) -> Callable[[], Column]:
    return lambda: F.col(part) > F.lit(above) * F.col(whole)


#: The order is the order of the bits; append only.
RULES: list[Rule] = [
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("many_words", lambda: F.col("n_words") > 1_000_000),
    Rule("symbols", _ratio("n_symbols", "n_words", 0.5)),
    Rule("duplicate_lines", _ratio("n_dup_lines", "n_lines", 0.6)),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("shouting", _ratio("n_upper", "n_letters", 0.5)),
    Rule("digits", _ratio("n_digits", "word_chars", 0.3)),
    Rule("few_letters", lambda: F.col("n_letters") < 0.5 * F.col("word_chars")),
    Rule("exclamations", _ratio("n_exclamations", "n_words", 0.3)),
    Rule("bars", _ratio("n_bars", "n_words", 0.2)),
    Rule("few_distinct_words", lambda: (F.col("n_words") >= 50) & (F.col("n_distinct") * 20 < F.sqrt("n_words") * 10)),
    Rule("ellipsis_lines", _ratio("n_ellipsis_lines", "n_lines", 0.5)),
    Rule("bullet_lines", _ratio("n_bullet_lines", "n_lines", 0.9)),
    Rule("replacement_characters", _ratio("n_replacement", "word_chars", 0.01)),
]

BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versions of the policy: the rules that reject. A version is never changed, only followed by another.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["many_words"] | BIT["symbols"] | BIT["duplicate_lines"] | BIT["few_letters"] | BIT["digits"],
    "v2": sum(BIT.values()),
    "v3": sum(BIT.values()) - BIT["many_words"],
}
CURRENT = "v2"
#: The corpus pipeline rejects no text for its length alone.
PIPELINE = "v3"

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
    "n_digits", "n_exclamations", "n_bars", "n_distinct", "n_ellipsis_lines", "n_bullet_lines", "n_replacement",
]


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class."""
    return F.char_length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements of each whole text.

    n_words: words are runs without ASCII white space; word_chars: their characters; n_symbols: characters of
    `#*$%&|<>`; n_dup_lines: lines with a word, equal to an earlier line; n_repeat_words: words in a three-word
    window found twice or more in the text, the first included; n_lines: lines with a word. Windows are compared by
    64-bit hashes of their words within one text.
    """
    held = {name: fresh(docs, f"__{name}") for name in ("text", "lines", "words", "windows", "sorted", "again")}
    text, lines, words, windows = (F.col(held[n]) for n in ("text", "lines", "words", "windows"))
    sorted_, again = F.col(held["sorted"]), F.col(held["again"])
    empty = F.array().cast("array<string>")
    out = docs.withColumn(held["text"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    flat = F.trim(F.regexp_replace(text, WORD_SPACE, " "))
    out = out.withColumns(
        {
            held["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE)),
            held["words"]: F.when(flat == "", empty).otherwise(F.split(flat, " ")),
            "word_chars": F.char_length(F.regexp_replace(text, WORD_SPACE, "")).cast("long"),
            "n_symbols": _count(text, "#*$%&|<>"),
            "n_letters": _count(text, r"\p{L}"),
            "n_upper": _count(text, r"\p{Lu}"),
            "n_digits": _count(text, "0-9"),
            "n_exclamations": _count(text, "!"),
            "n_bars": _count(text, "|"),
            "n_replacement": _count(text, "�"),
        }
    )
    positions = F.sequence(F.lit(1), F.size(words) - 2)
    hashed = F.transform(
        positions, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_distinct": F.size(F.array_distinct(words)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•] "))).cast("long"),
            held["windows"]: F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # only texts with a repeated window sort (hash, place) to find the places that have a like
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(held["sorted"], F.when(repeats, placed).otherwise(none))
    alike = F.filter(
        sorted_,
        lambda x, k: ((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"]))
        | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False)),
    )
    out = out.withColumn(held["again"], F.sort_array(F.transform(alike, lambda x: x["i"])))
    # a window covers three words; the next one begins d later and adds min(d, 3)
    gaps = F.zip_with(again, F.slice(again, 2, F.greatest(F.size(again), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumn("n_repeat_words", covered).drop(*held.values())


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with all measurements and `failures`, a bit for each rule of RULES that the text fails.

    A null text counts as empty: zero measurements, and it fails `few_words`. Every row gets its own result,
    repeated ones too. A column of a measurement's name is replaced.
    """
    measured = measure(docs.drop(*MEASURES, "failures"), text_col)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    # Depending on the partition (which changes nothing) keeps later filters above this step. Pushed below it, they would
    # repeat the measurements in every condition.
    still = F.when(F.spark_partition_id() < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("failures", bits.bitwiseOR(still))


def apply_policy(rows: DataFrame, version: str = CURRENT, name: str = "kept") -> DataFrame:
    """Adds whether the ledger's row passes all rules of a policy."""
    return rows.withColumn(name, F.col("failures").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: texts that fail it, texts that it alone rejects, and texts kept without it.

    The ledger is first counted by its bit sets, so the rules are compared over at most 2^rules small rows; no text
    and no rule is evaluated again.
    """
    mask = POLICIES[version]
    sets = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in RULES if BIT[r.name] & mask]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in chosen)))
    wide = sets.select("failed", "n", each.alias("r")).select("failed", "n", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return wide.groupBy("rule", "bit").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", version: str = CURRENT) -> DataFrame:
    """The rows that a policy keeps, with the columns they came with."""
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    kept = apply_policy(ledger(renamed, f"c{columns.index(text_col)}"), version, "kept").where("kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
