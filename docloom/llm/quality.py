"""Per-document text quality statistics, and by them prose, list, table or junk.

All statistics are SQL over the whole text and stay in the JVM. A rule list is induced by incremental
reduced-error pruning from labelled documents (a bounded number, see ``samples``); its thresholds become
a CASE expression over the statistics. Several such lists vote.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.rules import RuleList, induce
from docloom.llm.samples import FUNCTION_WORDS, labelled

#: Documents of each kind that the rules are learned from; the bound of the sample.
LABELLED = 400
#: Rule lists that vote on a document; one list hangs on which of the sample it was grown and pruned on.
LISTS = 15
COMMON = sorted({w for words in FUNCTION_WORDS.values() for w in words.split() if len(w) > 1})
#: Lines that dress a document and say nothing of its body.
FRAME = (
    r"(?m)^[ \t]*(?:%.*|\\(?:documentclass|usepackage|title|author|date|maketitle|newcommand|renewcommand|providecommand|DeclareMathOperator|def"
    r"|begin|end|bibliographystyle|bibliography|label|include|input|subfile|hline|toprule|midrule|bottomrule|centering|caption|tableofcontents)\b.*)\r?$"
)
ITEM = r"^\s*(?:\\(?:bib)?item\b|\\(?:sub)+item\b|[-*•‣–+]{1,2}\s+\S|\(?\d{1,4}[.)]\s+\S|\[[^\]\s]{1,12}\]\s+\S|[a-zA-Z][.)]\s+\S)"
ROW = r"(?=[&\t|;, ])(?:&.*(?:&|\\\\)|\t[^\t]*\t|\|.*\||;[^;\s]*\d[^;]*;|;\S+;\S+$|,[-+]?\d[\d.]*,| {2,}[-+]?[\d.]+ {2,}\S)"
#: A line of a dump of bytes: where it stands, and the bytes by pairs of digits.
DUMP = r"^\s*[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){4,}"
END = r"[.!?…。;:][\"'”’)\]}]*\s*$"
#: The statistics that rules may ask for: those that don't hang on the length of words or the breaking of lines.
FEATURES = ("common_share", "other_script_share", "item_share", "row_share", "dump_share", "line_repeat", "word_variety", "digit_share", "symbol_share", "sentence_rate", "sentence_repeat")
ACCENT = r"\\[\"'`^~=.]\s*\{?\\?([A-Za-z])\}?"


def _part(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of ``text``, one row for each row; of a null text all are null, of a blank one 0.

    n_chars, n_lines, n_words: signs, lines of the body that aren't blank, words of two letters and more.
    common_share: words that are function words; other_script_share: letters outside of Latin among all;
    item_share, row_share, end_share: lines that open like an item, are cut into cells, end in punctuation;
    dump_share: lines that dump bytes;
    line_repeat: lines that stand there before; word_variety: different words to the square root of all;
    mean_word: letters a word; digit_share, symbol_share, long_share: signs that are digits, neither
    letters nor digits nor blanks, or in words of over 20 letters; sentence_rate: ends of sentences a word;
    sentence_repeat: sentences that stand there before.
    """
    lone = df.select(F.col(key), F.col(text).alias("_t"))
    body = lone.withColumn("_b", F.regexp_replace(F.regexp_replace("_t", FRAME, ""), ACCENT, "$1"))
    lines = F.filter(F.split("_b", r"\r?\n|\r"), lambda x: x.rlike(r"\S"))
    plain = F.regexp_replace("_b", r"\\[A-Za-z]+\*?|\$[^$\n]*\$", " ")
    parts = body.withColumns({"_l": lines, "_p": F.lower(plain)})
    # sentences are compared by their letters, as lines may be broken elsewhere
    sentence = F.filter(F.split(F.regexp_replace("_p", r"[^\p{L}.!?]+", ""), "[.!?]+"), lambda x: F.length(x) > 12)
    words = parts.withColumn("_s", sentence).withColumn("_w", F.regexp_extract_all("_p", F.lit(r"\p{L}{2,}"), F.lit(0)))
    count = lambda c: F.size(c).cast("double")
    without = lambda pattern: (F.length("_b") - F.length(F.regexp_replace("_b", pattern, ""))).cast("double")
    sums = words.select(
        key, F.length("_t").cast("bigint").alias("n_chars"), F.when(F.col("_t").isNotNull(), F.size("_l")).alias("n_lines"),
        F.when(F.col("_t").isNotNull(), F.size("_w")).alias("n_words"), F.length("_b").cast("double").alias("_n"),
        count(F.filter("_w", lambda w: w.isin(COMMON))).alias("_common"), count(F.array_distinct("_w")).alias("_distinct"),
        F.length(F.array_join("_w", "")).cast("double").alias("_letters"),
        F.length(F.array_join(F.filter("_w", lambda w: F.length(w) > 20), "")).cast("double").alias("_long"),
        count(F.filter("_l", lambda x: x.rlike(ITEM))).alias("_items"), count(F.filter("_l", lambda x: x.rlike(ROW))).alias("_rows"),
        count(F.filter("_l", lambda x: x.rlike(END))).alias("_ends"), count(F.filter("_l", lambda x: x.rlike(DUMP))).alias("_dumps"), count(F.array_distinct("_l")).alias("_lines"),
        count("_s").alias("_all_sentences"), count(F.array_distinct("_s")).alias("_own_sentences"),
        without(r"[^\x00-\x{24F}\P{L}]+").alias("_other"), without(r"\p{L}+").alias("_all_letters"), without(r"[0-9]+").alias("_digits"), without(r"\s+").alias("_blank"),
        F.regexp_count("_p", F.lit(r"[.!?](?=\s|$)(?<=\p{L}{2}[)\"'’]?[.!?])")).cast("double").alias("_sentences"),
    )
    n, w, ln = F.col("_n"), F.col("n_words"), F.col("n_lines")
    c = F.col
    return sums.select(
        key, "n_chars", "n_lines", "n_words", _part(c("_common"), w).alias("common_share"), _part(c("_other"), c("_all_letters")).alias("other_script_share"),
        _part(c("_items"), ln).alias("item_share"), _part(c("_rows"), ln).alias("row_share"), _part(c("_ends"), ln).alias("end_share"), _part(c("_dumps"), ln).alias("dump_share"), _part(ln - c("_lines"), ln).alias("line_repeat"),
        _part(c("_distinct"), F.sqrt(w)).alias("word_variety"), _part(c("_letters"), w).alias("mean_word"), _part(c("_digits"), n).alias("digit_share"),
        _part(n - c("_all_letters") - c("_digits") - c("_blank"), n).alias("symbol_share"), _part(c("_long"), c("_letters")).alias("long_share"), _part(c("_sentences"), w).alias("sentence_rate"),
        _part(c("_all_sentences") - c("_own_sentences"), c("_all_sentences")).alias("sentence_repeat"),
    )


@lru_cache(maxsize=2)
def _learned(spark: SparkSession, each: int, lists: int) -> tuple[RuleList, ...]:
    documents = labelled(each)
    rows = [(i, t) for i, (t, _) in enumerate(documents)]
    got = statistics(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas().sort_values("doc_id")
    x = {f: got[f].to_numpy(np.float64) for f in FEATURES}
    y = np.array([k for _, k in documents], object)
    return tuple(induce(x, y, ["table", "list", "junk"], "prose", seed) for seed in range(1, lists + 1))


def rules(spark: SparkSession, each: int = LABELLED, lists: int = LISTS) -> tuple[RuleList, ...]:
    """Rule lists learned from ``each`` labelled documents of every kind, each from other thirds of them for growing and pruning."""
    return _learned(spark, each, lists)


def voted(lists: tuple[RuleList, ...]) -> Column:
    """The kind that most of the rule lists give by the statistics; of equally many the first of table, list, junk and prose."""
    kinds = F.array(*(F.expr(r.sql()) for r in lists))
    votes = lambda kind: F.size(F.filter(kinds, lambda k: k == F.lit(kind)))
    most = F.greatest(*(F.struct(votes(kind).alias("n"), F.lit(-no).alias("no"), F.lit(kind).alias("kind")) for no, kind in enumerate(("table", "list", "junk", "prose"))))
    return most["kind"]


def classified(df: DataFrame, key: str = "doc_id", text: str = "text", each: int = LABELLED, lists: int = LISTS) -> DataFrame:
    """The statistics and ``kind``: prose, list, table or junk; null where the text is null, empty or blank.

    A document of another script than Latin is prose unless its lines say otherwise. Rows are kept as they
    are, repeated ones too; no shuffle.
    """
    kind = voted(rules(df.sparkSession, each, lists))
    stats = statistics(df, key, text)
    # a generator between them keeps a later filter on the kind from being rewritten in terms of the text,
    # where every statistic it asks for would be computed once more
    held = stats.select(F.inline(F.array(F.struct(*stats.columns))))
    return held.withColumn("kind", F.when(F.col("n_lines") > 0, kind))


def not_prose(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind`` of each document that isn't prose."""
    return classified(df, key, text).where(F.col("kind") != "prose").select(key, "kind")
