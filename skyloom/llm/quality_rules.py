"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps the measurements and one bit
for each failed rule; a *policy* is a versioned mask over those bits, so a
change of policy or an ablation never reads the texts again.

Edge cases: a null text has no words and fails ``few_words``; an empty text
likewise.  Repeated rows give repeated ledger rows, an empty table an empty
ledger.  Input columns other than the id and the text are not carried, so
clashing names can't arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_chars, table, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "shouting", "100 * n_upper > 30 * word_chars"),
    Rule(4, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(6, "exclaiming", "100 * n_exclaims > 30 * n_words"),
)

#: Rules that any policy has.
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "2024.1": (*BASE, "symbols"),
    "2024.2": tuple(r.name for r in RULES),
}
CURRENT = "2024.2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measurements; the word windows are compared inside each row, without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = "(x -> length(translate(x, ' \\t\\n\\u000b\\f\\r', '')) > 0)"
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(F.col(text_col)).alias("_w"))
    second = first.select(
        "doc_id", "_t", "_w",
        F.expr(f"if(size(_w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(slice(_w, i + 1, {WINDOW}))))").alias("_h"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("_l"),
    )
    # Few texts have equal hashes; only those are sorted.
    third = second.select(
        "doc_id", "_t", "_w", "_l",
        F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))").alias("_s"),
    )
    near = "filter({s}, (x, k) -> (k > 0 and {s}[k - 1].{f} = x.{f}) or (k + 1 < size({s}) and {s}[k + 1].{f} = x.{f}))"
    fourth = third.select(
        "doc_id", "_t", "_w", "_l",
        # equal hashes are only candidates: the words themselves decide
        F.expr(f"array_sort(transform({near.format(s='_s', f='h')}, x -> named_struct('t', concat_ws(' ', slice(_w, x.i + 1, {WINDOW})), 'i', x.i)))").alias("_e"),
    )
    # A filter over the result must not be pushed below these steps, each of which it would repeat
    # several times over: it stops at an expression that isn't deterministic.
    places = f"array_sort(transform({near.format(s='_e', f='t')}, x -> x.i))"
    fifth = fourth.select("doc_id", "_t", "_w", "_l", F.expr(f"if(monotonically_increasing_id() >= 0, {places}, null)").alias("_p"))
    return fifth.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - count_chars(F.col("_t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        count_chars(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(aggregate(transform(_p, (p, k) -> if(k + 1 < size(_p), least({WINDOW}, _p[k + 1] - p), {WINDOW})), 0, (a, x) -> a + x) as bigint)").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count_chars(F.col("_t"), UPPER).alias("n_upper"),
        count_chars(F.col("_t"), "!").alias("n_exclaims"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and ``fail_bits``: bit b is set if rule b failed."""
    bits = " + ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    return measured(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def verdict(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``kept`` to a ledger."""
    return rows.withColumn("kept", verdict(policy))


def filtered(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that the policy keeps."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    # above a column that isn't deterministic, the filter reads the measurements instead of repeating them
    rows = ledger(row, "_row", "_text").withColumn("_place", F.monotonically_increasing_id())
    return rows.where(verdict(policy) & (F.col("_place") >= 0)).select("doc_id.*")


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (and
    so would be kept without it), and the rejected in all.

    The ledger is first counted by its masked bits: at most 2^rules rows leave
    the map side, however many documents there are.
    """
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]]
    each = counted.withColumn("r", F.explode(F.array(*rules)))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("rejected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(sum(1 << r.bit for r in RULES if r.name in BASE))) != 0
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 8], ' ') AS s
  FROM (SELECT r, w, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
dup AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(j - i, 8))) AS n FROM dup GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM d JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (%(bits)s)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, fail_bits & %(mask)d = 0 AS kept, fail_bits FROM b
""" % {"bits": " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES), "mask": mask(CURRENT)}
