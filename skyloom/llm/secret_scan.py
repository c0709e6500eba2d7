"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

All work is done by Spark SQL expressions inside each row: no shuffle, no
Python.  A span is (kind, start, end) in code points, end exclusive.

Base kinds are ``assign``, ``access`` and ``hex``.  Candidates for the entropy
kinds are maximal runs of base64 characters with a digit, of 20 or more.  A
window of 20 characters slides over each; the counts of its characters and
the sum of c*log2(c) change by the entering and the leaving character only.
A candidate is a secret when its best window reaches its character class's
threshold and no allow-list pattern matches it.

Edge cases: null is the empty text; texts without spans give zero counts,
the digest of the empty string and an empty ``spans``.  Repeated rows repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])[A-Za-z0-9+/=_-]{20,}+"

WINDOW = 20
#: Bits per character that the best window must reach, by character class.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.7}
#: Candidates that are no secrets whatever their entropy.
ALLOWED = (
    r"^[0-9+/=_-]+$",  # numbers, dates, telephone numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[A-Za-z]+([-_/+=]+[A-Za-z]+)*[-_/+=]*[0-9]{1,6}[-_/+=]*$",  # names with a number at the end
    r"EXAMPLE|example",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)

KINDS = ("assign", "access", "hex", *THRESHOLDS)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPANS = "array<struct<s: int, k: int, e: int, m: string>>"


def found(pattern: str, kind: int, group: int = 0, least: int = 1) -> str:
    """SQL for the array of (s, k, e, m) of a pattern's leftmost non-overlapping matches in ``_t``.

    ``split`` gives the texts between the matches, so their lengths add up to
    positions.  Matches whose ``group`` has fewer than ``least`` characters go.
    """
    p = quoted(pattern)
    parts = f"zip_with(split(_t, {p}), regexp_extract_all(_t, {p}, 0), (s, m) -> named_struct('s', length(s), 'm', m))"
    parts = f"zip_with({parts}, regexp_extract_all(_t, {p}, {group}), (x, g) -> named_struct('s', x.s, 'm', x.m, 'g', length(g)))"
    span = f"named_struct('s', a.at + x.s, 'k', {kind}, 'e', a.at + x.s + length(x.m), 'm', x.m)"
    return f"""if(_t rlike {p}, aggregate({parts}, named_struct('at', 0, 'out', cast(array() as {SPANS})),
        (a, x) -> if(x.m is null, a, named_struct('at', a.at + x.s + length(x.m), 'out', if(x.g >= {least}, concat(a.out, array({span})), a.out))),
        a -> a.out), cast(array() as {SPANS}))"""


def entropy(codes: str) -> str:
    """SQL for the largest Shannon entropy of the windows of an array of ASCII codes.

    The state has the window's counts ``c`` and its sum ``s`` of c*log2(c);
    a step adds code ``y.a`` and takes away ``y.r`` (-1: none).
    """
    f = "array(0D, " + ", ".join(f"{c} * log2({c}D)" for c in range(1, WINDOW + 2)) + ")"
    change = f"if(y.a = y.r, 0D, {f}[acc.c[y.a] + 1] - {f}[acc.c[y.a]] + if(y.r < 0, 0D, {f}[acc.c[y.r] - 1] - {f}[acc.c[y.r]]))"
    return f"""aggregate(
        transform({codes}, (y, i) -> named_struct('a', y, 'i', i, 'r', if(i >= {WINDOW}, {codes}[i - {WINDOW}], -1))),
        named_struct('c', array_repeat(0, 128), 's', 0D, 'best', 0D),
        (acc, y) -> named_struct(
            'c', transform(acc.c, (n, j) -> n + if(j = y.a, 1, 0) - if(j = y.r, 1, 0)),
            's', acc.s + {change},
            'best', if(y.i >= {WINDOW - 1}, greatest(acc.best, log2({WINDOW}D) - (acc.s + {change}) / {WINDOW}), acc.best)),
        acc -> acc.best)"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: array of (s, k, e, m) sorted by start, then kind; ``k`` indexes ``KINDS``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = rows.select(
        "doc_id",
        F.expr(found(ASSIGN, 0, group=2, least=6)).alias("_a"),
        F.expr(found(ACCESS, 1)).alias("_b"),
        F.expr(found(HEX, 2)).alias("_c"),
        F.expr(found(CANDIDATE, -1)).alias("_d"),
    )
    allowed = " or ".join(f"x.m rlike {quoted(p)}" for p in ALLOWED)
    coded = base.select(
        "doc_id", "_a", "_b", "_c",
        F.expr(f"transform(filter(_d, x -> not ({allowed})), x -> named_struct('x', x, 'codes', transform(split(x.m, ''), y -> ascii(y))))").alias("_d"),
    )
    judged = coded.select(
        "doc_id", "_a", "_b", "_c",
        F.expr(f"transform(_d, d -> named_struct('x', d.x, 'hex', d.x.m rlike '^[0-9a-fA-F]+$', 'h', {entropy('d.codes')}))").alias("_d"),
    )
    ids = {k: i for i, k in enumerate(KINDS)}
    high = f"""transform(filter(_d, y -> y.h + 1e-9 >= if(y.hex, {THRESHOLDS['entropy_hex']}D, {THRESHOLDS['entropy_base64']}D)),
        y -> named_struct('s', y.x.s, 'k', if(y.hex, {ids['entropy_hex']}, {ids['entropy_base64']}), 'e', y.x.e, 'm', y.x.m))"""
    return judged.select("doc_id", F.expr(f"array_sort(concat(_a, _b, _c, {high}))").alias("found"))


def listed(condition: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(filter(found, x -> {condition}), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with every found string replaced by ``mark``."""
    hits = scan(docs.select(id_col, text_col).withColumn("_r", F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))), "_r", text_col)
    by_length = "array_sort(array_distinct(transform(found, x -> x.m)), (a, b) -> length(b) - length(a))"
    return hits.select(F.col("doc_id.i").alias("doc_id"), F.expr(f"aggregate({by_length}, coalesce(doc_id.t, ''), (a, m) -> replace(a, m, '{mark}'))").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.expr(f"cast(size(filter(found, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *n, F.sha2(F.expr(listed("x.k < 3")), 256).alias("base_sha256"), F.expr(listed("true")).alias("spans"))


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_spans(kind: int, pattern: str, group: int = 0, least: int = 1) -> str:
    """SQL for DuckDB: r, k, s, e and m of a pattern's matches, from the texts between them."""
    p = sql_text(pattern)
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::BIGINT"
    return f"""SELECT r, {kind} AS k, {size.format('b[1 : i]')} + {size.format('m[1 : i - 1]')} AS s, {size.format('b[1 : i]')} + {size.format('m[1 : i]')} AS e, m[i] AS m
        FROM (SELECT r, string_split_regex(t, {p}) AS b, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g,
            unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i FROM d) WHERE length(g[i]) >= {least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({sql_spans(0, ASSIGN, 2, 6)} UNION ALL {sql_spans(1, ACCESS)} UNION ALL {sql_spans(2, HEX)}),
cand AS (SELECT * FROM ({sql_spans(3, '[A-Za-z0-9+/=_-]{20,}')}) WHERE regexp_matches(m, '[0-9]') AND NOT ({' OR '.join(f'regexp_matches(m, {sql_text(a)})' for a in ALLOWED)})),
win AS (SELECT r, s, i, c FROM (SELECT r, s, i, ch, count(*) AS c FROM (
    SELECT r, s, i, unnest(string_split(m[i + 1 : i + {WINDOW}], '')) AS ch FROM (SELECT r, s, m, unnest(range(0, length(m) - {WINDOW - 1})) AS i FROM cand)) GROUP BY r, s, i, ch)),
best AS (SELECT r, s, max(h) AS h FROM (SELECT r, s, i, log2({WINDOW}) - sum(c * log2(c)) / {WINDOW} AS h FROM win GROUP BY r, s, i) GROUP BY r, s),
high AS (SELECT r, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS k, s, e, h FROM cand JOIN best USING (r, s)),
every AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM high WHERE h + 1e-9 >= CASE WHEN k = 3 THEN {THRESHOLDS['entropy_hex']} ELSE {THRESHOLDS['entropy_base64']} END),
said AS (SELECT r, k, s, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][k + 1] || ':' || s || ':' || e AS x FROM every),
per AS (SELECT r, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
    coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM said GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""
