"""Secret scans with an incremental blob ledger: each distinct content is scanned once for each version of the rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, frugal, likely, shared_dir

#: kind, pattern, group that is measured, its least length, flags, substrings of which lower-cased text must hold one.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0, ("akia",)),
    ("hex", r"[0-9a-f]+", 0, 24, 0, ()),
)
MORE = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1, 0, ("private key",)),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, 0, ("eyj",)),
    ("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, 0, ("gh",)),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, 0, ("xox",)),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@[^\s/@]+", 0, 1, 0, ("://",)),
)
RULES = BASE + MORE
FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def version_of(rules: tuple) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, rules: tuple = RULES) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of every finding in code points, by start and then kind as listed."""
    low, out = text.lower(), []
    for order, (kind, pattern, group, least, flags, needles) in enumerate(rules):
        if needles and not any(n in low for n in needles):
            continue
        if kind == "hex":
            pattern = r"[0-9a-f]{24,}"  # the same runs: a run is matched whole or not at all
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text, flags) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def _scan(rules: tuple) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    version = version_of(rules)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for blob, text in zip(pdf["blob"], pdf["t"], strict=True):
                spans = find_spans(text, rules)
                base = [s for s in spans if s[1] < len(BASE)]
                n = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((blob, version, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return scan


def _blob(text_col: str) -> Column:
    return F.sha2(F.coalesce(column(text_col), F.lit("")).cast("binary"), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Findings of contents whose pair (blob, rule version) the ledger doesn't hold.

    Copies meet in their own task before the exchange (first of a group), so a content that fills a third of the rows
    crosses it once for each task.  What the ledger holds doesn't cross it at all, but for the few texts that a filter of fixed
    size can't tell from unseen ones.  Null text is the empty blob; an empty table gives no rows."""
    texts = docs.select(_blob(text_col).alias("blob"), F.coalesce(column(text_col), F.lit("")).alias("t"))
    seen = None if ledger is None else ledger.where(F.col("rule_version") == version_of(rules)).select("blob")
    if seen is None or seen.isEmpty():
        return texts.groupBy("blob").agg(F.first("t").alias("t")).mapInPandas(frugal(_scan(rules)), FINDINGS)
    node = F.xxhash64("blob").alias("node")
    unseen = texts.select("blob").distinct().join(seen, "blob", "left_anti").select(node)
    once = likely(texts.select("*", node), unseen).groupBy("blob").agg(F.first("t").alias("t"))
    return once.join(seen, "blob", "left_anti").mapInPandas(frugal(_scan(rules)), FINDINGS)


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger: a row for each pair of blob and rule version that was ever scanned."""
    return spark.read.schema(FINDINGS).parquet(path)


def new_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger; it is an error if something stands at path."""
    spark.createDataFrame([], FINDINGS).write.parquet(path)


def append(docs: DataFrame, path: str, text_col: str = "text", rules: tuple = RULES) -> None:
    """Scan what the ledger at path hasn't seen under these rules, and store it there.  One commit for a run: a run that fails
    leaves the ledger as it was, and a run that is repeated finds its work done."""
    scan_unseen(docs, ledger_at(docs.sparkSession, path), text_col, rules).write.mode("append").parquet(path)


def findings_by_path(docs: DataFrame, ledger: DataFrame, path_cols: list[str], text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """path_cols, blob and the ledger's findings for every path and version of docs, under these rules; what wasn't scanned has
    no row.  Repeated rows give repeated results."""
    paths = docs.select(*(column(c).alias(f"path{i}") for i, c in enumerate(path_cols)), _blob(text_col).alias("blob"))
    found = paths.join(ledger.where(F.col("rule_version") == version_of(rules)), "blob")
    return found.select(*(F.col(f"path{i}").alias(c) for i, c in enumerate(path_cols)), "blob", *(c.split()[0] for c in FINDINGS.split(", ")[1:]))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, from a stored ledger that two runs have filled: the first had half of the documents, the
    second has all and scans only contents that the first hadn't seen.  A null text is empty; repeated rows give repeated results."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), shared_dir(spark)
    new_ledger(spark, ledger)
    append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    append(docs, ledger)
    found = findings_by_path(docs, ledger_at(spark, ledger), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob", "rule_version")


def _oracle() -> str:
    """Places of matches from the lengths of matches and of what lies between them."""
    kinds = []
    for order, (kind, pattern, group, least, flags, _) in enumerate(RULES):
        p = ("(?i)" if flags & re.I else "") + pattern
        p = p.replace("'", "''")
        kinds.append(f"SELECT doc_id, {order} AS o, '{kind}' AS kind, {least} AS least, regexp_split_to_array(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs FROM d")
    n = ", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in BASE)
    order = "ORDER BY start, o"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({" UNION ALL ".join(kinds)})),
f AS (SELECT doc_id, o, kind, len(array_to_string(parts[1:i], '')) + len(array_to_string(ms[1:i - 1], '')) AS start, len(ms[i]) AS n FROM m WHERE len(gs[i]) >= least),
g AS (SELECT doc_id, {n}, string_agg(kind || ':' || start || ':' || (start + n), ',' {order}) FILTER (o < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || (start + n), ',' {order}) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob, '{version_of(RULES)}' AS rule_version
FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES = {"op10_secret_scan": _oracle()}
