"""Quality rules by host: failures by domain, shrunken rates, verdicts joined back.

Each document gets counts and rule failures by itself. Failures are summed by
host; a host's rate of each rule is shrunk towards all hosts' rate by a beta prior
whose strength comes from how much the hosts' rates differ (method of moments). A
host whose shrunken rate passes a limit is refused, and with it its documents.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, text_blocks, written

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Hosts up to which the verdicts are broadcast.
MOST_BROADCAST = 100_000


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text.

    Words are runs without ASCII white space. A word is repeated if it lies in a
    window of three words that the text has twice or more.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, covered = Counter(windows), -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def document_counts(df: DataFrame, **columns: str) -> DataFrame:
    """The columns named (id, host), and the counts of ``text``; a null text has no words."""
    rows = pick(df, **columns)
    rows = rows.select(*[c for c in rows.columns if c != "text"], "text")
    schema = rows.drop("text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batch: pa.RecordBatch) -> dict:
        found = [counts(t) for _, block in text_blocks(batch.column(batch.num_columns - 1)) for t in block]
        own = {f.name: batch.column(i) for i, f in enumerate(schema.fields[: -len(COUNTS)])}
        return own | {name: [x[k] for x in found] for k, name in enumerate(COUNTS)}

    return map_arrow(rows, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Each rule's failure, from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "fails_base": base_failed(),
        "fails_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "fails_word_length": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words),
        "fails_dup_lines": F.col("n_dup_lines") >= 10,
    }


def host_verdicts(counted: DataFrame, limit: float = 0.5) -> DataFrame:
    """A row for each host: host, n_docs, a shrunken rate for each rule, and host_kept.

    The prior of a rule has the mean m of all documents and the strength
    s = m(1-m)/v - 1, where v is the variance of the hosts' rates beyond what
    their sizes explain; no such variance gives the strength ``n_docs`` of all
    documents, so that all hosts share one rate. A null host is a host.
    """
    rules = rule_failures()
    host = counted.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("bigint")).alias(name) for name, c in rules.items()])
    host = written(host, "hosts")
    n = F.col("n_docs")
    facts = [F.sum("n_docs").alias("all_docs"), F.count(F.lit(1)).alias("hosts")]
    facts += [F.sum(name).alias(f"sum_{name}") for name in rules]
    facts += [F.sum(F.col(name) * F.col(name) / n).alias(f"square_{name}") for name in rules]
    facts += [F.sum(1 / n).alias("inverse")]
    total = host.agg(*facts).first()
    out = ["host", "n_docs"]
    for name in rules:
        docs, hosts = total["all_docs"] or 0, total["hosts"]
        m = (total[f"sum_{name}"] or 0) / docs if docs else 0.0
        strength = float(max(docs, 1))
        if hosts > 1 and 0 < m < 1:
            # between-host variance by the method of moments for groups of unequal sizes
            between = (total[f"square_{name}"] - docs * m * m - (hosts - 1) * m * (1 - m)) / max(docs - hosts, 1)
            if between > 0:
                strength = min(strength, max(m * (1 - m) / between - 1, 1.0))
        out.append(((F.col(name) + strength * m) / (n + strength)).alias(name.replace("fails", "rate")))
    rated = host.select(*out)
    refused = [F.col(name.replace("fails", "rate")) > limit for name in rules]
    kept = F.lit(True)
    for r in refused:
        kept = kept & ~r
    return rated.withColumn("host_kept", kept)


def apply_rules(df: DataFrame, id_col: str, text_col: str, host_col: str, limit: float = 0.5) -> DataFrame:
    """id, the counts, base_failed, host rates, host_kept and kept of every row.

    Rows that repeat count as often as they stand there; an empty table gives an
    empty result. Texts are read once: counts go to the shared folder. The hosts'
    table is broadcast while it has at most MOST_BROADCAST rows; a larger one is
    joined by shuffle, which AQE splits where a host is hot.
    """
    counted = written(document_counts(df, id=id_col, host=host_col, text=text_col), "counts")
    verdicts = written(host_verdicts(counted, limit), "verdicts")
    if verdicts.count() <= MOST_BROADCAST:
        verdicts = F.broadcast(verdicts)
    hosts = verdicts.withColumnRenamed("host", "__host")
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    rates = [name.replace("fails", "rate") for name in rule_failures()]
    failed = base_failed()
    return joined.select("id", *COUNTS, failed.alias("base_failed"), *rates, "host_kept", (~failed & F.col("host_kept")).alias("kept"))
