"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is tested by rules on its own words: too few of them, too many in repeated windows, too many symbols or repeated lines,
words that are too short or too long on average. Documents that fail a rule are then counted by host (here: source). A host's failure
rate is shrunk towards an empirical beta prior that is fitted to all hosts by moments, so that a host with few documents is judged mostly
by the prior; documents of a host whose shrunk rate is above the limit are rejected with it. A document by itself is rejected for the first two rules only.

Behaviour at the edges: null text has no words and fails; a null host is a host of its own; repeated rows count and are
returned as often as they occur; texts of any length are read whole; with one host, or hosts that all fail alike, the prior is a fixed weak
one around the overall rate; empty tables give no rows; columns beside doc_id, text and the host's are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseworks.llm.workspace import WORD_CLASS, settle, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Bounds of the rules that count for hosts only, in percent: symbols to words, repeated lines to lines with a word, and characters to words.
SYMBOL_SHARE, LINE_SHARE, SHORTEST, LONGEST = 10, 30, 200, 1500


window_hash = F.xxhash64


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words inside windows of three that occur at least twice among _words.

    A window's hash and position share a long, the position in just as many low bits as it needs, so that sorting longs brings equal
    windows together. Neighbours with equal hash bits are then compared word by word; in a text where that finds two that differ, windows are
    sorted by their words instead.
    """
    at = lambda p: p.bitwiseAND(F.col("_low")).cast("int")
    head = lambda p: p.bitwiseAND(F.bitwise_not(F.col("_low")))
    word = lambda p, k: F.get("_words", at(p) + k)

    def same(a: Column, b: Column) -> Column:
        return (head(a) == head(b)) & (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))

    def near(p: Column, i: Column, step: int) -> Column:
        return same(p, F.coalesce(F.get("_packed", i + step), F.bitwise_not(p)))

    several = F.size(F.array_distinct("_windows")) < F.size("_windows")  # false for most documents, which end here
    bits = F.length(F.bin(F.size("_windows").cast("long")))
    rows = rows.withColumn("_low", F.when(several, F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1))
    packed = F.sort_array(F.transform("_windows", lambda h, i: head(h).bitwiseOR(i.cast("long"))))
    rows = rows.withColumn("_packed", F.when(F.col("_low").isNotNull(), packed))
    starts = F.transform("_packed", lambda p, i: F.when(near(p, i, -1) | near(p, i, 1), at(p)))

    def unlike(p: Column, i: Column) -> Column:
        after = F.coalesce(F.get("_packed", i + 1), F.bitwise_not(p))
        return (head(p) == head(after)) & ~same(p, after)

    clash = F.exists(F.transform("_packed", unlike), lambda x: x)
    rows = rows.withColumn("_spelt", F.when(clash, F.sort_array(F.transform("_packed", lambda p: F.struct(word(p, 0).alias("a"), word(p, 1).alias("b"), word(p, 2).alias("c"), at(p).alias("at"))))))
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    spelt = F.transform("_spelt", lambda x, i: F.when(alike(x, F.get("_spelt", i - 1)) | alike(x, F.get("_spelt", i + 1)), x["at"]))
    found = F.when(F.col("_spelt").isNotNull(), spelt).otherwise(starts)
    rows = rows.withColumn("_starts", F.when(F.col("_packed").isNotNull(), F.sort_array(F.filter(found, lambda p: p.isNotNull()))))
    gaps = F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, _host, the counts that the rules use, base_failed and any_failed, for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", F.col(host).alias("_host"), text.alias("_text"))
    step = step.select(
        "doc_id", "_host", words_of(F.col("_text")).alias("_words"),
        F.length(_removed(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_removed(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD_CLASS)).alias("_lines"),
    )
    step = step.select("doc_id", "_host", "word_chars", "n_symbols", "_words", F.size("_lines").cast("long").alias("_n_lines"), F.size("_words").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    window = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: window_hash(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    step = _with_repeats(step.withColumn("_windows", window))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = (100 * F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words")) | (100 * F.col("n_dup_lines") > LINE_SHARE * F.col("_n_lines"))
    more = more | (100 * F.col("word_chars") < SHORTEST * F.col("n_words")) | (100 * F.col("word_chars") > LONGEST * F.col("n_words"))
    return step.select("doc_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (failed | more).alias("any_failed"))


def host_verdicts(rules: DataFrame, limit: float) -> DataFrame:
    """A row for each host: _host, host_docs, host_failed, host_rate (shrunk) and host_kept."""
    hosts = rules.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("any_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    # Moments of a beta-binomial: the spread of rates between hosts, less what drawing documents alone would give.
    moments = hosts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("n"), F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("i"))
    mean = F.col("f") / F.col("n")
    chance = mean * (1 - mean)
    between = F.col("v") - chance * F.col("i")
    weight = F.when(between > 1e-9, F.greatest(F.lit(2.0), F.least(F.lit(1e6), chance / between - 1))).otherwise(F.lit(1e6))
    weight = F.when((F.col("v") == 0) | (chance == 0), F.lit(2.0)).otherwise(weight)
    prior = moments.select((mean * weight).alias("_alpha"), weight.alias("_weight"))
    shrunk = (F.col("host_failed") + F.col("_alpha")) / (F.col("host_docs") + F.col("_weight"))
    return hosts.join(F.broadcast(prior)).select(F.col("_host").alias("_of"), "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source", limit: float = 0.6) -> DataFrame:
    """Counts and verdicts for each row; kept is false if the document fails or its host's shrunk failure rate exceeds the limit."""
    rules = settle(document_rules(docs, host), "rules")
    joined = rules.join(host_verdicts(rules, limit), F.col("_host").eqNullSafe(F.col("_of")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_docs", "host_failed",
    )


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, source, t, w, len(w) AS n FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM x WHERE n >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lin AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM x),
b AS (SELECT x.doc_id, x.source, CAST(n AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
      FROM x JOIN lin USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
             OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words AS any_failed FROM b),
h AS (SELECT source, CAST(count(*) AS BIGINT) AS host_docs, CAST(sum(CAST(any_failed AS INTEGER)) AS BIGINT) AS host_failed FROM f GROUP BY source),
m AS (SELECT sum(host_failed) / sum(host_docs) AS mu, coalesce(var_samp(host_failed / host_docs), 0) AS v, avg(1 / host_docs) AS i FROM h),
p AS (SELECT mu, CASE WHEN v = 0 OR mu * (1 - mu) = 0 THEN 2e0 WHEN v - mu * (1 - mu) * i > 1e-9
                      THEN greatest(2e0, least(1e6, mu * (1 - mu) / (v - mu * (1 - mu) * i) - 1)) ELSE 1e6 END AS wt FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.host_failed + mu * wt) / (h.host_docs + wt) <= 6e-1 AS kept, h.host_docs, h.host_failed
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN p
"""
