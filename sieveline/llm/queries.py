"""One registered query per corpus operator, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, html, katz, langid, licenses, linededup, packing, pii, quality, simhash, variants, wavelet, whitening
from sieveline.llm.common import Scratch, crc_remainder, table
from sieveline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """The public tokenizer file, where it is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def _quality_sql() -> str:
    """The base counts, the risk-controlled choice of cutoffs and the verdict, for DuckDB."""
    control = quality.RiskControl()
    limit = control.max_false_rejection / len(quality.CUTOFFS)
    cells = ", ".join(f"('{r}', {i}, {c})" for r, cuts in quality.CUTOFFS.items() for i, c in enumerate(cuts))
    share = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in quality.CUTOFFS) + " END"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, w[i:i + 4] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY rid),
m AS (
  SELECT rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes,
         len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
  FROM d LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_share,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_share, coalesce(n_echoes / nullif(n_words, 0), 0.0) AS echo_share,
         coalesce(n_capitals / nullif(n_letters, 0), 0.0) AS capital_share
  FROM m),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
held AS (SELECT f.*, quality FROM f JOIN truth USING (doc_id) WHERE NOT base_failed),
cells(rule, step, cutoff) AS (VALUES {cells}),
counts AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND x > cutoff) AS lost,
         count(*) FILTER (WHERE quality = 0 AND x > cutoff) AS caught
  FROM (SELECT held.*, rule, step, cutoff, {share} AS x FROM held, cells) GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN lost > n * {limit} THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, lost + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit}))))) END AS p_value
  FROM counts),
open AS (
  SELECT *, min(CASE WHEN p_value <= {control.level} / (strata * {len(quality.CUTOFFS)}) THEN 1 ELSE 0 END)
              OVER (PARTITION BY stratum, rule ORDER BY step) AS admissible
  FROM tested, (SELECT count(DISTINCT stratum) AS strata FROM held)),
best AS (
  SELECT stratum, rule, arg_max(cutoff, (caught - {control.good_cost} * lost) * 1000 - step) AS cutoff
  FROM open WHERE admissible = 1 AND caught - {control.good_cost} * lost > 0 GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT rid FROM (SELECT rid, cutoff, {share} AS x FROM f JOIN best USING (stratum)) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM f"""


@_query("op2_quality_rules", _quality_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, cutoffs = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.verdicts(measured, cutoffs).select("doc_id", *base)


@_query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", hexed, "component_id")


@_query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.RULES]
    digest = F.sha2(pii.listed(with_more=False), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed(with_more=True).alias("spans"))


@_query("op6_token_shards")
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return wavelet.read_shards(spark, path, Scratch(spark))


@_query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder(3) == 1)
    found = langid.train(docs.where("not held_out")).predict(docs, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, size=2048)


@_query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak benchmark items: one row each, with its items and the best of them."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("item_id", "n_windows", "n_matched", "coverage", "changed"), F.struct("coverage", -F.col("item_id")))
    one = found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), best.alias("b"))
    return one.select("doc_id", "n_items", "b.*")


@_query("op10_katz")
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), held_out=crc_remainder(7) == 2)


_LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE key NOT IN (SELECT key FROM often) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@_query("op11_line_dedup", _LINES_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.keep_lines(docs, linededup.line_bitmaps(docs, Scratch(spark), min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), min_chars=7, min_n=2, typo_every=31)
    return variants.group(words, Scratch(spark), ratio=10)


@_query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), Scratch(spark), components=16)
