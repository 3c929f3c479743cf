"""The registered queries of the dealt operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, collocations, imatch, mixing, pieces, quality_classifier, quality_rules, simhash, spelling, surrogates, token_counts, token_files, url_filters
from plumbline.sources.scratch import scratch_path
from plumbline.sources.tables import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Stands for the secret that a real run would pass.
SURROGATE_KEY = b"key of the synthetic tables"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge_urls(pages, url_filters.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, and a checksum of its ids, as read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "token-files")
    shards = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), folder)
    return token_files.read_token_digests(shards, folder)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts."""
    return quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_pii(docs, SURROGATE_KEY, counts=True)


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, against its edited text's and the next document's."""
    return imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word's near words, form and root."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases."""
    return collocations.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces and of the text they decode to."""
    return pieces.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_quality_classifier,
        op3_token_files,
        op4_token_counts,
        op5_quality_rules,
        op6_source_mixing,
        op7_simhash_near_dedup,
        op8_pii_surrogates,
        op9_imatch_fingerprints,
        op10_bpe_round_trip,
        op11_spelling_variants,
        op12_phrase_mining,
        op13_sentencepiece_round_trip,
    )
}

_RULES = ", ".join(f"('{verdict}', '{text[: text.index('/')]}', '{text[text.index('/') :]}')" for verdict, text in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": rf"""
WITH tails AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM tails),
 rules(verdict, host, path) AS (VALUES {_RULES}),
 fits AS (SELECT page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits USING (page_id)""",
    "op6_source_mixing": r"""
WITH items AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
 sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM items GROUP BY source),
 weighed AS (SELECT *, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
 levels AS (SELECT *, cap / w AS level, sum(cap) OVER o - cap AS caps_before, sum(w) OVER o - w AS w_before, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM weighed
  WINDOW o AS (ORDER BY cap / w, n ROWS UNBOUNDED PRECEDING)),
 common AS (SELECT arg_min((total - caps_before) / (w_all - w_before), (level, n)) AS c FROM levels WHERE (total - caps_before) / (w_all - w_before) <= level),
 targets AS (SELECT source, source_size, CASE WHEN c IS NULL THEN cap ELSE least(cap, c * w) END AS target FROM levels, common),
 plans AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(floor(target / source_size), 2) END AS whole FROM targets),
 budgets AS (SELECT *, CASE WHEN whole < 2 THEN target - whole * source_size ELSE 0 END AS budget FROM plans),
 hashes AS (SELECT source, h, sum(size) AS g FROM items GROUP BY source, h),
 sums AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS cum FROM hashes)
SELECT i.doc_id, i.size, b.source_size, b.target,
 ((b.whole + CASE WHEN b.budget > 0 AND (s.cum < b.budget OR s.cum - s.g < b.budget AND 2 * (b.budget - (s.cum - s.g)) >= s.g) THEN 1 ELSE 0 END) * i.size)::BIGINT AS taken
FROM items i JOIN budgets b ON i.source IS NOT DISTINCT FROM b.source JOIN sums s ON s.source IS NOT DISTINCT FROM i.source AND s.h = i.h""",
    "op12_phrase_mining": r"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
 totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
 grams AS (SELECT lang, k, list_aggregate(g, 'string_agg', ' ') AS phrase, count(*) AS f FROM (
   SELECT lang, k, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(ws) >= k)
  ) GROUP BY lang, k, phrase HAVING count(*) >= 30),
 cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM grams WHERE k > 1),
 halves AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.phrase = list_aggregate(c.ws[1 : c.cut], 'string_agg', ' ') AND x.k = c.cut
  JOIN grams y ON y.lang = c.lang AND y.phrase = list_aggregate(c.ws[c.cut + 1 :], 'string_agg', ' ') AND y.k = c.k - c.cut),
 scored AS (SELECT lang, k, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM halves GROUP BY ALL),
 inner_parts AS (SELECT lang, j, list_aggregate(ws[i : i + j - 1], 'string_agg', ' ') AS phrase, max(f) AS f FROM (
   SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT lang, k, f, string_split(phrase, ' ') AS ws FROM grams WHERE k > 2), (VALUES (2), (3)) parts(j) WHERE j < k) GROUP BY ALL),
 kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts p ON p.lang = s.lang AND p.j = s.k AND p.phrase = s.phrase WHERE p.f IS NULL OR 100::HUGEINT * p.f < 80::HUGEINT * s.a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
