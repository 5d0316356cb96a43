"""One query for each operator: (spark, sf_dir) -> DataFrame over the whole tables. SQL is given where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, hard_negatives, language, licenses, lines, packing, quality, simhash, substrings, token_counts, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` that holds 0.8 of the shingles of a `benchmark` item; see decontamination.contained() for nulls, repeats and empty texts."""
    return decontamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every row of `documents`, base phrases and templates; null texts count as empty, and every row stands for itself."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length table of all rows of `documents`, null and empty texts with length 0."""
    return token_counts.length_table(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of `documents`, learned from those that are not held out; a null doc_id is held out, a null text or one without a letter is und."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, language.fit_rows(F.col("doc_id")))
    held = F.coalesce(~language.fit_rows(F.col("doc_id")), F.lit(True)).alias("held_out")
    return model.score(docs.select("doc_id", "text")).select("doc_id", held, "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all rows of `documents` in sequences of 2048 tokens; a null or empty text is its END id alone."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every row of `documents`, labels learned from those that are not held out; a null doc_id is held out, null texts count as empty."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), quality.fit_rows(F.col("doc_id")))
    held = F.coalesce(~quality.fit_rows(F.col("doc_id")), F.lit(True)).alias("held_out")
    return model.score(docs, "score").select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of `pages`, by rule or by the purity of its template; null urls have an empty host and path."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.labels_by_number(pages, _table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the share of content lines of every row of `documents`; null texts count as empty and fail."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.judged(docs, lines.fit(docs, _table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every row of `documents`, labels learned from those that are not held out; a null doc_id is held out, null texts count as empty."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.fit_rows(F.col("doc_id")))
    held = F.coalesce(~toxicity.fit_rows(F.col("doc_id")), F.lit(True)).alias("held_out")
    return model.score(docs, "score").select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of `documents`; null and wordless texts have fingerprint zero, see simhash.near_duplicates() for null and repeated ids."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of `embeddings`; see hard_negatives.mined() for nulls, repeats and ties."""
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring deduplication leaves of every row of `documents`; see substrings.without_repeats() for nulls, repeats and ties."""
    found = substrings.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of `documents`, counted in all texts; see collocations.phrases() for nulls and repeats."""
    return collocations.best(collocations.phrases(_table(spark, sf_dir, "documents"))).drop("path_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_licenses, op3_token_counts, op4_language, op5_packing, op6_quality, op7_urls, op8_quality_rules, op9_toxicity, op10_simhash, op11_hard_negatives, op12_substrings, op13_collocations)}
ORACLES: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op1_decontamination": r"""
        WITH side AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
            UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
        worded AS (
            SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM side),
        shingled AS (
            SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
            FROM worded WHERE len(w) > 0),
        sizes AS (SELECT id, count(*) AS n_item FROM shingled WHERE side = 'i' GROUP BY id),
        shared AS (
            SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
            FROM shingled d JOIN shingled i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
        FROM shared JOIN sizes ON item_id = id WHERE n_shared >= 0.8 * n_item - 1e-9""",
    "op11_hard_negatives": """
        WITH rows AS (
            SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.row AS anchor, a.id AS anchor_id, b.row AS row, b.id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM rows a JOIN rows b ON a.row <> b.row WHERE a.id % 50 = 0),
        positives AS (
            SELECT anchor, anchor_id, row AS positive, id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, row) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, id, row)::INTEGER AS rank,
            id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op12_substrings": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {'pos': i, 'words': array_to_string(w[i:i + 19], ' ')}), recursive := true)
            FROM docs WHERE len(w) >= 20),
        repeated AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM repeated),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op13_collocations": r"""
        WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        found AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM worded, range(1, 4) t(k) WHERE len(w) >= k),
        counts AS (SELECT lang, k, phrase, count(*) AS f FROM found GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
        cuts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, w FROM candidates),
        scored AS (
            SELECT c.lang, c.k, c.phrase, a, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ')
            JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
        longer AS (
            SELECT lang, phrase, max(a) AS most FROM (
                SELECT lang, a, array_to_string(w[:2], ' ') AS phrase FROM candidates WHERE k = 3
                UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') FROM candidates WHERE k = 3) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM scored JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
        WHERE k = 3 OR coalesce(100 * most < 50 * a, true)
        QUALIFY rank <= 2000""",
}
