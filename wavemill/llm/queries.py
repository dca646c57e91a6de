"""The registered queries of this subpackage: whole tables in, the contract's digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, cotraining, exact_dedup, hmm, mixing, ngram_join, pii, pivot_index, prefix_trie, secret_ledger, sentencepiece_codec, sharding, token_files
from .common import table


#: A deployment passes its own secret; a fixed one keeps the registered query's result the same in every run.
PII_KEY = b"registered query"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), words=3, share=90)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_amounts(table(spark, sf_dir, "documents"))


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit_quality(docs, table(spark, sf_dir, "labels"))
    return cotraining.score_quality(docs, model, keep=["doc_id"]).withColumn("kept", F.col("score") >= 0.5)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_index(table(spark, sf_dir, "documents"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.secrets_by_row(table(spark, sf_dir, "documents"))
    base = F.array_join(F.filter(F.split("spans", ","), lambda span: span.rlike("^(assign|access|hex):")), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), "spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_summary(turns, present=F.col("present")).drop("n_rows")


def op12_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = prefix_trie.named_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_donors(named))


QUERIES = {f.__name__: f for f in (op1_pii_pseudonyms, op2_sentencepiece_codec, op3_ngram_jaccard, op4_source_mixing, op5_pivot_index, op6_quality_cotraining, op7_token_files, op8_hidden_markov, op9_secret_ledger, op10_exact_dedup, op11_conversation_repair, op12_consistent_ring, op13_prefix_trie)}

WORDS = "[^\\x20\\x09-\\x0D]+"

# The contract's kinds in their order, patterns, capture group that is measured, fewest characters.
BASE_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: SQL's patterns know no look behind: the character before the span is matched and left out of it.
LOOK_BEHIND, CHARACTER_BEFORE = "(?<![A-Za-z0-9_-])", "(?:^|[^A-Za-z0-9_-])"


def _secrets_sql() -> str:
    # kind, pattern, the same without groups, group measured, group that is the span, fewest characters
    kinds = [(kind, pattern, pattern.replace("([", "(?:["), group, 0, least) for kind, pattern, group, least in BASE_SECRETS]
    for rule in secret_ledger.MORE_RULES:
        lead = CHARACTER_BEFORE if rule.pattern.startswith(LOOK_BEHIND) else ""
        body = rule.pattern.removeprefix(LOOK_BEHIND)
        kinds.append((rule.name, f"{lead}({body})", lead + body, 1, 1, rule.least))
    quoted = lambda pattern: pattern.replace("'", "''")
    cut = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS place, '{kind}' AS kind, {least} AS least_, regexp_extract_all(t, '{quoted(pattern)}') AS hits, string_split_regex(t, '{quoted(plain)}') AS gaps, "
        f"regexp_extract_all(t, '{quoted(pattern)}', {measured}) AS measured, regexp_extract_all(t, '{quoted(pattern)}', {span}) AS owns FROM d"
        for k, (kind, pattern, plain, measured, span, least) in enumerate(kinds)
    )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        cut AS ({cut}),
        laid AS (SELECT doc_id, kind, place, least_, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(measured) AS said, unnest(owns) AS own, unnest(range(len(hits))) AS nr FROM cut WHERE len(hits) > 0),
        spans AS (SELECT doc_id, kind, place, own, said, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY nr) AS e, least_ FROM laid),
        good AS (SELECT doc_id, kind, place, (e - length(own))::BIGINT AS s, e::BIGINT AS e FROM spans WHERE length(said) >= least_),
        said AS (
          SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base,
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM good GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN said USING (doc_id)
    """


def _crc32_sql(said: str) -> str:
    """The CRC-32 of a short string of plain characters, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({said}) + 1), lambda i: list_prepend(ascii(({said})[i])::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT)"


ORACLES = {
    "op13_prefix_trie": f"""
        WITH turns AS (
          SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS s FROM conversations WHERE conv_id IS NOT NULL),
        lists AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, s) AS own FROM turns GROUP BY conv_id),
        held AS (SELECT conv_id, own, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM lists),
        rebuilt AS (
          SELECT c.conv_id, list_concat(coalesce(d.own, [])[1:c.h], c.own[c.h + 1:]) AS seq FROM held c LEFT JOIN lists d ON d.conv_id = c.conv_id - c.conv_id % 5),
        prefixes AS (SELECT conv_id, d, len(seq) AS n, seq[1:d] AS p, CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
        nodes AS (
          SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, count(*) FILTER (n > d) = 0 AS childless,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
          FROM prefixes GROUP BY p, d),
        above AS (SELECT p[1:a] AS top, depth, a, childless, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM nodes)),
        subtrees AS (SELECT top, count(*) FILTER (depth = a + 1) AS n_children, count(*) FILTER (childless) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY top)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN subtrees s ON s.top = n.p LEFT JOIN nodes up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.p = n.p[1:n.depth - 1]
    """,
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op4_source_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(w) AS size, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]') AND NOT regexp_matches(x, '[0-9]'))) AS plain,
            len(list_distinct(w)) AS differ, strlen(array_to_string(w, '')) AS width
          FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
        k AS (
          SELECT *, -ln((CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
            / greatest(1e-6::DOUBLE, 1::DOUBLE / (1::DOUBLE + abs(width::DOUBLE / greatest(size, 1) - 6::DOUBLE))
              * (0.1::DOUBLE + plain::DOUBLE / greatest(size, 1)) * (0.1::DOUBLE + differ::DOUBLE / greatest(size, 1))) AS key FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
        f AS (
          SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) * weight > 3 * source_size * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS full_
          FROM w WINDOW b AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
          SELECT source, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE
            ELSE ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT full_) OVER ())::DOUBLE END AS target FROM f),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
        p AS (
          SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target + 0.5)::BIGINT - e.epochs * e.source_size AS rest,
            coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
    """,
    "op5_pivot_index": r"""
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
            label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
            AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e <> 0)) > 0 AS ok FROM embeddings),
        links AS MATERIALIZED (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.x) = len(b.x)
          WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
        reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, v.vec_id) AS component_id, coalesce(c.m, v.vec_id) = v.vec_id AS kept
        FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id LEFT JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY node) c ON c.node = v.vec_id
    """,
    "op9_secret_ledger": _secrets_sql(),
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS MATERIALIZED (
          SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
        FROM sets d LEFT JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY node) c ON c.node = d.doc_id
    """,
}
