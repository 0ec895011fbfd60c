"""One query per operator of this subpackage over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.catalog.registry import Catalog, table

from . import (
    bpe, classifier, clusters, decontamination, lines, pii, quality, secrets, sharding, simhash, spelling, substrings,
    token_counts,
)

LLM = Catalog()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256_of(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def span_digest(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts and digest of the spans of the base kinds, and all spans."""
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *(F.size(of(name)).cast("long").alias(f"n_{name}") for name in base),
        sha256_of(span_list(of(*base))).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def _secret_sql() -> str:
    """The plain scan of every rule over every text."""
    plain = {"access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern, group, least = plain.get(rule.kind, (rule.pattern, rule.group, rule.least))
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS k, {least} AS least,
  unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 2)) AS i,
  unnest(list_append(regexp_extract_all(text, '{pattern}', 0), NULL)) AS m,
  unnest(list_append(regexp_extract_all(text, '{pattern}', {group}), NULL)) AS v,
  unnest(string_split_regex(text, '{pattern}')) AS gap FROM doc""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    counts = ", ".join(
        f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base
    )
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
part AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (
    PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM part WINDOW w AS (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING)
), span AS (
  SELECT doc_id, kind, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS t
  FROM placed WHERE m IS NOT NULL AND length(v) >= least
), listed AS (
  SELECT doc_id, {counts},
    string_agg(t, ',' ORDER BY s, k) FILTER (kind IN ({base})) AS base,
    string_agg(t, ',' ORDER BY s, k) AS spans
  FROM span GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc d LEFT JOIN listed l USING (doc_id)"""


@LLM.add(_secret_sql())
def op1_secrets(spark, folder: str) -> DataFrame:
    """Secrets in every document: counts and spans."""
    found = secrets.find_secrets(table(spark, folder, "documents"))
    return span_digest(found, [r.kind for r in secrets.RULES if r.base])


@LLM.add()
def op3_bpe(spark, folder: str) -> DataFrame:
    """BPE ids and decoded text of every document, as digests."""
    coded = bpe.encode_decode(table(spark, folder, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_of(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


@LLM.add()
def op5_pii(spark, folder: str) -> DataFrame:
    """Personal data in every document: counts and spans."""
    found = pii.personal_data(table(spark, folder, "documents"))
    return span_digest(found, [kind.name for kind in pii.KINDS if kind.base])


@LLM.add()
def op8_quality_rules(spark, folder: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    return quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@LLM.add()
def op9_simhash(spark, folder: str) -> DataFrame:
    """Fingerprint and class of every document, four-word shingles, four bits."""
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@LLM.add(r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, parts[n] AS line, n FROM split, unnest(range(1, len(parts) + 1)) AS t(n)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op4_line_dedup(spark, folder: str) -> DataFrame:
    """Documents without lines that an earlier document has too."""
    kept = lines.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("text")).alias("kept_sha256"))


@LLM.add(r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, n, md5(array_to_string(words[n:n + 19], ' ')) AS seq
  FROM split, unnest(range(1, len(words) - 18)) AS t(n)
), again AS (
  SELECT doc_id, n FROM starts QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, n) > 1
), gone AS (
  SELECT DISTINCT doc_id, m FROM again, unnest(range(n, n + 20)) AS t(m)
), word AS (
  SELECT doc_id, m, words[m] AS word FROM split, unnest(range(1, len(words) + 1)) AS t(m)
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY m) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, m) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.text, '')) AS kept_sha256
FROM split s LEFT JOIN left_over l USING (doc_id)""")
def op7_substring_dedup(spark, folder: str) -> DataFrame:
    """Documents without words of 20-word windows that also start earlier."""
    kept = substrings.dedup_substrings(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256_of(F.col("text")).alias("kept_sha256"))


@LLM.add()
def op10_sharding(spark, folder: str) -> DataFrame:
    """Shard and slot of every document under a uniform shuffle into 24 shards."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return sharding.shuffle_shards(table(spark, folder, "documents")).select(
        "row.doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@LLM.add()
def op6_decontamination(spark, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names and units."""
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@LLM.add()
def op2_quality_classifier(spark, folder: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _cluster_sql() -> str:
    """The rounds one after the other, every distance taken."""
    gap = "list_sum(list_transform(list_zip(v.c, k.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = []
    for n in range(clusters.ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, vec_id, v.c, k.k, CAST({gap} AS BIGINT) AS d FROM v, k{n} k
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k.k) = 1
)""")
        if n < clusters.ROUNDS:
            steps.append(f"""m{n} AS (
  SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT k, i, CAST(floor(CAST(sum(c[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM a{n}, range(1, {clusters.COMPONENTS + 1}) r(i) GROUP BY k, i
  ) GROUP BY k
), k{n + 1} AS MATERIALIZED (SELECT k.k, coalesce(m.c, k.c) AS c FROM k{n} k LEFT JOIN m{n} m USING (k))""")
    last = clusters.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE len(embedding) = {clusters.COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id), c) - 1 AS k, c FROM v
  QUALIFY k < {clusters.CLUSTERS}
), {", ".join(steps)}
SELECT a.vec_id, CAST(a.k AS INT) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.c, ',')) AS centroid_sha256
FROM a{last} a JOIN k{last} k ON a.k = k.k"""


@LLM.add(_cluster_sql())
def op11_centroid_clusters(spark, folder: str) -> DataFrame:
    """Cluster and squared distance of every vector after five exact rounds."""
    return clusters.with_inertia(*clusters.cluster_vectors(table(spark, folder, "embeddings")))


@LLM.add()
def op13_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document and the prefix that fits the token limit."""
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@LLM.add(r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS codes FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) AS c
    FROM range(256) r(n)
  )
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
      CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)),
    lambda c, b: xor(c // 256, codes[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT))
    || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail
  FROM words, unnest(range(1, length(word) + 1)) t(i)
), link AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON w.word = c.head || c.tail
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON w.word = c.head || c.tail
), near AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS best, max(m) AS best_n FROM link GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
    CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), walk AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL
), last AS (
  SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL
)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM formed f LEFT JOIN last l USING (word)""")
def op12_spelling_variants(spark, folder: str) -> DataFrame:
    """Frequent words, their near words and the form and root that each is a variant of."""
    return spelling.spelling_groups(spelling.word_counts(table(spark, folder, "documents")))
