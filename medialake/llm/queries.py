"""One registered query for each operator of this package, over its whole table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import fptree, langid, mixing, neardup, neighbours, packing, quality, repetition, secretscan, sharding, toxicity, turntrie, windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(n: int, key: str = "doc_id"):
    """The remainder that keeps rows apart from learning: crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see :func:`quality.score` for nulls, empty texts, repeated rows and empty tables."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(bucket_of(4) != 2), "quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", (bucket_of(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; see :func:`langid.identify` for nulls and empty texts. Repeated rows are judged alike; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(bucket_of(5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket_of(5) == 0).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; see :func:`neighbours.nearest` for nulls, ties, repeated rows and empty tables."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; see :func:`toxicity.score` for nulls, empty texts, repeated rows and empty tables."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(bucket_of(5) != 0), "toxic")
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (bucket_of(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies; see :func:`neardup.near_duplicates` for nulls, empty texts and repeated rows. An empty table gives an empty one."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; see :func:`mixing.mix` for nulls, empty texts, repeated rows and empty tables."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
marked AS (SELECT *, level * w >= 3 * source_size AS is_full FROM filled),
plan AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * w END AS target FROM marked),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; see :func:`sharding.shard`. A null text has no bytes, repeated rows get slots of their own, an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    placed = sharding.shard(rows, shards=16, spare="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents; see :func:`secretscan.scan` for nulls, empty texts, repeated rows and empty tables."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[secretscan.of_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(spans).alias("spans"), secretscan.of_kind(spans, "guess").alias("n_guess"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules on all documents; see :func:`repetition.rules` for nulls, empty texts, repeated rows and empty tables."""
    return repetition.rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all token pieces; see :func:`packing.pieces` and :func:`packing.pack` for nulls, empty texts, repeated rows and empty tables."""
    parts = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep_ids=False)
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's ten best documents; see :func:`fptree.rank` for nulls, empty texts, repeated rows and empty tables."""
    return fptree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
counted AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM counted),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM counted) WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weighed USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all token pieces; see :func:`windows.pack_online` for nulls, empty texts, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return windows.pack_online(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, keep_ids=False).drop("ids")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes over rebuilt conversations; see :func:`turntrie.trie` for nulls, empty texts, repeated rows and empty tables."""
    return turntrie.trie(turntrie.shared_openings(turntrie.sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ascii(c)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999] FOR c IN string_split(conv_id::VARCHAR, '')])),
    lambda a, b: CASE WHEN b = 999 THEN xor(a >> 1, (a & 1) * 3988292384::UBIGINT) ELSE xor(a, b) END), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns
  FROM own c JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS over FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '') AS ends,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY prefix, d),
members AS (SELECT p.conv_id AS member, p.d AS depth, n.conv_id FROM prefixes p JOIN nodes n ON n.prefix = p.prefix AND n.depth = p.d),
lined AS (SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM lined WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM lined l LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth),
below AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_nodes f JOIN members m ON m.member = f.conv_id AND m.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN below b ON b.conv_id = f.conv_id AND b.depth = f.depth
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_neighbours": op3_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_secrets": op8_secrets,
    "op9_repetition": op9_repetition,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_online_packing": op12_online_packing,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": OP6_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
