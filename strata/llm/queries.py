"""Registered queries of the llm operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text statistics, base rule and learned decision list of every document."""
    from strata.llm.quality import BASE, quality_rules

    judged, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under the bigram model of the training documents."""
    from strata.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to rANS files in ascending doc_id order and read back."""
    import json

    import public_tokenizers

    from strata.llm import rans

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    vocabulary = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    _, back = rans.round_trip(table(spark, sf_dir, "documents"), text, vocabulary, added=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the fixed patterns and of the randomness battery in every document."""
    from strata.llm.secrets import joined, spans

    found = spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in an equal-weight mixture of its sources."""
    from strata.llm.mixing import places

    return places(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 8 shards; row counts differ by one at most."""
    from strata.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when strings of 400 bytes that occur twice are removed."""
    from strata.llm.suffixes import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Vocabulary files of the public tokenizers; a parameter, never copied.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and near-duplicate component of every document."""
    from strata.llm.jaccard import links

    return links(table(spark, sf_dir, "documents"))


@query
def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50, whole texts as queries."""
    from strata.llm.search import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to, as digests."""
    import public_tokenizers

    from strata.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.digests(bpe.encode_packed(table(spark, sf_dir, "documents"), bpe.TiktokenWords(ranks, public_tokenizers.PATTERN),
                                         public_tokenizers.PATTERN, also={"decoded": (T.BinaryType(), bpe.decoder(ranks))}))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, their near words, forms and roots."""
    from strata.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of every text and of its edited text, compared."""
    from strata.llm.sketch import compare_neighbours

    return compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every document."""
    from strata.llm.merkle import prove

    return prove(table(spark, sf_dir, "documents"))


_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x20\\x09-\\x0D]+')")

ORACLE["op1_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
near AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, near.v FROM reach JOIN near ON near.u = reach.r)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id"""

ORACLE["op2_bm25_topk"] = f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT word, ln(1 + (c.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY word, c.n),
hit AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN df USING (word) JOIN tf d ON d.word = q.word JOIN dl ON dl.doc_id = d.doc_id, c
  WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit) WHERE rank <= 10"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: crc32 of a key's decimal digits, eight steps a byte, as there is no such function.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM doc),
low AS (
  SELECT lang, 0 AS l, i, leaf AS d, n FROM leaves
  UNION ALL
  SELECT lang, l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM low WHERE n > 1 GROUP BY lang, l, i // 8),
subroots AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS l, i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY l, i // 8),
nodes AS (SELECT *, false AS up FROM low WHERE n > 1 UNION ALL SELECT NULL, l, i, d, n, true FROM top WHERE n > 1),
near AS (
  SELECT up, CASE WHEN up THEN NULL ELSE lang END AS lang, l, i,
    coalesce(string_agg(d, '') OVER (PARTITION BY up, lang, l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(d, '') OVER (PARTITION BY up, lang, l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM nodes),
height AS (SELECT lang, max(l) AS h FROM low GROUP BY lang),
fold AS (
  SELECT leaves.doc_id, leaves.lang, leaves.i AS leaf_i, 0 AS step, coalesce(changed, leaf) AS d, leaves.i AS pos, '' AS proof, h, subroots.i AS top_i
  FROM leaves JOIN height ON height.lang IS NOT DISTINCT FROM leaves.lang JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang
  UNION ALL
  SELECT f.doc_id, f.lang, leaf_i, step + 1, sha256(pre || d || post), CASE WHEN step + 1 = h THEN top_i ELSE pos // 8 END, proof || pre || post, h, top_i
  FROM fold f JOIN near ON near.up = (step >= h) AND near.l = CASE WHEN step >= h THEN step - h ELSE step END AND near.i = CASE WHEN step = 0 AND h = 0 THEN top_i ELSE pos END
    AND (near.up OR near.lang IS NOT DISTINCT FROM f.lang)),
last AS (SELECT lang, leaf_i, max_by(d, step) AS folded_root, sha256(max_by(proof, step)) AS proof_sha256 FROM fold GROUP BY ALL),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT leaves.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN last ON last.lang IS NOT DISTINCT FROM leaves.lang AND leaf_i = leaves.i JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang, root"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
