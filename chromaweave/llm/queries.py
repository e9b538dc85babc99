"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.llm import bpe, crossalign, hamming, jaccard, langid, linededup, lm, mixing, packing, pii, secrets, simhash, sortmeans
from chromaweave.llm.store import small_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_byte_bpe(spark, sf_dir):
    """Ids of every whole text and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    decoded = bpe.decode(tokens, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_pack_sequences(spark, sf_dir):
    """Every document's tokens in gapless sequences of at most 2048."""
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def in_fold(divisor: int, remainder: int):
    """Whether crc32(doc_id as text) leaves the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


@query
def op10_language_id(spark, sf_dir):
    """Predicted language and calibrated probability of every whole text."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.select("doc_id", "text", "lang"), train=~in_fold(4, 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op7_secret_scan(spark, sf_dir):
    """Secrets in every whole text, classed by how many owners carry them."""
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))

    def number(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    def told(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    return found.select(
        "doc_id",
        *[number(of_kind(k)).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        number(lambda s: s["class"] == "live").alias("n_live"),
        number(lambda s: s["class"] == "example").alias("n_example"),
    )


@query
def op1_simhash(spark, sf_dir):
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    found = simhash.fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))
    own, edited, following = [F.col("hi"), F.col("lo")], [F.col("edited_hi"), F.col("edited_lo")], [F.col("next_hi"), F.col("next_lo")]
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_text(*own).alias("fingerprint"),
        simhash.as_text(*edited).alias("edited_fingerprint"),
        simhash.likeness(*own, *edited).alias("near_edited"),
        simhash.likeness(*own, *following).alias("near_next"),
    )


@query
def op4_line_dedup(spark, sf_dir):
    """Every document without lines that repeat, exactly or nearly, an earlier one."""
    docs = documents(spark, sf_dir)
    found = linededup.dedup_lines(docs, kept="kept_lines")
    return found.select(
        "doc_id",
        F.size("kept_lines").cast("long").alias("n_kept"),
        F.array_join(F.col("kept_lines").cast("array<string>"), ",").alias("kept_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query
def op2_ngram_jaccard(spark, sf_dir):
    """Classes of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard.classes(documents(spark, sf_dir).select("doc_id", "text"))


def told_spans(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def of_kind(kind):
    return lambda s: s["kind"] == kind


@query
def op5_pii(spark, sf_dir):
    """Personal data in every whole text, and the terms that disclose it."""
    found = pii.protect(documents(spark, sf_dir).select("doc_id", "text"), sanitised=None)
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(told_spans(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        told_spans(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", of_kind("term"))).cast("long").alias("n_term"),
    )


@query
def op6_hamming_top_k(spark, sf_dir):
    """The ten vectors whose sign codes are nearest to those of every fiftieth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    codes = hamming.sign_codes(rows, "vec_id", "embedding", dims=64)
    found = hamming.top_k(codes.where("id % 50 = 0"), codes, k=10, dims=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


ORACLES["op6_hamming_top_k"] = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


@query
def op3_lm_score(spark, sf_dir):
    """log10 probabilities of every whole text by word frequencies and by the attention model."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = lm.score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ~in_fold(7, 2))
    return found.select("doc_id", in_fold(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_cross_align(spark, sf_dir):
    """Every whole text in two tokenizers: groups between common ends, links, and how usual these are."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = crossalign.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op11_sort_means(spark, sf_dir):
    """Eight centroids of all whole vectors after ten rounds, and each vector's place among them."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = sortmeans.cluster(rows, "vec_id", "embedding", dims=64, k=8, rounds=10, seed=3)
    told = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", told.alias("centroid_sha256"))


def sort_means_sql(dims: int, k: int, rounds: int, seed: int) -> str:
    """Every distance in every round, written out round by round."""
    number = "CAST({} AS HUGEINT)"
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row_no,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS c, v AS w FROM kept ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row_no, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT row_no, c, CAST(list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY row_no)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT best.c AS c, i, sum({number.format('v[i]')}) AS s, count(*) AS n FROM a{r} JOIN kept USING (row_no), range(1, {dims + 1}) t(i) GROUP BY 1, 2),
m{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row_no) JOIN c{rounds} ON best.c = c{rounds}.c"""


ORACLES["op11_sort_means"] = sort_means_sql(64, 8, 10, 3)


@query
def op12_mix_sources(spark, sf_dir):
    """How often each document is taken, so that sources come to their target weights."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
