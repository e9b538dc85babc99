"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Candidates are found by regular expressions in the JVM: matches are marked by
control characters, the text is split at the marks, and running sums of the pieces'
lengths give the positions.  A candidate's value is then looked up across the whole
corpus by its hash: how many repositories and owners carry it.  Values that many
owners carry are copied examples; values of few owners that look random are live.
Only hashes and lengths leave the scan, never the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaweave.llm.store import materialise

# What counts as a candidate.  Each pattern has two groups: what stands
# before the value, and the value.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"()(AKIA[A-Z0-9]{16,})",
    "hex": r"()([0-9a-f]{24,})",
    "blob": r"()(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{24,})(?![A-Za-z0-9_-])",
}
BASE = ("assign", "access", "hex")
#: Shortest value of an assignment.
LEAST_VALUE = 6
#: A value of at least so many owners is a copied example.
EXAMPLE_OWNERS = 5
#: A value of at most so many owners can be live.
LIVE_OWNERS = 2
MARKS = "\x01\x02\x03"


def _hits(text: Column, kind: str) -> Column:
    """array<struct<before, length, least, looks, hash>>: gap since the last match, and the match."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARKS, "\x04\x04\x04")
    marked = F.regexp_replace(plain, PATTERNS[kind], "\x01$1\x02$2\x03")
    parts = F.split(marked, "\x01")

    def hit(p, i):
        match = F.substring_index(p, "\x03", 1)
        value = F.substring_index(match, "\x02", -1)
        return F.struct(
            (F.length(match) - 1).cast("long").alias("length"),
            # What follows the match, up to the next one.
            F.when(i == 0, F.length(p)).otherwise(F.length(p) - F.length(match) - 1).cast("long").alias("rest"),
            F.length(value).alias("least"),
            (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 8)).alias("looks"),
            (value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")).alias("mixed"),
            F.sha2(value, 256).alias("hash"),
        )

    return F.when(F.size(parts) > 1, F.transform(parts, hit))


def candidates(docs: DataFrame, text: str = "text", repository: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one row per document with a row number ``_row``; one row per candidate span.

    ``spans`` has _row, kind, start, end (code points, end exclusive), hash, looks,
    repository and owner (what precedes the first slash of the repository's name).
    """
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    scan = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        *keep,
        repo.alias("_repo"),
        *[_hits(F.col(text).cast("string"), k).alias(f"_{k}") for k in PATTERNS],
    )
    scan = materialise(scan, "secrets")
    found = None
    for kind in PATTERNS:
        # Element 0 stands for the text before the first match.
        one = scan.where(F.col(f"_{kind}").isNotNull()).select("_row", "_repo", F.lit(kind).alias("kind"), F.posexplode(f"_{kind}").alias("_i", "_h"))
        found = one if found is None else found.unionByName(one)
    own = F.when(F.col("_i") == 0, F.lit(0)).otherwise(F.col("_h.length"))
    ends = F.sum(own + F.col("_h.rest")).over(W.partitionBy("_row", "kind").orderBy("_i"))
    spans = found.select("*", (ends - F.col("_h.rest")).alias("end")).where("_i > 0")
    spans = spans.where((F.col("kind") != "assign") | (F.col("_h.least") >= LEAST_VALUE)).where((F.col("kind") != "blob") | F.col("_h.mixed"))
    spans = spans.select(
        "_row", "kind", (F.col("end") - F.col("_h.length")).alias("start"), "end", F.col("_h.hash").alias("hash"), F.col("_h.looks").alias("looks"),
        F.col("_repo").alias("repository"), F.substring_index("_repo", "/", 1).alias("owner"),
    )
    return scan.select("_row", *keep), spans


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_spans, n_repositories, n_owners; summed up per repository before hashes meet."""
    per = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    per = per.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return per.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, text: str = "text", repository: str = "source", keep: tuple[str, ...] = ("doc_id",), example_owners: int = EXAMPLE_OWNERS, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """The ``keep`` columns and the document's spans.

    ``spans`` is array<struct<start, end, rank, kind, class, n_repositories, n_owners, hash>>
    by start, then kind.  All base kinds are there whatever their class; ``blob`` (a
    long random-looking word) is there only where few owners have it and no base span
    covers it.  ``class`` is ``example``, ``live`` or ``unclear``.  A null or empty
    text has no spans; a null repository counts as one of its own; repeated rows are
    scanned each; an empty table gives an empty table; other input columns are ignored.
    """
    rows, spans = candidates(docs, text, repository, keep)
    known = spans.join(ownership(spans), "hash")
    kind_rank = F.create_map(*[x for i, k in enumerate(PATTERNS) for x in (F.lit(k), F.lit(i))])
    looks = F.when(F.col("n_owners") >= example_owners, "example").when((F.col("n_owners") <= live_owners) & F.col("looks"), "live").otherwise("unclear")
    known = known.withColumns({"class": looks, "rank": kind_rank[F.col("kind")]})
    base_end = F.when(F.col("kind").isin(*BASE), F.col("end"))
    covered = F.max(base_end).over(W.partitionBy("_row").orderBy("start", "rank"))
    known = known.withColumn("_cover", F.coalesce(covered, F.lit(-1)))
    known = known.where(F.col("kind").isin(*BASE) | ((F.col("class") == "live") & (F.col("_cover") < F.col("end"))))
    listed = known.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rank", "kind", "class", "n_repositories", "n_owners", "hash"))).alias("spans"))
    out = rows.join(listed, "_row", "left")
    none = F.from_json(F.lit("[]"), listed.schema["spans"].dataType)
    return out.select(*keep, F.coalesce("spans", none).alias("spans"))
