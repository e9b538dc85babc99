"""Registered queries over the driver tables and their DuckDB twins.

The domain's tables are read into the star schema: a chromosome is ``user_id``, a
position the seconds of ``ts``, a gene a signup (its strand by the parity of its id), a
peak a purchase, a sequence the bases of a document's text, an interaction a supplier
and a part, a prize a supplier's balance, a factor a supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.functions import scalars as S
from chromaweave.operators import graph, intervals, motifs, ranges, robust, sequences, stats, steiner

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- readings of the driver tables --------------------------------------------------

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def genes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_type = 'signup'")
    at = F.expr(SECONDS)
    return ev.select(F.col("user_id").alias("chrom"), F.col("event_id").alias("gene_id"), at.alias("tx_start"), (at + 3600).alias("tx_end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


def peaks(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return ev.select(F.col("user_id").alias("chrom"), F.col("event_id").alias("peak_id"), F.expr(SECONDS).alias("peak_loc"))


GENES = """genes AS (SELECT user_id AS chrom, event_id AS gene_id, CAST(floor(epoch(ts)) AS BIGINT) AS tx, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS te,
  event_id % 2 = 0 AS plus FROM events WHERE event_type = 'signup')"""
DERIVED = (
    GENES
    + """, derived AS (SELECT *,
  CASE WHEN plus THEN greatest(tx - 1 - 2000, 0) ELSE te + 1 END AS prom_lo, CASE WHEN plus THEN tx - 1 ELSE te + 1 + 2000 END AS prom_hi,
  CASE WHEN plus THEN tx + 1 ELSE te - 2000 END AS win_lo, CASE WHEN plus THEN tx + 2000 ELSE te END AS win_hi,
  CASE WHEN plus THEN te + 1 ELSE tx - 1 - 2000 END AS down_lo, CASE WHEN plus THEN te + 1 + 2000 ELSE tx - 1 END AS down_hi FROM genes)"""
)
PEAKS = "peaks AS (SELECT user_id AS chrom, event_id AS peak_id, CAST(floor(epoch(ts)) AS BIGINT) AS loc FROM events WHERE event_type = 'purchase')"


def edges(spark, sf_dir):
    """Supplier-part interactions: weight from the discount; odd lines are directed."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"),
        (F.col("l_discount") * 12 - 0.1).alias("weight"), F.when(F.col("l_linenumber") % 2 == 1, "D").otherwise("U").alias("dir"), F.col("l_linenumber").alias("run"),
    )


EDGES = """edges AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_discount * CAST(12 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS weight,
  CASE WHEN l_linenumber % 2 = 1 THEN 'D' ELSE 'U' END AS dir, l_linenumber AS run FROM lineitem)"""


def prizes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("prize"))


PRIZES = "prizes AS (SELECT 'S' || s_suppkey AS node, s_acctbal AS prize FROM supplier)"
DEGREES = """both_ends AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges),
  degrees AS (SELECT node, count(*) AS degree FROM both_ends GROUP BY node)"""


def bases(spark, sf_dir):
    """Documents as sequences: the letters A, C, G, T of their whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))


BASES = "bases AS (SELECT doc_id, lang, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS seq FROM documents)"


# -- scans, filters, intervals --------------------------------------------------------


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, ': *"?([^"}]*)', 1) AS DOUBLE) AS number,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def typed_parse_try_cast(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.regexp_extract("props", r': *"?([^"}]*)', 1)
    return ev.select("event_id", S.parse_number(raw).alias("number"), S.parse_number(F.col("event_type")).alias("not_a_number"))


@query(f"WITH {DERIVED} SELECT gene_id, prom_lo, prom_hi, win_lo, win_hi, down_lo, down_hi, CASE WHEN plus THEN prom_lo ELSE down_lo END AS ext_lo, CASE WHEN plus THEN down_hi ELSE prom_hi END AS ext_hi FROM derived")
def interval_derive(spark, sf_dir):
    return intervals.derive(genes(spark, sf_dir)).select("gene_id", "prom_lo", "prom_hi", "win_lo", "win_hi", "down_lo", "down_hi", "ext_lo", "ext_hi")


CLASSED = f"""WITH {DERIVED}, {PEAKS}, hits AS (
  SELECT peak_id, gene_id, CASE WHEN loc BETWEEN prom_lo AND prom_hi THEN 'promoter' WHEN loc BETWEEN win_lo AND win_hi THEN 'near TSS' END AS map_type,
  CASE WHEN loc BETWEEN prom_lo AND prom_hi THEN CASE WHEN plus THEN loc - prom_hi ELSE prom_lo - loc END
       WHEN loc BETWEEN win_lo AND win_hi THEN CASE WHEN plus THEN loc - win_lo ELSE win_hi - loc END END AS dist
  FROM peaks JOIN derived USING (chrom))"""


@query(CLASSED + " SELECT DISTINCT peak_id, gene_id, map_type, dist FROM hits WHERE map_type IS NOT NULL")
def range_join_promoter(spark, sf_dir):
    return intervals.map_peaks(peaks(spark, sf_dir), genes(spark, sf_dir)).select("peak_id", "gene_id", "map_type", "dist")


@query(f"""WITH {DERIVED}, {PEAKS}, hits AS (
  SELECT peak_id, gene_id, CASE WHEN loc BETWEEN prom_lo AND prom_hi THEN 'promoter' WHEN loc BETWEEN tx AND te THEN 'gene' WHEN loc BETWEEN down_lo AND down_hi THEN 'after' END AS map_type,
  round(CASE WHEN plus THEN loc - tx ELSE te - loc END / CAST(te - tx AS DOUBLE), 6) AS gene_pos FROM peaks JOIN derived USING (chrom))
  SELECT DISTINCT peak_id, gene_id, map_type, gene_pos FROM hits WHERE map_type IS NOT NULL""")
def range_join_gene_body(spark, sf_dir):
    out = intervals.map_peaks(peaks(spark, sf_dir), genes(spark, sf_dir), tss=False)
    return out.select("peak_id", "gene_id", "map_type", F.round("gene_pos", 6).alias("gene_pos"))


@query(CLASSED + ", d AS (SELECT DISTINCT * FROM hits WHERE map_type IS NOT NULL) SELECT p.peak_id, gene_id, coalesce(map_type, 'None') AS map_type FROM peaks p LEFT JOIN d USING (peak_id)")
def range_join_unmapped(spark, sf_dir):
    return intervals.map_peaks(peaks(spark, sf_dir), genes(spark, sf_dir), intergenic=True).select("peak_id", "gene_id", "map_type")


@query(CLASSED + ", d AS (SELECT DISTINCT * FROM hits WHERE map_type IS NOT NULL) SELECT map_type, count(*) AS n FROM d GROUP BY map_type")
def map_type_counts(spark, sf_dir):
    return intervals.map_peaks(peaks(spark, sf_dir), genes(spark, sf_dir)).groupBy("map_type").agg(F.count("*").alias("n"))


@query(f"WITH {GENES}, {PEAKS} SELECT peak_id, min(abs(loc - tx)) AS dist FROM peaks JOIN genes USING (chrom) GROUP BY peak_id")
def nearest_start(spark, sf_dir):
    return intervals.nearest_start(peaks(spark, sf_dir), genes(spark, sf_dir)).where("dist IS NOT NULL").select("peak_id", F.abs("dist").alias("dist"))


@query(f"""WITH {GENES}, o AS (SELECT chrom, tx, te, max(te) OVER (PARTITION BY chrom ORDER BY tx, te ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM genes),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR tx > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY tx, te ROWS UNBOUNDED PRECEDING) AS island FROM o)
  SELECT chrom, min(tx) AS tx_start, max(te) AS tx_end, count(*) AS n FROM i GROUP BY chrom, island""")
def interval_merge(spark, sf_dir):
    return intervals.merge(genes(spark, sf_dir), "chrom", "tx_start", "tx_end")


@query(f"""WITH {GENES}, {PEAKS} SELECT DISTINCT peak_id, gene_id FROM peaks JOIN genes USING (chrom)
  WHERE loc BETWEEN tx AND tx + 600 OR loc BETWEEN tx + 1800 AND tx + 2400 OR loc BETWEEN tx + 3000 AND te""")
def exon_test_array(spark, sf_dir):
    g = genes(spark, sf_dir).withColumns({"es": F.expr("array(tx_start, tx_start + 1800, tx_start + 3000)"), "ee": F.expr("array(tx_start + 600, tx_start + 2400, tx_end)")})
    hit = intervals.range_join(peaks(spark, sf_dir), g, "chrom", "peak_loc", "tx_start", "tx_end")
    return hit.where(intervals.in_exon(F.col("peak_loc"), F.col("es"), F.col("ee"))).select("peak_id", "gene_id").distinct()


@query("""SELECT event_id, CASE WHEN (event_type = '.' OR regexp_full_match(event_type, '[0-9]+')) THEN 'Peak_number_' || event_id
  WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1 THEN event_type || 'd' ELSE event_type END AS name FROM events""")
def peak_names(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"))
    return intervals.name_peaks(ev, "event_id")


@query("SELECT CAST(floor((l_orderkey + l_partkey) / 2) AS BIGINT) AS mid, l_orderkey + l_linenumber AS summit, l_partkey - 125 AS gps_lo, l_partkey + 125 AS gps_hi FROM lineitem")
def peak_points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lo, hi = intervals.gps_window(F.col("l_partkey"))
    return li.select(intervals.midpoint(F.col("l_orderkey"), F.col("l_partkey")).alias("mid"), intervals.summit(F.col("l_orderkey"), F.col("l_linenumber")).alias("summit"), lo.alias("gps_lo"), hi.alias("gps_hi"))


# -- joins and graphs -----------------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def last_wins_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query(f"WITH {EDGES}, {PRIZES} SELECT node, prize FROM prizes p WHERE EXISTS (SELECT 1 FROM edges WHERE src = node OR dst = node)")
def semi_reduce(spark, sf_dir):
    return graph.known_prizes(prizes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT count(*) AS n, count(DISTINCT src) AS n_src FROM edges WHERE src NOT IN ('S1', 'S2', 'S3') AND dst NOT IN ('P1', 'P2')")
def anti_reduce(spark, sf_dir):
    kept = graph.clean_edges(edges(spark, sf_dir), knockout=["S1", "S2", "S3", "P1", "P2"])
    return kept.agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


@query(f"""WITH {PRIZES}, factors AS (SELECT 'S' || c_custkey AS node, c_acctbal AS prize FROM customer)
  SELECT node, coalesce(f.prize * CAST(0.01 AS DOUBLE), p.prize) AS prize,
  CASE WHEN p.prize IS NULL THEN 'TF' WHEN f.prize IS NULL THEN 'Proteomic' ELSE 'Proteomic_TF' END AS terminal_type FROM prizes p FULL JOIN factors f USING (node)""")
def full_outer_prizes(spark, sf_dir):
    factors = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("node"), F.col("c_acctbal").alias("prize"))
    return graph.join_prizes(prizes(spark, sf_dir), factors, 0.01)


@query(f"WITH {EDGES} SELECT src, dst, dir, run, round(least(greatest(weight, CAST(0 AS DOUBLE)), CAST(0.99 AS DOUBLE)), 6) AS weight FROM edges WHERE src <> dst")
def edge_clean(spark, sf_dir):
    return graph.clean_edges(edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES} SELECT count(*) FILTER (weight < 0) AS n_below, count(*) FILTER (weight > CAST(0.99 AS DOUBLE)) AS n_above, count(*) FILTER (src = dst) AS n_self, count(*) AS n_edges FROM edges")
def edge_warnings(spark, sf_dir):
    return graph.edge_warnings(edges(spark, sf_dir))


CANON = f"""WITH {EDGES}, canon AS (SELECT CASE WHEN dir = 'U' THEN least(src, dst) ELSE src END AS src, CASE WHEN dir = 'U' THEN greatest(src, dst) ELSE dst END AS dst, dir, weight FROM edges),
  kept AS (SELECT src, dst, dir, max(weight) AS weight FROM canon GROUP BY src, dst, dir)"""


@query(CANON + " SELECT src, dst, dir, round(weight, 6) AS weight FROM kept")
def edge_keep_max(spark, sf_dir):
    return graph.keep_max(edges(spark, sf_dir)).select("src", "dst", "dir", F.round("weight", 6).alias("weight"))


@query(CANON + """ SELECT src, dst, dir, round(weight, 6) AS weight FROM kept k WHERE dir = 'D' OR NOT EXISTS
  (SELECT 1 FROM kept d WHERE d.dir = 'D' AND least(d.src, d.dst) = k.src AND greatest(d.src, d.dst) = k.dst)""")
def directed_precedence(spark, sf_dir):
    return graph.network(edges(spark, sf_dir)).select("src", "dst", "dir", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGES}, {DEGREES} SELECT node, degree FROM degrees")
def degree(spark, sf_dir):
    return graph.degree(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT node, count(*) AS out_degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges WHERE dir = 'U') GROUP BY node")
def out_degree(spark, sf_dir):
    return graph.out_degree(edges(spark, sf_dir))


def _penalty(squared):
    pen = "degree * degree" if squared else "degree"
    return f"""WITH {EDGES}, {DEGREES}, {PRIZES}, pen AS (SELECT node, CASE WHEN degree = 1 THEN 0.0 ELSE CAST(-0.04 AS DOUBLE) * {pen} END AS neg FROM degrees)
  SELECT node, round(coalesce(neg, 0), 6) AS prize_neg, round(coalesce(prize, 0) * 5 + coalesce(neg, 0), 6) AS prize_total FROM pen FULL JOIN prizes USING (node)
  WHERE prize IS NOT NULL OR coalesce(neg, 0) <> 0"""


def _rounded(df):
    return df.select("node", F.round("prize_neg", 6).alias("prize_neg"), F.round("prize_total", 6).alias("prize_total"))


@query(_penalty(False))
def degree_penalty(spark, sf_dir):
    return _rounded(graph.total_prizes(prizes(spark, sf_dir), edges(spark, sf_dir), 5.0, 0.04))


@query(_penalty(True))
def degree_penalty_sq(spark, sf_dir):
    return _rounded(graph.total_prizes(prizes(spark, sf_dir), edges(spark, sf_dir), 5.0, 0.04, squared=True))


@query(_penalty(False).replace("SELECT node, round(coalesce(neg, 0), 6) AS prize_neg, round(coalesce(prize, 0) * 5 + coalesce(neg, 0), 6)", "SELECT node, CASE WHEN prize IS NULL THEN round(neg, 6) ELSE 0.0 END AS prize_neg, round(CASE WHEN prize IS NULL THEN neg ELSE prize * 5 END, 6)"))
def prize_exclude_terminals(spark, sf_dir):
    return _rounded(graph.total_prizes(prizes(spark, sf_dir), edges(spark, sf_dir), 5.0, 0.04, exclude_terminals=True))


@query(f"WITH {EDGES} SELECT src AS node FROM edges UNION SELECT dst FROM edges")
def dummy_all(spark, sf_dir):
    return graph.dummy_neighbours("all", prizes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {EDGES}, {PRIZES} (SELECT src AS node FROM edges UNION SELECT dst FROM edges) EXCEPT SELECT node FROM prizes")
def dummy_others(spark, sf_dir):
    return graph.dummy_neighbours("others", prizes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {PRIZES} SELECT DISTINCT node FROM prizes")
def dummy_terminals(spark, sf_dir):
    return graph.dummy_neighbours("terminals", prizes(spark, sf_dir), edges(spark, sf_dir))


@query(CANON + """, sol AS (SELECT src, dst FROM kept WHERE weight > 1.0), ns AS (SELECT src AS node FROM sol UNION SELECT dst FROM sol)
  SELECT src, dst, dir, round(weight, 6) AS weight FROM kept k WHERE src IN (SELECT node FROM ns) AND dst IN (SELECT node FROM ns) AND NOT EXISTS (SELECT 1 FROM sol s WHERE s.src = k.src AND s.dst = k.dst)""")
def induced_subgraph(spark, sf_dir):
    kept = graph.keep_max(edges(spark, sf_dir))
    chosen = kept.where("weight > 1.0")
    return graph.induced(kept, graph.nodes(chosen), chosen).select("src", "dst", "dir", F.round("weight", 6).alias("weight"))


@query(CANON + f""", {PRIZES}, sol AS (SELECT * FROM kept WHERE weight > 1.0), ns AS (SELECT src AS node FROM sol UNION SELECT dst FROM sol),
  t AS (SELECT (SELECT coalesce(sum(prize * 5), 0) FROM prizes WHERE node NOT IN (SELECT node FROM ns)) AS excluded, (SELECT coalesce(sum(1 - weight), 0) FROM sol) AS cost,
  (SELECT count(DISTINCT src) * CAST(6 AS DOUBLE) FROM sol) AS roots)
  SELECT round(excluded, 3) AS excluded, round(cost, 3) AS cost, round(roots, 3) AS roots, round(excluded + cost + roots, 3) AS objective FROM t""")
def objective_terms(spark, sf_dir):
    chosen = graph.keep_max(edges(spark, sf_dir)).where("weight > 1.0")
    total = graph.total_prizes(prizes(spark, sf_dir), edges(spark, sf_dir), 5.0)
    out = graph.objective(total, graph.nodes(chosen), chosen, chosen.select("src").distinct(), 6.0)
    return out.select(*[F.round(c, 3).alias(c) for c in ("excluded", "cost", "roots", "objective")])


@query(f"WITH {EDGES} SELECT src, dst, round(count(DISTINCT run) / CAST(7 AS DOUBLE), 6) AS fraction FROM edges GROUP BY src, dst")
def run_fraction_merge(spark, sf_dir):
    return graph.merge_runs(edges(spark, sf_dir), ["src", "dst"], "run", F.lit(7.0)).withColumn("fraction", F.round("fraction", 6))


@query("SELECT s_suppkey, CAST((row_number() OVER (ORDER BY md5(s_suppkey || '//0'), s_suppkey) - 1) % 5 AS INTEGER) AS fold FROM supplier")
def fold_assignment(spark, sf_dir):
    return robust.folds(table(spark, sf_dir, "supplier").select("s_suppkey"), 5, key="s_suppkey")


@query(f"""WITH {EDGES}, {DEGREES}, r AS (SELECT node, row_number() OVER (ORDER BY degree, node) - 1 AS rank FROM degrees)
  SELECT a.node AS node, b.node AS other FROM r a JOIN r b ON b.rank = a.rank + 3""")
def degree_rank_offset(spark, sf_dir):
    r = ranges.numbered(graph.degree(edges(spark, sf_dir)), ["degree", "node"])
    return r.select("node", (F.col("rank") + 3).alias("rank")).join(r.select("rank", F.col("node").alias("other")), "rank").select("node", "other")


@query(f"""WITH {PRIZES}, a AS (SELECT prize, row_number() OVER (ORDER BY node) AS i FROM prizes), b AS (SELECT node, row_number() OVER (ORDER BY md5(node || '/0/0'), node) AS i FROM prizes)
  SELECT 0 AS run, node, prize FROM a JOIN b USING (i)""")
def rank_join_shuffle(spark, sf_dir):
    return robust.shuffle_prizes(prizes(spark, sf_dir), 1)


# -- factor by gene matrices, regression ----------------------------------------------

# Adding 0 turns -0.0 into 0.0.
SIGNED = "l_discount * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END + 0"


def matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return stats.max_abs(li.select(F.col("l_suppkey").alias("tf"), F.col("l_partkey").alias("gene"), F.expr(SIGNED).alias("score")), ["tf", "gene"])


MATRIX = f"m AS (SELECT l_suppkey AS tf, l_partkey AS gene, arg_max({SIGNED}, abs(l_discount) * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0 END) AS score FROM lineitem GROUP BY l_suppkey, l_partkey)"


@query(f"WITH {MATRIX} SELECT tf, gene, score FROM m")
def max_abs_score(spark, sf_dir):
    return matrix(spark, sf_dir)


@query(f"WITH {MATRIX} SELECT tf, string_agg(gene || ':' || CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR), ' ' ORDER BY gene) AS row, count(*) AS n FROM m GROUP BY tf")
def matrix_long_pivot(spark, sf_dir):
    """A row for each factor with all its genes, as sparse cells in the order of the genes; scores in hundredths."""
    cell = F.struct("gene", F.round(F.col("score") * 100).cast("int").alias("x"))
    rows = matrix(spark, sf_dir).groupBy("tf").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select("tf", F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["gene"].cast("string"), c["x"].cast("string"))), " ").alias("row"), F.size("c").cast("long").alias("n"))


REGR = "CASE WHEN isnan({0}) THEN NULL ELSE round({0}, {1}) END"


@query("""WITH r AS (SELECT l_suppkey AS tf, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_suppkey)
  SELECT tf, round(s, 3) AS slope, round(i, 2) AS intercept, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n FROM r WHERE NOT isnan(s)""")
def group_regression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tf"), "l_quantity", "l_extendedprice")
    out = stats.regression(li, "tf", "l_quantity", "l_extendedprice")
    return out.select("tf", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round(F.col("r") * F.col("r"), 6).alias("r2"), "n")


@query("""SELECT l_suppkey AS tf, count(*) AS n,
       CASE WHEN isnan(regr_slope(o_totalprice, l_quantity)) THEN NULL ELSE round(regr_slope(o_totalprice, l_quantity), 4) END AS slope
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey""")
def regression_with_multiplicity(spark, sf_dir):
    """Inner equi-join that keeps duplicates, then a regression per group."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tf"), F.col("l_orderkey").alias("gene"), "l_quantity")
    od = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gene"), "o_totalprice")
    joined = stats.join_expression(li, od)
    return joined.groupBy("tf").agg(F.count("*").alias("n"), F.round(F.regr_slope("o_totalprice", "l_quantity"), 4).alias("slope"))


PVALUES = "t AS (SELECT l_suppkey AS motif, (sum(l_partkey) % 997 + 1) / CAST(997 AS DOUBLE) AS p, CAST(sum(l_quantity) AS DOUBLE) AS slope FROM lineitem GROUP BY l_suppkey)"


def pvalues(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("motif")).agg(((F.sum("l_partkey") % 997 + 1) / F.lit(997.0)).alias("p"), F.sum("l_quantity").alias("slope"))


@query(f"WITH {PVALUES} SELECT motif, round(least(1.0, count(*) OVER () * p / row_number() OVER (ORDER BY p, -abs(slope), motif)), 6) AS q FROM t")
def bh_qvalue(spark, sf_dir):
    return stats.bh_qvalues(pvalues(spark, sf_dir)).select("motif", F.round("q", 6).alias("q"))


@query("""WITH t AS (SELECT unnest(string_split(p_name, ' ')) AS tf, (p_partkey % 97 + 1) / CAST(100 AS DOUBLE) AS p FROM part)
  SELECT tf, round(max(-log2(p)), 6) AS score FROM t WHERE p <= CAST(0.5 AS DOUBLE) AND p < 1 AND tf <> '' GROUP BY tf""")
def explode_max_neglog2(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", ".").alias("motif"), ((F.col("p_partkey") % 97 + 1) / 100.0).alias("p"))
    return stats.factor_scores(parts, S.tf_names(F.col("motif")), threshold=0.5).withColumn("score", F.round("score", 6))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS src, l_partkey || 'mrna' AS dst, round(max(CASE WHEN l_discount * 10 = 1 THEN CAST(0.9999 AS DOUBLE) ELSE l_discount * 10 END), 6) AS weight
  FROM lineitem WHERE l_discount * 10 > CAST(0.3 AS DOUBLE) AND l_suppkey NOT IN (3, 5) GROUP BY l_suppkey, l_partkey""")
def threshold_cap_network(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("tf"), F.col("l_partkey").cast("string").alias("gene"), (F.col("l_discount") * 10).alias("score"))
    return graph.factor_network(li, 0.3, exclude=("3", "5")).withColumn("weight", F.round("weight", 6))


@query("SELECT o_orderkey, round(log2(o_totalprice + CAST(0.1 AS DOUBLE)), 6) AS l2, round(log10(o_totalprice + CAST(0.1 AS DOUBLE)), 6) AS l10 FROM orders")
def log_transform_response(spark, sf_dir):
    y = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(stats.transform_response(y, "log2"), 6).alias("l2"), F.round(stats.transform_response(y, "log10"), 6).alias("l10"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std FROM lineitem GROUP BY l_returnflag")
def avg_std(spark, sf_dir):
    return stats.avg_std(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_k_sorted(spark, sf_dir):
    """The limit is the feature: a top-k report."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


# -- sequences and motifs -------------------------------------------------------------

GC = "CASE WHEN length(seq) = 0 THEN NULL ELSE (length(seq) - length(regexp_replace(lower(seq), '[cg]', '', 'g'))) / CAST(length(seq) AS DOUBLE) END"


@query(f"WITH {BASES} SELECT doc_id, round({GC}, 9) AS gc FROM bases")
def gc_content(spark, sf_dir):
    return bases(spark, sf_dir).select("doc_id", F.round(S.gc_content(F.col("seq")), 9).alias("gc"))


HISTOGRAM = f"g AS (SELECT lang, CAST(least(floor({GC} * 20), 19) AS INTEGER) AS bin FROM bases WHERE length(seq) > 0), h AS (SELECT lang, bin, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE) AS share FROM g GROUP BY lang, bin)"


@query(f"WITH {BASES}, {HISTOGRAM} SELECT lang, bin, n, round(share, 9) AS share FROM h")
def gc_histogram(spark, sf_dir):
    return sequences.gc_histogram(bases(spark, sf_dir), "seq", 20, ["lang"]).withColumn("share", F.round("share", 9))


@query(f"WITH {BASES}, {HISTOGRAM} SELECT round(sum(a.share * ln(a.share / b.share)), 6) AS kl FROM h a JOIN h b ON a.bin = b.bin WHERE a.lang = 'en' AND b.lang = 'de'")
def kl_divergence(spark, sf_dir):
    h = sequences.gc_histogram(bases(spark, sf_dir), "seq", 20, ["lang"])
    return stats.kl_divergence(h.where("lang = 'en'"), h.where("lang = 'de'"), "bin").select(F.round("kl", 6).alias("kl"))


@query(f"WITH {BASES} SELECT doc_id, reverse(translate(seq, 'acgtACGT', 'tgcaTGCA')) AS rc FROM bases")
def revcomp(spark, sf_dir):
    return bases(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


KMERS = "k AS (SELECT substr(seq, i, 4) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM bases WHERE length(seq) >= 4))"


@query(f"WITH {BASES}, {KMERS} SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY 1")
def kmer_canonical_counts(spark, sf_dir):
    return sequences.top_kmers(bases(spark, sf_dir), "seq", 4)


def _match(w):
    return " + ".join(f"CASE WHEN substr({w}, {i + 1}, 1) = '{c}' THEN 1 ELSE 0 END" for i, c in enumerate("TATA"))


@query(f"WITH {BASES}, {KMERS}, c AS (SELECT w AS kmer, count(*) AS n, reverse(translate(w, 'ACGT', 'TGCA')) AS rc FROM k GROUP BY w) SELECT kmer, n FROM c WHERE greatest({_match('kmer')}, {_match('rc')}) >= 3")
def kmer_mismatch(spark, sf_dir):
    return sequences.m_matches(bases(spark, sf_dir), "seq", "TATA", 3)


@query("""WITH s AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')), '^N+|N+$', '', 'g') AS seq FROM documents)
  SELECT doc_id, seq FROM s WHERE NOT regexp_matches(seq, '[NRYKMSWBDHV]')""")
def n_filter(spark, sf_dir):
    raw = F.regexp_replace("text", "[^ACGTNacgtn]", "")
    return table(spark, sf_dir, "documents").select("doc_id", S.del_n(raw).alias("seq")).where("seq IS NOT NULL")


@query(r"""SELECT page_id, CASE WHEN regexp_matches('hg18_' || 'chr' || page_id % 20 || '_' || page_id || '_' || (page_id * 3) || '_+', '^[^_\s]+_([^_\s]+)_([0-9]+)_([0-9]+)')
  THEN 'chr' || page_id % 20 || ':' || CAST(floor(page_id * 4 / 2) AS BIGINT) END AS key FROM pages""")
def header_parse(spark, sf_dir):
    header = F.concat(F.lit("hg18_chr"), F.col("page_id") % 20, F.lit("_"), F.col("page_id"), F.lit("_"), F.col("page_id") * 3, F.lit("_+"))
    return table(spark, sf_dir, "pages").select("page_id", S.region_key(header).alias("key"))


TILES = "tiles AS (SELECT lang, substr(seq, i * 6 + 1, 6) AS w FROM (SELECT lang, seq, unnest(range(0, length(seq) // 6)) AS i FROM bases WHERE length(seq) >= 6))"


def tiles(spark, sf_dir):
    """Sequences cut into words of six: aligned sequences, one motif for each language."""
    b = bases(spark, sf_dir).where("length(seq) >= 6")
    # Outer, so that no filter on the array is inferred and evaluated beside it.
    return b.select("lang", F.explode_outer(F.regexp_extract_all("seq", F.lit(".{6}"), 0)).alias("w")).where("w IS NOT NULL")


LETTERS = f"""WITH {BASES}, {TILES}, l AS (SELECT lang AS motif, i - 1 AS pos, substr(w, i, 1) AS letter, count(*) AS n FROM tiles, range(1, 7) r(i) GROUP BY ALL),
  al AS (SELECT unnest(['A', 'C', 'G', 'T']) AS letter), t AS (SELECT motif, pos, sum(n) AS total FROM l GROUP BY motif, pos),
  f AS (SELECT t.motif, CAST(t.pos AS INTEGER) AS pos, al.letter, (coalesce(n, 0) + CAST(0.25 AS DOUBLE)) / (total + 1) AS p FROM t CROSS JOIN al LEFT JOIN l ON l.motif = t.motif AND l.pos = t.pos AND l.letter = al.letter)"""


@query(LETTERS + " SELECT motif, pos, letter, round(p, 9) AS p, round(log2(p) + 2, 6) AS ll FROM f")
def pssm_from_sequences(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    return m.select("motif", "pos", "letter", F.round("p", 9).alias("p"), F.round("ll", 6).alias("ll"))


@query(LETTERS + ", b AS (SELECT motif, pos, greatest(sum(p * log2(p)) + 2, 0) AS bits, max(log2(p) + 2) AS hi, min(log2(p) + 2) AS lo FROM f GROUP BY motif, pos) SELECT motif, round(sum(bits), 6) AS bits, round(sum(hi), 6) AS maxscore, round(sum(lo), 6) AS minscore FROM b GROUP BY motif")
def pssm_bits_range(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    total = motifs.bits(m).groupBy("motif").agg(F.sum("bits").alias("bits"))
    return total.join(motifs.score_range(m), "motif").select("motif", *[F.round(c, 6).alias(c) for c in ("bits", "maxscore", "minscore")])


#: Motifs for the scans, by their IUPAC words, with pseudocounts.
WORDS = {"tata": "TATAW", "gata": "WGATAR"}


def word_motifs(spark):
    m = motifs.from_text(spark, WORDS)
    p = (F.col("p") + 0.0125) / 1.05
    return m.select("motif", "pos", "letter", p.alias("p"), (F.log2(p) + 2.0).alias("ll"))


def _values():
    rows = []
    for name, word in WORDS.items():
        for i, c in enumerate(word):
            for x in "ACGT":
                share = 1.0 / len(motifs.CODES[c]) if x in motifs.CODES[c] else 0.0
                rows.append(f"('{name}', {i}, '{x}', CAST({(share + 0.0125) / 1.05!r} AS DOUBLE), {len(word)})")
    return "w AS (SELECT *, log2(p) + 2 AS ll FROM (VALUES " + ", ".join(rows) + ") v(motif, pos, letter, p, width))"


SCANNED = f"""WITH {BASES}, {_values()}, o AS (SELECT doc_id, seq, unnest(range(0, length(seq))) AS i0 FROM bases),
  c AS (SELECT doc_id, i0, substr(seq, CAST(i0 AS BIGINT) + 1, 1) AS letter, length(seq) AS n FROM o),
  s AS (SELECT doc_id, a.motif, i0 - a.pos AS off, sum(a.ll) AS fwd, sum(b.ll) AS rev FROM c JOIN w a ON a.letter = c.letter
        JOIN w b ON b.motif = a.motif AND b.pos = a.width - 1 - a.pos AND b.letter = translate(c.letter, 'ACGT', 'TGCA') WHERE i0 - a.pos >= 0 AND i0 - a.pos + a.width <= n GROUP BY doc_id, a.motif, i0 - a.pos),
  hits AS (SELECT doc_id, motif, off, greatest(fwd, rev) AS s FROM s WHERE greatest(fwd, rev) > 5)"""


def hits(spark, sf_dir):
    return motifs.scan(bases(spark, sf_dir).select(F.col("doc_id").alias("region"), "seq"), word_motifs(spark), 5.0)


@query(SCANNED + ' SELECT doc_id, motif, CAST(off AS INTEGER) AS "offset", round(s, 6) AS score FROM hits')
def pssm_scan(spark, sf_dir):
    return hits(spark, sf_dir).select(F.col("region").alias("doc_id"), "motif", "offset", F.round(F.greatest("fwd", "rev"), 6).alias("score"))


@query(SCANNED + " SELECT doc_id, motif, round(max(s), 6) AS best FROM hits GROUP BY doc_id, motif")
def pssm_best_hit(spark, sf_dir):
    return motifs.best_hits(hits(spark, sf_dir)).select(F.col("region").alias("doc_id"), "motif", F.round("best", 6).alias("best"))


@query(SCANNED + " SELECT doc_id, motif, round(sum(s), 4) AS total, count(*) AS hits, round(avg(s), 4) AS mean, round(ln(sum(exp(s))), 4) AS logsum FROM hits GROUP BY doc_id, motif")
def pssm_scan_sum(spark, sf_dir):
    out = motifs.scan_sum(hits(spark, sf_dir))
    return out.select(F.col("region").alias("doc_id"), "motif", F.round("total", 4).alias("total"), "hits", F.round("mean", 4).alias("mean"), F.round("logsum", 4).alias("logsum"))


@query(SCANNED + """, k AS (SELECT ln(CAST(4 AS DOUBLE)) / (CAST(0.9 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS w), a AS (SELECT doc_id, motif, sum(exp(k.w * s / 12)) AS a FROM hits, k GROUP BY doc_id, motif)
  SELECT doc_id, motif, round(a / (a + 8 * exp(k.w * CAST(0.5 AS DOUBLE))), 6) AS affinity FROM a, k""")
def affinity(spark, sf_dir):
    found = hits(spark, sf_dir).groupBy("region", "motif").agg(S.affinity_of_rows(F.greatest("fwd", "rev") / 12, 0.5, 0.9, 4.0).alias("affinity"))
    return found.select(F.col("region").alias("doc_id"), "motif", F.round("affinity", 6).alias("affinity"))


@query(LETTERS + """, c AS (SELECT a.motif AS motif_a, b.motif AS motif_b, a.pos, sum(power(a.p - b.p, 2)) AS sq, greatest(sum(b.p * log2(b.p)) + 2, 0) AS bits, sum(a.p * log2(a.p / b.p)) AS kl
  FROM f a JOIN f b USING (pos, letter) WHERE a.motif = 'en' AND b.motif = 'de' GROUP BY a.motif, b.motif, a.pos)
  SELECT motif_a, motif_b, round(sqrt(sum(sq)), 6) AS euclid, round(avg(sqrt(sq / 2)), 6) AS diff,
  round(CASE WHEN max(bits) < CAST(0.1 AS DOUBLE) THEN 1 ELSE sum(sqrt(sq / 2) * bits) / sum(bits) END, 6) AS infomaskdiff, round(avg(kl) FILTER (bits > 0), 6) AS diverge FROM c GROUP BY motif_a, motif_b""")
def motif_distance(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    out = motifs.distances(m.where("motif = 'en'"), m.where("motif = 'de'"))
    return out.select("motif_a", "motif_b", *[F.round(c, 6).alias(c) for c in ("euclid", "diff", "infomaskdiff", "diverge")])


@query(f"WITH {BASES} SELECT CAST(length(seq) AS INTEGER) AS size, count(*) AS n FROM bases WHERE seq IS NOT NULL GROUP BY 1")
def size_distribution(spark, sf_dir):
    return sequences.sizes(bases(spark, sf_dir), "seq")


@query("""WITH o AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5(s_suppkey || '/0'), s_suppkey) AS k, count(*) OVER () AS n FROM supplier)
  SELECT s_suppkey, CAST(CASE WHEN k <= floor(n * CAST(0.3 AS DOUBLE)) THEN 0 ELSE 1 END AS INTEGER) AS part FROM o""")
def random_split(spark, sf_dir):
    return sequences.random_split(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 0.3)


_SAME = " + ".join(f"CAST(substr(w, CAST(o AS BIGINT) + {i}, 1) = substr(q, {i}, 1) AS INTEGER)" for i in range(1, 5))


@query(f"""WITH {BASES}, {TILES}, d AS (SELECT DISTINCT w FROM tiles), p AS (SELECT w, o, st, {_SAME} AS same FROM d, range(0, 3) r(o), (VALUES ('+', 'GATA'), ('-', 'TATC')) s(st, q)),
  k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY same DESC, st, o) AS k FROM p)
  SELECT w, same / CAST(4 AS DOUBLE) AS identity, CAST(o AS INTEGER) AS "offset", st AS strand FROM k WHERE k = 1""")
def word_comparison(spark, sf_dir):
    """Every word of six against GATA, on both strands."""
    words = tiles(spark, sf_dir).select("w").distinct().withColumn("q", F.lit("GATA"))
    return sequences.compare_words(words, "w", "q").select("w", "identity", "offset", "strand")


@query(LETTERS + """, d AS (SELECT lang AS motif, w, count(*) AS times FROM tiles GROUP BY lang, w),
  s AS (SELECT d.motif, w, max(times) AS times, sum(log2(p) + 2) AS score FROM d JOIN f ON f.motif = d.motif AND f.letter = substr(w, f.pos + 1, 1) GROUP BY d.motif, w),
  a AS (SELECT motif, sum(times) AS n, sum(times * score) / sum(times) AS mean FROM s GROUP BY motif),
  v AS (SELECT motif, any_value(mean) AS mean, CASE WHEN any_value(n) > 1 THEN sqrt(sum(times * power(score - mean, 2)) / (any_value(n) - 1)) ELSE 0 END AS sd FROM s JOIN a USING (motif) GROUP BY motif)
  SELECT motif, round(mean - CAST(1.5 AS DOUBLE) * sd, 6) AS threshold FROM v""")
def motif_own_threshold(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    own = tiles(spark, sf_dir).select(F.col("lang").alias("motif"), F.col("w").alias("seq"))
    return motifs.own_threshold(own, m, 1.5).select("motif", F.round("threshold", 6).alias("threshold"))


@query(LETTERS + " SELECT motif, round(avg(d), 6) AS maxdiff FROM (SELECT motif, pos, sqrt(sum(p * p) + 1 - 2 * min(p)) / sqrt(CAST(2 AS DOUBLE)) AS d FROM f GROUP BY motif, pos) GROUP BY motif")
def motif_max_distance(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    return motifs.max_distance(m).select("motif", F.round("maxdiff", 6).alias("maxdiff"))


@query(LETTERS + """, o AS (SELECT motif, pos, letter, p, '+' AS strand FROM f WHERE motif = 'de' UNION ALL SELECT motif, 5 - pos, translate(letter, 'ACGT', 'TGCA'), p, '-' FROM f WHERE motif = 'de'),
  c AS (SELECT a.motif AS motif_a, o.motif AS motif_b, strand, a.pos AS pos_a, o.pos AS pos_b, sqrt(sum(power(a.p - o.p, 2))) / sqrt(CAST(2 AS DOUBLE)) AS d
        FROM f a JOIN o ON a.letter = o.letter WHERE a.motif = 'en' GROUP BY 1, 2, 3, 4, 5),
  g AS (SELECT motif_a, motif_b, strand, pos_a - pos_b AS off, avg(d) AS distance FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
  k AS (SELECT *, row_number() OVER (PARTITION BY motif_a, motif_b ORDER BY round(distance, 12), strand, off) AS k FROM g)
  SELECT motif_a, motif_b, round(distance, 6) AS distance, strand, CAST(off AS INTEGER) AS "offset" FROM k WHERE k = 1""")
def motif_alignment(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    return motifs.aligned_distance(m.where("motif = 'en'"), m.where("motif = 'de'"), 4).withColumn("distance", F.round("distance", 6))


@query(LETTERS + ", c AS (SELECT motif, pos, max(log2(p) + 2) AS hi, min(log2(p) + 2) AS lo FROM f GROUP BY motif, pos) SELECT motif, round(CAST(0.7 AS DOUBLE) * (sum(hi) - sum(lo)) + sum(lo), 6) AS threshold FROM c GROUP BY motif")
def threshold_back_projection(spark, sf_dir):
    m = motifs.from_sequences(tiles(spark, sf_dir), "lang", "w")
    shares = m.select("motif").distinct().withColumn("threshold", F.lit(0.7))
    return motifs.back_projected(shares, m).withColumn("threshold", F.round("threshold", 6))


#: Thresholds of the motifs as shares of their ranges: total, false positive, type.
SHARES = (("tata", 0.5, 0.9, 4.0), ("gata", 0.6, 0.6, 1.5))


@query(SCANNED + f""", ends AS (SELECT motif, pos, max(ll) AS hi, min(ll) AS lo FROM w GROUP BY motif, pos), r AS (SELECT motif, sum(hi) AS hi, sum(lo) AS lo FROM ends GROUP BY motif),
  v AS (SELECT motif, CAST(total AS DOUBLE) AS total, CAST(CASE WHEN fp = total THEN 0.1 ELSE fp - total END AS DOUBLE) AS gap, CAST(typ AS DOUBLE) AS typ FROM (VALUES {", ".join(map(str, SHARES))}) x(motif, total, fp, typ)),
  z AS (SELECT motif, ln(typ) / gap AS wt, 2 * typ * exp(ln(typ) / gap * total) AS b FROM v),
  a AS (SELECT doc_id, motif, sum(exp(wt * (s - lo) / (hi - lo))) AS a, any_value(b) AS b FROM hits JOIN r USING (motif) JOIN z USING (motif) GROUP BY doc_id, motif)
  SELECT doc_id, motif, round(a / (a + b), 6) AS affinity FROM a""")
def affinity_normalised(spark, sf_dir):
    """Affinities of whole sequences, thresholds joined by motif, scores as shares of the motif's range."""
    thresholds = spark.createDataFrame(SHARES, "motif string, total double, fp double, typ double")
    out = motifs.affinities(hits(spark, sf_dir), thresholds, word_motifs(spark))
    return out.select(F.col("region").alias("doc_id"), "motif", F.round("affinity", 6).alias("affinity"))


# -- Steiner forests ------------------------------------------------------------------


def solution(spark, sf_dir):
    """Interactions that stand for a solved forest: the strongest weight; parts are its roots."""
    roots = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return edges(spark, sf_dir).where("weight > 1"), roots


SOLUTION = f"WITH {EDGES}, {PRIZES}, nd AS (SELECT src AS node FROM edges WHERE weight > 1 UNION SELECT dst FROM edges WHERE weight > 1), r AS (SELECT DISTINCT 'P' || p_partkey AS node FROM part)"


@query(SOLUTION + " SELECT node FROM r WHERE node NOT IN (SELECT node FROM nd)")
def singleton_roots(spark, sf_dir):
    chosen, roots = solution(spark, sf_dir)
    return graph.singleton_roots(roots, chosen)


@query(SOLUTION + """ SELECT (SELECT count(DISTINCT node) FROM prizes) AS terminals, (SELECT count(DISTINCT node) FROM prizes WHERE node IN (SELECT node FROM nd)) AS terminals_found,
  (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM r) AS roots, (SELECT count(*) FROM r WHERE node NOT IN (SELECT node FROM nd)) AS singleton_roots""")
def run_counts(spark, sf_dir):
    chosen, roots = solution(spark, sf_dir)
    return graph.run_counts(prizes(spark, sf_dir), chosen, roots)


def solver_edges(spark, sf_dir):
    return graph.keep_max(graph.clean_edges(edges(spark, sf_dir)))


@query()
def steiner_lineitem(spark, sf_dir):
    """One forest of the whole graph: invariants are tested, not values."""
    e = solver_edges(spark, sf_dir).select(F.lit(0).alias("run"), "src", "dst", "weight", "dir")
    p = prizes(spark, sf_dir).select(F.lit(0).alias("run"), "node", (F.col("prize") / 1000).alias("prize_total"))
    return steiner.solve_runs(e, p, p.select("run", "node"), 1.0, 4)


UNIT = "((CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def noise_sql(*keys):
    """Box and Muller from the MD5 of the keys, as ``robust.normal`` with seed 0."""
    unit = lambda k: UNIT.format(" || '/' || ".join([*keys, f"'0/{k}'"]))
    return f"(sqrt(-2 * ln({unit(1)})) * cos(2 * pi() * {unit(2)}))"


@query(f"""WITH {EDGES}, cleaned AS (SELECT CASE WHEN dir = 'U' THEN least(src, dst) ELSE src END AS src, CASE WHEN dir = 'U' THEN greatest(src, dst) ELSE dst END AS dst, dir,
  least(greatest(weight, 0), CAST(0.99 AS DOUBLE)) AS weight FROM edges WHERE src <> dst), top AS (SELECT src, dst, dir, max(weight) AS weight FROM cleaned GROUP BY src, dst, dir)
  SELECT CAST(run AS INTEGER) AS run, src, dst, dir, round(weight + CAST(0.333 AS DOUBLE) * {noise_sql("src", "dst", "dir", "run")}, 6) AS weight FROM top, range(0, 5) r(run)""")
def noise_runs(spark, sf_dir):
    return robust.noise_edges(solver_edges(spark, sf_dir), 5, 0.333).withColumn("weight", F.round("weight", 6))


@query(f"""WITH RECURSIVE {PRIZES}, {EDGES}, {DEGREES}, ranked AS (SELECT node, row_number() OVER (ORDER BY degree, node) - 1 AS rank, count(*) OVER () AS n FROM degrees),
  wanted AS (SELECT run, prize, n, CAST(((round(rank + 100 * {noise_sql("node", "run")}) % n) + n) % n AS BIGINT) AS want, md5(node || '/' || run || '/0') AS o
    FROM prizes JOIN ranked USING (node), range(0, 5) r(run)),
  laps AS (SELECT *, want AS spot FROM wanted UNION ALL SELECT *, want + n FROM wanted),
  seq AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY spot, o) AS k FROM laps),
  placed AS (SELECT run, prize, n, spot, k + max(spot - k) OVER (PARTITION BY run ORDER BY k) AS pos FROM seq)
  SELECT CAST(run AS INTEGER) AS run, node, prize FROM placed JOIN ranked ON ranked.rank = placed.pos % placed.n WHERE spot >= placed.n""")
def random_terminals(spark, sf_dir):
    return robust.random_terminals(prizes(spark, sf_dir), graph.degree(edges(spark, sf_dir)), 5)


@query()
def p_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("motif"), "l_quantity", "l_discount")
    return stats.bh_qvalues(stats.regression(li, "motif", "l_discount", "l_quantity"))


@query()
def cross_validation(spark, sf_dir):
    """Held-out suppliers, one fold a run; a fold's forest is solved without their prizes."""
    fold = robust.folds(prizes(spark, sf_dir), 5).select("node", "prize", "fold")
    runs = spark.range(5).select(F.col("id").cast("int").alias("run"))
    left = fold.join(F.broadcast(runs), F.col("fold") != F.col("run")).select("run", "node", (F.col("prize") / 1000).alias("prize_total"))
    # Written once; the runs, which may be solved in groups, all read it.
    e = robust.runs_of(ranges.Tables(spark)(solver_edges(spark, sf_dir)), 5).select("run", "src", "dst", "weight", "dir")
    solved = steiner.solve_runs(e, left, robust.runs_of(fold.select("node"), 5).select("run", "node"), 1.0, 4)
    return robust.fold_summary(fold.select("fold", "node"), solved.select(F.col("run").alias("fold"), "node"), fold)


# The queries that are cut to ranges and tiles register themselves here.
from chromaweave.plans import scale  # noqa: E402, F401
