"""Writers.  Each gives a DataFrame of text lines or columns, or writes one through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.scalars import wrap
from chromaweave.operators.ranges import numbered
from chromaweave.sources.formats import TAMO_MARKS


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)


def fasta_lines(seqs: DataFrame, width: int = 70) -> DataFrame:
    return seqs.orderBy("header").select(F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def numbered_fasta_lines(seqs: DataFrame, order: str) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.col(order), F.lit("\n"), "seq").alias("value"))


def regression_table(results: DataFrame) -> DataFrame:
    return results.select(F.col("motif").alias("Motif"), F.col("slope").alias("Slope"), F.col("p").alias("p-val"), F.col("q").alias("q-val"))


def sif_lines(edges: DataFrame) -> DataFrame:
    """'a pp b' for undirected, 'a pd b' for directed edges, in order."""
    return edges.select("src", F.when(F.col("dir") == "U", "pp").otherwise("pd").alias("type"), "dst").orderBy("src", "dst")


def edge_attributes(edges: DataFrame) -> DataFrame:
    name = F.concat("src", F.lit(" ("), F.when(F.col("dir") == "U", "pp").otherwise("pd"), F.lit(") "), "dst")
    return edges.orderBy("src", "dst").select(name.alias("Edge"), F.col("weight").alias("Weight"), F.col("fraction").alias("FractionOfOptimalForestsContaining"))


def node_attributes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("node").select(
        F.col("node").alias("Protein"), F.coalesce("prize", F.lit(0.0)).alias("Prize"), F.coalesce("betweenness", F.lit(0.0)).alias("BetweennessCentrality"),
        F.col("fraction").alias("FractionOfOptimalForestsContaining"), F.coalesce("terminal_type", F.lit("")).alias("TerminalType"),
    )


def attribute_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    """'key = value' lines of the older network format."""
    return df.orderBy(key).select(F.concat(F.col(key), F.lit(" = "), F.col(value).cast("string")).alias("value"))


def matrix_rows(matrix: DataFrame, genes: list[str]) -> DataFrame:
    """One row a factor, one column for each of a listed set of genes."""
    return matrix.groupBy("tf").pivot("gene", genes).agg(F.first("score")).na.fill(0.0)


def tamo_lines(m: DataFrame, fields: DataFrame) -> DataFrame:
    """motif, value: the text of each motif's block in a motif file, from its log odds and ``formats.tamo_fields``."""
    number = lambda c, f: F.format_string(f, c)
    cells = m.groupBy("motif", "letter").agg(F.array_sort(F.collect_list(F.struct("pos", "ll"))).alias("x"))
    row = F.concat(F.lit("#"), "letter", F.lit(" "), F.array_join(F.transform("x", lambda c: number(c["ll"], "%9.3f")), " "))
    matrix = cells.groupBy("motif").agg(F.max(F.size("x")).alias("width"), F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    ruler = F.concat(F.lit("#  "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: number(i, "%9d")), " "))
    given = lambda c, text: F.when(F.col(c).isNotNull(), text)
    minus_log = {name: log for _, name, log in TAMO_MARKS}
    marks = dict((name, mark) for mark, name, _ in reversed(TAMO_MARKS) if name not in ("total_bits", "map_score", "p_value"))
    shown = [given(n, F.concat(F.lit(f" {mark} "), number(-F.log10(n) if minus_log[n] else F.col(n), "%6.4f"))) for n, mark in marks.items()]
    word = F.coalesce("word", F.lit("-"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    line = F.concat(
        F.format_string("Motif %3d %-25s (Bits: %5.2f  MAP: %5.2f   D: %5.3f  %2d) E: %6.3f", "motif", word, zero("total_bits"), zero("map_score"), zero("seed_dist"), F.coalesce("seed_num", F.lit(0)), -F.log10(F.coalesce("p_value", F.lit(1.0)))),
        F.concat_ws("", *shown),
    )
    beside = F.when(F.col("dataset").isNotNull(), F.format_string("fasta file: %s beta: %f background sequences: %s", "dataset", F.coalesce("beta", F.lit(0.0)), F.coalesce("background", F.lit("-"))))
    text = F.concat_ws(
        "\n", F.concat(F.format_string("Log-odds matrix for Motif %3d ", "motif"), word), ruler, "rows", given("seed", F.format_string("Seed %3d: %s", "seed_num", "seed")), given("gamma", F.format_string("Gamma: %7.5f", "gamma")),
        given("evalue", F.format_string("Evalue: %6.3e", "evalue")), given("program", F.concat(F.lit("Program specific score: "), "program", F.lit(": "), F.coalesce("program_score", F.lit("")))), given("family", F.concat(F.lit("Family: "), "family")),
        given("source", F.concat(F.lit("Source:  "), "source")), beside, given("match_threshold", F.format_string("SVM match threshold: %s", "match_threshold")), given("cv_error", F.format_string("classification error: %s", "cv_error")),
        given("word", line), given("threshold", F.format_string("Threshold: %s", "threshold")),
    )
    return matrix.join(fields, "motif").select("motif", text.alias("value"))


def by_run(df: DataFrame, path: str, run: str = "run") -> None:
    """Results of runs or folds as Parquet, a folder for each, written side by side."""
    df.write.partitionBy(run).mode("error").parquet(path)


def report_lines(report: DataFrame) -> DataFrame:
    """run, value: the figures of ``pipelines.report`` as text, one to a line."""
    names = [c for c in report.columns if c != "run"]
    return report.select("run", F.concat_ws("\n", *[F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.col(c).cast("string")) for c in names]).alias("value"))


def score_rows(matrix: DataFrame, digits: int = 3) -> DataFrame:
    """tf, value: a motif's scores over all genes of the matrix in the order of their names, tab-separated; missing cells are 0.

    A row is gathered for each motif: as long as there are genes.
    """
    genes = matrix.select("gene").distinct()
    cells = matrix.select("tf").distinct().crossJoin(genes).join(matrix.select("tf", "gene", "score"), ["tf", "gene"], "left")  # the matrix itself
    row = F.array_sort(F.collect_list(F.struct("gene", F.coalesce("score", F.lit(0.0)).alias("x"))))
    return cells.groupBy("tf").agg(row.alias("r")).select("tf", F.array_join(F.transform("r", lambda c: F.format_string(f"%.{digits}f", c["x"])), "\t").alias("value"))


def matrix_bundle(matrix: DataFrame, path: str) -> None:
    """A matrix as Parquet: its cells (i, j, score), and the names of its rows (tfs) and columns (genes) by number."""
    tfs, genes = numbered(matrix.select("tf").distinct(), ["tf"], "i"), numbered(matrix.select("gene").distinct(), ["gene"], "j")
    tfs.write.parquet(f"{path}/tfs")
    genes.write.parquet(f"{path}/genes")
    matrix.join(tfs, "tf").join(genes, "gene").select("i", "j", "score").write.parquet(f"{path}/cells")


def read_bundle(spark, path: str) -> DataFrame:
    """tf, gene, score of what :func:`matrix_bundle` wrote."""
    cells = spark.read.parquet(f"{path}/cells")
    return cells.join(spark.read.parquet(f"{path}/tfs"), "i").join(spark.read.parquet(f"{path}/genes"), "j").select("tf", "gene", "score")


def score_table(scores: DataFrame, path: str) -> None:
    """Factor scores as two tab-separated columns without a header, sorted by factor."""
    tsv(scores.orderBy("tf").select("tf", "score"), path, header=False)
