"""Readers of the text formats, as bulk jobs over all files of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import is_position, norm_chrom

#: Headers of at most so many files (a few integers each) are broadcast.
MANY_FILES = 100_000
# The columns that the formats name.
REPORT_COLUMNS = {"chrom": "Chr", "pos": "Position", "lrr": "Log R Ratio", "baf": "B Allele Freq", "probe": "SNP Name"}
EXPERIMENT_COLUMNS = ("Experiment", "Cell_Line", "Cell_Clone", "Control", "Sample_ID")
BED = ("chrom", "start", "end", "name", "score", "strand")
#: Allelic states: name, copy number, allelism, probe state, informative, mosaic, scalar of probability.
STATES = """
CN0_0 0 0 CN0_0 no no 2
CN1_1 1 1 CN1_1 no no 2
CN2_02 2 1 CN2_02 no no 2
CN2_11 2 2 CN2_02 no no 2
CN2_11 2 2 CN2_11 yes no 2
CN3_03 3 1 CN3_03 no no 2
CN3_12 3 2 CN3_03 no no 2
CN3_12 3 2 CN3_12 yes no 1
CN4_04 4 1 CN4_04 no no 2
CN4_13 4 2 CN4_04 no no 2
CN4_13 4 2 CN4_13 yes no 1
CN4_22 4 2 CN4_04 no no 2
CN4_22 4 2 CN4_22 yes no 2
CN5_05 5 1 CN5_05 no no 2
CN5_14 5 2 CN5_05 no no 2
CN5_14 5 2 CN5_14 yes no 1
CN5_23 5 2 CN5_05 no no 2
CN5_23 5 2 CN5_23 yes no 1
CN1.5_02 1.5 1 CN1.5_02 no yes 2
CN1.5_11 1.5 2 CN1.5_02 no yes 2
CN1.5_11 1.5 2 CN1.5_11 yes yes 2
CN2.5_03 2.5 1 CN2.5_03 no yes 2
CN2.5_12 2.5 2 CN2.5_03 no yes 2
CN2.5_12 2.5 2 CN2.5_12 yes yes 1
"""


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line) of text files, without carriage returns."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, lines counted from 0 in each file. A file is read in blocks; where a block begins
    comes from a table of a row for each block.
    """
    return _block_lines(spark, path).drop("block")


def _block_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line, block): numbered lines with the place in the file at which their block begins."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = text.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return text.join(starts, ["file", "block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line", "block")


def parse_reports(text: DataFrame, files: int | None = None) -> DataFrame:
    """Probe rows from (file, line) of vendor reports: the header of each file tells where its columns are.

    Preamble lines and bad rows fail the checks on chromosome and position; if either value of a probe is not a number,
    both are NULL. Headers, one a file, are joined back to the lines; with at most ``MANY_FILES`` of them, if ``files`` says so,
    they are broadcast, so that no line is shuffled.
    """
    fields = F.split("line", "\t")
    heads = text.where(F.contains("line", F.lit("SNP Name")) & F.contains("line", F.lit("Log R Ratio"))).groupBy("file").agg(F.min("line").alias("_head"))
    heads = heads.select("file", *(F.array_position(F.split("_head", "\t"), F.lit(v)).cast("int").alias(f"_{k}") for k, v in REPORT_COLUMNS.items()))
    if files is not None and files <= MANY_FILES:
        heads = F.broadcast(heads)
    rows = text.join(heads, "file").where(F.contains("line", F.lit("\t")))
    got = rows.select("file", *(F.try_element_at(fields, F.when(F.col(f"_{k}") > 0, F.col(f"_{k}"))).alias(k) for k in REPORT_COLUMNS))
    value = lambda c: F.when(F.lower(c).isin("nan", "na", ""), F.lit(None)).otherwise(c).try_cast("double")
    both = value(F.col("lrr")).isNotNull() & value(F.col("baf")).isNotNull()
    good = got.where(is_position(F.col("pos")) & (F.col("chrom") != "") & (F.col("probe") != ""))
    return good.select("file", norm_chrom(F.col("chrom")).alias("chrom"), F.col("pos").cast("long").alias("pos"), "probe", F.when(both, value(F.col("lrr"))).alias("lrr"), F.when(both, value(F.col("baf"))).alias("baf"))


def read_final_reports(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """All probe reports below a path or glob in one job."""
    rows = parse_reports(lines(spark, path), len(spark.read.text(path).inputFiles()))
    return rows.where(F.col("chrom").isin(chroms)) if chroms else rows


def parse_manifest(text: DataFrame, name_col: str = "DNA_ID") -> DataFrame:
    """(row, sample, dna_name, dna_id) from the lines of a manifest, whose preamble ends at a line that starts ``Row,``.
    White space in names becomes ``_``. A missing name column is an error.
    """
    heads = text.where(F.startswith("line", F.lit("Row,"))).groupBy("file").agg(F.min("line").alias("_head"))
    rows = text.join(heads, "file").where(F.col("line").rlike("^[0-9]+,"))
    cells, head = F.split("line", ","), F.split("_head", ",")

    def cell(name: str) -> Column:
        at = F.array_position(head, F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at(cells, F.when(at > 0, at))).otherwise(F.raise_error(F.lit(f"no column {name} in the manifest")).cast("string") if name == name_col else F.lit(None))

    return rows.select("file", cell("Row").cast("long").alias("row"), F.regexp_replace(cell(name_col), r"\s", "_").alias("sample"), cell("DNA_Name").alias("dna_name"), cell("DNA_ID").alias("dna_id"))


def read_manifest(spark: SparkSession, path: str, name_col: str = "DNA_ID") -> DataFrame:
    """A sample manifest."""
    return parse_manifest(lines(spark, path), name_col)


def resolve_reports(manifest: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """(sample, file): the report named after a sample's row, else its name, else its id. ``files`` has ``file``.

    A sample must have exactly one; otherwise ``strict`` fails, and without it the sample comes with NULL.
    """
    key = F.regexp_extract("file", r"FinalReport_?(.*)\.txt$", 1)
    under = F.contains("file", F.lit("FinalReport_"))
    named = files.select("file", key.alias("_key"), under.alias("_under"))
    wanted = manifest.select("row", "sample", F.posexplode(F.array(F.struct(F.lit(False).alias("u"), F.col("row").cast("string").alias("k")), F.struct(F.lit(True).alias("u"), F.col("dna_name").alias("k")), F.struct(F.lit(True).alias("u"), F.col("dna_id").alias("k")))).alias("prio", "x"))
    hits = wanted.join(named, (F.col("x.k") == F.col("_key")) & (F.col("x.u") == F.col("_under")))
    found = hits.groupBy("row", "sample", "prio").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file")).groupBy("row", "sample").agg(F.min(F.struct("prio", "n", "file")).alias("b"))
    out = manifest.select("row", "sample").join(found, ["row", "sample"], "left")
    one = F.coalesce(F.col("b.n") == 1, F.lit(False))
    bad = F.raise_error(F.concat(F.lit("not exactly one report for sample "), F.col("sample"))).cast("string") if strict else F.lit(None)
    return out.select("row", "sample", F.when(one, F.col("b.file")).otherwise(bad).alias("file"))


def prototype_probes(reports: DataFrame) -> DataFrame:
    """Probe positions from the first file."""
    first = reports.agg(F.min("file").alias("file"))
    return reports.join(F.broadcast(first), "file").select("chrom", "pos", "probe")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """An experiment table; its required columns are checked."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in EXPERIMENT_COLUMNS if c not in df.columns]:
        raise ValueError(f"columns missing from the experiment table: {', '.join(missing)}")
    return df


def parse_bed(text: DataFrame) -> DataFrame:
    """Intervals from (ord, line): comments and blanks are skipped, thousands separators removed, bad integers fail."""
    cells = F.split("line", "\t")
    whole = lambda k, name: F.coalesce(F.regexp_replace(F.get(cells, F.lit(k)), ",", "").try_cast("long"), F.raise_error(F.concat(F.lit(f"bad {name} in BED line: "), F.col("line"))).cast("long")).alias(name)
    rows = text.where(~F.startswith("line", F.lit("#")) & (F.trim("line") != ""))
    return rows.select("ord", F.get(cells, F.lit(0)).alias("chrom"), whole(1, "start"), whole(2, "end"), F.get(cells, F.lit(3)).alias("name"), F.get(cells, F.lit(4)).try_cast("double").alias("score"), F.get(cells, F.lit(5)).alias("strand"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A BED file with ``ord``, the number of its line. ``.gz`` is read as such; ``.bgz`` is refused, as Spark would take it for
    plain text.
    """
    if path.endswith(".bgz"):
        raise ValueError("rename .bgz files to .gz")
    return parse_bed(numbered_lines(spark, path).select(F.col("line_no").alias("ord"), "line"))


def model_from_bed(bed: DataFrame) -> DataFrame:
    """An external copy-number model: the six columns as they are."""
    return bed.select("ord", *BED)


def parse_alignments(text: DataFrame) -> DataFrame:
    """The first nine columns of SAM lines; header lines are skipped."""
    cells = F.split("line", "\t", 10)
    rows = text.where(~F.startswith("line", F.lit("@")))
    names = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"))
    return rows.select(*(F.get(cells, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Paired alignments from SAM text or Parquet."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else parse_alignments(lines(spark, path))


def chunk_sequences(contigs: DataFrame, chunk: int) -> DataFrame:
    """(contig, chunk_no, seq) from (contig, seq), in capitals."""
    n = F.floor((F.length("seq") + chunk - 1) / chunk)
    rows = contigs.where(F.length("seq") > 0).select("contig", F.upper("seq").alias("_seq"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_no"))
    return rows.select("contig", F.col("chunk_no").cast("long").alias("chunk_no"), F.substr("_seq", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("seq"))


def place_bases(text: DataFrame) -> DataFrame:
    """(contig, offset, seq) from (file, block, line_no, line) of FASTA files: each line of bases with its contig and its place there.

    Lines are looked at within their block alone. What a block begins with, the contig that is open and how many of its bases
    came before, is told by tables of a row for each block, and for each contig and block. So a contig of any length is never one
    row, as long as its lines are not. White space is left out; lines before the first header belong to none.
    """
    here, rest = Window.partitionBy("file", "block").orderBy("line_no"), Window.unboundedPreceding
    is_head = F.startswith("line", F.lit(">"))
    rows = text.withColumn("_head", F.max(F.when(is_head, F.col("line_no"))).over(here.rowsBetween(rest, 0)))
    heads = text.where(is_head).select("file", F.col("line_no").alias("_head"), F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig"))
    blocks = rows.groupBy("file", "block").agg(F.max("_head").alias("_last"))
    open_ = F.max("_last").over(Window.partitionBy("file").orderBy("block").rowsBetween(rest, -1))
    rows = rows.join(blocks.select("file", "block", open_.alias("_open")), ["file", "block"])
    bases = F.upper(F.regexp_replace("line", r"\s", ""))
    rows = rows.where(~is_head).select("file", "block", "line_no", F.coalesce("_head", "_open").alias("_head"), bases.alias("seq")).where(F.col("_head").isNotNull() & (F.col("seq") != ""))
    keys = ["file", "_head"]
    parts = rows.groupBy(*keys, "block").agg(F.sum(F.length("seq").cast("long")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(rest, -1)), F.lit(0))
    rows = rows.join(parts.select(*keys, "block", before.alias("_before")), [*keys, "block"])
    inside = F.coalesce(F.sum(F.length("seq").cast("long")).over(Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(rest, -1)), F.lit(0))
    return rows.withColumn("offset", F.col("_before") + inside).join(heads, keys).select("contig", "offset", "seq")


def chunk_pieces(pieces: DataFrame, chunk: int) -> DataFrame:
    """(contig, chunk_no, seq) from pieces (contig, offset, seq): a piece goes to every chunk that it reaches into."""
    end = F.col("offset") + F.length("seq") - 1
    rows = pieces.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor(end / chunk))))
    low = F.greatest(F.col("chunk_no") * chunk - F.col("offset"), F.lit(0))
    high = F.least((F.col("chunk_no") + 1) * chunk - F.col("offset"), F.length("seq"))
    part = F.struct("offset", F.substr("seq", (low + 1).cast("int"), (high - low).cast("int")).alias("s"))
    found = rows.groupBy("contig", "chunk_no").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return found.select("contig", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join("_p.s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """FASTA files as chunks (contig, chunk_no, seq), in capitals; files are split into blocks like any text."""
    return chunk_pieces(place_bases(_block_lines(spark, path)), chunk)


def read_probe_gc(spark: SparkSession, path: str) -> DataFrame:
    """(probe, frac_gc, line_no) of a GC table as texts; see ``last_wins`` for its rules."""
    cells = F.split("line", "\t")
    return numbered_lines(spark, path).where((F.col("line_no") > 0) & (F.col("line") != "")).select(F.get(cells, F.lit(0)).alias("probe"), F.get(cells, F.lit(1)).alias("frac_gc"), "line_no")


def read_probe_model(spark: SparkSession, path: str, require: tuple[str, ...] = ("as_out", "cn_out", "inf_out", "lrr", "baf")) -> DataFrame:
    """A refined model without rows that miss a required value."""
    return spark.read.parquet(path).dropna(subset=list(require))


def read_svs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The variant tables of many samples."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def load_states(spark: SparkSession, max_cn: float, mosaic: bool) -> DataFrame:
    """The state table up to a copy number, with or without mosaic states."""
    rows = [x.split() for x in STATES.strip().splitlines()]
    df = spark.createDataFrame([(n, float(cn), int(a), p, i == "yes", m == "yes", float(s)) for n, cn, a, p, i, m, s in rows], "allelic_state string, copy_number double, allelism int, probe_state string, informative boolean, mosaic boolean, prob_scalar double")
    return df.where((F.col("copy_number") <= max_cn) & (F.lit(mosaic) | ~F.col("mosaic")))
