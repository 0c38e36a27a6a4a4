"""Readers of counts, hits, clusters, p-values and other line formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.fasta import InputError

#: Longest texts that are kept, and coordinates that a hit may have.
MOST_DESCRIPTION, MOST_HIT_NAME, MOST_SEQUENCE, MOST_COORDINATE = 250, 30, 32000, 32000
HIT_SCHEMA = (
    "query string, subject string, sim double, aln int, mismatches int, gap_opens int, seq_start int, seq_end int, "
    "hit_start int, hit_end int, evalue double, bits double"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, as words."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(F.trim("value").alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))


def read_counts(spark: SparkSession, path: str, libraries: dict[str, list[str]]) -> DataFrame:
    """seq, lib, rep, n of a matrix whose header names the replicates; ``libraries`` gives each library's replicates.
    Reals are rounded half up; rep 0 is the library's total. A header that a library's replicate lacks is an error."""
    head = _lines(spark, path).select("w").first()
    if not head:
        raise InputError(f"{path} is empty")
    place = {name: i for i, name in enumerate(head.w)}
    wanted = [(lib, r + 1, name) for lib, names in libraries.items() for r, name in enumerate(names)]
    if missing := [name for *_, name in wanted if name not in place]:
        raise InputError(f"{path} has no column {missing[0]}")
    shift = F.size("w") - len(head.w)  # rows may have a name that the header leaves out
    cells = F.array(*[F.struct(F.lit(lib).alias("lib"), F.lit(r).alias("rep"), F.floor(F.get("w", F.lit(place[name]) + shift).cast("double") + 0.5).cast("long").alias("n")) for lib, r, name in wanted])
    rows = _lines(spark, path).where(F.col("w") != F.lit(head.w)).select(F.get("w", F.lit(0)).alias("seq"), F.explode(cells).alias("c")).select("seq", "c.lib", "c.rep", "c.n")
    total = rows.groupBy("seq", "lib").agg(F.sum("n").alias("n")).select("seq", "lib", F.lit(0).alias("rep"), "n")
    return rows.unionByName(total)


def build_counts(spark: SparkSession, files: dict[str, str], names: DataFrame) -> DataFrame:
    """One matrix from two-column files, a column for each: a row per name, 0 where a file lacks it. Of lines that repeat
    a name the last counts. An unknown name or a count that is not whole is an error."""
    long = None
    for column, path in files.items():
        rows = _lines(spark, path).select(F.get("w", F.lit(0)).alias("name"), F.get("w", F.lit(1)).alias("v"), F.monotonically_increasing_id().alias("at"))
        rows = rows.groupBy("name").agg(F.max_by("v", "at").alias("v")).withColumn("file", F.lit(column))
        long = rows if long is None else long.unionByName(rows)
    wrong = long.where(~F.coalesce(F.col("v").rlike(r"^\d+$"), F.lit(False))).head(1) or long.join(names.select("name"), "name", "left_anti").head(1)
    if wrong:
        raise InputError(f"{wrong[0].file}: {wrong[0]['name']} {wrong[0].v}")
    wide = long.groupBy("name").pivot("file", list(files)).agg(F.max(F.col("v").cast("long")))
    return names.select("name").join(wide, "name", "left").fillna(0, list(files))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """The twelve tab-separated columns of a search, comments left out."""
    return spark.read.csv(path, sep="\t", schema=HIT_SCHEMA, comment="#")


def good_hits(hits: DataFrame, least_bits: float = 0.0) -> DataFrame:
    """Without hits of coordinates beyond the limit and of e-value 0 with too few bits."""
    far = reduce(lambda a, b: a | b, [F.col(c) > MOST_COORDINATE for c in ("seq_start", "seq_end", "hit_start", "hit_end")])
    return hits.where(~far & ~((F.col("evalue") == 0) & (F.col("bits") < least_bits)))


def subject_parts(subject: Column) -> tuple[Column, Column, Column]:
    """type, other and id of a subject: ``id``, ``type|id``, ``type|other|id``, or the fourth part of longer ones."""
    parts = F.split(F.regexp_replace(subject, r"\|+$", ""), r"\|")
    n = F.size(parts)
    kind = F.when(n > 1, F.get(parts, F.lit(0)))
    other = F.when(n > 2, F.get(parts, F.lit(1)))
    return kind, other, F.substring(F.when(n >= 4, F.get(parts, F.lit(3))).otherwise(F.element_at(parts, -1)), 1, MOST_HIT_NAME)


def header_parts(header: Column) -> tuple[Column, Column, Column]:
    """id, description and species of a header: UniProt ``sp|A|ID text OS=Species XX=``, ``gi|..|ref|..| text
    [Species]``, ``type|name text OS=Species``, or plain; what is not there is ``unk``."""
    word, rest = F.regexp_extract(header, r"^(\S*)", 1), F.regexp_extract(header, r"^\S*\s+(.*)$", 1)
    *_, name = subject_parts(word)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    os_ = blank(F.regexp_extract(rest, r"OS=(.*?)(?:\s+[A-Z]{2}=|$)", 1))
    bracket = blank(F.regexp_extract(rest, r"\[([^\[\]]+)\]\s*$", 1))
    text = F.when(rest.contains("OS="), F.regexp_extract(rest, r"^(.*?)\s*OS=", 1)).otherwise(F.regexp_replace(rest, r"\s*\[[^\[\]]+\]\s*$", ""))
    return name, F.substring(F.coalesce(blank(text), F.lit("unk")), 1, MOST_DESCRIPTION), F.coalesce(os_, bracket, F.lit("unk"))


def read_clusters(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """cluster, ds, seq from lines ``name ds|seq ds|seq ...``; unknown sequences and clusters of one member go.
    ``known`` has ds, seq."""
    rows = _lines(spark, path).select(F.get("w", F.lit(0)).alias("cluster"), F.explode(F.slice("w", 2, 1 << 30)).alias("m"))
    rows = rows.select("cluster", F.substring_index("m", "|", 1).alias("ds"), F.substring_index("m", "|", -1).alias("seq")).distinct()
    rows = rows.join(known.select("ds", "seq"), ["ds", "seq"], "left_semi")
    many = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    return rows.join(many, "cluster", "left_semi").select("cluster", "ds", "seq")


def read_kaks(spark: SparkSession, path: str) -> DataFrame:
    """seq1, seq2, method, ka, ks, kaks, p and kaks_na; NA is null, and kaks_na tells it from what was never computed."""
    rows = _lines(spark, path).where((F.size("w") >= 6) & F.get("w", F.lit(0)).contains(":"))
    number = lambda i: F.get("w", F.lit(i)).try_cast("double")
    name = F.get("w", F.lit(0))
    return rows.select(F.substring_index(name, ":", 1).alias("seq1"), F.substring_index(name, ":", -1).alias("seq2"), F.get("w", F.lit(1)).alias("method"), number(2).alias("ka"), number(3).alias("ks"), number(4).alias("kaks"), number(5).alias("p"), (F.get("w", F.lit(4)) == "NA").alias("kaks_na"))


def read_pvalues(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """seq, p and, from the first line ``group1 group2 column``, the groups (joined by ``:``) and the column."""
    head = _lines(spark, path).first()
    if not head or len(head.w) < 3:
        raise InputError(f"{path} does not begin with two groups and a column")
    rows = _lines(spark, path).where(F.col("line") != head.line)
    return rows.select(F.get("w", F.lit(0)).alias("seq"), F.get("w", F.lit(1)).try_cast("double").alias("p")), {"group1": head.w[0].split(":"), "group2": head.w[1].split(":"), "column": head.w[2]}


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """seq, group, start, end, strand and order of lines ``seq group:start-end(strand)``: groups by their number, then X, Y."""
    pattern = r"^(\S+)\s+([^:\s]+):(\d+)-(\d+)\(([+-])\)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = _lines(spark, path).where(F.col("line").rlike(pattern)).select(part(1).alias("seq"), part(2).alias("group"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"), part(5).alias("strand"))
    number = F.regexp_extract("group", r"(\d+)$", 1)
    place = F.when(number != "", number.try_cast("int")).when(F.upper(F.expr("right(group, 1)")) == "X", 1000).when(F.upper(F.expr("right(group, 1)")) == "Y", 1001).otherwise(1002)
    return rows.withColumn("group_order", place)


def add_remarks(sequences: DataFrame, spark: SparkSession, path: str, column: str = "remark") -> DataFrame:
    """Sequences with the remarks of a file in front of their own: ``new; old``, cut at the longest text."""
    new = _lines(spark, path).select(F.get("w", F.lit(0)).alias("name"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("_new")).groupBy("name").agg(F.concat_ws("; ", F.sort_array(F.collect_list("_new"))).alias("_new"))
    old = F.nullif(F.col(column), F.lit(""))
    return sequences.join(new, "name", "left").withColumn(column, F.substring(F.concat_ws("; ", "_new", old), 1, MOST_DESCRIPTION)).drop("_new")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a substitution matrix in the usual text form; both orders of each pair."""
    head = _lines(spark, path).first().w
    rows = _lines(spark, path).where(F.size("w") == len(head) + 1)
    cells = F.arrays_zip(F.lit(head).alias("b"), F.slice("w", 2, len(head)).cast("array<double>").alias("score"))
    return rows.select(F.get("w", F.lit(0)).alias("a"), F.explode(cells).alias("c")).select("a", "c.b", "c.score")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database; with a numeric key and its bounds, in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def verify(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lines that break a format (fasta, quality, hits, obo, pairs): line and problem; a good file gives none."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).withColumnRenamed("value", "line")
    bad = {
        "fasta": F.when(~F.col("line").rlike(r"^(>\s*\S|[/]|[A-Za-z*.\s-]+$)"), "neither a header nor residues"),
        "quality": F.when(~F.col("line").rlike(r"^(>\s*\S|[\d\s]+$)"), "neither a header nor numbers"),
        "hits": F.when(F.size(F.split("line", "\t")) < 11, "fewer than eleven columns"),
        "obo": F.when(~F.col("line").rlike(r"^(\[\w+\]|[\w-]+:.*)"), "neither a stanza nor a tag"),
        "pairs": F.when(F.size(F.split(F.trim("line"), r"\s+")) < 2, "fewer than two words"),
    }[kind]
    return rows.withColumn("problem", bad).where("problem IS NOT NULL")
