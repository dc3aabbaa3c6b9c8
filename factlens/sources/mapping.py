"""External tables: a declarative mapping compiled to one projection, with a diagnostic for each row that breaks a grammar."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factlens.functions.ident import stable_id
from factlens.operators.pit import lineage_violations
from factlens.schema import DIMENSIONS, FACT, is_token
from factlens.sources import arrow_source, artifacts
from factlens.sources.sinks import work_folder

DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
SEQUENCE = r"^[1-9][0-9]*$"
REQUIRED = ("entity_id", "concept_namespace", "concept", "value", "unit", "period_type", "period_end", "filed_on", "source_name", "source_locator", "source_row_key")


class MappingError(ValueError):
    """Columns of the input and the mapping do not agree."""


@dataclass(frozen=True)
class Mapping:
    """columns: field -> input column; constants: field -> value. Fields in neither are absent. Extra input columns are an error if `reject_unmapped`."""

    columns: dict[str, str]
    constants: dict[str, str] = field(default_factory=dict)
    null_tokens: tuple[str, ...] = ("",)
    period_labels: dict[str, str] = field(default_factory=lambda: {"instant": "instant", "duration": "duration"})
    dimensions: dict[str, str] = field(default_factory=dict)
    reject_unmapped: bool = False
    #: Whether the source says that data were available when they were filed. Without it, and without a column, that is an assumption.
    available_when_filed: bool = False

    def availability(self) -> str:
        return "column" if "available_on" in self.columns else "filing" if self.available_when_filed else "assumed"

    def check(self, names: list[str]) -> None:
        used = {*self.columns.values(), *self.dimensions.values()}
        if len(set(names)) < len(names):
            raise MappingError("repeated column names")
        if missing := sorted(used - set(names)):
            raise MappingError(f"missing columns: {missing}")
        if self.reject_unmapped and (extra := sorted(set(names) - used)):
            raise MappingError(f"unmapped columns: {extra}")
        if absent := [f for f in REQUIRED if f not in self.columns and f not in self.constants]:
            raise MappingError(f"fields without a source: {absent}")

    def mapping_id(self) -> str:
        """The same for mappings that say the same."""
        body = {k: sorted(v.items()) if isinstance(v, dict) else v for k, v in vars(self).items()}
        return f"dmap_{hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}"

    def text(self, name: str) -> Column:
        if name in self.columns:
            c = F.col(f"`{self.columns[name]}`").cast("string")
            return F.when(~c.isin(*self.null_tokens), c) if self.null_tokens else c
        return F.lit(self.constants.get(name)).cast("string")


FLOATS = (T.FloatType, T.DoubleType)


#: Columns beside those of the fact: what is wrong with the row, and where it stands.
PLACE = ("_file", "_block", "_row")


def placed(raw: DataFrame) -> DataFrame:
    """`raw` with the place of each row: its file and the start of its part, where Spark read it from files, and a number that grows within it."""
    where = {"_file": F.lit(""), "_block": F.lit(0).cast("long")}
    try:
        meta = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
        raw.select(*meta.values())
        where = meta
    except AnalysisException:  # no files behind it
        pass
    return raw.withColumns(where | {"_row": F.monotonically_increasing_id()})


def normalize(raw: DataFrame, m: Mapping) -> tuple[DataFrame, DataFrame]:
    """(facts, diagnostics). A row's first failing field, in the fact's order, names its diagnostic; copies of a source
    coordinate after the first row are diagnostics too. Diagnostics: source_row_key, error_code, error_field."""
    marked = _marked(placed(raw), m)
    return marked.filter("problem IS NULL").select(*FACT.names), marked.filter("problem IS NOT NULL").select("source_row_key", "problem.error_code", "problem.error_field")


def marked_rows(raw: DataFrame, m: Mapping, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `raw` as a fact, with `problem`, null where it is one, its place, and the columns of `keep`, within which rows are unique."""
    return _marked(placed(raw), m, keep)


def _marked(raw: DataFrame, m: Mapping, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of facts, `problem` (null where the row is a fact), the row's place and the columns of `keep`."""
    m.check([c for c in raw.columns if c not in (*PLACE, *keep)])
    kinds = {f.name: f.dataType for f in raw.schema}
    if "value" in m.columns and isinstance(kinds[m.columns["value"]], FLOATS):
        raise MappingError("the value column is binary floating point")
    rows = raw.select(*[m.text(n).alias(n) for n in ("entity_id", "entity_name", "concept_namespace", "concept", "value", "unit", "period_type", "period_start", "period_end", "filed_on", "available_on", "form", "accession_number", "source_name", "source_locator", "source_row_key", "lineage", "sequence")], *[F.col(f"`{c}`").cast("string").alias(f"_dim_{a}") for a, c in m.dimensions.items()], *PLACE, *keep)
    number = F.when(F.col("value").rlike(DECIMAL), F.col("value").try_cast("decimal(28,6)"))
    exact = number.isNotNull() & (F.length(F.regexp_extract("value", r"\.([0-9]+?)0*$", 1)) <= 6)
    day = {n: F.when(F.col(n).rlike(DATE) & (F.length(n) == 10), F.col(n).try_cast("date")) for n in ("period_start", "period_end", "filed_on", "available_on")}
    label = F.coalesce(*[F.when(F.col("period_type") == k, F.lit(v)) for k, v in m.period_labels.items()])
    lineage_half = F.col("lineage").isNull() != F.col("sequence").isNull()
    checks = [
        *[(n, ~is_token(F.col(n)), "invalid_text") for n in ("entity_id", "concept_namespace", "concept")],
        ("value", ~F.coalesce(exact, F.lit(False)), "invalid_decimal"),
        ("unit", ~is_token(F.col("unit")), "invalid_text"),
        ("period_type", label.isNull(), "invalid_period_type"),
        ("period_start", F.col("period_start").isNotNull() & day["period_start"].isNull(), "invalid_date"),
        ("period_end", day["period_end"].isNull(), "invalid_date"),
        ("filed_on", day["filed_on"].isNull(), "invalid_date"),
        ("available_on", F.col("available_on").isNotNull() & day["available_on"].isNull(), "invalid_date"),
        ("period_start", (label == "instant") & F.col("period_start").isNotNull() | (label == "duration") & (day["period_start"].isNull() | (day["period_start"] > day["period_end"])), "invalid_period"),
        *[(n, ~is_token(F.col(n)), "invalid_text") for n in ("source_name", "source_locator", "source_row_key")],
        ("sequence", lineage_half | (F.col("sequence").isNotNull() & ~F.col("sequence").rlike(SEQUENCE)), "invalid_revision"),
        *[(f"dimension.{a}", F.col(f"_dim_{a}").isNull(), "missing_dimension") for a in m.dimensions],
    ]
    problem = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(f"normalization.{code}").alias("error_code"), F.lit(name).alias("error_field"))) for name, bad, code in checks])
    key = F.when(F.col("lineage").isNull(), F.col("source_row_key")).otherwise(F.concat(F.substring(F.sha2("lineage", 256), 1, 16), F.lit("#r"), F.col("sequence")))
    dims = F.array_sort(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"_dim_{a}").alias("member")) for a in m.dimensions])) if m.dimensions else F.array().cast(DIMENSIONS)
    typed = {"value": number, "dimensions": dims, "period_type": label, "available_on": F.coalesce(day["available_on"], day["filed_on"])} | {n: day[n] for n in ("period_start", "period_end", "filed_on")}
    # Values are parsed once, before rows are dealt by coordinate.
    marked = rows.select(*[typed.get(f.name, F.col(f.name)).alias(f.name) for f in FACT if f.name != "record_id"], problem.alias("problem"), key.alias("row_key"), *PLACE, *keep)
    coordinate = (*keep, "source_name", "source_locator", "row_key", F.when(F.col("row_key").isNull(), F.struct(*PLACE)))
    # Of the rows of one coordinate the first one read counts. Rows without a key have a problem already; each is its own group.
    # The hash goes first, as it tells almost all apart by one comparison.
    w = Window.partitionBy(F.xxhash64(*coordinate), *coordinate).orderBy(*PLACE)
    marked = marked.withColumn("problem", F.coalesce("problem", F.when(F.col("row_key").isNotNull() & (F.row_number().over(w) > 1), F.struct(F.lit("normalization.duplicate_source_identity").alias("error_code"), F.lit("source_row_key").alias("error_field")))))
    made = {"record_id": stable_id("rec", F.col("source_name"), F.col("source_locator"), F.col("row_key")), "source_row_key": F.when(F.col("problem").isNull(), F.col("row_key")).otherwise(F.col("source_row_key"))}
    origin = {"available_on": {"metadata": {"availability": m.availability()}}}
    return marked.select(*[made.get(f.name, F.col(f.name)).alias(f.name, **origin.get(f.name, {})) for f in FACT], "problem", *PLACE, *keep)


class InvalidDataset(ValueError):
    """At least one row of an input is invalid, so there is no dataset."""


@dataclass(frozen=True)
class Loaded:
    """facts: what is valid. profile: one row of counts. diagnostics: the first ones by place, with the number of the row in its input."""

    facts: DataFrame
    profile: DataFrame
    diagnostics: DataFrame


DIAGNOSTIC = "position long, file string, row_number long, code string, severity string, stage string, field string"


def profiled(raw: DataFrame, m: Mapping, most: int = 100) -> Loaded:
    """Normalizes `raw` in one pass over it, and says what is wrong with it.

    The rows are written once, with what is wrong with each; counts are observed while they are written, and everything else
    reads what was written. profile: mapping_id, row_count, valid_record_count, error_count, warning_count, omitted_diagnostic_count, valid.
    diagnostics: the first `most` by file, part and row, numbered from 0; row_number counts the rows of the file from 1. A table that is not
    read from files counts as one file. Revisions whose history contradicts itself are errors of the stage `revision`, one a lineage
    and contradiction, after those of rows, without a row number. An empty table is valid.
    """
    if most < 1:
        raise ValueError("most must be positive")
    spark, path = raw.sparkSession, None
    marked, seen = marked_rows(raw, m), Observation()
    path = f"{work_folder(spark)}/normalized"
    watched = marked.observe(seen, F.count("*").alias("rows"), F.count("problem").alias("bad"))
    watched.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    facts = rows.filter("problem IS NULL").select(*FACT.names)
    contradictions = lineage_violations(facts)
    wrong = contradictions.count()
    n, bad = seen.get["rows"], seen.get["bad"] + wrong
    # A run of rows that one task read from one part of a file is numbered without gaps: its length places the runs after it.
    run = F.shiftright("_row", 33)
    runs = rows.groupBy("_file", "_block", run.alias("_run")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy("_file").orderBy("_block", "_run")) - F.col("_n")).drop("_n")
    first = rows.filter("problem IS NOT NULL").orderBy(*PLACE).limit(most).withColumn("_run", run).join(before, ["_file", "_block", "_run"])
    shown = first.select(F.struct(*PLACE).alias("at"), F.col("_file").alias("file"), (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("row_number"), F.col("problem.error_code").alias("code"), F.lit("normalization").alias("stage"), F.col("problem.error_field").alias("field"))
    place = F.struct(F.lit(None).cast("string").alias("_file"), F.lit(None).cast("long").alias("_block"), F.lit(None).cast("long").alias("_row"))
    later = contradictions.orderBy("lineage_id", "violation").limit(most).select(place.alias("at"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row_number"), F.lit("revision.ambiguous_history").alias("code"), F.lit("revision").alias("stage"), F.concat_ws(":", "lineage_id", "violation").alias("field"))
    # At most `most` rows of either kind are left, so one order over them is small.
    order = Window.orderBy(F.col("stage"), "at", "field")
    diagnostics = shown.unionByName(later).withColumn("position", (F.row_number().over(order) - 1).cast("long")).filter(F.col("position") < most)
    diagnostics = diagnostics.select("position", "file", "row_number", "code", F.lit("error").alias("severity"), "stage", "field")
    body = [(m.mapping_id(), n, n - seen.get["bad"], bad, 0, max(0, bad - most), bad == 0)]
    profile = spark.createDataFrame(body, "mapping_id string, row_count long, valid_record_count long, error_count long, warning_count long, omitted_diagnostic_count long, valid boolean")
    return Loaded(facts, profile, diagnostics)


def load(raw: DataFrame, m: Mapping, most: int = 100) -> DataFrame:
    """Facts, or InvalidDataset with the number of errors and the first `most` of them. The input is read once."""
    out = profiled(raw, m, most)
    p = out.profile.first()
    if not p.valid:
        first = [(r.row_number, r.code, r.field) for r in out.diagnostics.orderBy("position").collect()]
        raise InvalidDataset(f"{p.error_count} rows are invalid; omitted: {p.omitted_diagnostic_count}; first: {first}")
    return out.facts


def read_csv(spark: SparkSession, path: str, header: list[str], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """All columns as text, nothing inferred; the header must agree and a ragged row fails."""
    if len(set(header)) < len(header) or not all(header):
        raise MappingError("header names must be given and unique")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, sep=delimiter, quote=quote, escape=quote, multiLine=True, emptyValue="").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in header])


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, physical, logical) of every column of every file below `path`, from the footers, on executors.

    Files that pyarrow reaches are opened there and only their footers are read; of other stores Spark hands over the files.
    A file that is no Parquet file has one row with the column null and what is wrong as `physical`.
    """
    kinds = "file string, column string, physical string, logical string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    near = arrow_source.reachable(path)

    def footers(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for i, name in enumerate(batch.column("path").to_pylist()):
                try:
                    if near:
                        store, at = arrow_source.opened(unquote(name))
                        meta = pq.ParquetFile(at, filesystem=store).metadata
                    else:
                        meta = pq.ParquetFile(pa.BufferReader(batch.column("content")[i].as_buffer())).metadata
                    leaves = [meta.schema.column(j) for j in range(meta.num_columns)]
                    out += [(name, c.path, c.physical_type, str(c.logical_type)) for c in leaves]
                except (pa.ArrowInvalid, OSError) as e:
                    out.append((name, None, type(e).__name__, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=["file", "column", "physical", "logical"])

    # Without `content` Spark lists the files and reads none of them.
    return files.select("path", *([] if near else ["content"])).repartition(spark.sparkContext.defaultParallelism).mapInArrow(footers, kinds)


def footer_problems(footers: DataFrame, columns: list[str], decimals: tuple[str, ...] = ("value",)) -> DataFrame:
    """(file, column, problem) of the files that must not be read: `unreadable`, `missing`, `floating`, or `differs` from most files.

    Columns of `decimals` must not be binary floating point. A column whose type is not that of most files differs; of equally
    many the smaller name is taken as right.
    """
    own = footers.filter(F.col("column").isNotNull() & F.col("column").isin(*columns)).withColumn("kind", F.concat_ws(" ", "physical", "logical"))
    usual = own.groupBy("column", "kind").agg(F.count("*").alias("n")).groupBy("column").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("usual"))
    files = footers.groupBy("file").agg(F.collect_set("column").alias("there"), F.max(F.col("column").isNull()).alias("broken"))
    absent = files.filter("NOT broken").select("file", F.explode(F.array_except(F.array(*map(F.lit, columns)), "there")).alias("column"), F.lit("missing").alias("problem"))
    broken = files.filter("broken").select("file", F.lit(None).cast("string").alias("column"), F.lit("unreadable").alias("problem"))
    floating = F.col("column").isin(*decimals) & F.col("physical").isin("FLOAT", "DOUBLE")
    typed = own.join(F.broadcast(usual), "column").select("file", "column", F.when(floating, "floating").when(F.col("kind") != F.col("usual"), "differs").alias("problem")).filter("problem IS NOT NULL")
    return broken.unionByName(absent).unionByName(typed)


def read_parquet(spark: SparkSession, path: str, columns: list[str], decimals: tuple[str, ...] = ("value",)) -> DataFrame:
    """The columns of all files below `path`, once all footers agree; InvalidDataset names a file that does not, before any data is read."""
    if (bad := footer_problems(parquet_footers(spark, path), columns, decimals).orderBy("file", "column").first()) is not None:
        raise InvalidDataset(f"{bad.file}: {bad.column or 'file'} {bad.problem}")
    return spark.read.option("recursiveFileLookup", True).parquet(path).select(*[F.col(f"`{c}`") for c in columns])


def read_arrow(spark: SparkSession, path: str, stream: bool = False, task_bytes: int = arrow_source.TASK_BYTES) -> DataFrame:
    """An Arrow IPC file, by runs of record batches, or a stream, which has no footer and is decoded in one task.

    A file in a store that pyarrow does not reach is handed over by Spark, in one task too.
    """
    if not stream and arrow_source.reachable(path):
        return arrow_source.load(spark, path, task_bytes)
    files = spark.read.format("binaryFile").load(path)
    from pyspark.sql.pandas.types import from_arrow_schema

    def reader(content: pa.Scalar):
        return (pa.ipc.open_stream if stream else pa.ipc.open_file)(pa.BufferReader(content.as_buffer()))

    def schemas(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader(c).schema.serialize().to_pybytes() for c in batch.column("content")], pa.binary())], names=["schema"])

    # Only the serialized schema of one file comes to the driver.
    first = files.limit(1).select("content").mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise InvalidDataset("no Arrow file")

    def decode(batches):
        for batch in batches:
            for content in batch.column("content"):
                opened = reader(content)
                if stream:
                    yield from opened
                else:
                    yield from (opened.get_batch(i) for i in range(opened.num_record_batches))

    return files.select("content").mapInArrow(decode, from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(first.schema)))))


def read_rows(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    for i, r in enumerate(rows):
        if not isinstance(r, dict) or set(r) != set(columns):
            raise MappingError(f"row {i} does not have the declared columns")
    return spark.createDataFrame([tuple(None if r[c] is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def pinned(spark: SparkSession, path: str, sha256: str, size: int | None = None) -> str:
    """`path`, if its one file has that hash and size; hashed by an executor piece by piece, so a file of any size will do."""
    rows = artifacts.file_hashes(spark, path).collect()
    if len(rows) != 1 or rows[0].sha256 != sha256 or (size is not None and rows[0].size != size):
        raise InvalidDataset("the file is not the pinned one")
    return path
