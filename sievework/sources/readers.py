"""Readers: corpora, catalogues, dictionaries, packed vectors, legacy catalogues, step libraries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed

SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField(
            "procedures",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()), T.StructField("shortName", T.StringType()), T.StructField("modality", T.StringType()),
                        T.StructField("rating", T.IntegerType()), T.StructField("ratingLevel", T.StringType()),
                        T.StructField("usesContrast", T.IntegerType()), T.StructField("radiationDose", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
ENVELOPE_SCHEMA = T.StructType(
    [T.StructField("region", T.StringType()), T.StructField("scenarios", T.ArrayType(SCENARIO_SCHEMA)), T.StructField("count", T.IntegerType())]
)
CATALOGUE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "display_name", "body_region", "body_part", "section", "indications", "canonical_procedure", "source")]
    + [T.StructField("uses_contrast", T.StringType()), T.StructField("is_pediatric", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("keywords", "sections", "scanner_notes")]
    + [
        T.StructField(
            "sequences",
            T.ArrayType(
                T.StructType(
                    [T.StructField("sequence_name", T.StringType()), T.StructField("is_post_contrast", T.StringType()), T.StructField("sort_order", T.IntegerType())]
                )
            ),
        ),
        T.StructField(
            "scenario_matches",
            T.ArrayType(
                T.StructType(
                    [T.StructField("scenario_id", T.StringType()), T.StructField("scenario_name", T.StringType()), T.StructField("relevance_score", T.DoubleType())]
                )
            ),
        ),
    ]
)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """JSON of a schema; a missing path reads as no rows of the same shape."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as e:
        if e.getCondition() and "PATH_NOT_FOUND" in e.getCondition():
            return spark.createDataFrame([], schema)
        raise


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(region, id, name, description, procedures) of region files; the region is the file's stem."""
    try:
        files = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path).withColumn(
            "region", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
        )
    except AnalysisException as e:
        if not (e.getCondition() and "PATH_NOT_FOUND" in e.getCondition()):
            raise
        files = spark.createDataFrame([], ENVELOPE_SCHEMA)
    return files.select("region", F.explode("scenarios").alias("s")).select("region", "s.*")


def load_procedures(corpus: DataFrame) -> DataFrame:
    """Child table (region, scenario_id, pos, ...) of a corpus."""
    return corpus.select("region", F.col("id").alias("scenario_id"), F.posexplode("procedures").alias("pos", "p")).select(
        "region", "scenario_id", "pos", "p.*"
    )


def _flag(col: str) -> Column:
    return F.lower(col).isin("1", "true")


def load_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, steps, matches); 0/1 and true/false flags become booleans, ``seq`` keeps file order of a
    single array file."""
    raw = read_or_empty(spark, path, CATALOGUE_SCHEMA, multiLine=True).withColumn("seq", F.monotonically_increasing_id())
    entries = raw.drop("sequences", "scenario_matches").withColumns(
        {"uses_contrast": F.coalesce(_flag("uses_contrast"), F.lit(False)), "is_pediatric": F.coalesce(_flag("is_pediatric"), F.lit(False))}
    )
    steps = raw.select("name", F.explode("sequences").alias("s")).select(
        "name", "s.sequence_name", _flag("s.is_post_contrast").alias("is_post_contrast"), "s.sort_order"
    )
    matches = raw.select("name", F.posexplode("scenario_matches").alias("pos", "m")).select("name", "pos", "m.*")
    return entries, steps, matches


def load_dictionary(spark: SparkSession, path: str, inner: str | None = None) -> DataFrame:
    """(term, pos, synonym) of JSON objects whose keys are data, one object per file. ``inner`` names the
    field that holds the map."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,array<string>>"
    if inner:
        mapped = F.from_json("value", f"struct<`{inner}`:{kind}>")[inner]
    else:
        mapped = F.from_json("value", kind)
    return text.select(F.explode(mapped).alias("term", "list")).select("term", F.posexplode("list").alias("pos", "synonym"))


def load_vectors(spark: SparkSession, blob: str, sidecar: str | None = None) -> DataFrame:
    """(id, vector) of a packed half-precision matrix and its id list, or of a folder of such pairs."""
    packed.register(spark)
    reader = spark.read.format(packed.FORMAT)
    return (reader.option("sidecar", sidecar) if sidecar else reader).load(blob)


STEP = "array<struct<type:string,planes:array<string>,contrast:string,note:string>>"


def load_legacy(spark: SparkSession, flat_path: str, nested_path: str) -> DataFrame:
    """One table (category, study, scanner, seq_type, plane, contrast, note) from both catalogue layouts."""
    flat = spark.read.schema(f"category string, protocols array<struct<study:string,scanner:array<string>,sequences:{STEP}>>").option(
        "multiLine", True
    ).json(flat_path)
    nested = spark.read.schema(
        f"protocols array<struct<section:array<string>,studies:array<struct<study:string,layout:struct<leftCard:struct<sequences:{STEP}>>>>>>"
    ).option("multiLine", True).json(nested_path)
    a = flat.select("category", F.explode("protocols").alias("p")).select(
        "category", "p.study", F.array_join("p.scanner", ", ").alias("scanner"), F.explode_outer("p.sequences").alias("s")
    )
    b = nested.select(F.explode("protocols").alias("p")).select(F.array_join("p.section", ", ").alias("category"), F.explode("p.studies").alias("t")).select(
        "category", "t.study", F.lit(None).cast("string").alias("scanner"), F.explode_outer("t.layout.leftCard.sequences").alias("s")
    )
    return a.unionByName(b).select(
        "category", "study", "scanner", F.col("s.type").alias("seq_type"), F.explode_outer("s.planes").alias("plane"), "s.contrast", "s.note"
    )


def load_step_library(spark: SparkSession, path: str) -> DataFrame:
    """Step types of a library file, one row each with planes, regions and purpose."""
    schema = (
        "sequence_types array<struct<id:string,name:string,display_name:string,category:string,pulse_sequence:string,is_post_contrast:boolean,"
        "time_seconds:int,time_range:array<int>,planes:array<string>,regions:array<string>,rationale:struct<purpose:string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.posexplode("sequence_types").alias("seq", "t")).select("seq", "t.*").withColumn("purpose", F.col("rationale.purpose")).drop("rationale")
