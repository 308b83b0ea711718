"""The test tables in the roles of the imaging entities.

A line item is a slice, its order the series, the customer the study; a part's brand is the vendor; documents with labels are the
labelled studies; an embedding is a pixel array or a window's label scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RAW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]


def _roles(li: DataFrame) -> DataFrame:
    """Line items as slices; columns of theirs that have no role stay."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(
        "series_uid",
        F.concat_ws("/", "series_uid", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "l_partkey", "l_suppkey", cents).alias("relative_path"),
        F.datediff("l_shipdate", F.lit("1970-01-01")).cast("double").alias("position_scalar"),
        F.col("l_linenumber").cast("double").alias("instance_number"),
        F.when(F.col("l_returnflag") == "R", "Sagittal").when(F.col("l_returnflag") == "A", "Coronal").otherwise("Axial").alias("derived_plane"),
        cents.alias("size_bytes"),
        F.when(F.col("l_linestatus") == "O", "ok").otherwise("error").alias("status"),
        F.col("l_quantity").cast("long").alias("rows"),
        F.round(F.col("l_discount") * 100).cast("long").alias("columns"),
        "l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", *(c for c in li.columns if c not in _RAW and c != "series_uid"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices without series or vendor tables: what needs no join."""
    return _roles(table(spark, sf_dir, "lineitem").select(*_RAW).withColumn("series_uid", F.col("l_orderkey").cast("string")))


LINES = """SELECT l_orderkey::VARCHAR AS series_uid,
    concat_ws('/', l_orderkey, lpad(l_linenumber::VARCHAR, 3, '0'), l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS relative_path,
    date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS position_scalar, l_linenumber::DOUBLE AS instance_number,
    CASE l_returnflag WHEN 'R' THEN 'Sagittal' WHEN 'A' THEN 'Coronal' ELSE 'Axial' END AS derived_plane,
    round(l_extendedprice * 100)::BIGINT AS size_bytes, CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'error' END AS status,
    l_quantity::BIGINT AS rows_, round(l_discount * 100)::BIGINT AS columns_, l_partkey, l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax
    FROM lineitem"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with study, vendor and patient.

    The joins take the columns as they are, and what is made of them is made after both.  The last one deals by series, as what is grouped by series or by study and
    series then needs no other dealing.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("series_uid"), F.col("o_custkey").cast("string").alias("study_uid"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("manufacturer"))
    li = table(spark, sf_dir, "lineitem").select(*_RAW).join(parts, "l_partkey").withColumn("series_uid", F.col("l_orderkey").cast("string")).join(orders, "series_uid")
    return _roles(li).withColumn("patient_hash", F.md5(F.col("study_uid").cast("binary")))


SLICES = f"""SELECT s.*, o_custkey::VARCHAR AS study_uid, p_brand AS manufacturer, md5(o_custkey::VARCHAR) AS patient_hash
    FROM ({LINES}) s JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""


def series_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated plane (some missing) and fluid sensitivity of each series."""
    o = table(spark, sf_dir, "orders")
    plane = F.when(F.col("o_orderstatus") == "O", "Sagittal").when(F.col("o_orderstatus") == "F", "Coronal")
    return o.select(F.col("o_orderkey").cast("string").alias("series_uid"), plane.alias("metadata_plane"), F.substring("o_orderpriority", 1, 1).cast("int").alias("fluid_sensitive"))


SERIES_METADATA = """SELECT o_orderkey::VARCHAR AS series_uid, CASE o_orderstatus WHEN 'O' THEN 'Sagittal' WHEN 'F' THEN 'Coronal' END AS metadata_plane,
    substr(o_orderpriority, 1, 1)::INT AS fluid_sensitive FROM orders"""


def labelled(spark: SparkSession, sf_dir: str, shuffle: bool = False) -> DataFrame:
    """Studies (documents) with two labels, NULL where nobody labelled them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(shuffled(labels) if shuffle else labels, "doc_id", "left").withColumn("study_uid", F.col("doc_id").cast("string"))


LABELLED = "SELECT d.doc_id, lang, source, n_chars, quality, toxic, d.doc_id::VARCHAR AS study_uid FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
LABEL_NAMES = ["quality", "toxic"]


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies on disk: documents of 14 in 20 sources, and some that the table doesn't know."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.substring("source", 4, 2).cast("int") < 14).select(F.col("doc_id").cast("string").alias("study_uid"))
    strange = table(spark, sf_dir, "conversations").select(F.concat(F.lit("x"), F.col("conv_id")).alias("study_uid"))
    return known.unionByName(strange)


ON_DISK = "SELECT doc_id::VARCHAR AS study_uid FROM documents WHERE substr(source, 4, 2)::INT < 14 UNION ALL SELECT 'x' || conv_id FROM conversations"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows (embeddings) of studies (their labels): twelve scores and all features."""
    e = table(spark, sf_dir, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("label").alias("study"), F.col("vec_id").alias("window"), F.slice(wide, 1, 12).alias("scores"), wide.alias("features"))


WINDOWS = "SELECT label AS study, vec_id AS \"window\", embedding[1:12]::DOUBLE[] AS scores, embedding::DOUBLE[] AS features FROM embeddings"
