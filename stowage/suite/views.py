"""Catalog views over the test tables: the inputs of the registered queries.

Every view covers its whole table. The same definitions in DuckDB SQL are in
``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

LINE_ORDER = (
    "archive", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
)
DOC_ORDER = ("archive", "entry_ix")
EXPORT_PREFIX = "export"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _pick(selector: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (selector + 1).cast("int"))


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive members with content; one archive per source and language."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    base = (
        F.when(doc % 5 == 0, F.concat(F.lit("copy_"), doc.cast("string")))
        .when(doc % 5 == 1, F.concat(F.lit("alt_"), chars.cast("string")))
        .when(doc % 5 == 2, F.concat(F.lit("scan_of_a_rather_long_document_title_number_"), chars.cast("string")))
        .otherwise(F.concat(F.lit("doc_"), chars.cast("string")))
    )
    name = F.concat(
        base,
        _pick(doc % 3, ["", "(1)", "(2)"]),
        _pick(chars % 6, [".jpg", ".mp4", ".mp3", ".pdf", ".json", ".bin"]),
    )
    day = F.date_add(F.lit("2015-01-01").cast("date"), (doc % 3650).cast("int"))
    source_no = F.substring("source", 4, 9).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), "lang", F.lit(".zip")).alias("archive"),
        F.date_add(F.lit("2024-01-01").cast("date"), source_no).cast("timestamp_ntz").alias("archive_mtime"),
        doc.alias("entry_ix"),
        F.concat(F.lit("Data/"), "lang", F.lit("/"), name).alias("file_path"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        F.when(doc % 11 == 0, F.lit(1980)).otherwise(F.year(day)).alias("zip_y"),
        F.month(day).alias("zip_mo"),
        F.day(day).alias("zip_d"),
        (doc % 24).cast("int").alias("zip_h"),
        (chars % 60).cast("int").alias("zip_mi"),
        F.lit(0).alias("zip_s"),
        doc.alias("file_crc"),
        F.sha2("text", 256).alias("content_hash"),
        F.concat(F.octet_length("text").cast("string"), F.lit("_"), F.sha2("text", 256)).alias("content_key"),
        F.col("text").cast("binary").alias("content"),
        "lang",
    )


def doc_entries_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document members plus a renamed copy of every Spanish archive, downloaded later."""
    docs = doc_entries(spark, sf_dir)
    copies = docs.filter(F.col("lang") == "es").withColumn(
        "archive", F.concat(F.lit("zz_copy_"), "archive")
    ).withColumn("archive_mtime", F.col("archive_mtime") + F.expr("INTERVAL '100' DAY"))
    return docs.unionByName(copies)


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as archive members: the large metadata-only catalog."""
    part, quantity = F.col("l_partkey"), F.col("l_quantity").cast("bigint")
    marker = F.when(
        F.col("l_linenumber") > 1, F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")"))
    ).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lit(EXPORT_PREFIX + "-"), F.date_format("l_shipdate", "yyyyMM"), F.lit("01T000000Z-"),
            F.lpad((F.col("l_suppkey") % 10).cast("string"), 3, "0"), F.lit(".zip"),
        ).alias("archive"),
        F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz").alias("archive_mtime"),
        F.concat(
            F.lit("Photos/"), "l_returnflag", F.lit("/IMG_"), part.cast("string"), marker,
            _pick(part % 6, [".jpg", ".mp4", ".mp3", ".pdf", ".json", ".bin"]),
        ).alias("file_path"),
        (quantity * 1000 + part % 997).alias("file_size"),
        (part * 100 + quantity).alias("file_crc"),
        F.col("l_shipdate").alias("file_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing directory: every English document and every labelled one."""
    docs = doc_entries(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_ix")).distinct()
    marked = docs.join(labelled.withColumn("labelled", F.lit(True)), "entry_ix", "left")
    return marked.filter((F.col("lang") == "en") | F.col("labelled")).select(
        F.lit("library").alias("root"),
        F.concat("lang", F.lit("/"), F.col("entry_ix").cast("string"), F.lit("_"),
                 F.substring_index("file_path", "/", -1)).alias("file_path"),
        "file_size",
        F.make_timestamp_ntz(F.lit(2023), F.lit(6), F.lit(1), F.col("zip_h"), F.col("zip_mi"), F.lit(0)).alias("mtime"),
        "content_hash",
        "content_key",
        "content",
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as paths."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_path"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON sidecars, of documents where the ids meet; some are broken."""
    docs = doc_entries(spark, sf_dir).select("archive", "entry_ix", "file_path")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("entry_ix"), "ts", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    name = F.substring_index("file_path", "/", -1)
    stem = F.regexp_extract("file_path", r"^(.*)\.[^.]+$", 1)
    text = F.when(F.col("k") % 7 == 0, F.lit('{"photoTakenTime": {"timestamp": "soon"}}')).otherwise(
        F.concat(
            F.lit('{"photoTakenTime": {"timestamp": "'),
            F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string"),
            F.lit('"}}'),
        )
    )
    path = (
        F.when(F.col("file_path").isNull(), F.concat(F.lit("Data/event_"), F.col("entry_ix").cast("string"), F.lit(".json")))
        .when(F.col("k") % 3 == 0, F.concat("file_path", F.lit(".json")))
        .when(F.col("k") % 3 == 1, F.concat(stem, F.lit(".json")))
        .otherwise(F.concat(F.lit("Other/"), F.left(name, F.lit(46)), F.lit(".json")))
    )
    return events.join(docs, "entry_ix", "left").select(
        F.coalesce("archive", F.lit("events.zip")).alias("archive"), path.alias("json_path"), text.alias("json_text")
    )


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose ids meet no document, as images of an archive of their own."""
    docs = doc_entries(spark, sf_dir).select("entry_ix")
    return table(spark, sf_dir, "orders").withColumn("entry_ix", F.col("o_orderkey")).join(docs, "entry_ix", "left_anti").select(
        F.lit("orders.zip").alias("archive"), "entry_ix",
        F.concat(F.lit("order_"), F.col("entry_ix").cast("string"), F.lit(".jpg")).alias("file_path"),
        F.lit(1).cast("bigint").alias("file_size"),
    )


def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as image tags: of the documents whose ids meet, else of the members of ``orders.zip``."""
    docs = doc_entries(spark, sf_dir).select("archive", "entry_ix", "file_path")
    stamp = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_ix"),
        F.when(F.col("o_orderstatus") == "O", stamp).when(F.col("o_orderstatus") == "F", F.lit("unknown")).alias("dto"),
        stamp.alias("dt"),
    )
    own = F.concat(F.lit("order_"), F.col("entry_ix").cast("string"), F.lit(".jpg"))
    return orders.join(docs, "entry_ix", "left").select(
        F.coalesce("archive", F.lit("orders.zip")).alias("archive"), F.coalesce("file_path", own).alias("file_path"), "dto", "dt"
    )


def date_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached dates of the labelled documents; entries of toxic ones are stale (old size)."""
    docs = doc_entries(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_ix"), "quality", "toxic")
    return docs.join(labels, "entry_ix").select(
        "archive",
        "file_path",
        (F.col("file_size") + F.col("toxic")).alias("file_size"),
        F.col("entry_ix").alias("file_crc"),
        F.when(F.col("quality") == 1, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("entry_ix") % 3650).cast("int")).cast("timestamp_ntz")).alias("extracted_date"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("created_at"),
    )


def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached keys of the labelled library files: some on time, some late, some of another size."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    doc_id = F.regexp_extract("file_path", r"/(\d+)_", 1).cast("bigint")
    joined = library_files(spark, sf_dir).withColumn("doc_id", doc_id).join(labels, "doc_id")
    late = F.when(F.col("quality") == 1, F.expr("INTERVAL '0.5' SECOND")).otherwise(F.expr("INTERVAL '1.5' SECOND"))
    return joined.select(
        "root", "file_path", (F.col("file_size") + F.col("toxic")).alias("file_size"),
        (F.col("mtime") + late).alias("mtime"), F.concat(F.lit("cached_"), "content_key").alias("content_key"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("created_at"),
    )


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last scans of the library's language folders, as if all documents had been there."""
    docs = doc_entries(spark, sf_dir)
    return docs.groupBy(F.col("lang").alias("root")).agg(
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_scanned"), F.count("*").alias("file_count")
    )


def kept_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that still exist: those with a document labelled as good."""
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("entry_ix"))
    return doc_entries(spark, sf_dir).join(good, "entry_ix", "left_semi").select("archive").distinct()


def occupied_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations already on disk: one per order, named after its customer."""
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("out/"), F.date_format("o_orderdate", "yyyy/MM/"), F.lit("IMG_"),
            F.col("o_custkey").cast("string"), F.lit("x1.jpg"),
        ).alias("destination")
    ).distinct()
