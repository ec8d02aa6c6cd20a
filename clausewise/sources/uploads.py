"""Uploaded files: validation, fingerprint, duplicates, storage key, routing to text or to recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.maths import lookup
from clausewise.sources.reference_data import MAX_PAGES, MAX_UPLOAD_MIB, MIME_TYPES, MIN_TEXT_CHARS, WEBP_MARKER

MIME_BY_SUFFIX = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as uploads: ``upload_id (path), mime (by suffix), content, size``.

    The file source passes over files of length 0; empty uploads show up in the base64 or table intake only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.select(
        F.col("path").alias("upload_id"),
        F.coalesce(lookup(suffix, MIME_BY_SUFFIX), F.lit("application/octet-stream")).alias("mime"),
        "content",
        F.col("length").alias("size"),
    )


def decode_base64(uploads: DataFrame, column: str = "file_content") -> DataFrame:
    """Add ``content`` and ``size`` from a base64 column; undecodable input gives null content."""
    content = F.try_to_binary(F.col(column), F.lit("base64"))
    return uploads.withColumn("content", content).withColumn("size", F.octet_length("content").cast("bigint"))


def rejection_code(mime: Column, content: Column, size: Column) -> Column:
    """The first failing rule of an upload, null if it is fine; only header bytes are looked at."""
    magic = lookup(mime, {m: head for m, (head, _) in MIME_TYPES.items()})
    header = F.hex(F.substring(content, 1, 4))
    mismatch = ~F.startswith(header, magic)
    marker = F.hex(F.substring(content, 9, 4))
    return (
        F.when(magic.isNull(), "INVALID_MIME_TYPE")
        .when(content.isNull(), "INVALID_BASE64")
        .when(size == 0, "EMPTY_FILE")
        .when(size > MAX_UPLOAD_MIB * 1024 * 1024, "FILE_TOO_LARGE")
        .when(mismatch, "MAGIC_BYTES_MISMATCH")
        .when((mime == "image/webp") & (marker != WEBP_MARKER), "MAGIC_BYTES_MISMATCH")
    )


def rejection_message(code: Column, mime: Column, size: Column) -> Column:
    allowed = ", ".join(MIME_TYPES)
    mib = F.format_string("%.2f", size / F.lit(1024.0 * 1024.0))
    return (
        F.when(code == "INVALID_MIME_TYPE", F.concat(F.lit("MIME type '"), mime, F.lit(f"' is not supported. Allowed types: {allowed}.")))
        .when(code == "INVALID_BASE64", "File content could not be decoded from base64.")
        .when(code == "EMPTY_FILE", "File is empty.")
        .when(code == "FILE_TOO_LARGE", F.concat(F.lit("File size "), mib, F.lit(f" MB exceeds the maximum allowed size of {MAX_UPLOAD_MIB} MB.")))
        .when(code == "MAGIC_BYTES_MISMATCH", F.concat(F.lit("File content does not match the declared MIME type '"), mime, F.lit("'.")))
    )


def validate(uploads: DataFrame) -> DataFrame:
    """Add ``valid``, ``code`` and ``message`` to ``uploads(upload_id, mime, content, size)``."""
    checked = uploads.withColumn("code", rejection_code(F.col("mime"), F.col("content"), F.col("size")))
    return checked.withColumns(
        {"valid": F.col("code").isNull(), "message": rejection_message(F.col("code"), F.col("mime"), F.col("size"))}
    )


def accepted(checked: DataFrame) -> DataFrame:
    """Valid uploads with fingerprint and storage key."""
    return checked.filter("valid").select(
        "upload_id", "mime", "content", "size", fingerprint(F.col("content")).alias("hash"), storage_key(F.col("upload_id"), F.col("mime")).alias("key")
    )


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("not valid").select("upload_id", "mime", "code", "message")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicates(docs: DataFrame, content: str, key: str) -> DataFrame:
    """Fingerprints that occur more than once, with the first key and the number of surplus copies.

    Only the fingerprint is shuffled, pre-aggregated per task, so many copies of one file do not pile up.
    """
    return (
        docs.select(fingerprint(F.col(content)).alias("hash"), key)
        .groupBy("hash")
        .agg(F.min(key).alias("first_key"), (F.count("*") - 1).alias("surplus"))
        .filter("surplus > 0")
    )


def storage_key(audit_id: Column, mime: Column, prefix: str = "documents") -> Column:
    extension = lookup(mime, {m: e for m, (_, e) in MIME_TYPES.items()}, F.lit("bin"))
    name = audit_id.cast("string")
    return F.concat(F.lit(prefix + "/"), name, F.lit("/"), name, F.lit("."), extension)


def route(documents: DataFrame, page_texts: DataFrame | None = None) -> DataFrame:
    """Where a document goes: ``text`` for a PDF with enough text, else ``ocr``.

    ``documents(audit_id, mime[, n_chars, n_pages])``; the counts come from ``page_texts`` when that is given.
    ``low_yield`` marks PDFs sent on for too little text, ``too_long`` those above the page limit.
    """
    if page_texts is not None:
        counts = page_texts.groupBy("audit_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_pages"))
        documents = documents.drop("n_chars", "n_pages").join(counts, "audit_id", "left").fillna(0, ["n_chars", "n_pages"])
    is_pdf = F.col("mime") == "application/pdf"
    enough = F.col("n_chars") >= MIN_TEXT_CHARS
    return documents.withColumns(
        {
            "route": F.when(is_pdf & enough, "text").otherwise("ocr"),
            "low_yield": is_pdf & ~enough,
            "too_long": F.col("n_pages") > MAX_PAGES,
        }
    )


def low_yield_warnings(routed: DataFrame) -> DataFrame:
    return routed.filter("low_yield").select(
        "audit_id",
        F.lit("STRUCTURED_EXTRACTION_LOW_YIELD").alias("code"),
        F.concat(F.lit("PDF text extraction yielded only "), F.col("n_chars").cast("string"), F.lit(" characters.")).alias("message"),
        F.lit(True).alias("recoverable"),
        F.lit("UPLOADING").alias("stage"),
    )
