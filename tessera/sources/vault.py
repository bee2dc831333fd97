"""Sources: vaults of notes, captured files, import manifests, event journals; their bounded and paged reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars, text

#: Caps of an import manifest.
MOST_ITEMS, MOST_LINE = 200_000, 64 * 1024

MANIFEST = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("original_hash", T.StringType()),
        T.StructField("byte_len", T.LongType()),
        T.StructField("items", T.LongType()),
        T.StructField("body_hash", T.StringType()),
    ]
)
JOURNAL = "run_id string, sequence long, event_type string, occurred_at timestamp, request_id string, checksum string, payload string"


def notes(spark: SparkSession, root: str, most_files: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, bytes, text, hash, modified) of the Markdown files below root; refuses more files or bytes than asked for.

    The listing is checked on lengths alone: contents are read by tasks, later.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    if most_files is not None or most_bytes is not None:
        n, size = files.select("length").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if (most_files is not None and n > most_files) or (most_bytes is not None and size > most_bytes):
            raise ValueError(f"{n} files of {size} bytes are more than the budget")
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(base, F.length(F.lit(_bare(root))) + 2, 4096)
    return files.select(rel.alias("path"), F.col("length").alias("bytes"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))


def _bare(root: str) -> str:
    import re

    return "/" + re.sub("^[a-z]+:/*", "", root).strip("/")


def captured_files(spark: SparkSession, root: str, include: str = "*.{md,txt}", exclude: str = r"(^|/)\.") -> DataFrame:
    """(path, bytes): local files by a glob, without hidden ones, whose order by path is that of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(base, F.length(F.lit(_bare(root))) + 2, 4096)
    return files.select(rel.alias("path"), F.col("content").alias("bytes")).filter(~F.col("path").rlike(exclude))


def parsed(notes_: DataFrame) -> DataFrame:
    """(path, state, fields, body_start, error): the envelope of each note; one that is invalid stays readable."""
    out = text.mapped(notes_, text.parse_note, ("text",), "state string, pairs array<struct<k:string,v:string>>, body_start long, error string", ("path",))
    return out.select("path", "state", F.col("pairs").alias("fields"), "body_start", "error")


def transient(notes_: DataFrame) -> dict[str, DataFrame]:
    """The catalog's tables of notes that aren't published: documents, links and headings, for one command. Nothing is written; a table that isn't asked for isn't computed."""
    envelope = parsed(notes_)
    fields = F.map_from_entries(F.transform("fields", lambda p: F.struct(p["k"], p["v"])))
    known = envelope.select("path", "state", "error", "body_start", fields.alias("f"))
    rows = notes_.join(known, "path")
    documents = rows.select(
        "path", "hash", F.col("f")["id"].alias("record_id"), F.col("f")["kind"].alias("kind"), F.coalesce(F.col("f")["title"], F.regexp_extract("text", r"(?m)^#{1,6} +(.*?) *#* *$", 1)).alias("title"), "state", "error",
        F.when(F.col("state") == "invalid", "invalid").otherwise("current").alias("eligibility"), F.expr("substring(encode(text, 'UTF-8'), cast(body_start as int) + 1)").cast("string").alias("body"),
    )
    found = text.mapped(notes_, text.links, ("text",), "byte_start long, target string, label string", ("path",)).withColumnRenamed("path", "from_path")
    headings = text.mapped(notes_, _headings, ("text",), "byte_start long, headings array<string>", ("path",))
    return {"documents": documents, "links": found, "headings": headings}


def _headings(t: str | None) -> list[tuple[int, list[str]]]:
    return list(zip(*text.heading_chains((t or "").encode()), strict=True))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines manifest with an explicit schema; a line that is no JSON has nulls."""
    return spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").json(path)


def manifest_errors(rows: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(error, n) of a manifest: header and footer once each, ordinals 0 to items - 1 without repeats, as many items as the footer says, no more than `most`, paths portable."""
    item = F.col("type") == "item"
    sums = rows.agg(
        F.count_if(F.col("type") == "header").alias("headers"), F.count_if(F.col("type") == "footer").alias("footers"), F.count_if(item).alias("n"), F.max(F.when(F.col("type") == "footer", F.col("items"))).alias("said"),
        F.countDistinct(F.when(item, F.col("ordinal"))).alias("ordinals"), F.min(F.when(item, F.col("ordinal"))).alias("lo"), F.max(F.when(item, F.col("ordinal"))).alias("hi"), F.count_if(item & ~F.coalesce(scalars.is_vault_path(F.col("path")), F.lit(False))).alias("bad"), F.count_if(F.col("type").isNull()).alias("broken"),
    )
    checks = {"header": F.col("headers") != 1, "footer": F.col("footers") != 1, "items": ~F.col("n").eqNullSafe(F.col("said")), "ordinals": (F.col("ordinals") != F.col("n")) | (F.coalesce("lo", F.lit(0)) != 0) | (F.coalesce("hi", F.lit(-1)) != F.col("n") - 1), "too many": F.col("n") > most, "path": F.col("bad") > 0, "line": F.col("broken") > 0}
    return sums.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())).alias("error"))


def manifest_page(rows: DataFrame, after: int, most: int) -> DataFrame:
    """Items after an ordinal: a resumable batch, by a range filter that reaches the scan."""
    return rows.filter((F.col("type") == "item") & (F.col("ordinal") > after) & (F.col("ordinal") <= after + most))


def body_hash(rows: DataFrame, page: int = 4096) -> DataFrame:
    """One row: a digest of the items in their order: of each page of ordinals a digest of its items' digests, of all pages one of theirs."""
    d = F.sha2(F.concat_ws("\0", F.col("ordinal").cast("string"), "path", "original_hash"), 256)
    items = rows.filter("type = 'item'").select("ordinal", F.floor(F.col("ordinal") / page).alias("page"), d.alias("d"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), "")
    pages = items.groupBy("page").agg(F.sha2(joined(F.struct("ordinal", "d")), 256).alias("d"))
    return pages.agg(F.sha2(joined(F.struct("page", "d")), 256).alias("body_hash"))


def journal(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frames of an append-only journal of JSON lines; stream for a streaming read of the same folder."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(JOURNAL).json(path)


def journal_errors(frames: DataFrame) -> DataFrame:
    """(run_id, sequence, reason): checksums that don't hold, and gaps; a torn last frame of a run is tolerated."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id").orderBy("sequence")
    ok = F.sha2(F.col("payload"), 256) == F.col("checksum")
    rows = frames.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("before", F.lag("sequence").over(w)).withColumn("last", F.lead("sequence").over(w).isNull())
    reason = F.when(~F.col("ok") & ~F.col("last"), "checksum").when(F.col("sequence") != F.coalesce(F.col("before") + 1, F.lit(1)), "gap")
    return rows.select("run_id", "sequence", reason.alias("reason")).filter("reason is not null")
