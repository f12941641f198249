"""Readers (S1-S11) and writers (K1-K12) for posts, threads, pages and derived tables.

Readers always pass a declared schema.  Writers are plain DataFrame writers:
parallel, one file set per partition, with ``maxRecordsPerFile`` standing in
for the reference's size-rolled parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import schemas
from threadlens.functions import ids as D
from threadlens.functions import text as TX
from threadlens.session import cut_lineage, dropping_shuffles, slices

# ---------------------------------------------------------------- S: sources


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Post records under the fixed schema (parquet, json or csv)."""
    r = spark.read.schema(schemas.POST_SCHEMA)
    return r.format(fmt).load(path)


def read_post_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The store's record form (epoch-ms timestamps) back to the post schema."""
    df = spark.read.schema(schemas.POST_RECORD_SCHEMA).format(fmt).load(path)
    return df.select(*[F.timestamp_millis("post_date_timestamp").alias("post_timestamp") if c == "post_date_timestamp"
                       else F.col(c) for c in df.columns]).select(*schemas.POST_SCHEMA.fieldNames())


def read_threads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Thread records under the fixed schema."""
    return spark.read.schema(schemas.THREAD_SCHEMA).format(fmt).load(path)


def count_records(df: DataFrame) -> DataFrame:
    """S3: number of records (as a one-row frame; the caller decides whether to collect)."""
    return df.agg(F.count(F.lit(1)).alias("n_records"))


def sql_query(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL text over named frames with bound parameters (``:name``), never string formatting."""
    return spark.sql(text, args=args or {}, **frames)


def sql_single_value(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """One-row, one-column result; the caller reads ``first()[0]`` at its edge."""
    df = sql_query(spark, text, args, **frames)
    return df.select(df.columns[0]).limit(1)


def sql_first_column(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """S5, list form: the first column of every row, as a frame of one column."""
    df = sql_query(spark, text, args, **frames)
    return df.select(df.columns[0])


def thread_posts(posts: DataFrame, thread_id: int) -> DataFrame:
    """All posts of a thread; stays a DataFrame (use ``toLocalIterator`` only at the caller's edge)."""
    return posts.where(F.col("thread_id") == F.lit(thread_id))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line.

    ``line_id`` tells equal lines apart (unique in the read, the same for the same files and split sizes);
    ``doc_key`` is a hash of the text, for de-duplication.
    """
    df = spark.read.text(path)
    return df.select(F.monotonically_increasing_id().alias("line_id"), F.sha2(F.col("value"), 256).alias("doc_key"),
                     F.col("value").alias("text"))


def read_polarities(spark: SparkSession, path: str) -> DataFrame:
    """Polarity CSV with header under the fixed schema."""
    return spark.read.schema(schemas.POLARITY_SCHEMA).option("header", True).csv(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw pages (url + html per fetched page)."""
    if fmt == "wholetext":
        df = spark.read.option("wholetext", True).text(path).withColumn("url", F.input_file_name())
        return df.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))
    return spark.read.schema(schemas.PAGE_SCHEMA).format(fmt).load(path)


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """A seeded shuffle of the corpus, first ``n`` documents (a top-n sort, TakeOrderedAndProject)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(n).drop("_h")


# Markers of quoted lines in a message body (line starts or reply phrases).
QUOTE_LINE_PATTERN = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
FOOTER_LINE_PATTERN = r"^\s*-*\s*$"


def strip_header(col: Column) -> Column:
    """Drop everything up to the first blank line (no blank line -> empty text)."""
    pos = F.instr(col, "\n\n")
    return F.when(pos > 0, col.substr(pos + 2, F.length(col) + 1)).otherwise(F.lit(""))


def strip_footer(col: Column) -> Column:
    """Cut the text at its last line that is blank or only dashes (when that line is not the first)."""
    lines = F.split(F.trim(col), "\n")
    idx = F.aggregate(F.sequence(F.lit(1), F.size(lines)), F.lit(0),
                      lambda acc, i: F.when(F.element_at(lines, i).rlike(FOOTER_LINE_PATTERN), i - 1).otherwise(acc))
    return F.when(idx > 0, F.array_join(F.slice(lines, 1, idx), "\n")).otherwise(col)


def strip_quotes(col: Column) -> Column:
    """Drop quoted lines."""
    return F.array_join(F.filter(F.split(col, "\n"), lambda l: ~l.rlike(QUOTE_LINE_PATTERN)), "\n")


def strip_message(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Headers, then footers, then quoted lines removed (in that order)."""
    d = df.withColumn("_s11", F.col(text))
    d = d.withColumn("_s11", strip_header(F.col("_s11")))
    d = d.withColumn("_s11", strip_footer(F.col("_s11")))
    return d.withColumn(out, strip_quotes(F.col("_s11"))).drop("_s11")


# ---------------------------------------------------------------- K: sinks

def post_records(posts: DataFrame) -> DataFrame:
    """K12 shape: the store's post record (timestamp as epoch ms)."""
    return posts.select("post_id", "user_id", "user_name", "post_text", "thread_page",
                        D.epoch_millis("post_timestamp").alias("post_date_timestamp"),
                        "quoted_post_ids", "thread_id", "forum_id")


def post_json(posts: DataFrame) -> DataFrame:
    """One JSON record per post."""
    r = post_records(posts)
    return r.select("post_id", F.to_json(F.struct(*r.columns)).alias("json"))


def thread_json(threads: DataFrame) -> DataFrame:
    """One JSON record per thread (the flag keeps the store's field name)."""
    return threads.select("thread_id", F.to_json(F.struct(
        "thread_id", "thread_title", "forum_id", "author", "author_id", F.col("is_ignored").alias("ignore")))
        .alias("json"))


def write_posts(posts: DataFrame, path: str, max_records: int = 1_000_000, fmt: str = "parquet",
                mode: str = "append", partition_by: str | None = "forum_id") -> None:
    """K1: append posts; parts roll over at ``max_records`` rows; one folder per forum."""
    w = posts.write.mode(mode).option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)


def write_threads(threads: DataFrame, path: str, max_records: int = 1_000_000, fmt: str = "parquet",
                  mode: str = "append") -> None:
    """K2: append threads."""
    threads.write.mode(mode).option("maxRecordsPerFile", max_records).format(fmt).save(path)


def load_into_table(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """K3: append into an existing table; fail when it is missing or the columns or types differ.

    Returns a one-row frame with the rows loaded, counted while writing via ``observe``.
    """
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table} does not exist")
    target = spark.table(table)
    if df.dtypes != target.dtypes:
        raise ValueError(f"columns {df.dtypes} do not match {target.dtypes}")
    from pyspark.sql import Observation

    obs = Observation("load")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.insertInto(table)
    return spark.createDataFrame([(table, int(obs.get["rows"]))], "table string, rows_loaded long")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """K4: rows of ``new`` whose key is not stored yet (existing row wins); de-duplicated by key first.

    Returns only the rows to append; ``existing.unionByName(result)`` is the table after the load.
    """
    fresh = dedupe_latest(new, key, order_by=[key])
    return fresh.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def dedupe_latest(df: DataFrame, key: str = "post_id", order_by: list[str] | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    """K5: one row per key, the latest by ``order_by`` (default post_timestamp), ties by the whole row.

    An aggregate (``max_by`` over a struct), not a window: partial aggregation
    collapses a heavily duplicated key map-side before the shuffle.

    With ``columns`` only these are returned, and whole rows are regrouped only for keys whose latest rows
    differ in them: the others are known without the rest of the row.
    """
    order_by = order_by or ["post_timestamp"]
    if columns is not None:
        rank = [c for c in order_by if c != key]
        ends = df.groupBy(key, *rank).agg(F.min(F.struct(*columns)).alias("lo"), F.max(F.struct(*columns)).alias("hi"))
        if rank:
            ends = ends.groupBy(key).agg(F.max_by(F.struct("lo", "hi"), F.struct(*rank)).alias("b")).select(key, "b.*")
        best = cut_lineage(ends.withColumnRenamed(key, "_key"), drop_shuffles=True)
        same = F.col("lo").eqNullSafe(F.col("hi"))
        plain = best.where(same).select("hi.*")
        tied = best.where(~same).select("_key")
        n_tied = tied.count()
        if not n_tied:
            return plain
        tied = F.broadcast(tied) if n_tied <= 100_000 else tied
        rows = df.join(tied, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        return plain.unionByName(dedupe_latest(rows, key, order_by).select(*columns))
    cols = [c for c in df.columns]
    rank = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in cols if c not in order_by and
                                                     not isinstance(df.schema[c].dataType, T.MapType)])
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_r"))
    return best.select("_r.*")


def dedupe_repeated(df: DataFrame, key: str = "post_id", max_keys: int = 100_000) -> DataFrame:
    """K5 where few keys repeat: the same rows as ``dedupe_latest``, but only rows of a repeated key are regrouped.

    Keys alone are counted first. Rows whose key stands once pass as they are; with more than ``max_keys``
    repeated keys all rows take ``dedupe_latest``.
    """
    repeated = cut_lineage(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
                           .where(F.col("_n") > 1).select("_key"))
    n = repeated.count()
    if n == 0:
        return df
    if n > max_keys:
        return dedupe_latest(df, key)
    same = F.col(key).eqNullSafe(F.col("_key"))
    few = F.broadcast(repeated)
    return (df.join(few, same, "left_anti")
            .unionByName(dedupe_latest(df.join(few, same, "left_semi"), key)))


def csv_rows(posts: DataFrame, trim_newlines: bool = False) -> DataFrame:
    """K6 shape: post rows in the store's column order, optional newline removal in the text."""
    text = TX.remove_newlines("post_text") if trim_newlines else F.col("post_text")
    return posts.select("post_id", "thread_id", "user_name", "user_id", text.alias("post_text"), "thread_page",
                        F.date_format("post_timestamp", "yyyy-MM-dd HH:mm:ss").alias("post_timestamp"))


def write_csv(posts: DataFrame, path: str, delimiter: str = ",", trim_newlines: bool = False,
              mode: str = "append") -> None:
    """K6: delimited text, any delimiter."""
    csv_rows(posts, trim_newlines).write.mode(mode).option("sep", delimiter).csv(path)


def write_post_ids(posts: DataFrame, thread_id: int, path: str, mode: str = "overwrite") -> None:
    """K7: post ids of a thread, one per line."""
    (posts.where(F.col("thread_id") == thread_id).select(F.col("post_id").cast("string").alias("value"))
     .write.mode(mode).text(path))


def thread_post_json_rows(posts: DataFrame) -> DataFrame:
    """K8, row form: ``(thread_id, forum_id, post_id, post_json)``; written by buckets of threads.

    The whole-thread document is never built in one task: a thread's posts are
    JSON lines, ordered by post_id within files.
    """
    body = F.to_json(F.struct(
        "post_id", "thread_id", "user_name", "user_id", F.col("post_text").alias("text"),
        F.col("thread_page").alias("page"),
        F.date_format("post_timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")))
    return posts.select("thread_id", "forum_id", "post_id", body.alias("post_json"))


def thread_document(posts: DataFrame) -> DataFrame:
    """K8: one nested document per thread ``{thread_id, forum_id, posts:[...]}`` (posts ordered by id).

    For threads of bounded size; the row form above is the scalable writer.
    """
    rows = thread_post_json_rows(posts)
    return rows.groupBy("thread_id", "forum_id").agg(
        F.concat(F.lit('{"thread_id":"'), F.col("thread_id").cast("string"), F.lit('","forum_id":"'),
                 F.col("forum_id").cast("string"), F.lit('","posts":['),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_id", "post_json"))),
                                          lambda s: s["post_json"]), ","),
                 F.lit("]}")).alias("document"))


def thread_bucket(thread_id: Column, buckets: int) -> Column:
    """The folder of a thread: a hash bucket, so the number of folders does not grow with the threads."""
    return F.pmod(F.xxhash64(thread_id), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, by: str, order: list[str], path: str, mode: str) -> None:
    """JSON lines (gzip), one folder per bucket, dealt by bucket and ``by``.

    Slices of buckets are written one after the other, so the shuffle files of one of them are on disk at a time;
    a run that fails leaves the slices written before.
    """
    spark = rows.sparkSession
    with dropping_shuffles(spark):
        for part in slices(rows, "bucket", rows.count()):
            part = part.repartition("bucket", by)
            part = part.sortWithinPartitions(*order) if order else part
            part.write.mode(mode).option("compression", "gzip").partitionBy("bucket").json(path)
            mode = "append"


def write_thread_json(posts: DataFrame, path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """K8 sink: JSON lines (gzip), one folder per thread bucket; a thread's rows stand together, by post id."""
    rows = thread_post_json_rows(posts).withColumn("bucket", thread_bucket(F.col("thread_id"), buckets))
    _write_buckets(rows, "thread_id", ["bucket", "thread_id", "post_id"], path, mode)


def index_documents(posts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """K9: search-index bulk rows ``(index, id, body)``; index = forum-thread[-ascii], id = post_id.

    Re-indexing replaces by id, so only the latest row per post is kept.
    """
    latest = dedupe_repeated(posts, "post_id")
    text = TX.strip_non_ascii("post_text") if ascii_only else F.col("post_text")
    index = F.concat_ws("-", F.col("forum_id").cast("string"), F.col("thread_id").cast("string"),
                        *([F.lit("ascii")] if ascii_only else []))
    body = F.to_json(F.struct("post_id", "thread_id", "user_name", "user_id", text.alias("text"),
                              F.col("thread_page").alias("page"),
                              F.date_format("post_timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")))
    return latest.select(index.alias("index"), F.col("post_id").alias("id"), body.alias("body"))


def write_index(posts: DataFrame, path: str, ascii_only: bool = False, mode: str = "overwrite",
                buckets: int = 64) -> None:
    """K9 sink: bulk files (JSON lines, gzip), one folder per bucket of indexes; the index stays a column of the rows."""
    rows = index_documents(posts, ascii_only).withColumn("bucket", thread_bucket(F.col("index"), buckets))
    _write_buckets(rows, "index", [], path, mode)


def write_polarities(pol: DataFrame, path: str, header: bool = True, mode: str = "append") -> None:
    """Polarity rows as CSV, optional header."""
    pol.select(*schemas.POLARITY_SCHEMA.fieldNames()).write.mode(mode).option("header", header).csv(path)


def write_frame_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A statistics frame as CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)
