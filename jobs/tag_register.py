"""Register of tagged records: takes in new pages as they arrive and keeps one current row a record, by site.

A lab's instruments and run reports leave tagged text (HTML and XML exports).  This job reads such pages as a file stream
and reads their tags with the library's tag expressions.  Each run takes only files that no earlier run has taken (the
stream's checkpoint knows), then stops.  It keeps two tables under ``output``:

* ``records``, partitioned by batch and bucket: what each delivery said.  A batch that is run again after a failure
  replaces its own partitions.
* ``register``, partitioned by bucket: the latest delivery of each record, whether a later record at the same address has
  made it stale, and the site's totals.  After a batch only the buckets that it touched are made anew, from ``records``,
  so they are right whether or not the batch ran before.

A site's records share a bucket; a bucket is written in as many files as its size asks for (rebalanced), and every
grouping below is by record or by address, so a site with a third of all rows is no single task.  Pages are read once;
``records`` holds no page text, a few hundred bytes for each page.

Defined results.  A null html gives nulls and zero counts, a null or unreadable url no site (bucket of the empty site)
and no address, which is never stale.  A record without an id is known by the digest of its url and html.  Of several
rows of a record in one batch the greatest (sha256, url) counts.  Further columns of the pages are ignored; an empty
input gives an empty register.  ``output`` and ``checkpoint`` belong together: with a new checkpoint all files are new
deliveries, which changes no result as long as the files are the same.  ``buckets`` is fixed by the first run; another
number is refused.

    python -m jobs.tag_register --config jobs/tag_register.json --pages P --output O --checkpoint C
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from stackmeter.functions.tags import tag_attribute, tag_count, tag_text

LOG = logging.getLogger("jobs.tag_register")
RECORD = "record string, page_id long, url string, site string, address string, title string, language string, n_paragraphs int, n_links int, n_bytes long, sha256 string"


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    files_per_batch: int = 200


def described(pages: DataFrame, buckets: int) -> DataFrame:
    """One row of ``RECORD`` and its bucket for each page."""
    url, html = F.col("url"), F.col("html")
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)
    site = F.nullif(F.regexp_replace(F.lower(host), r"^(www|m|blog)\.", ""), F.lit(""))
    place = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), r"\.html$", "")
    path = F.regexp_replace(place, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    digest = F.sha2(html, 256)
    named = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.sha2(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))), 256)).alias("record"),
        F.col("page_id").cast("long").alias("page_id"), url, site.alias("site"), F.concat(site, path).alias("address"), tag_text(html, "title").alias("title"), tag_attribute(html, "html", "lang").alias("language"),
        F.coalesce(tag_count(html, "p"), F.lit(0)).alias("n_paragraphs"), F.coalesce(tag_count(html, "a"), F.lit(0)).alias("n_links"), F.coalesce(F.octet_length(html), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("sha256"),
    )
    return named.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("site", F.lit(""))), F.lit(buckets)).cast("int"))


def current(records: DataFrame) -> DataFrame:
    """The register's rows from the deliveries of whole buckets."""
    values = [c for c in records.columns if c not in ("record", "batch", "bucket", "n_buckets")]
    last = F.max_by(F.struct(*values), F.struct("batch", F.coalesce("sha256", F.lit("")), F.coalesce("url", F.lit(""))))
    latest = records.groupBy("bucket", "record").agg(last.alias("v")).select("bucket", "record", "v.*")
    newest = latest.where("address is not null").groupBy("bucket", "address").agg(F.max("page_id").alias("newest"))
    sites = latest.groupBy("bucket", "site").agg(F.count(F.lit(1)).alias("site_records"), F.sum("n_bytes").alias("site_bytes"))
    same = latest["bucket"].eqNullSafe(sites["bucket"]) & latest["site"].eqNullSafe(sites["site"])
    out = latest.join(sites, same).select(latest["*"], "site_records", "site_bytes").join(newest, ["bucket", "address"], "left")
    return out.withColumn("stale", F.coalesce(F.col("page_id") < F.col("newest"), F.lit(False))).drop("newest")


def run(spark: SparkSession, pages: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Take in the new files of ``pages``, end the stream, and say what was read and written."""
    report = {"batches": 0, "pages_read": 0, "buckets_written": 0}
    records, register = f"{output}/records", f"{output}/register"
    before = common.parquet_if_there(spark, records)
    if before is not None and not before.where(F.col("n_buckets") != settings.buckets).isEmpty():
        raise ValueError(f"{output} was written with another number of buckets than {settings.buckets}")
    schema = spark.read.parquet(pages).select("page_id", "url", "html").schema

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        common.replace_partitions(described(batch, settings.buckets).withColumn("n_buckets", F.lit(settings.buckets)).withColumn("batch", F.lit(number)).hint("rebalance", "bucket"), records, "batch", "bucket")
        told = common.parquet_if_there(own, records)
        if told is None:  # the first batch had no row
            return
        per_bucket = told.where(F.col("batch") == number).groupBy("bucket").count().collect()  # at most settings.buckets rows
        touched = [r["bucket"] for r in per_bucket]
        if touched:
            common.replace_partitions(current(told.where(F.col("bucket").isin(touched))).hint("rebalance", "bucket"), register, "bucket")
        n = sum(r["count"] for r in per_bucket)
        LOG.info("batch %d: read %d pages, wrote their records and %d buckets of the register", number, n, len(touched))
        report["batches"] += 1
        report["pages_read"] += n
        report["buckets_written"] += len(touched)

    # A stream takes a path without wildcards for a folder; with one, here around its last letter, it may be a single file too.
    place = pages.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(place if set("*?[{") & set(place) else f"{place[:-1]}[{place[-1]}]")
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %(pages_read)d new pages in %(batches)d batches", report)
    return report


def result(spark: SparkSession, output: str) -> DataFrame:
    """The register as it stands."""
    found = common.parquet_if_there(spark, f"{output}/register")
    if found is None:
        return spark.createDataFrame([], f"{RECORD}, site_records long, site_bytes long, stale boolean")
    return found.drop("bucket")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--pages", "--output", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config")
    a = p.parse_args(arguments)
    spark = common.session("tag-register")
    try:
        run(spark, a.pages, a.output, a.checkpoint, common.settings_of(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
