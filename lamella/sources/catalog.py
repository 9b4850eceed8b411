"""Catalogues of slices, slice filters, channel metadata and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_slice_filter(df: DataFrame, ranges: str = "ranges") -> DataFrame:
    """``"0-3, 7"`` to a row per allowed position. A core without an entry keeps all its slices (see ``keep_slices``)."""
    parts = df.select(*[c for c in df.columns if c != ranges], F.explode(F.split(ranges, ",")).alias("_p")).withColumn("_p", F.trim("_p"))
    low = F.regexp_extract("_p", r"^(\d+)", 1).try_cast("int")
    high = F.coalesce(F.regexp_extract("_p", r"-\s*(\d+)$", 1).try_cast("int"), low)
    positions = parts.filter(low.isNotNull() & (high >= low)).withColumn("position", F.explode(F.sequence(low, high)))
    return positions.drop("_p").distinct()


def slice_catalog(files: DataFrame, keys: Sequence[str] = ("core",), file: str = "file", pattern: str = r"TMA_(\d+)_", fallback: str = r"ID(\d+)_") -> DataFrame:
    """slice_id from the file name (-1 if there is none) and z, the file's place in the order of ids, then names."""
    found = F.coalesce(F.regexp_extract(file, pattern, 1).try_cast("int"), F.regexp_extract(file, fallback, 1).try_cast("int"), F.lit(-1))
    order = Window.partitionBy(*keys).orderBy("slice_id", file)
    return files.withColumn("slice_id", found).withColumn("z", F.row_number().over(order) - 1)


def channel_metadata(xml: DataFrame, column: str = "xml", key: str = "file_id") -> DataFrame:
    """Channel rows of image descriptions: OME ``Channel`` elements, else one vendor document per page.

    Vendor pages count if ``ImageType`` is FullResolution or absent; channel_index is the order of pages (column ``page``,
    if there is one). All values are text; absent ones are NULL. A text is parsed only for elements whose names stand in it,
    and for ``Name`` always, so broken texts fail.
    """
    fields = ("Name", "ExposureTime", "ExposureTimeUnit", "IsUnmixedComponent", "Fluor", "Color")
    attributes = [F.xpath(column, F.lit(f"//*[local-name()='Channel']/@{f}")) for f in fields]
    named = lambda name: F.contains(F.col(column), F.lit(name))
    count = F.when(named("Channel"), F.size(F.xpath(column, F.lit("//*[local-name()='Channel']/@Name")))).when(F.col(column).isNotNull(), 0)
    ome = xml.withColumn("_n", count).filter("_n > 0").select(key, F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("channel_index", "_i"), column)
    of_ome = ome.select(key, "channel_index", *[F.get(a, F.col("_i")).alias(f) for a, f in zip(attributes, fields)])
    parsed = lambda f: F.xpath_string(column, F.lit(f"//{f}"))
    text = lambda f: parsed(f) if f == "Name" else F.when(named(f), parsed(f)).otherwise("")
    pages = xml.withColumn("_n", count).filter("_n = 0").withColumn("_type", text("ImageType")).filter("_type IN ('', 'FullResolution')")
    order = Window.partitionBy(key).orderBy("page" if "page" in xml.columns else F.lit(0))
    # Few bytes need long parsing: dealt by a given number, which Spark does not merge by size. The parsing comes after the deal.
    pages = pages.repartition(int(xml.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    # Values have a step of their own: a text is parsed once for each, not again where an empty one becomes NULL.
    values = pages.select(key, (F.row_number().over(order) - 1).alias("channel_index"), *[text(f).alias(f) for f in fields])
    of_pages = values.select(key, "channel_index", *[F.nullif(F.col(f), F.lit("")).alias(f) for f in fields])
    return of_ome.unionByName(of_pages)


def scan_run_logs(spark: SparkSession, path: str, pattern: str = r"Final 3D cell count: (\d+)", file: str = r"([^/]+)\.log$") -> DataFrame:
    """The last count that each run log reports, and the run's status: OK, or NO_COUNT if it reports none.

    Lines have no order of their own across a split file, so they are numbered within the file as read whole.
    """
    logs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), file, 1).alias("core"), "value")
    counts = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    last = F.try_element_at(counts, F.lit(-1)).try_cast("long")
    return logs.select("core", last.alias("n_cells"), F.when(last.isNull(), "NO_COUNT").otherwise("OK").alias("status"))
