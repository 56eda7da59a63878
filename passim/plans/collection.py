"""A collection that outlives its session: models, segments, deletions, versions.

``<path>/models/``                  centroids, codebooks, and one row of metric and width
``<path>/data/write=<v>/cell=<c>/`` the rows that version ``v`` wrote
``<path>/segments/version=<v>/``    the segments ``write, cell, rows`` that ``v`` consists of
``<path>/deleted/version=<v>/``     places in earlier segments that ``v`` replaced or deleted
``<path>/versions/version=<v>/``    one row; with it ``v`` is published

A version is claimed by creating a file that must not exist yet, and published
last, by one small commit. So versions form one line, a reader sees whole ones
only, and each stays readable as it was. A write touches no earlier file: a
replaced row is named by its place (segment, file, row), and readers leave such
places out, without moving vectors while the list is small. A compaction rewrites
the cells that are due; all others keep their files.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passim.functions.vector import check_dim
from passim.operators.cells import assign_cells, request_probes, search_probes
from passim.operators.nearest import vector_width
from passim.operators.routed import encode_residuals, search_routed, settle
from passim.operators.segments import last_per_id
from passim.session import broadcast_within, checkpointed, create_new, path_exists, remove_file

# Fixed value: the one metric of the stored index.
METRIC = "squared_l2"
# More live segments than this are found by a join instead of a literal list.
_LITERAL_SEGMENTS = 4096
_PLACE = ["write", "cell", "file", "row"]


@dataclass(frozen=True)
class Collection:
    """One published version, read from its files alone."""

    spark: SparkSession
    path: str
    version: int
    width: int

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/models/centroids")

    def codebooks(self) -> DataFrame | None:
        """``sub, code, centroid`` for residuals, if the collection is compressed."""
        where = f"{self.path}/models/codebooks"
        return self.spark.read.parquet(where) if path_exists(self.spark, where) else None

    def segments(self) -> DataFrame:
        """``write, cell, rows`` of each segment; ``rows`` with those deleted since."""
        return self.spark.read.parquet(f"{self.path}/segments/version={self.version}")

    def deleted(self) -> DataFrame:
        """Places that are live no more, of segments that are."""
        base = f"{self.path}/deleted"
        if not path_exists(self.spark, base):
            return self.spark.createDataFrame([], "write int, cell int, file string, row long")
        places = self.spark.read.option("basePath", base).parquet(base).filter(F.col("version") <= self.version)
        return places.select(*_PLACE).join(self.segments().select("write", "cell"), ["write", "cell"], "left_semi")

    def placed(self) -> DataFrame:
        """Live rows ``id, values, cell, write`` (and ``codes``) with their ``file`` and ``row``."""
        base = f"{self.path}/data"
        rows = self.spark.read.option("basePath", base).parquet(base)
        rows = rows.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})
        segments = self.segments().select("write", "cell")
        listed = segments.limit(_LITERAL_SEGMENTS + 1).collect()
        if len(listed) <= _LITERAL_SEGMENTS:
            # Only partition columns: folders of other segments are never opened.
            rows = rows.filter(F.concat_ws("/", "write", "cell").isin([f"{r['write']}/{r['cell']}" for r in listed]))
        else:
            rows = rows.join(segments, ["write", "cell"], "left_semi")
        gone = self.deleted()
        return rows.join(broadcast_within(gone, gone.count(), 160), _PLACE, "left_anti")

    def rows(self) -> DataFrame:
        """Live rows: one for each id."""
        return self.placed().drop("file", "row")

    def search(self, requests: DataFrame) -> DataFrame:
        """``qid, rank, id, distance`` for requests ``id, values`` with their own
        ``k, nprobe, rescore`` where given; without codebooks distances are exact."""
        books = self.codebooks()
        if books is not None:
            return search_routed(requests, self.rows(), self.centroids(), books)
        centroids = self.centroids()
        asked = checkpointed(settle(requests, centroids.count()))
        most, k = asked.agg(F.max("nprobe"), F.max("k")).first()
        probes = checkpointed(request_probes(asked, centroids, most or 1))
        hits = search_probes(asked.select("id", "values"), self.rows(), probes, k or 1)
        return hits.join(asked.select(F.col("id").alias("qid"), "k"), "qid").filter(F.col("rank") <= F.col("k")).drop("k")

    def upsert(self, batch: DataFrame, pos: str | None = None) -> "Collection":
        """The next version, in which rows of ``batch`` (``id, values``) replace those of their id.

        With ``pos`` the last of an id's rows counts; without it ids must be
        unique. Vectors of another width fail.
        """
        rows = batch.select("id", "values", *([pos] if pos else []))
        rows = rows.withColumn("values", check_dim(F.col("values").cast("array<float>").cast("array<double>"), self.width).cast("array<float>"))
        version = _claim(self.spark, self.path, self.version)
        new = _write_rows(_routed(last_per_id(rows, pos) if pos else rows, self.centroids(), self.codebooks()), self.path, version)
        written = self.placed().select("id", *_PLACE).join(new.select("id"), "id", "left_semi").select(*_PLACE)
        return self._publish(version, self.segments(), new, written)

    def delete(self, ids: DataFrame) -> "Collection":
        """The next version, without the rows of these ids."""
        version = _claim(self.spark, self.path, self.version)
        gone = self.placed().select("id", *_PLACE).join(ids.select("id"), "id", "left_semi").select(*_PLACE)
        return self._publish(version, self.segments(), None, gone)

    def due(self, min_segments: int = 1) -> DataFrame:
        """``cell`` of the cells that :meth:`compact` would rewrite."""
        return self.segments().groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= min_segments).select("cell")

    def compact(self, min_segments: int = 1) -> "Collection":
        """The next version, in which each cell of so many segments is one, without deleted rows."""
        version = _claim(self.spark, self.path, self.version)
        due = checkpointed(self.due(min_segments))
        listed = [r["cell"] for r in due.limit(_LITERAL_SEGMENTS + 1).collect()]
        rows = self.rows()
        rows = rows.filter(F.col("cell").isin(listed)) if len(listed) <= _LITERAL_SEGMENTS else rows.join(due, "cell", "left_semi")
        new = _write_rows(rows.drop("write"), self.path, version)
        return self._publish(version, self.segments().join(due, "cell", "left_anti"), new, None)

    def _publish(self, version: int, kept: DataFrame, new: DataFrame | None, gone: DataFrame | None) -> "Collection":
        segments = kept.select("write", "cell", "rows")
        if new is not None:
            counted = new.groupBy("cell").agg(F.count("*").alias("rows"))
            segments = segments.unionByName(counted.select(F.lit(version).alias("write"), "cell", "rows"))
        segments.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/segments/version={version}")
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.path}/deleted/version={version}")
        _commit(self.spark, self.path, version)
        return Collection(self.spark, self.path, version, self.width)


def _claim(spark: SparkSession, path: str, parent: int) -> int:
    """The version after ``parent``, for this writer alone."""
    version = parent + 1
    if not create_new(spark, f"{path}/claims/{version}"):
        raise RuntimeError(f"version {version} is taken by another writer; open the newest version, or release_claim if that writer is gone")
    return version


def release_claim(spark: SparkSession, path: str) -> int | None:
    """Free the claim of a writer that was lost before it published; the version, if there was one.

    What the lost writer left is overwritten by the next writer of that version.
    """
    version = newest_version(spark, path) + 1
    return version if remove_file(spark, f"{path}/claims/{version}") else None


def _commit(spark: SparkSession, path: str, version: int) -> None:
    spark.range(1).select(F.lit(METRIC).alias("metric")).coalesce(1).write.mode("overwrite").json(f"{path}/versions/version={version}")


def _routed(rows: DataFrame, centroids: DataFrame, codebooks: DataFrame | None) -> DataFrame:
    homed = assign_cells(rows, centroids)
    return homed if codebooks is None else encode_residuals(homed, centroids, codebooks)


def _write_rows(rows: DataFrame, path: str, version: int) -> DataFrame:
    """Stored rows ``id, cell`` of this write."""
    target = f"{path}/data/write={version}"
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(target)
    kept = [f for f in rows.schema.fields if f.name != "cell"] + [rows.schema["cell"]]
    return rows.sparkSession.read.schema(type(rows.schema)(kept)).parquet(target).select("id", "cell")


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest published version; -1 if there is none."""
    base = f"{path}/versions"
    if not path_exists(spark, base):
        return -1
    newest = spark.read.schema("metric string, version int").json(base).agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def create_collection(vectors: DataFrame, path: str, centroids: DataFrame, codebooks: DataFrame | None = None) -> Collection:
    """Store the models and, as version 0, the rows ``id, values`` of ``vectors`` (ids unique).

    ``codebooks`` are of residuals, see ``train_residual_pq``. A path that holds
    a collection already fails.
    """
    spark = vectors.sparkSession
    width = vector_width(centroids)
    version = _claim(spark, path, -1)
    centroids.select("id", "values").write.mode("overwrite").parquet(f"{path}/models/centroids")
    if codebooks is not None:
        codebooks.select("sub", "code", "centroid").write.mode("overwrite").parquet(f"{path}/models/codebooks")
    settings = spark.range(1).select(F.lit(METRIC).alias("metric"), F.lit(width).alias("width"))
    settings.coalesce(1).write.mode("overwrite").json(f"{path}/models/settings")
    empty = Collection(spark, path, -1, width)
    rows = vectors.select("id", check_dim(F.col("values").cast("array<float>").cast("array<double>"), width).cast("array<float>").alias("values"))
    new = _write_rows(_routed(rows, empty.centroids(), empty.codebooks()), path, version)
    none = spark.createDataFrame([], "write int, cell int, rows long")
    return empty._publish(version, none, new, None)


def open_collection(spark: SparkSession, path: str, version: int | None = None) -> Collection:
    """A published version, the newest unless one is named."""
    newest = newest_version(spark, path)
    if newest < 0:
        raise FileNotFoundError(f"no published collection at {path}")
    version = newest if version is None else version
    if not path_exists(spark, f"{path}/versions/version={version}/_SUCCESS"):
        raise FileNotFoundError(f"version {version} of {path} is not published")
    settings = spark.read.schema("metric string, width int").json(f"{path}/models/settings").first()
    if settings["metric"] != METRIC:
        raise ValueError(f"unknown metric {settings['metric']}")
    return Collection(spark, path, version, settings["width"])
