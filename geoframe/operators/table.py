"""Feature tables: attribute columns, a row id that keeps the order (__fid), and a nullable geometry.

All operators are lazy and return a new frame.  Order-dependent statistics (first, last, concat, windows) go by __fid.
"""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions import geometry as G
from geoframe.functions import kernels, stats
from geoframe.functions.exprparse import parse
from geoframe.operators import bound
from geoframe.types import FID, GEOM, GEOMETRY, WGS84

Mapping = Sequence[tuple]


def as_column(condition) -> Column:
    return parse(condition) if isinstance(condition, str) else condition


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the context was given; one of our own only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'geoframe-shared')}"
    return path.rstrip("/")


_kept: dict[str, SparkSession] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table in the shared folder, written in one job and removed when this process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may be any
    _kept[path] = spark
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt over four tasks for each core: a small file is one split, and would be one task of whatever each row costs."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a file or folder removed when this process ends."""
    _kept[path] = spark


def remove_kept(*frames: DataFrame) -> None:
    """Remove the tables that frames straight from checkpointed() read, once nothing else reads them."""
    for df in frames:
        for folder in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
            _remove(next((k for k in _kept if k.endswith(f"/{folder}")), None))


def _remove(path: str | None) -> None:
    spark = _kept.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def remove_all_kept() -> None:
    """Remove all tables of checkpointed(): at the end, or before, once no frame made from them is used any more."""
    for path in list(_kept):
        _remove(path)


def ranked(df: DataFrame, *order: Column, name: str = FID) -> DataFrame:
    """df with a number from 0 in the given order. Rows are dealt into ranges and ranked inside; the ranges' sizes are added up, so no
    task sees all rows. The ranges come from a sample, which another run would draw otherwise: they are kept before they are counted."""
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    local = checkpointed(ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    sizes = local.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return local.join(F.broadcast(starts), "__p").select(*(c for c in df.columns if c != name), (F.col("__s") + F.col("__r") - 1).alias(name))


def with_fid(df: DataFrame, *keys: str) -> DataFrame:
    """df with __fid from 0 in the order of the keys; without keys ids follow the order in which rows are read, which the file splits decide:
    give keys where first, last, ties in sort, or a moving window must not change with them."""
    return ranked(df, *(F.col(k) for k in keys)) if keys else df.withColumn(FID, F.monotonically_increasing_id())


class FeatureFrame:
    #: Functions of the operator modules with this frame as their first argument (see operators.bound).
    manage, analyze, convert = (bound.Group(bound.VECTOR[g]) for g in ("manage", "analyze", "convert"))

    def __init__(self, df: DataFrame, geometry_type: str | None = None, crs: str = WGS84, order: Sequence[str] = ()):
        """geometry_type: Point, LineString or Polygon; the type of all geometries in the frame, if it is known."""
        if FID not in df.columns:
            df = with_fid(df, *order)
        if GEOM not in df.columns:
            df = df.withColumn(GEOM, F.lit(None).cast(GEOMETRY))
        self.df, self.geometry_type, self.crs = df, geometry_type, crs

    @classmethod
    def from_rows(cls, spark: SparkSession, fields: Sequence[str], rows: Sequence, geometries: Sequence[str | None] | None = None, schema: str | None = None, **more) -> FeatureFrame:
        """From lists: rows as lists of the fields' length or (partial) dicts, geometries as GeoJSON texts; the shorter list ends both."""
        geometries = [None] * len(rows) if geometries is None else geometries
        made = []
        for i, (row, g) in enumerate(zip(rows, geometries, strict=False)):
            if isinstance(row, dict):
                if unknown := set(row) - set(fields):
                    raise ValueError(f"unknown fields: {sorted(unknown)}")
                row = [row.get(f) for f in fields]
            if len(row) != len(fields):
                raise ValueError(f"row {i} has {len(row)} values for {len(fields)} fields")
            made.append((*row, i, _parsed(g)))
        kinds = schema or ", ".join(f"`{f}` {_kind([r[i] for r in made])}" for i, f in enumerate(fields))
        return cls(spark.createDataFrame(made, f"{kinds}{', ' if fields else ''}{FID} long, {GEOM} {GEOMETRY}"), **more)

    def new(self, df: DataFrame, **changes) -> FeatureFrame:
        return FeatureFrame(df, **({"geometry_type": self.geometry_type, "crs": self.crs} | changes))

    def __repr__(self) -> str:
        return f"<FeatureFrame {self.geometry_type or 'no geometry'} with fields {self.fields}>"

    def __len__(self) -> int:
        return self.df.count()

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in (FID, GEOM)]

    # Columns

    def select_fields(self, *columns: Column | str, geometry: Column | None = None) -> FeatureFrame:
        return self.new(self.df.select(*columns, FID, F.col(GEOM) if geometry is None else geometry.alias(GEOM)))

    def add_field(self, name: str, index: int | None = None, kind: str = "string") -> FeatureFrame:
        names = self.fields
        names.insert(len(names) if index is None else index, name)
        return self.new(self.df.withColumn(name, F.lit(None).cast(kind)).select(*names, FID, GEOM))

    def add_feature(self, row: dict, geometry: str | None = None) -> FeatureFrame:
        """One more row, after all others; fields not named are null."""
        if unknown := set(row) - set(self.fields):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        last = self.df.agg((F.coalesce(F.max(FID), F.lit(-1)) + 1).alias(FID))
        values = [F.lit(row.get(f)).cast(self.df.schema[f].dataType).alias(f) for f in self.fields]
        return self.new(self.df.unionByName(last.select(*values, FID, G.from_geojson(F.lit(geometry)).alias(GEOM))))

    def compute(self, field: str, value, by: str | Sequence[str] | None = None, stat: str | Callable | None = None) -> FeatureFrame:
        """A new or replaced column: a constant, a Column or an expression text; with `by` and `stat`, the group's statistic on each of its rows."""
        value = as_column(value) if isinstance(value, str) and by is None and stat is None else value if isinstance(value, Column) else stats.value_of(value) if isinstance(value, str) else F.lit(value)
        if stat is None:
            return self.new(self.df.withColumn(field, value))
        keys = [by] if isinstance(by, str) else list(by or [])
        # Grouped first and joined back: a hot group is added up partially, where a window would hold it in one task.
        per = self.aggregate_df(keys, [("__value", value, stat)])
        joined = self.df.alias("a").join(per.alias("b"), [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys] or F.lit(True), "left")
        out = [F.col(f"a.`{c}`") for c in self.df.columns if c != field]
        return self.new(joined.select(*out, F.col("b.__value").alias(field)))

    def drop_fields(self, *names: str) -> FeatureFrame:
        return self.new(self.df.drop(*names))

    def keep_fields(self, *names: str) -> FeatureFrame:
        if missing := [n for n in names if n not in self.fields]:
            raise ValueError(f"no such fields: {missing}")
        return self.new(self.df.select(*names, FID, GEOM))

    def rename_field(self, old: str, new: str) -> FeatureFrame:
        return self.new(self.df.withColumnRenamed(old, new))

    def convert_field(self, name: str, to) -> FeatureFrame:
        """to: a type name, or a function from a Column to a Column."""
        return self.new(self.df.withColumn(name, to(F.col(name)) if callable(to) else F.col(name).try_cast(to)))

    # Rows

    def select(self, condition) -> FeatureFrame:
        return self.new(self.df.where(as_column(condition)))

    get = select

    def exclude(self, condition) -> FeatureFrame:
        return self.new(self.df.where(~F.coalesce(as_column(condition), F.lit(False))))

    def feature(self, fid: int) -> FeatureFrame:
        return self.new(self.df.where(F.col(FID) == fid))

    def replace(self, fid: int, row: dict) -> FeatureFrame:
        out = self.df
        for name, v in row.items():
            out = out.withColumn(name, F.when(F.col(FID) == fid, F.lit(v)).otherwise(F.col(name)))
        return self.new(out)

    def sort(self, *keys: str | Column, reverse: bool = False) -> FeatureFrame:
        """Rows renumbered in the order of the keys; ties keep their order."""
        columns = [as_column(k) if isinstance(k, str) else k for k in keys]
        names = [f"__k{i}" for i in range(len(columns))]
        df = self.df.withColumnRenamed(FID, "__old")
        for n, c in zip(names, columns, strict=True):
            df = df.withColumn(n, c)
        order = [F.col(n).desc() if reverse else F.col(n).asc() for n in names]
        return self.new(ranked(df, *order, F.col("__old")).select(*self.df.columns))

    def limit(self, n: int) -> FeatureFrame:
        return self.new(self.df.orderBy(FID).limit(n))

    # Aggregation

    def aggregate_df(self, keys: Sequence[str | Column], mapping: Mapping, when: Column | None = None) -> DataFrame:
        """Key columns and statistics."""
        named = [k if isinstance(k, Column) else F.col(f"`{k}`") for k in keys]
        names = [k if isinstance(k, str) else f"key{i}" for i, k in enumerate(keys)]
        rows = self.df.select("*", *(c.alias(f"__key{i}") for i, c in enumerate(named)))
        by = [f"__key{i}" for i in range(len(named))]
        out = stats.aggregated(rows, by, mapping, when=when)
        return out.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), *(n for n, _, _ in mapping))

    def aggregate(self, key: Sequence[str] | str | Column, mapping: Mapping = (), geometry: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> FeatureFrame:
        """One feature for each key. A list of names keeps the key fields; a single name or Column does not. geometry, if given, takes (rows,
        key names) to a frame of key names and geom (see operators.overlay.dissolve)."""
        keys = [key] if isinstance(key, str | Column) else list(key)
        names = [k if isinstance(k, str) else f"key{i}" for i, k in enumerate(keys)]
        out = self.aggregate_df(keys, mapping)
        if geometry is not None:
            rows = self.df.select(*((k if isinstance(k, Column) else F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)), FID, GEOM)
            shapes = geometry(rows, names)
            shapes = shapes.select(*(F.col(n).alias(f"__g{n}") for n in names), GEOM)
            out = out.join(shapes, [F.col(n).eqNullSafe(F.col(f"__g{n}")) for n in names], "left").drop(*(f"__g{n}" for n in names))
        if isinstance(key, str | Column):
            out = out.orderBy(*names).drop(*names)
        return self.new(out)

    def duplicates(self, subkey: Sequence[str] = (), mapping: Mapping = ()) -> FeatureFrame:
        """One feature for each distinct geometry (and subkey)."""
        rows = self.df.withColumn("__shape", F.col(f"{GEOM}.parts"))
        out = FeatureFrame(rows).aggregate_df([*subkey, "__shape"], [*mapping, ("__one", F.col(GEOM), lambda c: F.min_by(c, F.col(FID))), ("__fid0", F.col(FID), lambda c: F.min(c))])
        return self.new(out.withColumn(GEOM, F.col("__one")).withColumn(FID, F.col("__fid0")).drop("__shape", "__one", "__fid0"))

    def group(self, key: str | Column) -> DataFrame:
        """Rows with the `key` of their group and its number `group`, from 0 in the order of the keys (null first). Sorted by group and __fid, groups follow
        each other as in a list of (key, rows), and none has to be held as a whole."""
        c = F.col(key) if isinstance(key, str) else key
        rows = self.df.withColumn("key", c)
        numbers = ranked(rows.select("key").distinct(), F.col("key"), name="group").select(F.col("key").alias("__key"), "group")
        return rows.join(numbers, F.col("key").eqNullSafe(F.col("__key"))).drop("__key")

    def split(self, key: str | Column, breaks: Sequence[float] | None = None) -> FeatureFrame:
        """Rows marked with the part they belong to (`part`): the key's value, or with breaks the class [a, b), the last one closed; rows
        in no class go. Write the frame partitioned by `part` to have one dataset each."""
        from geoframe.operators.classify import class_of

        c = F.col(key) if isinstance(key, str) else key
        out = self.df.withColumn("part", c if breaks is None else class_of(c, list(breaks)))
        return self.new(out.where("part IS NOT NULL"))

    #: Rows of a block of an ungrouped moving window.
    WINDOW_BLOCK = 100_000

    def moving_window(self, n: int, mapping: Mapping, groupby: str | Column | None = None) -> FeatureFrame:
        """Statistics of the last n rows, this one included, in the frame's order, inside groups if given. Without groups rows are ranked by ranges and
        cut into blocks, and the last n - 1 rows of each block go before the next one, too, so no task sees all rows."""
        if groupby is not None:
            key, out, before = F.col(groupby) if isinstance(groupby, str) else groupby, self.df, None
        else:
            size = max(self.WINDOW_BLOCK, n)
            out = ranked(self.df, F.col(FID), name="__pos")
            block = F.floor(F.col("__pos") / size)
            reaches = F.when(F.col("__pos") % size >= size - (n - 1), F.array(block, block + 1)).otherwise(F.array(block))
            out = out.withColumn("__block", F.explode(reaches))
            key, before = F.col("__block"), F.col("__block") != block
        w = Window.partitionBy(key).orderBy(*([F.col(FID)] if before is None else [F.col("__pos")])).rowsBetween(-(n - 1), 0)
        old = {f: F.col(f"__old_{f}") for f, _, _ in mapping if f in self.df.columns}
        for f in old:
            out = out.withColumn(f"__old_{f}", F.col(f))
        made = []
        for f, v, s in mapping:
            value = old.get(v, stats.value_of(v)) if isinstance(v, str) else stats.value_of(v)
            made.append((f, self._window_stat(s, value, w)))
        for f, c in made:
            out = out.withColumn(f, c)
        out = out.where(~before).drop("__pos", "__block") if before is not None else out
        return self.new(out.drop(*(f"__old_{f}" for f in old)))

    @staticmethod
    def _window_stat(name, value: Column, w) -> Column:
        v = stats.missing_as_null(value)
        if name == "first":
            return F.first(v, ignorenulls=True).over(w)
        if name == "last":
            return F.last(v, ignorenulls=True).over(w)
        if name in ("majority", "minority") or isinstance(name, str) and name.endswith("concat"):
            held = F.collect_list(v).over(w)
            if name.endswith("concat"):
                return F.when(F.size(held) > 0, F.array_join(F.transform(held, lambda x: x.cast("string")), name[: -len("concat")]))
            sign = -1 if name == "majority" else 1
            counted = F.transform(F.array_distinct(held), lambda x: F.struct((sign * F.size(F.filter(held, lambda y: y == x))).alias("n"), x.alias("v")))
            return F.array_min(counted)["v"]
        if callable(name):
            return name(value).over(w)
        if name == "count":
            return F.nullif(F.count(v).over(w), F.lit(0))
        return stats.NUMERIC[name](stats.number(value)).over(w)

    # Joins and set operations

    def join(self, other: FeatureFrame, key, keepall: bool = True, collapse: bool = False, mapping: Mapping = ()) -> FeatureFrame:
        """Attribute join, left outer unless keepall is False. key: a name, names, or (left Column, right Column). Null keys meet null keys. Fields of the
        right side that share a name go. With collapse the right side first becomes one row for each key (the first value of each of its own
        fields, or as the mapping says)."""
        left_keys, right_keys = (key if isinstance(key, tuple) and len(key) == 2 and any(isinstance(k, Column) for k in key) else (key, key))
        listed = lambda k: [k] if isinstance(k, str | Column) else list(k)
        columns = lambda ks: [F.col(k) if isinstance(k, str) else k for k in listed(ks)]
        named = {k for k in listed(right_keys) if isinstance(k, str)}
        own = [f for f in other.fields if f not in self.fields and f not in named]
        right = other
        if collapse:
            given = {n for n, _, _ in mapping}
            rows = other.df.select("*", *(c.alias(f"__r{i}") for i, c in enumerate(columns(right_keys))))
            names = [f"__r{i}" for i in range(len(columns(right_keys)))]
            chosen = [(f, f, "first") for f in own if f not in given] + [m for m in mapping if m[0] not in self.fields]
            right_df = FeatureFrame(rows).aggregate_df(names, chosen)
            own = [n for n, _, _ in chosen]
        else:
            right_df = right.df.select(*(c.alias(f"__r{i}") for i, c in enumerate(columns(right_keys))), *own, F.col(FID).alias("__rfid"))
        left = self.df.select("*", *(c.alias(f"__l{i}") for i, c in enumerate(columns(left_keys))))
        on = [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(columns(left_keys)))]
        out = left.join(right_df, on, "left" if keepall else "inner")
        return self.new(out.select(*self.fields, *own, FID, GEOM))

    def merge(self, *others: FeatureFrame) -> FeatureFrame:
        """All rows of all frames, by field name, in order; text fields that a frame lacks are '', others null."""
        frames = [self, *others]
        kinds = {f: x.df.schema[f].dataType for x in reversed(frames) for f in x.fields}
        fields = list(dict.fromkeys(f for x in frames for f in x.fields))
        rows = []
        for i, x in enumerate(frames):
            lacking = lambda f, x=x: F.col(f).cast(kinds[f]) if f in x.fields else F.lit("" if isinstance(kinds[f], T.StringType) else None).cast(kinds[f])
            rows.append(x.df.select(*(lacking(f).alias(f) for f in fields), GEOM, F.lit(i).alias("__i"), F.col(FID).alias("__f")))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return self.new(with_fid(out, "__i", "__f").drop("__i", "__f"))

    # Descriptions

    def has_geometry(self) -> bool:
        return not self.df.where(F.col(GEOM).isNotNull()).isEmpty()

    def bbox(self) -> DataFrame:
        """One row with xmin, ymin, xmax, ymax; all null without geometries."""
        b = F.col(f"{GEOM}.bbox")
        return self.df.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))

    def field_values(self, field: str) -> DataFrame:
        return self.df.select(field).distinct().orderBy(field)

    def field_type(self, field: str) -> str:
        """int, float or text, of the values that are not missing."""
        r = self.df.agg(*_type_of(field)).first()
        return _type_name(r[0], r[1])

    def describe(self) -> DataFrame:
        """A row for each field: its type, and how many values are there and missing."""
        aggs = []
        for f in self.fields:
            v = stats.missing_as_null(F.col(f"`{f}`"))
            a, b = _type_of(f)
            aggs.append(F.struct(F.lit(f).alias("field"), F.when(~F.coalesce(a, F.lit(True)), "text").when(~F.coalesce(b, F.lit(True)), "float").otherwise("int").alias("type"), F.count(v).alias("valid"), (F.count("*") - F.count(v)).alias("missing"), F.round(100 * (F.count("*") - F.count(v)) / F.count("*"), 6).alias("missing_percent")))
        return self.df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")

    def summarystats(self, *fields: str) -> DataFrame:
        """A row for each field: numbers, their least, largest and mean; nulls for text."""
        aggs = []
        for f in fields or self.fields:
            v = stats.number(F.col(f"`{f}`").cast("string"))
            aggs.append(F.struct(F.lit(f).alias("field"), F.count(v).alias("obs"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")))
        return self.df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")

    def tab(self, field: str) -> DataFrame:
        """value, frequency and percent of all rows."""
        per = self.df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("frequency"))
        total = self.df.agg(F.count("*").alias("__n"))
        return per.join(F.broadcast(total)).select("value", "frequency", (100 * F.col("frequency") / F.col("__n")).alias("percent"))

    def histogram(self, field: str, bins: int = 10) -> DataFrame:
        """Equal intervals [lo, hi), the last one closed, with counts; empty intervals are there."""
        v = stats.number(F.col(field))
        edge = self.df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
        width = (F.col("b") - F.col("a")) / bins
        number = F.least(F.lit(bins - 1), F.floor((v - F.col("a")) / F.nullif(width, F.lit(0.0)))).cast("int")
        counted = self.df.join(F.broadcast(edge)).where(v.isNotNull()).groupBy(F.coalesce(number, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
        frame = edge.where("a IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", width.alias("w"))
        return frame.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    # Bounding boxes

    def quick_overlap(self, bbox: tuple[float, float, float, float]) -> FeatureFrame:
        x1, y1, x2, y2 = min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])
        return self.new(self.df.where(G.overlaps_bbox(F.col(GEOM), x1, y1, x2, y2)))

    def quick_disjoint(self, bbox: tuple[float, float, float, float]) -> FeatureFrame:
        """What does not overlap, features without geometry included."""
        x1, y1, x2, y2 = min(bbox[0], bbox[2]), min(bbox[1], bbox[3]), max(bbox[0], bbox[2]), max(bbox[1], bbox[3])
        return self.new(self.df.where(F.coalesce(~G.overlaps_bbox(F.col(GEOM), x1, y1, x2, y2), F.lit(True))))

    def quick_nearest(self, *place: float | tuple, n: int = 1) -> FeatureFrame:
        """The n features whose bboxes are nearest to a point (x, y) or to a bbox, the nearest first; overlapping ones are at distance 0."""
        place = place[0] if len(place) == 1 else place
        if len(place) == 3:  # x, y, n
            *place, n = place
        x1, y1, x2, y2 = (*place, *place) if len(place) == 2 else (min(place[0], place[2]), min(place[1], place[3]), max(place[0], place[2]), max(place[1], place[3]))
        b = F.col(f"{GEOM}.bbox")
        dx = F.greatest(b["xmin"] - float(x2), float(x1) - b["xmax"], F.lit(0.0))
        dy = F.greatest(b["ymin"] - float(y2), float(y1) - b["ymax"], F.lit(0.0))
        return self.new(self.df.where(F.col(GEOM).isNotNull()).orderBy(F.sqrt(dx * dx + dy * dy), FID).limit(n))

    def point_geometry(self, xfield: str, yfield: str) -> FeatureFrame:
        return self.new(self.df.withColumn(GEOM, G.point(F.col(xfield).try_cast("double"), F.col(yfield).try_cast("double"))), geometry_type="Point")


def _parsed(text: str | None) -> dict | None:
    """The geometry struct of a GeoJSON text, on the driver; None where from_geojson gives null."""
    try:
        shape = json.loads(text or "null")
        kind, c = shape["type"], shape["coordinates"]
        parts = {"Point": lambda: [[[c]]], "MultiPoint": lambda: [[[p]] for p in c], "LineString": lambda: [[c]], "MultiLineString": lambda: [[r] for r in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}[kind]()
        out = kernels.struct(kind.removeprefix("Multi"), [[[(v[0], v[1]) for v in r] for r in p] for p in parts])
        return out and out | {"multi": kind.startswith("Multi")}
    except (ValueError, KeyError, TypeError):
        return None


def _kind(values: list) -> str:
    seen = {type(v) for v in values if v is not None}
    return "boolean" if seen == {bool} else "long" if seen and seen <= {int, bool} else "double" if seen and seen <= {int, float} else "string"


def _type_of(field: str) -> tuple[Column, Column]:
    v = stats.missing_as_null(F.col(f"`{field}`"))
    n = v.cast("string").try_cast("double")
    return F.bool_and(F.when(v.isNotNull(), n.isNotNull())), F.bool_and(F.when(n.isNotNull(), n == F.floor(n)))


def _type_name(numeric, integral) -> str:
    return "text" if numeric is False else "float" if integral is False else "int"
