"""Row types of points and state tables."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

TIMED_POINT = T.StructType([
    T.StructField("t", T.LongType()),
    T.StructField("x", VECTOR),
])

EXAMPLE = T.StructType([
    T.StructField("x", VECTOR),
    T.StructField("y", VECTOR),
    T.StructField("weight", T.DoubleType()),
])

#: cluster feature: count, linear and squared sums of the vector and of the time
CLUSTER_FEATURE = [
    T.StructField("n", T.DoubleType()),
    T.StructField("ls", VECTOR),
    T.StructField("ss", VECTOR),
    T.StructField("lst", T.DoubleType()),
    T.StructField("sst", T.DoubleType()),
]

MICRO_CLUSTER = T.StructType([
    T.StructField("mc_id", T.LongType()),
    *CLUSTER_FEATURE,
    T.StructField("ids", T.ArrayType(T.LongType())),
])

#: decaying micro-cluster; kind 'p' potential, 'o' outlier; all sums are anchored at t_last
DECAYING_CLUSTER = T.StructType([
    T.StructField("mc_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("w", T.DoubleType()),
    T.StructField("ls", VECTOR),
    T.StructField("ss", VECTOR),
    T.StructField("t0", T.LongType()),
    T.StructField("t_last", T.LongType()),
])

GRID_CELL = T.StructType([
    T.StructField("cell", T.ArrayType(T.IntegerType())),
    T.StructField("density", T.DoubleType()),
    T.StructField("t_update", T.IntegerType()),
    T.StructField("t_removed", T.IntegerType()),
    T.StructField("attr", T.IntegerType()),
    T.StructField("changed", T.BooleanType()),
    T.StructField("cluster_id", T.ArrayType(T.IntegerType())),
])

CORESET = T.StructType([
    T.StructField("level", T.IntegerType()),
    T.StructField("x", VECTOR),
    T.StructField("weight", T.DoubleType()),
])

BATCH_METRICS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("processing_ms", T.LongType()),
    T.StructField("total_ms", T.LongType()),
])
