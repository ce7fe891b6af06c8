"""Text codecs as column expressions, and the scans built on them.

Record forms: timed ``t/f1,f2,...``; untimed ``f1,f2,...``; example ``[out ]in[ weight]`` whose
tokens are dense (``1,2,3``) or sparse, 1-based (``1:0.5,7:2``); labelled CSV ``f1,...,fd,class``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- codecs -------------------------------------------------------------------------------


def parse_dense(text, sep: str = ",") -> Column:
    return F.transform(F.split(_c(text), f"\\Q{sep}\\E"), lambda s: F.trim(s).cast("double"))


def format_dense(x, sep: str = ",") -> Column:
    return F.array_join(F.transform(_c(x), lambda v: v.cast("string")), sep)


def parse_sparse(text) -> Column:
    """``i:v,i:v`` with 1-based i to MAP<INT,DOUBLE> with 0-based keys."""
    entries = F.transform(
        F.split(_c(text), ","),
        lambda e: F.struct(
            (F.trim(F.split(e, ":")[0]).cast("int") - 1).alias("key"),
            F.trim(F.split(e, ":")[1]).cast("double").alias("value")))
    return F.map_from_entries(entries)


def format_sparse(m) -> Column:
    pairs = F.array_sort(F.map_entries(_c(m)))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(
            (e["key"] + 1).cast("string"), F.lit(":"), e["value"].cast("string"))), ",")


def format_timed(t, x) -> Column:
    return F.concat(_c(t).cast("string"), F.lit("/"), format_dense(x))


def parse_timed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``t/f1,f2,...`` to (t BIGINT, x ARRAY<DOUBLE>); other columns are kept."""
    parts = F.split(F.col(value), "/")
    return lines.withColumns({"t": F.trim(parts[0]).cast("long"), "x": parse_dense(parts[1])}).drop(value)


def parse_untimed(lines: DataFrame, value: str = "value", sep: str = ",") -> DataFrame:
    return lines.withColumn("x", parse_dense(F.col(value), sep)).drop(value)


def parse_examples(lines: DataFrame, value: str = "value",
                   in_kind: str = "dense", out_kind: str = "dense") -> DataFrame:
    """One to three blank-separated tokens: in | out in | out in weight."""
    codecs = {"dense": parse_dense, "sparse": parse_sparse}
    tokens = F.split(F.trim(F.col(value)), "\\s+")
    size = F.size(tokens)
    source = F.when(size == 1, tokens[0]).otherwise(F.get(tokens, F.lit(1)))
    target = F.when(size > 1, tokens[0])
    return lines.withColumns({
        "x": codecs[in_kind](source),
        "y": codecs[out_kind](target),
        "weight": F.when(size > 2, F.get(tokens, F.lit(2)).cast("double")).otherwise(F.lit(1.0)),
    }).drop(value)


# ---- labelled CSV ---------------------------------------------------------------------------


def labelled_rows(lines: DataFrame, width: int, *, value: str = "value", sep: str = ",",
                  has_class: bool = True, n_classes: int = 25, on_bad: str = "raise") -> DataFrame:
    """(x, class) from labelled lines; blank lines and lines starting with % or @ are skipped.

    ``width`` counts all fields of a line.  Without a class field the class is 0.  Bad rows
    (wrong cardinality, class outside 0..n_classes-1) stop the job, or are left out with
    ``on_bad='drop'`` (see :func:`bad_labelled_rows`).
    """
    split = _labelled_split(lines, width, value, sep, has_class, n_classes)
    if on_bad == "drop":
        split = split.filter("bad IS NULL")
    elif on_bad == "raise":
        split = split.withColumn("fields", F.when(F.col("bad").isNull(), F.col("fields")).otherwise(
            F.raise_error(F.concat(F.lit("bad labelled row: "), F.col("bad"))).cast("array<string>")))
    else:
        raise ValueError(f"on_bad must be 'raise' or 'drop', not {on_bad!r}")
    n_features = width - 1 if has_class else width
    features = F.transform(F.slice("fields", 1, n_features), lambda s: F.trim(s).cast("double"))
    label = F.trim(F.col("fields")[width - 1]).cast("double").cast("int") if has_class else F.lit(0)
    return split.withColumns({"x": features, "class": label}).drop("fields", "bad", value)


def bad_labelled_rows(lines: DataFrame, width: int, *, value: str = "value", sep: str = ",",
                      has_class: bool = True, n_classes: int = 25) -> DataFrame:
    """Quarantine twin of :func:`labelled_rows`: the offending lines and why."""
    split = _labelled_split(lines, width, value, sep, has_class, n_classes)
    return split.filter("bad IS NOT NULL").drop("fields")


def _labelled_split(lines, width, value, sep, has_class, n_classes):
    text = F.trim(F.col(value))
    fields = F.split(text, f"\\Q{sep}\\E")
    bad = F.when(F.size(fields) != width, F.concat(F.lit("cardinality "), F.size(fields).cast("string")))
    if has_class:
        label = F.trim(F.get(fields, F.lit(width - 1))).cast("double")
        bad = bad.when(label.isNull() | (label < 0) | (label >= n_classes), F.lit("class out of range"))
    return (lines.filter((text != "") & ~text.startswith("%") & ~text.startswith("@"))
            .withColumns({"fields": fields, "bad": bad}))


def infer_width(lines: DataFrame, value: str = "value", sep: str = ",") -> int:
    """Number of fields of the first data line."""
    text = F.trim(F.col(value))
    row = (lines.filter((text != "") & ~text.startswith("%") & ~text.startswith("@"))
           .select(F.size(F.split(text, f"\\Q{sep}\\E")).alias("w")).first())
    if row is None:
        raise ValueError("no data line")
    return row["w"]


# ---- nominal features -----------------------------------------------------------------------


def nominal_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, idx): distinct values numbered in their natural order."""
    from tidepool.operators.rows import number_rows

    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return number_rows(values, ["value"], "idx")


def nominal_to_index(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    names = dictionary.select(F.col("value").alias(column), F.col("idx").alias(out))
    return df.join(names, column, "left")


def index_to_nominal(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    names = dictionary.select(F.col("idx").alias(column), F.col("value").alias(out))
    return df.join(names, column, "left")
