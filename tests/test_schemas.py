from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paceline import schemas
from tests import makers as m


def test_conform_orders_casts_and_versions(spark):
    df = m.frame(spark, "daily_features", [m.feature()])
    loose = df.select(*reversed(df.columns)).withColumn("vix_level", F.lit(20))
    out = schemas.conform(loose, "daily_features")
    assert out.columns == schemas.schema("daily_features").names
    row = out.first()
    assert row["vix_level"] == 20.0 and isinstance(row["vix_level"], float)
    assert row[schemas.VERSION_COLUMN] == 1


@pytest.mark.parametrize("table", list(schemas.KEYS))
def test_layouts_have_their_keys(table):
    assert set(schemas.KEYS[table]) <= set(schemas.required_columns(table))


def test_missing_and_extra_columns_raise(spark):
    df = m.frame(spark, "daily_features", [m.feature()])
    with pytest.raises(schemas.SchemaError, match="missing.*vix_level"):
        schemas.conform(df.drop("vix_level"), "daily_features")
    with pytest.raises(schemas.SchemaError, match="extra.*bogus"):
        schemas.conform(df.withColumn("bogus", F.lit(1)), "daily_features")


def test_version_belongs_to_the_library(spark):
    df = m.frame(spark, "daily_features", [m.feature()])
    unset = df.withColumn(schemas.VERSION_COLUMN, F.lit(None).cast("int"))
    assert schemas.conform(unset, "daily_features").first()[schemas.VERSION_COLUMN] == 1
    with pytest.raises(schemas.SchemaError, match="set by the library"):
        schemas.conform(df.withColumn(schemas.VERSION_COLUMN, F.lit(1)), "daily_features")


def test_text_that_is_no_number_fails(spark):
    df = m.frame(spark, "daily_features", [m.feature()]).withColumn("vix_level", F.lit("high"))
    with pytest.raises(PySparkException):
        schemas.conform(df, "daily_features").collect()


def test_reading_tolerates_extra_but_not_missing(spark):
    df = schemas.conform(m.frame(spark, "outcomes", [m.outcome()]), "outcomes")
    assert schemas.check_readable(df.withColumn("later", F.lit(1)), "outcomes").columns == df.columns
    with pytest.raises(schemas.SchemaError, match="lacks.*meta_score"):
        schemas.check_readable(df.drop("meta_score"), "outcomes")


def test_zone_less_time_is_refused(spark):
    df = m.frame(spark, "decisions", [m.decision()])
    naive = df.withColumn("decided_at_utc", F.col("decided_at_utc").cast("timestamp_ntz"))
    with pytest.raises(schemas.SchemaError, match="zone-aware"):
        schemas.conform(naive, "decisions")
