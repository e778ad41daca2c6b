"""How a step's error is named when several stages fail at once."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch.plans.journal import _kind


def test_stages_that_fail_at_once_are_named_by_the_first_and_quote_nothing(spark):
    with pytest.raises(PySparkException) as one:
        spark.range(3).select(F.raise_error(F.lit("secret"))).collect()
    jvm = spark.sparkContext._jvm
    several = jvm.java.lang.RuntimeException("secret", one.value._origin)
    assert _kind(Py4JJavaError("", several)) == "SparkRuntimeException: USER_RAISED_EXCEPTION"
    added = jvm.java.lang.RuntimeException("secret")
    added.addSuppressed(one.value._origin)
    assert _kind(Py4JJavaError("", added)) == "SparkRuntimeException: USER_RAISED_EXCEPTION"
    assert _kind(Py4JJavaError("", jvm.java.lang.RuntimeException("secret"))) == "Py4JJavaError: no condition"
