import pytest

from obligor.operators import encoding
from obligor.session import COMPILED_BYTES

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture
def limit(spark):
    yield lambda value: spark.conf.set(LIMIT, value)
    spark.conf.set(LIMIT, COMPILED_BYTES)


def test_wide_encoding_leaves_no_method_to_the_interpreter(spark, limit):
    state = encoding.EncoderState(numeric=["id"], fills={"id": 0.0}, scales={"id": [1.0, 2.0]})
    limit("65535")
    encoding.encode(spark.range(3), state, True)
    assert spark.conf.get(LIMIT) == COMPILED_BYTES


def test_a_limit_of_the_user_is_kept(spark, limit):
    state = encoding.EncoderState(numeric=["id"], fills={"id": 0.0}, scales={"id": [1.0, 2.0]})
    limit("20000")
    encoding.encode(spark.range(3), state, True)
    assert spark.conf.get(LIMIT) == "20000"
