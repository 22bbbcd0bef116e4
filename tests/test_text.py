import pyarrow as pa
from pyspark.sql import functions as F

from skein.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_meaningful(spark):
    cases = {"hello there": True, "": False, None: False, "Reacted to it": False, "Liked a photo": False, "Bo sent an attachment.": False, "Tapback x": False, "http://a.b": False, "http://a.b see this one": True}
    for body, want in cases.items():
        assert one(spark, T.meaningful(F.col("b"), F.lit(None).cast("string")), b=body) is want, body
    assert one(spark, T.meaningful(F.col("b"), F.lit("image")), b="hi") is False


def test_repair_never_fails(spark):
    assert one(spark, T.repair(F.col("b")), b="CafÃ©") == "Café"
    assert one(spark, T.repair(F.col("b")), b="café") == "caf�"
    assert one(spark, T.repair(F.col("b")), b="plain") == "plain"


def test_word_match(spark):
    for body, want in {"saw it in imax": True, "the climax": False, "see http://imax.example now": False, "IMAX!": True}.items():
        assert one(spark, T.word_match(F.col("b"), "imax"), b=body) is want, body


def test_hash_is_java_like(spark):
    assert one(spark, T.rolling_hash(F.col("b")), b="hello") == 99162322
    assert one(spark, T.rolling_hash(F.col("b")), b="polygenelubricants") == -2147483648


def test_distance(spark):
    km = one(spark, T.haversine(F.col("a"), F.col("b"), F.lit(-37.81), F.lit(144.96)), a=-33.87, b=151.21)
    assert 700 < km < 730


def test_markers_and_forms(spark):
    assert one(spark, T.marker(F.col("b")), b="I’m here") is True
    assert one(spark, T.marker(F.col("b")), b="my homework") is False
    assert sorted(one(spark, T.name_forms(F.col("b")), b="Maya Torres")) == ["maya", "maya torres"]
    assert one(spark, T.name_forms(F.col("b")), b="+15550100100") == []
    assert sorted(one(spark, T.name_forms(F.col("b")), b="Ann❤Lee")) == ["ann", "ann lee"]
    assert one(spark, T.name_forms(F.col("b")), b="7of9") == [] and one(spark, T.name_forms(F.col("b")), b="Jo") == []
    assert one(spark, T.marker(F.col("b")), b="i‘m here") is True


def test_footers_and_quotes(spark):
    assert one(spark, T.strip_footers(F.col("b")), b="ok\nTapbacks:\nLiked by Bo") == "ok"
    assert one(spark, T.normal_quote(F.col("b")), b="“It’s  fine” –") == "\"it's fine\" -"


def test_round_half_up(spark):
    assert one(spark, T.round_half_up(F.col("a")), a=-2.5) == -2.0
    assert one(spark, T.round_half_up(F.col("a")), a=2.5) == 3.0


def test_url_keys_are_one_line(spark):
    import base64

    for n in (1, 56, 57, 58, 200):
        url = ("https://a.example/?~" * 20)[:n]
        assert one(spark, T.url_key(F.col("b")), b=url) == base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


def test_long_texts_are_repaired_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("CafÃ© "), 200_000).alias("t"))
    repaired = long.select(T.repair(F.col("t")).alias("r"))
    sizes = F.arrow_udf(lambda t: pa.array([len(t)] * len(t), pa.int64()), "long")
    assert repaired.agg(F.count_if(F.col("r") == F.repeat(F.lit("Café "), 200_000))).first()[0] == 40
    assert long.select(sizes("t").alias("n")).agg(F.max("n")).first()[0] < 12
