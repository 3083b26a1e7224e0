"""Column functions against the literal fixtures of FIXTURES.md."""

from pyspark.sql import functions as F

from drapery.functions import color as C
from drapery.functions import html as H
from drapery.functions import keys as K
from drapery.functions import rules as R
from drapery.functions import text as T


def one(spark, expr, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_title_case(spark):
    assert one(spark, T.title_case("x"), value="tie-dye o'neil") == "Tie-Dye O'Neil"
    assert one(spark, T.title_case("x"), value="forest green") == "Forest Green"


def test_sizes_and_waist(spark):
    df = spark.createDataFrame([(["XL", "S", "30", "SIZE", "2", "2", "xs"],)], "t array<string>")
    r = df.select(F.array_join(H.sizes("t"), "|").alias("s"),
                  F.array_join(H.waist_sizes("t", F.lit("Bottoms")), "|").alias("w")).first()
    assert r.s == "XS|S|XL|2" and r.w == "30"


def test_hex_family(spark):
    df = spark.createDataFrame([("#FF8800",), ("#C0C020",), ("",), ("xyz",), ("#0A0A0A",), ("2030C0",)], "h string")
    got = [x.r for x in df.select(C.color_family_of_hex("h").alias("r")).collect()]
    assert got == ["Orange", "Neutral", "Neutral", "Neutral", "Black", "Blue"]


def test_css_name(spark):
    df = spark.createDataFrame([("#000080",), ("C0C0C0",), ("#fff",), ("#123456",), ("xyz",)], "h string")
    got = [x.r for x in df.select(C.css_color_name("h").alias("r")).collect()]
    assert got == ["navy", "silver", "white", "Default", "Default"]


def test_srcset(spark):
    assert one(spark, K.parse_srcset("x"), value="a.jpg 1x, b.jpg 2x") == ["a.jpg", "b.jpg"]


def test_urls(spark):
    base = F.lit("https://shop.example.com")
    df = spark.createDataFrame([("//h/x",), ("/x",), ("x",), ("http://h/x?q",), ("",)], "u string")
    got = [r.r for r in df.select(K.normalize_image_url("u", base).alias("r")).collect()]
    assert got == ["https://h/x", "https://shop.example.com/x", "https://shop.example.com/x", "http://h/x", ""]
    got = [r.r for r in df.select(K.resolve_url("u", F.lit("https://a.com/dir/page?q=1")).alias("r")).collect()]
    assert got == ["https://h/x", "https://a.com/x", "https://a.com/dir/x", "http://h/x?q", "https://a.com/dir/page?q=1"]


def test_audience_word_vs_substring(spark):
    df = spark.createDataFrame([("Women's Yoga Jogger", ""), ("Men's Tank", ""), ("Garment", "")], "t string, c string")
    word = [r.a for r in df.select(R.audience("t", "c").alias("a")).collect()]
    lit = [r.a for r in df.select(R.audience("t", "c", match="substring").alias("a")).collect()]
    assert word == ["Women", "Men", "Women"]
    assert lit == ["Men", "Men", "Men"]   # Q1: literal code sends "women"/"garment" to Men


def test_slugify(spark):
    assert one(spark, T.slugify("x"), value="  Hello, World -- Tie Dye! ") == "hello-world-tie-dye"


def test_looks_like_price(spark):
    df = spark.createDataFrame([("$12",), ("12.00",), ("Navy",)], "x string")
    assert [r.r for r in df.select(T.looks_like_price("x").alias("r")).collect()] == [True, True, False]


def test_literal_modes(spark):
    from drapery.operators.records import standardize
    df = spark.createDataFrame([(["30", "2", "S"],)], "t array<string>")
    r = df.select(F.array_join(H.waist_sizes("t", F.lit("Bottoms")), "|").alias("i"),
                  F.array_join(H.waist_sizes("t", F.lit("Bottoms"), mode="literal"), "|").alias("l")).first()
    assert (r.i, r.l) == ("30", "")        # Q6: the coded rule never yields a waist size
    b = spark.createDataFrame([("False",)], "is_apparel string")
    assert standardize(b).first().is_apparel is False
    assert standardize(b, literal_bools=True).first().is_apparel is True   # Q16
