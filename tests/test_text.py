from pyspark.sql import functions as F

from passagework.functions import stemming
from passagework.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_terms(spark):
    t = F.col("t")
    assert " ".join(one(spark, T.terms(t), t="Lena's R2-D2 kit (v3.5) cost €40; o'clock")) == "lena r2 d2 kit v3 5 cost 40 o clock"
    assert one(spark, T.terms(t), t=None) == []
    assert one(spark, T.terms(t, True), t="An owl is on the barn") == ["owl", "barn"]
    assert one(spark, T.terms(t), t="été l’été snake_case") == ["été", "l", "été", "snake", "case"]


def test_headers(spark):
    stamp = F.try_to_timestamp(F.col("d"))
    title, source = F.col("t"), F.col("s")
    assert one(spark, T.header(title, source, stamp), t="Who?", s="Wire", d="2023-10-07T23:30:00+00:00") == "Who?. Wire, October 7, 2023."
    assert one(spark, T.prompt_header(title, source, stamp), t="Who?", s="Wire", d="2023-10-07") == "Who? Wire, October 7, 2023."
    assert one(spark, T.header(title, source, stamp), t=None, s="Wire", d="soon") == "Wire."
    assert one(spark, T.header(title, source, stamp), t=None, s=None, d=None) == ""


def test_answers(spark):
    a, r = F.col("a"), F.col("r")
    assert one(spark, T.match_verdict(a, r), a="The Orchard, Inc!", r="orchard inc") is True
    assert one(spark, T.match_verdict(a, r), a="Insufficient information.", r="yes") is False
    assert one(spark, T.match_verdict(a, r), a="Yes", r="No") is False
    assert one(spark, T.match_verdict(a, r), a="Orchard, as far as the papers say.", r="no") is None
    assert one(spark, T.is_abstention(a), a="Some say so. Insufficient information.", r="") is True


def test_replies(spark):
    line = F.col("x")
    for raw, clean in (("1. Who won?", "Who won?"), ("- “Quoted”", "Quoted"), ("Query 2: what", "what"), ("Q3) where", "where"), ("plain", "plain")):
        assert one(spark, T.clean_line(line), x=raw) == clean
    assert one(spark, T.verdict(line, "yes", "no"), x='ok {"verdict": " YES "} end') is True
    assert one(spark, T.verdict(line, "yes", "no"), x="nothing") is None


def test_stems(spark):
    known = {"glasses": "glass", "berries": "berri", "decreed": "decre", "planned": "plan", "educational": "educ", "civilization": "civil", "playfulness": "play", "invention": "invent", "dry": "dry", "hiding": "hide", "installing": "instal", "on": "on", "feed": "feed", "sized": "size", "troubled": "troubl", "boss": "boss", "cities": "citi", "electrical": "electr", "falling": "fall", "rates": "rate", "employment": "employ"}
    got = stemming.stems(spark.createDataFrame([(w,) for w in [*known, "dry", None]], "term string"))
    assert {r["term"]: r["stem"] for r in got.collect()} == known
