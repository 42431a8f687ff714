from pyspark.sql import functions as F

from quillspan.functions import text as T


def fnv(token):
    h = 2166136261
    for b in token.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "t string").select(*exprs).first()


def test_tokens_fold_and_reference(spark):
    got = one(spark, "La RAZÓN según Juan 10:6, 1 Corintios 3:16 y el año; con fe", T.tokenize(F.col("t")))[0]
    assert got == ["razon", "juan", "corintios", "año", "juan10v6", "1corintios3v16"]
    assert one(spark, None, T.tokenize(F.col("t")))[0] is None and one(spark, "", T.tokenize(F.col("t")))[0] == []


def test_fnv(spark):
    rows = spark.createDataFrame([(w,) for w in ("razon", "año", "x", "", "日本語")], "w string").select("w", T.fnv1a(F.col("w")).alias("h")).collect()
    assert all(r.h == fnv(r.w) for r in rows)


def test_scalars(spark):
    c = F.col("t")
    assert one(spark, "  a \n b\t", T.collapse(c))[0] == "a b"
    assert one(spark, "3725.9", T.clock(c.cast("double")))[0] == "1:02:05"
    assert one(spark, "Cap 12 — 3", T.normal_header(c))[0] == "CAP # — #"
    assert one(spark, "x" * 100, F.char_length(T.short_title(c)))[0] == 80
    assert one(spark, "1,234%", T.numeric_text(c))[0] is True and one(spark, "n/a", T.numeric_text(c))[0] is False
    assert one(spark, "Jesús  de-Nazaret", T.canonical_name(c))[0] == "jesus de nazaret"
    assert one(spark, "¿Qu%C3%A9?", T.suspect_encoding(c))[0] is True and one(spark, "100% seguro", T.suspect_encoding(c))[0] is False
    assert tuple(one(spark, "ñandú corre", T.quote_span(F.lit("corre"), c))[0]) == (8, 13)
    assert one(spark, "a b", T.quote_still_locates(F.lit(None).cast("string"), c))[0] is None
    assert spark.range(1).select(T.upper_median(F.array(F.lit(1), F.lit(9), F.lit(5), F.lit(7)))).first()[0] == 7


def test_exact_decomposition_of_every_character(spark):
    import unicodedata

    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows = ["".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + ["", None, "plain"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", r) if not unicodedata.combining(c)) if r is not None else None for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", T.decomposed(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == want
    names = spark.createDataFrame([("Ｃafé — Ἀθῆναι",), ("ﬁn  de siècle!",)], "t string").select(T.exact_name(F.col("t")).alias("t")).collect()
    assert [r.t for r in names] == ["cafe αθηναι", "fin de siecle"]
