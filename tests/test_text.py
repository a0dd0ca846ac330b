import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import layout as L
from quire.operators import protect as P
from quire.operators import translate as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Figure 3. A plot", "caption"), ("2.1 Methods and data", "heading"), ("108.10 MHz is the range of it", "body"), ("12 34 56", "data"), ("22.83 m", "data"), ("17", "data"),
        ("NATIONAL WEATHER SERVICE", "heading"), ("Abstract", "heading"), ("plain prose goes here in lower case", "body"), ("∑ α β ∫ = γ", "data"),
    ],
)
def test_block_types(spark, text, want):
    t = F.lit(text)
    score = T.math_score(t)
    got = B.block_type(t, size=F.lit(10.0), body=F.lit(10.0), top=F.lit(400.0), bottom=F.lit(410.0), page=F.lit(1), page_height=F.lit(800.0), bold=F.lit(False), nlines=F.lit(1), num_lines=F.lit(0), math=score, ref_zone=F.lit(False))
    assert value(spark, got) == want


def test_contact_lines(spark):
    for text, want in {"(405) 954-4831": True, "P.O. Box 25082": True, "Oklahoma City, OK 73125": True, "Please do call us any day at (405) 954-4831 for help": False, "": False, "x" * 70: False}.items():
        assert value(spark, T.is_contact(F.lit(text))) is want, text


def test_keys(spark):
    assert value(spark, T.match_key(F.lit("Signiﬁcant Œ 12!"))) == "significant12"
    assert value(spark, T.match_key_drop(F.lit("ﬁerectileﬂ"))) == "erectile"
    assert value(spark, T.caps_ratio(F.lit("SPJ"))) is None


def test_digits_survive(spark):
    def ok(v, out):
        return value(spark, T.digits_survive(F.array(*map(F.lit, v)), F.lit(out)))

    assert ok(["80 million"], "8,000万") and ok(["13.4"], "134億") and not ok(["17"], "27") and ok(["x"], "none") and not ok(["1234567"], "12")


@pytest.mark.parametrize(("text", "want"), [("on January 17, 2025 it", "2025年1月17日"), ("17 Jan 2025", "2025年1月17日"), ("December 2015", "2015年12月"), ("no date", None)])
def test_dates(spark, text, want):
    assert value(spark, T.english_date(F.lit(text))) == want
    if want:
        assert want in P.protect_text(text)["tokens"].values()


def test_protect():
    got = P.protect_text("See https://x.org/a and 71 million, 250 Hz on 17 January 2025 at a@b.org; 2Q26 ROE")
    assert got["masked"].count("⟦T") == len(got["tokens"]) >= 6
    assert "million" in got["masked"] and "71" in got["tokens"].values()
    assert P.protect_text(None) == {"masked": None, "tokens": {}}
    assert P.disjoint([(0, 3, "a"), (0, 5, "b"), (4, 6, "c"), (5, 7, "d")]) == [(0, 5, "b"), (5, 7, "d")]


def test_restore_and_placeholders(spark):
    df = spark.createDataFrame([("a ⟦T0⟧ b ⟦T1⟧", {"⟦T0⟧": "1", "⟦T1⟧": "2"})], "m string, t map<string,string>")
    assert df.select(T.restore(F.col("m"), F.col("t")).alias("v")).first().v == "a 1 b 2"
    assert value(spark, T.tighten_placeholders(F.lit("x ⟦T1⟧ y"))) == "x⟦T1⟧y"
    assert spark.createDataFrame([("⟦T1,2⟧ ⟦ T 3⟧",)], "s string").select(P.repair_digits(F.col("s")).alias("v")).first().v == "⟦T12⟧ ⟦T3⟧"


def test_join_lines(spark):
    def join(*lines):
        return value(spark, T.join_lines(F.array(*map(F.lit, lines))))

    assert join("an informa-", "tion desk") == "an information desk"
    assert join("see https://faa.gov/a/", "b c") == "see https://faa.gov/a/b c"
    assert join("one", "two") == "one two" and join("A-", "B") == "A- B"


def test_wrap_keeps_text_and_rules():
    for text in ("これは長い文です。とても長い、本当に。", "ASCII words stay whole wherever they can", "混ぜた text と日本語のfoobarbaz。", "", "a\nb", "x" * 200):
        for width in (20.0, 47.0, 100.0):
            lines = L.wrap(text, 10.0, width)
            assert "".join(lines) == text.replace("\n", "")
            if width == 100.0 and text[:5] == "ASCII":
                assert all(not (a and b and a[-1].isalnum() and b[0].isalnum()) for a, b in zip(lines, lines[1:], strict=False))
    assert all(x[0] not in L.NO_START for x in L.wrap("これは長い文です。とても長い、本当に。", 10.0, 50.0)[1:])


def test_memo_and_glossary(spark):
    units = spark.createDataFrame([(1, "The Quick fox"), (2, "Other"), (3, None)], "uid int, source string")
    memo = spark.createDataFrame([("The", "a"), ("The Quick", "b"), ("", "c")], "prefix string, ja string")
    assert {r.uid: r.ja for r in X.memo_prefix(units, memo).collect()} == {1: "b", 2: "", 3: ""}
    assert {r.uid: r.ja for r in X.memo_prefix(units, memo.limit(0)).collect()} == {1: "", 2: "", 3: ""}
    glossary = spark.createDataFrame([("quick", "q"), ("fo", "f")], "term string, ja string")
    assert X.glossary_hits(units, glossary).count() == 2 and X.glossary_hits(units, glossary, strict=True).count() == 1
    merged = X.merged_glossary(glossary, spark.createDataFrame([("fo", "F"), ("n", "N")], "term string, ja string"))
    assert {r.term: r.ja for r in merged.collect()} == {"quick": "q", "fo": "F", "n": "N"}


def test_translation_path(spark):
    units = spark.createDataFrame([(1, "Hello world ⟦T0⟧"), (2, "⟦T0⟧"), (3, "Unknown text"), (4, "   ")], "uid int, masked string")
    engine = X.MemoEngine({"Hello": "こんにちは⟦T0⟧"})
    cache = spark.createDataFrame([], "key string, target_masked string")
    out = X.translate_units(units, cache, engine)
    got = {r.uid: r.target_masked for r in out.collect()}
    assert got == {1: "こんにちは⟦T0⟧", 2: "⟦T0⟧", 3: None, 4: None}
    again = X.cached(units, X.updated_cache(cache, out), "memo")
    assert {r.uid: r.target_masked for r in again.collect()}[1] == "こんにちは⟦T0⟧"

    class Broken(X.Engine):
        name = "broken"

        def translate(self, texts):
            raise RuntimeError("down")

    assert X.translate_units(units, cache, Broken()).filter("target_masked is not null").count() == 1


def test_requests():
    assert X.split_response("⟪SEG1⟫\na\n⟪SEG2⟫\n(type: body)\nb", 2) == ["a", "b"]
    assert X.split_response("⟪SEG1⟫ a ⟪SEG1⟫ b", 2) is None and X.split_response("none", 1) is None
    assert X.request_text(["a", "b"]).count("⟪SEG") == 2


def test_misc(spark):
    assert value(spark, T.safe_filename(F.lit("../a b/c d.pdf"))) == "c_d.pdf"
    assert value(spark, T.client_ip(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9.9.9.9"))) == "1.2.3.4"
    assert value(spark, T.client_ip(F.lit(""), F.lit("9.9.9.9"))) == "9.9.9.9"
    assert value(spark, T.fix_glyphs(F.lit("a(cid:12)b"))) == "a-b•"
    e = value(spark, T.progress_event(F.lit("[editor] translated 3/10 units")))
    assert (e.role, e.done, e.total) == ("editor", 3, 10)
