from pyspark.sql import functions as F

from quire.functions import text as T


def column(spark, rule, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(rule(F.col("v"))).collect()]


def test_names_and_paths(spark):
    assert column(spark, T.path_page_hint, "a/x_p12_1.png", "slide07.png", "第页3.png", "img_0045.png", "x.png", None) == [12, 7, 3, 45, None, None]
    assert column(spark, lambda c: T.safe_path(c, ("assets/", "media/")), "assets/a.png", "assets/../b", "/assets/a", "C:\\a", "other/a", None) == [True, False, False, False, False, False]
    names = ["t10.md", "t9.md", "T1.md", "a2.md"]
    keys = column(spark, T.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names))] == ["a2.md", "T1.md", "t9.md", "t10.md"]
    long = ["n" + "9" * 25 + ".md", "n1" + "0" * 25 + ".md", "n007.md", "n8.md"]
    assert [n for _, n in sorted(zip(column(spark, T.natural_key, *long), long))] == ["n007.md", "n8.md", "n" + "9" * 25 + ".md", "n1" + "0" * 25 + ".md"]
    roots = ("assets/images/", "assets/tables/")
    assert column(spark, lambda c: T.media_path(c, roots), "./Assets/Images/a.png", "\\srv\\assets\\tables\\b.md", "assets/c.png", "x/d.png", "", None) == ["assets/images/a.png", "assets/tables/b.md", "assets/images/assets/c.png", "", "", ""]
    assert column(spark, T.label, "a\\B_007-x.PNG", "007.md", None) == ["b7x", "7", ""]
    assert column(spark, T.slug, " a b/é-中 ", "", None, "__") == ["a_b_é-中", "document", "document", "document"]


def test_numbers_and_texts(spark):
    assert column(spark, T.first_int, "-3", "1.5", "第12页", "x", None, "9000000000") == [3, 1, 12, 0, 0, 9_000_000_000]
    assert column(spark, T.paragraph_text, "a\r\n\r\n\r\n\r\nb  ", None) == ["a\n\nb", ""]
    assert column(spark, T.low_quality, "", "123456", "中文内容很多 12", "abc") == [True, True, False, False]
    assert column(spark, T.clean_keywords, "1. a b；- c，c,x、dd。", "ERROR x", "") == ["a b、dd", "ERROR x", ""]
