from pyspark.sql import functions as F

from maskloom.functions.matching import replace_matches


def test_each_match_is_replaced_by_a_computed_value(apply):
    def hashed(column):
        return replace_matches(column, "[0-9]+", lambda m: F.concat(F.lit("<"), F.length(m), F.lit(">")))

    texts = ["12a345", "a1", "1", "", "abc", None, "1\n22", "x\ufdd07\ufdd1"]
    assert apply(texts, hashed) == ["<2>a<3>", "a<1>", "<1>", "", "abc", None, "<1>\n<2>", "x\ufdd0<1>\ufdd1"]


def test_empty_matches_and_lookaround(apply):
    def marked(pattern):
        return lambda c: replace_matches(c, pattern, lambda m: F.concat(F.lit("["), m, F.lit("]")))

    assert apply(["k=;k=v;", "k="], marked("(?<=k=)[^;]*")) == ["k=[];k=[v];", "k=[]"]
    assert apply(["axb"], marked("x?")) == ["[]a[x][]b[]"]
    assert apply(["11 1"], marked("(?<!1)1(?!1)")) == ["11 [1]"]


def test_replacement_is_not_a_template(apply):
    assert apply(["a1"], lambda c: replace_matches(c, "1", lambda m: F.lit("$0\\\\1"))) == ["a$0\\\\1"]
