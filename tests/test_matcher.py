"""Region names in texts: the automaton and the join give what a search of each name gives."""

import pytest

from inkmill.operators import matcher

NAMES = [("石家庄市", "1301000"), ("石家庄", "1301000"), ("sjz", "1301000"), ("唐山", "1302000"), ("唐山市", "1302000"), ("山市", "9"), ("1304", "1304000"), ("", "0"), (None, "0"), ("唐山", "1302001")]
FILES = ["石家庄市预算报告.pdf", "SJZ_2026.pdf", "unknown.pdf", "唐山市石家庄", "x唐山唐山市", "区划1304年", None, "", "石家庄市预算报告.pdf"]


@pytest.mark.parametrize("most", [matcher.BROADCAST_NAMES, 0])
def test_match_regions(spark, most):
    files = spark.createDataFrame([(i, f, "kept") for i, f in enumerate(FILES)], "n int, filename string, row string")
    got = [(r.region_code, r.matched, r.n_names, r.row) for r in matcher.match_regions(files, spark.createDataFrame(NAMES, "name string, code string"), most=most).orderBy("n").collect()]
    want = [("1301000", "石家庄市", 2), ("1301000", "sjz", 1), (None, "manual_required", 0), ("1302000", "唐山市", 4), ("1302000", "唐山市", 3), ("1304000", "1304", 1), (None, "manual_required", 0), (None, "manual_required", 0), ("1301000", "石家庄市", 2)]
    assert got == [(*w, "kept") for w in want]
    none = spark.createDataFrame([], "name string, code string")
    assert {r.matched for r in matcher.match_regions(files, none, most=most).collect()} == {"manual_required"}


@pytest.mark.parametrize("most", [matcher.BROADCAST_NAMES, 0])
def test_find_names_is_a_search_of_each(spark, most):
    texts = [(1, "abcabcd bcd"), (2, "aaaa"), (3, None), (4, "cd"), (5, "x" * 2000 + "bcd")]
    names = ["abc", "bcd", "abcd", "aa", "a", "cd", "zz"]
    got = sorted(map(tuple, matcher.find_names(spark.createDataFrame(texts, "row long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), most).collect()))
    assert got == sorted((i, n, t.index(n) + 1) for i, t in texts if t for n in names if n in t)
