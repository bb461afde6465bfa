"""Golden values of text functions, and the split rule against its step-by-step reading."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions import text as tx
from inkmill.operators import chunks


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_clean_text(spark):
    cases = {
        "第 1 章 总则 , 附 则": "第1章 总则，附 则",
        "%预算 12.5 亿": "12.5%预算 亿",
        "增长%约3.4": "增长3.4%约",
        "a  b\tc": "a b c",
        "Ωmega ё test é": "mega test é",
        "增长 5 % 中文 abc 测试,下一 句 。 2026 年": "增长5 2026%中文abc测试，下一 句。年",
        "": "",
    }
    assert column(spark, cases, tx.clean_text) == list(cases.values())
    assert column(spark, ["Ωmega", None], lambda c: tx.clean_text(c, foreign=False)) == ["Ωmega", None]


def test_estimate_tokens(spark):
    cases = {"": 0, "hello world": 3, "预算2026": 3, "ひらがな": 4, "　 ": 1, "abc。": 2}
    assert column(spark, cases, tx.estimate_tokens) == list(cases.values())


def test_percent_order(spark):
    cases = {"增长%约3.4": "增长3.4%约", "占比%12": "占比12%", "5%增长3": "5%增长3"}
    assert column(spark, cases, tx.fix_percent_order) == list(cases.values())


def test_predicates(spark):
    assert column(spark, ["好。", "好", "", "a? ", " 　"], tx.ends_sentence) == [True, False, True, True, True]
    assert column(spark, ["好」", "a?", "好"], tx.line_ends_sentence) == [True, False, False]
    assert column(spark, ["（一）总则", "1. x", "第一章", "（一）好。"], tx.is_sub_heading) == [True, True, False, False]
    assert column(spark, ["  1、x", "第二条 x", "——x", "12月", "abc"], tx.is_list_item) == [True, True, True, True, False]
    assert column(spark, ["第一条 x", "（1）x", "3)x", "3)4"], tx.is_line_list_item) == [False, True, True, False]
    assert column(spark, ["4920.1亿", "1. 总", "第三节", "一是好", "●x"], tx.starts_paragraph) == [False, True, True, True, True]
    assert column(spark, ["— 3 —", "3", "x — 3 —"], tx.is_page_number) == [True, False, False]
    assert column(spark, ["2026 年2 月3 日印", "秘书处", "x" * 81 + "秘书处", "x"], tx.is_end_matter) == [True, True, False, False]
    assert column(spark, ["省级—  5  —洁净城市"], tx.drop_page_numbers) == ["省级洁净城市"]
    assert column(spark, ["目   录", "x"], lambda c: tx.contains_keyword(c, ["目 录"])) == [True, False]
    assert column(spark, ["0", "2", "7", "x", None], tx.title_level) == [0, 1, 2, 1, 1]
    assert column(spark, ["—", "12", "123", "ab"], tx.is_fragment) == [True, True, False, False]


def weight(c):
    import re

    return 4 if re.match(tx.WIDE.replace(r"\x{", "\\U").replace("}", "") if False else "[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯ᄀ-ᇿ　-〿＀-￯]", c) else 0 if c.isspace() else 1


def split_brute(text, most):
    """Read step by step: take characters until they overflow, then cut at the last sentence end or right there."""
    parts = []
    while text:
        if sum(map(weight, text)) <= 4 * most:
            parts.append(text)
            break
        total, end = 0, 0
        for i, c in enumerate(text):
            total += weight(c)
            if total > 4 * most:
                break
            if c in chunks.SENTENCE_BREAKS or c == "\n" and text[i + 1 : i + 2] == "\n":
                end = i + 1
        cut = end or max(1, i)
        parts.append(text[:cut])
        text = text[cut:]
    return [p.strip() for p in parts if p.strip()]


@pytest.mark.parametrize("most", [5, 2, 4, 7, 100, 512])
def test_split_by_rules(spark, sf, most):
    golden = {5: ("一二三。四五六七八", ["一二三。", "四五六七八"]), 2: ("aaaa bbbb cccc dddd", ["aaaa bbbb", "cccc dddd"]), 4: ("一二三！四五；六七八九", ["一二三！", "四五；", "六七八九"])}
    texts = ["", "一二，三四五六七八", "a\n\nb。c", "x" * 3000, "好！" * 50, *(golden[most][:1] if most in golden else ())]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).select("text").collect()]
    got = column(spark, texts, lambda c: chunks.split_by_rules(c, most))
    assert got == [split_brute(t, most) for t in texts]
    if most in golden:
        assert got[5] == golden[most][1]
    for t, parts in zip(texts, got, strict=True):
        assert "".join("".join(parts).split()) == "".join(t.split())
        assert all(math.ceil(sum(map(weight, p)) / 4) <= most for p in parts)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_split_by_rules_on_short_limits(spark, most):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab一 \n\n。!;") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert column(spark, texts, lambda c: chunks.split_by_rules(c, most)) == [split_brute(t, most) for t in texts]


def test_split_by_rules_goes_by_sentences(spark):
    """The fold has a step for each sentence, and for each part of one that is too long, not for each character."""
    texts = ["abc def ghi。" * 1000, "x" * 3000, "a。" + "x" * 3000 + "。b"]
    assert column(spark, texts, lambda c: F.size(chunks._sentences(c, 512, chunks.SENTENCE_BREAKS))) == [1001, 2, 4]
