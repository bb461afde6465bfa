"""Sections packed by size against a plain loop."""

import random

from inkmill.operators import chunks, packing


def packs(items, hard, soft, small):
    sections, now = [], []
    size = lambda texts: sum(len(t) for t, _ in texts) + 2 * max(len(texts) - 1, 0)
    for t, h in items:
        if now and (h or size(now) >= soft or size(now) + 2 + len(t) > hard):
            sections.append(now)
            now = []
        now = [*now, (t, h)]
    sections += [now] if now else []
    out = []
    for s in sections:
        if out and size(out[-1]) < small and size(out[-1]) + 2 + size(s) <= hard:
            out[-1] = out[-1] + s
        else:
            out.append(s)
    made = []
    for p in out:
        heads, texts = [t for t, h in p if h], [t for t, h in p if not h]
        made.append((heads[0], heads[1:] + texts) if heads else (texts[0], texts[1:]))
    return made


def test_pack_sections(spark):
    rng = random.Random(3)
    docs = {d: [("x" * rng.choice([1, 5, 40, 90, 130]) + str(k), rng.random() < 0.25) for k in range(rng.randrange(1, 60))] for d in range(25)}
    rows = [(d, k, f" {t} ", h) for d, items in docs.items() for k, (t, h) in enumerate(items)] + [(99, 0, " ", True), (99, 1, None, False)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, text string, heading boolean")
    for limits in ((100, 80, 50), (1000, 800, 500)):
        got = {d: [] for d in docs}
        for r in packing.pack_sections(df, *limits).orderBy("doc_id", "pack").collect():
            got[r.doc_id].append((r.parent, r.bodies))
        assert got == {d: packs(items, *limits) for d, items in docs.items()}


def test_strategy(spark):
    df = spark.createDataFrame([(1, 0, "题", True), (1, 1, "甲。", False), (1, 2, "乙。", False)], "doc_id int, pos int, text string, heading boolean")
    assert [r.text for r in chunks.get_strategy("sections")(df).collect()] == ["***\n题\n<-split->\n甲。\n<-split->\n乙。\n<-split->"]
