import random

from ebbline.llm import line_dedup as ld
from tests.llm import fixtures


def cut(text):
    """Lines by reading characters one after the other; shares no code with the operator."""
    lines, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            lines.append(now)
            now, i = "", i + 1
            continue
        now, i = now + c, i + 1
        if c in ".!?…।॥؟۔։።。！？｡":
            j = i
            while j < len(text) and j < i + 2 and text[j] in "\"'”’»)]}）」』":
                j += 1
            wide = c in "。！？｡"
            while j > i and not wide and not (j < len(text) and text[j] in " \t\u00a0\u3000"):
                j -= 1
            if wide or (j < len(text) and text[j] in " \t\u00a0\u3000"):
                lines.append(now + text[i:j])
                while j < len(text) and text[j] in " \t\u00a0\u3000":
                    j += 1
                now, i = "", j
    return [x.strip() for x in [*lines, now] if x.split()]


def all_pairs(docs):
    """Lines that are left by comparing every pair: a line goes with a run of equal lines of five words or more."""
    known = [(i, cut(t)) for i, t in sorted(((i, t) for i, t in docs if i is not None and t is not None))]
    left = {}
    for k, (doc, own) in enumerate(known):
        gone = set()
        for other, lines in known[:k]:
            if other == doc or not set(own) & set(lines):
                continue
            places = {}
            for b, x in enumerate(lines):
                places.setdefault(x, []).append(b)
            runs = {}  # (place here, place there) of the last two equal lines -> begin and words of their run
            for a, x in enumerate(own):
                now = {}
                for b in places.get(x, ()):
                    begin, words = runs.get(b - 1, (a, 0))
                    now[b] = (begin, words + len(x.split()))
                    if now[b][1] >= 5:
                        gone.update(range(begin, a + 1))
                runs = now
        left[doc] = [x for n, x in enumerate(own) if n not in gone]
    return left


def test_cuts_and_alignment():
    text = "One two. Three four five. Six!\n\nSeven eight and. Nine"
    assert "".join(ld.lines_of(text)) == text
    assert ld.longest_increasing([3, 1, 2, 2, 5, 4]) in ([1, 2, 4], [1, 2, 5], [1, 3, 4], [1, 3, 5])
    # the crossing frequent line is left out, the rare anchors stay
    assert ld.align([(0, 5, 2), (1, 2, 9), (2, 6, 2), (3, 7, 9)]) == [0, 2, 3]
    assert ld.chains([(0, 5, 2), (1, 2, 9), (2, 6, 2), (3, 7, 9), (4, 3, 2)]) == [[0, 2, 3], [1, 4]]
    assert ld.blocks([(0, 0, 2), (1, 1, 2), (3, 2, 2), (4, 9, 2), (5, 10, 2)]) == [(0, 1), (2, 2), (3, 4)]
    # a block of two lines, a moved one and a repeated one, in the pairs with documents 7 and 9
    runs = [(0, 11, 7, 4, 2), (1, 12, 7, 5, 2), (2, 13, 9, 0, 3), (3, 11, 7, 4, 2), (5, 14, 7, 1, 2)]
    assert sorted(ld.aligned_blocks(runs, {(r[0], r[1]): r[0] + 1 for r in runs})) == [(7, 0, 2, 4), (7, 3, 4, 4), (7, 5, 6, 1), (9, 2, 3, 0)]


def test_against_sequential_code(spark):
    df, rows = fixtures.hard_documents(spark)
    passage = "This passage of many words stands in several documents. It has more than one line and goes on.\nIt even has a second line of its own with more words in it."
    more = [(200, f"{passage}\nOwn text here by the first."), (201, f"Other begin entirely.\n{passage}"), (202, f"Third one is different. {passage} And an own end."), (203, passage)]
    docs = [(r[0], r[1]) for r in rows] + more
    table = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, gone string, removed int")
    kept = ld.dedup_lines(table)
    found = [(r.d.doc_id, r.text, r.d.gone) for r in kept.collect()]
    repeated = {7}  # rows that share a doc_id share what is deleted
    left = all_pairs(docs)
    assert all(cut(t) == left[i] for i, t, _ in found if i is not None and t is not None and i not in repeated) and len(found) == len(docs)
    assert sorted((i or 0, t or "") for i, t, _ in found if i is None or t is None) == sorted((i or 0, t or "") for i, t in docs if i is None or t is None) and {x for *_, x in found} == {"x"}
    after = {i: t for i, t, _ in found}
    assert passage in after[200] and "second line" not in after[201] + after[202] + after[203] and "Own" in after[200] and "Other begin" in after[201] and "own end" in after[202]
    assert ld.dedup_lines(fixtures.empty_documents(spark)).collect() == []


def test_blocks_of_any_pair(spark):
    block = "That.\nAn original sentence of several words.\n|\nOther words stand here as well.\n|\nThat."
    docs = [(1, "That.\nfirst holder of short lines\n|"), (2, block), (3, block), (4, f"own start of this one\n{block}\nown end"), (5, "Other words stand here as well.\n|\nThat.\nmoved\nThat.\nAn original sentence of several words.")]
    r = random.Random(5)
    docs += [(10 + i, "\n".join(r.choice(["a", "b", "c d", "e f g", "h i j k l"]) for _ in range(r.randrange(12)))) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ld.dedup_lines(table).collect()
    left = {x.d.doc_id: cut(x.text) for x in rows}
    assert left == all_pairs(docs) and left[3] == [] and left[4] == ["own start of this one", "own end"] and left[5] == ["moved"]
    assert {x.d.doc_id: x.removed for x in rows}[4] == 6


def test_short_lines_with_other_first_holders(spark):
    lines = [f"line {k} of four" for k in range(8)]
    docs = [(k, f"{line}\nand own words of {k}") for k, line in enumerate(lines)] + [(10, "\n".join(lines)), (11, "\n".join(lines)), (12, "\n".join(reversed(lines)))]
    rows = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.d.doc_id: cut(r.text) for r in rows} == all_pairs(docs) and {r.d.doc_id: r.text for r in rows}[11] == ""


def test_every_sentence_end_cuts(spark):
    ends = ["Ends in a.", "Ends in é?", "Ends in X!", "Ends in 7.", "(Ends in bracket.)", "“Ends in quote.”", "Ends so…", "終わり。", "「終わり。」"]
    assert [x for x in ld.lines_of(" ".join(ends))[::2] if x] == ends == cut(" ".join(ends))
    r = random.Random(8)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b c", ".", "!", "…", "。", "！", "」", ")", "”", " ", "  ", "\t", "\u3000", "\n", "\u00a0"]) for _ in range(r.randrange(14)))
        assert "".join(ld.lines_of(t)) == t and [x.strip() for x in ld.lines_of(t)[::2] if x.split()] == cut(t), t
    assert ld.lines_of("一。二！三")[::2] == ["一。", "二！", "三"] and "".join(ld.lines_of("一。 二！三")) == "一。 二！三"
    passage = "This passage stands in the middle of a line. It is here."
    docs = [(1, f"Begin here. {passage} It goes on."), (2, f"Another begin here? {passage} An own end here.")]
    rows = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.d.doc_id: r.text for r in rows} == {1: docs[0][1], 2: "Another begin here? An own end here."}
