"""Line and paragraph dedup against brute force."""

import pytest

from framelode.llm import queries, substring

SHORT = "One two. Three four! Five six? Seven eight. Nine ten."
PARAGRAPH = "Red green.\nBlue black. White.\nPink grey. Brown."
CJK = "今日は天気がとても良いので公園まで散歩に行きました。"
TEXTS = [
    SHORT, f"Ahead.\n{SHORT}\nBehind.", f"{PARAGRAPH}\n\nAlone here.", f"Before it.\n\n{PARAGRAPH.upper()}\n \nAfter.", CJK, f"x\n{CJK}",
    "Too short.", "Too short.", f"A whole sentence that has got more than eight words. {SHORT}", "A whole sentence that has got more than eight words. Else.", None, "", f"{SHORT}\n{SHORT}",
    " \n\t\n", f"  {SHORT}\t\n\n\n{SHORT} more", f"{PARAGRAPH}\n{SHORT}", f"{PARAGRAPH}\n{SHORT}\n\n  tail",
]


def spans(text):
    """Places of lines and paragraphs, character by character."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    groups, group = [], []
    for at, line in lines:
        groups.append([(at, line)])
        if line.strip(" \t\r"):
            group.append((at, line))
        else:
            groups.append(group)
            group = []
    out = set()
    for g in [*groups, group]:
        if g:
            a, z = g[0][0], g[-1][0] + len(g[-1][1])
            while a < z and text[a].isspace():
                a += 1
            while z > a and text[z - 1].isspace():
                z -= 1
            if a < z:
                out.add((a, z))
    return sorted(out)


def brute(texts):
    """Cuts and number of units by place, from all units of all texts in order."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        own, found = [], spans(t or "")
        for a, z in found:
            key = " ".join(t[a:z].casefold().split())
            cjk = sum("぀" <= c <= "鿿" for c in key)
            if len(key.split()) + cjk // 2 >= 8 and seen.setdefault(key, (i, a)) != (i, a):
                own.append((a, z))
        out.append(([s for s in own if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in own)], len(found)))
    return out


def test_lines_and_paragraphs(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(TEXTS)
    got = {r.doc_id: r for r in queries.QUERIES["op9_substring_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i].removed for i in range(len(TEXTS))] == [",".join(f"{a}-{z}" for a, z in w) for w, _ in want]
    assert [got[i].n_removed for i in range(len(TEXTS))] == [len(w) for w, _ in want] and [got[i].n_units for i in range(len(TEXTS))] == [n for _, n in want]
    assert [len(w) for w, _ in want] == [0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 2, 0, 1, 1, 1]
    # a line that repeats leaves nothing of itself
    assert substring.cut(TEXTS[1], want[1][0]) == "Ahead.\nBehind."


def test_awkward_rows(spark, docs, rows):
    from pyspark.sql import functions as F

    order = sorted(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").distinct().collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    want = brute([r.text for r in order])
    got = substring.remove_repeats(docs).distinct().collect()
    expected = [(r.doc_id, len(w), n, None if r.text is None else substring.cut(r.text, w)) for r, (w, n) in zip(order, want, strict=True)]
    assert sorted(((r.doc_id, r.n_removed, r.n_units, r.kept) for r in got), key=str) == sorted(expected, key=str)
    assert sum(len(w) for w, _ in want) > 10 and len(rows) > len(order)


def test_units():
    t = "First one here. Second?  Third\n\n  Fourth line… end\nFifth"
    assert [t[a:b] for a, b in substring.units(t, ("line",))] == ["First one here. Second?  Third", "Fourth line… end", "Fifth"]
    assert [t[a:b] for a, b in substring.units(t, ("paragraph",))] == ["First one here. Second?  Third", "Fourth line… end\nFifth"]
    assert substring.units(t) == spans(t)


@pytest.mark.parametrize("given", [[], [(3, 5)]])
def test_nested_cuts(given):
    assert substring.outer([(5, 9), (0, 10), (0, 4), (12, 15), *given]) == [(0, 10), (12, 15)]
