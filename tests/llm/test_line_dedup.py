"""Repeated windows of lines against a plain search."""

import random

from gridmill.llm import line_dedup


def by_hand(docs, span=3):
    found, where = {}, []
    for key, text in sorted({(k, t) for k, t in docs if t is not None}, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for at in range(len(lines) - span + 1):
            window = tuple(x for _, x in lines[at : at + span])
            first = found.setdefault(window, (key, text, at))
            start = max(at, first[2] + span) if first[:2] == (key, text) else at
            if first != (key, text, at):
                where += [(key, text, lines[i][0]) for i in range(start, at + span)]
    gone = set(where)
    return sorted(((k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, t, i) not in gone)) for k, t in docs), key=str)


def result(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_random_documents(spark):
    rnd = random.Random(6)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "c d", "", " ", "e"]) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(line_dedup.dedup_lines(df.repartition(5))) == by_hand(docs)


def test_edges(spark):
    passage = "one\ntwo\nthree"
    docs = [
        (1, passage + "\nfour"), (2, passage), (3, "x\n\n" + passage.replace("\n", "\n\n") + "\ny"), (4, None), (5, ""), (6, "two\nthree"),
        (7, "z\n" * 5 + "z"), (None, passage), (2, passage), (8, "q\n" * 30_000),
    ]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, removed_lines string, _key int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_key", "removed_lines", "n_lines"]
    assert result(out) == by_hand(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == passage + "\nfour" and rows[2].text == "" and rows[2].removed_lines == [0, 1, 2]
    assert rows[3].text == "x\n\n\n\ny" and rows[3].removed_lines == [2, 4, 6] and rows[3].n_lines == 8
    assert rows[4].text is None and rows[4].n_lines == 0 and rows[5].text == "" and rows[6].text == "two\nthree"
    assert rows[7].text == "z\nz\nz" and rows[None].text == ""
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_hot_window(spark):
    rows = [(i, f"head {i}\nsame\nlines\nhere\ntail {i}") for i in range(600)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert result(out) == sorted(((i, f"head {i}\ntail {i}") if i else (0, rows[0][1]) for i, _ in rows), key=str)
