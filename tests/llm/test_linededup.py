from glossa.llm import linededup as L


def brute(rows, ratio=L.MAX_RATIO, least=L.MIN_PAGES):
    pages, counts = {}, {}
    for text, host in rows:
        host = host or ""
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(L.BLANKS) for x in (text or "").split("\n")} - {""}:
            counts[host, line] = counts.get((host, line), 0) + 1
    out = []
    for text, host in rows:
        host = host or ""
        gone = {x for (h, x), n in counts.items() if h == host and n >= least and n > ratio * pages[host]}
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if x.strip(L.BLANKS) not in gone))
    return out


def test_against_counting(spark):
    rows = [(f"Menu \nbody {i}\n\n  Home\t\nend {i % 7}", h) for i, h in enumerate(["a"] * 40 + ["b"] * 6 + [None] * 8 + [""] * 8)]
    rows += [(None, "a"), ("", "a"), ("Menu", "a"), ("Menu", "c"), ("x" * 300_000 + "\nMenu", "a"), ("Menu\nMenu", "b")]
    docs = spark.createDataFrame([(i, t, "en", h, 7, i) for i, (t, h) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `k` int")
    for ratio, least in ((0.05, 5), (0.5, 1), (0.9, 2)):
        got = sorted(L.line_dedup(docs, max_ratio=ratio, min_pages=least).collect())
        assert [r.text for r in got] == brute(rows, ratio, least)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.k == r.doc_id for r in got)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same\nother", "h")] * 6, "doc_id long, text string, source string")
    assert [r.text for r in L.line_dedup(docs).collect()] == [""] * 6
    assert L.line_dedup(docs.limit(0)).count() == 0
    clash = L.line_dedup(docs.selectExpr("*", "1 AS _drop", "2 AS _host", "3 AS _pages", "'k' AS _key"))
    assert {tuple(r) for r in clash.collect()} == {(1, "", "h", 1, 2, 3, "k")}


def test_join_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"nav\nt{i}", "h") for i in range(20)], "doc_id long, text string, source string")
    monkeypatch.setattr(L.runtime, "BROADCAST_BYTES", 0)
    assert sorted(r.text for r in L.line_dedup(docs).collect()) == sorted(f"t{i}" for i in range(20))
