from sparkweave.llm import line_dedup, queries

from .oracle import same


def test_whole_table(spark, sf):
    same(queries.op3_line_dedup(spark, sf), line_dedup.ORACLE, sf)


def test_edges(spark, monkeypatch):
    rows = [(i, "http://u@A.com:80/x", f"menu\nbody {i}\nmenu") for i in range(6)]
    rows += [(9, None, "menu"), (10, "http://b.com", None), (11, "http://b.com", ""), (12, "no url", "menu")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({})
    for limit in (10, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["lines"]) for r in line_dedup.dedup(pages).collect()}
        assert got[0] == (3, 2, ["body 0"]) and len(got) == len(rows)
        assert got[9] == (1, 0, ["menu"]) and got[10] == (0, 0, []) and got[12] == (1, 0, ["menu"])
    assert line_dedup.dedup(pages.limit(0)).count() == 0


def test_clashing_names(spark):
    rows = [(i, "http://h/x", f"menu\nline {i}", "a", "b", "c", "d") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, drop string, host string, row string, lines string")
    got = line_dedup.dedup(pages).collect()
    assert all(r["lines"] == [f"line {r['page_id']}"] and (r["drop"], r["host"], r["row"]) == ("a", "b", "c") for r in got) and len(got) == 6
