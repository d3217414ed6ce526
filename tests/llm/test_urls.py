import duckdb
from cases import SF

from proofweave.llm import queries, urls

RULES = queries.RULES


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, verdict string, seed string")


def link(*hosts):
    return "".join(f'<p><a class="x" HREF="https://{h}/a?b#c">t</a>' for h in hosts) + '<a href="/local">l</a><link href="https://not.an.anchor/">'


def planted():
    rows = [
        (1, "http://A.Example.NET/x", None), (2, "https://w.example.net/en/1?q=/de/", ""), (3, "http://b.example.com/de/2#f", ""), (4, "http://badexample.com/de/", ""),
        (5, "ftp://x.org/fr/", ""), (6, "http://x.org/en/", ""), (7, None, None), (8, "no scheme", ""), (9, "http://net", ""), (10, "http://net/", ""),
        (11, "http://foo.net?x=/", ""), (12, "a://b://c.net/", ""), (None, "http://q.net/", ""), (1, "http://A.Example.NET/x", None), (13, "://", ""), (14, "http://É.NET/ü", ""),
    ]
    # a farm that links to blocked hosts only, one that trusted hosts link to as well, and a chain
    rows += [(100 + k, f"http://bad{k}.net/p", "") for k in range(4)]
    rows += [(200, "http://farm.example.biz/1", link("bad0.net", "bad1.net", "BAD2.net", "bad3.net")), (201, "http://mixed.biz/", link("bad0.net", *["fine.biz"] * 9)), (202, "http://good.org/fr/", link("mixed.biz")), (203, "http://chain.biz/", link("farm.example.biz"))]
    return rows


def want(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cur = con.execute(urls.oracle(RULES))
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(n)] for n in ("page_id", "host", "path", "rule", "verdict")) for r in cur.fetchall()), key=str)


def test_rules_and_propagation(spark):
    got = urls.judged(pages(spark, planted()), RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == want(planted())
    by = {r[0]: r for r in rows}
    assert by[1] == (1, "a.example.net", "/x", "net/", "block") and by[2][3:] == ("example.net/en/", "allow") and by[3][3:] == ("example.com/de/", "block")
    assert by[4][3:] == (None, "allow") and by[5][3:] == ("org/fr/", "allow") and by[7] == (7, "", "", None, "allow") and by[9][2:4] == ("", None)
    assert by[200][3:] == (None, "block") and by[203][3:] == (None, "block") and by[201][3:] == (None, "allow")


def test_empty_table(spark):
    assert urls.judged(pages(spark, []), RULES).count() == 0


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((tuple(r) for r in urls.judged(table, RULES).collect()), key=str)
    assert got == want([(r.page_id, r.url, r.html) for r in table.collect()])


def test_plan_runs_no_python(spark):
    plan = urls.judged(spark.read.parquet(f"{SF}/pages.parquet"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
