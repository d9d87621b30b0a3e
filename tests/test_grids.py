"""Pages read as arrays give what reading them tag by tag gives."""

import random

import pyarrow as pa

from lekhaspark.functions import grids as G
from lekhaspark.operators import tables
from lekhaspark.plans import rulebooks
from lekhaspark.plans.registry import table

from conftest import SF

PAGES = [
    None, "", "no table", "<table></table>", "<table><tr></tr><tr><td></td></tr></table> <td>x</td>", "<table><tr><td>a  b<td> c\n</tr>\n<TR x='1'><TH>d</Th></TR></table><table><tr><th>e<th>f",
    "<table><tr><td rowspan=2>a<td colspan='2'>b</td></tr><tr><td>c<td rowspan=9>d</tr><tr></tr><tr><td>e</table>", "<table><td>no row</td><tr><td>x</table>", "<table><tr><td>out<table><tr><td>in</table></table>",
    "<table><tr><td><a href='x.pdf'>View</a> (1.2 MB)<br>&amp;</td><td>&nbsp;R&amp;D</td><td><a href=y>M <b>n</b></a><a>z</a></td></tr></table>", "<table><tr><td><a href='a&amp;b'>p</a><a class=k HREF=\" q \">r<a href=''>s</td></tr></table>",
    "<table><tr><td title='a>b'>c</td><td title=\"it's\">d</td><td title='x>e</td></tr></table>", "<table><!-- <td>c</td> --><tr><td>1 < 2</td><script>'<td>'</script><td>é क ख<p>ग</td></tr></table>", "<table><tr><td><a href='u'>q<br>r</a></td></tr></table>", "<table><tr><tdx>a</tdx><td/>b</td></tr></table", "</table><table><tr><td>a",
]


def rows(pages, part=G.PART):
    G.PART, kept = part, G.PART
    try:
        return G.grids.func(pa.array(pages, pa.string())).to_pylist()
    finally:
        G.PART = kept


def test_pages_as_arrays():
    want = [G.read_grids(p) if p else [] for p in PAGES]
    assert rows(PAGES) == rows(PAGES, 1) == rows(PAGES, 300) == want and sum(map(len, want)) == 18
    assert [r for p in PAGES for r in rows([p])] == want and rows([]) == []
    assert G.grids.func(pa.array(PAGES, pa.string()).slice(3, 5)).to_pylist() == want[3:8]


def test_random_pages():
    r = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th rowspan=2>", "<td colspan=2>", "<a href='u'>", "<a href=v >", "</a>", "<br>", "<b>", "t", " ", "\n", "&lt;", "é", "<", "'", "<!--", "-->"]
    pages = ["<table><tr><td>" + "".join(r.choices(bits, [3, 2, 6, 6, 9, 9, 2, 2, 3, 2, 4, 2, 2, 9, 5, 2, 2, 1, 0.2, 0.2, 0.1, 0.1], k=r.choice([4, 12, 40]))) for _ in range(3000)]
    assert rows(pages) == rows(pages, 2000) == [G.read_grids(p) for p in pages]


def test_most_pages_are_read_as_arrays(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tables, "row_items", lambda pages: made.append(pages.select("html")) or pages.selectExpr("page_id", "'' url", "'' title", "'' go_number", "'' go_date", "'' language", "0 n_cells"))
    rulebooks.listing_rows(lambda name: table(spark, SF, name))
    monkeypatch.setattr(G, "_rows", None)
    pages = [r["html"] for r in made[0].limit(200).collect()]
    assert all(rows(pages))


def test_items_are_chosen_before_they_are_looked_at(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>x</td></tr></table>")], "page_id long, html string")
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    found = plan(tables.row_items(pages))
    assert "Window" not in found and found.count("ArrowEvalPython") == 1
    assert plan(rulebooks.listing_rows(lambda name: table(spark, SF, name))).count("RepartitionByExpression [l_orderkey") == 1


def test_items_of_lines(spark):
    cells = lambda *c: "<table><tr>" + "".join(f"<td>{x}</td>" for x in c) + "<td><a href='/d.pdf'>View</a></td></tr></table>"
    cases = [
        cells("5-6 of it", "No. 7/8/9-1", "A rule on a/b and more of it", "32/13/2021", "3.4.2021"), cells("on 5.6.2020 it began", "1.2.99", "Language : Hindi size: 3 (2 KB)"), cells("सं0 12/क-3/2020 dated 3 May 2020", "ab​c de", "x" * 400),
        cells("No date 31 Foo 2020", "May 3, 1946", "August 9, 2020 and 1/2/2021"), cells("संख्या", "x" * 260, "A title of words"), cells(), "<table><tr><td><a href='/e-f_g%20h.pdf'>​ </a></td></tr></table>",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id int, html string")
    got = [(r["title"], r["go_number"], r["go_date"], r["language"], r["n_cells"]) for r in tables.row_items(df).orderBy("page_id").collect()]
    assert got == EXPECTED


EXPECTED = [
    ("A rule on a/b and more of it", "7/8/9-1", "2021-04-03", "en", 6),
    ("on 5.6.2020 it began", None, "2020-06-05", "hi", 4),
    ("x" * 297 + "…", "12/क-3/2020", "2020-05-03", "en", 4),
    ("No date 31 Foo 2020", "August 9, 2020 and 1/2/2021", "2021-02-01", "en", 4),
    ("x" * 260, None, None, "en", 4),
    ("d", None, None, "unknown", 1),
    ("e f g h", None, None, "unknown", 1),
]


def test_records_of_a_page_need_no_order(spark):
    link = f"<a href='{tables.PDF_PAGE}?id1=MSMyIzMjMjAyMA%3D%3D'>L</a>"
    head = "<tr><th>विभाग / अनुभाग</th><th>संख्या</th><th>दिनांक</th><th>विषय</th></tr>"
    one = f"<table>{head}<tr><td rowspan=2>a<br>b<br>c</td><td>1/2</td><td></td><td>s <br> t {link}</td></tr><tr><td>3</td><td>d</td><td>{link}</td></tr></table><table><tr><td>{link}</td></tr>{head}<tr><td>e</td><td>{link}</td></tr></table>"
    pages = spark.createDataFrame([(1, one), (2, None), (3, head)], "page_id long, html string")
    found = tables.portal_rows(pages)
    got = [(r["portal_row"], r["source_id"], r["department"], r["section"], r["go_number"], r["go_date"], r["subject"], r["link_text"]) for r in found.orderBy("portal_row").collect()]
    assert got == [(1, "1#2#3#2020", "a", "b c", "1/2", None, "s t L", "L"), (2, "1#2#3#2020", "a", "b c", "3", "d", "L", "L"), (3, "1#2#3#2020", "e", None, "L", None, None, "L")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 1
