import base64

import pytest

from lekhaspark.functions.grids import read_grids
from lekhaspark.operators import tables as T


def texts(page):
    return [[c["text"] for c in r["cells"]] for r in read_grids(page)]


def test_spans():
    page = "<table><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><td>c</td><td rowspan=3>d<br>e</td></tr><tr><td>f<td>g</tr><tr><td colspan=2>h</table>"
    assert texts(page) == [["a", "b", "b"], ["a", "c", "d\ne"], ["f", "g", "d\ne"], ["h", "h", "d\ne"]]
    assert [r["header"] for r in read_grids(page)] == [True, False, False, False]
    assert texts("<table><tr><td rowspan=2>x<td>y<td rowspan=2>z</tr><tr></tr></table>") == [["x", "y", "z"], ["x"]] or texts("<table><tr><td rowspan=2>x<td>y<td rowspan=2>z</tr><tr></tr></table>")[0] == ["x", "y", "z"]
    nested = read_grids("<table><tr><td>out<table><tr><td><a href='x.pdf'>in &amp; out</a></td></tr></table></td><td>last</td></tr></table>")
    assert [(r["table"], [c["text"] for c in r["cells"]]) for r in nested] == [(0, ["out", "last"]), (1, ["in & out"])]
    assert nested[1]["cells"][0]["links"] == [{"href": "x.pdf", "label": "in & out"}]
    assert texts("<td>no table</td>") == [] and texts("<table><script>'<td>'</script><!-- <td> --><tr><td>x") == [["x"]]
    assert texts("<table><tr><td rowspan=99999999 colspan=x>a</td></tr><tr><td>b</td></tr></table>") == [["a"], ["a", "b"]]


def link(source, page="/GO/ViewGOPDF_list_user.aspx", host="https://shasanadesh.up.gov.in"):
    return f"{host}{page}?id1={base64.b64encode(source.encode()).decode()}"


def test_portal_rows(spark):
    head = "<tr><th>क्र.</th><th>विभाग / अनुभाग</th><th>शासनादेश संख्या</th><th>दिनांक</th><th>विषय</th><th></th></tr>"
    row = lambda n, href: f"<tr><td>{n}</td><td>कृषि विभाग<br>कृषि अनुभाग-5</td><td>{n}/2026</td><td>01/02/2026</td><td>बीज  हेतु</td><td><a href='{href}'>देखें</a></td></tr>"
    good, other = link("158#50001#1#2026"), link("158#50001#1#2026", host="https://example.org")
    page = f"<p>कुल प्राप्त अभिलेख : 1,234</p><table>{row(0, good)}{head}{row(1, good)}{row(2, other)}{row(3, link('x#y'))}{row(4, link('7#8#9#2020', page='/other.aspx'))}{row(5, link('7#8#9#2020')[len('https://shasanadesh.up.gov.in'):])}</table>"
    df = spark.createDataFrame([(1, page), (2, "<table><tr><td>no header</td></tr></table>"), (3, None)], "page_id int, html string")
    got = T.portal_rows(df).orderBy("portal_row").collect()
    assert [(r["portal_row"], r["source_id"], r["go_number"]) for r in got] == [(1, "158#50001#1#2026", "1/2026"), (2, "7#8#9#2020", "5/2026")]
    r = got[0]
    assert (r["department"], r["section"], r["go_date"], r["subject"], r["category"], r["link_text"], r["source_url"]) == ("कृषि विभाग", "कृषि अनुभाग-5", "01/02/2026", "बीज हेतु", None, "देखें", good)
    assert [x["t"] for x in df.orderBy("page_id").select(T.portal_total(df["html"]).alias("t")).collect()] == [1234, None, None]


CMS = """<table><tr><th>S.No</th><th>Title</th><th>No</th><th>Date</th><th></th></tr><tr><td>1</td><td>Uttar Pradesh Data Center Policy 2021</td><td>823/78 - 2 - 2021 -254 L.C/2019TC</td><td>17/06/2022</td>
<td><a href="/media/C_1.pdf">View</a> (1.2 MB) Language: English</td></tr></table>"""
HAND_MADE = """<table><tr><td>न0वि0-4</td><td>18-08-2020</td><td><a href="https://x/NV-4-1342.pdf"> 1342/नौ-4-2020-10ड0ब्लू/2016</a></td>
<td>उ0प्र0 पालिका (केन्द्रीयित) पशु चिकित्सा सेवा संवर्ग के पशुचिकित्सा अधिकारियों की सेवा शर्तें</td></tr><tr><td width="83%"><a href=book/Chapter-18.pdf target =_blank>CHAPTER XVIII- DEPOSITS</a></td><td>612-627</td></tr></table>"""
COMBINED = """<table><tr><td>3</td><td>Finance (General) Section-3</td><td>11/2024/S-3-227/10-19099/4/2024 / 12 Jun 2024</td><td>Regarding notional increment on retirement</td><td><a href="../ViewDoc.aspx?id=4583"></a></td></tr></table>"""
MANY = "<table><tr><td>All of them</td><td>" + "".join(f"<a href='f_{k}-x.pdf'>View</a>" for k in range(6)) + "</td></tr></table><table><tr><td><a href='f_1-x.pdf'>A named file of the list</a></td><td>02.03.2021</td></tr></table>"


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(list(enumerate([CMS, HAND_MADE, COMBINED, MANY, None])), "page_id int, html string")
    docs = T.row_items(df, documents=r"(?i)\.pdf$|ViewDoc\.aspx\?id=\d+").collect()
    assert T.row_items(df).where("page_id = 2").count() == 0
    return {(r["page_id"], r["url"]): r for r in docs}


def test_row_items(items):
    cms = items[0, "/media/C_1.pdf"]
    assert (cms["title"], cms["go_number"], cms["go_date"], cms["language"]) == ("Uttar Pradesh Data Center Policy 2021", "823/78 - 2 - 2021 -254 L.C/2019TC", "2022-06-17", "en")
    nic = items[1, "https://x/NV-4-1342.pdf"]
    assert nic["go_number"] == "1342/नौ-4-2020-10ड0ब्लू/2016" and nic["go_date"] == "2020-08-18" and "पशु चिकित्सा सेवा संवर्ग" in nic["title"] and nic["language"] == "hi"
    assert items[1, "book/Chapter-18.pdf"]["title"] == "CHAPTER XVIII- DEPOSITS"
    both = items[2, "../ViewDoc.aspx?id=4583"]
    assert (both["go_number"], both["go_date"], both["title"]) == ("11/2024/S-3-227/10-19099/4/2024", "2024-06-12", "Regarding notional increment on retirement")
    assert items[3, "f_0-x.pdf"]["title"] == "f 0 x" and items[3, "f_1-x.pdf"]["title"] == "A named file of the list" and items[3, "f_1-x.pdf"]["go_date"] == "2021-03-02"
