"""A site's pages through its profile to canonical notices."""

import datetime as dt
import json

from noticeloom.operators.metrics import Funnel
from noticeloom.schema import NOTICE
from noticeloom.sources import snapshots
from noticeloom.sources.profiles import REGISTRY, collect, with_rules


def pages(spark, body):
    return spark.createDataFrame([("k", 1, body)], "list_key string, page_no int, body string")


def test_all_sources_are_there():
    assert list(REGISTRY) == ["KANC", "NNFC", "KOTRA", "EBNEW", "MOFCOM", "KRISS"]
    assert {c for c, p in REGISTRY.items() if p.keep_expired} == {"KOTRA", "EBNEW", "MOFCOM"}


def test_dotted_board(spark):
    row = '<td class="hide">{0}</td><td class="list_title"><a href="/x?cid={0}&amp;hcid=38">{1}</a></td>\n<td class="list_date">{2}</td>'
    body = row.format(1, "반도체 <b>식각</b> 장비 구매", "2026.07.01") + row.format(2, "장비운용 용역", "2026.07.01") + row.format(4, "유리기판 장비 사전규격", "2026.7.2") + row.format(3, "OLED 장비 구매", "2026.01.01") + row.format(5, "장비 구매", "2026.07.03")
    details = spark.createDataFrame([("1", "<p>사업예산 : USD 5 / KRW 704,573,000 계약방법 : 일반경쟁 6) 인도조건 : DDP 공고기간 : 2026.06.24 - 2026.07.08</p>"), ("4", "<p></p>"), ("3", ""), ("5", "")], "key string, body string")
    found = collect(REGISTRY["KANC"], pages(spark, body), details, "2026-07-08")
    assert found.schema.names == NOTICE.names
    rows = {r.id: r for r in found.collect()}  # the list ends at its first row that is too old
    assert set(rows) == {"cid1", "cid4"}
    r = rows["cid1"]
    assert (r.title, r.due_date, r.budget_amount, r.contract_method, r.keywords, r.notice_type) == ("반도체 식각 장비 구매", dt.date(2026, 7, 8), 704573000, "일반경쟁", ["반도체 장비"], "정식입찰")
    assert (rows["cid4"].due_date, rows["cid4"].keywords, rows["cid4"].notice_type) == (None, ["TGV 장비"], "사전규격")


def test_due_date_in_the_list(spark):
    body = '<td class="m_hidden">7</td>\n<td class="txt_left"><a href="/b?list_no=88&x=1">진공펌프 구매</a></td><td>2026/7/1</td><td>2026/07/20</td>'
    r = collect(REGISTRY["KRISS"], pages(spark, body), spark.createDataFrame([("88", "")], "key string, body string"), "2026-07-08").first()
    assert (r.id, r.due_date, r.posted_date) == ("kriss88", dt.date(2026, 7, 20), dt.date(2026, 7, 1))


def test_a_failed_source_keeps_its_partition(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    both = spark.createDataFrame([("A", "a1"), ("B", "b1")], "source_code string, id string")
    snapshots.write_snapshot(both, path)
    snapshots.write_snapshot(spark.createDataFrame([("A", "a2")], "source_code string, id string"), path)
    assert {tuple(r) for r in snapshots.read_snapshot(spark, path, both.schema).collect()} == {("A", "a2"), ("B", "b1")}


def test_landed_files(spark, tmp_path):
    (tmp_path / "p.html").write_bytes("ok é".encode() + b"\xff")
    assert snapshots.landed_pages(spark, str(tmp_path)).first().body == "ok é�"
    assert snapshots.read_document(spark, str(tmp_path / "none"), "id long, title string").count() == 0


def details(spark, **pages):
    return spark.createDataFrame([(k.removeprefix("k"), v) for k, v in pages.items()], "key string, body string")


def test_attachments_of_each_site(spark):
    """Ids, size notes, two-level lists and nameless links."""
    row = '<tr data-ntt-id="9"><a class="bbs-subject-txt"> 장비 구매 <td class="regDate">2026-07-01</td></tr>'
    body = """<a href="#" data-atch-file-id="F1" data-file-sn="2" x> 규격서.hwp &amp; 도면 [1.5 MB]</a><a data-atch-file-id="F2" data-file-sn="1"><i></i> [3 KB]</a>"""
    r = collect(REGISTRY["NNFC"], pages(spark, row), details(spark, k9=body), "2026-07-08").first()
    assert [tuple(a) for a in r.attachments] == [("규격서.hwp & 도면", "/cmm/fms/F1/2/FileDown.do")]
    row = '<tr><td class="hide">1</td><a href="?cid=5&hcid=38">장비 구매</a><td class="list_date">2026.07.01</td></tr>'
    body = """<a href="javascript:getDownloadFile('12', '5','a.hwp')" title="x"><img src="i.gif"/> 공고문.hwp</a>"""
    r = collect(REGISTRY["KANC"], pages(spark, row), details(spark, k5=body), "2026-07-08").first()
    assert [tuple(a) for a in r.attachments] == [("공고문.hwp", "/cwsboard/board.do?bid=12&mode=download&cid=5&filename=a.hwp")] and r.org == "한국나노기술원"
    row = '<tr><td class="m_hidden">7</td><a href="/b?list_no=88&x=1">진공펌프 구매</a><td>2026/7/1</td><td>2026/07/20</td></tr>'
    body = """<div class="file"><ul><li><a href="/d?f=1">사양서.pdf <span>(20KB)</span></a></li><li><a href="/d?f=2"><span>(1KB)</span></a></li></ul></div> K26BK00012345-001"""
    r = collect(REGISTRY["KRISS"], pages(spark, row), details(spark, k88=body), "2026-07-08").first()
    assert [tuple(a) for a in r.attachments] == [("사양서.pdf", "/d?f=1")] and r.national_bid_no == "K26BK00012345-001"


def test_rows_end_where_their_profile_says(spark):
    """A brace between two fields is no end of a row."""
    row = '<tr data-ntt-id="9" onclick="f({x:1})"><a class="bbs-subject-txt"> 장비 구매 <td class="regDate">2026-07-01</td></tr>'
    assert collect(REGISTRY["NNFC"], pages(spark, row), details(spark, k9=""), "2026-07-08").count() == 1


def test_fairs(spark):
    card = '<li><a href="?dtlBizMntNo={0}&cpbizYn=N">{1}</a></li>'
    body = card.format("A1", "반도체 수출상담회") + card.format("A2", "식품 박람회") + card.format("A1", "반도체 수출상담회") + card.format("A3", "디스플레이 사업") + card.format("A4", "세정 관세정책")
    page = """<caption>신청기간, 주관부서</caption><th>신청기간</th><td>2026-06-20&nbsp;~&nbsp;2026-07-10</td><th>개최기간</th><td>2026-09-01</td><th>주관부서</th><td> 소재부품팀 </td>
    <p>사업진행장소 : 해외 (국내 아님)</p><div class="nHtagArea"><ul><li>전시</li><li>{0}</li></ul></div><textarea id="txtArea" x>바이어  상담\n행사</textarea><a href="/kmodule/file/fileDown.do?storFileId=7"> 안내.pdf </a>"""
    found = {r.id: r for r in collect(REGISTRY["KOTRA"], pages(spark, body), details(spark, A1=page.format("베트남"), A3=page.format("기타"), A4="<p></p>"), "2026-07-08").collect()}
    r = found["kotraA1"]
    assert set(found) == {"kotraA1", "kotraA3", "kotraA4"} and (r.country, r.country_code, r.notice_type, r.org, r.description) == ("베트남", "VN", "수출상담회", "소재부품팀", "바이어 상담\n행사")
    assert (r.posted_date, r.due_date, tuple(r.event_period)) == (dt.date(2026, 6, 20), dt.date(2026, 7, 10), (dt.date(2026, 9, 1), dt.date(2026, 9, 1)))
    assert [tuple(a) for a in r.attachments] == [("안내.pdf", "/kmodule/file/fileDown.do?storFileId=7")]
    assert (found["kotraA3"].country, found["kotraA3"].country_code) == ("해외(국가 확인 필요)", None) and (found["kotraA4"].country, found["kotraA4"].org) == ("확인 필요", "확인 필요")


def test_chinese_searches_end_to_end(spark):
    """Blocks: relevance of the title, the same title of a day once, the whole text as third test, translation with its flag; all counted."""
    block = '<div class="abstract-title"><i class="abstract-tag">招标公告</i><a href="/d/{0}.html" title="{1}"></a><span>{2}</span></div>'
    rows = [(1, "京东方刻蚀机设备", "2026-07-05"), (2, "京东方 刻蚀机设备", "2026-07-05"), (3, "半导体土建项目", "2026-07-05"), (4, "晶圆设备", "2026-07-04"), (5, "晶圆厂房设备", "2026-07-04"), (6, "晶圆旧闻", "2026-01-01"), (7, "晶圆后来", "2026-07-05")]
    text = "<p>招标人：京东方 招标产品：刻蚀机 招标地区：陕西省设备 项目编号：B-77 截止时间：2026-07-28 采购预算：37万元 设备采购</p>"
    funnel = Funnel("EBNEW")
    list_pages = pages(spark, "head" + "".join(block.format(*r) for r in rows))
    out = collect(REGISTRY["EBNEW"], list_pages, details(spark, k1=text, k2=text, k4="<p>设备采购 招标人：某公司 项目编号：C</p>", k5="<p>晶圆</p>", k7=text), "2026-07-08", funnel)
    found = {r.id: r for r in out.collect()}
    assert set(found) == {"ebnew1", "ebnew4"}
    r = found["ebnew1"]
    assert (r.original_title, r.title, r.org, r.original_org, r.region, r.project_no) == ("京东方刻蚀机设备", "BOE 식각기 장비", "BOE", "京东方", "산시성设备", "B-77")
    assert (r.due_date, r.budget_amount, r.translated_summary, r.translation_incomplete, r.notice_type) == (dt.date(2026, 7, 28), 370000, "식각기", False, "정식입찰")
    assert found["ebnew4"].translation_incomplete
    assert funnel.counts() == {"raw": 5, "exclude_no_signal": 0, "exclude_not_relevant": 1, "selected": 4, "distinct": 3, "excluded_after_detail": 1, "included": 2, "translation_incomplete": 1}


def test_payload_search(spark):
    """JSON with braces in its values, pages beyond its own last one, no payload, and fallbacks of the list row."""
    row = lambda i, name, digest, day: {"fdid": i, "name": name, "digest": digest, "publishTime": day, "industryName": "半导体", "areaName": "河北省"}
    page = lambda *rows: json.dumps({"maxPageNum": 2, "rows": list(rows)}, ensure_ascii=False)
    bodies = [page(row("a", "晶圆设备", "brace } here", "2026-07-05 10:00"), row("b", "食品", "", None)), "<html>", page(row("c", "刻蚀机", "", "2026-07-06"))]
    lists = spark.createDataFrame([("k", 1, bodies[0]), ("k", 2, bodies[1]), ("k", 3, bodies[2]), ("q", 1, None)], "list_key string, page_no int, body string")
    found = collect(REGISTRY["MOFCOM"], lists, details(spark, a="<p>设备采购 投标截止时间（开标时间）：2026-08-01</p>", c="设备采购"), "2026-07-08").collect()
    assert [(r.id, r.original_org, r.region, r.due_date, r.posted_date, r.original_summary) for r in found] == [("mofcoma", "半导体", "허베이성", dt.date(2026, 8, 1), dt.date(2026, 7, 5), "brace } here")]


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([(1, "exclude_hard", "취소"), (2, "include", "로봇"), (2, "include", "장비")], "priority int, verdict string, term string")
    row = '<tr><td class="hide">{0}</td><a href="?cid={0}&hcid=38">{1}</a><td class="list_date">2026.07.01</td></tr>'
    body = row.format(1, "로봇 팔") + row.format(2, "로봇 취소") + row.format(3, "구매")
    found = collect(with_rules(REGISTRY["KANC"], rules), pages(spark, body), details(spark, k1="", k2="", k3=""), "2026-07-08").collect()
    assert [r.id for r in found] == ["cid1"]
