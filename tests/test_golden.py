"""Golden cases: inputs in the shapes of the six sites, results worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.operators import access, dedup, marts, records, rules, snapshot, translate
from noticeloom.sources.profiles import KANC_ROW


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


def test_records_span_lines(spark):
    html = '<td class="hide">12</td><td class="list_title"><a href="/x?cid=345&amp;hcid=38">반도체 <b>식각</b> 장비 구매</a></td>\n<td class="list_date">2026.03.09</td>'
    rows = records.regex_records(spark.createDataFrame([(html,)], "body string"), "body", KANC_ROW, ["no", "cid", "title", "list_date"])
    r = rows.select("cid", X.strip_tags(F.col("title")).alias("title"), X.dotted_date(F.col("list_date")).alias("d")).first()
    assert (r.cid, r.title, r.d) == ("345", "반도체 식각 장비 구매", "2026-03-09")


def test_verdicts(spark):
    cascade = [("exclude_hard", ["매각", "취소"]), ("exclude_service", ["장비운용", "운용용역"]), ("include", ["구매", "장비"]), ("exclude_service", ["위탁", "교육"])]
    titles = {"반도체 장비운용 용역업체 선정": "exclude_service", "반도체 연구용 장비 구매": "include", "직원 교육 위탁": "exclude_service", "장비 매각 공고": "exclude_hard", "회의실 안내": "exclude_no_signal"}
    for title, verdict in titles.items():
        assert one(spark, rules.cascade(F.col("t"), cascade, "exclude_no_signal"), t=title) == verdict


def test_short_terms_are_words(spark):
    assert not one(spark, X.short_or_any(F.col("t"), ["세정", "웨이퍼"]), t="관세정책 설명회")
    assert one(spark, X.short_or_any(F.col("t"), ["세정"]), t="웨이퍼 세정 사업")


def test_due_date_skips_dates_before_registration(spark):
    text = "의견마감일시 2025-03-11 공고기간 : 2026.03.02 - 2026.03.19"
    c = [X.date_parts(F.col("t"), r"의견마감일시\s*(\d{4})-(\d{1,2})-(\d{1,2})"), X.date_parts(F.col("t"), r"-\s+(\d{4})\.(\d{1,2})\.(\d{1,2})")]
    assert one(spark, X.first_candidate(c, F.lit("2026-03-02")), t=text) == "2026-03-19"
    assert one(spark, X.first_candidate(c, F.lit(None).cast("string")), t=text) == "2025-03-11"
    assert one(spark, X.first_candidate(c, F.lit(None).cast("string")), t="none") is None


def test_budgets(spark):
    assert one(spark, X.budget_after_label(F.col("t"), "사업예산"), t="사업예산 : USD 31,250 / KRW 41,870,500") == 41870500
    both = X.budget_any_currency(F.col("t"), ["사업예산", "배정예산"], ["사업예산", "배정예산"], "원")
    assert tuple(one(spark, both, t="배정예산 : JPY(¥) 8,420,000")) == (8420000, "JPY")
    assert tuple(one(spark, both, t="사업예산 : 63,910,000원(VAT 포함)")) == (63910000, "KRW")
    unit = X.budget_with_unit(F.col("t"), ["采购预算", "预算金额"])
    assert tuple(one(spark, unit, t="预算金额：37万元")) == (370000, "CNY")
    assert tuple(one(spark, unit, t="采购预算：9,450")) == (9450, "CNY")
    assert one(spark, unit, t="采购预算：1.2.3 元") is None


def test_labelled_fields(spark):
    assert one(spark, X.labelled_text(F.col("t"), "계약방법"), t="계약방법 : 일반경쟁 6) 인도조건 : DDP") == "일반경쟁"
    assert one(spark, X.labelled_text_near(F.col("t"), "납품장소", r"\s(?:[가-힣]\s*[.)]|\d{1,2}\.\d{1,2}\.)\s"), t="납품장소 및 인도조건 : 대전 나. 계약방법 : 수의") == "대전"
    text = "招标人：京东方 项目编号：A-1 截止时间：2026-07-08"
    assert one(spark, X.field_until_label(F.col("t"), "招标人", "[一-鿿]{2,10}"), t=text) == "京东方"
    assert one(spark, X.labelled_deadline(F.col("t"), "截止时间"), t=text) == "2026-07-08"


def test_periods(spark):
    p = X.period(F.col("t"), "신청기간", "상시")
    assert tuple(one(spark, p, t="<p>신청기간</p>신청기간</th><td>2026-07-01 ~ 2026-07-20</td>")) == ("2026-07-01", "2026-07-20")
    assert tuple(one(spark, p, t="신청기간</th><td>상시</td>")) == (None, None)
    assert tuple(one(spark, p, t="신청기간</th><td>2026-7-1</td>")) == ("2026-07-01", "2026-07-01")


def test_extractors_on_odd_rows(spark):
    rows = [(None,), ("",), ("&nbsp;",), ("<!-- a > b --> x",), ("a 　 b",), ("<p unclosed",)]
    got = [r.r for r in spark.createDataFrame(rows, "t string").select(X.strip_tags(F.col("t"), comments=True).alias("r")).collect()]
    assert got == [None, "", "", "x", "a b", "<p unclosed"]
    assert one(spark, X.unescape_all(F.col("t")), t="&eacute;&amp;lt;") == "é&lt;"


def test_deadlines(spark):
    day = F.lit("2026-07-08").cast("date")
    for due, status, label in ((None, "open", "unknown"), ("2026-07-07", "closed", "closed"), ("2026-07-08", "closing", "D-DAY"), ("2026-07-15", "closing", "D-7"), ("2026-07-16", "open", "D-8")):
        d = F.lit(due).cast("date")
        assert one(spark, marts.deadline_status(d, day), t="x") == status
        assert one(spark, marts.badge(d, day)[0], t="x") == label


def test_new_is_strict(spark):
    now = F.lit("2026-07-08 09:00:00").cast("timestamp")
    for seen, new in (("2026-07-06 09:00:01", True), ("2026-07-06 09:00:00", False), (None, False)):
        assert one(spark, marts.is_new(F.lit(seen).cast("timestamp"), now), t="x") is new


def test_snapshot_merge(spark):
    prev = spark.createDataFrame([("A", "a1", "t0", 0), ("A", "a2", "t0", 1), ("B", "b1", "t0", 2)], "s string, id string, seen string, pos int")
    fresh = spark.createDataFrame([("A", "a1"), ("A", "a3")], "s string, id string")
    merged = snapshot.source_fallback(fresh, prev.select("s", "id"), "s")
    seen = snapshot.first_seen(merged, prev, ["s", "id"], "seen", F.lit("t1"), "pos")
    assert {tuple(r) for r in seen.select("s", "id", "seen").collect()} == {("A", "a1", "t0"), ("A", "a3", "t1"), ("B", "b1", "t0")}
    assert [r.id for r in snapshot.new_ids(merged, prev, "id").collect()] == ["a3"]
    assert snapshot.source_fallback(fresh.limit(0), prev.select("s", "id"), "s").count() == 3


def test_two_key_dedup(spark):
    rows = spark.createDataFrame([(0, 1, "ta", "d"), (1, 2, "ta", "d"), (2, 2, "tb", "d"), (3, 3, "tb", "d")], "pos int, id int, norm string, day string")
    assert sorted(r.id for r in dedup.two_key(rows, "id", ["norm", "day"], "pos").collect()) == [1, 3]


def test_take_while(spark):
    rows = spark.createDataFrame([("l", 0, "2026-07-05"), ("l", 1, "2026-06-01"), ("l", 2, "2026-07-04")], "l string, pos int, day string")
    assert dedup.take_while(rows, "l", F.col("day") < "2026-06-08", "pos").count() == 1


def test_translation(spark):
    units = [("第(\\d+(?:\\.\\d+)?)代", "제$1세대")]
    glossary = translate.compile_glossary([(0, "京东方", "BOE(징둥팡)"), (4, "项目", "프로젝트"), (4, "设备", "장비")])
    r = one(spark, translate.translated(F.col("t"), units, glossary), t="京东方第6代OLED项目")
    assert tuple(r) == ("BOE(징둥팡) 제6세대OLED 프로젝트", True)
    assert tuple(one(spark, translate.translated(F.col("t"), units, glossary), t="")) == ("", True)
    assert not one(spark, translate.translated(F.col("t"), units, glossary), t="陕西省设备采购").ok


def test_lockout(spark):
    base = dt.datetime(2026, 7, 8)
    steps = [(m, "failure") for m in (0, 1, 2, 3, 4, 5)] + [(14, "request"), (15, "failure"), (16, "success")]
    log = spark.createDataFrame([(1, i, base + dt.timedelta(minutes=m), o) for i, (m, o) in enumerate(steps)], "key long, event_id long, ts timestamp_ntz, outcome string")
    rows = [(r.decision, r.failures, r.minutes_left) for r in access.lockouts(log).orderBy("event_id").collect()]
    assert rows[4] == ("locked", 0, 10) and rows[5] == ("rejected", 0, 9)
    assert rows[6][0] == "allowed" and rows[7][:2] == ("allowed", 1) and rows[8][:2] == ("allowed", 0)


def test_shares(spark):
    rows = marts.share_percent(spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "k string, n long"), "n")
    assert {r.k: r.share_pct for r in rows.collect()} == {"a": 33, "b": 67, "c": 0}


def test_message_skips_what_is_missing(spark):
    text = snapshot.message(F.lit(None).cast("string"), F.lit("S"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.array(F.lit("x"), F.lit("y")), F.lit("u"))
    assert one(spark, text, t="x") == "(untitled)\nS\nx, y\nu"


def test_labelled_values_by_position(spark):
    text = lambda t: one(spark, X.labelled_text(F.col("t"), "Terms", 20), t=t)
    assert text("Terms of use; Terms: open bid 3) next Terms : no") == "open bid"  # the first mention has no colon
    assert text("Terms : one two three four five six") == "one two three four"
    assert text("Terms : " + "x" * 30) == "x" * 20 and text("Terms : 12345 6789 123456789 q") == "12345 6789" and text("Terms : ") is None and text("none") is None
    near = lambda t: one(spark, X.labelled_text_near(F.col("t"), "Place", r"\s[a-z]\.\s", 15, 20), t=t)
    assert near("Place of work： Hall 3 b. Method : open") == "Hall 3" and near("Place far from any colon : x") is None
    field = lambda t: one(spark, X.field_until_label(F.col("t"), "Org", "[A-Z][a-z]{2,9}", 12), t=t)
    assert field("Org none Org：Acme Ltd Kind：x") == "Acme Ltd" and field("Org: to the end") == "to the end" and field("Org: longer than twelve Kind: y") is None
    money = lambda t: one(spark, X.budget_any_currency(F.col("t"), ["Plan", "Price"], ["Plan"], "won"), t=t)
    assert tuple(money("Plan : EUR（net） 1,200 Price: 77 won")) == (77, "KRW") and tuple(money("Plan : EUR（net） 1,200")) == (1200, "EUR")
    assert money("Plan : GBP(net) 5") is None and money("Plan : EUR 5") is None and tuple(money("Plan : USD($ 9,000")) == (9000, "USD")
    krw = lambda t: one(spark, X.budget_after_label(F.col("t"), "Budget"), t=t)
    assert krw("Budget K / KRW 5") is None and krw("Budget " + "." * 80 + " KRW 5") is None and krw("Budget: KRW 0, Budget: KRW 1,500") == 1500
