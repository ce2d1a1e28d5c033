"""Source profiles: a site as data. A new source is one profile and its registration; the job over its pages is the same for all."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.operators import dedup, records, rules, translate
from noticeloom.operators.metrics import Funnel
from noticeloom.schema import NOTICE, project
from noticeloom.sources.snapshots import written


@dataclass(frozen=True)
class Translation:
    """What turns a source's texts into the reader's language: number rules, a glossary, its regions, and syllables (char, syllable) for what these leave."""

    numbers: Sequence[tuple[str, str]] = ()
    glossary: Sequence[tuple[str, str]] = ()
    regions: Sequence[tuple[str, str]] = ()
    suffixes: Sequence[str] = ("省", "市", "")
    syllables: Sequence[tuple[str, str]] = ()
    chars: str = translate.CJK


@dataclass(frozen=True)
class SourceProfile:
    """Patterns, terms and constants of one site.

    `rows` turns list pages (list_key, page_no, body) into list rows (key, title, list_key, page_no, pos and others). The stages of `collect` are
    switched on by what a profile has: `posted` and `due` are dates of the list row, `verdicts` or `list_stage` select by title (and
    `list_text`), `detail_stage` by the whole text, `second_key` drops the same title of the same day under another key. `fields` read the
    plain text of the detail page, `page_fields` its HTML and the list row. Terms are the caller's data: the defaults are a small sample of each kind, and
    `with_rules` replaces them by a rule table.
    """

    code: str
    name: str
    country: str | None
    rows: Callable[[DataFrame], DataFrame]
    id_prefix: str
    url: str = ""
    posted: Callable[[], Column] | None = None
    due: Callable[[], Column] | None = None
    due_patterns: Sequence[str] = ()
    verdicts: Sequence[tuple[str, Sequence[str]]] = ()
    default_verdict: str = "exclude_no_signal"
    list_text: Callable[[], Column] | None = None
    list_stage: Callable[[Column], Column] | None = None
    detail_stage: Callable[[Column], Column] | None = None
    second_key: bool = False
    whole_text: Callable[[], Column] | None = None
    categories: Sequence[tuple[str, Sequence[str]]] = ()
    default_category: str | None = None
    short_terms: bool = False
    notice_types: Sequence[tuple[str, Sequence[str]]] = ()
    default_type: str = "정식입찰"
    keep_expired: bool = False
    lookback_days: int | None = 30
    fields: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    page_fields: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    translation: Translation | None = None


REGISTRY: dict[str, SourceProfile] = {}


def register_source(profile: SourceProfile) -> SourceProfile:
    """Adds a source; its place among the sources is the order of registration."""
    REGISTRY[profile.code] = profile
    return profile


def with_rules(profile: SourceProfile, verdicts: DataFrame, categories: DataFrame | None = None) -> SourceProfile:
    """The profile with the terms of rule tables (priority, verdict, term); categories are such rules too, in the order of priority."""
    return replace(profile, verdicts=rules.compile_rules(verdicts), **({"categories": rules.compile_rules(categories)} if categories is not None else {}))


def list_rows(profile: SourceProfile, pages: DataFrame) -> DataFrame:
    """The rows of list pages (list_key, page_no, body), with their place; rows without key or title are left out."""
    rows = profile.rows(pages)
    return rows.withColumns({"title": X.strip_tags(F.col("title")), "key": F.col("key").cast("string")}).where("title <> '' and key <> ''")


def pattern_rows(pattern: str, fields: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """List rows as the matches of an expression."""
    return lambda pages: records.regex_records(pages, "body", pattern, fields, "list_key", "page_no")


def block_rows(marker: str, fields: dict[str, str], required: str = "key") -> Callable[[DataFrame], DataFrame]:
    """List rows as the blocks behind a marker."""
    return lambda pages: records.block_records(pages, "body", marker, fields, required, "list_key", "page_no")


def payload_rows(schema: str, rows: str, fields: dict[str, str], last_page: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """List rows as the objects of an array in a JSON payload; payloads that are none have no rows, and pages beyond the payload's own last page are left out."""

    def read(pages: DataFrame) -> DataFrame:
        parsed = records.payload_rows(pages, "body", schema, "list_key", "page_no")
        if last_page:
            parsed = parsed.where(F.col(last_page).isNull() | (F.col("page_no") <= F.col(last_page)))
        each = parsed.select("list_key", "page_no", F.posexplode(rows).alias("pos", "_r"))
        return each.select("list_key", "page_no", "pos", *(F.col(f"_r.{source}").alias(name) for name, source in fields.items()))

    return read


def collect(profile: SourceProfile, list_pages: DataFrame, detail_pages: DataFrame, as_of: str, funnel: Funnel | None = None) -> DataFrame:
    """Canonical notices of one source.

    Each list is read up to its first row that is too old. Rows are selected by title, then the first of each key and, if the profile says so, of each
    title and day is joined with its detail page (key, body) and selected by the whole text; a row without detail page is left out. Texts are
    translated, originals stay beside them; for that the selected rows are written to the shared folder once. Nothing is invented: what isn't found is null. A funnel is told how many rows each stage saw.
    """
    watch = funnel.watch if funnel else lambda rows, **_: rows
    count = F.count("*")
    rows = list_rows(profile, list_pages).withColumn("posted", X.safe_date(profile.posted()) if profile.posted else F.lit(None).cast("date"))
    if profile.posted and profile.lookback_days is not None:
        rows = dedup.take_while(rows, "list_key", F.col("posted") < F.date_sub(F.lit(as_of).cast("date"), profile.lookback_days), "page_no", "pos")
    rows = rows.withColumn("_text", profile.list_text() if profile.list_text else F.col("title"))
    verdict = rules.cascade(F.col("_text"), profile.verdicts, profile.default_verdict)
    rows = rows.withColumn("_verdict", F.when(profile.list_stage(F.col("_text")), "include").otherwise("exclude_not_relevant") if profile.list_stage else verdict)
    if not profile.second_key:
        rows = dedup.first_by(rows, ["key"], "page_no", "pos", "list_key")
    names = dict.fromkeys([*(v for v, _ in profile.verdicts), profile.default_verdict, "exclude_not_relevant"])
    rows = watch(rows, raw=count, **{n: F.count_if(F.col("_verdict") == n) for n in names if n != "include"}).where("_verdict = 'include'")
    if profile.second_key:
        rows = dedup.first_by(rows, ["key"], "list_key", "page_no", "pos")
        rows = watch(rows.withColumn("_norm", X.normalize_text(F.col("title"))).withColumn("_day", F.coalesce(F.col("posted").cast("string"), F.lit("-"))), selected=count)
        rows = dedup.first_by(rows, ["_norm", "_day"], "list_key", "page_no", "pos")
    rows = watch(rows, distinct=count)
    rows = rows.join(detail_pages.select("key", F.col("body").alias("detail")), "key").withColumn("plain", X.strip_tags(F.col("detail"), comments=True))
    for name, read in profile.fields.items():
        rows = rows.withColumn(f"_{name}", read(F.col("plain")))
    for name, read in profile.page_fields.items():
        rows = rows.withColumn(f"_{name}", read(F.col("detail")))
    rows = rows.withColumn("_whole", profile.whole_text() if profile.whole_text else F.col("title"))
    if profile.detail_stage:
        test = F.coalesce(profile.detail_stage(F.col("_whole")), F.lit(False))
        rows = watch(rows, excluded_after_detail=F.count_if(~test)).where(test)
    out = {name: F.col(f"_{name}") for name in (*profile.fields, *profile.page_fields) if name in NOTICE.names} | {name: F.lit(value) for name, value in profile.constants.items()}
    if profile.translation:
        rows, translated = _translated(written(rows, "selected"), profile.translation)
        out |= translated
    listed = profile.due() if profile.due else F.lit(None).cast("string")
    candidates = [X.date_parts(F.col("plain"), p) for p in profile.due_patterns]
    due = F.coalesce(listed, X.first_candidate(candidates, F.date_format("posted", "yyyy-MM-dd"))) if candidates else listed
    tags = rules.category_tags(F.col("_whole"), profile.categories, profile.default_category, profile.short_terms)
    fields = {
        "id": F.concat(F.lit(profile.id_prefix), "key"),
        "source_code": F.lit(profile.code),
        "source": F.lit(profile.name),
        "title": F.col("title"),
        "country_code": F.lit(profile.country),
        "due_date": X.safe_date(due),
        "posted_date": F.col("posted"),
        "keywords": tags,
        "classification_status": rules.classification_status(tags),
        "notice_type": rules.cascade(F.col("_whole"), profile.notice_types, profile.default_type),
        "url": F.format_string(profile.url, F.col("key")) if profile.url else F.lit(None),
    } | out
    incomplete = {"translation_incomplete": F.count_if(fields["translation_incomplete"])} if "translation_incomplete" in fields else {}
    return project(watch(rows, included=count, **incomplete), **fields)


def _translated(rows: DataFrame, t: Translation) -> tuple[DataFrame, dict[str, Column]]:
    """Title, organisation and summary by the glossary, the region by its list; each original beside it."""
    table = rows.sparkSession.createDataFrame(list(t.syllables), "char string, syllable string")
    for name in ("org", "summary", "region"):
        if f"_{name}" not in rows.columns:
            rows = rows.withColumn(f"_{name}", F.lit(None).cast("string"))
    oks = {}
    for name in ("title", "_org", "_summary"):
        folded = translate.translated(F.col(name), t.numbers, t.glossary, t.chars)
        rows = rows.withColumn(f"_folded{name}", folded["text"])
        oks[name] = folded["ok"]
    rows = rows.withColumn("_folded_region", translate.region_translate(F.col("_region"), t.regions, t.suffixes)).withColumns({f"{n}_ok": ok for n, ok in oks.items()})
    rows = translate.romanize_all(rows, {f"_folded{n}": f"{n}_translated" for n in ("title", "_org", "_summary", "_region")}, table, t.chars)
    return rows, {
        "title": F.col("title_translated"),
        "translated_title": F.col("title_translated"),
        "original_title": F.col("title"),
        "org": F.col("_org_translated"),
        "original_org": F.col("_org"),
        "translated_summary": F.col("_summary_translated"),
        "original_summary": F.col("_summary"),
        "description": F.coalesce("_summary_translated", "title_translated"),
        "region": F.col("_region_translated"),
        "translation_incomplete": translate.incomplete(F.col("title_ok"), F.col("_org_ok"), F.col("_summary_ok")),
    }


# Names of the categories, and a sample of each source's terms.
SEMI, DISPLAY, GLASS = "반도체 장비", "디스플레이 장비", "TGV 장비"
GLASS_TERMS = ["TGV", "Through Glass Via", "유리기판", "Glass Substrate", "관통전극"]
DISPLAY_TERMS = ["디스플레이", "oled", "lcd", "패널", "글라스"]
HARD = ["매각", "취소"]

# What a value looks like where it follows its marker.
VALUES = {
    "number": r"(\d+)",
    "number_within": r'[^"\d]*(\d+)',
    "word": r"(\w+)",
    "quoted": r'((?:[^"\\]|\\.)*)',
    "inner": r"[^<>]*>\s*([^<]*?)\s*<",
    "link": r"[^<>]*>\s*(.*?)\s*</a>",
    "date": r"\s*(\d[\d./-]+)",
}
DAY = r"{}\s*[.-]\s*{}\s*[.-]\s*{}".format(r"(\d{4})", r"(\d{1,2})", r"(\d{1,2})")
ANY_DAY = DAY.replace("(", "(?:")


def row_form(end: str, *fields: tuple[str, str | None]) -> str:
    """The expression of a list row from its end and the markers of its fields in order; between two fields stands anything but the end. A field without value only has to be there."""
    return "(?s)" + f"(?:(?!{re.escape(end)}).)*?".join(re.escape(marker) + (VALUES[value] if value else "") for marker, value in fields)


def _label(words: str) -> str:
    """A label, its words with or without blanks between them, with what may stand between it and its value."""
    return r"\s*".join(map(re.escape, words.split())) + r"[\s:：~]*"


def deadline(label: str) -> str:
    """The day after a label."""
    return _label(label) + DAY


def period_end(label: str) -> str:
    """The second of two days after a label."""
    return _label(label) + ANY_DAY + r"\D{1,12}" + DAY


# The markers of the sites' list rows and of their attachments' links.
KANC_ROW = row_form("</tr>", ('class="hide">', "number"), ("cid=", "number"), ("hcid=38", "link"), ('class="list_date">', "date"))
NNFC_ROW = row_form("</tr>", ('data-ntt-id="', "quoted"), ("bbs-subject-txt", "inner"), ('class="regDate">', "date"))
KOTRA_CARD = row_form("</li>", ("dtlBizMntNo=", "word"), ("cpbizYn=N", "inner"))
KRISS_ROW = row_form("</tr>", ("m_hidden", "inner"), ("list_no=", "number"), ("", "link"), ("<td>", "date"), ("<td>", "date"))
EBNEW_BLOCK = {"tag": r"abstract-tag[^<>]*>\s*([^<]*?)\s*<", "key": r'href="[^"\d]*(\d+)', "title": r'title="([^"]*)"', "list_date": r"(\d{4}-\d{2}-\d{2})"}
MOFCOM_PAYLOAD = "maxPageNum int, rows array<struct<fdid string, name string, digest string, publishTime string, createTime string, industryName string, areaName string>>"
#: The form of a national bid number.
BID_NUMBER = r"\b[A-Z]\d{2}[A-Z]{2}\d{8}-\d{3}\b"
SIZE_NOTE = r"\s*\[[^\[\]]*B\s*\]\s*$"


def kanc_files(html: Column) -> Column:
    """Download calls with three arguments, an image and the name."""
    call = lambda k: X.all_matches(html, r"getDownloadFile\(\s*'(\d+)'\s*,\s*'(\d+)'\s*,\s*'([^']+)'[^<]*<img[^>]*>([^<]*)</a>", k)
    rows = F.arrays_zip(*(call(k).alias(n) for k, n in ((1, "b"), (2, "c"), (3, "f"), (4, "n"))))
    return X.named_files(F.transform(rows, lambda x: F.struct(x["n"].alias("name"), F.concat(F.lit("/cwsboard/board.do?bid="), x["b"], F.lit("&mode=download&cid="), x["c"], F.lit("&filename="), x["f"]).alias("url"))))


def nnfc_files(html: Column) -> Column:
    """Links that carry a file's id and number; the size behind the name is no part of it."""
    attribute = lambda x, name: F.regexp_extract(x, name + r'="([^"]+)"', 1)
    links = X.all_matches(html, r"(?s)(<a\b[^>]*data-atch-file-id.*?)</a>", 1)
    name = lambda x: F.regexp_replace(X.strip_tags(F.regexp_extract(x, r"(?s)>(.*)$", 1)), SIZE_NOTE, "")
    return X.named_files(F.transform(links, lambda x: F.struct(name(x).alias("name"), F.concat(F.lit("/cmm/fms/"), attribute(x, "data-atch-file-id"), F.lit("/"), attribute(x, "data-file-sn"), F.lit("/FileDown.do")).alias("url"))))


def kotra_files(html: Column) -> Column:
    """Links to the file service."""
    return X.links(html, r'href="([^"]*/file/fileDown\.do[^"]*)"[^>]*>([^<]*)</a>')


def kriss_files(html: Column) -> Column:
    """List items of the block of files: the link, and the name before the span with its size."""
    items = X.all_matches(F.regexp_extract(html, r'(?s)<div class="file[^"]*">(.*?)</div>', 1), r"(?s)<li\b[^>]*>(.*?)</li>", 1)
    rows = F.transform(items, lambda x: F.struct(X.strip_tags(F.get(F.split(F.regexp_extract(x, r"(?s)<a\b[^>]*>(.*)", 1), "<span|</a>", 2), F.lit(0))).alias("name"), F.regexp_extract(x, r'href="([^"]+)"', 1).alias("url")))
    return X.named_files(F.filter(rows, lambda x: x["url"] != ""))


_korean = [(DISPLAY, DISPLAY_TERMS), (GLASS, GLASS_TERMS)]
_chinese = [(SEMI, ["半导体", "晶圆", "刻蚀"]), (DISPLAY, ["显示", "oled", "面板"]), (GLASS, ["玻璃基板", "tgv"])]
_industry = [t for _, terms in _chinese for t in terms]
_signals = ["반도체", "웨이퍼", "디스플레이", "oled", "유리기판", "세정", "진공"]
_chinese_words = Translation(
    numbers=[(r"第(\d+(?:\.\d+)?)代", "제$1세대")],
    glossary=translate.compile_glossary([(0, "京东方", "BOE"), (3, "半导体", "반도체"), (3, "刻蚀机", "식각기"), (4, "设备", "장비"), (4, "采购", "구매"), (4, "项目", "프로젝트")]),
    regions=[("陕西", "산시성"), ("河北", "허베이성"), ("苏州", "쑤저우")],
)


def _summary(html: Column) -> Column:
    return F.nullif(X.keep_lines(X.unescape_entities(F.regexp_extract(html, r'(?s)id="txtArea"[^>]*>(.*?)</textarea>', 1))), F.lit(""))


def _tags(html: Column) -> Column:
    return X.tag_list(html, r'(?s)class="nHtagArea"\s*>\s*<ul>(.*?)</ul>')


def _period(label: str, end: str) -> Callable[[Column], Column]:
    return lambda html: X.safe_date(X.period(F.replace(html, F.lit("&nbsp;"), F.lit(" ")), label, "상시")[end])


def _country(part: str) -> Callable[[Column], Column]:
    names = {"베트남": "VN", "일본": "JP", "미국": "US", "독일": "DE", "중국": "CN", "대만": "TW"}  # a sample; the caller's data like all terms
    return lambda html: X.resolve_country(_tags(html), names, X.location_hint(X.strip_tags(html), "사업진행장소", [("overseas", "해외"), ("home", "국내")]), ("국내", "KR"), "해외(국가 확인 필요)", "확인 필요")[part]


def _either(*labels: str) -> Callable[[Column], Column]:
    """The first label that has a value, up to the next label."""
    return lambda text: F.coalesce(*(X.field_until_label(text, label, "[一-鿿]{2,10}") for label in labels))


_not_built, _low = ["二次配管", "独立基础", "土建"], ["维修", "租赁"]
_purchase = lambda text: rules.purchase_context(text, _not_built, ["设备采购", "采购项目"], ["采购", "购置"], ["设备", "刻蚀机"])

register_source(SourceProfile(
    "KANC", "한국나노기술원", "KR", pattern_rows(KANC_ROW, ["no", "key", "title", "list_date"]), "cid", posted=lambda: X.dotted_date(F.col("list_date")),
    due_patterns=[deadline("의견 마감 일시"), deadline("마감 일시"), period_end("기간")],
    verdicts=[("exclude_hard", HARD), ("exclude_service", ["장비운용", "운용용역", "관리용역"]), ("include", ["구매", "제작", "장비", "설비"]), ("exclude_service", ["위탁", "교육", "행사"])],
    categories=_korean, default_category=SEMI, notice_types=[("사전규격", ["사전규격"])],
    fields={"budget_amount": lambda t: X.budget_after_label(t, "사업예산"), "contract_method": lambda t: X.labelled_text(t, "계약방법"), "delivery_condition": lambda t: X.labelled_text(t, "인도조건"), "payment_condition": lambda t: X.labelled_text(t, "지급조건")},
    page_fields={"attachments": kanc_files}, constants={"org": "한국나노기술원"},
))
register_source(SourceProfile(
    "NNFC", "나노종합기술원", "KR", pattern_rows(NNFC_ROW, ["key", "title", "list_date"]), "nttid", posted=lambda: X.iso_date(F.col("list_date")),
    due_patterns=[deadline("마감 일시"), deadline("입찰 마감")],
    verdicts=[("exclude_hard", HARD), ("exclude_result", ["결과안내", "평가결과"]), ("exclude_service", ["용역", "교육", "전시"])], default_verdict="include",
    categories=_korean, default_category=SEMI, notice_types=[("소액수의", ["소액수의"])],
    fields={"budget_amount": lambda t: X.budget_any_currency(t, ["사업예산", "배정예산"], ["사업예산", "배정예산"], "원")["amount"], "budget_currency": lambda t: X.budget_any_currency(t, ["사업예산", "배정예산"], ["사업예산", "배정예산"], "원")["currency"]},
    page_fields={"attachments": nnfc_files}, constants={"org": "나노종합기술원"},
))
register_source(SourceProfile(
    "KOTRA", "대한무역투자진흥공사", None, pattern_rows(KOTRA_CARD, ["key", "title"]), "kotra", lookback_days=None,
    list_stage=lambda t: X.short_or_any(t, _signals), detail_stage=lambda t: X.short_or_any(t, _signals),
    whole_text=lambda: F.concat_ws(" ", "title", "_description", F.array_join("_tags", " ")),
    categories=[(SEMI, ["반도체", "웨이퍼", "세정", "진공"]), (DISPLAY, DISPLAY_TERMS), (GLASS, GLASS_TERMS)], short_terms=True,
    notice_types=[("수출상담회", ["수출상담회"]), ("구매상담회", ["구매상담회", "바이어상담"]), ("공급사 모집", ["공급사모집", "파트너모집"])], default_type="사업안내", keep_expired=True,
    page_fields={
        "description": _summary, "tags": _tags, "attachments": kotra_files, "due_date": _period("신청기간", "end"), "posted_date": _period("신청기간", "start"), "country": _country("name"), "country_code": _country("iso"),
        "org": lambda h: F.coalesce(F.nullif(X.strip_tags(F.regexp_extract(h, r"(?s)주관부서\s*</th>\s*<td>(.*?)</td>", 1)), F.lit("")), F.lit("확인 필요")),
        "event_period": lambda h: F.struct(_period("개최기간", "start")(h).alias("start"), _period("개최기간", "end")(h).alias("end")),
    },
))
register_source(SourceProfile(
    "EBNEW", "중국 비롄왕(EBNEW)", "CN", block_rows("abstract-title", EBNEW_BLOCK), "ebnew", posted=lambda: F.col("list_date"), due_patterns=[deadline("截止时间")],
    list_stage=lambda t: rules.list_relevant(t, _not_built, _industry, _low), detail_stage=_purchase, second_key=True, whole_text=lambda: F.concat_ws(" ", "title", "_summary", "plain"),
    categories=_chinese, keep_expired=True, lookback_days=14,
    fields={
        "org": _either("招标人", "招标机构"), "region": _either("招标地区", "项目地区"), "summary": _either("招标产品"), "project_no": _either("项目编号"),
        "budget_amount": lambda t: X.budget_with_unit(t, ["采购预算", "项目预算", "预算金额"])["amount"], "budget_currency": lambda t: X.budget_with_unit(t, ["采购预算", "项目预算", "预算金额"])["currency"],
    },
    constants={"detected_language": "zh-CN", "source_country": "CN"}, translation=_chinese_words,
))
register_source(SourceProfile(
    "MOFCOM", "중국국제초표망(MOFCOM)", "CN", payload_rows(MOFCOM_PAYLOAD, "rows", {"key": "fdid", "title": "name", "digest": "digest", "published": "publishTime", "created": "createTime", "industry": "industryName", "area": "areaName"}, "maxPageNum"), "mofcom",
    posted=lambda: F.substring(F.coalesce("published", "created"), 1, 10), due_patterns=[deadline("投标截止时间（开标时间）")], list_text=lambda: F.concat_ws(" ", "title", "digest"),
    list_stage=lambda t: rules.list_relevant(t, _not_built, _industry, _low), detail_stage=_purchase, second_key=True, whole_text=lambda: F.concat_ws(" ", "title", "digest", "plain"),
    categories=_chinese, keep_expired=True, lookback_days=14,
    fields={"org": lambda t: F.coalesce(_either("招标人")(t), F.col("industry")), "region": lambda t: F.coalesce(X.field_until_label(t, "项目实施地点", "[一-鿿]{2,10}", 20), F.col("area")), "summary": lambda t: F.nullif(F.col("digest"), F.lit("")), "project_no": _either("招标项目编号")},
    constants={"detected_language": "zh-CN", "source_country": "CN"}, translation=_chinese_words,
))
register_source(SourceProfile(
    "KRISS", "한국표준과학연구원", "KR", pattern_rows(KRISS_ROW, ["notice_no", "key", "title", "list_date", "due_day"]), "kriss", posted=lambda: X.slash_date(F.col("list_date")), due=lambda: X.slash_date(F.col("due_day")),
    verdicts=[("exclude_hard", HARD), ("include", ["반도체", "진공", "플라즈마", "펌프"]), ("exclude_service", ["청소", "시설관리"])], categories=_korean, default_category=SEMI, notice_types=[("사전규격", ["사전규격"])],
    fields={"national_bid_no": lambda t: F.regexp_substr(t, F.lit(BID_NUMBER))}, page_fields={"attachments": kriss_files}, constants={"org": "한국표준과학연구원"},
))
