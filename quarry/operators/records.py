"""Medical records: which pages are some, their fields, and a text of them in a fixed order. All but the first are Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as X
from quarry.functions.dom import Node, parse


@dataclass(frozen=True)
class RecordKind:
    name: str
    headers: tuple[str, ...]
    #: Elements that a page must have: tag, data-name, data-id, and the word that its text may begin with.
    required: tuple[tuple[str, str, str, str], ...]
    fields: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


# Fixed values.
TALK = RecordKind("谈话记录", ("谈话记录]",), (("table", "基本信息", "谈话基本信息", "基本信息"), ("table", "谈话记录", "谈话记录", "谈话记录")), (), ("谈话记录",))
ADMISSION = RecordKind(
    "入院记录",
    ("入院记录]", "入出院记录]"),
    (("p", "主诉", "主诉", "主诉"), ("p", "现病史", "现病史", "现病史")),
    ("主诉", "现病史", "流行病学史", "既往史", "个人史", "婚育史", "家族史"),
    ("主诉", "现病史", "辅助检查", "阳性体格检查", "阳性辅助检查结果", "初步诊断", "补充诊断", "修正诊断", "诊疗方案"),
)
SURGERY = RecordKind(
    "手术知情同意书",
    ("手术知情同意书]",),
    (("p", "简要病情", "手术知情病历摘要", "简要病情"), ("p", "术前诊断", "手术知情诊断信息", "术前诊断"), ("p", "拟实施手术名称", "手术知情拟手术名称", "拟实施手术名称")),
    ("术中、术后可能出现的各种情况、意外、风险及并发症", "针对上述情况，医师根据医疗规范采取在术前、术中、术后预防及治疗措施"),
    ("简要病情", "术前诊断", "拟实施手术名称", "拟实施麻醉方式", "手术指征", "手术禁忌症", "术前准备"),
)
KINDS = (TALK, ADMISSION, SURGERY)
BASIC = {"性别": "gender", "年龄": "age", "科室": "department", "病案号": "medical_record_number"}
TALK_TEXT = r"(?s)谈话记录.*?\| \[(.*?)\] \|"
INITIAL = r"(?s)\| 初步诊断：.*?\| \[(.*?)\] \|"
FURTHER = r"(?s){}：(.+?)(?:医师签名|签名时间|\]|$)"
NOT_DIAGNOSIS = r"[^一-龥\d.、]+"
MIN_LENGTH = 100


def find_element(root: Node, required: tuple[str, str, str, str], nodes: list[Node] | None = None) -> Node | None:
    """The first element of the tag (of ``nodes``, where all of the page are at hand) with the data-name, else with the data-id, else whose text begins with the word and a full-width colon."""
    tag, name, id_, word = required
    own = root.all(tag) if nodes is None else [n for n in nodes if n.tag == tag]
    for k, v in (("data-name", name), ("data-id", id_)):
        for n in own:
            if n.attrs.get(k) == v:
                return n
    return next((n for n in own if n.text().startswith(f"{word}：")), None)


def kind_of(root: Node) -> str | None:
    """Name of the first kind whose header stands in the page's header element, spaces aside, and whose elements are all there."""
    header = next(iter(root.all("header")), None)
    if header is None:
        return None
    text = header.text().strip().replace(" ", "")
    nodes = root.all()
    return next((k.name for k in KINDS if any(h in text for h in k.headers) and all(find_element(root, r, nodes) for r in k.required)), None)


@F.pandas_udf(StringType())
def record_kind(html: pd.Series) -> pd.Series:
    return html.map(lambda h: kind_of(parse(h)) if h else None)


def paragraph_fields(content: Column, names: tuple[str, ...]) -> Column:
    """Map of the paragraphs that begin with a name to what follows their first full-width colon; the last of a name counts."""
    paragraphs = F.filter(F.split(content, "\n\n"), lambda p: F.contains(p, F.lit("：")))

    def entry(i: int) -> Column:
        begins = lambda p, j: F.startswith(p, F.lit(names[j]))
        own = F.filter(paragraphs, lambda p: begins(p, i) & ~reduce(or_, (begins(p, j) for j in range(i)), F.lit(False)))
        last = F.try_element_at(own, F.lit(-1))
        return F.struct(F.lit(names[i]).alias("key"), X.strip(F.substring(last, F.instr(last, "：") + 1, F.length(last))).alias("value"))

    entries = map(entry, range(len(names)))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _group(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def diagnoses(content: Column) -> Column:
    """Map of the initial, revised and supplementary diagnosis found in a record's table."""
    clean = lambda name: F.regexp_replace(_group(content, FURTHER.format(name)), NOT_DIAGNOSIS, "")
    found = {"初步诊断": X.strip(_group(content, INITIAL)), "修正诊断": clean("修正诊断"), "补充诊断": clean("补充诊断")}
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items())), lambda e: e["value"].isNotNull()))


def talk_text(content: Column) -> Column:
    found = X.strip(_group(content, TALK_TEXT))
    return F.map_from_entries(F.filter(F.array(F.struct(F.lit(TALK.name).alias("key"), found.alias("value"))), lambda e: e["value"].isNotNull()))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated one time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _overlaid(*maps: Column) -> Column:
    """Entries of all maps; a later map's count."""
    both = lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return reduce(lambda old, new: F.get(F.zip_with(F.array(old), F.array(new), both), F.lit(0)), maps)


def record_fields(content: Column, kind: RecordKind) -> Column:
    """Fields of a record that is one text."""
    return page_fields(F.array(content), kind)


#: How the text begins that has a record's diagnoses.
DIAGNOSES = "| 初步诊断"


def page_fields(texts: Column, kind: RecordKind) -> Column:
    """Fields of a record's texts: pairs of all, paragraphs of the first, diagnoses of the first table of them, a talk of the whole."""
    return _bound(texts, lambda t: _fields(t, kind))


def _fields(texts: Column, kind: RecordKind) -> Column:
    whole = F.array_join(texts, "\n")
    pairs = X.bracketed_pairs(whole)
    if kind is TALK:
        return _overlaid(pairs, talk_text(whole))
    own = paragraph_fields(F.get(texts, F.lit(0)), kind.fields)
    if kind is not ADMISSION:
        return _overlaid(pairs, own)
    table = F.get(F.filter(texts, lambda t: t.startswith(DIAGNOSES)), F.lit(0))
    # a record given as one text has its table in it
    table = F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.coalesce(table, F.lit("")))
    return _overlaid(pairs, own, diagnoses(table))


METADATA = "struct<emr_type:string,gender:string,age:string,department:string,medical_record_number:string,diagnosis:string,treatment:string>"


def page_record(texts: Column, kind: Column) -> Column:
    """(page_content, record) of a page of this kind: its text, null where it is too short, and its metadata."""
    found = F.lit(None).cast(f"struct<page_content:string,record:{METADATA}>")
    for k in reversed(KINDS):
        made = _bound(page_fields(texts, k), lambda f: F.struct(record_text(f, k).alias("page_content"), record_metadata(f, k).alias("record")))
        found = F.when(kind == k.name, made).otherwise(found)
    return found


def record_text(fields: Column, kind: RecordKind) -> Column:
    """The kind, basic facts and the listed fields, a section each; null where it stays under ``MIN_LENGTH`` characters."""
    at = lambda k: F.try_element_at(fields, F.lit(k))
    facts = F.concat(*(F.coalesce(F.concat(F.lit(k + "："), at(k), F.lit(" ")), F.lit("")) for k in BASIC))
    head = lambda k: "" if kind is TALK else f"### {k}\n\n"
    rest = [F.coalesce(F.concat(F.lit(head(k)), at(k), F.lit("\n\n")), F.lit("")) for k in kind.order]
    whole = F.concat(F.lit(f"## {kind.name}\n\n### 基本信息\n\n"), facts, F.lit("\n\n"), *rest)
    return F.when(F.length(whole) >= MIN_LENGTH, whole)


def record_metadata(fields: Column, kind: RecordKind) -> Column:
    """emr_type, the basic facts, diagnosis and treatment by priority; what is missing is empty."""
    at = lambda k: F.try_element_at(fields, F.lit(k))
    return F.struct(
        F.lit(kind.name).alias("emr_type"),
        *(F.coalesce(at(k), F.lit("")).alias(v) for k, v in BASIC.items()),
        X.diagnosis(at("修正诊断"), at("初步诊断"), at("补充诊断")).alias("diagnosis"),
        X.treatment(at("诊疗方案"), at("拟实施手术名称")).alias("treatment"),
    )
