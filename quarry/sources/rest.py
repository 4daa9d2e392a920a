"""Requests to a knowledge base: built as Columns, sent by tasks through an injected transport."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# The server's version, its words, and rules that it applies.
VERSION = "v1"
INDEXING = ("high_quality", "economy")
MODES = ("automatic", "custom")
PERMISSIONS = ("only_me", "all_team_members", "partial_members")
PROVIDERS = ("vendor", "external")
SEPARATOR, MAX_TOKENS = "\n\n\n", 10000


class RequestFailed(Exception):
    """A status of 400 or more, or no answer at all."""


def _one_of(value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{value!r} is none of {', '.join(known)}")
    return value


def _null() -> Column:
    return F.lit(None).cast("string")


def process_rule(separator: str = SEPARATOR, max_tokens: int = MAX_TOKENS, extra_spaces: bool = True, urls_emails: bool = True, mode: str = "custom") -> Column:
    """How the server cleans and cuts a document; in automatic mode without rules of one's own."""
    if _one_of(mode, MODES) == "automatic":
        return F.struct(F.lit(mode).alias("mode"), _null().alias("rules"))
    flag = lambda name, on: F.struct(F.lit(name).alias("id"), F.lit(on).alias("enabled"))
    rules = F.struct(F.array(flag("remove_extra_spaces", extra_spaces), flag("remove_urls_emails", urls_emails)).alias("pre_processing_rules"), F.struct(F.lit(separator).alias("separator"), F.lit(max_tokens).alias("max_tokens")).alias("segmentation"))
    return F.struct(F.lit(mode).alias("mode"), rules.alias("rules"))


def segment(content: Column, answer: Column | None = None, keywords: Column | None = None, enabled: bool = True) -> Column:
    none = F.lit(None)
    return F.struct(content.alias("content"), (none.cast("string") if answer is None else answer).alias("answer"), (none.cast("array<string>") if keywords is None else keywords).alias("keywords"), F.lit(enabled).alias("enabled"))


def request(method: str, path: Column, body: Column | None = None, file: Column | None = None) -> Column:
    """method, path, body (JSON, nulls kept) and file (name and content) of a call."""
    text = F.to_json(body, {"ignoreNullFields": "false"}) if body is not None else _null()
    return F.struct(F.lit(method).alias("method"), path.alias("path"), text.alias("body"), (F.lit(None) if file is None else file).cast("struct<name:string,content:binary>").alias("file"))


def _at(*parts: Column | str) -> Column:
    return F.concat(F.lit(f"/{VERSION}"), *[F.concat(F.lit("/"), F.lit(p) if isinstance(p, str) else p) for p in parts])


def _query(path: Column, **params: Column | str | int | None) -> Column:
    """The path with the parameters that are given and not empty."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode((v if isinstance(v, Column) else F.lit(v)).cast("string"))) for k, v in params.items() if isinstance(v, Column) or v]
    return F.concat(path, F.lit("?"), F.concat_ws("&", *pairs)) if pairs else path


def _config(name: Column | None, rule: Column | None, indexing: str) -> list[Column]:
    return [(_null() if name is None else name).alias("name"), F.lit(_one_of(indexing, INDEXING)).alias("indexing_technique"), (process_rule(mode="automatic") if rule is None else rule).alias("process_rule")]


def _file(path: Column, content: Column) -> Column:
    return F.struct(F.regexp_replace(path, r"^.*/", "").alias("name"), content.alias("content"))


def create_by_text(dataset: Column, name: Column, text: Column, rule: Column | None = None, indexing: str = "high_quality") -> Column:
    return request("POST", _at("datasets", dataset, "document", "create_by_text"), F.struct(*_config(name, rule, indexing), text.alias("text")))


def create_by_file(dataset: Column, path: Column, content: Column, rule: Column | None = None, indexing: str = "high_quality") -> Column:
    return request("POST", _at("datasets", dataset, "document", "create_by_file"), F.struct(*_config(None, rule, indexing)), _file(path, content))


def update_by_text(dataset: Column, document: Column, name: Column, text: Column, rule: Column | None = None, indexing: str = "high_quality") -> Column:
    return request("POST", _at("datasets", dataset, "documents", document, "update_by_text"), F.struct(*_config(name, rule, indexing), text.alias("text")))


def update_by_file(dataset: Column, document: Column, path: Column, content: Column, rule: Column | None = None, indexing: str = "high_quality") -> Column:
    return request("POST", _at("datasets", dataset, "documents", document, "update_by_file"), F.struct(*_config(None, rule, indexing)), _file(path, content))


def create_dataset(name: Column, description: Column | None = None, indexing: str = "high_quality", permission: str = "only_me", provider: str = "vendor", external_api: str | None = None, external_id: str | None = None) -> Column:
    outer = [F.lit(v).alias(k) for k, v in (("external_knowledge_api", external_api), ("external_knowledge_id", external_id)) if v]
    body = F.struct(name.alias("name"), F.lit(_one_of(indexing, INDEXING)).alias("indexing_technique"), (_null() if description is None else description).alias("description"), F.lit(_one_of(permission, PERMISSIONS)).alias("permission"), F.lit(_one_of(provider, PROVIDERS)).alias("provider"), *outer)
    return request("POST", _at("datasets"), body)


def list_datasets(page: Column | int, limit: Column | int) -> Column:
    if not isinstance(page, Column) and not page or not isinstance(limit, Column) and not limit:
        raise ValueError("page and limit are needed")
    return request("GET", _query(_at("datasets"), page=page, limit=limit))


def delete_dataset(dataset: Column) -> Column:
    return request("DELETE", _at("datasets", dataset))


def batch_status(dataset: Column, batch: Column) -> Column:
    return request("GET", _at("datasets", dataset, "documents", batch, "indexing-status"))


def delete_document(dataset: Column, document: Column) -> Column:
    return request("DELETE", _at("datasets", dataset, "documents", document))


def list_documents(dataset: Column, keyword: Column | str | None = None, page: Column | int | None = None, limit: Column | int | None = None) -> Column:
    return request("GET", _query(_at("datasets", dataset, "documents"), page=page, limit=limit, keyword=keyword))


def add_segments(dataset: Column, document: Column, segments: Column) -> Column:
    return request("POST", _at("datasets", dataset, "documents", document, "segments"), F.struct(segments.alias("segments")))


def update_segment(dataset: Column, document: Column, segment_id: Column, new: Column) -> Column:
    return request("POST", _at("datasets", dataset, "documents", document, "segments", segment_id), F.struct(new.alias("segment")))


def list_segments(dataset: Column, document: Column, keyword: str | None = None, status: str | None = None) -> Column:
    """Filters go in the body, as the server wants them."""
    some = {k: v for k, v in (("keyword", keyword), ("status", status)) if v}
    body = F.struct(*[F.lit(v).alias(k) for k, v in some.items()]) if some else F.create_map().cast("map<string,string>")
    return request("GET", _at("datasets", dataset, "documents", document, "segments"), body)


def delete_segment(dataset: Column, document: Column, segment_id: Column) -> Column:
    return request("DELETE", _at("datasets", dataset, "documents", document, "segments", segment_id))


def upload(files: DataFrame, dataset: str, rule: Column | None = None, indexing: str = "high_quality") -> DataFrame:
    """path and request: each file of a folder (``files.read_files``) as a document to create."""
    return files.select("path", create_by_file(F.lit(dataset), F.col("path"), F.col("content"), rule, indexing).alias("request"))


def send(requests: DataFrame, transport: Callable[[str, str, str | None, tuple[str, bytes] | None], int], column: str = "request") -> None:
    """Each task sends its rows by ``transport(method, path, body, file)``; a status of 400 or more fails the task, which is tried again."""

    def part(rows):
        for r in rows:
            q = r[column]
            status = transport(q["method"], q["path"], q["body"], (q["file"]["name"], bytes(q["file"]["content"])) if q["file"] else None)
            if status != 200:
                log.error("%s %s: %s", q["method"], q["path"], status)
            if status >= 400:
                raise RequestFailed(f"{q['method']} {q['path']}: {status}")

    requests.select(column).foreachPartition(part)
