"""Text to records by a pluggable backend.

A backend turns (text, system prompt, record type, setting) into JSON text. The
rule backend needs no network; http_backend asks a model server, and is used
only where it is passed.
"""

from __future__ import annotations

import http.client
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..schema import RECORDS, problems, split_valid, validated
from ..session import ship_package

# The system prompts, for one record and for all of a kind.
PROMPT_ONE = """You are an expert information extractor for industrial manufacturing knowledge.
Extract a {name} from the given text.
Context: {doc}
The input text is in {language}.
Only extract information that is explicitly stated in the text.
Leave fields as null if the information is not present."""
PROMPT_ALL = """You are an expert information extractor for industrial manufacturing knowledge.
Extract ALL {name} instances from the given text.
Context: {doc}
The input text is in {language}.
Only extract information that is explicitly stated in the text.
Leave fields as null if the information is not present.
If no {name} is found, return an empty list."""

Backend = Callable[[str, str, str, "ExtractorSettings"], str]


@dataclass(frozen=True)
class ExtractorSettings:
    model: str = "llama3.1:8b"
    language: str = "German"
    temperature: float = 0.0
    max_retries: int = 3


def system_prompt(record: str, language: str = "German", many: bool = False) -> str:
    return (PROMPT_ALL if many else PROMPT_ONE).format(name=record, doc=RECORDS[record][0], language=language)


def extract(df: DataFrame, text: str, record: str, backend: Backend, settings: ExtractorSettings = ExtractorSettings(), prompt: str | None = None, many: bool = False) -> DataFrame:
    """df with column payload: the backend's JSON text for each text, of one
    record or (many) of a list; null where every attempt failed.

    The backend is called again, up to max_retries times in all, while it
    raises, returns no JSON, or returns what violates the record type; what was
    wrong is added to the prompt. An answer that still violates it at the end is
    kept, for the quarantine. A null
    text is not sent. Partitions run at the same time: repartition for more.
    """
    ship_package(df.sparkSession)
    sent = prompt or system_prompt(record, settings.language, many)

    def attempt(t: str | None) -> str | None:
        kept, wrong = None, ""
        for _ in range(max(1, settings.max_retries) if t is not None else 0):
            try:
                answer = backend(t, sent + wrong, record, settings)
            except Exception:  # noqa: BLE001 - a failed request is tried again
                continue
            try:
                value = json.loads(answer)
            except (TypeError, ValueError):
                wrong = "\nYour last answer was no JSON. Answer again, with JSON alone."
                continue
            items = value.get("items") if many and isinstance(value, dict) else [value]
            found = [p for x in items for p in problems(x, record)] if isinstance(items, list) else ["items: missing"]
            if not found:
                return answer
            kept, wrong = answer, f"\nYour last answer did not fit ({'; '.join(dict.fromkeys(found))}). Answer again, with these put right."
        return kept

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(attempt).astype(object).where(lambda s: s.notna(), None)

    # A model may answer differently each time, and each call costs: filters on the answer must not repeat it.
    return df.withColumn("payload", call.asNondeterministic()(F.col(text)))


def extract_records(df: DataFrame, text: str, record: str, backend: Backend, settings: ExtractorSettings = ExtractorSettings(), prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the record as a struct, quarantined rows)."""
    return split_valid(validated(extract(df, text, record, backend, settings, prompt), "payload", record))


def extract_list(df: DataFrame, text: str, record: str, backend: Backend, settings: ExtractorSettings = ExtractorSettings(), prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each extracted item, with its position, and the quarantined
    items. The backend answers {"items": [...]}."""
    rows = extract(df, text, record, backend, settings, prompt, many=True)
    items = F.try_variant_get(F.try_parse_json("payload"), "$.items", "array<variant>")
    rows = rows.select(*df.columns, F.posexplode(F.transform(items, lambda v: F.to_json(v))).alias("pos", "payload"))
    return split_valid(validated(rows, "payload", record))


# Where a local model server listens, and the key it expects.
LOCAL_SERVER, LOCAL_KEY = "http://localhost:11434/v1", "ollama"


_CONNECTIONS: dict[tuple[str, str], http.client.HTTPConnection] = {}


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    """The answer to a request, over the connection that this worker keeps to
    the server; a connection that was closed meanwhile is opened again once."""
    parts = urlsplit(url)
    key = (parts.scheme, parts.netloc)
    for fresh in (False, True):
        if fresh or key not in _CONNECTIONS:
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            _CONNECTIONS[key] = kind(parts.netloc, timeout=timeout)
        try:
            _CONNECTIONS[key].request("POST", parts.path, body, headers)
            answer = _CONNECTIONS[key].getresponse()
            data = answer.read()
        except (http.client.HTTPException, OSError):
            _CONNECTIONS.pop(key).close()
            if fresh:
                raise
            continue
        if answer.status >= 400:
            raise OSError(f"{answer.status} {answer.reason}")
        return data
    raise OSError("no answer")


def http_backend(url: str = LOCAL_SERVER, key: str = LOCAL_KEY, timeout: float = 120.0) -> Backend:
    """A backend that asks a model over HTTP (chat completions in JSON mode). A
    worker opens one connection and keeps it. Nothing uses it by itself."""

    def ask(text: str, prompt: str, record: str, settings: ExtractorSettings) -> str:
        body = {
            "model": settings.model, "temperature": settings.temperature, "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}],
        }
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        return json.loads(_post(f"{url}/chat/completions", json.dumps(body).encode(), headers, timeout))["choices"][0]["message"]["content"]

    return ask


# A maker-like word, then a model code: what the rule backend takes for a tool.
TOOL_PATTERN = r"([A-ZÄÖÜ][a-zäöüß]+) ([A-Z]{2}-[0-9]+)"


def rule_backend(text: str, prompt: str, record: str, settings: ExtractorSettings) -> str:
    """Tools named by maker and model code, in order of appearance, as a list."""
    items = [{"name": f"{m.group(1)} {m.group(2)}", "manufacturer": m.group(1), "model": m.group(2)} for m in re.finditer(TOOL_PATTERN, text)] if record == "Tool" else []
    return json.dumps({"items": items}, ensure_ascii=False)


def rule_backend_one(text: str, prompt: str, record: str, settings: ExtractorSettings) -> str:
    """The first of what rule_backend finds, as one record; an empty one if
    there is none."""
    items = json.loads(rule_backend(text, prompt, record, settings))["items"]
    return json.dumps(items[0] if items else {}, ensure_ascii=False)


def dump_json(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of each row as indented JSON with nulls kept."""
    return df.select(F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))


def dump_dict(row: Row) -> dict:
    """A record that was fetched as nested dicts and lists."""
    return row.asDict(recursive=True)
