"""Requests to a recognition model, the batched stage that sends them, and its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prompts and sampling parameters of the model.
PROMPTS = {"layout": "\nLayout Detection:", "table": "\nTable Recognition:", "equation": "\nFormula Recognition:", "image": "\nImage Analysis:", "chart": "\nImage Analysis:"}
TEXT_PROMPT = "\nText Recognition:"
SYSTEM_PROMPT = "You are a helpful assistant."
END_TOKEN = "<|im_end|>"
ATTEMPTS, DELAYS = 3, (0.2, 0.5)
STAGES = ("layout", "extract")


def prompt(kind: Column) -> Column:
    out = F.lit(TEXT_PROMPT)
    for k, p in PROMPTS.items():
        out = F.when(kind == k, F.lit(p)).otherwise(out)
    return out


def presence_penalty(kind: Column) -> Column:
    return F.when(kind == "layout", F.lit(0.0)).otherwise(F.lit(1.0))


def frequency_penalty(kind: Column) -> Column:
    return F.when(kind == "layout", F.lit(0.0)).when(kind == "table", F.lit(0.005)).otherwise(F.lit(0.05))


def request_body(kind: Column, model: Column, png: Column, priority: Column) -> Column:
    """The chat request as JSON. Three parameters are left out for models whose name begins with gpt, null ones for all."""
    gpt = F.lower(model).startswith("gpt")
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    image = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("data:image/png;base64,"), F.base64(png)).alias("url")).alias("image_url")).cast(part)
    words = F.struct(F.lit("text").alias("type"), prompt(kind).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part)
    user = F.when(png.isNotNull(), F.array(image, words)).otherwise(F.array(words))
    messages = [F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")), {"ignoreNullFields": "true"}) for role, content in (("system", F.lit(SYSTEM_PROMPT)), ("user", user))]
    rest = F.to_json(
        F.struct(
            F.lit(0.0).alias("temperature"),
            F.lit(0.01).alias("top_p"),
            F.when(~gpt, F.lit(False)).alias("skip_special_tokens"),
            F.when(~gpt, F.lit(1)).alias("top_k"),
            presence_penalty(kind).alias("presence_penalty"),
            frequency_penalty(kind).alias("frequency_penalty"),
            F.when(~gpt, F.lit(1.0)).alias("repetition_penalty"),
            F.struct(F.lit(100).alias("no_repeat_ngram_size"), F.lit(False).alias("debug")).alias("vllm_xargs"),
            priority.cast("int").alias("priority"),
        ),
        {"ignoreNullFields": "true"},
    )
    head = F.to_json(F.struct(model.alias("model")))
    # the messages' contents have two types, so the body is put together from JSON texts
    return F.concat(F.left(head, F.length(head) - 1), F.lit(',"messages":['), messages[0], F.lit(","), messages[1], F.lit("],"), F.substr(rest, F.lit(2)))


_RESPONSE = "struct<object:string,choices:array<struct<finish_reason:string,message:struct<content:string>>>>"


def response_content(body: Column, end_token: str = END_TOKEN) -> Column:
    """The first choice's text without the end token; null where response_error() is not."""
    first = F.try_element_at(F.from_json(body, _RESPONSE)["choices"], F.lit(1))
    content = F.coalesce(first["message"]["content"], F.lit(""))
    cut = F.when(content.endswith(end_token), F.left(content, F.length(content) - len(end_token))).otherwise(content)
    return F.when(response_error(body).isNull(), cut)


def response_error(body: Column) -> Column:
    data = F.from_json(body, _RESPONSE)
    first = F.try_element_at(data["choices"], F.lit(1))
    why = first["finish_reason"]
    # fixed values: the messages
    return (
        F.when(data["object"] == "error", F.concat(F.lit("Error from server: "), body))
        .when(first.isNull(), F.lit("No choices found in the response."))
        .when(why.isNull(), F.lit("Finish reason is None in the response."))
        .when(~why.isin("stop", "length"), F.concat(F.lit("Unexpected finish reason: "), why))
    )


def retryable(status: Column, code: Column, kind: Column) -> Column:
    """429, 5xx, or an error that names a rate limit or the server; a null status is a failed connection."""
    return status.isNull() | (status == 429) | status.between(500, 599) | F.coalesce(code == "rate_limit_exceeded", F.lit(False)) | F.coalesce(kind == "server_error", F.lit(False))


def server_url(c: Column) -> Column:
    """Without white space, last slashes and /v1; else the origin, null if there is none."""
    plain = F.regexp_replace(F.trim(c), "/+$", "")
    origin = F.regexp_extract(plain, "^(https?://[^/]+)", 1)
    return F.when(plain.endswith("/v1"), F.regexp_replace(plain, "(/v1)+$", "")).when(origin != "", origin)


class Failed(Exception):
    """An answer other than a success; status is null for a failed connection."""

    def __init__(self, message: str, status: int | None = None, code: str | None = None, kind: str | None = None):
        super().__init__(message)
        self.status, self.code, self.kind = status, code, kind

    def again(self) -> bool:
        return self.status is None or self.status == 429 or 500 <= self.status <= 599 or self.code == "rate_limit_exceeded" or self.kind == "server_error"


def send(requests: DataFrame, transport: Callable[[str], str], threads: int = 8, body: str = "body", attempts: int = ATTEMPTS, most_in_flight: int | None = None, fail_fast: bool = False) -> DataFrame:
    """requests with response, failure (null on success) and elapsed_ms.

    Batches of a partition go through a thread pool, which bounds the requests
    in flight to partitions x threads; with most_in_flight there are no more
    partitions than that allows. A retry is idempotent: the request is the row.
    Errors stay in their row, so one bad page does not end the job, unless
    fail_fast is set: then the first one does.
    """

    def one(text: str) -> tuple[str | None, str | None, int]:
        began = time.monotonic()
        taken = lambda: int(1000 * (time.monotonic() - began))
        for i in range(attempts):
            try:
                return transport(text), None, taken()
            except Failed as e:
                if i + 1 == attempts or not e.again():
                    if fail_fast:
                        raise
                    return None, str(e), taken()
                time.sleep(DELAYS[min(i, len(DELAYS) - 1)])
        return None, "no attempt", taken()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                found = list(pool.map(one, b.column(b.schema.get_field_index(body)).to_pylist()))
                told = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *told], [*b.schema.names, "response", "failure", "elapsed_ms"])

    if most_in_flight is not None:
        requests = requests.coalesce(max(1, most_in_flight // threads))
    schema = T.StructType(list(requests.schema.fields)).add("response", T.StringType()).add("failure", T.StringType()).add("elapsed_ms", T.LongType())
    return requests.mapInArrow(run, schema)


def page_priority(page_idx: Column) -> Column:
    """Earlier pages first; the number stays within 32 bits."""
    return F.least(page_idx.cast("long"), F.lit(2**31 - 1)).cast("int")


def attach(blocks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with the content and failure of their answers (keys, content, failure); blocks that were not asked for have none."""
    return blocks.join(answers.select(*keys, "content", "failure"), keys, "left")


def window_timings(stages: DataFrame, window: list[str]) -> DataFrame:
    """Pages, blocks and milliseconds by stage of each window, from rows (window, stage, page_idx, n_blocks, elapsed_ms)."""
    spent = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("elapsed_ms"))), F.lit(0)).alias(f"{s}_ms")
    return stages.groupBy(*window).agg(F.count_distinct("page_idx").alias("n_pages"), F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"), *[spent(s) for s in STAGES])


def http_transport(base_url: str, key: str | None = None, seconds: float = 600.0) -> Callable[[str], str]:
    """A transport that posts chat requests to a server; other statuses than 200 and lost connections raise Failed."""

    def call(body: str) -> str:
        return _request(f"{base_url}/v1/chat/completions", key, seconds, body.encode())

    return call


def _request(url: str, key: str | None, seconds: float, data: bytes | None = None) -> str:
    import json
    import urllib.error
    import urllib.request

    asked = urllib.request.Request(url, data, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    try:
        with urllib.request.urlopen(asked, timeout=seconds) as answer:  # noqa: S310  the caller's own server
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        text = e.read().decode(errors="replace")
        try:
            told = json.loads(text).get("error") or {}
        except (ValueError, AttributeError):
            told = {}
        told = told if isinstance(told, dict) else {}
        raise Failed(told.get("message") or text or str(e), e.code, told.get("code"), told.get("type")) from None
    except OSError as e:
        raise Failed(str(e)) from None


_names: dict[str, str] = {}


def model_name(base_url: str, override: str | None = None, models: Callable[[str], str] | None = None) -> str:
    """The name of the server's only model, asked for once by a process; an override is taken as it is."""
    import json

    if override and override.strip():
        return override.strip()
    if base_url not in _names:
        told = json.loads((models or (lambda url: _request(url, None, 10.0)))(f"{base_url}/v1/models"))
        found = [m.get("id") for m in told.get("data") or []]
        if len(found) != 1:
            # fixed value: the message
            raise ValueError(f"Expected exactly one model from {base_url}, but got {len(found)}.")
        if not found[0]:
            raise ValueError(f"Model name is empty in response from {base_url}.")
        _names[base_url] = found[0]
    return _names[base_url]


def fake_transport(body: str) -> str:
    """A deterministic model for tests: one text box for a layout request, fixed text for others."""
    import json

    asked = json.loads(body)
    text = json.dumps(asked["messages"])
    content = "<|box_start|>0 0 1000 1000<|box_end|><|ref_start|>text<|ref_end|>" if "Layout Detection" in text else "recognized text"
    return json.dumps({"object": "chat.completion", "choices": [{"index": 0, "finish_reason": "stop", "message": {"role": "assistant", "content": content + END_TOKEN}}]})
