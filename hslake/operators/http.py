"""Decoded HTTP exchanges: search, pages, URLs, headers, bodies and the archive export."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.operators.investigation import page
from hslake.plans.registry import query


def search_http(text: str) -> Column:
    """Up to eight terms that must all be found; header:, body: and status: name a part, status:4xx a range."""
    out = F.lit(True)
    for term in text.split()[:8]:
        part, _, value = term.partition(":")
        if part == "status" and value.lower().endswith("xx"):
            out &= F.col("status").between(int(value[0]) * 100, int(value[0]) * 100 + 99)
        elif part == "status":
            out &= F.col("status") == int(value)
        elif part in ("header", "body"):
            out &= T.contains(F.col("response_headers" if part == "header" else "response_body"), value)
        else:
            out &= T.any_of([T.contains(F.col(c), term) for c in ("host", "target", "method", "response_headers", "response_body")])
    return out


@query("search_http", "select id from exchanges where contains(lower(host), 'example') and contains(lower(response_headers), 's1') and status between 200 and 299")
def search(j):
    return j.exchanges.where(search_http("Example header:S1 status:2xx")).select("id")


@query("page_http", "select id, started_us from exchanges where (started_us, id) < (1704067400000000, 40) order by started_us desc, id desc limit 51")
def page_http(j):
    return page(j.exchanges, "started_us", 50, (1704067400000000, 40)).select("id", "started_us")


@query("http_detail", "select id, method, host, target, status, response_headers, strlen(response_body) as body_bytes from exchanges where id = 7")
def http_detail(j):
    return j.exchanges.where("id = 7").select("id", "method", "host", "target", "status", "response_headers", F.octet_length("response_body").cast("long").alias("body_bytes"))


@query("http_url", "select id, concat(scheme, '://', host, case when (scheme = 'https' and server_port = 443) or (scheme = 'http' and server_port = 80) then '' else concat(':', server_port) end, target) as url from exchanges")
def http_url(j):
    usual = ((F.col("scheme") == "https") & (F.col("server_port") == 443)) | ((F.col("scheme") == "http") & (F.col("server_port") == 80))
    return j.exchanges.select("id", F.concat("scheme", F.lit("://"), "host", F.when(usual, "").otherwise(F.concat(F.lit(":"), "server_port")), "target").alias("url"))


@query("http_timings", "select id, greatest(request_end_us - started_us, 0) / 1000.0 as send_ms, case when response_start_us is null then -1.0 else greatest(response_start_us - request_end_us, 0) / 1000.0 end as wait_ms, case when response_start_us is null then -1.0 else greatest(ended_us - response_start_us, 0) / 1000.0 end as receive_ms from exchanges")
def http_timings(j):
    ms = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0)) / 1000.0
    seen = lambda e: F.when(F.col("response_start_us").isNull(), -1.0).otherwise(e)
    return j.exchanges.select("id", ms("started_us", "request_end_us").alias("send_ms"), seen(ms("request_end_us", "response_start_us")).alias("wait_ms"), seen(ms("response_start_us", "ended_us")).alias("receive_ms"))


def header_value(headers: str, name: str) -> Column:
    lines = F.filter(F.split(headers, "\n"), lambda h: F.startswith(F.lower(h), F.lit(name.lower() + ":")))
    return F.trim(F.substring(F.get(lines, F.lit(0)), len(name) + 2, 1 << 20))


@query("http_header_value", "select id, trim(regexp_extract(response_headers, 'Server:([^' || chr(10) || ']*)', 1)) as server from exchanges")
def http_header_value(j):
    return j.exchanges.select("id", header_value("response_headers", "server").alias("server"))


@query("query_pairs", "select id, string_split(p, '=')[1] as name, url_decode(coalesce(string_split(p, '=')[2], '')) as value from (select id, unnest(string_split(split_part(target, '?', 2), '&')) as p from exchanges where contains(target, '?')) x where p <> ''")
def query_pairs(j):
    pairs = j.exchanges.where(F.contains("target", F.lit("?"))).select("id", F.explode(F.split(F.split_part("target", F.lit("?"), F.lit(2)), "&")).alias("p")).where("p <> ''")
    return pairs.select("id", F.split_part("p", F.lit("="), F.lit(1)).alias("name"), F.try_url_decode(F.split_part("p", F.lit("="), F.lit(2))).alias("value"))


#: Leading bytes (hexadecimal) of body kinds.
MAGIC = {"1F8B": "gzip", "89504E47": "png", "FFD8FF": "jpeg", "25504446": "pdf", "504B0304": "zip", "3C21444F": "html", "3C68746D": "html", "7B": "json"}


@query("content_kind", "select case when response_body like '<!DO%' or response_body like '<htm%' then 'html' when starts_with(response_body, '{') then 'json' when response_body = '' then 'empty' else 'other' end as kind, count(*) as n, sum(strlen(response_body)) as bytes from exchanges group by 1")
def content_kind(j):
    head = F.hex(F.substring(F.encode("response_body", "UTF-8"), 1, 4))
    kind = F.when(F.col("response_body") == "", "empty")
    for magic, name in MAGIC.items():
        kind = kind.when(F.startswith(head, F.lit(magic)), name)
    return j.exchanges.groupBy(kind.otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("response_body").cast("long")).alias("bytes"))


COMPRESSED = tuple(bytes.fromhex(m) for m, kind in MAGIC.items() if kind in ("gzip", "png", "jpeg", "pdf", "zip"))
BODY_BOUND = 8 << 20


def decode_bodies(df: DataFrame) -> DataFrame:
    """(id, encoding, decoded_bytes, text) of (id, encoding, body binary); output beyond the bound or damaged input gives null bytes."""

    def run(batches):
        for batch in batches:
            size, text = [], []
            for encoding, body in zip(batch.column("encoding").to_pylist(), batch.column("body").to_pylist()):
                wbits = {"gzip": 31, "deflate": 15, "raw": -15}.get(encoding or "")
                try:
                    raw = body or b""
                    if wbits is not None:
                        d = zlib.decompressobj(wbits)
                        raw = d.decompress(raw, BODY_BOUND)
                        if d.unconsumed_tail:
                            raise ValueError("over the bound")
                    size.append(len(raw))
                    text.append(b"\0" not in raw[:4096])
                except (zlib.error, ValueError):
                    size.append(None)
                    text.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("encoding"), pa.array(size, pa.int64()), pa.array(text)], names=["id", "encoding", "decoded_bytes", "text"])

    return df.select("id", "encoding", "body").mapInArrow(run, "id long, encoding string, decoded_bytes long, text boolean")


@query("body_inventory", "select text, count(*) as n, sum(b) as bytes from (select not contains(substr(response_body, 1, 4096), chr(0)) as text, strlen(response_body) as b from exchanges) x group by 1")
def body_inventory(j):
    """Bodies that hold text and others, with their bytes; recorded ones are plain, so nothing is decoded."""
    plain = F.instr(F.substring("response_body", 1, 4096), "\0") == 0
    return j.exchanges.groupBy(plain.alias("text")).agg(F.count("*").alias("n"), F.sum(F.octet_length("response_body").cast("long")).alias("bytes"))


def payload_entropy(df: DataFrame, least: int = 4096) -> DataFrame:
    """(id, entropy, possible_encryption) of (id, body binary): bits a byte of bodies of ``least`` bytes or more; compressed kinds aren't taken for encryption."""

    def run(batches):
        for batch in batches:
            bits, marked = [], []
            for body in batch.column("body").to_pylist():
                marked.append((body or b"").startswith(COMPRESSED))
                if body is None or len(body) < least:
                    bits.append(None)
                    continue
                p = np.bincount(np.frombuffer(body, np.uint8), minlength=256) / len(body)
                p = p[p > 0]
                bits.append(float(-(p * np.log2(p)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.float64()), pa.array([b is not None and b >= 7.8 and not m for b, m in zip(bits, marked)])], names=["id", "entropy", "possible_encryption"])

    return df.select("id", "body").mapInArrow(run, "id long, entropy double, possible_encryption boolean")


@query("payload_entropy", "select id, entropy, coalesce(entropy >= 7.8, false) as possible_encryption from (select id, case when strlen(response_body) >= 4096 then round(list_aggregate(regexp_extract_all(hex(encode(response_body)), '..'), 'entropy'), 6) end as entropy from exchanges) x")
def payload_entropy_query(j):
    return payload_entropy(j.exchanges.select("id", F.encode("response_body", "UTF-8").alias("body"))).withColumn("entropy", F.round("entropy", 6))


_HAR = """to_json({'startedDateTime': concat(strftime(make_timestamp(started_us), '%Y-%m-%dT%H:%M:%S.%g'), 'Z'), 'request': {'method': method, 'url': concat(scheme, '://', host, target)},
 'response': {'status': status, 'headers': list_transform(string_split(response_headers, chr(10)), lambda h: {'name': split_part(h, ':', 1), 'value': trim(split_part(h, ':', 2))}), 'content': {'size': strlen(response_body), 'text': response_body}}})"""


@query("export_har", f"select id, started_us, cast({_HAR} as varchar) as entry from exchanges where state <> 'encrypted'")
def export_har(j):
    """HAR 1.2 entries of what was decoded, oldest first by ``started_us``."""
    rows = j.exchanges.where("state <> 'encrypted'")
    headers = F.transform(F.split("response_headers", "\n"), lambda h: F.struct(F.split_part(h, F.lit(":"), F.lit(1)).alias("name"), F.trim(F.split_part(h, F.lit(":"), F.lit(2))).alias("value")))
    entry = F.struct(F.date_format(F.to_utc_timestamp(F.timestamp_micros("started_us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"), F.struct("method", F.concat("scheme", F.lit("://"), "host", "target").alias("url")).alias("request"), F.struct("status", headers.alias("headers"), F.struct(F.octet_length("response_body").alias("size"), F.col("response_body").alias("text")).alias("content")).alias("response"))
    return rows.select("id", "started_us", F.to_json(entry).alias("entry"))


def jwt_tokens(df: DataFrame) -> DataFrame:
    """(id, alg, issuer, expires) of up to ten distinct tokens in each (id, text)."""
    token = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)"), F.lit(1))), 1, 10)
    rows = df.select("id", F.explode(token).alias("t"))

    def part(i: int) -> Column:
        raw = F.translate(F.split_part("t", F.lit("."), F.lit(i)), "-_", "+/")
        return base64_text(F.rpad(raw, (F.ceil(F.length(raw) / 4.0) * 4).cast("int"), "="))

    return rows.select("id", F.get_json_object(part(1), "$.alg").alias("alg"), F.get_json_object(part(2), "$.iss").alias("issuer"), F.get_json_object(part(2), "$.exp").try_cast("long").alias("expires"))


def base64_text(column: Column) -> Column:
    """The text behind Base64; null where either layer is damaged."""
    return F.try_validate_utf8(F.try_to_binary(column, F.lit("base64")).cast("string"))


JWT_AT = 1704067800
_TOKENS = r"select id, unnest(list_distinct(regexp_extract_all(text, '(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)', 1))[1:10]) as t from authorizations"
_PART = "decode(from_base64(rpad(translate({p}, '-_', '+/'), cast(ceil(length({p}) / 4.0) * 4 as int), '=')))"


@query("jwt_inventory", f"select alg, issuer, case when exp is null then 'No expiry' when exp <= {JWT_AT} then 'Expired' else 'Valid' end as expiry, count(*) as n from (select json_extract_string(h, '$.alg') as alg, json_extract_string(p, '$.iss') as issuer, cast(json_extract_string(p, '$.exp') as bigint) as exp from (select {_PART.format(p="split_part(t, '.', 1)")} as h, {_PART.format(p="split_part(t, '.', 2)")} as p from ({_TOKENS}) x) y) z group by all")
def jwt_inventory(j):
    """Tokens by algorithm, issuer and whether they had expired at a given time."""
    expiry = F.when(F.col("expires").isNull(), "No expiry").when(F.col("expires") <= JWT_AT, "Expired").otherwise("Valid")
    return jwt_tokens(j.authorizations.select("id", "text")).groupBy("alg", "issuer", expiry.alias("expiry")).agg(F.count("*").alias("n"))


def element(name: str) -> str:
    return rf"<(?:\w+:)?{name}\b[^>]*>([^<]*)<"


STATUS = r'<(?:\w+:)?StatusCode\b[^>]*\bValue="[^"]*:([^":]*)"'
SIGNED = r"<(?:\w+:)?Signature\b"
SAML = {"issuer": element("Issuer"), "status": STATUS, "subject": element("NameID"), "audience": element("Audience")}


def saml_fields(df: DataFrame) -> DataFrame:
    """(id, issuer, status, subject, audience, signed) of the response in each (id, form); damaged ones have nulls, absent ones give no row."""
    sent = F.regexp_extract("form", "(?:^|&)SAMLResponse=([^&]*)", 1)
    rows = df.select("id", sent.alias("sent")).where("sent <> ''").select("id", base64_text(F.try_url_decode("sent")).alias("xml"))
    return rows.select("id", *[T.nonempty(F.regexp_extract("xml", p, 1)).alias(n) for n, p in SAML.items()], F.rlike("xml", F.lit(SIGNED)).alias("signed"))


@query("saml_inventory", "select id, " + ", ".join(f"nullif(regexp_extract(xml, '{p}', 1), '') as {n}" for n, p in SAML.items()) + f", regexp_matches(xml, '{SIGNED}') as signed from (select id, decode(from_base64(url_decode(regexp_extract(form, 'SAMLResponse=([^&]*)', 1)))) as xml from authorizations where form is not null) x")
def saml_inventory(j):
    return saml_fields(j.authorizations.select("id", "form"))
