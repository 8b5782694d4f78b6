"""Operator 1: derivative builder for web archive records.

Each response record gives two linked records: metadata (application/warc-fields: status, digests of the source's block
and payload, title, language, number of links, and every header line of the source's block under a source- prefix, in
order and with its own spelling) and conversion (the plain text of an HTML payload). Both refer to the response's record
id, date and target, carry its digests and have a date and a block digest of their own. Character references are decoded
once: numeric ones, and the HTML names that end with a semicolon. All of it is one pass in built-in functions without a
shuffle; digests are SHA-256, written sha256:<hex>.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common

#: In this order: (pattern, what takes its place). Patterns mean the same to Java and RE2.
TEXT_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|nav|article|section|header|footer|main|aside|tr|td|th|table|title|head|body|html|blockquote|pre)(?:\s[^>]*)?/?>", "\n"),
    (r"<[a-zA-Z/!][^>]*>", ""),
]
#: After the character references.
SPACE_RULES = [
    (r"[ \t\r\f\x0B\x{A0}]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
#: Names that are looked up first, as the JVM looks through a map from its start.
COMMON = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo"]
#: What each named reference stands for, from the standard library's table.
NAMED = {name: html5[f"{name};"] for name in [*COMMON, *name2codepoint, *sorted(n[:-1] for n in html5 if n.endswith(";"))] if f"{name};" in html5}
#: What a reference holds between ampersand and semicolon: a name, or # and a decimal or hexadecimal number.
REFERENCE = r"^([a-zA-Z][a-zA-Z0-9]{0,40}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
#: When a page was fetched, if the table doesn't say.
FETCHED = "2026-01-01T00:00:00Z"
LINK = r"(?i)<a\s[^>]*href"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z-]+)"
STATUS = r"^HTTP/[0-9.]+ ([0-9]{3})"
CONTENT_TYPE = r"(?i)\ncontent-type:[ \t]*([^\r\n]*)"


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def urn(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, fetched: str = FETCHED) -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, block, block_digest) from fetched pages (page_id, url, html); a null html is an empty payload."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, html)
    return pages.select("page_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html).alias("record_id"), url.alias("target_uri"), F.lit(fetched).alias("date"), block.alias("block"), digest(block).alias("block_digest"))


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def _resolved(parts: Column) -> Column:
    """Pieces that followed an ampersand each, with the references that they begin with resolved; what isn't one, or stands for no character, keeps its ampersand."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # folded to a constant

    def text_of(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).cast("bigint")
        known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(~ref.startswith("#"), named[ref]).when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    found = F.transform(parts, lambda x: F.struct(x.alias("piece"), F.regexp_extract(x, REFERENCE, 1).alias("ref")))
    found = F.transform(found, lambda s: F.struct(s["piece"].alias("piece"), s["ref"].alias("ref"), F.when(s["ref"] != "", text_of(s["ref"])).alias("text")))
    return F.transform(found, lambda s: F.when(s["text"].isNull(), F.concat(F.lit("&"), s["piece"])).otherwise(F.concat(s["text"], s["piece"].substr(F.char_length(s["ref"]) + 2, F.char_length(s["piece"])))))


def with_plain_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """rows with the plain text of the column html; each step is a column of its own, so that none is computed twice."""
    rows = rows.withColumn(name, _replaced(F.col(html), TEXT_RULES)).withColumn("text_parts", F.split(name, "&", -1))
    whole = F.concat(F.col("text_parts")[0], F.array_join(_resolved(F.slice("text_parts", 2, F.size("text_parts"))), ""))
    rows = rows.withColumn(name, F.when(F.size("text_parts") > 1, whole).otherwise(F.col(name))).drop("text_parts")
    return rows.withColumn(name, _replaced(F.col(name), SPACE_RULES))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response (page_id, record_id, target_uri, date, block, block_digest): warc_type, record_id, date, refers_to, target_uri,
    content_type, content_length, block_digest, source_digest (of the payload), source_block_digest, block, headers.

    A block without an empty line has no payload; one without a status or content type has empty ones. Payloads that
    aren't HTML by their content type are converted as they are. Repeated rows each give their two records, with the
    same ids; a null block counts as empty, a missing block digest is computed. Other columns are ignored; an empty
    table gives no rows.
    """
    block = F.coalesce("block", F.lit(""))
    rows = records.select("page_id", F.coalesce("record_id", F.lit("")).alias("source"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("block_digest", digest(block)).alias("source_block_digest"), block.alias("whole"))
    rows = rows.withColumn("head", F.substring_index("whole", "\r\n\r\n", 1))
    rows = rows.withColumn("payload", F.expr("substring(whole, char_length(head) + 5)"))
    rows = rows.withColumn("kind", F.regexp_extract("head", CONTENT_TYPE, 1)).withColumn("source_digest", digest(F.col("payload")))
    is_html = F.lower("kind").contains("html")
    rows = with_plain_text(rows.withColumn("html", F.when(is_html, F.col("payload"))), "html", "text").withColumn("text", F.when(is_html, F.col("text")).otherwise(F.col("payload"))).drop("html")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " "))
    links = (F.size(F.split("payload", LINK, -1)) - 1).cast("string")
    lines = F.split("head", "\r\n", -1)
    headers = F.array_join(F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != ""), lambda x: F.concat(F.lit("source-"), x, F.lit("\r\n"))), "")
    fields = [("http-status", F.regexp_extract("head", STATUS, 1)), ("source-block-digest", F.col("source_block_digest")), ("source-payload-digest", F.col("source_digest")), ("title", title), ("language", F.regexp_extract("payload", LANG, 1)), ("links", links)]
    meta = F.concat(*[field(n, v) for n, v in fields], headers)
    made = [F.struct(F.lit(t).alias("warc_type"), F.lit(c).alias("content_type"), b.alias("block")) for t, c, b in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", F.col("text")))]
    rows = rows.select("page_id", "source", "target_uri", "date", "source_digest", "source_block_digest", F.explode(F.array(*made)).alias("new"))
    rows = rows.select("page_id", F.col("new.warc_type"), urn(F.col("new.warc_type"), F.col("source"), F.col("source_digest")).alias("record_id"), "date", F.col("source").alias("refers_to"), "target_uri", F.col("new.content_type"), F.octet_length("new.block").cast("long").alias("content_length"), digest(F.col("new.block")).alias("block_digest"), "source_digest", "source_block_digest", F.col("new.block"))
    return rows.withColumn("headers", F.concat(F.lit("WARC/1.1\r\n"), *[field(n, F.col(c).cast("string")) for n, c in HEADERS], F.lit("\r\n")))


#: Header lines of a derived record, and the columns they come from; a derivative has the date of its source, so that a second run gives the same record.
HEADERS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(common.table(spark, sf_dir, "pages")))


def _quoted(text: str) -> str:
    """A DuckDB string, with its control characters written as chr()."""
    out = "'" + text.replace("'", "''") + "'"
    for c in "\r\n\t":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})"


def oracle() -> str:
    def replaced(text: str, rules: list[tuple[str, str]]) -> str:
        for pattern, new in rules:
            text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
        return text

    named = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in NAMED.items())
    ref = f"regexp_extract(x, {_quoted(REFERENCE)}, 1)"
    number = f"(CASE WHEN {ref} ~ '^#[xX].*' THEN ('0x' || substr({ref}, 3))::BIGINT ELSE substr({ref}, 2)::BIGINT END)"
    found = f"CASE WHEN {ref} = '' THEN NULL WHEN {ref}[1] <> '#' THEN t[{ref}] WHEN {number} = 0 OR {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN NULL ELSE chr({number}::INT) END"
    crlf = "chr(13) || chr(10)"
    urn_of = lambda x: f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({x}) AS h))"
    piece = f"CASE WHEN ({found}) IS NOT NULL THEN ({found}) || substr(x, length({ref}) + 2) ELSE '&' || x END"
    fields = [("http-status", f"regexp_extract(head, {_quoted(STATUS)}, 1)"), ("source-block-digest", "source_block_digest"), ("source-payload-digest", "source_digest"), ("title", f"trim(regexp_replace(regexp_extract(payload, {_quoted(TITLE)}, 1), '\\s+', ' ', 'g'))"), ("language", f"regexp_extract(payload, {_quoted(LANG)}, 1)"), ("links", f"len(regexp_extract_all(payload, {_quoted(LINK)}))")]
    meta = " || ".join(f"'{n}: ' || {v} || {crlf}" for n, v in fields)
    meta += f" || array_to_string(list_transform(list_filter(string_split(head, {crlf})[2:], lambda x: x <> ''), lambda x: 'source-' || x || {crlf}), '')"
    headers = f"'WARC/1.1' || {crlf} || " + " || ".join(f"'{n}: ' || {c} || {crlf}" for n, c in HEADERS) + f" || {crlf}"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, {urn_of("'response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|' || html")} AS source, url AS target_uri,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) AS head, html AS payload FROM p),
k AS (SELECT *, regexp_extract(head, {_quoted(CONTENT_TYPE)}, 1) AS kind, 'sha256:' || sha256(payload) AS source_digest, 'sha256:' || sha256(head || {crlf} || {crlf} || payload) AS source_block_digest FROM r),
b AS (SELECT page_id, string_split({replaced("payload", TEXT_RULES)}, '&') AS parts FROM k),
m AS (SELECT MAP {{{named}}} AS t),
u AS (SELECT page_id, parts[1] || array_to_string(list_transform(parts[2:], lambda x: {piece}), '') AS text FROM b, m),
n AS (SELECT page_id, source, target_uri, source_digest, source_block_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {meta} AS block FROM k
  UNION ALL SELECT page_id, source, target_uri, source_digest, source_block_digest, 'conversion', 'text/plain; charset=utf-8', {replaced("text", SPACE_RULES)} FROM k JOIN u USING (page_id)),
d AS (SELECT page_id, warc_type, {urn_of("warc_type || '|' || source || '|' || source_digest")} AS record_id, '{FETCHED}' AS date, source AS refers_to, target_uri, content_type, strlen(block)::BIGINT AS content_length,
  'sha256:' || sha256(block) AS block_digest, source_digest, source_block_digest, block FROM n)
SELECT *, {headers} AS headers FROM d
"""
