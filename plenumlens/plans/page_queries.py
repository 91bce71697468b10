"""Queries over ``pages``, ``conversations`` and ``orders``: content, gates, exports of statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenumlens.functions import fields
from plenumlens.functions import html as hx
from plenumlens.operators import joins, ranking, statements, summaries
from plenumlens.plans.registry import query, table
from plenumlens.session import materialize, scratch_path, spread_few_files
from plenumlens.sinks import writers
from plenumlens.sources import json_items, tables, transcripts

_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TAGS_A = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_TEXT_A = _COLLAPSE.format(
    f"regexp_replace(replace(replace(replace({_TAGS_A}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
)
_TAGS_B = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"


def _entities(text: str, pairs: list[tuple[str, str]]) -> str:
    for entity, char in pairs:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


_TEXT_B = _COLLAPSE.format(_entities(_TAGS_B, hx.ENTITIES_B))
_TAGS_C = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_TEXT_C = _COLLAPSE.format(_entities(_TAGS_C, hx.ENTITIES_C))
_STRIP = r"trim({}, E' \t\n\r\f\v')"
_VALID = (
    f"(length({_STRIP.format('html')}) >= 50 AND NOT ("
    + " OR ".join(f"contains(lower(html), '{m}')" for m in hx.ERROR_MARKERS)
    + ") AND ("
    + " OR ".join(f"contains(lower(html), '{t}')" for t in hx.HTML_TAGS)
    + f" OR length({_STRIP.format('html')}) > 200))"
)
_HAS = f"(length({_STRIP.format('html')}) >= 50 AND length({_TEXT_B}) > 20)"


def pages(spark, sf_dir):
    return spread_few_files(table(spark, sf_dir, "pages"))


@query("fn_clean_html", f"SELECT page_id, {_TEXT_A} AS text FROM pages")
def fn_clean_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hx.clean_html(F.col("html")).alias("text"))


@query("fn_html_to_text_b", f"SELECT page_id, {_TEXT_B} AS text FROM pages")
def fn_html_to_text_b(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hx.html_to_text_b(F.col("html")).alias("text"))


@query("fn_html_to_text_c", f"SELECT page_id, {_TEXT_C} AS text FROM pages")
def fn_html_to_text_c(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hx.html_to_text_c(F.col("html")).alias("text"))


@query("flt_html_valid", f"SELECT page_id, {_VALID} AS is_valid FROM pages")
def flt_html_valid(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hx.is_valid_html(F.col("html")).alias("is_valid"))


@query("flt_content", f"SELECT page_id, length({_TEXT_B}) AS content_length FROM pages WHERE {_HAS}")
def flt_content(spark, sf_dir):
    gated = statements.with_content_gates(pages(spark, sf_dir))
    return gated.where("has_content").select("page_id", F.length("text").alias("content_length"))


@query("clean_pages", f"SELECT page_id, url, {_TEXT_B} AS text, length({_TEXT_B}) AS content_length FROM pages WHERE {_HAS} AND {_VALID}")
def clean_pages(spark, sf_dir):
    return statements.clean_pages(pages(spark, sf_dir), ["page_id", "url"])


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query("agg_content_stats", f"""WITH p AS (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, {_HOST} AS speaker,
  regexp_extract(url, '^([a-z]+):', 1) AS day, page_id, {_HAS} AND {_VALID} AS ok, NOT {_HAS} AS bad FROM pages),
s AS (SELECT lang, day, speaker, count(*) AS a, count(*) FILTER (WHERE ok) AS g, count(*) FILTER (WHERE length(speaker) > 20) AS m,
  count(*) FILTER (WHERE bad) AS b, count(*) FILTER (WHERE page_id % 11 = 0) AS f, count(*) FILTER (WHERE page_id % 13 = 0) AS l
  FROM p GROUP BY ALL)
SELECT lang, sum(a)::BIGINT AS statements, sum(a)::BIGINT AS attempts, sum(g)::BIGINT AS successes, sum(a - g)::BIGINT AS skipped,
  sum(m)::BIGINT AS enrichments, count(*) FILTER (WHERE m > 0) AS speakers_identified,
  sum(b)::BIGINT AS errors, sum(f)::BIGINT AS future_skipped, sum(l)::BIGINT AS limit_skipped FROM s GROUP BY lang""")
def agg_content_stats(spark, sf_dir):
    gated = statements.with_content_gates(pages(spark, sf_dir))
    rows = gated.select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "^([a-z]+):", 1).alias("day"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("speaker"),
        "page_id", (F.col("has_content") & F.col("is_valid")).alias("ok"), (~F.col("has_content")).alias("failed"),
        (F.col("page_id") % 11 == 0).alias("future"), (F.col("page_id") % 13 == 0).alias("beyond"),
    ).withColumn("is_member", F.length("speaker") > 20)
    return summaries.content_stats(rows, ["lang"], "day", "page_id", "ok", "speaker", "is_member", "failed", "future", "beyond")


@query("agg_success_band", """WITH s AS (SELECT o_custkey, count(*) AS attempts, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes
  FROM orders GROUP BY o_custkey), p AS (SELECT *, successes * 100.0::DOUBLE / attempts AS success_percent FROM s)
SELECT *, CASE WHEN success_percent >= 70 THEN 'excellent' WHEN success_percent >= 50 THEN 'good'
  WHEN success_percent >= 30 THEN 'medium' ELSE 'weak' END AS band FROM p""")
def agg_success_band(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("o_orderstatus") == "F").alias("successes")
    )
    return summaries.with_success_band(per_customer, "attempts", "successes")


@query("fn_safe_name", """SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS stem,
left(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 50) AS member FROM pages""")
def fn_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", fields.safe_file_stem(F.col("url")).alias("stem"),
        fields.safe_member_name(F.col("url")).alias("member"),
    )


_ENDPOINTS = ["/MP", "/clubs/1", "/term", "/term10/transcripts/7", "/transcripts", "/proceedings", "/other"]


@query("fn_ttl_class", f"""WITH e AS (SELECT page_id, url || {_ENDPOINTS!r}[1 + page_id % 7] AS endpoint FROM pages)
SELECT page_id, CASE WHEN contains(endpoint, '/MP') OR contains(endpoint, '/clubs') THEN 43200
 WHEN endpoint LIKE '%/term' THEN 86400 WHEN contains(endpoint, '/transcripts/') THEN 86400
 WHEN contains(endpoint, '/transcripts') THEN 21600 WHEN contains(endpoint, '/proceedings') THEN 3600 ELSE 1800 END::BIGINT AS ttl FROM e""")
def fn_ttl_class(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in _ENDPOINTS])
    endpoint = F.concat("url", F.element_at(endings, (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", fields.ttl_seconds(endpoint).alias("ttl"))


@query("fn_media_type", """WITH m AS (SELECT CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' ELSE 'png' END AS media_type,
 strlen(html) + CASE page_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS n FROM pages)
SELECT media_type, count(*) AS files, sum(n)::BIGINT AS bytes FROM m GROUP BY media_type""")
def fn_media_type(spark, sf_dir):
    magic = F.array(F.lit(fields.PNG_MAGIC), F.lit(fields.JPEG_MAGIC), F.lit(fields.GIF_MAGIC), F.lit(b""))
    content = F.concat(F.element_at(magic, (F.col("page_id") % 4 + 1).cast("int")), F.col("html").cast("binary"))
    files = table(spark, sf_dir, "pages").select(content.alias("content"), F.octet_length(content).alias("length"))
    return tables.media_inventory(files, logo=True)


@query("fn_duration", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
CASE WHEN l_shipdate >= o_orderdate THEN date_diff('second', o_orderdate, l_shipdate) END AS duration_seconds
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def fn_duration(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        "l_orderkey", "l_linenumber",
        fields.duration_seconds(F.col("o_orderdate").cast("string"), F.col("l_shipdate").cast("string")).alias("duration_seconds"),
    )


@query("flt_error_object", """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN '{"supportID": 5}'
 WHEN 'view' THEN '{"supportID": 1, "k": 2}' ELSE props END AS payload FROM events)
SELECT event_id FROM e WHERE json_keys(payload) = ['supportID']""")
def flt_error_object(spark, sf_dir):
    payload = (
        F.when(F.col("event_type") == "error", F.lit('{"supportID": 5}'))
        .when(F.col("event_type") == "view", F.lit('{"supportID": 1, "k": 2}')).otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").where(fields.is_error_object(payload)).select("event_id")


# --- conversations: a conversation is a proceeding day, a turn a statement, a role a speaker ---


def listing(spark, sf_dir):
    """Conversations as listing rows; the system role has no name."""
    role = F.when(F.col("role") != "system", F.col("role"))
    return spread_few_files(table(spark, sf_dir, "conversations")).select(
        F.lit(10).alias("term"), F.col("conv_id").alias("proceeding_id"), F.lit("2024-01-01").alias("date"),
        F.col("turn").alias("num"), role.alias("name"), F.lit(None).cast("string").alias("function"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.lit("bench")).alias("club"),
        F.lit(None).cast("string").alias("firstName"), F.col("role").alias("lastName"),
        F.lit("2024-01-01T10:00:00").alias("startDateTime"),
        F.when(F.col("turn") > 0, F.lit("2024-01-01T10:01:30.9")).otherwise(F.lit("2024-01-01T09:00:00")).alias("endDateTime"),
        F.col("text"),
    )


def content_struct():
    """Text in a different field per role."""
    def only(role, value):
        return F.when(F.col("name").eqNullSafe(role), value)

    return F.struct(
        only("user", F.col("text")).otherwise(F.lit("")).alias("text"),
        only("assistant", F.col("text")).alias("text_content"),
        F.lit(None).cast("string").alias("plain"),
        F.when(F.col("name").isNull(), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><style>p{}</style>"))).alias("html_content"),
    )


@query("prj_processed", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Nieznany' ELSE role END AS name, '' AS function,
CASE WHEN role = 'user' THEN '' ELSE 'bench' END AS club, '' AS first_name, role AS last_name,
CASE WHEN turn > 0 THEN 90 END::BIGINT AS duration_seconds,
'/term10/proceedings/' || conv_id || '/2024-01-01/transcripts/' || turn AS api_url FROM conversations""")
def prj_processed(spark, sf_dir):
    return statements.to_processed(listing(spark, sf_dir)).select(
        F.col("proceeding_id").alias("conv_id"), F.col("num").alias("turn"), "speaker.*", "timing.duration_seconds",
        "technical.api_url",
    )


_TEXT = rf"CASE WHEN role = 'system' THEN {_COLLAPSE.format('text')} ELSE {_STRIP.format('text')} END"


@query("prj_text_coalesce", f"SELECT conv_id, turn, {_TEXT} AS text FROM conversations")
def prj_text_coalesce(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("content", content_struct())
    return rows.select(
        F.col("proceeding_id").alias("conv_id"), F.col("num").alias("turn"),
        statements.content_text(F.col("content")).alias("text"),
    )


def canonical(spark, sf_dir):
    """Conversations as canonical statements."""
    rows = listing(spark, sf_dir).withColumn("content", content_struct())
    speaker = F.struct(
        F.coalesce("name", F.lit(statements.UNKNOWN_SPEAKER)).alias("name"), F.lit(None).cast("int").alias("id"),
        (F.col("name") == "user").alias("is_mp"), F.col("club").alias("club"), F.lit("none").alias("group"),
    )
    timing = F.struct(
        F.col("startDateTime").alias("start_datetime"), F.col("endDateTime").alias("end_datetime"),
        fields.duration_seconds(F.col("startDateTime"), F.col("endDateTime")).alias("duration_seconds"),
    )
    processed = rows.select("term", "proceeding_id", "date", "num", speaker.alias("speaker"), timing.alias("timing"), "content")
    return statements.to_canonical(processed)


_CANONICAL = f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Nieznany' ELSE role END AS name,
 CASE WHEN role = 'user' THEN 'none' ELSE 'bench' END AS club, {_TEXT} AS text FROM conversations WHERE length({_TEXT}) >= 10"""


@query("prj_canonical", _CANONICAL)
def prj_canonical(spark, sf_dir):
    return canonical(spark, sf_dir).select(
        F.col("proceeding_id").alias("conv_id"), F.col("num").alias("turn"), "speaker.name", "speaker.club", "text"
    )


def written_transcripts(spark, sf_dir):
    """Conversations filed under 20 proceedings of 5 days; ``num`` orders them within a day."""
    conv = F.col("proceeding_id")
    filed = canonical(spark, sf_dir).withColumns({
        "num": conv * 1000 + F.col("num"),
        "date": F.concat(F.lit("2024-01-0"), F.floor(conv / 20) % 5 + 1),
        "proceeding_id": conv % 20,
    })
    path = scratch_path(spark, "transcripts")
    writers.write_transcripts(materialize(filed, "filed"), path)  # the writer reads it twice
    return path


def transcript_documents(spark, sf_dir):
    """The same days as one document each, under the names of transcript files."""
    conv = F.col("proceeding_id")
    filed = canonical(spark, sf_dir).withColumns({
        "num": conv * 1000 + F.col("num"),
        "date": F.concat(F.lit("2024-01-0"), F.floor(conv / 20) % 5 + 1),
        "proceeding_id": conv % 20,
    })
    path = scratch_path(spark, "transcript-documents")
    fields = ["num", "speaker", "text", "start_time", "end_time", "duration_seconds"]
    writers.write_transcript_documents(materialize(filed, "filed"), path, fields, F.lit("2024-02-01T00:00:00"))
    return path


@query("sink_transcripts", _CANONICAL)
def sink_transcripts(spark, sf_dir):
    """Written as one document per day, each read back whole by Spark's own reader."""
    schema = "metadata struct<term:int,proceeding_id:bigint,date:string>, statements array<struct<num:bigint,speaker:struct<name:string,club:string>,text:string>>"
    days = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(
        transcript_documents(spark, sf_dir))
    return days.select(F.inline("statements")).select(
        F.floor(F.col("num") / 1000).alias("conv_id"), (F.col("num") % 1000).alias("turn"), "speaker.name",
        "speaker.club", "text",
    )


@query("src_transcripts", f"""SELECT conv_id * 1000 + turn AS num, name, club, text, 10::BIGINT AS term, conv_id % 20 AS proceeding_id,
 '2024-01-0' || (conv_id // 20 % 5 + 1) AS date, 'transkrypty_2024-01-0' || (conv_id // 20 % 5 + 1) || '.json' AS file_name,
 row_number() OVER (PARTITION BY conv_id % 20, conv_id // 20 % 5 ORDER BY conv_id, turn) - 1 AS pos FROM ({_CANONICAL})""")
def src_transcripts(spark, sf_dir):
    """The documents walked by the reader of any envelope, with the keys and names that the writer gave them."""
    rows = transcripts.read_statements(spark, transcript_documents(spark, sf_dir)).where("_corrupt_record IS NULL")
    return rows.select("num", F.col("speaker").alias("name"), "club", "text", "term", "proceeding_id", "date", "file_name", "pos")


@query("src_transcripts_envelope", f"SELECT conv_id, turn AS num, name, text FROM ({_CANONICAL})")
def src_transcripts_envelope(spark, sf_dir):
    """Statements in metadata envelopes, half of them nested under ``data``."""
    statement = F.struct("num", "speaker", "text")
    metadata = F.struct("term", F.col("proceeding_id").cast("int").alias("proceeding_id"), "date")
    nested = F.col("num") % 2 == 1
    path = scratch_path(spark, "envelopes")
    canonical(spark, sf_dir).select(
        metadata.alias("metadata"),
        F.when(~nested, F.array(statement)).alias("statements"),
        F.when(nested, F.struct(F.array(statement).alias("statements"))).alias("data"),
    ).write.json(path)
    rows = transcripts.read_statements(spark, path, lines=True)
    return rows.select(
        F.col("proceeding_id").cast("bigint").alias("conv_id"), "num", F.col("speaker").alias("name"), "text"
    )


@query("src_discover", f"SELECT count(DISTINCT (conv_id % 20, conv_id // 20 % 5)) AS days FROM ({_CANONICAL})")
def src_discover(spark, sf_dir):
    """Days found among written files when the input folder itself has none."""
    path = written_transcripts(spark, sf_dir)
    found = transcripts.discover(spark, path, [path])
    return found.select(F.regexp_extract("path", "proceeding_id=[0-9]+/date=[0-9-]+", 0).alias("day")).agg(
        F.countDistinct("day").alias("days")
    )


@query("win_topn_per_group", """SELECT conv_id, turn, pos FROM (SELECT conv_id, turn,
row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) WHERE pos <= 3""")
def win_topn_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return ranking.topk_per_group(rows, ["conv_id"], [F.col("turn")], 3, ["turn"], rank="pos")


@query("ord_statements", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations")
def ord_statements(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return ranking.rank_all(rows, ["conv_id"], [F.floor(F.col("turn") / 4096)], [F.col("turn")], rank="pos")


@query("agg_sample_success", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
SELECT conv_id, rank, role AS speaker, length(trim(text, E' \\t\\n\\r\\f\\v')) > 50 AS success, length(text) AS content_length,
CASE WHEN length(trim(text, E' \\t\\n\\r\\f\\v')) > 50 THEN left(text, 100) || '...' END AS preview FROM r WHERE rank <= 3""")
def agg_sample_success(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return summaries.sample_success(rows, ["conv_id"], [F.col("turn")], ["turn"], "text", "role")


@query("join_content", """SELECT c.conv_id, c.turn, d.text FROM conversations c JOIN
(SELECT conv_id, turn, text FROM conversations WHERE length(text) > 200) d USING (conv_id, turn)""")
def join_content(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    content = turns.where(F.length("text") > 200).select("conv_id", "turn", "text")
    return joins.join_content(turns.select("conv_id", "turn"), content, ["conv_id", "turn"])


@query("join_content_dropped", "SELECT role, count(*) AS dropped FROM conversations WHERE length(text) <= 200 GROUP BY role")
def join_content_dropped(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    content = turns.where(F.length("text") > 200).select("conv_id", "turn")
    lost = joins.without_content(turns.select("conv_id", "turn", "role"), content, ["conv_id", "turn"])
    return lost.groupBy("role").agg(F.count(F.lit(1)).alias("dropped"))


def flat_statements(spark, sf_dir):
    return canonical(spark, sf_dir).select(
        "term", "proceeding_id", "date", "num", F.col("speaker.name").alias("speaker_name"),
        F.lit(None).cast("string").alias("speaker_function"), F.col("speaker.club").alias("speaker_club"),
        "start_time", "end_time", "duration_seconds", "text",
    )


_CSV = f"""SELECT '10' AS term, 'proceeding_' || conv_id AS proceeding_dir, '2024-01-01' AS date, turn::VARCHAR AS statement_num,
 name AS speaker_name, '' AS speaker_function, club AS speaker_club, '2024-01-01T10:00:00' AS start_time,
 CASE WHEN turn > 0 THEN '2024-01-01T10:01:30.9' ELSE '2024-01-01T09:00:00' END AS end_time,
 CASE WHEN turn > 0 THEN '90' ELSE '' END AS duration_seconds, 'true' AS has_full_content,
 CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS content_preview FROM ({_CANONICAL})"""


@query("sink_statements_csv", _CSV)
def sink_statements_csv(spark, sf_dir):
    folder = F.concat(F.lit("proceeding_"), F.col("proceeding_id"))
    path = scratch_path(spark, "statements-out")
    writers.write_csv(writers.statements_csv(flat_statements(spark, sf_dir), folder), path)
    return tables.read_csv(spark, path).na.fill("")


@query("src_csv", _CSV)
def src_csv(spark, sf_dir):
    """The statement export written as CSV and read back, every column as text."""
    path = scratch_path(spark, "statements-csv")
    folder = F.concat(F.lit("proceeding_"), F.col("proceeding_id"))
    writers.write_csv(writers.statements_csv(flat_statements(spark, sf_dir), folder), path)
    return tables.read_csv(spark, path).na.fill("")


@query("sink_term_json", f"""SELECT 10::BIGINT AS term, 'proceeding_' || CASE WHEN conv_id < 100 THEN lpad(conv_id::VARCHAR, 3, '0') ELSE conv_id::VARCHAR END AS directory_name,
 '2024-01-01' AS date, turn AS num, text FROM ({_CANONICAL})""")
def sink_term_json(spark, sf_dir):
    """The export as nested documents, and their innermost items read again with the levels around them."""
    path = scratch_path(spark, "term-json")
    writers.write_term_documents(materialize(canonical(spark, sf_dir), "term-rows"), path, F.lit("20240201_000000"), ["num", "text"])
    keep = ["term", "proceedings.directory_name", "proceedings.transcripts.metadata"]
    items = json_items.read_items(spark, path, ["proceedings.transcripts.statements"], keep)
    head = F.from_json("head", "term int, `proceedings.directory_name` string, `proceedings.transcripts.metadata` struct<date:string>")
    read = items.where("_corrupt_record IS NULL").select(head.alias("h"), F.from_json("item", "num bigint, text string").alias("s"))
    return read.select("h.term", F.col("h").getField("proceedings.directory_name").alias("directory_name"),
                       F.col("h").getField("proceedings.transcripts.metadata")["date"].alias("date"), "s.num", "s.text")


_LINES = f"SELECT conv_id % 20 AS proceeding_id, count(*) AS lines FROM ({_CANONICAL}) GROUP BY conv_id % 20"
_PROCEEDING = "proceeding_id=([0-9]+)"


@query("src_text", _LINES)
def src_text(spark, sf_dir):
    """Whole files of the transcript export, their records counted."""
    files = tables.read_text(spark, f"{written_transcripts(spark, sf_dir)}/*/*/*/*.json")
    lines = F.size(F.filter(F.split("value", "\n"), lambda x: x != ""))
    return files.select(F.regexp_extract("path", _PROCEEDING, 1).cast("bigint").alias("proceeding_id"), lines.alias("n")).groupBy(
        "proceeding_id").agg(F.sum("n").alias("lines"))


@query("src_binary", _LINES)
def src_binary(spark, sf_dir):
    """The same files as bytes: line ends counted, size checked against the content."""
    files = tables.read_binary(spark, f"{written_transcripts(spark, sf_dir)}/*/*/*/*.json")
    text = F.decode("content", "UTF-8")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    whole = files.where(F.octet_length("content") == F.col("length"))
    return whole.select(F.regexp_extract("path", _PROCEEDING, 1).cast("bigint").alias("proceeding_id"), ends.alias("n")).groupBy(
        "proceeding_id").agg(F.sum("n").alias("lines"))
