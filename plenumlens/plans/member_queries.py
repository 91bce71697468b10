"""Queries on members and verdicts.

Members are nations of regions (names collide on purpose) or customers; verdicts come
from ``documents`` joined to their ``labels``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenumlens.functions import fields, replies
from plenumlens.operators import detector, evaluation, joins, ranking, summaries
from plenumlens.operators.verdict_store import VerdictStore
from plenumlens.plans.registry import query, table
from plenumlens.plans.text_queries import RULE, RULE_SCORE, documents
from plenumlens.session import materialize, scratch_path
from plenumlens.sinks import writers
from plenumlens.sources import tables

# --- speakers ---

_SPEAKER = """CASE o_orderkey % 4 WHEN 0 THEN n_name || ' ' || r_name WHEN 1 THEN r_name || ' ' || n_name
 WHEN 2 THEN ' ' || r_name || '  ' ELSE 'Guest ' || o_custkey END"""


def members(spark, sf_dir):
    """Nations as members: first name is the nation, last name the region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("firstName"), F.col("r_name").alias("lastName"),
        F.concat(F.lit("club "), "r_regionkey").alias("club"), F.lit(None).cast("string").alias("districtName"),
        F.col("n_nationkey").alias("districtNum"), F.col("r_name").alias("profession"),
        F.lit(None).cast("string").alias("voivodeship"),
    )


@query("join_speaker", f"""WITH m AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT n_nationkey AS id, r_regionkey, unnest([n_name || ' ' || r_name, r_name || ' ' || n_name, r_name]) AS name, unnest([0, 1, 2]) AS form FROM m),
k AS (SELECT name, arg_max(id, id * 10 + form) AS id, arg_max(r_regionkey, id * 10 + form) AS rk FROM f GROUP BY name),
s AS (SELECT o_orderkey, trim({_SPEAKER}) AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)
SELECT o_orderkey, id::BIGINT AS member_id, 'club ' || rk AS club, id IS NOT NULL AS is_mp,
 CASE WHEN id IS NOT NULL THEN '' END AS voivodeship FROM s LEFT JOIN k USING (name)""")
def join_speaker(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    named = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    form = F.col("o_orderkey") % 4
    name = (
        F.when(form == 0, F.concat("n_name", F.lit(" "), "r_name")).when(form == 1, F.concat("r_name", F.lit(" "), "n_name"))
        .when(form == 2, F.concat(F.lit(" "), "r_name", F.lit("  "))).otherwise(F.concat(F.lit("Guest "), "o_custkey"))
    )
    rows = named.select("o_orderkey", name.alias("name"))
    return joins.join_speaker(rows, members(spark, sf_dir), "name", "id").select(
        "o_orderkey", F.col("mp_data.id").alias("member_id"), "mp_data.club", "is_mp", "mp_data.voivodeship"
    )


@query("fn_full_name", """SELECT n_nationkey::BIGINT AS id, n_name || ' ' || r_name AS full_name, r_name || ' ' || n_name AS reversed_name
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000 + c_custkey, c_name, ' ' || c_name FROM customer""")
def fn_full_name(spark, sf_dir):
    """Members, and customers who have only a first name with stray spaces."""
    one_name = table(spark, sf_dir, "customer").select(
        (F.lit(1000000) + F.col("c_custkey")).alias("id"), F.concat(F.lit(" "), "c_name", F.lit("\t")).alias("firstName"),
        F.lit(None).cast("string").alias("lastName"),
    )
    named = members(spark, sf_dir).select("id", "firstName", "lastName").unionByName(one_name)
    first, last = F.col("firstName"), F.col("lastName")
    return named.select(
        F.col("id").cast("bigint").alias("id"), fields.full_name(first, last).alias("full_name"),
        fields.reversed_name(first, last).alias("reversed_name"),
    )


_LAND = """WITH s AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 30 < 25 THEN n_name || ' ' || r_name ELSE 'Guest' END AS name,
  CASE WHEN conv_id % 30 < 25 THEN n_nationkey END AS id, r_regionkey FROM conversations LEFT JOIN nation ON conv_id % 30 = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT conv_id, turn, name, id::BIGINT AS member_id, id IS NOT NULL AS is_mp, 'club ' || r_regionkey AS club, trim(text, E' \t\n\r\f\v') AS text
FROM s WHERE length(text) > 200"""


@query("land_statements", _LAND)
def land_statements(spark, sf_dir):
    """The whole landing job: listing, members and content to canonical statements."""
    turns = table(spark, sf_dir, "conversations")
    known = members(spark, sf_dir)
    names = known.select("id", F.concat("firstName", F.lit(" "), "lastName").alias("_full"))
    none = F.lit(None).cast("string")
    day = [F.lit(10).alias("term"), F.col("conv_id").alias("proceeding_id"), F.lit("2024-01-01").alias("date")]
    listing = turns.join(names, F.col("conv_id") % 30 == F.col("id"), "left").select(
        *day, F.col("turn").alias("num"), F.coalesce("_full", F.lit("Guest")).alias("name"), none.alias("function"),
        F.lit("").alias("club"), none.alias("firstName"), none.alias("lastName"), none.alias("startDateTime"),
        none.alias("endDateTime"),
    )
    body = F.struct("text", none.alias("text_content"), none.alias("plain"), none.alias("html_content"))
    content = turns.where(F.length("text") > 200).select(*day, F.col("turn").alias("num"), body.alias("content"))
    return detector.land_statements(listing, known, content, "id").select(
        F.col("proceeding_id").alias("conv_id"), F.col("num").alias("turn"), "speaker.name",
        F.col("speaker.id").alias("member_id"), "speaker.is_mp", "speaker.club", "text",
    )


def customers(spark, sf_dir):
    """Customers as members: segment is the club (one has none), nation the voivodeship."""
    club = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("firstName"), club.alias("club"),
        F.col("c_nationkey").cast("string").alias("voivodeship"),
    )


_MEMBERS = """SELECT c_custkey AS id, c_name AS "firstName", CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS club,
 c_nationkey::VARCHAR AS voivodeship FROM customer"""
_PAIRS = f"""SELECT 'club' AS group_kind, club AS group_value, id, "firstName" FROM ({_MEMBERS}) WHERE club IS NOT NULL
 UNION ALL SELECT 'voivodeship', voivodeship, id, "firstName" FROM ({_MEMBERS})"""


@query("agg_members_by_group", f"""SELECT group_kind, group_value, id, "firstName",
 count(*) OVER (PARTITION BY group_kind, group_value) AS member_count FROM ({_PAIRS})""")
def agg_members_by_group(spark, sf_dir):
    return summaries.members_by_group(customers(spark, sf_dir), ["club", "voivodeship"], ["id", "firstName"])


@query("agg_group_totals", f"""SELECT group_kind, count(DISTINCT group_value) AS groups, count(*) AS members FROM ({_PAIRS}) GROUP BY group_kind""")
def agg_group_totals(spark, sf_dir):
    return summaries.group_totals(customers(spark, sf_dir), ["club", "voivodeship"])


@query("agg_club_counts", f"SELECT coalesce(club, 'Brak klubu') AS club, count(*) AS members FROM ({_MEMBERS}) GROUP BY ALL")
def agg_club_counts(spark, sf_dir):
    return summaries.club_counts(customers(spark, sf_dir), "club")


_MEMBER_CSV = f"""SELECT id::VARCHAR AS id, "firstName", '' AS "lastName", coalesce(club, '') AS club, voivodeship,
 '' AS "districtName", '' AS "districtNum", '' AS "numberOfVotes", '' AS email FROM ({_MEMBERS})"""


@query("sink_members_csv", _MEMBER_CSV)
def sink_members_csv(spark, sf_dir):
    path = scratch_path(spark, "members-csv")
    writers.write_csv(writers.members_csv(customers(spark, sf_dir)), path)
    return tables.read_csv(spark, path).na.fill("")


_MEMBER_JSON = f'SELECT id, "firstName", club, voivodeship FROM ({_MEMBERS})'


@query("sink_members_json", _MEMBER_JSON)
def sink_members_json(spark, sf_dir):
    """The member table written in envelopes and read by the member reader."""
    rows, path = customers(spark, sf_dir), scratch_path(spark, "members-envelope")
    writers.write_json(writers.in_envelope(rows, F.lit("2024-01-20"), "1", rows.columns, listed=True), path)
    back = tables.read_members(spark, path, json_lines=True)
    return back.select(F.col("id").cast("bigint").alias("id"), "firstName", "club", "voivodeship")


@query("src_members", _MEMBER_JSON)
def src_members(spark, sf_dir):
    """Member files read back from their folder: only the newest export counts, with all its parts."""
    path = scratch_path(spark, "members-json")
    rows = customers(spark, sf_dir)
    older = F.concat(F.lit("old "), "firstName").alias("firstName")
    rows.select("id", older, "club", "voivodeship").repartition(3).write.json(path)
    rows.repartition(4).write.mode("append").json(path)
    back = tables.read_members(spark, path, json_lines=True)
    return back.select(F.col("id").cast("bigint").alias("id"), "firstName", "club", "voivodeship")


@query("join_member_detail", f"""WITH d AS (SELECT c_custkey AS id, c_acctbal AS votes FROM customer WHERE c_acctbal > 0),
p AS (SELECT DISTINCT o_custkey AS id, 'photos/' || o_custkey || '.jpg' AS photo FROM orders WHERE o_orderstatus = 'F'),
v AS (SELECT DISTINCT o_custkey AS id, 'votes/' || o_custkey || '.json' AS voting_stats FROM orders WHERE o_orderstatus = 'O')
SELECT m.id, votes, photo, voting_stats, d.id IS NULL AS is_error FROM ({_MEMBERS}) m LEFT JOIN d USING (id) LEFT JOIN p USING (id) LEFT JOIN v USING (id)""")
def join_member_detail(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    details = customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("votes"))

    def paths(status, folder, extension, name):
        ids = orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id")).distinct()
        return ids.withColumn(name, F.concat(F.lit(f"{folder}/"), "id", F.lit(extension)))

    return joins.join_member_detail(
        customers(spark, sf_dir).select("id"), details, paths("F", "photos", ".jpg", "photo"),
        paths("O", "votes", ".json", "voting_stats"), "id",
    )


@query("agg_combine_stats", """SELECT o_custkey % 10 AS part, count(*) FILTER (WHERE kind = 'o') AS mps_downloaded,
 count(*) FILTER (WHERE kind = 'c') AS clubs_downloaded, count(*) FILTER (WHERE bad) AS errors FROM
 (SELECT o_custkey, 'o' AS kind, o_orderstatus = 'P' AS bad FROM orders UNION ALL SELECT c_custkey, 'c', c_acctbal < 0 FROM customer) GROUP BY ALL""")
def agg_combine_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("part")).agg(
        F.count(F.lit(1)).alias("mps_downloaded"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"))
    customer = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 10).alias("part")).agg(
        F.count(F.lit(1)).alias("clubs_downloaded"), F.count_if(F.col("c_acctbal") < 0).alias("errors"))
    return summaries.combine_stats([orders, customer], ["part"])


@query("set_distinct", "SELECT DISTINCT c_mktsegment AS club, c_nationkey::BIGINT AS voivodeship FROM customer")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("club"), F.col("c_nationkey").alias("voivodeship")
    ).dropDuplicates()


# --- verdicts: a labelled document is an evaluated fragment ---

_PROVIDERS = "['ollama', 'gemini', 'openai', 'claude']"
_EVALUATED = f"""SELECT doc_id, text, quality = 1 AS is_funny, least(n_chars, 4096) / 4096.0::DOUBLE AS confidence,
 'quality ' || quality AS reason, {_PROVIDERS}[1 + doc_id % 4] AS api_used, toxic = 1 AS cached FROM documents JOIN labels USING (doc_id)"""


def evaluated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    names = F.array(*[F.lit(p) for p in ("ollama", "gemini", "openai", "claude")])
    return docs.join(labels, "doc_id").select(
        "doc_id", "text", (F.col("quality") == 1).alias("is_funny"),
        (F.least("n_chars", F.lit(4096)) / F.lit(4096.0)).alias("confidence"),
        F.concat(F.lit("quality "), "quality").alias("reason"),
        F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("api_used"),
        (F.col("toxic") == 1).alias("cached"),
    )


@query("flt_confidence", f"SELECT doc_id, confidence FROM ({_EVALUATED}) WHERE is_funny AND confidence >= 0.6")
def flt_confidence(spark, sf_dir):
    return evaluation.confident(evaluated(spark, sf_dir)).select("doc_id", "confidence")


@query("flt_positive", f"SELECT doc_id, reason FROM ({_EVALUATED}) WHERE is_funny")
def flt_positive(spark, sf_dir):
    return evaluation.positive(evaluated(spark, sf_dir)).select("doc_id", "reason")


@query("ord_confidence", f"SELECT doc_id, confidence, row_number() OVER (ORDER BY confidence DESC, doc_id) AS rank FROM ({_EVALUATED}) WHERE is_funny")
def ord_confidence(spark, sf_dir):
    rows = evaluation.positive(evaluated(spark, sf_dir)).select("doc_id", "confidence")
    levels = [F.floor(-F.col("confidence") * 1024), -F.col("confidence"), F.floor(F.col("doc_id") / 4096)]
    return ranking.rank_all(rows, [], levels, [F.col("doc_id")])


@query("agg_eval_stats", f"""SELECT api_used, count(*) AS evaluated, count(*) FILTER (WHERE is_funny) AS positive,
 count(*) FILTER (WHERE cached) AS cached FROM ({_EVALUATED}) GROUP BY api_used""")
def agg_eval_stats(spark, sf_dir):
    return summaries.eval_stats(evaluated(spark, sf_dir))


@query("agg_analysis_stats", f"""SELECT count(*) FILTER (WHERE NOT cached) AS total_analyzed, count(*) FILTER (WHERE NOT cached AND is_funny) AS positive_found,
 count(*) FILTER (WHERE NOT cached AND is_funny) * 100.0::DOUBLE / count(*) FILTER (WHERE NOT cached) AS positive_rate,
 sum(confidence) FILTER (WHERE NOT cached) / count(*) FILTER (WHERE NOT cached) AS mean_confidence,
 count(*) FILTER (WHERE cached) AS errors FROM ({_EVALUATED})""")
def agg_analysis_stats(spark, sf_dir):
    # toxic documents stand for failed evaluations
    return summaries.analysis_stats(evaluated(spark, sf_dir).withColumnRenamed("cached", "failed"))


@query("agg_hit_rate", f"""SELECT api_used, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses,
 count(*) FILTER (WHERE cached) / count(*)::DOUBLE AS hit_rate FROM ({_EVALUATED}) GROUP BY api_used""")
def agg_hit_rate(spark, sf_dir):
    return summaries.hit_rate(evaluated(spark, sf_dir), ["api_used"])


_KEY = r"CASE WHEN length(text) >= 20 THEN sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) END"
_KNOWN = f"""SELECT content_key, arg_min(is_funny, doc_id) AS is_funny, arg_min(confidence, doc_id) AS confidence
 FROM (SELECT *, {_KEY} AS content_key FROM ({_EVALUATED})) WHERE content_key IS NOT NULL GROUP BY content_key"""


def known_verdicts(spark, sf_dir):
    """Verdict table: the first labelled document of each content."""
    keyed = evaluation.with_content_key(evaluated(spark, sf_dir)).where(F.col("content_key").isNotNull())
    columns = ["content_key", "doc_id", *evaluation.VERDICT_FIELDS]
    return ranking.first_per_key(keyed.select(*columns), ["content_key"], ["doc_id"]).drop("doc_id")


@query("join_eval_cache", f"""WITH k AS ({_KNOWN}), d AS (SELECT doc_id, {_KEY} AS content_key FROM documents)
SELECT doc_id, k.content_key IS NOT NULL AS cached, k.is_funny, k.confidence FROM d LEFT JOIN k USING (content_key)""")
def join_eval_cache(spark, sf_dir):
    """Verdicts of two earlier runs, the second also with failed ones and one known by then, looked up in their store."""
    keyed = evaluation.with_content_key(documents(spark, sf_dir)).select("doc_id", "content_key")
    found = materialize(known_verdicts(spark, sf_dir), "found-verdicts")
    store = VerdictStore(spark, scratch_path(spark, "verdict-store"), buckets=16)
    early = F.pmod(F.xxhash64("content_key"), F.lit(3)) > 0
    store.append(found.where(early))
    store.compact()
    failed = keyed.where("content_key IS NOT NULL").select("content_key", F.lit(True).alias("is_funny"), F.lit(9.0).alias("confidence"),
                                                           F.lit("no answer").alias("reason"), F.lit(evaluation.FAILED).alias("api_used"))
    store.append(found.unionByName(failed))
    return store.lookup(keyed).select("doc_id", "cached", "is_funny", "confidence")


@query("eval_batch", f"""WITH k AS ({_KNOWN}), d AS (SELECT doc_id, text, {_KEY} AS content_key FROM documents),
fresh AS (SELECT content_key, lower(arg_min(text, doc_id)) AS t FROM d WHERE content_key IS NOT NULL AND content_key NOT IN (SELECT content_key FROM k) GROUP BY content_key),
ruled AS (SELECT content_key, ({RULE_SCORE})::DOUBLE AS score FROM fresh),
v AS (SELECT content_key, is_funny, confidence, true AS cached FROM k UNION ALL
 SELECT content_key, score >= 2.0, least(score / 8.0, 1.0), false FROM ruled)
SELECT doc_id, coalesce(v.cached, false) AS cached, v.is_funny, v.confidence FROM d LEFT JOIN v USING (content_key)""")
def eval_batch(spark, sf_dir):
    """Whole run: reuse, one evaluation per distinct new text, short texts kept without verdict.

    The first provider breaks down on some texts; the second one judges those.
    """
    docs = documents(spark, sf_dir)
    verdicts = materialize(known_verdicts(spark, sf_dir), "known-verdicts")
    rule = evaluation.rule_evaluator(RULE)

    def fragile(frame):
        if (frame["text"].str.len() % 50 == 0).any():
            raise ValueError("a length it cannot take")
        return rule(frame)

    result, _ = evaluation.evaluate_fragments(docs, verdicts, [("fragile", fragile), ("rule", rule)], ["doc_id"])
    return result.select("doc_id", "cached", "is_funny", "confidence")


@query("win_provider_choice", f"""WITH c AS (SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND toxic = 0 THEN quality = 1 WHEN doc_id % 5 = 0 THEN toxic = 1 ELSE false END AS is_funny,
 CASE WHEN doc_id % 3 = 0 AND toxic = 0 THEN 0.75::DOUBLE WHEN doc_id % 5 = 0 THEN 0.25 ELSE 0 END AS confidence,
 CASE WHEN doc_id % 3 = 0 AND toxic = 0 THEN 'from gemini' WHEN doc_id % 5 = 0 THEN 'from claude' ELSE 'from gemini' END AS reason,
 CASE WHEN doc_id % 3 = 0 AND toxic = 0 THEN 'gemini' WHEN doc_id % 5 = 0 THEN 'claude' ELSE 'none' END AS api_used FROM c""")
def win_provider_choice(spark, sf_dir):
    """Two candidate answers per document; either may be missing."""
    base = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    gemini = F.when((F.col("doc_id") % 3 == 0) & (F.col("toxic") == 0), F.col("quality") == 1)
    claude = F.when(F.col("doc_id") % 5 == 0, F.col("toxic") == 1)

    def answer(verdict, confidence, provider):
        return F.struct(verdict.alias("is_funny"), F.lit(confidence).alias("confidence"), F.lit(f"from {provider}").alias("reason"), F.lit(provider).alias("api_used"))

    rows = base.select("doc_id", F.inline(F.array(answer(claude, 0.25, "claude"), answer(gemini, 0.75, "gemini"))))
    return evaluation.choose_provider(rows, ["doc_id"], "ollama")


# --- replies ---

_LABELLED = "SELECT doc_id, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query("fn_parse_text_reply", f"""SELECT doc_id, quality = 1 AS is_funny,
 CASE WHEN doc_id % 7 = 0 THEN CASE WHEN quality = 1 THEN 0.5 ELSE 0 END ELSE least((n_chars % 130) / 100.0::DOUBLE, 1.0) END::DOUBLE
 + CASE WHEN quality = 1 AND doc_id % 7 > 0 AND n_chars % 130 = 0 THEN 0.5 ELSE 0 END AS confidence,
 ['absurd', 'żart', 'ironia', 'brak'][1 + doc_id % 4] AS category,
 CASE WHEN doc_id % 5 > 0 THEN 'length: ' || n_chars WHEN quality = 1 THEN 'Model rozpoznał element ' || ['absurd', 'żart', 'ironia', 'brak'][1 + doc_id % 4]
  ELSE 'Brak wyraźnych elementów humorystycznych' END AS reason FROM ({_LABELLED})""")
def fn_parse_text_reply(spark, sf_dir):
    """Replies with a repeated verdict line, missing numbers and missing reasons."""
    words = F.array(*[F.lit(w) for w in ("Absurd!", "dobry żart", "ironiczne", "none")])
    funny = F.when(F.col("quality") == 1, F.lit("TAK")).otherwise(F.lit("nie"))
    reply = F.concat(
        F.lit("\n  Śmieszne: tak\n ŚMIESZNE: "), funny, F.lit("\nPEWNOŚĆ: "),
        F.when(F.col("doc_id") % 7 == 0, F.lit("duża")).otherwise(F.concat((F.col("n_chars") % 130).cast("string"), F.lit("%"))),
        F.lit("\nKategoria: "), F.element_at(words, (F.col("doc_id") % 4 + 1).cast("int")),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("\nPowód: length: "), "n_chars", F.lit("  "))).otherwise(F.lit("\n")),
    )
    return labelled(spark, sf_dir).select("doc_id", replies.parse_text_reply(reply).alias("p")).select("doc_id", "p.*")


@query("fn_parse_json_reply", f"""SELECT doc_id, doc_id % 6 > 0 AS ok, CASE WHEN doc_id % 6 > 0 THEN quality = 1 ELSE false END AS is_funny,
 CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN 0 ELSE n_chars / 65536.0::DOUBLE END::DOUBLE AS confidence,
 CASE WHEN doc_id % 6 > 0 THEN 'n ' || n_chars ELSE '' END AS reason FROM ({_LABELLED})""")
def fn_parse_json_reply(spark, sf_dir):
    """Replies with a preamble, quoted numbers, no number, or no JSON at all."""
    number = F.format_string("%.20f", F.col("n_chars") / F.lit(65536.0))
    stated = (
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "confidence": "'), number, F.lit('"')))
        .otherwise(F.concat(F.lit(', "confidence": '), number))
    )
    body = F.concat(
        F.lit('Sure:\n{"is_funny": '), (F.col("quality") == 1).cast("string"), stated, F.lit(', "reason": "n '), "n_chars", F.lit('"}\nDone')
    )
    reply = F.when(F.col("doc_id") % 6 == 0, F.lit("I cannot say")).otherwise(body)
    return labelled(spark, sf_dir).select("doc_id", replies.parse_json_reply(reply).alias("p")).select("doc_id", "p.*")


@query("fn_category", """SELECT doc_id, CASE WHEN contains(lower(text), 'absurd') THEN 'absurd' WHEN contains(lower(text), 'żart') OR contains(lower(text), 'zart')
 OR contains(lower(text), 'joke') THEN 'żart' WHEN contains(lower(text), 'ironi') THEN 'ironia' WHEN contains(lower(text), 'gaf') THEN 'gafa'
 WHEN contains(lower(text), 'przesad') OR contains(lower(text), 'exagger') THEN 'przesada' ELSE 'brak' END AS category FROM documents""")
def fn_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", replies.category_of(F.col("text")).alias("category"))


@query("fn_prompt", """SELECT doc_id, 'Judge: ' || text || chr(10) || CASE WHEN lang <> 'en' THEN 'Speaker: ' || source || chr(10) ELSE '' END
 || 'Club: ' || lang || chr(10) || 'End' AS prompt FROM documents""")
def fn_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("lang") != "en", F.col("source"))
    return docs.select("doc_id", replies.build_prompt(
        F.col("text"), name, F.col("lang"), template="Judge: {text}\n{context}\nEnd").alias("prompt"))


# --- selection, reports and results ---

_TOP = f"SELECT doc_id, row_number() OVER (PARTITION BY api_used ORDER BY confidence DESC, doc_id) AS rank FROM ({_EVALUATED}) WHERE confidence >= 0.2"


def selected(spark, sf_dir):
    good = evaluated(spark, sf_dir).where(F.col("confidence") >= 0.2)
    return ranking.topk_per_group(good, ["api_used"], [F.col("confidence").desc(), F.col("doc_id")], 10, ["doc_id"])


@query("join_rest", f"SELECT e.doc_id, CASE WHEN rank <= 10 THEN 0 ELSE 1 END::BIGINT AS part FROM ({_EVALUATED}) e LEFT JOIN ({_TOP}) t USING (doc_id)")
def join_rest(spark, sf_dir):
    return joins.join_rest(evaluated(spark, sf_dir), selected(spark, sf_dir), ["doc_id"]).select("doc_id", "part")


@query("set_except", f"SELECT doc_id FROM ({_EVALUATED}) EXCEPT SELECT doc_id FROM ({_TOP}) WHERE rank <= 10")
def set_except(spark, sf_dir):
    chosen = selected(spark, sf_dir).select("doc_id")
    return evaluated(spark, sf_dir).select("doc_id").join(chosen, "doc_id", "left_anti")


@query("set_union_rest", f"""SELECT e.doc_id, CASE WHEN rank <= 10 THEN rank END AS rank, CASE WHEN rank <= 10 THEN 0 ELSE 1 END::BIGINT AS part
 FROM ({_EVALUATED}) e LEFT JOIN ({_TOP}) t USING (doc_id)""")
def set_union_rest(spark, sf_dir):
    return joins.join_rest(evaluated(spark, sf_dir), selected(spark, sf_dir), ["doc_id"]).select("doc_id", "rank", "part")


@query("sink_report_txt", f"""WITH e AS ({_EVALUATED}), f AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, doc_id) AS i FROM e WHERE is_funny)
SELECT string_agg(line, chr(10) ORDER BY line_no) AS report FROM (SELECT 0::BIGINT AS line_no, 'Best fragments' || chr(10) || 'Found: ' || count(*) FILTER (WHERE is_funny) || '/' || count(*) AS line FROM e
UNION ALL SELECT i, i || '. [' || round_even(confidence * 100, 0)::INT || '%] ' || left(text, 150) || '...' || chr(10) || '   → ' || reason FROM f WHERE i <= 10)""")
def sink_report_txt(spark, sf_dir):
    """The report written as a text file and read back."""
    path = scratch_path(spark, "report")
    writers.write_report(writers.report_lines(evaluated(spark, sf_dir), [F.col("confidence").desc(), F.col("doc_id")]), path)
    return tables.read_text(spark, path).select(F.regexp_replace("value", r"\n\z", "").alias("report"))


@query("sink_results", f"""SELECT doc_id, 'run1' AS run_id, trim(replace(api_used, 'o', '_o'), '_') AS source_stem, is_funny, confidence,
 'in/' || replace(api_used, 'o', ' +o') || '.json' AS source_file, '2024-01-20' AS generated_at, row_number() OVER (PARTITION BY api_used ORDER BY doc_id) - 1 AS pos FROM ({_EVALUATED})""")
def sink_results(spark, sf_dir):
    """Results of two runs, one enveloped document per run and source; of the newer run every document is walked."""
    path = scratch_path(spark, "results")
    name = F.concat(F.lit("in/"), F.replace("api_used", F.lit("o"), F.lit(" +o")), F.lit(".json"))
    rows = materialize(evaluated(spark, sf_dir).withColumn("source_file", name), "result-rows")
    verdict = F.struct("is_funny", "confidence").alias("ai_evaluation")
    fields = [F.col("doc_id").alias("statement_id"), verdict]
    for run, some in (("run0", rows.withColumn("confidence", F.lit(-1.0))), ("run1", rows)):
        writers.write_result_documents(some, path, "source_file", fields, ["doc_id"], F.lit("2024-01-20"), "1", run)
    back = tables.read_result_documents(spark, path).where("_corrupt_record IS NULL")
    place = F.regexp_extract("path", "run_id=([^/]+)/source_stem=([^/]+)/", 1)
    stem = F.regexp_extract("path", "run_id=([^/]+)/source_stem=([^/]+)/", 2)
    return back.select(F.col("statement_id").alias("doc_id"), place.alias("run_id"), stem.alias("source_stem"),
                       "ai_evaluation.is_funny", "ai_evaluation.confidence", "source_file", "generated_at", "pos")


@query("src_latest_results", f"""SELECT statement_id, score FROM (SELECT doc_id AS statement_id, confidence AS score FROM ({_EVALUATED}))""")
def src_latest_results(spark, sf_dir):
    """Fragments of the newest of two result exports, unwrapped from their envelope."""
    path = scratch_path(spark, "result-files")
    rows = evaluated(spark, sf_dir)

    def export(score, parts, mode):
        fragment = F.struct(F.col("doc_id").alias("statement_id"), score.alias("score"))
        rows.select(F.struct(F.array(fragment).alias("fragments")).alias("data")).repartition(parts).write.mode(mode).json(path)

    export(F.lit(-1.0), 3, "errorifexists")
    export(F.col("confidence"), 4, "append")
    return tables.read_latest_results(spark, path, json_lines=True).select("statement_id", "score")


@query("src_lexicon", """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name AS keyword,
 CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size END::DOUBLE AS weight FROM part""")
def src_lexicon(spark, sf_dir):
    """Lexicon files made of part names, with broken weights and elements to skip, one file per value."""
    weight = F.when(F.col("p_size") % 3 == 0, F.lit('"heavy"')).otherwise(F.concat(F.lit('"'), "p_size", F.lit('"')))
    item = F.concat(F.lit('{"keyword": '), F.to_json(F.array("p_name")), F.lit(', "weight": '), weight, F.lit("}"))
    element = F.replace(F.replace(item, F.lit('["'), F.lit('"')), F.lit('"]'), F.lit('"'))
    files = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit('["not an object", '), element, F.lit(', {"weight": 2.0}, {"keyword": ""}]')).alias("value")
    )
    entries = tables.parse_lexicon(files, carry=["p_partkey"])
    return ranking.rank_all(
        entries.select("p_partkey", "keyword", "weight"), [],
        # the only unpartitioned level has one row per 16 million entries
        [F.floor(F.col("p_partkey") / (1 << 24)), F.floor(F.col("p_partkey") / 4096)], [F.col("p_partkey")], rank="ord"
    ).select((F.col("ord") - 1).alias("ord"), "keyword", "weight")


@query("enrich_with", "SELECT doc_id, upper(lang) AS lang_code, length(text) > 1000 AS is_long FROM documents")
def enrich_with(spark, sf_dir):
    def add_facts(df):
        return df.select("doc_id", F.upper("lang").alias("lang_code"), (F.length("text") > 1000).alias("is_long"))

    return evaluation.enrich_with(table(spark, sf_dir, "documents"), add_facts)


@query("top_fraction", """WITH c AS (SELECT quantile_disc(n_chars, 0.67) AS cut FROM documents) SELECT doc_id, n_chars FROM documents, c WHERE n_chars >= cut""")
def top_fraction(spark, sf_dir):
    return ranking.top_fraction(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 0.33)
