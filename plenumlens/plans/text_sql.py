"""SQL text shared by the text queries: normalising, segmenting and counting in DuckDB."""

from __future__ import annotations

from plenumlens.functions.keywords import SUFFIXES, plain_form

#: Lexicon of the queries over the driver's documents. Weights are sums of powers of two,
#: so that scores are exact whatever the order of addition.
QUERY_LEXICON = [
    ("the", 0.5), ("with", 1.0), ("this", 1.5), ("than", 2.0), ("under", 2.5), ("license", 3.0),
    ("and the", 1.5), ("of the", 1.0), ("für", 1.0), ("ción", 2.0),
]
LIMIT = 500


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalized(text: str = "text") -> str:
    """Cleaned and normalised text (the driver's documents hold no scripts and no references)."""
    return (
        f"lower(trim(regexp_replace(replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '&', ' i '), "
        r"'\s+', ' ', 'g')))"
    )


def marked(text: str) -> str:
    """Words between marker characters: a keyword is then found by plain search."""
    return rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_]+)', chr(2) || '\1' || chr(3), 'g')"


def _chunks(sep: str) -> str:
    return rf"(?:{sep})*(.{{1,{LIMIT}}}|.+?)(?:{sep}|$)"


def segments(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs up to ``segs(key, seg_idx, body, s, e)`` and ``norm(key, n)``."""
    comma, space = _chunks(", "), _chunks(" ")
    return rf"""
norm AS (SELECT {key}, {normalized(text)} AS n FROM {table}),
cuts AS (SELECT {key}, string_split(regexp_replace(n, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM norm),
parts0 AS (SELECT {key}, unnest(l) AS part, generate_subscripts(l, 1) AS pidx FROM cuts),
parts AS (SELECT {key}, part, pidx,
    sum(length(part) + 1) OVER (PARTITION BY {key} ORDER BY pidx) - length(part) - 1 AS p0 FROM parts0),
packed AS (SELECT {key}, pidx, p0,
    CASE WHEN length(part) <= {LIMIT} THEN [part] ELSE regexp_extract_all(part, '{comma}', 1) END AS bodies,
    CASE WHEN length(part) <= {LIMIT} THEN [part] ELSE regexp_extract_all(part, '{comma}', 0) END AS wholes
    FROM parts WHERE part <> ''),
pieces0 AS (SELECT {key}, pidx, p0, unnest(bodies) AS body, unnest(wholes) AS whole, len(bodies) AS nj,
    generate_subscripts(bodies, 1) AS j FROM packed),
pieces AS (SELECT *, p0 + coalesce(sum(length(whole)) OVER (PARTITION BY {key}, pidx ORDER BY j
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN nj = 1 THEN 0 ELSE length(regexp_extract(whole, '^(?:, )*')) END AS s0 FROM pieces0),
worded AS (SELECT {key}, pidx, j, s0,
    CASE WHEN j = nj AND length(body) > {LIMIT} THEN regexp_extract_all(body, '{space}', 1) ELSE [body] END AS bodies,
    CASE WHEN j = nj AND length(body) > {LIMIT} THEN regexp_extract_all(body, '{space}', 0) ELSE [body] END AS wholes
    FROM pieces),
chunks0 AS (SELECT {key}, pidx, j, s0, unnest(bodies) AS body, unnest(wholes) AS whole,
    generate_subscripts(bodies, 1) AS k FROM worded),
chunks AS (SELECT *, s0 + coalesce(sum(length(whole)) OVER (PARTITION BY {key}, pidx, j ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM chunks0),
segs AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY pidx, j, k) - 1)::BIGINT AS seg_idx,
    body, s::BIGINT AS s, (s + length(body))::BIGINT AS e FROM chunks)"""


def _marker_form(keyword: str) -> str:
    """A keyword as it appears between markers."""
    out, word = "", ""
    for char in keyword + "\0":
        if char.isalnum() or char == "_":
            word += char
            continue
        if word:
            out += f"\x02{word}\x03"
            word = ""
        if char != "\0":
            out += char
    return out


def strict_counts(text: str, lexicon=QUERY_LEXICON) -> str:
    """List of structs with the strict count of each keyword in already marked text."""
    items = []
    for i, (keyword, weight) in enumerate(lexicon):
        form = quoted(_marker_form(keyword.lower()))
        count = f"((length({text}) - length(replace({text}, {form}, ''))) // length({form}))::BIGINT"
        items.append(f"{{'ord': {i}, 'keyword': {quoted(keyword)}, 'weight': {weight}::DOUBLE, 'cnt': {count}}}")
    return "[" + ", ".join(items) + "]"


def lenient_counts(text: str, lexicon=QUERY_LEXICON) -> str:
    """The same with the lenient pattern, for marked mark-free text."""
    endings = "|".join(SUFFIXES)
    items = []
    for i, (keyword, weight) in enumerate(lexicon):
        form = _marker_form(plain_form(keyword))
        pattern = quoted(form[:-1] + f"(?:{endings})?\x03")
        items.append(
            f"{{'ord': {i}, 'keyword': {quoted(keyword)}, 'weight': {weight}::DOUBLE, "
            f"'cnt': len(regexp_extract_all({text}, {pattern}))::BIGINT}}"
        )
    return "[" + ", ".join(items) + "]"


def lenient_hits(key: str = "doc_id") -> str:
    """CTE ``lenient(key, seg_idx, ord, keyword, weight, cnt)`` over ``segs``."""
    inner = marked("strip_accents(lower(body))")
    return f"""
lenient0 AS (SELECT {key}, seg_idx, {inner} AS m FROM segs),
lenient1 AS (SELECT {key}, seg_idx, unnest({lenient_counts('m')}) AS h FROM lenient0),
lenient AS (SELECT {key}, seg_idx, h.ord AS ord, h.keyword AS keyword, h.weight AS weight, h.cnt AS cnt
    FROM lenient1 WHERE h.cnt > 0)"""


def keyword_places(key: str = "doc_id") -> str:
    """CTE ``places(key, keyword, place)``: keywords by best segment, then lexicon order."""
    return f"""
seg_scores AS (SELECT {key}, seg_idx, sum(cnt * weight) AS score FROM lenient GROUP BY ALL),
ranked AS (SELECT l.{key}, l.keyword, row_number() OVER (PARTITION BY l.{key}
    ORDER BY s.score DESC, l.seg_idx, l.ord) AS r FROM lenient l JOIN seg_scores s USING ({key}, seg_idx)),
places AS (SELECT {key}, keyword, row_number() OVER (PARTITION BY {key} ORDER BY min(r)) AS place
    FROM ranked GROUP BY {key}, keyword)"""


def contexts(key: str = "doc_id") -> str:
    """CTE ``cut(key, seg_idx, cs, ce, t)``: context windows of segments with a strict hit."""
    hit = f"list_sum(list_transform({strict_counts('m')}, lambda x: x.cnt)) > 0"
    return f"""
windowed AS (SELECT {key}, seg_idx, {marked('body')} AS m, min(s) OVER w AS cs, max(e) OVER w AS ce FROM segs
    WINDOW w AS (PARTITION BY {key} ORDER BY seg_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
raw AS (SELECT {key}, seg_idx, cs, ce, trim(substr(n, cs + 1, ce - cs)) AS t
    FROM windowed JOIN norm USING ({key}) WHERE {hit}),
cut AS (SELECT {key}, seg_idx, cs, ce, t FROM raw)"""


def fragments(key: str = "doc_id") -> str:
    """CTE ``frags(key, seg_idx, cs, ce, t, score, matched)`` with every CTE before it."""
    return f"""{segments(key=key)}, {lenient_hits(key)}, {keyword_places(key)}, {contexts(key)},
scored0 AS (SELECT {key}, seg_idx, cs, ce, t, unnest({strict_counts(marked('t'))}) AS h FROM cut),
scored AS (SELECT s.{key}, s.seg_idx, s.cs, s.ce, s.t, h.keyword AS keyword, h.weight AS weight, h.cnt AS cnt, p.place
    FROM scored0 s LEFT JOIN places p ON s.{key} = p.{key} AND s.h.keyword = p.keyword),
frags AS (SELECT {key}, seg_idx, cs, ce, t,
    coalesce(sum(cnt * weight) FILTER (WHERE cnt > 0 AND place IS NOT NULL), 0)::DOUBLE AS score,
    coalesce(string_agg(keyword || ':' || cnt, '|' ORDER BY place) FILTER (WHERE cnt > 0 AND place IS NOT NULL), '') AS matched
    FROM scored GROUP BY ALL)"""
