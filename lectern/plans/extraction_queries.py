"""Registered queries of the extraction chain, from lines with positions to references and sections, each beside equivalent SQL.

The tables hold no positions, so each query lays the documents' whole texts out: sixty characters a line, ten lines a page in two columns. Where a line stands,
how high it is, and which lines become headings, entries or captions follows from its content.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.functions.fixed import NOISE_LINES, SECTION_HEADINGS
from lectern.functions.text import DOI_PATTERN
from lectern.operators import layout, reference_list, section_parser
from lectern.plans.catalogue import NEEDS, VIEWS, query
from lectern.plans.reading_queries import _KIND, _quoted, _re2
from lectern.plans.shared import saved
from lectern.sources import tables as S

#: Headings that the layout puts in, and the size of its pages.
HEADINGS = ["Approach", "overview", "Limitations:", "2. Results", "Related work and more", "References", "IV. Data"]
WIDE, HIGH = 612.0, 792.0


def _chunks(spark, sf_dir) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), ((F.length(x) - 1) / 60).cast("int")), lambda j: F.substring(x, j * 60 + 1, F.lit(60)))
    rows = S.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.flatten(F.transform(lines, cut))).alias("k", "t"))
    return rows.withColumn("v", F.length("t") + F.ascii("t") * 7 + F.col("k") * 3).withColumn("page", (F.col("k") / 10).cast("int")).withColumn("i", F.col("k") % 10)


def _laid(spark, sf_dir) -> DataFrame:
    """(doc, page, seq, x, y, width, height, text)"""
    v, k, i = F.col("v"), F.col("k"), F.col("i")
    text = (
        F.when(i == 0, F.concat(F.lit("Proceedings of tests "), F.col("page").cast("string"))).when((v % 17 == 5) & (i > 2), "References").when(v % 19 == 7, F.concat(F.lit("Figure "), v.cast("string"), F.lit(" "), "t"))
        .when(v % 23 == 4, F.get(F.array(*map(F.lit, HEADINGS)), k % len(HEADINGS))).when(v % 3 == 0, F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), "t")).otherwise(F.col("t"))
    )
    x, y = 60.0 + 250.0 * (i > 5).cast("int") + (v % 3) * 12.0, F.when(i == 0, 20.0).otherwise(90.0 + (i - 1) % 5 * 14.0 + F.when(v % 11 == 0, 60.0).otherwise(0.0))
    return _chunks(spark, sf_dir).select(
        "doc", "page", k.alias("seq"), x.alias("x"), y.alias("y"), (100.0 + v % 90).alias("width"), F.when(v % 13 == 0, 14.0).otherwise(10.0).alias("height"), text.alias("text")
    )


def _pages(lines: DataFrame) -> DataFrame:
    return lines.select("doc", "page").distinct().withColumn("width", F.lit(WIDE)).withColumn("height", F.lit(HIGH))


_TIGHT = "regexp_replace(text, '\\s+', '', 'g')"
_SCAN = "PARTITION BY doc ORDER BY page DESC, seq DESC"
VIEWS |= {
    "chunks": """
      SELECT doc, k, t, length(t) + ascii(t) * 7 + k * 3 AS v, k // 10 AS page, k % 10 AS i FROM (
        SELECT doc, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS k FROM (
          SELECT doc_id AS doc, flatten(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), lambda l: list_transform(range(0, (length(l) - 1) // 60 + 1), lambda j: substr(l, j * 60 + 1, 60)))) AS ls
          FROM documents))""",
    "laid": f"""
      SELECT doc, page, k AS seq, 60.0::DOUBLE + 250 * (i > 5)::INT + (v % 3) * 12 AS x, CASE WHEN i = 0 THEN 20.0 ELSE 90 + (i - 1) % 5 * 14 + CASE WHEN v % 11 = 0 THEN 60 ELSE 0 END END::DOUBLE AS y,
             (100 + v % 90)::DOUBLE AS width, CASE WHEN v % 13 = 0 THEN 14 ELSE 10 END::DOUBLE AS height,
             CASE WHEN i = 0 THEN 'Proceedings of tests ' || page WHEN v % 17 = 5 AND i > 2 THEN 'References' WHEN v % 19 = 7 THEN 'Figure ' || v || ' ' || t
                  WHEN v % 23 = 4 THEN {HEADINGS}[k % {len(HEADINGS)} + 1] WHEN v % 3 = 0 THEN '[' || (k + 1) || '] ' || t ELSE t END AS text
      FROM chunks""",
    "lines_": "SELECT *, height AS low, height AS high FROM laid",
}
NEEDS |= {"laid": ["chunks"], "lines_": ["chunks", "laid"]}


def _parts_sql(full: bool, source: str) -> str:
    """Views from lines to parts; ``full`` as in the operator."""
    named = "false" if full else f"(regexp_matches({_TIGHT}, '(?i)(参考文献|reference|bibliography)') AND length({_TIGHT}) < 20)"
    return f"""
    keyed AS (
      SELECT *, NOT (x > 0.2 * {WIDE} AND y > 0.2 * {HIGH} AND x + width < 0.8 * {WIDE} AND y + height < 0.8 * {HIGH}) AS outer_, max(page) OVER (PARTITION BY doc) + 1 AS total,
             [CASE WHEN regexp_matches(text, '^[A-Z]{{1,3}}$') THEN '' ELSE regexp_replace(text, '\\s+|\\d+', '', 'g') END, round_even(x, 0)::VARCHAR, round_even(y, 0)::VARCHAR, round_even(width, 0)::VARCHAR, round_even(height, 0)::VARCHAR] AS key FROM {source}),
    body AS (
      SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS nth FROM (
        SELECT *, max(page) OVER (PARTITION BY doc, key) AS hi, min(page) FILTER (WHERE page >= total - 3) OVER (PARTITION BY doc, key) AS lo3 FROM keyed)
      WHERE NOT (outer_ AND (hi > page OR (page >= total - 3 AND coalesce(lo3 < page, false)))) AND NOT regexp_matches({_TIGHT}, '(?i)^(?:Table|Fig|Figure).*\\d')),
    grown AS (
      SELECT doc, page, nth, seq, y AS ly, x + width AS r, x AS l, 0 AS col FROM body WHERE nth = 1
      UNION ALL
      SELECT doc, page, nth, seq, ly, CASE WHEN new THEN own ELSE greatest(r, own) END, CASE WHEN new THEN x ELSE least(l, x) END, col + new::INT FROM (
        SELECT b.doc, b.page, b.nth, b.seq, b.y AS ly, b.x + b.width AS own, b.x, g.r, g.l, g.col, b.y < g.ly OR b.x > g.r OR b.x + b.width < g.l AS new
        FROM grown g JOIN body b ON b.doc = g.doc AND b.page = g.page AND b.nth = g.nth + 1)),
    columned AS (SELECT b.*, g.col FROM body b JOIN grown g USING (doc, page, seq) WHERE total >= 3 AND b.page >= {0 if full else 1}),
    ended AS (
      SELECT *, coalesce(max(e) OVER (PARTITION BY doc, page), max(seq) OVER (PARTITION BY doc, page)) AS end_seq FROM (
        SELECT c.*, CASE WHEN NOT EXISTS (FROM columned o WHERE o.doc = c.doc AND o.page = c.page AND o.y >= c.y AND o.x + o.width >= c.x + c.width AND (o.x, o.y, o.width, o.height, o.text) <> (c.x, c.y, c.width, c.height, c.text)) THEN seq END AS e FROM columned c)),
    started AS (
      SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY seq DESC) AS pos FROM (SELECT *, bool_or(seq = end_seq AND regexp_matches({_TIGHT}, '(图|fig|Fig|Figure).*\\d+')) OVER (PARTITION BY doc, page) AS fig FROM ended) WHERE seq <= end_seq AND NOT fig),
    seen AS (
      SELECT *, {named} AS brk, lag(page) OVER w AS wp, lag(col) OVER w AS wc, lag(y) OVER w AS wy, lag(height) OVER w AS wh, lag(low) OVER w AS wl FROM started WINDOW w AS ({_SCAN})),
    leveled AS (SELECT *, wl - high < least(wl, high) * 0.3 AS level FROM seen),
    paged AS (
      SELECT *, min(pos) FILTER (WHERE brk) OVER p AS any_brk, min(pos) FILTER (WHERE brk AND pos >= first_level) OVER p AS late_brk FROM (
        SELECT *, min(pos) FILTER (WHERE pos > 1 AND level) OVER (PARTITION BY doc, page) AS first_level FROM leveled) WINDOW p AS (PARTITION BY doc, page)),
    sure AS (SELECT *, CASE WHEN pos = 1 AND (coalesce(level, true) OR (any_brk IS NULL) = (late_brk IS NULL)) THEN any_brk IS NOT NULL END AS known FROM paged),
    broke AS (SELECT *, CASE WHEN pos = 1 THEN coalesce(last_value(known IGNORE NULLS) OVER ({_SCAN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) END AS b FROM sure),
    turned AS (SELECT *, bool_or(b) OVER p AS broken, bool_or(pos = 1 AND NOT coalesce(level, true) AND NOT b) OVER p AS changed FROM broke WINDOW p AS (PARTITION BY doc, page)),
    stopped AS (SELECT * FROM (SELECT *, CASE WHEN changed THEN late_brk ELSE any_brk END AS stop FROM turned) WHERE stop IS NULL OR pos <= stop),
    opened AS (
      SELECT *, coalesce(pos = stop, false) AS heading,
             CASE WHEN pos = 1 THEN wp IS NULL OR broken OR changed
                  ELSE (changed AND (first_level IS NULL OR pos < first_level)) OR (NOT (changed AND (first_level IS NULL OR pos - 1 < first_level)) AND (NOT level OR (col = wc AND abs(y - wy) > 3 * wh))) END AS o FROM stopped),
    numbered AS (SELECT *, sum(CASE WHEN heading THEN 0 ELSE o::INT END) OVER ({_SCAN} ROWS UNBOUNDED PRECEDING) AS part, heading AND (pos > 1 OR (wp IS NOT NULL AND NOT broken)) AS ends FROM opened),
    parts AS (
      SELECT *, round_even(x - min(x) OVER (PARTITION BY doc, part, page, col), 1) AS rx FROM (
        SELECT *, bool_or(ends) OVER (PARTITION BY doc, part) AS listed, max(part) OVER (PARTITION BY doc) AS final FROM numbered) WHERE NOT heading AND part > 0 AND (listed OR part < final))"""


_LISTED = f""", {_parts_sql(False, "lines_")},
    scored AS (
      SELECT *, listed AND regexp_extract(trim(arg_min(text, [page, seq]) OVER (PARTITION BY doc, part)), '^\\d+') IN ('', '1') AS whole, sum((kind <> -1)::INT) OVER (PARTITION BY doc, part) AS score
      FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, trim(text) AS t, {_TIGHT} AS s FROM parts))),
    chosen AS (
      SELECT * FROM (SELECT *, min(part) FILTER (WHERE whole) OVER (PARTITION BY doc) AS until, arg_min(part, [-score, part]) OVER (PARTITION BY doc) AS best FROM scored)
      WHERE CASE WHEN until IS NOT NULL THEN listed AND part <= until ELSE part = best END)"""
_ENTRIES = """,
    placed_ AS (SELECT *, row_number() OVER w - 1 AS n_i, count(*) OVER (PARTITION BY doc) AS n, first_value(rx) OVER w AS hx, first_value(height) OVER w AS hh, first_value(kind) OVER w AS hk FROM chosen WINDOW w AS (PARTITION BY doc ORDER BY page, seq)),
    indented AS (SELECT *, coalesce(hx - arg_min(rx, n_i) FILTER (WHERE n_i > 0 AND rx <> hx AND abs(rx - hx) < 10 * hh) OVER (PARTITION BY doc), 0) AS indent, list(rx) OVER (PARTITION BY doc) AS places FROM placed_),
    begun AS (
      SELECT *, kind = hk AND (hk <= 2 OR CASE WHEN indent = 0 THEN kind <> -1 AND abs(hx - rx) < height * 0.5
                ELSE len(list_filter(places, lambda p: (rx - p) * indent > 0 AND abs(rx - p) >= abs(indent) AND abs(abs(rx - p) - abs(indent)) < 2 * height)) > 0 END) AS begins FROM indented),
    entered AS (SELECT *, sum(begins::INT) OVER w AS entry, last_value(CASE WHEN begins THEN rx END IGNORE NULLS) OVER w AS own FROM begun WINDOW w AS (PARTITION BY doc ORDER BY n_i ROWS UNBOUNDED PRECEDING)),
    cut_ AS (SELECT * FROM (SELECT *, bool_or(NOT begins AND entry > 0 AND n_i / n > 0.9 AND abs(abs(own - rx) - abs(indent)) > 5 * height) OVER (PARTITION BY doc ORDER BY n_i ROWS UNBOUNDED PRECEDING) AS stray FROM entered) WHERE NOT stray),
    named_ AS (SELECT *, CASE WHEN entry = 0 THEN n_i - max(n_i) FILTER (WHERE entry = 0) OVER (PARTITION BY doc) ELSE entry END AS nr FROM cut_),
    entries AS (
      SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY nr) AS entry, replace(regexp_replace(string_agg(text, chr(1) ORDER BY n_i), '-+\\x01', '', 'g'), chr(1), ' ') AS text, arg_min(x, n_i) AS x, arg_min(y + height, n_i) AS y FROM named_ GROUP BY doc, nr)"""


def _registered(sql: str, views: str = "lines_"):
    def put(f):
        from lectern.plans.catalogue import SQL

        query(sql, views)(f)
        SQL[f.__name__] = SQL[f.__name__].replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return put


@_registered(_LISTED + " SELECT doc, page::INT AS page, seq::INT AS seq, col::INT AS \"column\", rx AS x, kind::INT AS kind FROM chosen")
def reference_list_lines(spark, sf_dir):
    """The lines of each document's list of references, found from its end."""
    from lectern.functions.text import reference_type

    lines = _laid(spark, sf_dir)
    return reference_list.reference_lines(lines, _pages(lines)).select("doc", "page", "seq", "column", "x", reference_type(F.col("text")).alias("kind"))


@_registered(_LISTED + _ENTRIES + " SELECT doc, entry::INT AS entry, text, x, y FROM entries")
def reference_list_entries(spark, sf_dir):
    """Those lines joined to entries by indents."""
    lines = _laid(spark, sf_dir)
    return reference_list.reference_entries(reference_list.reference_lines(lines, _pages(lines))).select("doc", "entry", "text", "x", "y")


# From spans to sections


def _spans(spark, sf_dir) -> DataFrame:
    """The layout's lines as two spans each, of which the second may stand higher or lower, be lower, or leave the line."""
    lines, v = _laid(spark, sf_dir), F.length("text")
    first = lines.select("doc", "page", (F.col("seq") * 2).alias("seq"), "x", "y", "width", "height", F.substring("text", 1, 30).alias("text"))
    second = lines.filter(v > 30).select(
        "doc", "page", (F.col("seq") * 2 + 1).alias("seq"), (F.col("x") + F.col("width")).alias("x"), (F.col("y") + (v % 5 - 2) * 2.5).alias("y"), F.lit(40.0).alias("width"),
        F.when(v % 4 == 0, 6.0).otherwise(F.col("height")).alias("height"), F.expr("substring(text, 31)").alias("text"),
    )
    return first.unionByName(second)



_JOINS = "((b.y >= m.fy AND b.y < m.fy + m.fh) OR b.y = m.fy OR (b.y + b.height > m.fy AND b.y + b.height <= m.fy + m.fh))"
_KEYWORDS = ", ".join(f"'{k}'" for k in SECTION_HEADINGS)
_NOISE = " OR ".join(f"regexp_matches(t, '{_re2(('(?i)' if i else '') + p)}')" for p, i in NOISE_LINES)
_EQUATION = f"""
  (length(translate(t, '{layout.MATH}', '')) < length(t) AND length(t) < 60) OR (regexp_matches(t, '[{layout.EQUALS}]') AND regexp_matches(t, '[∑∫√∞≈≠≤≥±×÷∂∇∆ðþ]')) OR (regexp_matches(t, '[{layout.BRACKETS}]') AND length(t) < 120)
  OR (length(t) < 30 AND regexp_matches(t, '[\\x{{1D400}}-\\x{{1D7FF}}]')) OR (length(t) < 20 AND regexp_matches(t, '^[\\d\\s.,;:!?+\\-*/=><()\\[\\]{{}}|\\\\]+$'))
  OR (len(string_split_regex(t, '\\s+')) >= 3 AND 2 * len(list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) = 1)) >= len(string_split_regex(t, '\\s+')) AND length(t) < 100)
  OR (length(t) < 60 AND regexp_matches(t, '^[A-Za-z][\\p{{L}}\\p{{N}}_\\s]{{0,20}}[=≈¼]\\s*[\\p{{L}}\\p{{N}}_\\s%]'))"""
_TOPS = ", ".join(f"'{k}'" for k in layout.TOP_HEADINGS)


@_registered(f""",
    spans AS (
      SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS nth FROM (
        SELECT doc, page, seq, round_even(x, 1) AS x, round_even(y, 1) AS y, width, height, trim(text, ' ') AS text FROM (
          SELECT doc, page, seq * 2 AS seq, x, y, width, height, substr(text, 1, 30) AS text FROM laid
          UNION ALL SELECT doc, page, seq * 2 + 1, x + width, y + (length(text) % 5 - 2) * 2.5, 40.0, CASE WHEN length(text) % 4 = 0 THEN 6.0 ELSE height END, substr(text, 31) FROM laid WHERE length(text) > 30)
        WHERE trim(text, ' ') <> '')),
    folded AS (
      SELECT doc, page, nth, 0 AS line, y AS fy, height AS fh FROM spans WHERE nth = 1
      UNION ALL
      SELECT b.doc, b.page, b.nth, CASE WHEN {_JOINS} THEN m.line ELSE m.line + 1 END, CASE WHEN {_JOINS} THEN m.fy ELSE b.y END, CASE WHEN {_JOINS} THEN m.fh ELSE b.height END
      FROM folded m JOIN spans b ON b.doc = m.doc AND b.page = m.page AND b.nth = m.nth + 1),
    heights AS (
      SELECT doc, page, line, arg_min(height, [-n, k]) AS height FROM (SELECT doc, page, line, height, count(*) AS n, min(nth) AS k FROM spans JOIN folded USING (doc, page, nth) GROUP BY ALL) GROUP BY ALL),
    joined AS (
      SELECT doc, page, line AS seq, arg_min(x, nth) AS x, arg_min(y, nth) AS y, sum(width) AS width, min(s.height) AS low, max(s.height) AS high, string_agg(text, ' ' ORDER BY nth) AS text, any_value(h.height) AS height
      FROM spans s JOIN folded USING (doc, page, nth) JOIN heights h USING (doc, page, line) GROUP BY doc, page, line),
    {_parts_sql(True, "joined")},
    flat AS (
      SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, col, y, rx, seq) AS place FROM (
        SELECT doc, page, col, seq, rx, y, height, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM parts) WHERE t <> '' AND NOT ({_NOISE})),
    tallest AS (SELECT doc, arg_min(h, [-n, k]) AS body FROM (SELECT doc, round_even(height, 1) AS h, count(*) AS n, min(place) AS k FROM flat GROUP BY ALL) GROUP BY doc),
    lowered AS (SELECT *, trim(regexp_replace(lower(t), '[.:]+$', '')) AS low, ({_EQUATION}) AS eq FROM flat JOIN tallest USING (doc)),
    raw AS (
      SELECT *, length(t) BETWEEN 3 AND 150 AND NOT eq AND (
               (regexp_matches(t, '^(?:\\d+\\.\\d+\\.\\d+|\\d+\\.\\d+|\\d+|[IVXivx]+)(?:\\.|\\s|\\))\\s+[A-Z一-龥]') AND length(t) < 120)
               OR low IN ({_KEYWORDS}) OR (string_split_regex(low, '\\s+')[1] IN ({_KEYWORDS}) AND len(string_split_regex(low, '\\s+')) <= 6)
               OR len(list_filter([{_KEYWORDS}], lambda k: contains(k, ' ') AND (starts_with(low, k || ' ') OR starts_with(low, k || ':')))) > 0
               OR (height > body * 1.3 AND len(string_split_regex(t, '\\s+')) >= 3 AND length(t) BETWEEN 8 AND 100 AND NOT regexp_matches(t, '[.,;:?!]$') AND regexp_matches(t, '^\\p{{Lu}}'))) AS h0,
             low IN ('references', 'bibliography', '参考文献', 'reference list') OR regexp_matches(low, '^(?:\\d+\\.\\s+)?(?:references|bibliography)\\b') AS names FROM lowered),
    heads AS (SELECT *, h0 AND (names OR NOT coalesce(bool_or(h0 AND names) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS head FROM raw),
    sectioned AS (SELECT * FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY place) AS section FROM heads) WHERE section > 0),
    opened_ AS (
      SELECT doc, section, max(t) FILTER (WHERE head) AS heading, min(page) + 1 AS page_start, max(page) + 1 AS page_end,
             max(CASE WHEN regexp_matches(t, '^(?:\\d+|[A-Z])\\.\\d+\\.\\d+') THEN 3 WHEN regexp_matches(t, '^(?:\\d+|[A-Z])\\.\\d+') THEN 2 WHEN regexp_matches(t, '^(?:\\d+|[IVXivx]+|[A-Z])(?:\\.|\\s|\\))') THEN 1
                      WHEN height > body * 1.3 OR regexp_replace(lower(t), '\\.+$', '') IN ({_TOPS}) THEN 1 ELSE 2 END) FILTER (WHERE head) AS level
      FROM sectioned GROUP BY doc, section),
    tall_ AS (SELECT doc, section, arg_min(h, [-n, k]) AS own FROM (SELECT doc, section, round_even(height, 1) AS h, count(*) AS n, min(place) AS k FROM sectioned WHERE NOT head GROUP BY ALL) GROUP BY doc, section),
    lagged AS (
      SELECT *, lag(rx) OVER w AS px, lag(y) OVER w AS py, lag(height) OVER w AS ph, lag(t) OVER w AS pt FROM sectioned JOIN tall_ USING (doc, section) WHERE NOT head WINDOW w AS (PARTITION BY doc, section ORDER BY place)),
    split_ AS (
      SELECT *, sum(o::INT) OVER (PARTITION BY doc, section ORDER BY place) AS par FROM (
        SELECT *, coalesce(abs(y - py - ph) > own * 2.5 OR rx - px > own * 1.5, false) AS o FROM lagged WHERE pt IS NULL OR NOT eq)),
    paragraphs_ AS (
      SELECT * FROM (SELECT doc, section, par, trim(regexp_replace(string_agg(CASE WHEN NOT o AND coalesce(ends_with(pt, '-'), false) THEN chr(1) ELSE ' ' END || t, '' ORDER BY place), '-*\\x01', '', 'g')) AS p FROM split_ GROUP BY ALL) WHERE length(p) > 10),
    runs AS (SELECT *, sum(n::INT) OVER (PARTITION BY doc ORDER BY section) AS m FROM (SELECT *, coalesce(heading <> lag(heading) OVER (PARTITION BY doc ORDER BY section), true) AS n FROM opened_)),
    out_ AS (SELECT r.doc, m, arg_min(heading, r.section) AS heading, arg_min(level, r.section) AS level, arg_min(page_start, r.section) AS page_start, max(page_end) AS page_end FROM runs r GROUP BY ALL),
    texts AS (SELECT r.doc, m, count(*) AS n, string_agg(p, chr(10) ORDER BY r.section, par) AS body FROM runs r JOIN paragraphs_ q ON q.doc = r.doc AND q.section = r.section GROUP BY ALL)
    SELECT doc, m::INT AS section, heading, level::INT AS level, page_start::INT AS page_start, page_end::INT AS page_end, coalesce(n, 0)::INT AS paragraphs, coalesce(body, '') AS body FROM out_ LEFT JOIN texts USING (doc, m)""", "laid")
def paper_sections(spark, sf_dir):
    """Sections with their paragraphs, from spans: lines, columns, running heads, parts, headings, paragraphs."""
    lines = saved(layout.lines_of_spans(_spans(spark, sf_dir)), "lines")
    parts = reference_list.text_parts(lines, _pages(lines), full_text=True).filter("finished")
    return section_parser.sections(parts).select("doc", F.col("section").cast("int").alias("section"), "heading", "level", "page_start", "page_end", F.size("paragraphs").alias("paragraphs"), F.array_join("paragraphs", "\n").alias("body"))


# Reference entries to fields, and first pages


def _entries(spark, sf_dir) -> DataFrame:
    """Lines of the documents as entries, with a year and a venue behind, quoted here and there."""
    lines = S.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).filter(F.trim("line") != "")
    quoted = F.when(F.col("seq") % 7 == 3, F.concat(F.lit("A. Name. “"), "line", F.lit(",” Papers"))).otherwise(F.col("line"))
    return lines.select("doc_id", "seq", F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "), quoted, F.lit(" ("), (1980 + F.col("seq") * 7 % 60).cast("string"), F.lit("). Journal of Tests "), F.col("seq").cast("string")).alias("text"))


_NOISY = "(len(regexp_extract_all(s, '[A-Z]\\.')) + len(regexp_extract_all(s, '[,.\\-():]')) + len(regexp_extract_all(s, '\\d')))::DOUBLE / greatest(length(s), 1)"


@query(f"""
  , texts AS (
    SELECT doc_id, seq, regexp_replace(regexp_replace('[' || seq || '] ' || CASE WHEN seq % 7 = 3 THEN 'A. Name. “' || line || ',” Papers' ELSE line END || ' (' || (1980 + seq * 7 % 60) || '). Journal of Tests ' || seq, '^\\[\\d+?\\]', ''), '\\s+', ' ', 'g') AS t
    FROM lines WHERE trim(line) <> ''),
  cut_ AS (SELECT *, regexp_extract(t, '“(.+)”', 1) AS q, CASE WHEN len(string_split(t, '. ')) < 2 THEN string_split(t, '.') ELSE string_split(t, '. ') END AS parts FROM texts),
  scored AS (SELECT *, list_aggregate(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN len(regexp_extract_all(parts[i], '\\s+')) >= 3 THEN [{_NOISY.replace('(s,', '(parts[i],').replace('length(s)', 'length(parts[i])')}, i] END), 'min')[2] AS k FROM cut_),
  marked AS (SELECT *, CASE WHEN q <> '' THEN '“' || q || '”' ELSE trim(parts[k::INT]) END AS mark FROM scored),
  rest_ AS (SELECT *, trim(substr(t, 1, instr(t, mark) - 1)) AS n0, substr(t, instr(t, mark) + length(mark)) AS after, list_filter(list_transform(regexp_extract_all(t, '[^\\d]\\d{{4}}[^\\d-]'), lambda m: regexp_extract(m, '\\d+')), lambda y: y::INT <= 2025)[1] AS y FROM marked),
  named AS (SELECT *, CASE WHEN instr(after, mark) > 0 THEN substr(after, 1, instr(after, mark) - 1) ELSE after END AS a, CASE WHEN instr(n0, 'et al.') > 0 THEN substr(n0, 1, instr(n0, 'et al.') - 1) || 'et al.' ELSE n0 END AS n1 FROM rest_),
  bare AS (SELECT *, CASE WHEN y IS NULL THEN n1 ELSE trim(regexp_replace(trim(regexp_replace(trim(replace(trim(replace(trim(replace(n1, '(' || y || ')', '')), y || '.', '')), y, '')), '\\(\\s*\\)', '', 'g')), '\\s+\\.$', '')) END AS names FROM named)
  SELECT doc_id, seq::INT AS seq, coalesce(trim(CASE WHEN q <> '' THEN regexp_replace(q, ',$', '') ELSE regexp_replace(mark, '\\[[A-Z]\\]$', '') END), t) AS title, nullif(names, '') AS authors, CASE WHEN mark IS NOT NULL THEN y END AS year,
         CASE WHEN mark IS NOT NULL THEN trim(string_split_regex(regexp_extract(a, '[^.\\s].+[^.]'), '[,\\d]')[1]) END AS venue FROM bare""", "lines")
def parsed_references(spark, sf_dir):
    """Entries to title, authors, year and venue."""
    from lectern.operators.extraction import parsed

    return parsed(_entries(spark, sf_dir), this_year=F.lit(2024)).select("doc_id", "seq", "title", "authors", "year", "venue")


#: Lines of the layout of first pages that stand for authors and institutions.
PEOPLE = ["Ann Lee 1,2, Bob Roe * and Cy Poe b", "Authors: Di Fox | Jo Su 3 | IEEE", "Received 3 May", "Abstract: words", "By: Al Moe, and, 12"]
PLACES = ["a  University of Somewhere b  Institute of Other Things", "1, Some College of Arts, City", "Nothing Inc"]


def _first_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The first six lines of each document as blocks whose places follow from their lengths, some with people or institutions; and page texts that hold whole documents."""
    docs = S.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    lines = docs.select("doc", F.posexplode(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 6)).alias("seq", "t"))
    n, d, k = F.length("t"), F.col("doc"), F.col("seq")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (d % len(values)).cast("int"))
    text = F.when((k == 1) & (d % 3 > 0), of(PEOPLE)).when((k == 2) & (d % 3 > 0), of(PLACES)).when((k == 0) & (d % 4 == 1), F.concat(F.lit("Article 10.1234/ab.c "), "t")).otherwise(F.col("t"))
    size = F.when(k == 0, 18.0).otherwise(F.get(F.array(F.lit(8.0), F.lit(10.0), F.lit(18.25)), n % 3))
    y0 = 60.0 + k * 24.0 + F.when(n % 5 == 0, 9.0).otherwise(0.0)
    blocks = lines.select("doc", "seq", text.alias("text"), size.alias("size"), y0.alias("y0"), (y0 + 6.0 + n % 20).alias("y1"))
    words = F.concat(F.lit("\nAbstract\n"), "text", F.when(d % 2 == 0, "\n\n1. Introduction\nmore").otherwise(""), F.lit("\nKeywords: trees, large "), F.substring("text", 1, 9), F.lit(";\nlong words.\n\n10.55555/x."), d.cast("string"), F.lit(" ends"))
    return blocks, docs.select("doc", F.lit(800.0).alias("height"), words.alias("text"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _plain(pattern: str) -> str:
    """A pattern for an engine that escapes ASCII only."""
    return _quoted(re.sub(r"\\([^\x00-\x7f])", r"\1", pattern))


def _alt(values) -> str:
    return _plain("|".join(values))


_CLEAN = "regexp_replace(trim(n), '^(?:and|AND|&)\\s+', '')"
for _ in range(5):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_plain(X.NAME_MARKER)}', '')"


@query(f"""
  pages AS (
    SELECT doc_id AS doc, chr(10) || 'Abstract' || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '1. Introduction' || chr(10) || 'more' ELSE '' END || chr(10) || 'Keywords: trees, large ' || substr(text, 1, 9) || ';' || chr(10) || 'long words.' || chr(10) || chr(10) || '10.55555/x.' || doc_id || ' ends' AS text,
           list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:6] AS ls FROM documents),
  raw AS (SELECT doc, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS seq FROM pages),
  placed AS (SELECT *, 60.0::DOUBLE + seq * 24 + CASE WHEN length(t) % 5 = 0 THEN 9 ELSE 0 END AS y0 FROM raw),
  blocks AS (
    SELECT doc, seq, y0, y0 + 6 + length(t) % 20 AS y1, CASE WHEN seq = 0 THEN 18.0 ELSE [8.0, 10.0, 18.25][length(t) % 3 + 1] END::DOUBLE AS size,
           CASE WHEN seq = 1 AND doc % 3 > 0 THEN {_sql_list(PEOPLE)}[doc % {len(PEOPLE)} + 1] WHEN seq = 2 AND doc % 3 > 0 THEN {_sql_list(PLACES)}[doc % {len(PLACES)} + 1] WHEN seq = 0 AND doc % 4 = 1 THEN 'Article 10.1234/ab.c ' || t ELSE t END AS text FROM placed),
  worded AS (SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words, y0 / 800 AS at_ FROM blocks),
  pooled AS (SELECT *, CASE WHEN at_ BETWEEN 0.07 AND 0.35 AND words >= 4 THEN 2 WHEN at_ < 0.5 AND words >= 5 THEN 1 ELSE 0 END AS pool FROM worded),
  main AS (SELECT doc, arg_min(seq, [-size, -words, seq]) AS ms, max(size) FILTER (WHERE true) AS unused FROM (SELECT *, max(pool) OVER (PARTITION BY doc) AS best FROM pooled) WHERE pool = best AND best > 0 GROUP BY doc),
  sized AS (SELECT b.*, m.ms, p.size AS msize, b.at_ BETWEEN 0.07 AND 0.40 AND b.words >= 1 AND abs(b.size - p.size) < 0.5 AS alike FROM worded b JOIN main m USING (doc) JOIN blocks p ON p.doc = m.doc AND p.seq = m.ms),
  alone AS (SELECT * FROM (SELECT *, bool_or(seq = ms AND NOT alike) OVER (PARTITION BY doc) AS lone FROM sized WHERE alike OR seq = ms) WHERE NOT lone OR seq = ms),
  stepped AS (SELECT *, coalesce(y0 - lag(y1) OVER (PARTITION BY doc ORDER BY y0, seq) >= msize * 1.6, false)::INT AS o FROM alone),
  runs AS (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY y0, seq) AS run FROM stepped),
  own AS (SELECT * FROM (SELECT *, max(run) FILTER (WHERE seq = ms) OVER (PARTITION BY doc) AS mine FROM runs) WHERE run = mine),
  whole AS (SELECT doc, string_agg(trim(text), ' ' ORDER BY y0, seq) FILTER (WHERE trim(text) <> '') AS w, max(y1) AS bottom FROM own GROUP BY doc),
  heads AS (SELECT p.doc, coalesce(coalesce(nullif(trim(regexp_replace(w, '(?i)^\\s*(?:{_alt(X.TITLE_PREFIXES)}){_plain(X.TITLE_LINK)}\\s+', '')), ''), w), '') AS title, coalesce(bottom, 200) AS bottom FROM pages p LEFT JOIN whole USING (doc)),
  below AS (SELECT b.*, first_value(y0) OVER w AS f, max(y1) OVER (PARTITION BY doc ORDER BY y0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM blocks b JOIN heads USING (doc) WHERE y0 > bottom + 2 AND y0 < bottom + 60 AND size >= 8 WINDOW w AS (PARTITION BY doc ORDER BY y0, seq)),
  until AS (SELECT *, max((y0 - greatest(f, u) > 20 OR regexp_matches(text, '(?i)^\\s*(?:{_alt(X.AUTHOR_STOPS)})'))::INT) OVER (PARTITION BY doc ORDER BY y0, seq) AS stopped FROM below),
  line AS (SELECT doc, regexp_replace(trim(string_agg(text, ' ' ORDER BY y0, seq)), '(?i)^\\s*(?:{_alt(X.AUTHOR_LABELS)})', '') AS l FROM until WHERE stopped = 0 GROUP BY doc),
  split_ AS (SELECT doc, CASE WHEN l = '' OR regexp_replace(lower(regexp_extract(l, '^\\s*(\\S+)', 1)), ':+$', '') IN {tuple(X.NO_FIRST_WORDS)} THEN [] ELSE flatten(list_transform(string_split(l, CASE WHEN contains(l, '|') THEN '|' ELSE ',' END), lambda p: string_split_regex(trim(p), '\\s+(?:and|AND|&)\\s+'))) END AS ns FROM line),
  cleaned AS (SELECT doc, list_transform(list_filter(list_transform(ns, lambda n: trim(n)), lambda n: n <> ''), lambda n: trim(regexp_replace({_CLEAN}, '\\s{{2,}}', ' ', 'g'))) AS ns FROM split_),
  people AS (SELECT doc, list_filter(ns, lambda n: length(n) >= 2 AND NOT regexp_matches(n, '^[\\d\\s\\*\\.,]+$') AND lower(n) NOT IN {tuple(X.NO_NAMES)} AND regexp_replace(lower(regexp_extract(n, '^\\s*(\\S+)', 1)), ':+$', '') NOT IN {tuple(X.NO_FIRST_WORDS)}) AS authors FROM cleaned),
  known AS (SELECT h.*, coalesce(authors, []) AS authors FROM heads h LEFT JOIN people USING (doc)),
  low AS (SELECT b.*, greatest(bottom + 20, max(CASE WHEN len(authors) > 0 AND y0 > bottom AND size BETWEEN 9 AND 12 THEN y1 END) OVER (PARTITION BY doc)) AS lo FROM blocks b JOIN known USING (doc)),
  where_ AS (
    SELECT doc, y0, seq, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\s{{2,}}([a-z]\\s{{2,}})', chr(1) || '\\1', 'g'), '\\x01'), lambda p: trim(regexp_replace(p, '^[a-z0-9,\\*\\s]+', ''))), lambda p: length(p) > 10) AS a
    FROM low WHERE y0 > lo + 2 AND y0 < lo + 120 AND regexp_matches(text, '(?i){_alt(X.INSTITUTIONS)}')),
  places AS (SELECT doc, string_agg(array_to_string(a, ' / '), ' / ' ORDER BY y0, seq) FILTER (WHERE len(a) > 0) AS affiliations FROM where_ GROUP BY doc),
  abstracts AS (
    SELECT doc, trim(CASE WHEN regexp_matches(r, '(?i){_alt(X.ABSTRACT_ENDS)}') THEN string_split_regex(r, '(?i){_alt(X.ABSTRACT_ENDS)}')[1] ELSE substr(r, 1, 5000) END, ' ' || chr(10) || chr(9) || chr(13)) AS a, text
    FROM (SELECT doc, text, string_split_regex(text, '(?i){_plain(X.ABSTRACT_LABEL)}')[-1] AS r FROM pages)),
  tidy AS (SELECT doc, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\\n[A-Z][a-z]+(?:\\s+[a-z]+){{0,3}}\\s*\\n([a-z])', chr(10) || '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n([^\\n])', ' \\1', 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS abstract,
                  trim(regexp_extract(text, '(?is){_plain(X.KEYWORD_LIST)}', 1), ' ' || chr(10)) AS kw FROM abstracts),
  terms AS (SELECT doc, abstract, text, list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(kw, chr(10)), lambda x: regexp_replace(trim(x), '[;,]+$', '')), lambda x: length(x) >= 3), lambda x: string_split_regex(x, '[;,]'))), lambda t: regexp_replace(trim(t), '\\.+$', '')), lambda t: length(t) > 1) AS terms FROM tidy)
  SELECT k.doc, title, array_to_string(authors, ' / ') AS authors, coalesce(affiliations, '') AS affiliations, abstract, array_to_string(terms, ' / ') AS keywords,
         regexp_replace(nullif(regexp_extract(text, '{_plain(DOI_PATTERN)}'), ''), '\\.+$', '') AS doi FROM known k LEFT JOIN places USING (doc) JOIN terms USING (doc)""".replace("\n  pages AS", "\n WITH pages AS", 1))
def first_page_metadata(spark, sf_dir):
    """Title, authors, affiliations, abstract, keywords and DOI from first pages."""
    from lectern.operators.front_matter import front_matter

    joined = lambda c: F.array_join(c, " / ").alias(c)
    return front_matter(*_first_pages(spark, sf_dir)).select("doc", "title", joined("authors"), joined("affiliations"), "abstract", joined("keywords"), "doi")
