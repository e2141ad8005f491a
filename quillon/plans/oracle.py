"""The same semantics in ANSI SQL (with list functions), for comparison: common table expressions that queries pick from."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
RUN = r"[\p{L}\p{N}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{RUN}')"


def content(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda w: length(w) > 1)"


CORPUS = f"""
docs AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'txt' END AS ext FROM documents),
named AS (SELECT d.doc_id, d.text, d.ext, s.lang || '_' || s.source || '_module_' || d.doc_id || '.' || d.ext AS filename,
  {tokens("s.lang || '_' || s.source || '_module_' || d.doc_id")} AS fwords FROM docs d JOIN documents s USING (doc_id)),
toks AS (SELECT doc_id, unnest({content('text')}) AS term FROM named),
postings AS (SELECT doc_id, term, count(*) AS term_count FROM toks GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(term_count) AS total_words FROM postings GROUP BY doc_id),
meta AS (SELECT n.*, s.total_words FROM named n JOIN sizes s USING (doc_id)),
lines AS (SELECT doc_id, filename, unnest(CASE WHEN ext = 'pdf' THEN string_split(text, chr(10)) ELSE [text] END) AS text,
  unnest(range(1, 1 + CASE WHEN ext = 'pdf' THEN len(string_split(text, chr(10))) ELSE 1 END)) AS page_number FROM meta),
pages_ AS (SELECT doc_id, filename, page_number, lower(text) AS text FROM lines WHERE {strip('text')} <> ''),
vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def values(queries: list[tuple]) -> str:
    rows = ", ".join("({}, '{}', '{}', '{}')".format(i, raw.replace("'", "''"), page, limit) for i, raw, page, limit in queries)
    return f"q(query_id, raw, page, lim) AS (SELECT * FROM (VALUES {rows}))"


def parsed() -> str:
    """CTEs from q to qp: query_id, rest, filetype, query, quoted, words, phrase_words, phrase."""
    alone = "lower(w) IN ('pdf', '.pdf', 'docx', '.docx', 'txt', '.txt')"
    words = f"list_filter(regexp_split_to_array(s, '{SPACE}+'), lambda w: w <> '')"
    rest, kind = "", ""
    for t in ("pdf", "docx", "txt"):
        n = len(t) + 1
        cut = rstrip(f"left(s, length(s) - {n + 1})")
        rest += f" WHEN ends_with(lower(s), '.{t}\"') THEN CASE WHEN {cut} <> '' THEN {cut} || '\"' ELSE '' END WHEN ends_with(lower(s), '.{t}') THEN {rstrip(f'left(s, length(s) - {n})')}"
        kind += f" WHEN ends_with(lower(s), '.{t}\"') OR ends_with(lower(s), '.{t}') THEN '{t}'"
    whole = "length({0}) >= 2 AND starts_with({0}, '\"') AND ends_with({0}, '\"')"
    return f"""
q1 AS (SELECT *, {strip('raw')} AS s FROM q),
q2 AS (SELECT *, CASE{rest} ELSE array_to_string(list_filter({words}, lambda w: NOT {alone}), ' ') END AS rest,
  CASE{kind} ELSE ltrim(lower(list_filter({words}, lambda w: {alone})[1]), '.') END AS filetype FROM q1),
q3 AS (SELECT *, {strip('rest')} AS r FROM q2),
q4 AS (SELECT *, {whole.format('r')} AS wrapped FROM q3),
q5 AS (SELECT *, CASE WHEN wrapped THEN {strip('substring(r, 2, length(r) - 2)')} ELSE r END AS inside FROM q4),
q6 AS (SELECT *, CASE WHEN regexp_matches(inside, '(?i)\\.(pdf|docx|txt)$') THEN {rstrip("regexp_replace(inside, '(?i)[.](pdf|docx|txt)$', '')")} ELSE inside END AS bare FROM q5),
q7 AS (SELECT *, lower(CASE WHEN wrapped THEN '"' || bare || '"' ELSE bare END) AS query FROM q6),
q8 AS (SELECT *, CASE WHEN {whole.format('query')} THEN {strip('substring(query, 2, length(query) - 2)')} END AS quoted FROM q7),
qp AS (SELECT *, {tokens('query')} AS words, CASE WHEN coalesce(quoted, '') <> '' THEN {tokens('quoted')} ELSE {tokens('query')} END AS phrase_words,
  coalesce(quoted, '') <> '' AS is_quoted FROM q8),
qq AS (SELECT *, array_to_string(phrase_words, ' ') AS phrase, array_to_string(words, ' ') AS joined, len(phrase_words) >= 2 AS phrase_query,
  greatest(1, coalesce(try_cast(page AS INT), 1)) AS page_no, least(50, greatest(1, coalesce(try_cast(lim AS INT), 10))) AS limit_no FROM qp)"""


MATCH = """
qw AS (SELECT query_id, unnest(list_filter(words, lambda w: length(w) > 1)) AS word, unnest(range(len(list_filter(words, lambda w: length(w) > 1)))) AS pos FROM qq),
hit AS (SELECT query_id, pos, word, term, df, CASE WHEN term = word THEN 0 WHEN length(word) >= 3 AND starts_with(term, word) THEN 1 ELSE 2 END AS kind,
  CASE WHEN term = word THEN 1.0::DOUBLE
       WHEN length(word) >= 3 AND starts_with(term, word) THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, length(word)::DOUBLE / length(term)))
       ELSE greatest(0.2::DOUBLE, least(0.65::DOUBLE, 0.7::DOUBLE * (length(word)::DOUBLE / length(term)))) END AS weight
  FROM qw JOIN vocab ON term = word OR (length(word) >= 3 AND starts_with(term, word))
    OR (regexp_matches(word, '^[0-9]{2,}$') AND contains(term, word) AND NOT starts_with(term, word)))"""

SCORE = MATCH + """,
nd AS (SELECT query_id, count(*) AS n_docs FROM qq JOIN meta ON filetype IS NULL OR filetype = ext WHERE len(words) > 0 GROUP BY query_id),
part AS (SELECT h.*, m.doc_id, (p.term_count::DOUBLE / m.total_words) * (ln((nd.n_docs + 1)::DOUBLE / (h.df + 1)) + 1) * h.weight AS part
  FROM hit h JOIN nd USING (query_id) JOIN qq USING (query_id) JOIN postings p ON p.term = h.term JOIN meta m ON m.doc_id = p.doc_id WHERE qq.filetype IS NULL OR qq.filetype = m.ext),
cs AS (SELECT query_id, doc_id, sum(part) AS content_score, bool_or(term = word) AS exact_,
  coalesce(max(CASE WHEN term <> word AND regexp_matches(word, '^[0-9]+$') THEN weight END), 0) AS num_, coalesce(max(CASE WHEN term <> word AND NOT regexp_matches(word, '^[0-9]+$') THEN weight END), 0) AS pre_
  FROM part GROUP BY query_id, doc_id),
body AS (SELECT doc_id, """ + collapse("lower(text)") + """ AS body FROM meta),
ph AS (SELECT query_id, doc_id, ((length(body) - length(replace(body, phrase, ''))) / length(phrase))::INT AS occ FROM qq, body WHERE phrase_query AND len(words) > 0 AND contains(body, phrase)),
al AS (SELECT qq.query_id, qq.words, qq.phrase, qq.phrase_query, qq.is_quoted, qq.filetype, qq.joined, qq.page_no, qq.limit_no, m.doc_id, m.filename, m.fwords, array_to_string(m.fwords, ' ') AS fname,
  coalesce(cs.content_score, 0) AS content_score, coalesce(exact_, false) AS exact_, coalesce(num_, 0) AS num_, coalesce(pre_, 0) AS pre_, coalesce(occ, 0) AS occ
  FROM qq JOIN meta m ON len(words) > 0 AND (filetype IS NULL OR filetype = ext) LEFT JOIN cs ON cs.query_id = qq.query_id AND cs.doc_id = m.doc_id LEFT JOIN ph ON ph.query_id = qq.query_id AND ph.doc_id = m.doc_id),
fn AS (SELECT *, list_filter(words, lambda w: list_contains(fwords, w) AND (NOT regexp_matches(w, '^[0-9]+$') OR len(list_filter(words, lambda v: NOT regexp_matches(v, '^[0-9]+$'))) = 0
    OR len(list_filter(words, lambda v: NOT regexp_matches(v, '^[0-9]+$') AND list_contains(fwords, v))) > 0)) AS counted,
  len(list_filter(words, lambda w: list_contains(fwords, w)))::DOUBLE / len(words) AS cover,
  phrase <> '' AND contains(fname, phrase) AS in_name FROM al),
sc AS (SELECT *, (CASE WHEN joined = fname THEN 100 WHEN len(words) >= 2 AND contains(fname, joined) THEN 50 ELSE 0 END + 20 * len(counted))::DOUBLE AS filename_score,
  (CASE WHEN joined = fname THEN 1.0 WHEN len(words) >= 2 AND contains(fname, joined) THEN 0.95 ELSE 0.75 * cover END)::DOUBLE AS filename_relevance,
  ((CASE WHEN phrase_query AND occ > 0 THEN greatest(CASE WHEN is_quoted AND in_name THEN 30 ELSE 0 END, CASE WHEN occ <= 1 THEN 50 ELSE least(100, 50 + 50 * least(ln(occ::DOUBLE) / ln(25::DOUBLE), 1)) END)
         ELSE CASE WHEN is_quoted AND in_name THEN 30 ELSE 0 END END) + CASE WHEN phrase_query AND in_name THEN 100 ELSE 0 END)::DOUBLE AS phrase_score,
  (is_quoted AND in_name) OR (phrase_query AND (occ > 0 OR in_name)) AS phrase_match,
  (CASE WHEN exact_ THEN 1.0 WHEN pre_ > 0 THEN 0.7::DOUBLE + 0.3::DOUBLE * pre_ WHEN num_ > 0 THEN 0.3::DOUBLE + 0.4::DOUBLE * num_ ELSE 0 END)::DOUBLE AS lexical FROM fn),
kept AS (SELECT * FROM sc WHERE (phrase_match OR NOT is_quoted) AND (filename_score > 0 OR content_score <> 0 OR phrase_score > 0 OR phrase_match)),
mx AS (SELECT *, max(content_score) OVER (PARTITION BY query_id) AS max_content, bool_or(filename_score > 0) OVER (PARTITION BY query_id) AS name_hit FROM kept),
fi AS (SELECT *, CASE WHEN is_quoted AND name_hit THEN [0.8, 0.05, 0.15, 0] WHEN is_quoted THEN [0.05, 0.15, 0.8, 0] WHEN name_hit THEN [0.75, 0.15, 0.1, 0] ELSE [0.05, 0.6, 0.2, 0.15] END::DOUBLE[] AS w FROM mx),
fs AS (SELECT *, w[1] * filename_relevance + w[2] * (CASE WHEN max_content > 0 THEN content_score / max_content ELSE 0 END) + w[3] * least(phrase_score / 100, 1) + w[4] * lexical AS final_score FROM fi),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM fs WHERE final_score > 0 AND (filename_score > 0 OR content_score <> 0 OR phrase_score > 0))"""


def search(queries: list[tuple], tail: str) -> str:
    return f"WITH {values(queries)},{CORPUS},{parsed()},{SCORE} {tail}"


#: The page of each query, from ranked rows in {0}.
PAGES = """, pg AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM {0}), pt AS (SELECT *, ((total + limit_no - 1) // limit_no)::INT AS total_pages FROM pg), pp AS (SELECT *, least(page_no, total_pages) AS pno FROM pt),
pr AS (SELECT * FROM pp WHERE rank BETWEEN (pno - 1) * limit_no + 1 AND pno * limit_no)"""

#: The place of a snippet in the pages of a result row: 1 the phrase, 2 a whole word, 3 a word that starts another, 4 any occurrence.
SNIPPETS = """,
m1 AS (SELECT query_id, doc_id, word, min(pos) AS pos FROM part GROUP BY ALL),
m2 AS (SELECT query_id, doc_id, list(word ORDER BY pos) AS found FROM m1 GROUP BY ALL),
kw AS (SELECT pr.*, coalesce(found, []) AS found, CASE WHEN phrase_match THEN string_split(phrase, ' ') ELSE found END AS given FROM pr LEFT JOIN m2 USING (query_id, doc_id)),
kd AS (SELECT *, list_filter(given, lambda w, i: list_position(given, w) = i) AS ws FROM kw),
sp AS (SELECT query_id, k.doc_id, page_number, """ + collapse("g.text") + """ AS t, ws, array_to_string(ws, ' ') AS whole FROM kd k JOIN pages_ g ON g.doc_id = k.doc_id WHERE len(found) > 0),
ew AS (SELECT *, unnest(ws) AS w, unnest(range(len(ws))) AS word_at FROM sp),
c1 AS (SELECT query_id, doc_id, page_number, t, 1 AS kind, 0.0::DOUBLE AS better, 0 AS word_at, strpos(t, whole) - 1 AS pos, length(whole) AS len, whole AS mark FROM sp WHERE len(ws) >= 2 AND contains(t, whole)),
r2 AS (SELECT *, regexp_extract(' ' || t || ' ', '[^a-z0-9]' || w || '[^a-z0-9]') AS m FROM ew WHERE contains(t, w)),
c2 AS (SELECT query_id, doc_id, page_number, t, 2 AS kind, 0.0::DOUBLE AS better, word_at, strpos(' ' || t || ' ', m) - 1 AS pos, length(w) AS len, w AS mark FROM r2 WHERE m <> ''),
r3 AS (SELECT *, regexp_extract(' ' || t, '[^a-z0-9]' || w || '[a-z0-9]+') AS m FROM ew WHERE length(w) >= 3 AND contains(t, w)),
c3 AS (SELECT query_id, doc_id, page_number, t, 3 AS kind, length(w)::DOUBLE / (length(m) - 1) AS better, word_at, strpos(' ' || t, m) - 1 AS pos, length(m) - 1 AS len, w AS mark FROM r3 WHERE m <> ''),
sure AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
r4 AS (SELECT *, string_split(t, w) AS cut FROM ew WHERE contains(t, w) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM sure)),
p4 AS (SELECT *, unnest(list_transform(range(1, len(cut)), lambda i: list_sum(list_transform(cut[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(w))) AS pos FROM r4),
c4 AS (SELECT query_id, doc_id, page_number, t, 4 AS kind, (1000 * len(list_filter(ws, lambda x: contains(substring(t, greatest(0, pos - 140) + 1, pos + 140 - greatest(0, pos - 140)), x))) + length(w))::DOUBLE AS better, word_at, pos, length(w) AS len, whole AS mark FROM p4),
best AS (SELECT * FROM (SELECT * FROM sure UNION ALL SELECT * FROM c4) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY kind, better DESC, page_number, word_at, pos) = 1),
w1 AS (SELECT *, greatest(0, pos - 140) AS a, least(length(t), pos + len + 140) AS z FROM best),
w2 AS (SELECT *, trim(substring(t, a + 1, z - a), ' ') AS core FROM w1),
w3 AS (SELECT *, CASE WHEN a = 0 THEN core WHEN contains(core, ' ') THEN '... ' || substring(core, strpos(core, ' ') + 1) ELSE '... ' || core END AS lefted FROM w2),
w4 AS (SELECT *, CASE WHEN z < length(t) THEN regexp_replace(lefted, ' [^ ]*$', '') || ' ...' ELSE lefted END AS snip FROM w3),
h1 AS (SELECT *, string_split(snip, mark) AS cut FROM w4),
h2 AS (SELECT *, list_transform(range(1, len(cut)), lambda i: list_sum(list_transform(cut[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(mark)) AS b FROM h1),
h3 AS (SELECT *, list_filter(b, lambda x, i: i = 1 OR x > b[i - 1] + length(mark)) AS begins, list_filter(b, lambda x, i: i = len(b) OR b[i + 1] > x + length(mark)) AS lasts FROM h2),
sn AS (SELECT query_id, doc_id, page_number, snip, '[' || array_to_string(list_transform(begins, lambda x, i: '{"start":' || x || ',"end":' || lasts[i] + length(mark) || '}'), ',') || ']' AS highlights FROM h3),
rr AS (SELECT kd.*, CASE WHEN len(found) > 0 THEN coalesce(snip, 'No matching text found.') ELSE 'Filename matched: ' || array_to_string(list_filter(counted, lambda x, i: list_position(counted, x) = i), ', ') END AS snippet,
  CASE WHEN len(found) > 0 THEN page_number END AS at_page, coalesce(highlights, '[]') AS highlights, '/api/documents/' || url_encode(filename) AS url FROM kd LEFT JOIN sn USING (query_id, doc_id)),
ro AS (SELECT query_id, rank::INT AS rank, filename AS title, '/data/' || filename AS path, url AS document_url, url || coalesce('#page=' || at_page, '') AS page_url, snippet, at_page::INT AS page, highlights, occ::INT AS phrase_occurrences,
  round(filename_score, 4) AS filename_score, round(content_score, 4) AS content_score, exact_ AS exact_content_match, round(pre_, 4)::DOUBLE AS prefix_similarity, round(num_, 4)::DOUBLE AS numeric_similarity, round(lexical, 4) AS lexical_match_relevance,
  round(phrase_score, 4) AS phrase_score, round(final_score, 4) AS score, CASE WHEN len(counted) > 0 AND phrase_match THEN 'Filename + Phrase' WHEN phrase_match THEN 'Phrase Match' WHEN len(counted) > 0 AND len(found) > 0 THEN 'Filename + Content' WHEN len(counted) > 0 THEN 'Filename Match' ELSE 'Content Match' END AS match_type,
  filetype, 'Ranked Result' AS tag, url || coalesce('#page=' || at_page, '') AS open_url, pno::INT AS page_no, total::INT AS total, total_pages FROM rr)"""

BROWSE = """br AS (SELECT query_id, filename, filetype, page_no, limit_no, row_number() OVER (PARTITION BY query_id ORDER BY lower(filename), doc_id) AS rank FROM qq JOIN meta ON ext = filetype WHERE len(words) = 0)"""

BROWSE_ROWS = """,
bo AS (SELECT query_id, rank::INT AS rank, filename AS title, '/data/' || filename AS path, '/api/documents/' || url_encode(filename) AS document_url, '/api/documents/' || url_encode(filename) AS page_url, 'Filtered by file type: ' || upper(filetype) AS snippet, NULL::INT AS page, '[]' AS highlights, 0::INT AS phrase_occurrences,
  0.0::DOUBLE AS filename_score, 0.0::DOUBLE AS content_score, NULL::BOOLEAN AS exact_content_match, NULL::DOUBLE AS prefix_similarity, NULL::DOUBLE AS numeric_similarity, NULL::DOUBLE AS lexical_match_relevance, 0.0::DOUBLE AS phrase_score, 1.0::DOUBLE AS score, 'File Type: ' || upper(filetype) AS match_type,
  filetype, 'Filtered Result' AS tag, '/api/documents/' || url_encode(filename) AS open_url, pno::INT AS page_no, total::INT AS total, total_pages FROM pr)"""


def results(queries: list[tuple], columns: str) -> str:
    """The response rows of ranked pages."""
    return search(queries, f"{PAGES.format('res')}{SNIPPETS} SELECT {columns} FROM ro".lstrip())


def browse_results(queries: list[tuple], columns: str) -> str:
    """The response rows of browses by type."""
    return f"WITH {values(queries)},{CORPUS},{parsed()}, {BROWSE}{PAGES.format('br')}{BROWSE_ROWS} SELECT {columns} FROM bo"
