"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    return token_counts(spark, table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan, taken

    return taken(plan(spark, table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"), with_text=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(spark, table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_quality that no estimate goes into."""
    return op6_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neardup import near_duplicates

    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id_").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id_").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import materialise

    return materialise(spark, table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(spark, table(spark, sf_dir, "documents"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that says whether op10_sharding keeps its law: all rows and bytes, shards that differ by no more than the largest document, slots without gaps."""
    from pyspark.sql import functions as F

    each = op10_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), (F.count_distinct("slot") == F.max("slot") + 1).alias("gapless"), F.min("slot").alias("first"))
    whole = each.agg(F.sum("rows").alias("documents"), F.sum("bytes").alias("bytes"), F.count("*").cast("int").alias("shards"), (F.bool_and("gapless") & (F.max("first") == 0)).alias("gapless"), (F.max("bytes") - F.min("bytes") <= F.max("largest")).alias("even"))
    return whole


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(spark, table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out_identification

    return held_out_identification(spark, table(spark, sf_dir, "documents")).drop("languages")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_topk, op2_token_counts, op3_mixing, op4_warc, op5_repeats, op6_quality, op7_near_duplicates, op8_token_shards, op9_packing, op10_sharding, op11_fill_in_middle, op12_manifest, op13_language, pipeline, quality_base, sharding_law)}
def _tree_sql(name: str, nodes: str, most: int) -> str:
    """CTEs of a hash tree over nodes(grp, idx, n, h), `most` levels: {name}0 .. the nodes of each level, {name}s0 .. what stands beside each."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(most):
        out.append(f"""{name}s{k} AS (SELECT a.grp, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM {name}{k} a LEFT JOIN {name}{k} b ON a.grp = b.grp AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx WHERE a.n > 1 GROUP BY a.grp, a.idx)""")
        out.append(f"{name}{k + 1} AS (SELECT grp, idx // 3 AS idx, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY grp, idx // 3)")
    return ",\n".join(out)


def _walk_sql(name: str, tree: str, start: str, most: int) -> str:
    """CTEs that take rows (row_id, grp, idx, node, proof) up a tree."""
    out = [f"{name}0 AS ({start})"]
    for k in range(most):
        out.append(f"{name}{k + 1} AS (SELECT w.row_id, w.grp, w.idx // 3 AS idx, CASE WHEN s.grp IS NULL THEN w.node ELSE sha256(lft || w.node || rgt) END AS node, w.proof || coalesce(lft || rgt, '') AS proof FROM {name}{k} w LEFT JOIN {tree}s{k} s ON s.grp = w.grp AND s.idx = w.idx)")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels of a source's tree and of the tree of sources that the SQL goes up.
_LEVELS, _TOPS = 10, 6
#: The lowest bit of a text's CRC-32, by the polynomial bit by bit.
_CRC_SQL = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, list_reduce(list_concat([xor(a, b) & 255], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"
MANIFEST_SQL = f"""
WITH r AS (SELECT *, row_number() OVER () AS row_id, coalesce('s' || source, 'n') AS grp, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS altered, xor({_CRC_SQL}, 4294967295) % 2 = 0 AS hit FROM documents),
o AS (SELECT row_id, doc_id, grp, leaf, CASE WHEN hit THEN altered ELSE leaf END AS now, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM r),
{_tree_sql("t", "SELECT grp, idx, n, leaf AS h FROM o", _LEVELS)},
sub AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t{_LEVELS}),
{_tree_sql("u", "SELECT 0 AS grp, idx, n, h FROM sub", _TOPS)},
{_walk_sql("w", "t", "SELECT row_id, grp, idx, now AS node, '' AS proof FROM o", _LEVELS)},
{_walk_sql("v", "u", f"SELECT row_id, 0 AS grp, sub.idx, node, proof FROM w{_LEVELS} JOIN sub USING (grp)", _TOPS)}
SELECT doc_id, leaf, sub.h AS subroot, u{_TOPS}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u{_TOPS}.h AS verified FROM o JOIN v{_TOPS} v USING (row_id) JOIN sub ON sub.grp = o.grp, u{_TOPS}"""

#: Every 400-byte string of every text by its MD5; the runs of those that start more than once. _UTF8: a character's bytes, in hexadecimal.
_UTF8 = "[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB]."
REPEATS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT uid, pos, md5(b[pos + 1:pos + 400]) AS k FROM (SELECT uid, b, unnest(range(octet_length(b) - 399)) AS pos FROM d WHERE octet_length(b) >= 400)),
s AS (SELECT uid, pos FROM h SEMI JOIN (SELECT k FROM h GROUP BY k HAVING count(*) > 1) r USING (k)),
f AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY uid ORDER BY pos) + 400 THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY pos) AS run FROM f),
r AS (SELECT uid, run, min(pos) AS a, max(pos) + 400 AS z FROM g GROUP BY uid, run),
e AS (SELECT uid, a, z, coalesce(lag(z) OVER (PARTITION BY uid ORDER BY a), 0) AS before FROM r),
k AS (SELECT uid, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS kept FROM e JOIN d USING (uid) GROUP BY uid),
x AS (SELECT doc_id, b, n_removed, n_spans, CASE WHEN last IS NULL THEN hex(b) ELSE kept || hex(b[last + 1:]) END AS rest FROM d LEFT JOIN k USING (uid))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(rest, '{_UTF8}|..'), lambda c: regexp_full_match(c, '{_UTF8}')), ''))) AS kept_text FROM x"""
#: All pairs of documents that share a shingle, and what can be reached over those that share enough.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT uid, doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s FROM w),
e AS (SELECT uid, len(s) AS n, hash(x) AS one, x FROM (SELECT uid, s, unnest(s) AS x FROM s)),
p AS (SELECT a.uid AS a, b.uid AS b FROM e a JOIN e b ON a.one = b.one AND a.x = b.x AND a.uid < b.uid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.uid, b.uid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT uid AS root, uid FROM s UNION SELECT c.root, l.b FROM c JOIN l ON l.a = c.uid),
m AS (SELECT root AS uid, min(doc_id) AS component_id FROM c JOIN s USING (uid) GROUP BY root)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN m USING (uid)"""

#: The others' results follow from hashes, tokens or estimates that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_manifest": MANIFEST_SQL,
    "op1_topk": """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS cuid, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_repeats": REPEATS_SQL,
    "quality_base": r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT uid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM (SELECT uid, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT uid, i FROM x QUALIFY count(*) OVER (PARTITION BY uid, k) > 1),
c AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY uid),
l AS (SELECT uid, count(*) - count(DISTINCT line) AS n FROM (SELECT uid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN c USING (uid) LEFT JOIN l USING (uid)""",
    "sharding_law": "SELECT count(*) AS documents, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes, 8::INT AS shards, true AS gapless, true AS even FROM documents",
    "op7_near_duplicates": NEAR_DUPLICATES_SQL,
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t)::BIGINT AS n, sha1(t) AS d FROM p),
k AS (SELECT d, n, max(page_id) AS top FROM h WHERE n >= 1000 GROUP BY d, n)
SELECT h.page_id, h.n AS payload_bytes, h.d AS payload_digest, CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS DISTINCT FROM h.page_id THEN top END AS refers_to FROM h LEFT JOIN k ON k.d = h.d AND k.n = h.n""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substring(h, 8 * k + 1, 8))::BIGINT) AS x FROM t),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
