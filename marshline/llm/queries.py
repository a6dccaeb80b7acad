"""The numbered queries over whole tables, with reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marshline.llm import chat, decontaminate, langid, merkle, multiindex, packing, pii, repair, repeats, sketch, tokens, treebpe, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_ESCAPED = r"regexp_replace({}, '(\\)|([<\[])(/?s>|/?INST\]|\|startoftext\|>|\|endoftext\|>)', '\1\2\\\3', 'g')"

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
drawn AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 22) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM drawn"""


@query("op9_chat_masks", CHAT_SQL)
def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest_chats(chat.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json")))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, carry=["doc_id", "held_out"])


NEAR_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
                 ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id"""


@query("op10_similarity_sketch", NEAR_SQL)
def op10_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_sequence_packing")
def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_edit_leaks")
def op1_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


REPEATS_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM words WHERE len(ws) >= 50)),
firsts AS (SELECT w, min(doc_id) AS lo FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS places
  FROM windows JOIN firsts USING (w) WHERE doc_id > lo GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n_words, CASE WHEN places IS NULL THEN ws
         ELSE list_filter(ws, lambda w, i: NOT list_contains(places, i)) END AS left_words
  FROM words LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, n_words - len(left_words) AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept"""


@query("op6_seed_and_extend", REPEATS_SQL)
def op6_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_context_bootstrap")
def op7_context_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


VECTOR_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.95 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON c.x = vec_id
LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = vec_id"""


@query("op5_multi_index", VECTOR_SQL)
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def captures(pages: DataFrame) -> DataFrame:
    """Three captures of each page: a full response, a revisit a day later and one an hour earlier, by URLs that mean the same."""
    page, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    seconds = F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + page * 7919 % 2_000_000
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 30).cast("string"))

    def text(c):
        return F.lit(c) if isinstance(c, str) else c

    def row(n, url, at, status, headers):
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), text(v).alias("value")) for k, v in headers.items()]), lambda e: e["value"].isNotNull())
        return F.struct((page * 4 + n).alias("record_id"), url.alias("url"), F.timestamp_seconds(at).alias("time"), F.lit(status).alias("status"),
                        F.map_from_entries(pairs).alias("headers"))

    url = F.col("url")
    rows = F.array(
        row(0, url, seconds, 200, {"Content-Type": "text/html", "Content-Length": F.octet_length(html).cast("string"), "ETag": F.when(page % 7 != 0, tag),
                                   "Last-Modified": day, "Cache-Control": "max-age=60"}),
        row(1, F.concat(url, F.lit("#again")), seconds + 86400, 304, {
            "ETag": F.when(page % 5 == 0, '"other"').otherwise(F.concat(F.lit("W/"), tag)), "Content-Length": "0",
            "cache-control": F.concat(F.lit("max-age="), (page % 100).cast("string")), "Date": F.concat(F.lit("d"), page.cast("string"))}),
        row(2, F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=mail")), seconds - 3600, 304, {"last-modified": day}))
    return pages.select(F.inline(rows))


REVISIT_SQL = r"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 2000000) AS t,
         '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag, 'day ' || (page_id % 30) AS day FROM pages),
records AS (
  SELECT page_id * 4 AS record_id, url, t AS time, 200 AS status, CASE WHEN page_id % 7 <> 0 THEN tag END AS etag, day AS lm, 'max-age=60' AS cc,
         CAST(strlen(html) AS VARCHAR) AS size, NULL AS date FROM base
  UNION ALL SELECT page_id * 4 + 1, url || '#again', t + INTERVAL 1 DAY, 304, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END, NULL,
         'max-age=' || (page_id % 100), '0', 'd' || page_id FROM base
  UNION ALL SELECT page_id * 4 + 2, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail', t - INTERVAL 1 HOUR, 304, NULL, day,
         NULL, NULL, NULL FROM base),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND
               NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM bare)),
pairs AS (
  SELECT v.record_id, v.url, v.time, v.etag, v.lm, v.cc, v.date, f.record_id AS response_id, f.etag AS f_etag, f.lm AS f_lm, f.cc AS f_cc, f.size AS f_size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY f.time DESC NULLS LAST, f.record_id DESC) AS rn
  FROM canon v LEFT JOIN (SELECT * FROM canon WHERE status = 200) f ON v.c = f.c AND f.time < v.time WHERE v.status = 304),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                 WHEN etag IS NOT NULL AND f_etag IS NOT NULL
                   THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN lm IS NOT NULL AND f_lm IS NOT NULL THEN CASE WHEN lm = f_lm THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'resolved' END AS outcome
  FROM pairs WHERE rn = 1)
SELECT record_id, url, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, response_id, outcome, CASE WHEN outcome = 'resolved' THEN array_to_string(list_filter([
         'cache-control: ' || coalesce(cc, f_cc), 'content-length: ' || f_size, 'content-type: text/html', 'date: ' || date,
         'etag: ' || coalesce(etag, f_etag), 'last-modified: ' || coalesce(lm, f_lm)], lambda x: x IS NOT NULL), chr(10)) END AS headers
FROM judged"""


@query("op2_revisit_resolution", REVISIT_SQL)
def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return resolved.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).withColumn("headers", F.array_join("headers", "\n"))


#: CRC-32 of an ASCII text, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen({0})), lambda i: ascii(substr({0}, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT)"""


def _field(value: str, text: str | None = None) -> str:
    text = text or f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field("", text)]) + ")"


def _levels(name: str, base: str) -> str:
    """A tree over ``base`` (g, idx, n, d) and each node's left and right digests."""
    return f"""
{name}(g, level, idx, n, d) AS (
  SELECT g, 0, idx, n, d FROM {base}
  UNION ALL SELECT g, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 16, n),
{name}_sides AS MATERIALIZED (
  SELECT a.g, a.level, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.g, a.level, a.idx)"""


MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS d,
         CASE WHEN {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 5 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_levels("tree", "ranked")},
subroots AS MATERIALIZED (
  SELECT g AS own, d, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
{_levels("top", "subroots")},
walk(rid, g, level, idx, d, proof) AS (
  SELECT rid, g, 0, idx, coalesce(tampered, d), '' FROM ranked
  UNION ALL SELECT w.rid, w.g, w.level + 1, w.idx // 16, sha256(s.l || w.d || s.r), proof || s.l || s.r
  FROM walk w JOIN tree_sides s ON w.g = s.g AND w.level = s.level AND w.idx = s.idx),
reached AS MATERIALIZED (SELECT rid, s.idx, w.d, proof, s.d AS subroot FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM walk) w
  JOIN subroots s ON w.g = s.own WHERE k = 1),
climb(rid, level, idx, d, proof) AS (
  SELECT rid, 0, idx, d, proof FROM reached
  UNION ALL SELECT c.rid, c.level + 1, c.idx // 16, sha256(s.l || c.d || s.r), proof || s.l || s.r
  FROM climb c JOIN top_sides s ON c.level = s.level AND c.idx = s.idx)
SELECT doc_id, ranked.d AS leaf, subroot, root, sha256(c.proof) AS proof_sha256, c.d AS folded_root, c.d = root AS verified
FROM ranked JOIN reached USING (rid) JOIN (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM climb) c USING (rid),
     (SELECT d AS root FROM top WHERE n = 1) WHERE k = 1"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                      merkle.leaf_digest(*map(F.col, fields), merkle.ascii_lower(F.col("text"))))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), [*fields, "text"], tampered=tampered)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select("doc_id", *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                       merkle.hexed(merkle.proof_digest(F.col("path"))).alias("proof_sha256"), merkle.hexed(folded).alias("folded_root"),
                       (folded == F.col("root")).alias("verified"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` as damage leaves them, in one row each, with the number of copies that are left."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    return turns.select("conv_id", "turn", F.when(code == 4, "user").otherwise(shown[2]).alias("role"),
                        F.when(code == 1, "").when(code == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3]).alias("text"),
                        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def _best(fields: str) -> str:
    return f"list_min([{fields}])"


_DUE_SQL = "[3, 3, 4, 3]"  # states from 1: start, after system, after user, after assistant
_INSERTED = "list_transform([1, 2, 3, 4], lambda q: " + _best(f"{{v}}[q], {{{{'c': 3 + {{v}}[{_DUE_SQL}[q]].c, 'a': 'I' || {{v}}[{_DUE_SQL}[q]].a}}}}") + ")"
_NO = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
_EDITED = "list_transform([1, 2, 3, 4], lambda q: " + _best(f"""{{'c': 4 + v[q].c, 'a': 'D' || v[q].a}},
        CASE WHEN fault IN ('blank', 'duplicate') OR kept[q] = 0 THEN {_NO} ELSE {{'c': extra + v[kept[q]].c, 'a': 'K' || v[kept[q]].a}} END,
        CASE WHEN fault IN ('blank', 'duplicate') THEN {_NO} ELSE {{'c': 3 + extra + v[{_DUE_SQL}[q]].c, 'a': 'R' || v[{_DUE_SQL}[q]].a}} END""") + ")"

REPAIR_SQL = rf"""
WITH RECURSIVE shown AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS MATERIALIZED (SELECT *, {CRC_SQL.format("k")} % 20 AS code FROM shown),
turns AS MATERIALIZED (
  SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded JOIN (VALUES (1), (2)) copy(nr) ON nr = 1 OR code = 3 WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i,
           row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST) AS nth FROM turns),
judged AS MATERIALIZED (
  SELECT g, i, role, text, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
best(g, i, v) AS (
  SELECT g, max(i), {_INSERTED.format(v="[" + "{'c': CAST(0 AS BIGINT), 'a': ''}, " + _NO + ", " + _NO + ", {'c': CAST(0 AS BIGINT), 'a': ''}]")} FROM judged GROUP BY g
  UNION ALL SELECT g, i - 1, {_INSERTED.format(v="v")} FROM (SELECT g, i, {_INSERTED.format(v="v")} AS v FROM (SELECT g, i, {_EDITED} AS v FROM (
    SELECT g, i, v, fault, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra,
           CASE initial WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS kept
    FROM best JOIN judged USING (g, i))))),
plan AS MATERIALIZED (SELECT g, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 0),
walk(g, k, i, state, said) AS (
  SELECT g, 1, 1, 1, CAST([] AS VARCHAR[]) FROM plan
  UNION ALL SELECT g, k + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN state WHEN 'K' THEN stay ELSE due END,
         CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
                ELSE list_append(said, CASE WHEN due = 3 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, substr(p.audit, CAST(k AS BIGINT), 1) AS e, {_DUE_SQL}[state] AS due, t.role, t.text,
               CASE t.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END AS stay
        FROM walk w JOIN plan p USING (g) LEFT JOIN judged t ON w.g = t.g AND w.i = t.i WHERE k <= length(p.audit))),
counts AS (SELECT g, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY g),
spread AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM turns GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(array_to_string(coalesce(said, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM shown) LEFT JOIN counts USING (g) LEFT JOIN spread USING (g) LEFT JOIN plan USING (g)
LEFT JOIN walk w USING (g) WHERE w.g IS NULL OR w.k = length(audit) + 1"""


@query("op12_structure_repair", REPAIR_SQL)
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    left = turns.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    found = repair.digests(repair.repaired(left))
    live = F.when(F.col("live"), F.col("turn"))
    spread = (turns.groupBy("conv_id", "turn").agg((F.max("copies") > 0).alias("live")).groupBy("conv_id")
              .agg((F.max(live) - F.min(live) + 1 - F.count(live)).alias("gaps")).withColumn("g", repair.conversation_key(F.col("conv_id"))))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return spread.join(found, "g", "left").select(
        "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op11_tree_concatenation")
def op11_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = treebpe.decode_ids(treebpe.encode_texts(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
