"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.secrets import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.mixing import mixed

    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.warc import archive_pages

    records = archive_pages(read_table(spark, sf_dir, "pages"))
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.sharding import sharded

    return sharded(read_table(spark, sf_dir, "documents"), shards=40)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.near_dedup import Rule, near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), Rule(words=3, percent=85))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.decontaminate import contaminated

    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.chat import as_events, fold_events, read_back, render

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return read_back(render(fold_events(as_events(rows.withColumnRenamed("turn", "seq")))))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framesift.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framesift.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framesift.llm.token_alignment import token_alignment

    return token_alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.line_dedup import deduplicated_lines

    found = deduplicated_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.llm.structure_repair import damage, repair, with_lost

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, _ = repair(damage(rows))
    return with_lost(report, rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_seekable_warc": op3_seekable_warc,
    "op4_feistel_sharding": op4_feistel_sharding,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_chat_format": op7_chat_format,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_structure_repair": op13_structure_repair,
    "pipeline": pipeline,
}

#: Letters of the assign pattern in either case, spelled out: other engines fold more letters than these.
EITHER_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k(kind, rank, base, least, pattern) AS (VALUES
  ('assign', 1, true, 6, '{EITHER_CASE}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 2, true, 20, 'AKIA[A-Z0-9]+'),
  ('hex', 3, true, 24, '[0-9a-f]{{24,}}'),
  ('web_token', 4, false, 1, 'eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}'),
  ('mixed', 5, false, 32, '[A-Za-z0-9+/_-]{{32,}}')),
m AS (
  SELECT *, regexp_extract_all(t, pattern) AS hits, CASE kind WHEN 'assign' THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern) END AS found, string_split_regex(t, pattern) AS gaps FROM d, k
),
p AS (
  SELECT doc_id, source, kind, rank, base, least, found[i] AS value, length(hits[i]) AS n,
    list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM m, unnest(range(1, len(hits) + 1)) u(i)
),
s AS (SELECT * FROM p WHERE length(value) >= least AND (kind <> 'mixed' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
o AS (SELECT value, count(DISTINCT source) < 3 AND count(DISTINCT doc_id) < 50 AS live FROM s GROUP BY value),
j AS (SELECT *, kind || ':' || start || ':' || (start + n) AS span FROM s JOIN o USING (value)),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY start, rank) FILTER (base OR live) AS spans,
    count(*) FILTER (base AND live) AS n_live, count(*) FILTER (base AND NOT live) AS n_copied, count(*) FILTER (NOT base AND live) AS n_added
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN a USING (doc_id)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS revisit FROM f)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP6_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM t),
b AS (SELECT DISTINCT least(len(words), 5) AS width FROM w WHERE kind = 1 AND len(words) > 0),
s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(words), width - 1) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) AS shingle
  FROM w JOIN b ON kind = 0 OR width = least(len(words), 5)
),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.shingle = i.shingle JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n_item HAVING count(*) * 100 >= n_item * 80
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g') AS body FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(body) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""

#: A walk over the turns keeps the best edits that lead to each state, by cost, then audit, with the conversation that they make.
_STEP = "CASE WHEN c{s}.cost < 1000000 THEN {{'cost': c{s}.cost + {cost}, 'audit': c{s}.audit || '{edit}', 'said': {said}}} ELSE c{s} END"
_NONE = "{'cost': 1000000, 'audit': '', 'said': []::VARCHAR[]}"


def _step(s: int, cost: str, edit: str, said: str) -> str:
    return _STEP.format(s=s, cost=cost, edit=edit, said=said)


def _turn_sql(to: int) -> str:
    """The ways to a state with a turn."""
    name, letter = {1: ("", "s"), 2: ("user", "u"), 3: ("assistant", "a")}.get(to, ("", ""))
    ways = [f"CASE WHEN true THEN {_step(to, '3', 'D', f'c{to}.said')} END"]
    for s in {1: (0,), 2: (0, 1, 3), 3: (2,)}.get(to, ()):
        ways.append(f"CASE WHEN fault < 2 AND left(role, 1) = '{letter}' THEN {_step(s, 'fault', 'K', f'list_append(c{s}.said, role || chr(58) || text)')} END")
        if name:
            ways.append(f"CASE WHEN fault < 2 THEN {_step(s, '2 + fault', 'R', f'list_append(c{s}.said, {chr(39)}{name}:{chr(39)} || text)')} END")
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _inserts_sql(to: int) -> str:
    """The ways to a state by a turn inserted last, or none."""
    name = {2: "user", 3: "assistant"}.get(to)
    ways = [f"c{to}"] + [_step(s, "2", "I", f"list_append(c{s}.said, '{name}:')") for s in {2: (0, 1, 3), 3: (2,)}.get(to, ())]
    return f"list_min([{', '.join(ways)}])"


OP13_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs
),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
h AS (
  SELECT o.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS hit FROM o, bits
),
d AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(CASE hit WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) u(copy)
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS time,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS seam FROM n
),
t AS (SELECT *, CASE WHEN last = '' THEN 2 WHEN time > 1 THEN 3 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM f),
w AS (
  SELECT conv_id, 0 AS step, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS c0, {_NONE} AS c1,
    {{'cost': 2, 'audit': 'I', 'said': ['user:']}} AS c2, {{'cost': 4, 'audit': 'II', 'said': ['user:', 'assistant:']}} AS c3 FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, step, c0, c1, {_inserts_sql(2)} AS c2, {_inserts_sql(3)} AS c3 FROM (
    SELECT conv_id, step, c0, c1, {_inserts_sql(2)} AS c2, {_inserts_sql(3)} AS c3 FROM (
      SELECT w.conv_id, step + 1 AS step, {", ".join(f"{_turn_sql(s)} AS c{s}" for s in range(4))} FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND n = step + 1
    )
  )
),
e AS (SELECT conv_id, list_min([c0, c3]) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step DESC) = 1),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (seam NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op3_seekable_warc": OP3_SQL,
    "op5_near_duplicates": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_structure_repair": OP13_SQL,
}
