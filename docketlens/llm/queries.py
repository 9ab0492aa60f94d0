"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlens.llm import (chat_format, edit_embedding, mixing, quality_rules, secret_index, simhash_variants, sos_packing, structure_repair,
                            token_alignment, token_frames, tree_bpe, url_validity, vector_packing)
from docketlens.llm.words import read
from docketlens.session import checkpoint_dir


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


_RULES = quality_rules.Rules()
_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in quality_rules.BOILERPLATE)
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
m AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n, len(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
  len(list_filter(string_split_regex(l, '[\\x20\\x09]+'), lambda x: x IN ('|', '»', '›', '•', '·'))) AS seps,
  len(list_filter(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: regexp_matches(x, '[#*$%&|<>]|!!'))) AS noisy FROM l),
f AS (SELECT *, CASE WHEN n = 0 THEN NULL
  WHEN seps >= {_RULES.min_separators} AND seps * {_RULES.words_per_separator} >= n THEN 'navigation'
  WHEN n <= {_RULES.max_boilerplate_words} AND ({_PHRASES}) THEN 'boilerplate'
  WHEN noisy * 100 > n * {_RULES.max_noisy_percent} THEN 'punctuation'
  WHEN n < {_RULES.min_words_without_end} AND NOT regexp_matches(l, '[.!?…。！？:;,)\\]"''”’»\\-]\\s*$') THEN 'punctuation' END AS fails FROM m),
s AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines, coalesce(sum(chars) FILTER (fails IS NOT NULL), 0) AS lost_chars,
  count(*) FILTER (fails = 'punctuation') AS n_punctuation_lines, count(*) FILTER (fails = 'navigation') AS n_navigation_lines,
  count(*) FILTER (fails = 'boilerplate') AS n_boilerplate_lines FROM f GROUP BY doc_id),
a AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars, n_punctuation_lines, n_navigation_lines, n_boilerplate_lines
  FROM t JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {_RULES.max_lost_percent} AS kept,
  lost_chars::BIGINT AS lost_chars, n_punctuation_lines, n_navigation_lines, n_boilerplate_lines FROM b"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_chars", "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines")


@query("op10_simhash_variants")
def op10_simhash_variants(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return simhash_variants.near_duplicates(docs).select(
        "doc_id", simhash_variants.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_secret_index")
def op3_secret_index(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_index.scan(read(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    kinds = [r.kind for r in secret_index.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(secret_index.span_list(base), 256).alias("base_sha256"),
                        secret_index.span_list(F.col("spans")).alias("spans"))


MIXING_SQL = """
WITH t AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM t GROUP BY source),
w AS (SELECT source, source_size, ([3, 1, 2])[1 + (rk - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER b AS given, sum(weight) OVER () - sum(weight) OVER b AS free, lead(cap / weight) OVER (ORDER BY cap / weight, source NULLS LAST) AS next_ratio
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
a AS (SELECT 1.5 * sum(source_size) AS amount FROM s),
c AS (SELECT (amount - given) / free AS level, next_ratio FROM o, a WHERE free > 0
  UNION ALL SELECT (SELECT amount FROM a) / sum(weight), min(cap / weight) FROM w),
g AS (SELECT max(level) AS level FROM c WHERE level <= next_ratio),
b AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM w, g),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (greatest(0, least(size, round(target)::BIGINT - before))
  + greatest(0, least(size, round(target)::BIGINT - source_size - before)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source"""


@query("op4_mixing", MIXING_SQL)
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_tree_bpe")
def op8_tree_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return tree_bpe.encode(docs, vocabulary("word_bpe_49k.json"), "bare", keep=["doc_id"], cached=1_000_000).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_vector_packing")
def op2_vector_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = vector_packing.text_sizes(read(spark, sf, "documents").select("doc_id", "text")).withColumn("text_crc32", vector_packing.crc(F.col("text")))
    out = vector_packing.pack(docs.drop("text"), 8, "doc_id")
    return out.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "tokens")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
e AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
  len(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1' || chr(92) || chr(92) || '\2\3', 'g')) AS body
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + CASE WHEN opens THEN 22 + len(role) ELSE 8 END + CASE WHEN closes THEN 11 ELSE 0 END)::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM e GROUP BY conv_id"""


@query("op7_chat_format", CHAT_SQL)
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], turns.schema)
    back = chat_format.parse_chats(chat_format.format_chats(turns.union(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"),
                       (F.size(F.split("formatted", F.lit(r"<\|im_start\|>"))) - 1).cast("long").alias("n_blocks"))


@query("op9_token_frames")
def op9_token_frames(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid4().hex}"
    manifest = token_frames.write_tokens(read(spark, sf, "documents"), folder, vocabulary("byte_bpe_50k.json"), "led", end_id=0)
    return token_frames.read_tokens(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_edit_embedding")
def op6_edit_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return edit_embedding.neighbours(read(spark, sf, "documents"))


URL_SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched_on, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, [strpos('0123456789abcdef', substr(md5(host), i, 1)) for i in range(1, 5)] AS d FROM c WHERE host <> ''),
e AS (SELECT 'spam' AS list, 'block' AS action, 'domain' AS kind, host AS value, 'add' AS change, d[2] * 10 AS day FROM h WHERE d[1] <= 4
  UNION ALL SELECT 'spam', 'block', 'domain', host, 'remove', d[2] * 10 + d[3] * 8 FROM h WHERE d[1] <= 4
  UNION ALL SELECT 'spam', 'block', 'domain', host, 'add', d[2] * 10 + d[3] * 8 + d[4] * 5 FROM h WHERE d[1] <= 4 AND d[4] > 8
  UNION ALL SELECT 'adult', 'block', 'domain', regexp_replace(host, '^(m|www|blog)\.', ''), 'add', 30 FROM h WHERE regexp_matches(host, 'casino|bets|pills')
  UNION ALL SELECT 'trusted', 'allow', 'prefix', host || '/en', 'add', 31 + d[2] FROM h WHERE d[1] > 12),
g AS (SELECT DISTINCT list, action, kind, value, change, DATE '2024-01-01' + day::INT AS day FROM e),
v AS (SELECT list, action, kind, value, day AS valid_from, change, lead(day) OVER (PARTITION BY list, action, kind, value ORDER BY day) AS valid_to FROM g),
s AS (SELECT page_id, url, fetched_on, host, path, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM c WHERE host <> ''),
k AS (SELECT page_id, fetched_on, 'domain' AS kind, unnest([array_to_string(l[i:], '.') for i in range(1, len(l))]) AS value FROM s
  UNION ALL SELECT page_id, fetched_on, 'prefix', unnest([array_to_string(list_concat([host], p[1:i]), '/') for i in range(0, len(p) + 1)]) FROM s),
f AS (SELECT page_id, count(*) AS n_hits, bool_or(action = 'block') AS blocked, bool_or(action = 'allow') AS allowed, min(list) AS first_list
  FROM k JOIN v ON k.kind = v.kind AND k.value = v.value AND change = 'add' AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched_on::VARCHAR AS fetched_on, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(blocked, false) AS blocked, coalesce(allowed, false) AS allowed,
  first_list, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'none' END AS verdict FROM c LEFT JOIN f USING (page_id)"""


def list_log(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of the table: entries come and go on days that a hash of the host sets."""
    hosts = pages.select(url_validity.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    d = [F.position(F.substring(F.md5("host"), i, 1), F.lit("0123456789abcdef")) for i in range(1, 5)]

    def entry(when, name, action, kind, value, change, day):
        fields = {"list": F.lit(name), "action": F.lit(action), "kind": F.lit(kind), "value": value, "change": F.lit(change), "day": day}
        return F.when(when, F.struct(*[c.alias(n) for n, c in fields.items()]))

    host, first, second = F.col("host"), d[1] * 10, d[1] * 10 + d[2] * 8
    entries = F.array(
        entry(d[0] <= 4, "spam", "block", "domain", host, "add", first), entry(d[0] <= 4, "spam", "block", "domain", host, "remove", second),
        entry((d[0] <= 4) & (d[3] > 8), "spam", "block", "domain", host, "add", second + d[3] * 5),
        entry(host.rlike("casino|bets|pills"), "adult", "block", "domain", F.regexp_replace(host, r"^(m|www|blog)\.", ""), "add", F.lit(30)),
        entry(d[0] > 12, "trusted", "allow", "prefix", F.concat(host, F.lit("/en")), "add", d[1] + 31))
    flat = hosts.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")
    return flat.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))).withColumn("seq", F.lit(0))


@query("op5_url_validity", URL_SQL)
def op5_url_validity(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    out = url_validity.judge(captures, list_log(pages))
    return out.select("page_id", "url", F.col("fetched_on").cast("string").alias("fetched_on"), "n_hits", "blocked", "allowed", "first_list", "verdict")


def _repair_sql() -> str:
    """The same dynamic program as a recursive query; a state is (cost, audit, repaired turns), the least of which is kept."""

    def add(state: str, cost: str, edit: str, line: str | None = None) -> str:
        turns = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {turns}}} END"

    def stay(state: str, role: str) -> str:
        keep = add(state, "late", "K", "role || ':' || text")
        reroled = add(state, "late + 1", "R", f"'{role}:' || text")
        return f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN initial = '{role[0]}' THEN {keep} ELSE {reroled} END"

    user, answer = "'user:'", "'assistant:'"
    relaxed = f"""SELECT *, least(a, {add('u0', '5', 'I', answer)}) AS a0 FROM (SELECT *, least(u, {add('e', '5', 'I', user)}, {add('s', '5', 'I', user)},
  {add('a', '5', 'I', user)}) AS u0 FROM v)"""
    system = f"CASE WHEN initial = 's' AND coalesce(fault, '') NOT IN ('blank', 'duplicate') THEN {add('e', 'late', 'K', "role || ':' || text")} END"
    return f"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS code FROM conversations, tbl),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) FROM k WHERE code <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), sha256(text)) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault FROM p),
r AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM f),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS step, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS s,
    NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS a FROM conversations
  UNION ALL SELECT w.conv_id, step + 1, {add('e', '2', 'D')}, least({add('s', '2', 'D')}, {system}), least({add('u0', '2', 'D')}, {stay('e', 'user')}, {stay('s', 'user')},
    {stay('a0', 'user')}), least({add('a0', '2', 'D')}, {stay('u0', 'assistant')}) FROM ({relaxed}) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = step + 1),
b AS (SELECT conv_id, least(e, a0) AS best FROM ({relaxed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step DESC) = 1),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM b LEFT JOIN c ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op11_structure_repair", _repair_sql())
def op11_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = structure_repair.damage(read(spark, sf, "conversations"))
    return structure_repair.summaries(structure_repair.repair(turns, "absent"), "absent")


@query("op13_sos_packing")
def op13_sos_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = sos_packing.pack(read(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), "bare", end_id=1, keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    out = token_alignment.align(read(spark, sf, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
