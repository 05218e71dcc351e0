"""One query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import (
    bpe, chat, language, license_scan, member_lloyd, mixing, prefix_forest, quality_rules, secret_scan, sharding, simhash, wavelet,
    whitening,
)
from almanac.llm.common import table
from almanac.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS draw FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, n0 AS n, [5.0, 2.0, 1.0][n0 % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n0 FROM sizes)),
summed AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM ranked),
leveled AS (SELECT *, cap * ws <= rest * w AS stops,
  coalesce((SELECT arg_min(rest / ws, (ratio, n)) FROM summed WHERE NOT cap * ws <= rest * w), 0) AS lvl FROM summed),
aims AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE lvl * w END AS target FROM leveled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS base FROM aims),
hashes AS (SELECT r.source, r.draw, p.target - p.base * p.source_size AS rest, sum(size) AS size
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw) AS upto FROM hashes),
taken AS (SELECT source, draw, upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) AS more FROM running)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(r.size * (p.base + CASE WHEN t.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
JOIN taken t ON t.source IS NOT DISTINCT FROM r.source AND t.draw = r.draw
"""


@query("op5_mixing", OP5_SQL)
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_report(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _draw_sql(path: str, weight: float) -> str:
    number = f"CAST('0x' || substr(md5(k || '/{path}'), 1, 13) AS BIGINT)"
    return f"(-ln(({number} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight}::DOUBLE)"


def _tree_sql(leaves) -> str:
    """Shard of the key ``k``: the smallest draw wins at every level."""

    def pick(options: list[tuple[str, float, str]]) -> str:
        if len(options) == 1:
            return options[0][2]
        draws = [_draw_sql(path, weight) for path, weight, _ in options]
        least = f"least({', '.join(draws)})"
        cases = " ".join(f"WHEN {d} = {least} THEN {below}" for d, (_, _, below) in zip(draws, options, strict=True))
        return f"CASE {cases} END"

    regions = []
    for r in sorted({x.region for x in leaves}):
        part, racks = [x for x in leaves if x.region == r], []
        for n in sorted({x.rack for x in part}):
            own = [x for x in part if x.rack == n]
            shards = pick([(f"{r}/{n}/{x.shard}", x.weight, str(x.shard)) for x in own])
            racks.append((f"{r}/{n}", sum(x.weight for x in own), shards))
        regions.append((f"{r}", sum(x.weight for x in part), pick(racks)))
    return pick(regions)


OP6_SQL = f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
rows AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, strlen(coalesce(text, '')) + 1 AS size,
  xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: CAST('0x' || h AS BIGINT)), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM documents, crc),
placed AS (SELECT doc_id, size, text_crc32, CAST('0x' || substr(md5(k), 1, 13) AS BIGINT) AS o,
  CAST({_tree_sql(sharding.topology(8))} AS INT) AS shard, CAST({_tree_sql(sharding.topology(9))} AS INT) AS grown_shard FROM rows)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, size) - 1 AS BIGINT) AS slot FROM placed
"""


@query("op6_sharding", OP6_SQL)
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


OP10_ADDED = "</s>[INST] ok [/INST]"


def _escape_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control, written in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{written}')"
    return out


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{OP10_ADDED}'), (-1, 1, 'assistant', '{OP10_ADDED}')),
shown AS (SELECT *, '{chat.OPEN}' || replace({_escape_sql("role")}, chr(10), '\\n') || chr(10) || {_escape_sql("text")}
  || '<|im_end|>' || chr(10) AS turn_text, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(turn_text)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query("op10_chat", OP10_SQL)
def op10_chat(spark: SparkSession, sf: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(OP10_ADDED).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    shown = chat.render(chat.fold_events(chat.row_events(rows)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = shown.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op2_wavelet")
def op2_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    shards = wavelet.encode_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_documents(shards)


@query("op7_language")
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query("op9_prefix_forest")
def op9_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return prefix_forest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def _document_path(doc_id: str, source: str, text: str) -> str:
    """SQL of the stand-in path: the source is a repository, ids are filed by thousands and hundreds."""
    return f"concat_ws('/', coalesce({source}, 'unnamed'), {text.format(f'{doc_id} // 1000')}, {text.format(f'{doc_id} // 100 % 10')}, {text.format(doc_id)})"


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))
OP3_SQL = rf"""
WITH files AS (SELECT doc_id, {_document_path("doc_id", "source", "CAST({} AS VARCHAR)")} AS path, text FROM documents),
seen AS (SELECT DISTINCT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files) WHERE trim(line) <> ''),
known AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) t(i, license, line)),
counted AS (SELECT line, count(*) AS n FROM seen GROUP BY line UNION ALL SELECT line, 1 FROM known),
idf AS (SELECT term, ln(((SELECT sum(n) FROM counted)::DOUBLE + 1) / (sum(n)::DOUBLE + 1)) + 1 AS idf
  FROM (SELECT n, unnest(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS term FROM counted) GROUP BY term),
stated AS (SELECT DISTINCT doc_id, path, trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g')) AS line FROM (
  SELECT doc_id, path, unnest(string_split(text, chr(10)) || string_split_regex(text, '\n[ \t\r]*\n') || [text]) AS line FROM files)),
lines AS (SELECT DISTINCT 's' || line AS k, line FROM stated UNION ALL SELECT 't' || i, line FROM known),
terms AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM lines) GROUP BY ALL),
w AS (SELECT k, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM terms JOIN idf USING (term)),
norms AS (SELECT k, sqrt(sum(w * w)) AS norm FROM w GROUP BY k),
dots AS (SELECT a.k, t.i, t.license, sum(a.w * b.w / bn.norm) AS dot FROM w a JOIN w b USING (term)
  JOIN known t ON b.k = 't' || t.i JOIN norms bn ON bn.k = b.k WHERE a.k LIKE 's%' AND b.k LIKE 't%' GROUP BY ALL),
scored AS (SELECT substr(k, 2) AS line, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (k)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, path, license, score FROM stated JOIN best USING (line) WHERE score >= {license_scan.LEAST}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
standing AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS from_dir, license, score FROM own
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY doc_id, path) = 1),
near AS (SELECT f.doc_id, s.* FROM files f JOIN standing s ON starts_with(f.path, s.from_dir || '/') OR s.from_dir = ''
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(s.from_dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, u.license) AS license, coalesce(o.score, u.score) AS score,
  CASE WHEN o.path IS NOT NULL THEN 'own' WHEN u.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.path IS NULL THEN u.from_dir END AS from_dir
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN near u ON u.doc_id = f.doc_id
"""


@query("op3_license_scan", OP3_SQL)
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The documents have no paths: the source stands for a repository, and ids are filed by thousands and hundreds."""
    docs = table(spark, sf, "documents")
    path = F.expr(_document_path("doc_id", "source", "CAST({} AS STRING)").replace("//", "div"))
    found = license_scan.scan(docs.select(F.col("doc_id").alias("rank"), path.alias("path"), "text"))
    return found.withColumnRenamed("rank", "doc_id")


def _lloyd_sql() -> str:
    """The rounds written out one after the other over the parts of the kept vectors."""
    parts, entries, scale = member_lloyd.PARTS, member_lloyd.ENTRIES, member_lloyd.SCALE
    squares = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"parts AS (SELECT r, p, list_slice(x, p * len(x) // {parts} + 1, (p + 1) * len(x) // {parts}) AS x FROM kept, range({parts}) t(p))",
        f"c0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries})",
    ]
    for n in range(member_lloyd.ROUNDS + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': {squares}, 'e': e}}) AS b "
            f"FROM parts JOIN c{n} USING (p) GROUP BY r, p)"
        )
        if n < member_lloyd.ROUNDS:
            steps.append(
                f"s{n} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, b.e AS e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m "
                f"FROM (SELECT p, b, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL) GROUP BY p, e)"
            )
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (p, e))")
    last = member_lloyd.ROUNDS
    steps.append(
        f"coded AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{last} GROUP BY r)"
    )
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""


@query("op11_member_lloyd", _lloyd_sql())
def op11_member_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    coded = member_lloyd.compress(table(spark, sf, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def _secret_sql() -> str:
    """Matches and the pieces between them, unnested and summed by windows."""
    token = secret_scan.TOKEN_KIND
    patterns = [secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.TOKEN]
    quoted = ["'" + p.replace("'", "''") + "'" for p in patterns]
    found = " UNION ALL ".join(
        f"SELECT key, {kind} AS kind, i, v, sum(length(gap) + length(v)) OVER (PARTITION BY key ORDER BY i) AS stop, "
        + (f"regexp_extract(v, {p}, 2)" if kind == 0 else "v")
        + f""" AS value FROM (SELECT key, unnest(m) AS v, unnest(string_split_regex(text, {p})[:len(m)]) AS gap, generate_subscripts(m, 1) AS i
  FROM (SELECT key, text, regexp_extract_all(text, {p}) AS m FROM docs) WHERE len(m) > 0)"""
        for kind, p in enumerate(quoted)
    )
    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    written = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
  coalesce(source || '/' || (doc_id // 1000), '') AS repo FROM documents),
found AS ({found}),
spans AS (SELECT key, kind, CAST(stop - length(v) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, sha256(value) AS hash, value,
  len(list_distinct(string_split(value, ''))) >= {secret_scan.LEAST_DISTINCT}
    AND NOT regexp_matches(value, '{secret_scan.PLACEHOLDER}') AS looks FROM found),
kept AS (SELECT * FROM spans WHERE CASE kind WHEN 0 THEN length(value) >= {secret_scan.ASSIGN_LEAST}
  WHEN {token} THEN looks AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') ELSE true END),
held AS (SELECT hash, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM kept JOIN docs USING (key) GROUP BY hash),
judged AS (SELECT kept.*, CASE WHEN owners >= {secret_scan.COPIED_OWNERS} OR repos >= {secret_scan.COPIED_REPOS} THEN 'example'
  WHEN looks AND owners = 1 THEN 'live' ELSE 'unsure' END AS verdict FROM kept JOIN held USING (hash)),
told AS (SELECT *, kind < {token} AS base, kind = {token} AND verdict = 'live' AND NOT EXISTS (SELECT 1 FROM judged b
  WHERE b.key = judged.key AND b.kind < {token} AND b.start < judged.stop AND b.stop > judged.start) AS added FROM judged),
summed AS (SELECT key, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  {written} FILTER (base) AS base_spans, {written} FILTER (base OR added) AS spans,
  count(*) FILTER ((base OR added) AND verdict = 'live') AS n_live, count(*) FILTER ((base OR added) AND verdict = 'example') AS n_example
  FROM told GROUP BY key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN summed USING (key)
"""


@query("op12_secret_scan", _secret_sql())
def op12_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The documents name no repository: the source stands for the owner, and its ids by thousands for repositories."""
    repo = F.concat("source", F.lit("/"), F.expr("doc_id div 1000").cast("string"))
    return secret_scan.scan(table(spark, sf, "documents"), "doc_id", "text", F.col("source"), repo)
