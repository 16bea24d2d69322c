"""The registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .decontaminate import leaks
from .html_extract import extract_text
from .imatch import compare_edited
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .line_rules import BOILERPLATE, END, NAVIGATION, clean_lines
from .lm_score import score_texts
from .merkle import digest_of, fold, merkle_proofs, proof_digest
from .packing import pack_documents
from .repeats import remove_repeats
from .spelling import LOWER, UPPER, group_variants
from .url_filter import judge_urls
from .warc import plan_records, read_bundles, write_bundles

#: Host, start of the path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_bundles(plan_records(_table(spark, sf_dir, "pages")), path)
    return read_bundles(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(_table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "id as doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return found.withColumnRenamed("id", "doc_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_table(spark, sf_dir, "documents"))
    return found.selectExpr("id as doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.selectExpr("id as doc_id", "item as item_id", "item_words", "agreeing")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"))
    return found.selectExpr("id as doc_id", "n_shingles", "component_id", "class_id", "class_size", "n_links")


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = digest_of([F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in fields])
    found = merkle_proofs(docs, fields, "lang", "doc_id", {"seen": F.when(tampered, seen)})
    folded = fold(F.coalesce("seen", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_lm_score": op2_lm_score,
        "op3_suffix_repeats": op3_suffix_repeats,
        "op4_packing": op4_packing,
        "op5_html_extract": op5_html_extract,
        "op6_language_id": op6_language_id,
        "op7_url_filter": op7_url_filter,
        "op8_decontaminate": op8_decontaminate,
        "op9_imatch": op9_imatch,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_line_rules": op11_line_rules,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), f AS (
  SELECT page_id, octet_length(body) AS n, sha256(body) AS d,
         CASE WHEN octet_length(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_OP7_SQL = """
WITH h AS (
  SELECT page_id,
         lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS rn
  FROM h LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rn = 1
"""


_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), m(mask, i0, i1, i2, i3, i4) AS (VALUES (0, 0, 1, 2, 4, 5), (1, 0, 1, 3, 4, 6), (2, 0, 2, 3, 5, 8), (3, 0, 2, 4, 6, 8), (4, 0, 1, 4, 7, 8),
  (5, 0, 3, 4, 5, 7)),
ds AS (
  SELECT doc_id, p, mask, w[p + i0 + 1] || ' ' || w[p + i1 + 1] || ' ' || w[p + i2 + 1] || ' ' || w[p + i3 + 1]
         || ' ' || w[p + i4 + 1] AS seed
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d), m
), bs AS (
  SELECT item_id, p, mask, w[p + i0 + 1] || ' ' || w[p + i1 + 1] || ' ' || w[p + i2 + 1] || ' ' || w[p + i3 + 1]
         || ' ' || w[p + i4 + 1] AS seed
  FROM (SELECT item_id, w, unnest(range(len(w))) AS p FROM b), m
), hits AS (
  SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS off FROM ds JOIN bs USING (mask, seed)
), laid AS (
  SELECT doc_id, item_id, len(b.w) AS n,
         len(list_filter(range(len(b.w)), lambda j: j + off >= 0 AND d.w[j + off + 1] = b.w[j + 1])) AS same
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_words, CAST(max(same) AS INTEGER) AS agreeing
FROM laid GROUP BY doc_id, item_id, n
HAVING max(same) >= least(n, greatest(8, ceil(n * 0.5)))
"""


_GAP = r"[\x20\x09-\x0D]"

_OP11_SQL = rf"""
WITH l AS (
  SELECT doc_id, k, lines[k] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), w AS (
  SELECT doc_id, k, j, words[j] AS w
  FROM (SELECT doc_id, k, words, unnest(range(1, len(words) + 1)) AS j
        FROM (SELECT doc_id, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l))
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i FROM w
), g AS (
  SELECT doc_id, k, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS three,
         w || ' ' || lead(w) OVER e || ' ' || lead(w, 2) OVER e AS line_three
  FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i), e AS (PARTITION BY doc_id, k ORDER BY i)
), f AS (
  SELECT doc_id, k, i, three IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, three) > 1 AS twice,
         line_three IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k, line_three) > 1 AS line_twice
  FROM g
), c AS (
  SELECT doc_id, k, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS covered,
         bool_or(line_twice) OVER (PARTITION BY doc_id, k ORDER BY i ROWS 2 PRECEDING) AS line_covered
  FROM f
), n AS (
  SELECT doc_id, k, count(*) AS words, count(*) FILTER (covered) AS repeats, count(*) FILTER (line_covered) AS line_repeats
  FROM c GROUP BY doc_id, k
), r AS (
  SELECT l.doc_id, line, words, repeats, line_repeats,
         row_number() OVER (PARTITION BY l.doc_id, line ORDER BY l.k) > 1 AS earlier, lower(line) AS low
  FROM l JOIN n USING (doc_id, k)
), v AS (
  SELECT *,
    10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > words
    OR 3 * length(regexp_replace(line, '[^!]', '', 'g')) > words
    OR (words < 8 AND NOT regexp_matches(regexp_replace(line, '{_GAP}+$', ''), '{END.replace("'", "''")}'))
    OR (words >= 4 AND 2 * length(regexp_replace(line, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) > length(regexp_replace(line, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')))
    OR (words <= 12 AND regexp_matches(low, '\b(?:{"|".join(NAVIGATION)})\b'))
    OR (words <= 40 AND regexp_matches(low, '{"|".join(BOILERPLATE)}'))
    OR earlier OR 2 * line_repeats > words AS failed
  FROM r
), s AS (
  SELECT doc_id, sum(words) AS n_words, sum(repeats) AS n_repeat_words, count(*) FILTER (earlier) AS n_dup_lines,
         coalesce(sum(words) FILTER (NOT failed), 0) AS kept_words
  FROM v GROUP BY doc_id
), t AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(coalesce(text, ''), '{_GAP}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
  FROM documents d LEFT JOIN s USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND kept_words >= 0.5 * n_words AS kept, kept_words
FROM t
"""

#: crc32 by its table: `crc_table` has it as one list, `{0}` is a list of bytes.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
         lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
)"""
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], {0}), lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) + 1 AS INTEGER)])), 4294967295)"
_BYTES = (
    "list_transform(range(1, CAST(length(hex(encode({0}))) / 2 + 1 AS BIGINT)), lambda i: 16 * (instr('0123456789ABCDEF', hex(encode({0}))[2 * i - 1]) - 1)"
    " + instr('0123456789ABCDEF', hex(encode({0}))[2 * i]) - 1)"
)

_OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents
), k AS (
  SELECT id || ':' || run AS key, run, count(*) AS n FROM o GROUP BY id, run
), h AS (
  SELECT run, n, {_CRC.format(_BYTES.format("key"))} AS h FROM k, crc_table
), t AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), c AS (
  SELECT word, n, p, substring(word, 1, p - 1) AS a, substring(word, p + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM c x JOIN c y ON x.a || '*' || x.b = y.a || '*' || y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, v.word, v.n FROM c x JOIN v ON x.a || x.b = v.word
  UNION SELECT v.word, v.n, x.word, x.n FROM c x JOIN v ON x.a || x.b = v.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS rn, near_n >= 5 * n AS is_form
  FROM near
), f AS (
  SELECT v.word, CASE WHEN is_form THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN is_form THEN near_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word AND rn = 1
), r AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON f.word = r.word
"""


def _op13_sql(levels: int = 8) -> str:
    """The tree by levels of windows: up to 8**levels rows of a language."""

    def laid(field: str, value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(laid(c, text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))"
    parts = [
        _CRC_TABLE,
        f"""l0 AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {_CRC.format(digits)} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen
  FROM documents, crc_table
), n0 AS (
  SELECT doc_id, lang, leaf, coalesce(seen, leaf) AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM l0
)""",
    ]

    def climb(name: str, base: str, group: str, out: str) -> None:
        """CTEs `name`1.. of the nodes above `base`0 by level, and the siblings that each node of a level has."""
        by = f"{group}, " if group else ""
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (
  SELECT {by}i // 8 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, any_value(m) > 1 AS goes
  FROM (SELECT {by}i, h, count(*) OVER ({f"PARTITION BY {group}" if group else ""}) AS m FROM {name}{k}) GROUP BY {by}i // 8
), {out}{k} AS (
  SELECT x.{group or "i"} AS g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after
  FROM {name}{k} x JOIN {name}{k} y ON {f"x.{group} IS NOT DISTINCT FROM y.{group} AND " if group else ""}x.i // 8 = y.i // 8 GROUP BY x.{group or "i"}, x.i
)"""
            )

    climb("n", "n", "lang", "s")
    parts.append(f"r0 AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM n{levels})")
    climb("r", "r", "", "q")
    state = "SELECT doc_id, lang, leaf, i, seen AS h, '' AS proof FROM n0"
    for k in range(levels):
        state = (
            f"SELECT t.doc_id, t.lang, t.leaf, t.i // 8 AS i, CASE WHEN goes THEN sha256(before || t.h || after) ELSE t.h END AS h, t.proof || CASE WHEN goes THEN before || after ELSE '' END AS proof"
            f" FROM ({state}) t JOIN s{k} s ON t.lang IS NOT DISTINCT FROM s.g AND t.i = s.i JOIN n{k + 1} n ON t.lang IS NOT DISTINCT FROM n.lang AND t.i // 8 = n.i"
        )
    state = f"SELECT t.doc_id, t.leaf, r.h AS subroot, r.i, t.h, t.proof FROM ({state}) t JOIN r0 r ON t.lang IS NOT DISTINCT FROM r.lang"
    for k in range(levels):
        state = (
            f"SELECT t.doc_id, t.leaf, t.subroot, t.i // 8 AS i, CASE WHEN goes THEN sha256(before || t.h || after) ELSE t.h END AS h, t.proof || CASE WHEN goes THEN before || after ELSE '' END AS proof"
            f" FROM ({state}) t JOIN q{k} s ON t.i = s.i JOIN r{k + 1} n ON t.i // 8 = n.i"
        )
    return (
        "WITH "
        + ", ".join(parts)
        + f" SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified FROM ({state}) t, r{levels} r"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": _OP1_SQL,
        "op7_url_filter": _OP7_SQL,
        "op8_decontaminate": _OP8_SQL,
        "op11_line_rules": _OP11_SQL,
        "op12_spelling_variants": _OP12_SQL,
        "op13_merkle_manifest": _op13_sql(),
    }
