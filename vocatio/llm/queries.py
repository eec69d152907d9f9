"""One query for each operator, over its whole table and with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.llm import alignment, ann, bpe, chats, linededup, packing, pages, quality, secrets, sharding, simhash, tokencounts, trie
from vocatio.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_consensus_host_paths")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op2_pack_power_of_two")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op3_count_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query(
    "op4_line_dedup_runs",
    """
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    firsts AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key),
    judged AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
    SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


@query("op5_projected_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def quality_sql() -> str:
    """The base counts and the line rules of ``quality`` over ``documents``."""
    word = r"[^\x20\x09-\x0D]+"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    closing, terminal = quality.CLOSING.replace("'", "''"), quality.TERMINAL
    w = quality.WINDOW
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + {w - 1}], ' ') AS part
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) AS i FROM d WHERE len(w) >= {w})),
    repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS c FROM windows) WHERE c > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM repeated, (SELECT unnest(range({w})) AS o) GROUP BY doc_id),
    cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    lines AS (SELECT doc_id, line, trim(line, {blank}) AS bare, regexp_extract_all(line, '{word}') AS w FROM cut),
    judged AS (
        SELECT doc_id, line, len(w) AS n, rtrim(bare, '{closing}') <> ''
            AND (regexp_matches(rtrim(bare, '{closing}'), '[{terminal}]$')
                OR (len(w) > {quality.PASSAGE_WORDS} AND regexp_matches(bare, '[{terminal}][\\x20\\x09-\\x0D]')))
            AND len(list_filter(w, lambda x: regexp_matches(x, '{quality.MARKS}$'))) <= {quality.MAX_MARKED} * len(w)
            AND NOT (len(regexp_extract_all(bare, '{quality.SEPARATORS.pattern}')) >= {quality.NAV_SEPARATORS}
                AND 4 * len(regexp_extract_all(bare, '{quality.SEPARATORS.pattern}')) >= len(w))
            AND NOT regexp_matches(bare, '[{{}}]')
            AND (len(w) > {quality.BOILERPLATE_WORDS} OR NOT regexp_matches(bare, '(?i){quality.BOILERPLATE.pattern}')) AS passes
        FROM lines WHERE len(w) > 0),
    by_doc AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (passes), 0) AS n_kept FROM judged GROUP BY doc_id),
    counted AS (
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_kept, 0) AS n_kept
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN by_doc b ON b.doc_id = d.doc_id),
    based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND n_kept >= {quality.MIN_KEPT} * n_words AS kept FROM based
    """


@query("op6_line_first_quality", quality_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


@query("op7_feistel_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op8_secret_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's verdict; the value itself stays out of the report."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "pos", "start", F.length("value").cast("long").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "probability", "is_secret",
    )


@query("op9_simhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digest=True)


@query("op11_align_tokenizers")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), digest=True)


# CRC-32 bit by bit: each of the eight steps of a byte, the byte itself taken in before the first.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(k))), lambda crc, i:
    xor(xor(crc, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1])::BIGINT ELSE 0 END) >> 1,
        3988292384 * (xor(crc, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1])::BIGINT ELSE 0 END) & 1))), 4294967295::BIGINT)"""


@query(
    "op12_prefix_trie_tour",
    f"""
    WITH turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    keyed AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS k FROM turns),
    convs AS (SELECT c, c - c % 100 AS base, {CRC32_SQL} % {trie.SHARED} AS h FROM keyed),
    rows AS (
        SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
        UNION ALL SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
    numbered AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM rows),
    chained AS (
        SELECT c, depth, length(text) AS chars,
            md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY depth)) AS key
        FROM numbered
        UNION ALL SELECT c, 0, 0, '' FROM convs),
    held AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS last FROM chained),
    nodes AS (
        SELECT key, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
        FROM held GROUP BY key, depth),
    children AS (SELECT up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
    own AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN children k ON k.key = n.key),
    subtrees AS (
        SELECT h.key, sum((o.n_children = 0)::INT) AS n_leaves, sum(o.saved) AS saved_tokens
        FROM own o JOIN held h ON h.c = o.conv_id AND h.depth <= o.depth GROUP BY h.key)
    SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children,
        CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
    FROM own o JOIN subtrees s ON s.key = o.key LEFT JOIN own p ON p.key = o.up AND p.depth = o.depth - 1
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


MARKED = "</s>[INST] ok [/INST]"  # what both turns of conversation -1 say


@query(
    "op13_reply_tree_chats",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, '{chats.LEARNT}', '{MARKED}'),
    whole AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{chats.LEARNT}'), '') AS learnt,
            sum({len(chats.OPEN + chats.BETWEEN + chats.CLOSE)} + length(role) + length(text)
                + len(regexp_extract_all(role, '{chats.CONTROL}')) + len(regexp_extract_all(text, '{chats.CONTROL}'))) AS chars
        FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
        CAST(chars AS BIGINT) AS formatted_chars
    FROM whole
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, chats.LEARNT, MARKED)], "conv_id long, turn long, role string, text string")
    return chats.report(turns.unionByName(extra))
