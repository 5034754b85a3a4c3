"""The registered queries of this subpackage and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, read

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def uniform_sql(key: str, salt: str) -> str:
    digest = f"md5(concat_ws(':', coalesce(CAST({key} AS VARCHAR), 'null'), CAST({salt} AS VARCHAR)))"
    return f"((CAST(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


#: CRC-32 of a text in UTF-8, over a table of the 256 byte remainders.
CRC_TABLE = """SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {octets}, lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295)"


@register(
    "op10_digest_index",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
    FROM d WINDOW g AS (PARTITION BY h)
    """,
)
def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.digests import dedupe_groups

    return dedupe_groups(read(spark, sf_dir, "documents"))


@register(
    "op6_rendezvous_shards",
    f"""
    WITH remainders AS ({CRC_TABLE}), draws AS (
      SELECT doc_id, shard, -ln({uniform_sql('doc_id', 'shard')}) AS draw
      FROM documents, (SELECT unnest(range(0, 41)) AS shard)
    ), placed AS (
      SELECT doc_id, arg_min(shard, draw) FILTER (WHERE shard < 40) AS shard, arg_min(shard, draw) AS grown_shard
      FROM draws GROUP BY doc_id
    )
    SELECT d.doc_id, strlen(coalesce(d.text, '')) + 16 AS size, {crc_sql("coalesce(d.text, '')")} AS text_crc32, 'key' AS law, CAST(p.shard AS BIGINT) AS shard,
      row_number() OVER (PARTITION BY p.shard ORDER BY d.doc_id) - 1 AS slot, CAST(p.grown_shard AS BIGINT) AS grown_shard
    FROM documents d JOIN placed p USING (doc_id), remainders
    """,
)
def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), 40)


@register(
    "op4_source_mix",
    rf"""
    WITH d AS (
      SELECT doc_id, source, len({WORDS}) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]+')) AS runs FROM documents
    ), k AS (
      SELECT doc_id, source, size, -ln({uniform_sql('doc_id', '7')}) / (1.0 / (1.0 + runs / CAST(greatest(size, 1) AS DOUBLE))) AS draw FROM d
    ), s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), w AS (
      SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap,
        sum(source_size) OVER () AS total FROM s
    ), o AS (
      SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(w) OVER before, 0) AS w_before, sum(w) OVER () AS w_all FROM w
      WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), c AS (
      SELECT *, cap * (w_all - w_before) <= (total * 150 / 100 - cap_before) * w AS stops FROM o
    ), t AS (
      SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE)
        ELSE (total * 150 / 100 - coalesce(sum(cap) FILTER (WHERE stops) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT stops) OVER () END AS target
      FROM c
    ), u AS (
      SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k
    )
    SELECT doc_id, u.source, size, source_size, target, epochs,
      size * (epochs + CAST(size > 0 AND epochs < 2 AND upto - size / 2 <= target - epochs * source_size AS BIGINT)) AS taken
    FROM u JOIN (
      SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
    ) t ON u.source IS NOT DISTINCT FROM t.source
    """,
)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


@register(
    "op1_capture_index",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
      FROM pages
    )
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM p
    """,
)
def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.captures import capture_histories

    return capture_histories(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_minimum_bin_slack")
def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def cascade_sql() -> str:
    from tidemark.llm.cascade import RULE_SQL

    failed = " OR ".join(f"({x})" for x in RULE_SQL.values())
    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
    ), w AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM (
        SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_zip(words, words[2:], words[3:], true)) AS three FROM d WHERE len(words) > 2
      )
    ), r AS (
      SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM w WHERE n > 1) GROUP BY doc_id
    ), b AS (
      SELECT d.doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)
    ), f AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM f
    """


@register("op2_rule_cascade", cascade_sql())
def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.cascade import judge

    return judge(read(spark, sf_dir, "documents"))


@register("op8_quadratic_discriminant")
def op8_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op5_marginal_unigrams")
def op5_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify, train

    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


@register(
    "op9_shingle_join",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) BETWEEN 1 AND 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(list_zip(words, words[2:], words[3:], words[4:], words[5:], true), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4], z[5])) END) AS shingle
      FROM w
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY 1
    ), p AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), l AS (
      SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
    ), r AS (
      SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x
    )
    SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
    """,
)
def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


@register("op7_block_labeller")
def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.extraction import extract

    return extract(read(spark, sf_dir, "pages"))


#: The same as ``looped`` below, and the crc by the table of remainders.
LOOPED = rf"""
    SELECT doc_id, CASE WHEN h % 10 = 0 AND len(words) > 0
        THEN list_transform(range(0, len(words)), lambda i: words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) ELSE words END AS words
    FROM (
      SELECT *, 1 + (len(words) - a) // (3 + (h // 10) % 8) AS p FROM (
        SELECT doc_id, h, words, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) ELSE 0 END AS a FROM (
          SELECT doc_id, {WORDS} AS words, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, remainders
        )
      )
    )"""


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and the words that ``op13`` asks for, one space apart: in a tenth of the documents a passage repeats to the end."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    rows = docs.select("doc_id", words.alias("words"), h.alias("h")).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.element_at("words", F.col("a") + (i - F.col("a")) % F.col("p") + 1))
    loop = F.concat(F.slice("words", F.lit(1), F.col("a")), tail)
    return rows.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), loop).otherwise(F.col("words")), " ").alias("text"))


@register(
    "op13_frequency_splitting",
    rf"""
    WITH remainders AS ({CRC_TABLE}), d AS ({LOOPED}), w AS (
      SELECT doc_id, len(words) AS n, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS three
      FROM (SELECT doc_id, words, unnest(range(0, len(words) - 2)) AS i FROM d WHERE len(words) >= 6)
    ), e AS (
      SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.three = y.three AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
    ), s AS (
      SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length
      FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island
    ), r AS (
      SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
    ), t AS (
      SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), [-length, start, period]) AS top,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs,
        list_distinct(flatten(list(range(start + period, start + length)))) AS gone
      FROM r GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
      1000 * top.length // top.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
      sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
    FROM d LEFT JOIN t USING (doc_id) LEFT JOIN (
      SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept
      FROM (SELECT d.doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM d JOIN t ON d.doc_id = t.doc_id) x
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS j FROM t) g WHERE g.doc_id = x.doc_id AND g.j = x.i) GROUP BY x.doc_id
    ) USING (doc_id)
    """,
)
def op13_frequency_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periods import periodic_runs

    found = periodic_runs(looped(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    # The greatest length first, of equals the smallest start, then period.
    order = lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))
    top = F.array_min(F.transform("runs", order))
    rows = found.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.array_join(lines, "").alias("lines"), "collapsed")
    length, period = -F.col("top.less"), F.col("top.period")
    return rows.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register(
    "op11_superminhash",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) BETWEEN 1 AND 2 THEN [array_to_string(words, ' ')]
        ELSE list_transform(list_zip(words, words[2:], words[3:], true), lambda z: concat_ws(' ', z[1], z[2], z[3])) END) AS shingle
      FROM w
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY 1
    ), p AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), l AS (
      SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
    ), r AS (
      SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x
    )
    SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
    """,
)
def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.superminhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@register(
    "op12_hilbert_zone_maps",
    """
    WITH e AS (
      SELECT vec_id, CAST(label AS BIGINT) AS own, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (own + 1) % 10 ELSE own END AS label, x FROM e
    ), s AS (
      SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label,
        CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 3
    """,
)
def op12_hilbert_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.negatives import hard_negatives

    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
