"""Queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import exact, infill, langid, merkle, mixing, near, packing, quality, secrets, sharding, simhash, urls, warc
from groundwork.llm.common import shared_dir, table, word_count, written

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, (~quality.passes("base-1")).alias("base_failed"), quality.passes("strict-1").alias("kept"), "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger's masks alone: documents it fails, fails alone, and kept without it."""
    rows = written(quality.ledger(table(spark, sf_dir, "documents")).select("failed"), "quality-ledger")
    tables = [quality.ablation(rows, policy).select(F.lit(policy).alias("policy"), "*") for policy in quality.POLICIES]
    return reduce(DataFrame.unionByName, tables)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # A null id has no checksum; such a row is neither held out nor learned from.
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predicted(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


#: Rules of the production policy: verdict, host with path.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rule fits are the labelled ones: the tree learns which templates of a host the rules reject."""
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    captures = warc.assembled(warc.read_records(spark, path))
    number = lambda c: F.regexp_extract(c, r":(-?[0-9]+)>$", 1).try_cast("long")
    again = F.col("response.record_type") == "revisit"
    length = F.regexp_extract("response.http", r"(?i)content-length: ([0-9]+)", 1).cast("long")
    return captures.select(
        number("capture_id").alias("page_id"),
        # A revisit has its payload's length and digest from its headers, any other record from the payload as read.
        F.when(again, length).otherwise(F.col("response.body_bytes")).alias("payload_bytes"),
        F.when(again, F.col("response.digest")).otherwise(F.col("response.body_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
        # Records of the transaction that were found and joined.
        (F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).alias("n_records"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.grouped(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Production parameters of the mixture. The domain of a source is its number's tens and fives: src0-4, 5-9, 10-14, 15-19.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 40, "books": 30, "news": 20, "forum": 10}, "lang": {"en": 55, "fr": 15, "de": 15, "es": 15}}
MIX = {"budget_share": 0.6, "max_epochs": 3, "seed": 17}


def mix_rows(docs: DataFrame, row_col: str | None = None) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    domain = F.when(number < 5, "web").when(number < 10, "books").when(number < 15, "news").when(number.isNotNull(), "forum")
    return mixing.leaf_rows(docs, {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, word_count(F.col("text")), row_col=row_col)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mix_rows(table(spark, sf_dir, "documents")), "mix-rows")
    return mixing.drawn(rows, MIX_LEVELS, MIX_WEIGHTS, **MIX)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.scan(docs).select("doc_id", "place", "value", *secrets.FEATURES, "probability", "is_secret")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.classified(docs).select("doc_id", "class_id", "class_size", "kept")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(sharding.sized(table(spark, sf_dir, "documents")), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


#: Fields of a manifest's leaf.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number's checksum 7 divides are held against their proofs with one character more than they have."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    changed = F.when(tampered, merkle.leaf_hash([more.get(c, F.col(c)) for c in LEAF]))
    rows = merkle.manifest(table(spark, sf_dir, "documents").select(*LEAF), merkle.leaf_hash([F.col(c) for c in LEAF]), changed)
    rows = rows.withColumn("folded_root", merkle.folded(F.col("presented"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classified(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (10 * n_capitals > 3 * n_letters)::INT
             + 32 * (word_chars > 25 * n_words)::INT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed
FROM b
"""

ABLATION_SQL = f"""
WITH ledger AS ({OP1_SQL}),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('shouting', 16), ('long_words', 32)) AS t(rule, bit)),
policies AS (SELECT * FROM (VALUES ('base-1', 3), ('strict-1', 63)) AS t(policy, mask))
SELECT policy, rule, count_if(failed & bit <> 0) AS n_failed, count_if(failed & mask = bit) AS n_failed_alone, count_if(failed & mask & ~bit = 0) AS n_kept_without
FROM policies JOIN rules ON mask & bit <> 0 CROSS JOIN ledger GROUP BY policy, rule
"""

OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


def _mix_sql() -> str:
    """The same water levels, level by level, written out for three levels."""

    def case(level: str) -> str:
        listed = " ".join(f"WHEN {level} = '{name}' THEN {w}" for name, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE {listed} ELSE 1 END" if listed else "1"

    steps = []
    for depth, level in enumerate(MIX_LEVELS):
        parent, node, tree = ", ".join(MIX_LEVELS[:depth]), ", ".join(MIX_LEVELS[: depth + 1]), f"tree{depth}"
        by = f"PARTITION BY {parent}" if parent else ""
        steps.append(f"""
n{depth} AS (SELECT {node}, sum(cap) AS c, max(given) AS b, {case(level)} AS w FROM {tree} GROUP BY {node}),
o{depth} AS (SELECT *, coalesce(sum(c) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
                    sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
             FROM n{depth} WINDOW f AS ({by} ORDER BY c::DOUBLE / w::DOUBLE, {level})),
g{depth} AS (SELECT *, max((b - cum)::DOUBLE / rest::DOUBLE) OVER ({by}) AS lvl FROM o{depth}),
tree{depth + 1} AS (SELECT t.* EXCLUDE (given), least(g.c, floor(g.lvl * g.w))::BIGINT AS given FROM {tree} t JOIN g{depth} g USING ({node}))""")
    levels = ", ".join(MIX_LEVELS)
    return f"""
WITH s AS (SELECT doc_id, lang, source, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
r AS (SELECT doc_id, CASE WHEN k < 5 THEN 'web' WHEN k < 10 THEN 'books' WHEN k < 15 THEN 'news' WHEN k IS NOT NULL THEN 'forum' ELSE 'unknown' END AS domain,
             coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, n_tokens FROM s),
l AS (SELECT {levels}, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY {levels}),
tree0 AS (SELECT *, tokens * {MIX["max_epochs"]} AS cap, floor(sum(tokens) OVER () * {MIX["budget_share"]}::DOUBLE)::BIGINT AS given FROM l),{",".join(steps)},
p AS (SELECT {levels}, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS pre FROM tree{len(MIX_LEVELS)}),
k AS (SELECT r.*, p.full_epochs, p.pre, md5(concat_ws(':', '{MIX["seed"]}', full_epochs, doc_id)) AS h FROM r JOIN p USING ({levels})),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {levels} ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM k)
SELECT doc_id, {levels}, n_tokens, full_epochs::BIGINT AS full_epochs, greatest(0, least(n_tokens, pre - cum))::BIGINT AS prefix_tokens,
       (full_epochs * n_tokens + greatest(0, least(n_tokens, pre - cum)))::BIGINT AS drawn_tokens FROM c
"""


#: All pairs of documents that share a shingle, their exact overlap, and the components of the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, s, count(*) AS k FROM g GROUP BY doc_id, s),
n AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS common FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, least_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.least_id FROM r JOIN u ON u.a = r.node WHERE r.least_id < u.b),
m AS (SELECT node, min(least_id) AS class_id FROM r GROUP BY node)
SELECT node AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, node = class_id AS kept FROM m
"""


def _url_sql(levels: int = 6, z: float = 2.58, strength: float = 5.0, threshold: float = 0.5, least: int = 5) -> str:
    """The same tree, level by level, for paths of so many levels (those of ``pages`` have two)."""
    name, verdict = "NULL", "NULL"
    for decided, rule in sorted(URL_RULES, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}'))"
        name, verdict = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{decided}' ELSE {verdict} END"

    def apart(n1: str, b1: str, n2: str, b2: str) -> str:
        return f"coalesce(abs({b1}::DOUBLE * {n2} - {b2}::DOUBLE * {n1}) > {z}::DOUBLE * sqrt(({b1} + {b2})::DOUBLE * ({n1} + {n2} - {b1} - {b2}) * {n1} * {n2} / nullif({n1} + {n2}, 0)), FALSE)"

    steps = []
    for d in range(levels):
        steps.append(f"""
c{d} AS (SELECT host, prefix, l[{d + 1}] AS child, sum(n)::BIGINT AS cn, sum(b)::BIGINT AS cb FROM t{d} GROUP BY host, prefix, l[{d + 1}]),
e{d} AS (SELECT *, child <> '' AND cn >= {least} AS seen FROM c{d}),
s{d} AS (SELECT *, sum(cn) FILTER (WHERE seen) OVER w AS en, sum(cb) FILTER (WHERE seen) OVER w AS eb, count(*) FILTER (WHERE seen) OVER w AS ek,
                count(*) FILTER (WHERE child <> '' AND NOT seen) OVER w AS rare FROM e{d} WINDOW w AS (PARTITION BY host, prefix)),
h{d} AS (SELECT *, seen AND coalesce(cb::DOUBLE * en > eb::DOUBLE * cn, FALSE) AS high FROM s{d}),
g{d} AS (SELECT *, coalesce(sum(cn) FILTER (WHERE high) OVER w, 0) AS hn, coalesce(sum(cb) FILTER (WHERE high) OVER w, 0) AS hb, count(*) FILTER (WHERE high) OVER w AS hk FROM h{d} WINDOW w AS (PARTITION BY host, prefix)),
f{d} AS (SELECT *, {apart("hn", "hb", "(en - hn)", "(eb - hb)")} AS split FROM g{d}),
r{d} AS (SELECT *, CASE WHEN NOT split THEN en WHEN high THEN hn ELSE en - hn END - cn AS rn, CASE WHEN NOT split THEN eb WHEN high THEN hb ELSE eb - hb END - cb AS rb,
                CASE WHEN NOT split THEN ek WHEN high THEN hk ELSE ek - hk END AS rk, CASE WHEN split THEN ek - hk ELSE ek END AS lk FROM f{d}),
n{d} AS (SELECT host, prefix, child, CASE WHEN child = '' THEN prefix ELSE concat_ws('/', prefix, CASE WHEN NOT seen THEN CASE WHEN rare = 1 THEN child WHEN lk > 1 THEN '*?' ELSE '*' END
            WHEN rk = 1 OR {apart("cn", "cb", "rn", "rb")} THEN child WHEN split AND high THEN '*!' ELSE '*' END) END AS nxt FROM r{d}),
t{d + 1} AS (SELECT t.host, t.l, t.n, t.b, nxt AS prefix FROM t{d} t JOIN n{d} x ON t.host = x.host AND t.prefix = x.prefix AND t.l[{d + 1}] = x.child)""")
    last = f"t{levels}"
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, {name} AS rule, {verdict} AS ruled, string_split(regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g'), '[0-9]+', '#', 'g'), '/') AS ps FROM u),
w AS (SELECT * EXCLUDE (ps), list_transform(range(1, {levels + 1}), lambda i: coalesce(ps[i], '')) AS l FROM v),
t0 AS (SELECT host, l, count(ruled) AS n, count_if(ruled = 'block') AS b, '' AS prefix FROM w GROUP BY host, l),{",".join(steps)},
a AS (SELECT coalesce(sum(b)::DOUBLE / nullif(sum(n), 0), 0) AS overall FROM {last}),
g AS (SELECT host, prefix, sum(n) >= {least} AND (sum(b) + {strength}::DOUBLE * any_value(overall)) / (sum(n) + {strength}::DOUBLE) > {threshold}::DOUBLE AS impure FROM {last}, a GROUP BY host, prefix)
SELECT page_id, w.host, path, rule, coalesce(ruled, CASE WHEN impure THEN 'block' ELSE 'allow' END) AS verdict, t.prefix AS template, impure
FROM w JOIN {last} t USING (host, l) JOIN g ON g.host = t.host AND g.prefix = t.prefix
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to, 3 AS n_records FROM q
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS pre, '<M>' || substring(t, a + 1, b - a) AS mid, '<S>' || substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN pre || suf || mid WHEN 'spm' THEN suf || pre || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


#: CRC-32 of the decimal id bit by bit, levels as lists, proofs by place.
OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT doc_id AS of, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT) AS bytes FROM documents WHERE doc_id IS NOT NULL),
crc(of, bytes, i, step, c) AS (SELECT DISTINCT of, bytes, 1, 0, xor(4294967295, bytes[1]) FROM bits UNION ALL
    SELECT of, bytes, i + (step = 7)::INT, (step + 1) % 8, xor(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CASE WHEN step = 7 THEN coalesce(bytes[i + 1], 0) ELSE 0 END) FROM crc WHERE i <= len(bytes)),
bad AS (SELECT of FROM crc WHERE i > len(bytes) AND xor(c, 4294967295) % 7 = 0),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({" || ".join(_field_sql(c) for c in LEAF)}) AS leaf,
             sha256({" || ".join(_field_sql("n_chars + 1" if c == "n_chars" else c) for c in LEAF)}) AS other FROM documents),
p AS (SELECT doc_id, k, leaf, CASE WHEN doc_id IN (SELECT of FROM bad) THEN other ELSE leaf END AS shown, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
lv(k, level, nodes) AS (SELECT k, 0, list(leaf ORDER BY pos) FROM p GROUP BY k UNION ALL
    SELECT k, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT k, nodes[1] AS subroot, row_number() OVER (ORDER BY k) - 1 AS kpos FROM lv WHERE len(nodes) = 1),
top(level, nodes) AS (SELECT 0, list(subroot ORDER BY kpos) FROM sub UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], ''))) FROM top WHERE len(nodes) > 1),
depth AS (SELECT k, max(level) AS depth FROM lv GROUP BY k),
steps AS (SELECT p.doc_id, p.k, p.pos, lv.level AS step, (p.pos >> lv.level) % 2 = 1 AS is_right, nodes[xor(p.pos >> lv.level, 1) + 1] AS sibling FROM p JOIN lv USING (k) WHERE len(nodes) > 1
    UNION ALL SELECT p.doc_id, p.k, p.pos, depth + top.level, (kpos >> top.level) % 2 = 1, nodes[xor(kpos >> top.level, 1) + 1] FROM p JOIN sub USING (k) JOIN depth USING (k), top WHERE len(nodes) > 1),
paths AS (SELECT k, pos, list(struct_pack(r := is_right, s := sibling) ORDER BY step) AS path FROM steps GROUP BY k, pos),
fold(k, pos, path, i, node) AS (SELECT p.k, p.pos, coalesce(path, []), 1, shown FROM p LEFT JOIN paths USING (k, pos) UNION ALL
    SELECT k, pos, path, i + 1, sha256(CASE WHEN path[i].s IS NULL THEN node WHEN path[i].r THEN path[i].s || node ELSE node || path[i].s END) FROM fold WHERE i <= len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: coalesce(x.s, '')), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM p JOIN sub USING (k) JOIN (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1) ON TRUE JOIN (SELECT * FROM fold WHERE i > len(path)) USING (k, pos)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_language": op2_language,
        "op3_mix": op3_mix,
        "op4_url_filter": op4_url_filter,
        "op5_warc": op5_warc,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_secrets": op7_secrets,
        "op8_near_dedup": op8_near_dedup,
        "op9_shards": op9_shards,
        "op10_pack": op10_pack,
        "op11_infill": op11_infill,
        "op12_merkle": op12_merkle,
        "op13_simhash": op13_simhash,
        "quality_ablation": quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op3_mix": _mix_sql(), "op4_url_filter": _url_sql(), "op5_warc": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_near_dedup": OP8_SQL, "op11_infill": OP11_SQL, "op12_merkle": OP12_SQL, "quality_ablation": ABLATION_SQL}
