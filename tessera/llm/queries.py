"""Queries that apply the operators to their whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .tokens import public_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find, fit

    return digest(find(_read(spark, sf_dir, "documents"), fit(spark)))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import token_index, write_token_ids

    path = f"{Scratch(spark, 'token-orc').path}/ids"
    write_token_ids(_read(spark, sf_dir, "documents"), path, public_path(), end_id=0)
    return token_index(spark, path)


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS sh
      FROM (SELECT doc_id, ws, least(len(ws), 5) AS size, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, _read(spark, sf_dir, "documents"), public_path(), capacity=1024, end_id=2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .language_id import fit, identify

    docs = _read(spark, sf_dir, "documents")
    found = identify(spark, docs, fit(docs.filter(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .quality_trees import fit, score

    docs = _read(spark, sf_dir, "documents")
    found = score(spark, docs, fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, judge

    docs = _read(spark, sf_dir, "documents")
    found = judge(docs, fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, is_contaminated

    found = contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP4_SQL = """
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS gram
         FROM (SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM items WHERE len(ws) > 0)),
grams AS (SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS gram
          FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM low, (SELECT DISTINCT size FROM wins) WHERE len(ws) >= size)),
hits AS (SELECT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN wins w ON g.gram = w.gram AND g.size = w.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, find

    return digest(find(spark, _read(spark, sf_dir, "documents")))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    found = near_duplicates(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op7, which SQL can express."""
    from .quality_rules import judge

    return judge(_read(spark, sf_dir, "documents"), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_SPACE = "\\x20\\x09-\\x0D"
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op5, counted, and their text's length, which SQL can express."""
    from .pii import KINDS, base_spans

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], *[F.aggregate(k, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias(f"chars_{k}") for k in KINDS])


_LUHN = "list_sum(list_transform(list_reverse(string_split(regexp_replace(x, '[^0-9]', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
PII_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(coalesce(text, ''), '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS ip,
 regexp_extract_all(coalesce(text, ''), '[0-9](?:[\\x20-]?[0-9])+') AS card, regexp_extract_all(coalesce(text, ''), '\\+[0-9][\\x20().0-9-]+[0-9]') AS phone FROM documents),
k AS (SELECT doc_id, email, list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) <= 255))) AS ip,
 list_filter(card, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN}) AS card, list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS phone FROM d)
SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}, CAST(coalesce(list_sum(list_transform({k}, lambda x: length(x))), 0) AS BIGINT) AS chars_{k}" for k in ("email", "ip", "card", "phone"))} FROM k
"""


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op8, counted, and their text's length, which SQL can express."""
    from .secrets import KINDS, base_spans

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], *[F.aggregate(k, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias(f"chars_{k}") for k in KINDS])


_ASSIGN = "((?i:password|passwd|secret|token|api_?key)[\"\']?\\x20*[:=]\\x20*[\"\']?)([A-Za-z0-9+/_.=-]+)".replace("\'", "''")
SECRET_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_ASSIGN}') AS whole, regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2) AS value,
 list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18) AS access, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16) AS hex FROM documents),
k AS (SELECT doc_id, list_filter(whole, lambda x, i: length(value[i]) >= 12) AS assign, access, hex FROM d)
SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}, CAST(coalesce(list_sum(list_transform({k}, lambda x: length(x))), 0) AS BIGINT) AS chars_{k}" for k in ("assign", "access", "hex"))} FROM k
"""

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, failures, joint_failures

    flagged = failures(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return audit(joint_failures(flagged, "ABCDE"), "ABCDE")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
       CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, CAST(list_sum(list_transform(range(1, step + 1), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS BIGINT) AS upto FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (WHERE mask & upto = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & (upto - own) = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & (upto - own) <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & (upto - own) = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & (upto - own) = 0), 0) AS BIGINT) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variant_groups, vocabulary

    return variant_groups(spark, vocabulary(_read(spark, sf_dir, "documents")))


OP12_SQL = """
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+') AS ws FROM documents),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM low) GROUP BY ALL),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
h AS (SELECT w, n, length(w) AS len, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM run, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substring(w, 1, CAST(h % len AS INTEGER)) || substring(w, CAST(h % len AS INTEGER) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT del.word, v.word, v.n FROM del JOIN v ON del.less = v.word UNION SELECT v.word, del.word, del.n FROM del JOIN v ON del.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.at AS root FROM r JOIN f ON r.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON f.word = e.word
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    found = score(spark, docs, fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_quality_trees, op4_decontamination, op5_pii, op6_token_orc, op7_quality_rules, op8_secret_scan, op9_minhash_near_dup, op10_best_fit_packing, op11_filter_audit, op12_spelling_variants, op13_toxicity, quality_counts, pii_counts, secret_counts)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op9_minhash_near_dup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling_variants": OP12_SQL, "quality_counts": QUALITY_SQL, "pii_counts": PII_SQL, "secret_counts": SECRET_SQL}
