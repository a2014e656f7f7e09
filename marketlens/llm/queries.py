"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, fim, media, pieces, pii, quality, secrets, simhash, substrings, tokens, urls, warc
from .common import LOWER, UPPER, model_path, table


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_back(tokens.stored(table(spark, sf_dir, "documents"), model_path("byte_bpe_50k.json")))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id has no label
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; ids_sha256 is of the ids, comma-joined."""
    model = pieces.Pieces.load(model_path("piece_bpe_32k.model"))
    out = pieces.encoded(table(spark, sf_dir, "documents"), model, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rule decides are the labelled ones: the tables mark no other page."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint) AS n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.factored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = codes.coded(table(spark, sf_dir, "embeddings"))
    return done.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint) AS n_{rule.kind}") for k, rule in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_pieces": op5_pieces,
    "op6_urls": op6_urls,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_substrings": op10_substrings,
    "op11_fim": op11_fim,
    "op12_codes": op12_codes,
    "op13_secrets": op13_secrets,
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds one by one, each entry compared in whole."""
    zip_ = "list_sum(list_transform(list_zip(x.u, c.u), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    out = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS u FROM kept, range(8) t(p))",
        "c0 AS MATERIALIZED (SELECT p, e, u FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, c.e, {zip_} AS d FROM x JOIN c{k} c USING (p)) GROUP BY 1, 2)")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(w, u) AS u FROM c{k} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS w FROM (
            SELECT p, e, i, CAST((sum(u[i]) - ((sum(u[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM a{k} JOIN x USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(u) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (p, e))""")
    out.append(f"own AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    out.append(f"books AS (SELECT sha256(string_agg(array_to_string(u, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(out) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM own JOIN kept USING (vec_id), books"


def _secrets_sql() -> str:
    """Every rule searches every text."""
    rules = []
    for k, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("}+", "}").replace("'", "''") + "'"
        keep = f"len(regexp_extract(m, {p}, 1)) >= 6" if r.kind == "assign" else "true"
        rules.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, s, s + len(m) AS e FROM (SELECT doc_id, m[i] AS m, CAST(coalesce(list_sum(list_transform(b[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS b FROM d))) WHERE {keep}""")
    named = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(rules)})
SELECT d.doc_id, {counts}, sha256(coalesce({named} FILTER (k < {len(secrets.BASE)}), '')) AS base_sha256, coalesce({named}, '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


ORACLE: dict[str, str] = {
    "op11_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op12_codes": _codes_sql(),
    "op13_secrets": _secrets_sql(),
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + least(10, len(w)) - 1] AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
