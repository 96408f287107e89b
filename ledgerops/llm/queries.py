"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerops.llm import (
    decontaminate, fingerprints, html_text, langid, licenses, merkle, mixing, near_vectors, ngram_join, periodic, secrets, toxicity, warc,
)
from ledgerops.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf, "documents").select("doc_id", "text"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic"))


@query("op3_license_scan", licenses.oracle_sql())
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.licenses(table(spark, sf, "documents").select("doc_id", "text"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf, "documents").select("doc_id", "text")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query(
    "op6_benchmark_decontamination",
    f"""
    WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS span, w[p : p + least(len(w), 10) - 1] AS gram
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
    spans AS (SELECT DISTINCT span FROM iw),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    dw AS (SELECT r, p, span, w[p : p + span - 1] AS gram FROM (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM d, spans WHERE len(w) >= span)),
    m AS (SELECT r, p, dw.span, item_id FROM dw JOIN iw ON dw.span = iw.span AND dw.gram = iw.gram),
    h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + span)) AS q FROM m) GROUP BY r),
    n AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))


@query("op7_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_id")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf, "documents").select("doc_id", "text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.repeat_tails(table(spark, sf, "documents"))))


@query(
    "op12_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT r, vec_id, e FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
    links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(r, x) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.x),
    c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.x GROUP BY reach.r),
    n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors.near_groups(table(spark, sf, "embeddings"))


_CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _merkle_sql() -> str:
    """Levels by recursion, siblings by joins of each leaf with its ancestors' runs, and folding by recursion over the levels."""
    fields = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    up = "SELECT lvl + 1, k, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM {t} WHERE n > 1 GROUP BY lvl, k, pos // 3, n"
    return f"""
    WITH RECURSIVE {_CRC},
    ids AS (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)) AS codes FROM documents),
    h AS (SELECT ids.*, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM ids, crc),
    leaves AS (
      SELECT doc_id, coalesce('=' || source, '') AS k, sha256({fields} || {_field("text")}) AS leaf,
             sha256({fields} || {_field("CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS now FROM h),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaves),
    tree(lvl, k, pos, d, n) AS (SELECT 0, k, pos, leaf, n FROM placed UNION ALL {up.format(t="tree")}),
    subs AS (SELECT k, d AS subroot, lvl AS depth, row_number() OVER (ORDER BY k) - 1 AS spos, count(*) OVER () AS sn FROM tree WHERE n = 1),
    top(lvl, k, pos, d, n) AS (SELECT 0, '', spos, subroot, sn FROM subs UNION ALL {up.format(t="top")}),
    rows_ AS (SELECT row_number() OVER () AS r, placed.*, subroot, depth, spos, (SELECT d FROM top WHERE n = 1) AS root FROM placed JOIN subs USING (k)),
    steps AS (
      SELECT r, s.lvl AS lvl, s.pos AS pos, s.d AS d, s.pos < rows_.pos // CAST(power(3, s.lvl) AS BIGINT) AS l FROM rows_ JOIN tree s
        ON s.k = rows_.k AND s.pos // 3 = rows_.pos // CAST(power(3, s.lvl + 1) AS BIGINT) AND s.pos <> rows_.pos // CAST(power(3, s.lvl) AS BIGINT)
      UNION ALL
      SELECT r, depth + s.lvl, s.pos, s.d, s.pos < spos // CAST(power(3, s.lvl) AS BIGINT) FROM rows_ JOIN top s
        ON s.pos // 3 = spos // CAST(power(3, s.lvl + 1) AS BIGINT) AND s.pos <> spos // CAST(power(3, s.lvl) AS BIGINT)),
    proofs AS (SELECT r, string_agg(d, '' ORDER BY lvl, pos) AS proof FROM steps GROUP BY r),
    sides AS (SELECT r, lvl, coalesce(string_agg(d, '' ORDER BY pos) FILTER (l), '') AS lt, coalesce(string_agg(d, '' ORDER BY pos) FILTER (NOT l), '') AS rt FROM steps GROUP BY r, lvl),
    height AS (SELECT (SELECT max(lvl) FROM top) AS h),
    fold(lvl, r, acc, levels) AS (
      SELECT 0, r, now, depth + h FROM rows_, height
      UNION ALL
      SELECT fold.lvl + 1, fold.r, sha256(coalesce(lt, '') || acc || coalesce(rt, '')), levels FROM fold LEFT JOIN sides ON sides.r = fold.r AND sides.lvl = fold.lvl WHERE fold.lvl < levels)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, acc AS folded_root, acc = root AS verified
    FROM rows_ JOIN fold ON fold.r = rows_.r AND fold.lvl = fold.levels LEFT JOIN proofs ON proofs.r = rows_.r"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verified(table(spark, sf, "documents"))
