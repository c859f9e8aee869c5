"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.llm import bpe, chat, decontamination, exact_dedup, html_text, language_id, near_dedup, ngram_lm, packing, runs, spotsigs, toxicity, turn_repair
from evidmill.llm.common import remainder_column, table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pattern())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_column("doc_id", 7) == 2
    rows = ngram_lm.score_corpus(spark, docs, docs.where(~held_out))
    return rows.withColumn("held_out", held_out)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_column("doc_id", 3) == 1
    model = language_id.fit(docs.where(~held_out))
    rows = language_id.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "language.*")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_column("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    rows = toxicity.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "toxicity.*", (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.report(runs.collapse(docs.select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.summaries(turn_repair.damaged(table(spark, sf_dir, "conversations")), F.col("_dropped"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {q.__name__: q for q in (op1_html_text, op2_best_fit_packing, op3_lm_scoring, op4_minhash_near_dedup, op5_language_id, op6_spotsigs, op7_byte_bpe, op8_exact_dedup, op9_toxicity, op10_chat_format,
                                  op11_periodic_runs, op12_conversation_repair, op13_decontamination)}

# crc32 for DuckDB, which has none: the table of 256 remainders, and the sum of the text ``s``.
_CRC_TABLE = """SELECT list(v ORDER BY k) AS crc FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"""

# One row of op12's repair: states m0 to m3 (none, system, user, assistant) hold the cheapest (cost, edits, lines) so far.
_EDIT = "struct_pack(c := {m}.c + {cost}, a := {m}.a || '{edit}', t := {m}.t || {lines})"


def _edit(state: str, cost: str, edit: str, line: str | None) -> str:
    return _EDIT.format(m=state, cost=cost, edit=edit, lines="''" if line is None else f"chr(10) || {line}")


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _taken(state: str, letter: str, role: str) -> list[str]:
    """Keeping and relabelling from a state, at a cost out of reach where the row doesn't allow it."""
    bad = "CASE WHEN f IN (1, 2) THEN 1000000 WHEN f = 3 THEN 5 ELSE 0 END"
    return [_edit(state, f"{bad} + CASE WHEN x = '{letter}' THEN 0 ELSE 1000000 END", "K", "role || ':' || text"), *([] if letter == "s" else [_edit(state, f"1 + {bad}", "R", f"'{role}:' || text")])]


def _inserted(n0: str, n1: str, n2: str, n3: str) -> str:
    user = _least(n2, *[_edit(n, "5", "I", "'user:'") for n in (n0, n1, n3)])
    return f"SELECT *, {_least('n3', _edit('m2', '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS m3 FROM (SELECT *, n0 AS m0, n1 AS m1, {user} AS m2 FROM {{rows}})"


_STEP = ", ".join(f"{sql} AS {name}" for name, sql in {
    "n0": _edit("m0", "2", "D", None),
    "n1": _least(_edit("m1", "2", "D", None), *_taken("m0", "s", "system")),
    "n2": _least(_edit("m2", "2", "D", None), *[o for m in ("m0", "m1", "m3") for o in _taken(m, "u", "user")]),
    "n3": _least(_edit("m3", "2", "D", None), *_taken("m2", "a", "assistant")),
}.items())
_NEVER = "struct_pack(c := 1000000000, a := '', t := '')"
_BEGIN = f"(SELECT k, struct_pack(c := 0, a := '', t := '') AS n0, {_NEVER} AS n1, {_NEVER} AS n2, {_NEVER} AS n3 FROM convs)"
_STATES = "m0, m1, m2, m3"

ORACLES = {
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op13_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                 list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM b WHERE len(w) > 0),
        n AS (SELECT DISTINCT n FROM v),
        p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n),
        m AS (SELECT p.r, p.i, v.n, v.item_id FROM p JOIN d USING (r) JOIN v ON v.n = p.n AND v.s = array_to_string(d.w[p.i:p.i + p.n - 1], ' ')),
        h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op11_periodic_runs": rf"""
        WITH t AS ({_CRC_TABLE}),
        d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT r, doc_id, w, len(w) AS n, {_CRC.format(s="coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM d, t),
        a AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
        e AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM a),
        w AS (SELECT r, n, unnest(w) AS s, unnest(range(n)) AS i FROM e),
        m AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m),
        u AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        v AS (SELECT r, start, length, min(q) AS period FROM u GROUP BY r, start, length),
        b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS place FROM v),
        x AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM v GROUP BY r),
        o AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM v),
        c AS (SELECT r, string_agg(s, ' ' ORDER BY i) AS kept FROM w ANTI JOIN o USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM e LEFT JOIN x USING (r) LEFT JOIN b ON b.r = e.r AND place = 1 LEFT JOIN c ON c.r = e.r""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE crcs AS ({_CRC_TABLE}),
        convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
        coded AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                         {_CRC.format(s="coalesce(CAST(conversations.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
                  FROM conversations JOIN convs ON conversations.conv_id IS NOT DISTINCT FROM convs.conv_id, crcs),
        hurt AS (SELECT k, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
        placed AS (SELECT *, left(role, 1) AS x, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS nth, lag(x) OVER (PARTITION BY k ORDER BY i) AS before FROM placed),
        marked AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM seen),
        counted AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
                           count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY k),
        walk AS (SELECT k, 0 AS i, {_STATES} FROM ({_inserted("n0", "n1", "n2", "n3").format(rows=_BEGIN)})
                 UNION ALL
                 SELECT k, i, {_STATES} FROM ({_inserted("n0", "n1", "n2", "n3").format(rows=f"(SELECT k, i, {_STEP} FROM (SELECT walk.k, marked.i, {_STATES}, x, f, role, text FROM walk JOIN marked ON marked.k = walk.k AND marked.i = walk.i + 1))")})),
        ends AS (SELECT walk.k, {_least("m0", "m3")} AS best FROM walk JOIN counted ON walk.k = counted.k AND walk.i = counted.n)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
        FROM convs LEFT JOIN counted USING (k) LEFT JOIN ends USING (k)""",
}
