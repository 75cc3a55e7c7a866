"""SQL equivalents of the queries, in DuckDB's dialect.

Queries without an entry: random damage (r10, r15, r17), digests of written files
(i4) and the smoke chain (m11).
"""

from __future__ import annotations

from lapidary.plans.sql_text import bytewise, normed

# fixed values: Unicode white space
BLANK = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE len({words(x)}) END"


def has(m: str, k: str) -> str:
    return f"list_contains(map_keys({m}), '{k}')"


def chars(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: substring({x}, i, 1))"


def group_split(rows: str, group: str, label: str, train: str = "0.8", valid: str = "0.1", seed: int = 1337) -> str:
    """CTEs ``_g`` (groups with part) over the rows of the CTE ``rows``."""
    return f"""
      _w AS (SELECT {group} AS grp, count(*) AS w FROM {rows} GROUP BY 1),
      _c AS (SELECT grp, w, sum(w) OVER (ORDER BY sha256('{seed}|{label}|' || coalesce(grp, chr(0))), grp ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS total FROM _w),
      _g AS (SELECT grp, CASE WHEN cum <= CAST({train} AS DOUBLE) * total OR cum = w THEN 'train'
                              WHEN cum <= (CAST({train} AS DOUBLE) + CAST({valid} AS DOUBLE)) * total THEN 'valid' ELSE 'test' END AS part FROM _c)"""


SIGNS = r"list_concat(regexp_extract_all({x}, '[\x{{13000}}-\x{{1345F}}]', 0), regexp_extract_all({x}, '<g>([^<]+)</g>', 1))"


def signs(x: str) -> str:
    return SIGNS.format(x=x)


RUNS = r"""
  _d AS (SELECT * REPLACE (lower(trim(regexp_replace(run_id, '\s+$', ''))) AS run_id, lower(trim(status)) AS status) FROM run_records),
  _r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (status <> 'registered')::INT DESC, received_at DESC, delivery_id DESC) AS k FROM _d),
  runs AS (SELECT * EXCLUDE (k), TRY_CAST(nullif(regexp_extract(all_metrics, '"\Q' || selection_metric || '\E"\s*:\s*(-?(?:\d[\d.eE+-]*|Infinity)|NaN)\s*[,}]', 1), '') AS DOUBLE) AS value
           FROM _r WHERE k = 1)"""

SLOTS = f"""
  _s AS (SELECT ord, s, row_number() OVER (PARTITION BY ord ORDER BY i) AS i FROM (
           SELECT ord, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT ord, {signs("fields['hieroglyphs']")} AS x FROM records WHERE fields['hieroglyphs'] IS NOT NULL))),
  _f AS (SELECT ord, s, min(i) AS i FROM _s GROUP BY 1, 2),
  counts AS (SELECT s AS sign, count(*) AS c FROM _f GROUP BY 1),
  slots AS (SELECT ord, arg_max(s, i) AS truth FROM _f GROUP BY 1),
  top AS (SELECT sign, c, row_number() OVER (ORDER BY c DESC, sign) AS r FROM counts),
  cum AS (SELECT sign, r, sum(c) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS cc, sum(c) OVER () AS t FROM top),
  bins AS (SELECT sign, CASE WHEN r < n // 3 THEN 'frequent' WHEN r < n * 2 // 3 THEN 'medium' ELSE 'rare' END AS bin
           FROM (SELECT sign, row_number() OVER (ORDER BY c DESC, sign) - 1 AS r, count(*) OVER () AS n FROM counts)),
  scores AS (SELECT coalesce(cc, (SELECT max(t) FROM cum)) AS s FROM slots LEFT JOIN cum ON truth = sign),
  qhat AS (SELECT s AS q, n FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM scores)
           WHERE r = CASE WHEN ceil((n + 1) * CAST(0.9 AS DOUBLE)) < n THEN ceil(ceil((n + 1) * CAST(0.9 AS DOUBLE)) / n * (n - 1)) ELSE n - 1 END)"""

TRAIN_EVAL = """
  _p AS (SELECT ord, min(part) AS part FROM split_parts WHERE scheme = 'random' AND tag = 'v1' GROUP BY 1),
  _x AS (SELECT part, fields['text'] AS t, records.ord FROM records JOIN _p USING (ord) WHERE fields['text'] IS NOT NULL)"""

PICKS = """
  _n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM _s),
  _m AS (SELECT b, CAST('0x' || substr(sha256('1234|' || b || '|' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM _n) AS k
         FROM (SELECT unnest(range(1000)) AS b) CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM _n))) AS slot))"""

FREQ = """
  _alpha AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS ch, unnest(range(26)) AS pos)"""

# German translations with their part, the removal of exact and near copies of train
DEDUP = f"""
  _t AS (SELECT ord, doc_id, coalesce(fields['translation_de'], '') AS v FROM records WHERE {has("fields", "translation_de")}), {group_split("_t", "doc_id", "document")},
  {normed("_q", "_t", "ord")}, _u AS (SELECT _t.ord, part, 1 AS g, coalesce(n, '') AS n FROM _t JOIN _g ON doc_id IS NOT DISTINCT FROM grp LEFT JOIN _q USING (ord)), {bytewise("_a", "_u", "g")},
  _b AS (SELECT n, length(n) AS l, translate(n, (SELECT f FROM _a), (SELECT t FROM _a)) AS x, bool_or(part = 'train') AS tr, bool_or(part <> 'train') AS ev FROM _u GROUP BY 1),
  _e AS (SELECT *, CAST(floor(l * CAST(0.1 AS DOUBLE)) AS INT) AS k FROM _b WHERE ev AND NOT tr),
  _z AS (SELECT DISTINCT e.n FROM _e e JOIN _b t ON t.tr AND abs(e.l - t.l) <= e.k WHERE e.k > 0 AND levenshtein(e.x, t.x) <= e.k),
  flags AS (SELECT ord, part, CASE WHEN part = 'train' THEN NULL WHEN n IN (SELECT n FROM _b WHERE tr) THEN 'exact' WHEN n IN (SELECT n FROM _z) THEN 'near' END AS removed FROM _u)"""



def grams(kind: str, pairs: str, orders: int) -> str:
    """CTE ``kind(id, n, m, h, r)``: matched, hypothesis and reference n-grams of the lists ``h`` and ``r`` of ``pairs(id, h, r)``."""
    side = lambda c: f"(SELECT id, n, array_to_string({c}[i : i + n - 1], chr(31)) AS g, count(*) AS k FROM (SELECT id, n, {c}, unnest(range(1, len({c}) - n + 2)) AS i FROM {pairs}, (SELECT unnest(range(1, {orders + 1})) AS n)) GROUP BY ALL)"
    return f"""
      _m{kind} AS (SELECT a.id, a.n, sum(least(a.k, b.k)) AS m FROM {side("h")} a JOIN {side("r")} b USING (id, n, g) GROUP BY 1, 2),
      {kind} AS (SELECT p.id, n, coalesce(m, 0) AS m, greatest(len(h) - n + 1, 0) AS h, greatest(len(r) - n + 1, 0) AS r FROM {pairs} p CROSS JOIN (SELECT unnest(range(1, {orders + 1})) AS n) LEFT JOIN _m{kind} USING (id, n))"""


def f_score(stats: str) -> str:
    """chrF of a relation ``(m, h, r)``, a row an order."""
    return f"SELECT CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END AS f FROM (SELECT avg(m / h) AS p, avg(m / r) AS q FROM ({stats}) WHERE h > 0 AND r > 0)"


def characters(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({x}, '{BLANK}+', '', 'g'), '(?s).')"


def cut_words(x: str) -> str:
    """Words with one punctuation mark at either end taken off."""
    mark = r"[!-/:-@\[-`{-~]"
    return f"""flatten(list_transform({words(x)}, lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '{mark}$') THEN [w[1 : length(w) - 1], w[length(w) :]]
      WHEN length(w) > 1 AND regexp_matches(w, '^{mark}') THEN [w[1 : 1], w[2 :]] ELSE [w] END))"""


def script_tokens(x: str) -> str:
    """Tokens of the standard evaluation scripts."""
    x = f"' ' || trim({x}) || ' '"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return words(x)


PAIRS = """
  _r AS (SELECT ord, fields['translation_de'] AS t, lag(fields['translation_de']) OVER (PARTITION BY corpus, doc_id ORDER BY ord) AS b FROM records WHERE fields['translation_de'] IS NOT NULL),
  _p AS (SELECT ord AS id, t, b FROM _r WHERE b IS NOT NULL)"""

SQL: dict[str, str] = {
    "g26_sentence_chrf": f"""
      WITH p AS (SELECT ord AS id, {characters("fields['src']")} AS h, {characters("fields['tgt']")} AS r FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL), {grams("g", "p", 6)}
      SELECT id, round(coalesce(({f_score("SELECT m, h, r FROM g WHERE g.id = p.id")}), 0), 6) AS chrf FROM p""",
    "g25_chrf_bleu": f"""
      WITH {PAIRS}, _pc AS (SELECT id, {characters("t")} AS h, {characters("b")} AS r FROM _p), _pw AS (SELECT id, {cut_words("t")} AS h, {cut_words("b")} AS r FROM _p),
      _pb AS (SELECT id, {script_tokens("t")} AS h, {script_tokens("b")} AS r FROM _p), {grams("c", "_pc", 6)}, {grams("w", "_pw", 2)}, {grams("b", "_pb", 4)},
      s AS (SELECT 'c' AS kind, * EXCLUDE (id) FROM c UNION ALL SELECT 'w', * EXCLUDE (id) FROM w UNION ALL SELECT 'b', * EXCLUDE (id) FROM b),
      t AS (SELECT kind, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM s GROUP BY 1, 2),
      z AS (SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS z FROM t WHERE kind = 'b'),
      l AS (SELECT sum(CASE WHEN m > 0 THEN ln(m / h) ELSE ln(1 / (pow(2, z) * h)) END) AS lp, count(*) AS k, sum(m) AS m, max(h) FILTER (n = 1) AS hl, max(r) FILTER (n = 1) AS rl FROM z WHERE h > 0)
      SELECT round(({f_score("SELECT * FROM t WHERE kind = 'c'")}), 6) AS chrf, round(({f_score("SELECT * FROM t WHERE kind IN ('c', 'w')")}), 6) AS chrf_plus,
             round(CASE WHEN m > 0 AND k = 4 THEN 100 * exp(lp / 4 + CASE WHEN hl >= rl THEN 0 ELSE 1 - rl / hl END) ELSE 0 END, 6) AS bleu FROM l""",
    "flagship_split_census": f"""
      WITH {group_split("documents", "CAST(doc_id AS VARCHAR)", "document")},
      x AS (SELECT d.doc_id, d.text, part FROM documents d JOIN _g ON CAST(d.doc_id AS VARCHAR) = grp),
      y AS (SELECT *, part <> 'train' AND trim(text) IN (SELECT trim(text) FROM x WHERE part = 'train') AS gone FROM x)
      SELECT part, count(*) AS n_checked, count(*) FILTER (gone) AS removed_exact, count(DISTINCT doc_id) FILTER (NOT gone) AS n_docs,
             sum(CASE WHEN gone THEN 0 ELSE {tokens("text")} END) AS n_tokens FROM y GROUP BY 1""",
    "a1_jsonl_round_trip": """
      SELECT ord, corpus, doc_id, sent_id, cardinality(fields) AS n_fields, cardinality(meta) AS n_meta, fields['text'] AS text, fields['hieroglyphs'] AS hieroglyphs,
             fields['translation_de'] AS translation_de, fields['src'] AS src, meta['authors'] AS authors, meta['dateNotBefore'] AS "dateNotBefore" FROM records""",
    "b1_normalized": f"""
      WITH _t AS (SELECT ord, fields['translation_de'] AS v FROM records WHERE {has("fields", "translation_de")}), {normed("_q", "_t", "ord")}
      SELECT _t.ord, CASE WHEN v IS NOT NULL THEN coalesce(n, '') END AS norm FROM _t LEFT JOIN _q USING (ord)""",
    "d1_dedup_flags": f"WITH {DEDUP} SELECT ord, part, removed FROM flags",
    "d1_dedup_report": f"""
      WITH {DEDUP} SELECT part, count(*) AS checked, count(*) FILTER (removed = 'exact') AS removed_exact, count(*) FILTER (removed = 'near') AS removed_near, count(*) FILTER (removed IS NULL) AS kept
      FROM flags WHERE part <> 'train' GROUP BY 1""",
    "b2_signs": f"SELECT ord, unnest(list_distinct({signs("fields['hieroglyphs']")})) AS sign FROM records",
    "b3_prepared_text": f"""
      SELECT ord, trim(regexp_replace(regexp_replace(fields['hieroglyphs'], '<g>[^<]*</g>', '▯', 'g'), '{BLANK}+', ' ', 'g')) AS prepared
      FROM records WHERE fields['hieroglyphs'] IS NOT NULL""",
    "b4_token_counts": f"SELECT ord, {tokens("fields['text']")} AS n_text, {tokens("fields['translation_de']")} AS n_translation FROM records",
    "b5_period_buckets": r"""
      WITH y AS (SELECT corpus, TRY_CAST(nullif(regexp_extract(trim(meta['dateNotBefore']), '^[+-]?\d{1,9}$', 0), '') AS INT) AS y FROM records)
      SELECT corpus, coalesce(CASE WHEN y IS NOT NULL THEN 'c' || CASE WHEN floor(y / 100) < 0 THEN '' ELSE '+' END || CAST(CAST(floor(y / 100) AS INT) AS VARCHAR) END, 'unknown') AS bucket, count(*) AS n
      FROM y GROUP BY 1, 2""",
    "b6_enciphered": """
      SELECT ord, translate(fields['src'], 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm') AS cipher,
             translate(translate(fields['src'], 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm'), 'qwertyuiopasdfghjklzxcvbnm', 'abcdefghijklmnopqrstuvwxyz') AS plain
      FROM records WHERE fields['src'] IS NOT NULL""",
    "b7_test_paths": """
      SELECT DISTINCT '/srv/data/' || corpus || '/splits/' || scheme || '/' || tag || '/' || part || '/records.jsonl' AS path, part = 'test' AS is_test FROM split_parts""",
    "b8_run_timestamps": r"""
      SELECT delivery_id, CAST(epoch(try_strptime(regexp_extract(trim(run_id), '^\d{8}-\d{6}', 0), '%Y%m%d-%H%M%S')) AS BIGINT) AS started FROM run_records""",
    "b9_b10_field_selection": f"""
      SELECT corpus, count(*) FILTER ({has("fields", "translation_de")} AND {tokens("fields['translation_de']")} > 0) AS filled,
             count(*) FILTER ({has("fields", "transliteration")} AND {has("fields", "translation_de")}) AS parallel,
             count(*) FILTER ({has("fields", "translation_de")}) AS present FROM records GROUP BY 1""",
    "b11_fonts": """
      SELECT corpus, CASE WHEN corpus LIKE 'tla%' THEN 'egyptian' WHEN corpus LIKE '%coptic%' THEN 'coptic' WHEN corpus LIKE '%hebrew%' THEN 'hebrew'
                          WHEN corpus LIKE '%greek%' THEN 'greek' WHEN corpus LIKE '%cuneiform%' THEN 'cuneiform' ELSE 'default' END AS font FROM corpora""",
    "c1_unique_ids": """
      SELECT ord, CASE WHEN n = 1 THEN sent_id ELSE sent_id || '#' || n END AS sent_id
      FROM (SELECT ord, sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY ord) AS n FROM records)""",
    "c2_cohorts": f"""
      WITH k AS (SELECT ord, {", ".join(f"CASE WHEN {has('meta', m)} THEN meta['{m}'] ELSE '' END AS k{i}" for i, m in enumerate(("dateNotBefore", "dateNotAfter", "authors")))} FROM records),
      f AS (SELECT ord, min(ord) OVER (PARTITION BY k0, k1, k2) AS f FROM k)
      SELECT ord, printf('x-d%05d', dense_rank() OVER (ORDER BY f)) AS doc_id FROM f""",
    "c4_running_index": """
      SELECT corpus, ord, lpad(CAST(row_number() OVER (PARTITION BY corpus ORDER BY ord) - 1 AS VARCHAR), 6, '0') AS "index" FROM records""",
    "s1_split_document": f"WITH {group_split('records', 'doc_id', 'document')} SELECT ord, part FROM records JOIN _g ON doc_id IS NOT DISTINCT FROM grp",
    "s2_split_random": """
      WITH r AS (SELECT ord, row_number() OVER (ORDER BY sha256('1337|random|' || ord), ord) - 1 AS rank, count(*) OVER () AS n FROM records)
      SELECT ord, rank, CASE WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train'
                             WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) + round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'valid' ELSE 'test' END AS part FROM r""",
    "s5_split_metadata": f"""
      WITH x AS (SELECT ord, CASE WHEN {has("meta", "authors")} THEN coalesce(meta['authors'], 'None') ELSE 'unknown' END AS g FROM records),
      {group_split("x", "g", "metadata:authors")} SELECT ord, part FROM x JOIN _g ON g = grp""",
    "s6_split_period": rf"""
      WITH y AS (SELECT ord, TRY_CAST(nullif(regexp_extract(trim(meta['dateNotBefore']), '^[+-]?\d{{1,9}}$', 0), '') AS INT) AS y FROM records),
      x AS (SELECT ord, coalesce(CASE WHEN y IS NOT NULL THEN 'c' || CASE WHEN floor(y / 100) < 0 THEN '' ELSE '+' END || CAST(CAST(floor(y / 100) AS INT) AS VARCHAR) END, 'unknown') AS g FROM y),
      {group_split("x", "g", "period")} SELECT ord, part FROM x JOIN _g ON g = grp""",
    "s8_split_sign_heldout": f"""
      WITH x AS (SELECT ord, doc_id, {signs("fields['hieroglyphs']")} AS s FROM records WHERE fields['hieroglyphs'] IS NOT NULL),
      n AS (SELECT sign, count(*) AS n FROM (SELECT DISTINCT ord, unnest(s) AS sign FROM x) GROUP BY 1),
      r AS (SELECT sign, row_number() OVER (ORDER BY n DESC, sign) - 1 AS rank, count(*) OVER () AS t FROM n),
      held AS (SELECT sign FROM r WHERE rank >= CAST(floor(t * CAST(0.25 AS DOUBLE)) AS INT) AND rank < CAST(floor(t * CAST(0.75 AS DOUBLE)) AS INT) ORDER BY sha256('1337|signs|' || sign), sign LIMIT 25),
      test AS (SELECT DISTINCT ord FROM (SELECT ord, unnest(s) AS sign FROM x) JOIN held USING (sign)),
      rest AS (SELECT * FROM x WHERE ord NOT IN (SELECT ord FROM test)),
      {group_split("rest", "doc_id", "sign_rest", "(CAST(0.8 AS DOUBLE) / (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)))", "(1 - CAST(0.8 AS DOUBLE) / (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)))")}
      SELECT ord, part FROM rest JOIN _g ON doc_id = grp UNION ALL SELECT ord, 'test' FROM test""",
    "s8_sign_ranks": f"""
      WITH n AS (SELECT sign, count(*) AS n_records FROM (SELECT DISTINCT ord, unnest({signs("fields['hieroglyphs']")}) AS sign FROM records) GROUP BY 1)
      SELECT sign, n_records, row_number() OVER (ORDER BY n_records DESC, sign) - 1 AS rank FROM n""",
    "s9_split_by_document_count": """
      WITH d AS (SELECT DISTINCT doc_id FROM records WHERE doc_id IS NOT NULL),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1337|random|' || doc_id), doc_id) - 1 AS rank, count(*) OVER () AS n FROM d),
      p AS (SELECT doc_id, CASE WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train'
                                WHEN rank < round_even(n * CAST(0.8 AS DOUBLE), 0) + round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'valid' ELSE 'test' END AS part FROM r)
      SELECT ord, part FROM records JOIN p USING (doc_id)""",
    "j1_catalogue_join": "SELECT domain, primary_lang, count(*) AS n FROM records LEFT JOIN corpora USING (corpus) GROUP BY 1, 2",
    "j4_exact_overlap": f"""
      WITH x AS (SELECT ord, doc_id, trim(fields['text']) AS t FROM records WHERE fields['text'] IS NOT NULL), {group_split("x", "doc_id", "document")},
      y AS (SELECT ord, part, t FROM x JOIN _g ON doc_id IS NOT DISTINCT FROM grp)
      SELECT ord, part FROM y WHERE part <> 'train' AND t IN (SELECT t FROM y WHERE part = 'train')""",
    "d5_new_ledger_lines": """
      WITH l AS (SELECT trim(concat_ws('|', run_id, status, completed_at)) AS line, batch_id AS b FROM run_records)
      SELECT line FROM l WHERE line <> '' GROUP BY 1 HAVING min(b) > (SELECT min(b) FROM l)""",
    "g1_ingest_stats": f"""
      SELECT corpus, count(*) AS n_records, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n_docs, sum({tokens("fields[primary_field]")}) AS n_tokens_primary
      FROM records LEFT JOIN corpora USING (corpus) GROUP BY 1""",
    "g1_field_coverage": "SELECT corpus, field, count(*) AS n FROM (SELECT corpus, unnest(map_keys(fields)) AS field FROM records) GROUP BY 1, 2",
    "g2_census": f"""
      WITH s AS (SELECT corpus, count(*) AS n_records, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n_docs, sum({tokens("fields[primary_field]")}) AS n_tokens_primary
                 FROM records LEFT JOIN corpora USING (corpus) GROUP BY 1)
      SELECT c.corpus, kind, n_records, n_docs, n_tokens_primary, CASE WHEN kind = 'stub' THEN 'stub' WHEN n_records IS NOT NULL THEN 'ingested' ELSE 'pending' END AS status
      FROM corpora c LEFT JOIN s USING (corpus)""",
    "g4_extension_histogram": """
      WITH f AS (SELECT coalesce(source, 'none') AS subset, '.' || lower(coalesce(domain, 'txt')) AS ext, coalesce(n_chars, 0) AS b FROM documents),
      t AS (SELECT subset, count(*) AS files, sum(b) AS bytes FROM f GROUP BY 1)
      SELECT subset, files, bytes, ext, count(*) AS n FROM f JOIN t USING (subset) GROUP BY ALL""",
    "g5_char_frequencies": f"""
      WITH {FREQ}, _c AS (SELECT unnest({chars("fields['src']")}) AS ch FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL),
      n AS (SELECT ch, pos, (SELECT count(*) FROM _c WHERE _c.ch = _alpha.ch) AS c FROM _alpha)
      SELECT ch, pos, round(c / sum(c) OVER (), 9) AS freq FROM n""",
    "j11_rank_match": f"""
      WITH {FREQ}, _a AS (SELECT unnest({chars("fields['src']")}) AS ch FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL),
      _b AS (SELECT unnest({chars("fields['transliteration']")}) AS ch FROM records WHERE fields['transliteration'] IS NOT NULL),
      a AS (SELECT ch AS src, row_number() OVER (ORDER BY (SELECT count(*) FROM _a WHERE _a.ch = _alpha.ch) DESC, pos) AS r FROM _alpha),
      b AS (SELECT ch AS tgt, row_number() OVER (ORDER BY (SELECT count(*) FROM _b WHERE _b.ch = _alpha.ch) DESC, pos) AS r FROM _alpha)
      SELECT src, tgt FROM a JOIN b USING (r)""",
    "g7_unigram_entropy": f"""
      WITH {TRAIN_EVAL},
      t AS (SELECT ch, count(*) AS c FROM (SELECT unnest({chars("t")}) AS ch FROM _x WHERE part = 'train') GROUP BY 1),
      e AS (SELECT ch, count(*) AS m FROM (SELECT unnest({chars("t")}) AS ch FROM _x WHERE part = 'valid') GROUP BY 1),
      x AS (SELECT sum(-ln((coalesce(c, 0) + 1) / ((SELECT sum(c) FROM t) + (SELECT count(*) FROM t) + 1)) * m) / sum(m) AS ce FROM e LEFT JOIN t USING (ch))
      SELECT round(ce, 8) AS ce, round(ce / ln(2), 8) AS bits FROM x""",
    "g8_bigram_entropy": f"""
      WITH {TRAIN_EVAL},
      _y AS (SELECT part, unnest(list_transform(range(1, length(t) + 1), lambda i: {{'a': CASE WHEN i = 1 THEN chr(2) ELSE substring(t, i - 1, 1) END, 'b': substring(t, i, 1)}})) AS p FROM _x),
      t AS (SELECT p.a AS a, p.b AS b, count(*) AS c FROM _y WHERE part = 'train' GROUP BY 1, 2),
      x AS (SELECT a, sum(c) AS ctx FROM t GROUP BY 1),
      v AS (SELECT count(DISTINCT b) AS v FROM t),
      e AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM _y WHERE part = 'valid' GROUP BY 1, 2)
      SELECT round(sum(-ln(CASE WHEN ctx IS NULL THEN 1 / (v + 1) ELSE (coalesce(c, 0) + 0.5::DOUBLE) / (ctx + 0.5::DOUBLE * (v + 1)) END) * n) / sum(n), 8) AS ce
      FROM e LEFT JOIN t USING (a, b) LEFT JOIN x USING (a) CROSS JOIN v""",
    "g9_char_vocabulary": f"""
      WITH c AS (SELECT ord, unnest({chars("fields['text']")}) AS ch, unnest(range(length(fields['text']))) AS p FROM records WHERE fields['text'] IS NOT NULL),
      n AS (SELECT ch, count(*) AS n, min({{'o': ord, 'p': p}}) AS f FROM c GROUP BY 1)
      SELECT ch, row_number() OVER (ORDER BY n DESC, f) + 3 AS id FROM n QUALIFY row_number() OVER (ORDER BY n DESC, f) <= 4096""",
    "g19_token_accuracy": r"""
      WITH p AS (SELECT regexp_split_to_array(trim(fields['src']), '\s+') AS r, regexp_split_to_array(trim(translate(fields['src'], 'aeiou', 'bfjpv')), '\s+') AS h
                 FROM records WHERE fields['src'] IS NOT NULL AND fields['tgt'] IS NOT NULL)
      SELECT round(sum(len(list_filter(range(1, len(r) + 1), lambda i: r[i] = h[i]))) / sum(len(r)), 9) AS accuracy FROM p""",
    "l4_latest_state": f"WITH {RUNS} SELECT run_id, family, status, seed, config_hash, round(value, 9) AS value FROM runs",
    "g10_family_counts": f"""
      WITH {RUNS} SELECT family, count(*) AS registered, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'abandoned') AS abandoned, count(*) FILTER (status NOT IN ('completed', 'failed', 'abandoned')) AS open FROM runs GROUP BY 1""",
    "g11_family_values": f"""
      WITH {RUNS} SELECT family, count(*) AS n_values, round(max(value), 9) AS best, round(quantile_cont(value, 0.5), 9) AS median, round(min(value), 9) AS worst
      FROM runs WHERE status = 'completed' AND value IS NOT NULL GROUP BY 1""",
    "g14_rank_stability": f"""
      WITH {RUNS}, b AS (SELECT family, seed, selection_metric AS c, max(value) AS v FROM runs WHERE status = 'completed' AND value IS NOT NULL GROUP BY 1, 2, 3),
      s AS (SELECT x.family, x.seed AS s1, y.seed AS s2, x.c, x.v AS v1, y.v AS v2 FROM b x JOIN b y ON x.family = y.family AND x.c = y.c AND x.seed < y.seed),
      n AS (SELECT family, s1, s2, count(*) AS n FROM s GROUP BY 1, 2, 3),
      t AS (SELECT x.family, x.s1, x.s2, sum(sign(x.v1 - y.v1) * sign(x.v2 - y.v2)) AS t FROM s x JOIN s y ON x.family = y.family AND x.s1 = y.s1 AND x.s2 = y.s2 AND x.c < y.c GROUP BY 1, 2, 3)
      SELECT family, count(*) AS n_seed_pairs, round(avg(t / (n * (n - 1) / 2)), 9) AS rank_stability FROM n JOIN t USING (family, s1, s2) WHERE n > 1 GROUP BY 1""",
    "g15_kendall_tau": """
      WITH p AS (SELECT p_type, p_brand, round(avg(p_retailprice), 6) AS a, avg(p_size) AS b FROM part GROUP BY 1, 2),
      n AS (SELECT p_type, count(*) AS n FROM p GROUP BY 1),
      t AS (SELECT x.p_type, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS t FROM p x JOIN p y ON x.p_type = y.p_type AND x.p_brand < y.p_brand GROUP BY 1)
      SELECT p_type, n, CASE WHEN n > 1 THEN round(coalesce(t, 0) / (n * (n - 1) / 2), 9) END AS tau FROM n LEFT JOIN t USING (p_type)""",
    "w2_variants_so_far": f"WITH {RUNS} SELECT run_id, family, row_number() OVER (PARTITION BY family ORDER BY registered_at, run_id) AS n_variants FROM runs",
    "b12_run_list": f"WITH {RUNS} SELECT run_id, family, phase FROM runs WHERE status = 'failed'",
    "g16_recall": f"""
      WITH {SLOTS}, h AS (SELECT coalesce(bin, 'all') AS bin, coalesce(r, 9999) AS r FROM slots LEFT JOIN bins ON truth = bins.sign LEFT JOIN top ON truth = top.sign)
      SELECT bin, count(*) AS n_slots, round(avg((r <= 1)::INT), 9) AS recall_1, round(avg((r <= 5)::INT), 9) AS recall_5, round(avg((r <= 20)::INT), 9) AS recall_20 FROM h GROUP BY ROLLUP (bin)""",
    "g17_frequency_bins": f"WITH {SLOTS} SELECT sign, bin FROM bins",
    "g18_calibration_error": """
      WITH p AS (SELECT l_discount * 9 AS conf, (l_returnflag = 'R')::INT AS hit FROM lineitem),
      b AS (SELECT len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: conf > e)) AS b, count(*) AS n, avg(hit) AS acc, avg(conf) AS c FROM p WHERE conf BETWEEN 0 AND 1 GROUP BY 1)
      SELECT round(sum(n / (SELECT count(*) FROM p) * abs(acc - c)), 8) AS ece FROM b""",
    "g21_conformal_threshold": f"WITH {SLOTS} SELECT round(q / (SELECT max(t) FROM cum), 9) AS qhat, n FROM qhat",
    "g22_conformal_sets": f"""
      WITH {SLOTS}, z AS (SELECT coalesce(min(r) FILTER (cc >= (SELECT q FROM qhat)), max(r)) AS size FROM cum),
      h AS (SELECT coalesce(r <= (SELECT size FROM z), false)::INT AS hit FROM slots LEFT JOIN cum ON truth = sign)
      SELECT round(avg(hit), 9) AS coverage, round((SELECT size FROM z)::DOUBLE, 9) AS mean_size, (SELECT size FROM z)::DOUBLE AS median_size, count(*) AS n FROM h""",
    "g23_block_bootstrap": f"""
      WITH _s AS (SELECT doc_id, sum(n_chars) AS s, count(*) AS c FROM documents WHERE n_chars IS NOT NULL GROUP BY 1), {PICKS},
      v AS (SELECT b, sum(s) / sum(c) AS v FROM _m JOIN _n USING (k) GROUP BY 1)
      SELECT round((SELECT sum(s) / sum(c) FROM _s), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, (SELECT count(*) FROM _s) AS n_docs FROM v""",
    "g24_paired_bootstrap": f"""
      WITH _s AS (SELECT doc_id, sum(length(text)) AS sa, sum(length(text) - doc_id % 7 + 3) AS sb, count(*) AS c FROM documents GROUP BY 1), {PICKS},
      o AS (SELECT (sum(sa) - sum(sb)) / sum(c) AS d FROM _s),
      v AS (SELECT b, (sum(sa) - sum(sb)) / sum(c) AS v FROM _m JOIN _n USING (k) GROUP BY 1),
      q AS (SELECT quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, avg((v * sign((SELECT d FROM o)) <= 0)::INT) AS rev FROM v)
      SELECT round((SELECT d FROM o), 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(least(1, 2 * rev), 6) AS p_value, low > 0 OR high < 0 AS significant FROM q""",
    "w10_windows": """
      SELECT vec_id, i::INT AS i, 24 AS width, round(list_sum(list_transform(list_slice(embedding, i * 12 + 1, i * 12 + 24), lambda x: x::DOUBLE)) + greatest(i * 12 + 24 - len(embedding), 0), 5) AS total
      FROM embeddings, (SELECT unnest(range(5)) AS i)""",
    "w5_moving_average": """
      SELECT vec_id, i::INT AS i, round((embedding[greatest(i, 1)]::DOUBLE + embedding[i + 1]::DOUBLE + embedding[least(i + 2, 64)]::DOUBLE) / 3, 6) AS x
      FROM embeddings, (SELECT unnest(range(64)) AS i)""",
    "r13_standardised": """
      WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS i FROM embeddings)
      SELECT vec_id, i, round((x - avg(x) OVER (PARTITION BY vec_id)) / (stddev_samp(x) OVER (PARTITION BY vec_id) + 1e-6), 5) AS x FROM e""",
    "g28_ink_fraction": "SELECT vec_id, round(len(list_filter(embedding, lambda x: x < 0.5)) / len(embedding), 9) AS ink FROM embeddings",
    "r11_trimmed": """
      WITH e AS (SELECT vec_id, list_filter(range(64), lambda i: 1 - abs(embedding[i + 1]) * 4 < 0.5) AS k FROM embeddings)
      SELECT vec_id, CASE WHEN len(k) = 0 THEN 64 ELSE least(list_max(k) + 3, 64) - greatest(list_min(k) - 2, 0) END::INT AS width FROM e""",
    "p6_found": """
      WITH m AS (
        SELECT delivery_id, row_number() OVER (
          PARTITION BY lower(trim(run_id, E' \\t\\n\\r')), lower(trim(status, E' \\t\\n\\r')), floor(epoch(CAST(completed_at AS TIMESTAMPTZ)))
          ORDER BY received_at, delivery_id) AS n
        FROM run_records)
      SELECT delivery_id FROM m WHERE n > 1""",
}
